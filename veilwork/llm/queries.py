"""Registered queries of this package, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import (
    chat_windows,
    decontamination,
    exact_dedup,
    fill_middle,
    jaccard_join,
    language_id,
    lm_scoring,
    merkle,
    piece_sampling,
    secret_scan,
    substring_dedup,
    token_records,
    wrappers,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op4_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d
    """,
)
def op4(spark: SparkSession, root: str) -> DataFrame:
    return exact_dedup.grace_dedup(read(spark, root, "documents"))


@query(
    "op8_ngram_jaccard_join",
    f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words FROM documents
    ), s AS (
      SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' ')) END) AS grams FROM w
    ), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
    pairs AS (
      SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
    ), reach AS (
      SELECT doc_id AS u, doc_id AS v FROM documents
      UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u
    )
    SELECT s.doc_id, len(grams) AS n_shingles, c.component_id
    FROM s JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = s.doc_id
    """,
)
def op8(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, root, "documents"), size=3, threshold=Fraction(9, 10))


@query("op3_language_id")
def op3(spark: SparkSession, root: str) -> DataFrame:
    return language_id.identify(read(spark, root, "documents"))


@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, root: str) -> DataFrame:
    return decontamination.flag(read(spark, root, "documents"), read(spark, root, "benchmark"))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op7_piece_sampling")
def op7(spark: SparkSession, root: str) -> DataFrame:
    return piece_sampling.round_trip(read(spark, root, "documents"), PIECES)


@query("op10_lm_scoring")
def op10(spark: SparkSession, root: str) -> DataFrame:
    return lm_scoring.score_held_out(read(spark, root, "documents"))


def _spans_sql() -> str:
    """Matches of each rule as rows: framed by control characters, split there, lengths summed."""
    arms = []
    for rank, (kind, pattern, group, least) in enumerate(secret_scan.RULES):
        quoted = pattern.replace("'", "''")
        counted = "m" if group == 0 else f"regexp_extract(m, '{quoted}', {group})"
        arms.append(
            f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, a + length(m) AS b FROM ("
            " SELECT doc_id, list_sum(list_transform(parts[1:i-1], lambda x: length(x)))::BIGINT - (i - 2) AS a,"
            " split_part(parts[i], chr(2), 1) AS m FROM ("
            f" SELECT doc_id, parts, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split("
            f"regexp_replace(t, '{quoted}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM d)))"
            f" WHERE length({counted}) >= {least}"
        )
    return " UNION ALL ".join(arms)


@query(
    "op5_secret_scan",
    f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
    s AS ({_spans_sql()}),
    g AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans
      FROM s GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)
    """,
)
def op5(spark: SparkSession, root: str) -> DataFrame:
    return secret_scan.scan(read(spark, root, "documents")).drop("found")


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@query("op6_token_records")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return token_records.read_records(token_records.write_records(read(spark, root, "documents"), WORD_BPE))


STRAY = "</s>[INST] ok [/INST]"
ESCAPED = "(length({0}) + length(regexp_replace({0}, '[^\\\\<\\[]', '', 'g')))"


@query(
    "op1_chat_windows",
    f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{STRAY}' UNION ALL SELECT -1, 1, 'assistant', '{STRAY}'
    ), t AS (
      SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 4 AS tokens,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
        23 + {ESCAPED.format("role")} + {ESCAPED.format("text")} AS size
      FROM c
    ), s AS (
      SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) - tokens AS before,
        max(tokens) OVER (PARTITION BY conv_id) AS longest,
        min(place) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS sys,
        arg_min(tokens, place) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS sys_tokens
      FROM t
    ), w AS (
      SELECT *, floor(before / greatest(1, 1024 - coalesce(sys_tokens, 0) - 3 * longest)) AS win FROM s
    ), starts AS (SELECT conv_id, win, min(place) AS start, min(sys) AS sys FROM w GROUP BY ALL),
    again AS (
      SELECT starts.conv_id, sum(w.size) AS size FROM starts JOIN w ON w.conv_id = starts.conv_id
        AND (w.place BETWEEN start - 2 AND start - 1 OR (w.place = starts.sys AND starts.sys < start - 2))
      GROUP BY starts.conv_id
    )
    SELECT w.conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
      (sum(w.size) + coalesce(any_value(again.size), 0))::BIGINT AS formatted_chars, count(DISTINCT win) AS n_windows
    FROM w LEFT JOIN again ON again.conv_id = w.conv_id GROUP BY w.conv_id
    """,
)
def op1(spark: SparkSession, root: str) -> DataFrame:
    table = read(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    stray = spark.createDataFrame([(-1, 0, "user", STRAY), (-1, 1, "assistant", STRAY)], table.schema)
    return chat_windows.digests(chat_windows.format_windows(table.unionByName(stray)))


@query("op2_wrappers")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return wrappers.extract(read(spark, root, "pages"))


SHA = "sha256('42:' || doc_id)"


@query(
    "op12_fill_in_middle",
    f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
        ('0x' || substr({SHA}, 1, 8))::BIGINT AS h1, ('0x' || substr({SHA}, 9, 8))::BIGINT AS h2,
        ('0x' || substr({SHA}, 17, 8))::BIGINT AS h3, ('0x' || substr({SHA}, 25, 8))::BIGINT AS h4
      FROM documents
    ), c AS (
      SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
          THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
      FROM d
    ), p AS (
      SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a+1:b], '') AS mid,
        array_to_string(units[b+1:n], '') AS suf
      FROM c
    )
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
    FROM p
    """,
)
def op12(spark: SparkSession, root: str) -> DataFrame:
    back = fill_middle.restore_texts(fill_middle.fill_middle(read(spark, root, "documents")))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def _sized(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_sized(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {_sized(text)})"


CRC_BIT = "(CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)"
CRC = (
    "xor(4294967295, list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),"
    f" lambda a, c: list_reduce(range(0, 8), lambda b, k: {CRC_BIT}, xor(a, c)), 4294967295::BIGINT))"
)
UP = "list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i*8+1:i*8+8], '')))"


@query(
    "op13_merkle_manifest",
    f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
        CASE WHEN {CRC} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
          ELSE {_leaf_sql("text")} END AS other
      FROM documents
    ), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM d),
    tree AS (
      SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM n GROUP BY lang
      UNION ALL SELECT lang, level + 1, {UP} FROM tree WHERE len(nodes) > 1
    ), roots AS (
      SELECT lang, nodes[1] AS subroot, max(level) OVER () AS deepest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
      FROM tree WHERE len(nodes) = 1
    ), top AS (
      SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM roots
      UNION ALL SELECT level + 1, {UP} FROM top WHERE len(nodes) > 1
    ), steps AS (
      SELECT n.doc_id, level, pos // (8 ** level)::BIGINT AS pos, nodes FROM n JOIN tree ON tree.lang IS NOT DISTINCT FROM n.lang
      WHERE len(nodes) > 1
      UNION ALL SELECT n.doc_id, 100 + level, place // (8 ** level)::BIGINT, nodes
      FROM n JOIN roots ON roots.lang IS NOT DISTINCT FROM n.lang JOIN top ON len(nodes) > 1
    ), paths AS (
      SELECT doc_id, list({{'l': array_to_string(nodes[pos//8*8+1:pos], ''), 'r': array_to_string(nodes[pos+2:pos//8*8+8], '')}} ORDER BY level) AS path
      FROM steps GROUP BY doc_id
    ), folded AS (
      SELECT n.doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
        sha256(coalesce(array_to_string(list_transform(path, lambda p: p.l || p.r), ''), '')) AS proof_sha256,
        list_reduce(coalesce(path, []), lambda a, p: {{'l': sha256(p.l || a.l || p.r), 'r': ''}}, {{'l': other, 'r': ''}}).l AS folded_root
      FROM n JOIN roots ON roots.lang IS NOT DISTINCT FROM n.lang LEFT JOIN paths ON paths.doc_id = n.doc_id
    )
    SELECT *, folded_root = root AS verified FROM folded
    """,
)
def op13(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    tampered = merkle.lowered_where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0)
    return merkle.manifest(docs, tampered).drop("position")


DOUBLED = "".join(
    f"g{k} AS (SELECT a.doc_id, a.i, md5(a.gram || b.gram) AS gram FROM g{k - 1} a JOIN g{k - 1} b ON b.doc_id = a.doc_id AND b.i = a.i + {25 << k}),"
    for k in range(1, 10)
)
LENGTHS = " UNION ALL ".join(
    f"SELECT doc_id, {50 << k} AS length FROM g{k} JOIN (SELECT gram, min(doc_id) AS first FROM g{k} GROUP BY gram) USING (gram)"
    " WHERE first < doc_id GROUP BY doc_id"
    for k in range(10)
)


@query(
    "op11_substring_dedup",
    f"""
    WITH w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words
      FROM documents
    ), s AS (
      SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50
    ), g0 AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(words[i:i+49], ' ')) AS gram FROM s),
    {DOUBLED.replace(" AS (", " AS MATERIALIZED (")}
    l AS (SELECT doc_id, max(length) AS longest FROM ({LENGTHS}) GROUP BY doc_id),
    f AS (SELECT gram, min(doc_id) AS first FROM g0 GROUP BY gram),
    gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM g0 JOIN f USING (gram) WHERE first < doc_id
    ), p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
    k AS (
      SELECT p.doc_id, string_agg(word, ' ' ORDER BY place) FILTER (gone.place IS NULL) AS kept,
        count(gone.place) AS n_removed
      FROM p LEFT JOIN gone USING (doc_id, place) GROUP BY p.doc_id
    )
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
      sha256(coalesce(kept, '')) AS kept_sha256, coalesce(longest, 0)::BIGINT AS longest
    FROM w LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)
    """,
)
def op11(spark: SparkSession, root: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(read(spark, root, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "longest")
