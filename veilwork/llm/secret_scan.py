"""Secret scanning with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query of trigrams that every match must contain (lower-cased).  The
index has the posting lists of the trigrams that the rules ask for, per shard of documents, so a list is bounded.
Queries intersect and unite the lists of a shard; candidates are verified on their whole text with the rule itself.
A rule without a mandatory trigram scans every text.  Texts are joined with their candidate rules by id, so an id or
source of many rows splits as any equi-join does.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.store import Workspace

# Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
# Public token formats, found besides the base kinds.
MORE = (
    ("git", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abps]-[A-Za-z0-9-]{10,}", 0, 15),
    ("maps", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("pay", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)
RULES = BASE + MORE
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
TERMS = 64  # alternatives that a query may have


def _all(left, right):
    """Both queries; None asks for nothing.  Too many alternatives: the left one alone, which is weaker but right."""
    if left is None or right is None:
        return left if right is None else right
    both = {a | b for a, b in product(left, right)}
    return both if len(both) <= TERMS else left


def _of_strings(strings: set[str]):
    grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in grams else grams


def _node(op, value) -> tuple[set[str] | None, set[frozenset[str]] | None]:
    """All lower-cased strings of a node if there are few, and a query that every match satisfies."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, None
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
        return {chr(v).lower() for _, v in value}, None
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "BRANCH":
        arms = [_sequence(arm) for arm in value[1]]
        if all(strings is not None for strings, _ in arms):
            return set().union(*(strings for strings, _ in arms)), None
        queries = [q if s is None else _of_strings(s) for s, q in arms]
        return None, None if None in queries else set().union(*queries)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and most <= 4 and len(strings) ** most <= TERMS:
            return {"".join(x) for n in range(least, most + 1) for x in product(strings, repeat=n)}, None
        return None, None if least == 0 else query if strings is None else _of_strings(strings)
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, set[frozenset[str]] | None]:
    run, query, whole = {""}, None, True
    for op, value in nodes:
        strings, own = _node(op, value)
        if strings is not None and len(run) * len(strings) <= TERMS:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, whole = _all(_all(query, _of_strings(run)), own), False
        run = strings if strings is not None else {""}
    return (run, None) if whole else (None, _all(query, _of_strings(run)))


def trigram_query(pattern: str) -> set[frozenset[str]] | None:
    """Alternatives of trigram sets, one of which every match contains; None if there is no such set."""
    strings, query = _sequence(re._parser.parse(pattern))
    query = _of_strings(strings) if strings is not None else query
    return query and {term for term in query if not any(other < term for other in query)}


def _postings(space: Workspace, keyed: DataFrame, grams: list[str], shard_rows: int) -> DataFrame:
    """``shard, lists`` (trigram number to posting list) of the trigrams that the rules ask for."""
    shards = max(1, math.ceil(keyed.count() / shard_rows))
    low = keyed.select("key", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(i)) for i, g in enumerate(grams)]))
    hits = low.select("key", F.explode(has).alias("gram"))
    lists = hits.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "gram").agg(F.collect_set("key").alias("ids"))
    return lists.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))


def _candidates(postings: DataFrame, queries: dict[int, set[frozenset[str]]], grams: list[str]) -> DataFrame:
    """``key, rules``: the rules whose trigram query a document satisfies."""
    none = F.array().cast("array<string>")
    number = {g: i for i, g in enumerate(grams)}

    def posting(gram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(number[gram])), none)

    def rule(query) -> Column:
        alternatives = [reduce(F.array_intersect, [posting(g) for g in sorted(term)]) for term in sorted(query, key=sorted)]
        return reduce(F.array_union, alternatives)

    each = F.array(*[F.struct(F.lit(r).alias("rule"), rule(q).alias("ids")) for r, q in queries.items()])
    rows = postings.select(F.explode(each).alias("c")).select("c.rule", F.explode("c.ids").alias("key"))
    return rows.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches in ``clean``, as code points: matches are framed, then lengths are summed."""
    marked = F.split(F.regexp_replace("clean", F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    text = F.substring_index

    def add(so_far: Column, part: Column) -> Column:
        match = text(part, CLOSE, 1)
        end = so_far["at"] + F.length(match)
        counted = F.length(match) if group == 0 else F.length(F.regexp_extract(match, pattern, group))
        span = F.struct(so_far["at"].alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(
            (so_far["at"] + F.length(part) - 1).alias("at"),
            F.when(counted >= least, F.concat(so_far["out"], F.array(span))).otherwise(so_far["out"]).alias("out"),
        )

    first = F.struct(F.length(marked[0]).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), first, add, lambda x: x["out"])


SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_rows: int = 4096) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found``.

    Null texts count as empty.  Ids may be null or repeated: every row's own text is verified.  Offsets are code
    points, ends exclusive; control characters in a text never move them.
    """
    space = Workspace(docs.sparkSession, "secrets")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("key"),
    )
    queries = {r: q for r, (_, pattern, _, _) in enumerate(RULES) if (q := trigram_query(pattern)) is not None}
    grams = sorted({g for q in queries.values() for term in q for g in term})
    postings = space.save(_postings(space, rows.select("key", "text"), grams, shard_rows), "postings")
    candidates = space.save(_candidates(postings, queries, grams), "candidates")
    joined = rows.join(candidates, "key", "left")
    framed = F.col("text").contains(OPEN) | F.col("text").contains(CLOSE)
    clean = F.when(framed, F.translate("text", OPEN + CLOSE, OTHER + OTHER)).otherwise(F.col("text"))
    read = joined.select("doc_id", "rules", clean.alias("clean"))
    none = F.array().cast(SPANS)
    found = []
    for r, (kind, pattern, group, least) in enumerate(RULES):
        asked = F.array_contains("rules", r) if r in queries else F.col("clean").rlike(_least_run(pattern, least))
        found.append(F.when(asked, _spans(kind, r, pattern, group, least)).otherwise(none).alias(kind))
    spans = read.select("doc_id", *found)
    base = spans.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE],
        F.array_sort(F.concat(*[F.col(k) for k, *_ in BASE])).alias("base"),
        F.array_sort(F.concat(*[F.col(k) for k, *_ in RULES])).alias("found"),
    )

    def listed(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return base.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"), "found"
    )


def _least_run(pattern: str, least: int) -> str:
    """The pattern with its last ``+`` at the least length: texts without such a run have no match that counts."""
    return f"{pattern[:-1]}{{{least}}}" if pattern.endswith("+") else pattern
