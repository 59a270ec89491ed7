"""Profiles, value counts, column roles, tiers, name expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import ALL_TABLES, check, columns_of, read, sql_column_stats, sql_text
from veilwork.functions import names
from veilwork.operators import profile as P
from veilwork.operators.policies import ColumnPolicy, policies_frame
from veilwork.sources.tables import row_counts, union_all

PROFILED = ("customer", "orders", "lineitem")


@check(
    "table_row_counts",
    " UNION ALL ".join(f"SELECT '{t.upper()}' AS table_name, count(*) AS row_count FROM {t}" for t in ALL_TABLES),
)
def table_row_counts(spark, root):
    return row_counts({t.upper(): read(spark, root, t) for t in ALL_TABLES})


@check(
    "profile_columns",
    f"""SELECT table_name, column_name, data_type, row_count, null_count, distinct_count,
        min_value, max_value, round(mean_value, 3) AS mean_value, round(std_value, 3) AS std_value,
        round(distinct_count / (row_count - null_count), 6) AS unique_ratio, boolean_like
        FROM ({sql_column_stats(PROFILED)})""",
)
def profile_columns(spark, root):
    return P.profile_tables({t.upper(): read(spark, root, t) for t in PROFILED}, distinct="exact").select(
        "table_name", "column_name", "data_type", "row_count", "null_count", "distinct_count", "min_value",
        "max_value", F.round("mean_value", 3).alias("mean_value"), F.round("std_value", 3).alias("std_value"),
        F.round("unique_ratio", 6).alias("unique_ratio"), "boolean_like",
    )


@check(
    "profile_columns_sketch",
    f"""SELECT table_name, column_name, row_count, null_count, CASE WHEN distinct_count < 16384 THEN distinct_count END AS distinct_count,
        min_value, max_value, boolean_like, true AS within FROM ({sql_column_stats(PROFILED)})""",
)
def profile_columns_sketch(spark, root):
    """The default profile: exact up to 2**14 values; larger counts lie within 3% of the exact ones."""
    tables = {t.upper(): read(spark, root, t) for t in PROFILED}
    exact = P.profile_tables(tables, distinct="exact").select("table_name", "column_name", F.col("distinct_count").alias("_exact"))
    found = P.profile_tables(tables).join(exact, ["table_name", "column_name"])
    return found.select(
        "table_name", "column_name", "row_count", "null_count", F.when(F.col("_exact") < 16384, F.col("distinct_count")).alias("distinct_count"),
        "min_value", "max_value", "boolean_like", (F.abs(F.col("distinct_count") - F.col("_exact")) <= 0.03 * F.col("_exact")).alias("within"),
    )


def _sql_long(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table.upper()}' AS table_name, '{c}' AS column_name, {sql_text(c, k)} AS value FROM {table}"
        for c, k in columns_of(table)
    )


@check(
    "top_values",
    f"""SELECT table_name, column_name, value, frequency FROM (
          SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY frequency DESC, value) AS rn
          FROM (SELECT table_name, column_name, value, count(*) AS frequency
                FROM ({_sql_long("orders")} UNION ALL {_sql_long("lineitem")})
                WHERE value IS NOT NULL GROUP BY ALL))
        WHERE rn <= 10""",
)
def top_values(spark, root):
    return union_all(
        P.top_values(read(spark, root, t)).select(
            F.lit(t.upper()).alias("table_name"), "column_name", "value", "frequency"
        )
        for t in ("orders", "lineitem")
    )


@check(
    "value_shares",
    """SELECT column_name, value, frequency, round(frequency / sum(frequency) OVER (PARTITION BY column_name), 6) AS share
       FROM (SELECT 'event_type' AS column_name, event_type AS value, count(*) AS frequency FROM events GROUP BY ALL
             UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY ALL)""",
)
def value_shares(spark, root):
    return P.value_counts(read(spark, root, "events"), ["event_type", "user_id"]).withColumn("share", F.round("share", 6))


@check(
    "value_patterns",
    f"""WITH counted AS (SELECT column_name, value, count(*) AS f FROM ({_sql_long("part")} UNION ALL {_sql_long("events")})
                        WHERE value IS NOT NULL GROUP BY ALL),
          top AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY f DESC, value) AS rn FROM counted)
        SELECT column_name,
               CASE WHEN column_name LIKE '%\\_CD%' ESCAPE '\\' OR column_name LIKE '%STAT%' THEN 'finite_categorical'
                    WHEN bool_and(regexp_matches(regexp_replace(value, '[.\\-]', '', 'g'), '^[0-9]+$')) FILTER (rn <= 5)
                    THEN 'numeric_measure' ELSE 'high_cardinality_string' END AS pattern_type
        FROM top WHERE rn <= 10 GROUP BY column_name""",
)
def value_patterns(spark, root):
    found = []
    for t in ("part", "events"):
        df = read(spark, root, t)
        names_only = P.fields_of(df)
        stats = spark.createDataFrame([(f.name,) for f in names_only], "column_name string")
        found.append(P.value_pattern(stats, P.top_values(df)))
    return union_all(found)


# ---- column roles and tiers ----------------------------------------------------

ROLE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
KEY_COLUMNS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": [],
}
ROLE_POLICIES = [
    ColumnPolicy("CUSTOMER", "c_name", masking_strategy="substitute_realistic", dedup_mode="entity"),
    ColumnPolicy("SUPPLIER", "s_name", masking_strategy="substitute_realistic", dedup_mode="entity"),
    ColumnPolicy("PART", "p_retailprice", masking_strategy="generalise", dedup_mode="event"),
    ColumnPolicy("EVENTS", "props", dedup_mode="reference"),
]


def _sql_policies() -> str:
    rows = ", ".join(
        f"('{p.table_name}', '{p.column_name}', '{p.masking_strategy}', '{p.dedup_mode}')" for p in ROLE_POLICIES
    )
    return f"(VALUES {rows}) AS p(table_name, column_name, masking, dedup)"


_KEYS_SQL = ", ".join(f"('{t.upper()}', '{c}')" for t, cs in KEY_COLUMNS.items() for c in cs)


def _any(tokens) -> str:
    return "(" + " OR ".join(f"contains(u, '{t}')" for t in tokens) + ")"


SQL_ROLES = f"""
WITH stats AS ({sql_column_stats(ROLE_TABLES)}),
facts AS (
  SELECT s.*, upper(s.column_name) AS u, s.data_type IN ('int', 'bigint', 'double') AS is_num,
         distinct_count / greatest(row_count - null_count, 1) AS ratio,
         coalesce(p.masking, 'passthrough') <> 'passthrough' AS masked, p.dedup AS dedup,
         (s.table_name, s.column_name) IN (VALUES {_KEYS_SQL}) AS is_key
  FROM stats s LEFT JOIN {_sql_policies()} USING (table_name, column_name)),
flags AS (
  SELECT *, (data_type LIKE 'timestamp%' OR {_any(names.DATE_TOKENS)}) AS is_date,
         (u LIKE '%\\_ID' ESCAPE '\\' OR is_key) AS is_id,
         (ratio >= 0.95 AND {_any(names.UNIQUE_ID_TOKENS)}) AS unique_id,
         (is_num OR {_any(names.METRIC_TOKENS)}) AS metric
  FROM facts),
roles AS (
  SELECT *, CASE WHEN boolean_like OR is_date OR coalesce(dedup = 'reference', false) OR {_any(names.STATUS_TOKENS)}
      OR is_id OR unique_id OR distinct_count <= greatest(12, floor(row_count * 0.02))
      OR (masked AND NOT metric AND (coalesce(dedup = 'entity', false) OR is_date OR is_id OR unique_id
          OR (NOT is_num AND NOT is_date AND ratio >= 0.35 AND distinct_count >= 50)))
    THEN 'structural' ELSE 'modeled' END AS role
  FROM flags),
profiles AS (
  SELECT table_name, max(row_count) AS row_count,
    coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (role = 'structural'), '') AS structural_columns,
    coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (role = 'modeled'), '') AS modeled_columns,
    coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (masked), '') AS sensitive_columns,
    count(*) FILTER (role = 'structural') AS n_structural, count(*) FILTER (role = 'modeled') AS n_modeled
  FROM roles GROUP BY table_name)
"""


def profile_frame(spark, root, tables=ROLE_TABLES):
    stats = P.profile_tables({t.upper(): read(spark, root, t) for t in tables})
    keys = [(t.upper(), c) for t, columns in KEY_COLUMNS.items() for c in columns]
    return P.generation_profile(P.column_roles(stats, policies_frame(spark, ROLE_POLICIES), keys))


@check(
    "generation_profile",
    SQL_ROLES + "SELECT table_name, row_count, structural_columns, modeled_columns, sensitive_columns FROM profiles",
)
def generation_profile(spark, root):
    lists = ("structural_columns", "modeled_columns", "sensitive_columns")
    return profile_frame(spark, root).select(
        "table_name", "row_count", *[F.array_join(c, ",").alias(c) for c in lists]
    )


@check(
    "tier_route",
    SQL_ROLES
    + """SELECT table_name, row_count, CASE
          WHEN n_modeled = 0 OR (n_modeled = 1 AND n_structural >= 8)
            OR (row_count >= 6000 AND n_modeled <= 3 AND n_structural >= 10) THEN 'rule_based'
          WHEN row_count >= 5000 THEN 'ctgan' WHEN row_count >= 200 THEN 'tvae' ELSE 'rule_based' END AS tier
        FROM profiles""",
)
def tier_route(spark, root):
    return P.route_tier(profile_frame(spark, root)).select("table_name", "row_count", "tier")


@check(
    "profile_similarity",
    SQL_ROLES
    + """, sides AS (SELECT table_name, row_count,
            list_transform(string_split(structural_columns, ','), lambda x: substr(x, 3)) AS s,
            list_transform(string_split(modeled_columns, ','), lambda x: substr(x, 3)) AS m FROM profiles)
        SELECT a.table_name AS left_table, b.table_name AS right_table,
          round(0.65 * len(list_intersect(a.m, b.m)) / len(list_distinct(a.m || b.m))
              + 0.25 * len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s))
              + 0.10 * least(a.row_count, b.row_count) / greatest(a.row_count, b.row_count), 4) AS score
        FROM sides a JOIN sides b ON (a.table_name, b.table_name) IN (('CUSTOMER', 'SUPPLIER'), ('ORDERS', 'LINEITEM'))""",
)
def profile_similarity(spark, root):
    # column names lose their table prefix, as the tables name alike columns alike
    bare = [
        F.transform(c, lambda x: F.substring(x, 3, 100)).alias(c) for c in ("structural_columns", "modeled_columns")
    ]
    sides = profile_frame(spark, root, ("customer", "supplier", "orders", "lineitem")).select(
        "table_name", F.struct("row_count", *bare).alias("p")
    )
    wanted = spark.createDataFrame([("CUSTOMER", "SUPPLIER"), ("ORDERS", "LINEITEM")], "left_table string, right_table string")
    pairs = (
        wanted.join(sides.select(F.col("table_name").alias("left_table"), F.col("p").alias("a")), "left_table")
        .join(sides.select(F.col("table_name").alias("right_table"), F.col("p").alias("b")), "right_table")
    )
    return P.profile_similarity(pairs).select("left_table", "right_table", "score")


@check(
    "key_multiplicity",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS parents, round(avg(n), 6) AS mean_count,
            round(stddev_samp(n), 6) AS std_count, min(n) AS min_count, max(n) AS max_count
            FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey")
    ),
)
def key_multiplicity(spark, root):
    found = P.multiplicity(read(spark, root, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])
    return found.withColumn("mean_count", F.round("mean_count", 6)).withColumn("std_count", F.round("std_count", 6))


_DICTIONARY_SQL = ", ".join(f"('{k}', '{v}')" for k, v in names.ABBREVIATIONS.items())


@check(
    "abbrev_expand",
    f"""WITH named AS (SELECT c_custkey, 'CUST_' || upper(c_mktsegment) || '_ACCT_' || c_custkey || '_NO' AS name FROM customer),
          tokens AS (SELECT c_custkey, name, unnest(string_split(name, '_')) AS token,
                            generate_subscripts(string_split(name, '_'), 1) AS pos FROM named)
        SELECT c_custkey, name, string_agg(coalesce(d.expansion, token), ' ' ORDER BY pos) AS expanded,
               bool_and(d.expansion IS NOT NULL) AS fully_resolved
        FROM tokens LEFT JOIN (VALUES {_DICTIONARY_SQL}) AS d(key, expansion) ON d.key = token GROUP BY ALL""",
)
def abbrev_expand(spark, root):
    named = read(spark, root, "customer").select(
        "c_custkey",
        F.concat_ws("_", F.lit("CUST"), F.upper("c_mktsegment"), F.lit("ACCT"), "c_custkey", F.lit("NO")).alias("name"),
    )
    return names.expand_abbreviations(named, "name", names.abbreviation_table(spark))
