"""Synthetic rows, repairs, edge cases, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, read, sql_normal, sql_order_key, sql_pick, sql_uniform
from checks.relations import EDGES
from veilwork.operators import dedup as DD
from veilwork.operators import edge_cases as E
from veilwork.operators import repair as R
from veilwork.operators import synthesis as S
from veilwork.operators.policies import ColumnPolicy, Strategy

SEED = 42


def sql_index(table: str, key: str, columns: str, where: str = "true", seed=SEED) -> str:
    """Rows at 0-based positions of the keyed random order."""
    return (
        f"SELECT row_number() OVER (ORDER BY {sql_order_key(f"'{seed}'", key)}, {key}) - 1 AS pos, {columns}"
        f" FROM {table} WHERE {where}"
    )


def sql_weighted(table: str, column: str, draw: str) -> str:
    """Value whose running frequency total (in value order) holds the draw."""
    return (
        f"(SELECT min_by(value, upto) FROM (SELECT value, sum(n) OVER (ORDER BY value) AS upto FROM"
        f" (SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)) WHERE {draw} < upto)"
    )


RIDS = "(SELECT range AS rid FROM range((SELECT count(*) FROM orders)))"
S_ = f"'{SEED}'"


@check(
    "synth_structural",
    f"""WITH indexed AS ({sql_index("orders", "o_orderkey", "o_orderkey, o_custkey, o_orderdate")}),
        status AS (SELECT o_orderstatus AS v, sum(count(*)) OVER (ORDER BY o_orderstatus) AS upto, count(*) AS n FROM orders GROUP BY 1),
        priority AS (SELECT o_orderpriority AS v, sum(count(*)) OVER (ORDER BY o_orderpriority) AS upto, count(*) AS n FROM orders GROUP BY 1),
        drawn AS (SELECT rid, {sql_pick("(SELECT count(*) FROM orders)", S_, "'row'", "rid")} AS pos,
            {sql_pick("(SELECT count(*) FROM orders)", S_, "'o_orderstatus'", "rid")} AS ds,
            {sql_pick("(SELECT count(*) FROM orders)", S_, "'o_orderpriority'", "rid")} AS dp FROM {RIDS})
        SELECT rid AS _rid, o_orderkey, o_custkey, s.v AS o_orderstatus, o_orderdate, p.v AS o_orderpriority
        FROM drawn JOIN indexed USING (pos)
        JOIN status s ON ds < s.upto AND ds >= s.upto - s.n JOIN priority p ON dp < p.upto AND dp >= p.upto - p.n""",
)
def synth_structural(spark, root):
    orders = read(spark, root, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    return S.synthesize(orders, columns, [], ["o_orderkey"], seed=SEED, columns=columns)


def _sql_gauss(table: str, column: str, whole: bool) -> str:
    spread = f"greatest((SELECT stddev_samp({column}) FROM {table}), {1.0 if whole else 0.01})"
    value = (
        f"least(greatest((SELECT avg({column}) FROM {table}) + {spread} * {sql_normal(S_, f"'{column}'", 'rid')},"
        f" (SELECT min({column}) FROM {table})::DOUBLE), (SELECT max({column}) FROM {table})::DOUBLE)"
    )
    return f"trunc({value})::INT" if whole else f"round({value}, 2)"


@check(
    "synth_rule_based",
    f"""WITH rids AS (SELECT range AS rid FROM range((SELECT count(*) FROM part))),
        named AS ({sql_index("part", "p_partkey", "p_name")}),
        kinds AS (SELECT p_type AS v, sum(count(*)) OVER (ORDER BY p_type) AS upto, count(*) AS n FROM part GROUP BY 1),
        drawn AS (SELECT rid, {sql_pick("(SELECT count(*) FROM part)", S_, "'p_name'", "rid")} AS pos,
                  {sql_pick("(SELECT count(*) FROM part)", S_, "'p_type'", "rid")} AS dt,
                  ['A', 'B', 'C'][{sql_pick(3, S_, "'p_brand'", "rid")} + 1] AS p_brand,
                  {_sql_gauss("part", "p_size", True)} AS p_size, {_sql_gauss("part", "p_retailprice", False)} AS p_retailprice FROM rids)
        SELECT rid AS _rid, p_name, p_brand, v AS p_type, p_size, p_retailprice
        FROM drawn JOIN named USING (pos) JOIN kinds ON dt < upto AND dt >= upto - n""",
)
def synth_rule_based(spark, root):
    policies = [ColumnPolicy("PART", "p_brand", allowed_values="['A', 'B', 'C']")]
    return S.synthesize(
        read(spark, root, "part"), [], policies, ["p_partkey"], seed=SEED, columns=["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    )


@check(
    "synth_identifiers",
    f"""WITH base AS (SELECT *, CASE WHEN c_acctbal >= 0 THEN 'CU-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS code FROM customer),
        present AS ({sql_index("base", "c_custkey", "code", "code IS NOT NULL")}),
        notes AS ({sql_index("customer", "c_custkey", "c_name")}),
        drawn AS (SELECT range AS rid, range % (SELECT count(*) FROM present) AS pos,
            {sql_pick("(SELECT count(*) FROM customer)", S_, "'NOTE'", "range")} AS note_pos,
            {sql_uniform("'null'", S_, "'CUST_CODE_ID'", "range")} >= (SELECT count(*) FILTER (code IS NULL) / count(*) FROM base) AS kept
          FROM range((SELECT count(*) FROM customer)))
        SELECT rid AS _rid, rid + 1 AS CUST_ID,
               CASE WHEN kept THEN 'CU-' || lpad(CAST(rid + 1 AS VARCHAR), 6, '0') END AS CUST_CODE_ID, n.c_name AS NOTE
        FROM drawn JOIN present USING (pos) JOIN notes n ON n.pos = note_pos""",
)
def synth_identifiers(spark, root):
    """Numbered keys, renumbered text ids with NULLs, and independent resampling."""
    base = read(spark, root, "customer").select(
        F.col("c_custkey").alias("CUST_ID"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("CU-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))).alias("CUST_CODE_ID"),
        F.col("c_name").alias("NOTE"),
    )
    return S.synthesize(base, ["CUST_ID", "CUST_CODE_ID"], [], ["CUST_ID"], seed=SEED)


def _sql_many(column: str, expression: str) -> str:
    total = f"(SELECT count({expression}) FROM lineitem)"
    return f"""{column}_w AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto, n FROM (SELECT CAST({expression} AS VARCHAR) AS v, count(*) AS n FROM lineitem WHERE {expression} IS NOT NULL GROUP BY 1)),
        {column}_d AS (SELECT range AS rid, {sql_pick(total, S_, f"'{column}'", "range")} AS d,
          {sql_uniform("'null'", S_, f"'{column}'", "range")} >= (SELECT 1 - count({expression}) / count(*) FROM lineitem) AS kept FROM range((SELECT count(*) FROM lineitem))),
        {column}_v AS (SELECT rid, CASE WHEN kept THEN v END AS {column} FROM {column}_d ASOF JOIN (SELECT v, upto - n AS lower FROM {column}_w) w ON d >= w.lower)"""


@check(
    "synth_weighted_many",
    f"""WITH {_sql_many("PART_STATUS", "l_partkey")}, {_sql_many("SHIP_STATUS", "CASE WHEN l_linenumber > 1 THEN CAST(l_shipdate AS VARCHAR) END")}
        SELECT rid AS _rid, CAST(PART_STATUS AS BIGINT) AS PART_STATUS, SHIP_STATUS FROM PART_STATUS_v JOIN SHIP_STATUS_v USING (rid)""",
)
def synth_weighted_many(spark, root):
    """Categories by the thousand, one column with NULLs; drawn by their running totals."""
    lines = read(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("PART_STATUS"),
        F.when(F.col("l_linenumber") > 1, F.col("l_shipdate").cast("string")).alias("SHIP_STATUS"),
    )
    columns = ["PART_STATUS", "SHIP_STATUS"]
    return S.synthesize(lines, columns, [], ["l_orderkey", "l_linenumber"], seed=SEED, columns=columns)


def orders_with_rid(spark, root):
    return read(spark, root, "orders").withColumn(S.RID, F.col("o_orderkey"))


@check(
    "fk_stitch",
    f"""WITH parents AS ({sql_index("customer", "c_custkey", "c_custkey", "c_acctbal >= 0")}),
        drawn AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN {sql_pick("(SELECT count(*) FROM parents)", S_, "'o_custkey'", "o_orderkey")} END AS pos FROM orders)
        SELECT o_orderkey, c_custkey AS o_custkey FROM drawn LEFT JOIN parents USING (pos)""",
)
def fk_stitch(spark, root):
    child = orders_with_rid(spark, root).withColumn("o_custkey", F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_custkey END"))
    parents = {"CUSTOMER": read(spark, root, "customer").where("c_acctbal >= 0")}
    return R.stitch_foreign_keys("ORDERS", child, EDGES, parents, SEED).select("o_orderkey", "o_custkey")


@check(
    "repair_allowed",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus
        ELSE ['O', 'F'][{sql_pick(2, S_, "'allowed'", "'o_orderstatus'", "o_orderkey")} + 1] END AS o_orderstatus FROM orders""",
)
def repair_allowed(spark, root):
    policies = [ColumnPolicy("ORDERS", "o_orderstatus", allowed_values=["O", "F"])]
    return R.enforce_allowed(orders_with_rid(spark, root), policies, SEED).select("o_orderkey", "o_orderstatus")


def shipments(spark, root):
    return read(spark, root, "lineitem").join(read(spark, root, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@check(
    "repair_temporal",
    """SELECT l_orderkey, l_linenumber, l_partkey, least(o_orderdate, l_shipdate) AS o_orderdate, greatest(o_orderdate, l_shipdate) AS l_shipdate
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def repair_temporal(spark, root):
    fixed = R.enforce_date_order(shipments(spark, root), Strategy(temporal=[("o_orderdate", "l_shipdate")]))
    return fixed.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate")


@check(
    "repair_unique",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN count(*) FILTER (event_type <> 'view') OVER (ORDER BY event_id) END AS ACCT_ID,
          CASE WHEN event_type <> 'view' THEN 'CODE_KEY_' || lpad(CAST(count(*) FILTER (event_type <> 'view') OVER (ORDER BY event_id) AS VARCHAR), 6, '0') END AS CODE_KEY
       FROM events""",
)
def repair_unique(spark, root):
    events = read(spark, root, "events").select(
        "event_id",
        F.expr("CASE WHEN event_type <> 'view' THEN user_id END").alias("ACCT_ID"),
        F.expr("CASE WHEN event_type <> 'view' THEN event_type END").alias("CODE_KEY"),
    )
    policies = [ColumnPolicy("EVENTS", c, dedup_mode="entity") for c in ("ACCT_ID", "CODE_KEY")]
    return R.enforce_unique(events, policies, [], order="event_id")


def _sql_junction(size: int | str) -> str:
    return f"""WITH per_key AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey),
        facts AS (SELECT avg(n) AS mean, greatest(stddev_samp(n), 0.5) AS std, max(n) AS most FROM per_key),
        keys AS ({sql_index("part", "p_partkey", "p_partkey")}), size AS (SELECT count(*) AS m FROM part),
        stride AS (SELECT min(r) AS step FROM (SELECT unnest(range(CAST(floor(m * 0.618) AS BIGINT), CAST(floor(m * 0.618) AS BIGINT) + 1000)) AS r, m FROM size) WHERE gcd(r, m) = 1),
        counted AS (SELECT o_orderkey, least(greatest(1, trunc(mean + std * {sql_normal(S_, "'count'", "o_orderkey")})::BIGINT), most, m) AS n,
            {sql_pick("m", S_, "'start'", "o_orderkey")} AS start FROM orders, facts, size)
        SELECT o_orderkey AS l_orderkey, p_partkey AS l_partkey FROM
          (SELECT o_orderkey, (start + i * step) % m AS pos FROM (SELECT *, unnest(range(n)) AS i FROM counted), stride, size)
        JOIN keys USING (pos)"""


@check("junction_generate", _sql_junction("part"))
def junction_generate(spark, root):
    return S.junction(
        read(spark, root, "orders"), "o_orderkey", read(spark, root, "part"), "p_partkey",
        read(spark, root, "lineitem"), "l_orderkey", "l_partkey", SEED,
    )


EDGE_POLICIES = [
    ColumnPolicy("ORDERS", "o_totalprice", edge_case_flags=["zero_amount", "negative", "max_boundary", "min_value", "outlier"]),
    ColumnPolicy("ORDERS", "o_orderstatus", edge_case_flags=["null_value", "duplicate", "special_characters", "empty"]),
    ColumnPolicy("ORDERS", "o_orderdate", edge_case_flags=["future_date", "past_date"]),
]
SQL_EDGE = f"""WITH marked AS (SELECT *, row_number() OVER (ORDER BY {sql_order_key(S_, "o_orderkey")}, o_orderkey)
            <= greatest(1, floor((SELECT count(*) FROM orders) * 0.05)) AS hit, {sql_pick(11, S_, "'spec'", "o_orderkey")} AS spec FROM orders),
  changed AS (SELECT o_orderkey, hit AS _edge_case,
     CASE WHEN NOT hit THEN o_totalprice WHEN spec = 0 THEN 0 WHEN spec = 1 THEN CASE WHEN o_totalprice = 0 THEN -1 ELSE -abs(o_totalprice) END
          WHEN spec = 2 THEN (SELECT max(o_totalprice) * 1.5 FROM orders) WHEN spec = 3 THEN (SELECT min(o_totalprice) * 0.5 FROM orders)
          WHEN spec = 4 THEN (SELECT avg(o_totalprice) + 3 * stddev_samp(o_totalprice) FROM orders) ELSE o_totalprice END AS price,
     CASE WHEN NOT hit THEN o_orderstatus WHEN spec = 5 THEN NULL
          WHEN spec = 6 THEN (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
          WHEN spec = 7 THEN o_orderstatus || '!@#$%' WHEN spec = 8 THEN '' ELSE o_orderstatus END AS o_orderstatus,
     CASE WHEN hit AND spec = 9 THEN TIMESTAMP '2099-12-31' WHEN hit AND spec = 10 THEN TIMESTAMP '1900-01-01' ELSE o_orderdate END AS o_orderdate
   FROM marked)"""


def injected(spark, root):
    return E.inject_edge_cases(read(spark, root, "orders"), EDGE_POLICIES, 0.05, SEED, key="o_orderkey")


@check("edge_cases", SQL_EDGE + " SELECT o_orderkey, round(price, 2) AS o_totalprice, o_orderstatus, o_orderdate, _edge_case FROM changed")
def edge_cases(spark, root):
    return injected(spark, root).select(
        "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderstatus", "o_orderdate", "_edge_case"
    )


@check("edge_coverage", SQL_EDGE + " SELECT avg(_edge_case::INT) AS edge_case_coverage FROM changed")
def edge_coverage(spark, root):
    return E.edge_coverage(injected(spark, root))


DOC_HASH = "sha256(concat_ws('|', coalesce(lang, 'None'), coalesce(CAST(n_chars AS VARCHAR), 'None'), coalesce(source, 'None'), coalesce(text, 'None')))"


@check("dedup_entity", f"SELECT min(doc_id) AS doc_id, {DOC_HASH} AS record_hash FROM documents GROUP BY 2")
def dedup_entity(spark, root):
    return DD.dedup(read(spark, root, "documents"), "entity", "doc_id").select("doc_id", "record_hash")


EVENT_HASH = "sha256(concat_ws('|', event_type, props, CAST(value AS VARCHAR)))"


def dedup_events(spark, root, **options):
    return DD.dedup(
        read(spark, root, "events"), "event", "event_id", fk_columns=["user_id"], ignore=["event_id", "ts"], **options
    )


@check("dedup_event", f"SELECT min(event_id) AS event_id, {EVENT_HASH} AS record_hash FROM events GROUP BY 2")
def dedup_event(spark, root):
    """Events that differ only in user, time or id count as one."""
    return dedup_events(spark, root).select("event_id", "record_hash")


@check(
    "dedup_registry",
    f"""SELECT min(event_id) AS event_id FROM events WHERE {EVENT_HASH} NOT IN
        (SELECT {EVENT_HASH} FROM events WHERE event_type = 'click') GROUP BY {EVENT_HASH}""",
)
def dedup_registry(spark, root):
    """A run that has already delivered every click."""
    events = read(spark, root, "events")
    registry = events.where("event_type = 'click'").select(
        F.lit("EVENTS").alias("table_name"),
        DD.record_hash(events, ["event_type", "props", "value"]).alias("record_hash"),
        F.lit("run-1").alias("run_id"),
    )
    return dedup_events(spark, root, registry=registry, table="EVENTS", run_id="run-1").select("event_id")


@check(
    "registry_additions",
    f"""SELECT DISTINCT 'EVENTS' AS table_name, {EVENT_HASH} AS record_hash, 'run-2' AS run_id FROM events
        WHERE {EVENT_HASH} NOT IN (SELECT {EVENT_HASH} FROM events WHERE event_type = 'click')""",
)
def registry_additions(spark, root):
    events = read(spark, root, "events")
    registry = events.where("event_type = 'click'").select(
        F.lit("EVENTS").alias("table_name"),
        DD.record_hash(events, ["event_type", "props", "value"]).alias("record_hash"),
        F.lit("run-1").alias("run_id"),
    )
    return DD.new_registry_rows(dedup_events(spark, root), registry, "EVENTS", "run-2")


@check(
    "boundary_keys",
    """SELECT 'sales' AS domain, 'CUSTOMER' AS table_name, 'c_custkey' AS pk_column, CAST(c_custkey AS VARCHAR) AS key_value, 'run-1' AS run_id FROM customer
       UNION ALL SELECT DISTINCT 'sales', 'CUSTOMER', 'ROW_ID', CAST(c_custkey + 7 AS VARCHAR), 'run-1' FROM customer""",
)
def boundary_keys(spark, root):
    customer = read(spark, root, "customer").withColumn("ROW_ID", F.col("c_custkey") + 7).withColumn("AREA_ID", F.col("c_nationkey"))
    return S.boundary_keys(customer, "CUSTOMER", EDGES, "sales", "run-1")
