"""Distribution tests, leakage, re-identification, lineage and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, read
from checks.generation import shipments
from checks.privacy import KEY, sql_mask_digest, _of
from checks.relations import EDGES, tables_of
from veilwork.operators import copula
from veilwork.operators import fidelity as FI
from veilwork.operators import masking as M
from veilwork.operators import synthesis as S
from veilwork.operators import validation as V
from veilwork.operators.policies import ColumnPolicy, Strategy, failure_types
from veilwork.sources.tables import union_all


def numeric_pair(spark, root):
    """Two samples under the same names: customers and suppliers, order totals and line prices."""
    left = [("customer", "c_acctbal", "balance"), ("orders", "o_totalprice", "price")]
    right = [("supplier", "s_acctbal", "balance"), ("lineitem", "l_extendedprice", "price")]

    def long(side):
        return union_all(FI.numeric_long(read(spark, root, t).select(F.col(c).alias(n)), [n]) for t, c, n in side)

    return FI._sides(long(left), long(right))


SQL_PAIR = """WITH sides AS (SELECT 'balance' AS c, c_acctbal AS v, 1 AS r, 0 AS s FROM customer UNION ALL SELECT 'balance', s_acctbal, 0, 1 FROM supplier
     UNION ALL SELECT 'price', o_totalprice, 1, 0 FROM orders UNION ALL SELECT 'price', l_extendedprice, 0, 1 FROM lineitem),
   counts AS (SELECT c, v, sum(r) AS r, sum(s) AS s FROM sides GROUP BY ALL)"""


@check(
    "ks_two_sample",
    SQL_PAIR
    + """, cdf AS (SELECT c, sum(r) OVER w / sum(r) OVER (PARTITION BY c) AS f1, sum(s) OVER w / sum(s) OVER (PARTITION BY c) AS f2,
             sum(r) OVER (PARTITION BY c) AS n, sum(s) OVER (PARTITION BY c) AS m FROM counts WINDOW w AS (PARTITION BY c ORDER BY v)),
         d AS (SELECT c, max(n)::BIGINT AS n, max(m)::BIGINT AS m, max(abs(f1 - f2)) AS ks FROM cdf GROUP BY c)
       SELECT c AS column_name, n AS total_real, m AS total_synth, round(ks, 6) AS ks_stat,
         round(greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END::DOUBLE * exp(-2.0::DOUBLE * k * k * (n * m / (n + m)) * ks * ks))))), 6) AS p_value FROM d""",
)
def ks_two_sample(spark, root):
    return FI.ks_two_sample(numeric_pair(spark, root)).select(
        "column_name", "total_real", "total_synth", F.round("ks_stat", 6).alias("ks_stat"), F.round("p_value", 6).alias("p_value")
    )


JSD = "round(sqrt(greatest(0, sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2)), 6)"


@check(
    "jsd_numeric",
    SQL_PAIR
    + f""", lim AS (SELECT c, min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM counts GROUP BY c),
        binned AS (SELECT c, least(49, floor((v - lo) / w)) AS b, sum(r) AS r, sum(s) AS s FROM counts JOIN lim USING (c) GROUP BY ALL),
        pq AS (SELECT c, (r / sum(r) OVER (PARTITION BY c) + 1e-10) / (1 + 50e-10) AS p, (s / sum(s) OVER (PARTITION BY c) + 1e-10) / (1 + 50e-10) AS q FROM binned)
        SELECT c AS column_name, {JSD} AS jsd FROM pq GROUP BY c""",
)
def jsd_numeric(spark, root):
    found = FI.jensen_shannon(FI.histogram(numeric_pair(spark, root)), FI.BINS)
    return found.withColumn("jsd", F.round("jsd", 6))


def category_pair(spark, root):
    left = read(spark, root, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").cast("string").alias("year"))
    right = read(spark, root, "lineitem").select(F.col("l_linestatus").alias("status"), F.year("l_shipdate").cast("string").alias("year"))
    return FI.category_counts(left, right, ["status", "year"])


SQL_CATEGORIES = """WITH sides AS (SELECT 'status' AS c, o_orderstatus AS v, 1 AS r, 0 AS s FROM orders UNION ALL SELECT 'status', l_linestatus, 0, 1 FROM lineitem
     UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), 1, 0 FROM orders UNION ALL SELECT 'year', CAST(year(l_shipdate) AS VARCHAR), 0, 1 FROM lineitem),
   counts AS (SELECT c, v, sum(r) AS r, sum(s) AS s, sum(sum(r)) OVER (PARTITION BY c) AS n, sum(sum(s)) OVER (PARTITION BY c) AS m, count(*) OVER (PARTITION BY c) AS k FROM sides GROUP BY c, v)"""


@check(
    "jsd_categorical",
    SQL_CATEGORIES
    + f", pq AS (SELECT c, (r / n + 1e-10) / (1 + k * 1e-10) AS p, (s / m + 1e-10) / (1 + k * 1e-10) AS q FROM counts) SELECT c AS column_name, {JSD} AS jsd FROM pq GROUP BY c",
)
def jsd_categorical(spark, root):
    return FI.jensen_shannon(category_pair(spark, root)).withColumn("jsd", F.round("jsd", 6))


@check(
    "chi_square",
    SQL_CATEGORIES
    + """ SELECT c AS column_name, round(sum((s - r * m / n) * (s - r * m / n) / (r * m / n)) FILTER (r > 0), 3) AS chi2,
        count(*) FILTER (r > 0) - 1 AS dof, round(coalesce(sum(s) FILTER (r = 0), 0) / max(m), 6) AS unseen_share FROM counts GROUP BY c""",
)
def chi_square(spark, root):
    found = FI.chi_square(category_pair(spark, root), with_p=False)
    return found.withColumn("chi2", F.round("chi2", 3)).withColumn("unseen_share", F.round("unseen_share", 6))


@check(
    "sensitive_overlap",
    f"""WITH masked AS (SELECT {_of(M.FIRST_NAMES, sql_mask_digest('c_name', 'c_name'), 0)} || ' ' || {_of(M.LAST_NAMES, sql_mask_digest('c_name', 'c_name'), 1)} AS c_name, c_mktsegment FROM customer)
        SELECT 'c_name' AS column_name, (SELECT count(DISTINCT c_name) FROM customer) AS real_values, count(DISTINCT c_name) AS synth_values,
          (SELECT count(DISTINCT c_name) FROM masked WHERE c_name IN (SELECT c_name FROM customer)) AS shared_values FROM masked
        UNION ALL SELECT 'c_mktsegment', (SELECT count(DISTINCT c_mktsegment) FROM customer), count(DISTINCT c_mktsegment),
          (SELECT count(DISTINCT c_mktsegment) FROM masked WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer)) FROM masked""",
)
def sensitive_overlap(spark, root):
    real = read(spark, root, "customer")
    masked = M.mask(real, [ColumnPolicy("CUSTOMER", "c_name", masking_strategy="substitute_realistic")], KEY)
    return V.value_overlap(real, masked, ["c_name", "c_mktsegment"]).drop("overlap")


REID_COLUMNS = ["p_brand", "p_name", "p_type", "p_size", "p_retailprice"]


def altered_parts(spark, root):
    """Parts whose price is masked away and whose size moved for one type."""
    return read(spark, root, "part").withColumn("p_retailprice", F.col("p_retailprice") + 0.05).withColumn(
        "p_size", F.when(F.col("p_type") == "PROMO", F.col("p_size") + 100).otherwise(F.col("p_size"))
    )


@check(
    "reid_risk",
    """WITH synth AS (SELECT p_brand, p_name, p_type, CASE WHEN p_type = 'PROMO' THEN p_size + 100 ELSE p_size END AS p_size, p_retailprice + 0.05 AS p_retailprice FROM part),
        records AS (SELECT *, count(*) AS copies, row_number() OVER () AS id FROM synth GROUP BY ALL),
        nearest AS (SELECT s.id, any_value(s.copies) AS copies, max((s.p_brand = r.p_brand)::INT + (s.p_name = r.p_name)::INT + (s.p_type = r.p_type)::INT + (s.p_size = r.p_size)::INT
            + (CAST(s.p_retailprice AS VARCHAR) = CAST(r.p_retailprice AS VARCHAR))::INT) AS matches FROM records s, part r GROUP BY s.id)
        SELECT matches, count(*) AS records, sum(copies)::BIGINT AS copies FROM nearest WHERE matches / 5 > 0.7 GROUP BY matches""",
)
def reid_risk(spark, root):
    found = V.reid_risk(read(spark, root, "part"), altered_parts(spark, root), REID_COLUMNS, 0.7)
    return found.groupBy("matches").agg(F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies"))


WIDE = ["p_brand", "p_name", "p_type", "p_size", "p_retailprice", "words", "fifth", "hundreds"]
SQL_WIDE = "SELECT p_partkey, p_brand, p_name, p_type, p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice, length(p_name) AS words, p_size % 5 AS fifth, CAST(floor(p_retailprice / 100) AS BIGINT) AS hundreds FROM part"


@check(
    "reid_risk_wide",
    f"""WITH real AS ({SQL_WIDE}), synth AS (SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE p_brand END AS p_brand,
            CASE WHEN p_partkey % 4 = 0 THEN p_size + 1000 ELSE p_size END AS p_size, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE fifth END AS fifth) FROM real),
        records AS (SELECT {', '.join(WIDE)}, count(*) AS copies, row_number() OVER () AS id FROM synth GROUP BY ALL),
        nearest AS (SELECT s.id, any_value(s.copies) AS copies, max({' + '.join(f'(s.{c} = r.{c})::INT' for c in WIDE)}) AS matches FROM records s, real r GROUP BY s.id)
        SELECT matches, count(*) AS records, sum(copies)::BIGINT AS copies FROM nearest WHERE matches / 8 > 0.7 GROUP BY matches""",
)
def reid_risk_wide(spark, root):
    """Eight columns, two of which may differ; some columns have few values."""
    part = read(spark, root, "part").withColumns(
        {"words": F.length("p_name"), "fifth": F.col("p_size") % 5, "hundreds": F.floor(F.col("p_retailprice") / 100)}
    )
    key = F.col("p_partkey")
    synth = part.withColumns(
        {
            "p_brand": F.when(key % 3 == 0, "other").otherwise(F.col("p_brand")),
            "p_size": F.when(key % 4 == 0, F.col("p_size") + 1000).otherwise(F.col("p_size")),
            "fifth": F.when(key % 7 == 0, -1).otherwise(F.col("fifth")),
        }
    )
    found = V.reid_risk(part, synth, WIDE, 0.7, block=32)
    return found.groupBy("matches").agg(F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies"))


@check(
    "reid_sample",
    """WITH real AS (SELECT * FROM part ORDER BY p_partkey LIMIT 200),
        synth AS (SELECT p_partkey, p_brand, p_name, p_type, CASE WHEN p_type = 'PROMO' THEN p_size + 100 ELSE p_size END AS p_size, p_retailprice + 0.05 AS p_retailprice FROM real)
        SELECT s.p_partkey AS row, max((s.p_brand = r.p_brand)::INT + (s.p_name = r.p_name)::INT + (s.p_type = r.p_type)::INT + (s.p_size = r.p_size)::INT
            + (CAST(s.p_retailprice AS VARCHAR) = CAST(r.p_retailprice AS VARCHAR))::INT) / 5 AS similarity FROM synth s, real r GROUP BY 1""",
)
def reid_sample(spark, root):
    """The first 200 rows of each side, the size of the interactive check."""
    return V.reid_sample(read(spark, root, "part"), altered_parts(spark, root), REID_COLUMNS, "p_partkey")


@check(
    "temporal_check",
    "SELECT count(*) FILTER (o_orderdate > l_shipdate) AS violations, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def temporal_check(spark, root):
    df = shipments(spark, root)
    return df.agg(V.temporal_violations(df, "o_orderdate", "l_shipdate").alias("violations"), F.count(F.lit(1)).alias("n"))


RULE_TEXTS = ["c_acctbal must be positive", "C_NAME must not be null", "c_mktsegment must be one of the known segments"]
SHOWN = ["check_name", "table_name", "column_name", "passed", "metric_value"]


@check(
    "business_rules",
    """SELECT 'Business Rule: c_acctbal must be positive' AS check_name, 'CUSTOMER' AS table_name, 'c_acctbal' AS column_name,
         count(*) FILTER (c_acctbal < 0) = 0 AS passed, (count(*) FILTER (c_acctbal < 0))::DOUBLE AS metric_value FROM customer
       UNION ALL SELECT 'Business Rule: C_NAME must not be null', 'CUSTOMER', 'c_name', count(*) = count(c_name), (count(*) - count(c_name))::DOUBLE FROM customer
       UNION ALL SELECT 'Business Rule: c_mktsegment must be one of the known segments', 'CUSTOMER', NULL, true, NULL""",
)
def business_rules(spark, root):
    return V.validate_rules(read(spark, root, "customer"), "CUSTOMER", RULE_TEXTS).select(*SHOWN)


def lineage(spark, root):
    """Every declared edge, with only finished orders delivered."""
    tables = tables_of(spark, root)
    tables["ORDERS"] = tables["ORDERS"].where("o_orderstatus = 'F'")
    return union_all(
        V.validate_lineage(tables[t], t, EDGES, tables)
        for t in sorted({e.source_table for e in EDGES})
    )


def _sql_lineage() -> str:
    def orphans(e):
        child = f"(SELECT * FROM {e.source_table} WHERE o_orderstatus = 'F')" if e.source_table == "ORDERS" else e.source_table
        parent = f"(SELECT * FROM {e.target_table} WHERE o_orderstatus = 'F')" if e.target_table == "ORDERS" else e.target_table
        return f"(SELECT count(DISTINCT {e.source_column}) FROM {child} WHERE {e.source_column} NOT IN (SELECT {e.target_column} FROM {parent}))"

    return " UNION ALL ".join(
        f"SELECT 'FK Integrity: {e.source_column} → {e.target_table}.{e.target_column}' AS check_name, '{e.source_table}' AS table_name,"
        f" '{e.source_column}' AS column_name, {orphans(e)} = 0 AS passed, {orphans(e)}::DOUBLE AS metric_value"
        for e in EDGES
    )


@check("fk_integrity", _sql_lineage())
def fk_integrity(spark, root):
    return lineage(spark, root).select(*SHOWN)


@check(
    "validation_summary",
    f"""WITH results AS ({_sql_lineage()})
        SELECT table_name, count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks,
          round(100.0 * count(*) FILTER (passed) / count(*), 1) AS pass_rate,
          coalesce(string_agg(check_name, ';' ORDER BY check_name) FILTER (NOT passed), '') AS failing_checks FROM results GROUP BY 1""",
)
def validation_summary(spark, root):
    found = V.validation_summary(lineage(spark, root))
    return found.withColumn("failing_checks", F.array_join("failing_checks", ";"))


@check(
    "failure_types",
    f"WITH results AS ({_sql_lineage()}) SELECT DISTINCT table_name, 'lineage' AS failure_types FROM results WHERE NOT passed",
)
def failed_kinds(spark, root):
    return failure_types(lineage(spark, root)).withColumn("failure_types", F.array_join("failure_types", ","))


@check("validation_gate")
def validation_gate(spark, root):
    """All checks of a generated order table against its source."""
    orders = read(spark, root, "orders")
    structural = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    made = S.synthesize(orders, structural, [], ["o_orderkey"])
    policies = [ColumnPolicy("ORDERS", c) for c in orders.columns]
    strategy = Strategy(rules=["o_totalprice must be non-negative"])
    return V.validate_table(orders, made, "ORDERS", policies, EDGES, {"CUSTOMER": read(spark, root, "customer")}, strategy)


COPULA_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check("copula_synthesize")
def copula_synthesize(spark, root):
    return copula.copula_synthesize(read(spark, root, "lineitem"), COPULA_COLUMNS)


@check("quality_score")
def quality_score(spark, root):
    real = read(spark, root, "lineitem")
    made = copula.copula_synthesize(real, COPULA_COLUMNS)
    counts = FI.numeric_counts(real, made, COPULA_COLUMNS)
    return FI.quality_score(counts, None, real, made, COPULA_COLUMNS)
