"""Defect scan, impact, overrides, planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, read, sql_order_key, sql_pick
from checks.relations import EDGES
from veilwork.operators import defects as D

RULES = [
    D.non_negative("CUSTOMER", "c_custkey", "c_acctbal", "negative_balance"),
    D.length_is("CUSTOMER", "c_custkey", "c_name", 18, "name_wrong_length"),
    D.no_injection("CUSTOMER", "c_custkey", "c_name"),
    D.max_value("ORDERS", "o_orderkey", "o_totalprice", "450000.0", "total_overflow"),
    D.not_future("ORDERS", "o_orderkey", "o_orderdate", "2001-01-01"),
    D.references("ORDERS", "o_orderkey", "o_custkey", "SOLVENT", "c_custkey", "fk_dangling_customer"),
    D.non_negative("SUPPLIER", "s_suppkey", "s_acctbal", "negative_balance"),
    D.not_greater("PART", "p_partkey", "p_size", "p_retailprice", "size_exceeds_price"),
]
IMPACT_EDGES = [e for e in EDGES if e.source_table in ("ORDERS", "LINEITEM")]
SHOW = {"ORDERS": ["o_orderkey"], "LINEITEM": ["l_orderkey", "l_partkey", "l_linenumber"]}


def source(spark, root):
    tables = {t.upper(): read(spark, root, t) for t in ("customer", "orders", "lineitem", "supplier", "part")}
    # parents that count as valid: customers who owe nothing
    tables["SOLVENT"] = tables["CUSTOMER"].where("c_acctbal >= 0")
    return tables


def _sql_hits() -> str:
    def hit(ord_, table, key, column, kind, severity, where):
        rule = f"{table}.{column}.{kind}".upper()
        return (
            f"SELECT {ord_} AS rule_ord, '{rule}' AS rule_key, '{table}' AS table_name, '{column}' AS column_name,"
            f" '{kind}' AS defect_type, {key} AS pk, CAST({column} AS VARCHAR) AS bad_value, '{severity}' AS severity"
            f" FROM {table} WHERE {where}"
        )

    return " UNION ALL ".join(
        [
            hit(0, "CUSTOMER", "c_custkey", "c_acctbal", "negative_balance", "high", "c_acctbal < 0"),
            hit(1, "CUSTOMER", "c_custkey", "c_name", "name_wrong_length", "critical", "length(c_name) <> 18"),
            hit(3, "ORDERS", "o_orderkey", "o_totalprice", "total_overflow", "critical", "o_totalprice > 450000"),
            hit(4, "ORDERS", "o_orderkey", "o_orderdate", "date_in_future", "high", "o_orderdate > '2001-01-01'"),
            hit(5, "ORDERS", "o_orderkey", "o_custkey", "fk_dangling_customer", "critical",
                "NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)"),
            hit(6, "SUPPLIER", "s_suppkey", "s_acctbal", "negative_balance", "high", "s_acctbal < 0"),
            hit(7, "PART", "p_partkey", "p_size", "size_exceeds_price", "high", "p_size > p_retailprice"),
        ]
    )


# not_future compares text, so the first midnight of the limit date counts as after it
SQL_DEFECTS = f"""WITH hits AS ({_sql_hits().replace("o_orderdate > '2001-01-01'", "CAST(o_orderdate AS VARCHAR) > '2001-01-01'")}),
 defects AS (SELECT *, CAST(pk AS VARCHAR) AS pk_value, row_number() OVER (PARTITION BY table_name ORDER BY rule_ord, pk) AS n FROM hits),
 named AS (SELECT *, table_name || '-' || upper(defect_type) || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS defect_id FROM defects)
"""
SHOWN = ["defect_id", "table_name", "pk_value", "column_name", "defect_type", "bad_value", "severity", "rule_key"]


@check("defect_scan", SQL_DEFECTS + f"SELECT {', '.join(SHOWN)} FROM named")
def defect_scan(spark, root):
    return D.defect_report(D.detect(source(spark, root), RULES), with_rows=False).select(*SHOWN)


@check(
    "defect_scan_first25",
    SQL_DEFECTS
    + """, firsts AS (SELECT *, row_number() OVER (PARTITION BY table_name, rule_ord ORDER BY pk) AS rn FROM hits),
        renumbered AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY rule_ord, pk) AS k FROM firsts WHERE rn <= 25)
        SELECT table_name || '-' || upper(defect_type) || '-' || lpad(CAST(k AS VARCHAR), 3, '0') AS defect_id, CAST(pk AS VARCHAR) AS pk_value FROM renumbered""",
)
def defect_scan_first25(spark, root):
    """At most 25 rows per rule, the size of the interactive report."""
    return D.defect_report(D.detect(source(spark, root), RULES, cap=25), with_rows=False).select("defect_id", "pk_value")


WIDE_RULES = [
    D.non_negative("CUSTOMER", "code", "c_acctbal", "negative_balance"),
    D.max_value("CUSTOMER", "code", "c_acctbal", "9000", "balance_high"),
    D.max_value("ORDERS", "number", "o_totalprice", "300000.0", "total_overflow"),
    D.length_is("ORDERS", "money", "o_orderpriority", 8, "priority_wrong_length"),
]


@check(
    "defect_scan_wide_keys",
    """WITH c AS (SELECT *, 'CUSTOMER-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code FROM customer),
        o AS (SELECT *, 1152921504606846976 + o_orderkey AS number, 12345678901234567890.0::DECIMAL(38,2) + CAST(o_totalprice AS DECIMAL(38,2)) AS money FROM orders),
        hits AS (SELECT 'CUSTOMER' AS t, 0 AS r, 'NEGATIVE_BALANCE' AS kind, code, NULL::BIGINT AS number, NULL::DECIMAL(38,2) AS money FROM c WHERE c_acctbal < 0
          UNION ALL SELECT 'CUSTOMER', 1, 'BALANCE_HIGH', code, NULL, NULL FROM c WHERE c_acctbal > 9000
          UNION ALL SELECT 'ORDERS', 2, 'TOTAL_OVERFLOW', NULL, number, NULL FROM o WHERE o_totalprice > 300000
          UNION ALL SELECT 'ORDERS', 3, 'PRIORITY_WRONG_LENGTH', NULL, NULL, money FROM o WHERE length(o_orderpriority) <> 8),
        named AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r, code, number, money) AS n,
          coalesce(code, CAST(number AS VARCHAR), CAST(money AS VARCHAR)) AS pk_value FROM hits)
        SELECT t || '-' || kind || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS defect_id, pk_value FROM named""",
)
def defect_scan_wide_keys(spark, root):
    """Keys of one text prefix, longs above 2**53 and long decimals are numbered in their own order."""
    customer = read(spark, root, "customer").withColumn("code", F.format_string("CUSTOMER-%09d", "c_custkey"))
    orders = read(spark, root, "orders").withColumn("number", F.col("o_orderkey") + (1 << 60))
    wide = F.lit("12345678901234567890.00").cast("decimal(38,2)") + F.col("o_totalprice").cast("decimal(38,2)")
    orders = orders.withColumn("money", wide.cast("decimal(38,2)"))
    return D.defect_report(D.detect({"CUSTOMER": customer, "ORDERS": orders}, WIDE_RULES), with_rows=False).select("defect_id", "pk_value")


SQL_IMPACT = (
    SQL_DEFECTS
    + """, children AS (
      SELECT 'CUSTOMER' AS t, 'ORDERS' AS child_table, 'o_custkey' AS via_column, o_custkey AS k,
             CAST(to_json({'o_orderkey': o_orderkey}) AS VARCHAR) AS row FROM orders
      UNION ALL SELECT 'ORDERS', 'LINEITEM', 'l_orderkey', l_orderkey, CAST(to_json({'l_orderkey': l_orderkey, 'l_partkey': l_partkey, 'l_linenumber': l_linenumber}) AS VARCHAR) FROM lineitem
      UNION ALL SELECT 'PART', 'LINEITEM', 'l_partkey', l_partkey, CAST(to_json({'l_orderkey': l_orderkey, 'l_partkey': l_partkey, 'l_linenumber': l_linenumber}) AS VARCHAR) FROM lineitem
      UNION ALL SELECT 'SUPPLIER', 'LINEITEM', 'l_suppkey', l_suppkey, CAST(to_json({'l_orderkey': l_orderkey, 'l_partkey': l_partkey, 'l_linenumber': l_linenumber}) AS VARCHAR) FROM lineitem),
    impact AS (SELECT defect_id, child_table, via_column, pk_value AS parent_value, count(*) AS row_count,
      list_sort(list(row))[1:5] AS rows, any_value(table_name) AS table_name FROM named JOIN children ON t = table_name AND k = pk GROUP BY ALL)
"""
)


@check(
    "defect_impact",
    SQL_IMPACT + "SELECT defect_id, child_table, via_column, parent_value, row_count, array_to_string(rows, ';') AS rows FROM impact",
)
def defect_impact(spark, root):
    tables = source(spark, root)
    found = D.impacts(D.detect(tables, RULES), IMPACT_EDGES, tables, show=SHOW)
    return found.select(
        "defect_id", "child_table", "via_column", "parent_value", "row_count", F.array_join("rows", ";").alias("rows")
    )


@check(
    "defect_summary",
    SQL_IMPACT
    + """SELECT table_name, defect_count, coalesce(linked_rows, 0)::BIGINT AS linked_rows FROM
        (SELECT t.table_name, count(n.pk) AS defect_count FROM (VALUES ('CUSTOMER'), ('ORDERS'), ('SUPPLIER'), ('PART')) AS t(table_name)
         LEFT JOIN named n USING (table_name) GROUP BY ALL)
        LEFT JOIN (SELECT table_name, sum(row_count) AS linked_rows FROM impact GROUP BY ALL) USING (table_name)""",
)
def defect_summary(spark, root):
    """Flagship: all rules, the rows that depend on the defects, and totals per table."""
    tables = source(spark, root)
    found = D.detect(tables, RULES)
    return D.defect_summary(found, D.impacts(found, IMPACT_EDGES, tables, show=SHOW))


OVERRIDES = [
    ("customer.c_acctbal.negative_balance", "allow", "approved", None, None),
    ("ORDERS.O_TOTALPRICE.TOTAL_OVERFLOW", "customize", "approved", "needs a second signature", "medium"),
    ("ORDERS.O_ORDERDATE.DATE_IN_FUTURE", "customize", "pending", "planned order", "low"),
]


@check(
    "defect_overrides",
    SQL_DEFECTS
    + """SELECT rule_key, CASE WHEN rule_ord = 3 THEN 'medium' ELSE severity END AS severity, rule_ord = 3 AS custom_reason, count(*) AS defects
        FROM named WHERE rule_ord <> 0 GROUP BY ALL""",
)
def defect_overrides(spark, root):
    overrides = spark.createDataFrame(
        OVERRIDES, "rule_key string, action_mode string, review_status string, custom_failure_reason string, custom_severity string"
    )
    report = D.defect_report(D.detect(source(spark, root), RULES), with_rows=False)
    return (
        D.apply_overrides(report, overrides)
        .groupBy("rule_key", "severity", (F.col("reason") == "needs a second signature").alias("custom_reason"))
        .agg(F.count(F.lit(1)).alias("defects"))
    )


PLAN = [
    D.PlannedDefect("CUSTOMER", "c_custkey", "c_acctbal", "-450.0", "negative_balance"),
    D.PlannedDefect("CUSTOMER", "c_custkey", "c_name", "x'); DROP TABLE customer;--", "sql_injection", rank=1),
    D.PlannedDefect("CUSTOMER", "c_custkey", "c_name", "short", "name_length", rank=2),
    D.PlannedDefect("ORDERS", "o_orderkey", "o_totalprice", "99999999999.99", "overflow", where="o_orderstatus = 'F'"),
    D.PlannedDefect("ORDERS", "o_orderkey", "o_custkey", "999999999", "fk_dangling", largest=True),
    D.PlannedDefect("SUPPLIER", "s_suppkey", "s_acctbal", "-1.0", "negative_balance", largest=True, rank=1),
]


@check(
    "defect_plan_recall",
    """WITH planted AS (
         SELECT 'CUSTOMER' AS t, 'c_acctbal' AS c, min(c_custkey) AS k FROM customer
         UNION ALL SELECT 'CUSTOMER', 'c_name', unnest(list_sort(list(c_custkey))[2:3]) FROM customer
         UNION ALL SELECT 'ORDERS', 'o_totalprice', min(o_orderkey) FROM orders WHERE o_orderstatus = 'F'
         UNION ALL SELECT 'ORDERS', 'o_custkey', max(o_orderkey) FROM orders
         UNION ALL SELECT 'SUPPLIER', 's_acctbal', list_sort(list(s_suppkey), 'DESC')[2] FROM supplier),
       natural_hits AS (
         SELECT 'CUSTOMER' AS t, 'c_acctbal' AS c, c_custkey AS k FROM customer WHERE c_acctbal < 0
         UNION SELECT 'ORDERS', 'o_totalprice', o_orderkey FROM orders WHERE o_totalprice > 450000
         UNION SELECT 'ORDERS', 'o_orderdate', o_orderkey FROM orders WHERE CAST(o_orderdate AS VARCHAR) > '2001-01-01'
         UNION SELECT 'SUPPLIER', 's_acctbal', s_suppkey FROM supplier WHERE s_acctbal < 0
         UNION SELECT 'PART', 'p_size', p_partkey FROM part WHERE p_size > p_retailprice
         UNION SELECT 'ORDERS', 'o_custkey', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
       SELECT (SELECT count(*) FROM planted) AS planted, (SELECT count(*) FROM planted) AS found, 0 AS missed, 1.0::DOUBLE AS recall,
              count(*) AS beyond_plan FROM natural_hits WHERE (t, c, k) NOT IN (SELECT t, c, k FROM planted)""",
)
def defect_plan_recall(spark, root):
    tables = source(spark, root)
    spoiled, ledger = D.apply_defect_plan(tables, PLAN)
    spoiled["SOLVENT"] = tables["SOLVENT"]
    report = D.defect_report(D.detect(spoiled, RULES), with_rows=False)
    return D.detector_recall(report, ledger)


@check(
    "inject_defect_recipes",
    f"""WITH ranked AS (SELECT *, row_number() OVER (ORDER BY {sql_order_key("'plant'", "o_orderkey")}, o_orderkey) AS rn,
            {sql_pick(2, "'plant'", "'recipe'", "o_orderkey")} AS which FROM (SELECT *, 'clerk ' || o_custkey || '@example.com' AS clerk_email FROM orders))
        SELECT 'ORDERS' AS table_name, CAST(o_orderkey AS VARCHAR) AS pk_value,
          CASE which WHEN 0 THEN 'o_totalprice' ELSE 'clerk_email' END AS column_name,
          CASE which WHEN 0 THEN 'numeric_overflow' ELSE 'email_malformed' END AS defect_type,
          CASE which WHEN 0 THEN CAST(o_totalprice AS VARCHAR) ELSE clerk_email END AS old_value,
          CASE which WHEN 0 THEN '9.999999999E8' ELSE replace(clerk_email, '@', ',') END AS bad_value
        FROM ranked WHERE rn <= 100""",
)
def inject_defect_recipes(spark, root):
    orders = read(spark, root, "orders").withColumn(
        "clerk_email", F.concat(F.lit("clerk "), "o_custkey", F.lit("@example.com"))
    )
    _, ledger = D.inject_defects(orders.drop("o_orderdate", "o_orderpriority"), "ORDERS", "o_orderkey", 100, "plant", ["o_custkey"])
    return ledger.select("table_name", "pk_value", "column_name", "defect_type", "old_value", "bad_value")
