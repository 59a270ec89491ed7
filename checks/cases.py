"""Tracing of business cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, read
from checks.privacy import KEY, sql_mask_digest, _of
from checks.relations import EDGES, tables_of
from veilwork.operators import masking as M
from veilwork.operators import tracing as T
from veilwork.operators.policies import ColumnPolicy

SHOW = {
    "REGION": ["r_regionkey"], "NATION": ["n_nationkey"], "CUSTOMER": ["c_custkey"], "ORDERS": ["o_orderkey"],
    "LINEITEM": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "PART": ["p_partkey"], "SUPPLIER": ["s_suppkey"],
}


def traced(spark, root):
    """Every customer in debt is one case."""
    tables = tables_of(spark, root)
    roots = tables["CUSTOMER"].where("c_acctbal < 0").withColumn(T.CASE, F.col("c_custkey").cast("string"))
    return T.trace(tables, EDGES, "CUSTOMER", roots.select(T.CASE, *tables["CUSTOMER"].columns))


SQL_TRACE = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, * FROM customer WHERE c_acctbal < 0),
   n AS (SELECT DISTINCT case_id, nation.* FROM c JOIN nation ON c_nationkey = n_nationkey),
   o AS (SELECT DISTINCT case_id, orders.* FROM c JOIN orders ON o_custkey = c_custkey),
   r AS (SELECT DISTINCT case_id, region.* FROM n JOIN region ON n_regionkey = r_regionkey),
   c2 AS (SELECT DISTINCT case_id, customer.* FROM o JOIN customer ON o_custkey = c_custkey),
   l AS (SELECT DISTINCT case_id, lineitem.* FROM o JOIN lineitem ON l_orderkey = o_orderkey),
   o3 AS (SELECT DISTINCT case_id, orders.* FROM l JOIN orders ON l_orderkey = o_orderkey),
   p3 AS (SELECT DISTINCT case_id, part.* FROM l JOIN part ON l_partkey = p_partkey),
   s3 AS (SELECT DISTINCT case_id, supplier.* FROM l JOIN supplier ON l_suppkey = s_suppkey)
"""


def _sql_rows() -> str:
    visits = [("c", "CUSTOMER", "root", 0), ("n", "NATION", "upstream", 1), ("o", "ORDERS", "downstream", 1),
              ("r", "REGION", "upstream", 2), ("c2", "CUSTOMER", "context", 2), ("l", "LINEITEM", "downstream", 2),
              ("o3", "ORDERS", "context", 3), ("p3", "PART", "context", 3), ("s3", "SUPPLIER", "context", 3)]
    return " UNION ALL ".join(
        f"SELECT case_id, '{t}' AS table_name, '{m}' AS mode, {d} AS depth, CAST(to_json({{{', '.join(f"'{c}': {c}" for c in SHOW[t])}}}) AS VARCHAR) AS row FROM {a}"
        for a, t, m, d in visits
    )


@check("trace_case", SQL_TRACE + _sql_rows())
def trace_case(spark, root):
    return traced(spark, root).rows(SHOW)


def _sql_links() -> str:
    steps = [
        ("c", "CUSTOMER", "NATION", "c_nationkey", "n_nationkey", "upstream", 0), ("c", "CUSTOMER", "ORDERS", "c_custkey", "o_custkey", "downstream", 0),
        ("n", "NATION", "REGION", "n_regionkey", "r_regionkey", "upstream", 1), ("o", "ORDERS", "CUSTOMER", "o_custkey", "c_custkey", "upstream", 1),
        ("o", "ORDERS", "LINEITEM", "o_orderkey", "l_orderkey", "downstream", 1), ("l", "LINEITEM", "ORDERS", "l_orderkey", "o_orderkey", "upstream", 2),
        ("l", "LINEITEM", "PART", "l_partkey", "p_partkey", "upstream", 2), ("l", "LINEITEM", "SUPPLIER", "l_suppkey", "s_suppkey", "upstream", 2),
    ]
    return " UNION ALL ".join(
        f"SELECT case_id, '{f}' AS from_table, '{t}' AS to_table, '{a}' AS via_source_column, '{b}' AS via_target_column, CAST({a} AS VARCHAR) AS match_value,"
        f" '{way}' AS direction, {d} AS depth, k AS row_count FROM {x} JOIN (SELECT {b} AS key, count(*) AS k FROM {t} GROUP BY 1) ON key = {a}"
        for x, f, t, a, b, way, d in steps
    )


@check("trace_links", SQL_TRACE + _sql_links())
def trace_links(spark, root):
    return traced(spark, root).links


@check(
    "masked_scenario",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 'CUSTOMER' AS table_name, {_of(M.FIRST_NAMES, sql_mask_digest('c_name', 'c_name'), 0)} || ' ' || {_of(M.LAST_NAMES, sql_mask_digest('c_name', 'c_name'), 1)} AS c_name
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 490000""",
)
def masked_scenario(spark, root):
    """One case per very large order; its customer comes out masked."""
    tables = {n: df for n, df in tables_of(spark, root).items() if n in ("ORDERS", "CUSTOMER", "NATION", "REGION")}
    roots = tables["ORDERS"].where("o_totalprice > 490000").withColumn(T.CASE, F.col("o_orderkey").cast("string"))
    found = T.trace(tables, EDGES, "ORDERS", roots.select(T.CASE, *tables["ORDERS"].columns))
    policies = [
        ColumnPolicy("CUSTOMER", "c_name", masking_strategy="substitute_realistic"),
        ColumnPolicy("CUSTOMER", "c_acctbal", masking_strategy="suppress"),
    ]
    masked = T.masked_scenario(found, policies, EDGES, KEY)
    return masked["CUSTOMER"].select(T.CASE, F.lit("CUSTOMER").alias("table_name"), "c_name")


@check(
    "list_ids",
    "SELECT DISTINCT c_name AS value FROM customer WHERE contains(c_name, '#0000000') ORDER BY value LIMIT 50",
)
def list_ids(spark, root):
    """The search box: the first 50 ids that contain the text."""
    return T.id_values(read(spark, root, "customer"), "c_name", "#0000000")


@check(
    "point_lookup",
    "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def point_lookup(spark, root):
    wanted = read(spark, root, "customer").where("c_acctbal < 0").select("c_custkey")
    return T.point_lookup(read(spark, root, "orders"), "o_custkey", wanted)
