"""Registry of the queries that are compared with SQL, and SQL text helpers."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ALL_TABLES = TPCH + ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


# ---- SQL text for DuckDB ------------------------------------------------------


def sql_digest(*parts: str) -> str:
    """Parts are SQL expressions; text constants need their own quotes."""
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def sql_word(digest: str, index: int = 0) -> str:
    return f"('0x' || substr({digest}, {1 + 8 * index}, 8))::BIGINT"


def sql_uniform(*parts: str) -> str:
    return f"({sql_word(sql_digest(*parts))} / 4294967296::DOUBLE)"


def sql_pick(size, *parts: str) -> str:
    return f"(('0x' || substr({sql_digest(*parts)}, 1, 15))::BIGINT % ({size})::BIGINT)"


def sql_order_key(*parts: str) -> str:
    return f"('0x' || substr({sql_digest(*parts)}, 1, 12))::BIGINT"


def sql_normal(*parts: str) -> str:
    d = sql_digest(*parts)
    return (
        f"(sqrt(-2.0::DOUBLE * ln(({sql_word(d, 0)} + 1) / 4294967296::DOUBLE))"
        f" * cos(2 * pi() * {sql_word(d, 1)} / 4294967296::DOUBLE))"
    )


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_text(column: str, kind: str) -> str:
    """Column as the text Spark gives it; NaN reads NULL, -0.0 reads 0.0."""
    if kind == "double":
        return f"CAST(CASE WHEN isnan({column}) THEN NULL ELSE {column} + 0.0 END AS VARCHAR)"
    return f"CAST({column} AS VARCHAR)"


# Columns of the given tables, with Spark's names of their types.
SCHEMAS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double"
    " o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double"
    " l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string"
    " l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in SCHEMAS[table].split()]


NUMERIC = {"int", "bigint", "double"}


def sql_column_stats(tables) -> str:
    """One row per column of each table, as the profile gives it."""
    parts = []
    for table in tables:
        for ordinal, (column, kind) in enumerate(columns_of(table), start=1):
            text = sql_text(column, kind)
            number = f"{column}::DOUBLE" if kind in NUMERIC else "NULL::DOUBLE"
            parts.append(
                f"SELECT '{table.upper()}' AS table_name, '{column}' AS column_name, '{kind}' AS data_type,"
                f" {ordinal} AS ordinal, count(*) AS row_count, count(*) - count({text}) AS null_count,"
                f" count(DISTINCT {text}) AS distinct_count, min({number}) AS min_value, max({number}) AS max_value,"
                f" avg({number}) AS mean_value, stddev_samp({number}) AS std_value,"
                f" coalesce(bool_and(upper({text}) IN ('Y','N','TRUE','FALSE','0','1')), false) AS boolean_like"
                f" FROM {table}"
            )
    return " UNION ALL ".join(parts)
