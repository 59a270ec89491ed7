"""Foreign-key edges: declared in DDL text, mined from query logs, checked on data.

An edge is a row (source_table, source_column, target_table, target_column,
relationship_type, confidence); the source is the child.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.sources.tables import Tables, union_all

EDGE_SCHEMA = (
    "source_table string, source_column string, target_table string, target_column string,"
    " relationship_type string, confidence double"
)
END_COLUMNS = ["source_table", "source_column", "target_table", "target_column"]

IDENT = r'"?([A-Za-z_][A-Za-z0-9_]*)"?'
CREATE = r"(?i)^\s*create\s+table\s+(?:if\s+not\s+exists\s+)?" + IDENT
FOREIGN_KEY = r"(?i)foreign\s+key\s*\(([^)]*)\)\s*references\s+" + IDENT + r"\s*\(([^)]*)\)"
FROM_CLAUSE = (
    r"(?i)\bfrom\s+(.*?)\s*(?:\bwhere\b|\bgroup\s+by\b|\border\s+by\b|\bhaving\b|\blimit\b|\bunion\b|\)|$)"
)
JOIN_WORD = r"(?i)\s+(?:(?:inner|left|right|full|outer|cross|natural)\s+)*join\s+"
WHERE_CLAUSE = r"(?i)\bwhere\s+(.*?)\s*(?:\bgroup\s+by\b|\border\s+by\b|\bhaving\b|\blimit\b|\bunion\b|$)"
TABLE_ALIAS = r'(?i)^\s*"?([a-z_][a-z0-9_]*)"?(?:\s+(?:as\s+)?"?([a-z_][a-z0-9_]*)"?)?'
SINGLE_EQUALITY = r"^\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*$"
EACH_EQUALITY = r"(?i)(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*(?:\)|\band\b|\bor\b|$)"


@dataclass(frozen=True)
class Edge:
    source_table: str
    source_column: str
    target_table: str
    target_column: str
    relationship_type: str = "FK_DECLARED"
    confidence: float = 1.0


def edges_frame(spark: SparkSession, edges: Iterable[Edge]) -> DataFrame:
    rows = [
        (e.source_table, e.source_column, e.target_table, e.target_column, e.relationship_type, e.confidence)
        for e in edges
    ]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def edge_list(edges: DataFrame) -> list[Edge]:
    """Schema edges on the driver: as many as a schema has foreign keys, never row data."""
    return [Edge(**row.asDict()) for row in edges.select(*[f.split()[0] for f in EDGE_SCHEMA.split(", ")]).collect()]


def _names(list_text: Column) -> Column:
    return F.transform(F.split(list_text, ","), lambda c: F.upper(F.regexp_replace(c, r'[\s"]', "")))


def declared_fks(statements: DataFrame, column: str = "statement") -> DataFrame:
    """Edges of every CREATE TABLE statement that has FOREIGN KEY clauses."""
    text = F.col(column)
    keys = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(FOREIGN_KEY), F.lit(1)).alias("children"),
        F.regexp_extract_all(text, F.lit(FOREIGN_KEY), F.lit(2)).alias("parent"),
        F.regexp_extract_all(text, F.lit(FOREIGN_KEY), F.lit(3)).alias("parents"),
    )
    return (
        statements.select(F.upper(F.regexp_extract(text, CREATE, 1)).alias("source_table"), F.explode(keys).alias("k"))
        .where(F.col("source_table") != "")
        .select(
            "source_table",
            F.upper("k.parent").alias("target_table"),
            F.explode(
                F.arrays_zip(
                    _names(F.col("k.children")).alias("source_column"),
                    _names(F.col("k.parents")).alias("target_column"),
                )
            ).alias("c"),
        )
        .where(F.col("c.source_column").isNotNull() & F.col("c.target_column").isNotNull())
        .select(
            "source_table",
            "c.source_column",
            "target_table",
            "c.target_column",
            F.lit("FK_DECLARED").alias("relationship_type"),
            F.lit(1.0).alias("confidence"),
        )
        .distinct()
    )


KEYWORDS = ["ON", "WHERE", "USING", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "GROUP", "ORDER"]


def _alias_entry(piece: Column) -> Column:
    table = F.upper(F.regexp_extract(piece, TABLE_ALIAS, 1))
    alias = F.upper(F.regexp_extract(piece, TABLE_ALIAS, 2))
    return F.struct(
        F.when((alias == "") | alias.isin(KEYWORDS), table).otherwise(alias).alias("alias"),
        table.alias("table"),
    )


def _resolve(aliases: Column, alias: Column) -> Column:
    return F.try_element_at(F.filter(aliases, lambda a: a["alias"] == alias), F.lit(1))["table"]


PARTS = ("a", "x", "b", "y")


def statement_shapes(statements: DataFrame, column: str = "statement") -> DataFrame:
    """(shape, times): statements with their constants blanked, counted.

    Logs repeat few statements with many constants; whatever is read from a shape
    is read once, and a statement that fills a third of the log is one row.
    """
    text = F.regexp_replace(F.col(column), "'[^']*'", "''")
    text = F.regexp_replace(text, r"\b[0-9]+(?:\.[0-9]+)?\b", "0")
    return statements.groupBy(text.alias("shape")).agg(F.count(F.lit(1)).alias("times"))


def join_pairs(statements: DataFrame, column: str = "statement") -> DataFrame:
    """The two ends of every join equality and how often it was written.

    The alphabetically smaller table comes first.  An ON condition counts when it
    is one equality; in WHERE every equality between columns of two different
    aliases counts.
    """
    # one select per step: each later expression then refers to a computed column
    split = (
        statement_shapes(statements, column)
        .select(
            "times",
            F.regexp_extract_all("shape", F.lit(FROM_CLAUSE), F.lit(1)).alias("clauses"),
            F.regexp_extract("shape", WHERE_CLAUSE, 1).alias("where"),
        )
        .select("times", "where", F.flatten(F.transform("clauses", lambda c: F.split(c, JOIN_WORD))).alias("pieces"))
        .select(
            "times",
            "where",
            F.flatten(
                F.transform("pieces", lambda p: F.split(F.regexp_replace(p, r"(?i)\s+on\s+.*$", ""), ","))
            ).alias("tables"),
            F.filter(
                F.transform("pieces", lambda p: F.regexp_extract(p, r"(?i)\s+on\s+(.*)$", 1)),
                lambda t: t.rlike(SINGLE_EQUALITY),
            ).alias("on"),
        )
    )
    on_pairs = F.transform(
        "on",
        lambda t: F.struct(
            *[F.upper(F.regexp_extract(t, SINGLE_EQUALITY, i + 1)).alias(n) for i, n in enumerate(PARTS)],
            F.lit(False).alias("where"),
        ),
    )
    where_pairs = F.transform(
        F.arrays_zip(
            *[F.regexp_extract_all("where", F.lit(EACH_EQUALITY), F.lit(i + 1)).alias(n) for i, n in enumerate(PARTS)]
        ),
        lambda s: F.struct(*[F.upper(s[n]).alias(n) for n in PARTS], F.lit(True).alias("where")),
    )
    found = (
        split.select("times", F.transform("tables", _alias_entry).alias("aliases"), F.concat(on_pairs, where_pairs).alias("pairs"))
        .select("times", "aliases", F.explode("pairs").alias("p"))
        .where(~F.col("p.where") | (F.col("p.a") != F.col("p.b")))
        .select(
            "times",
            _resolve(F.col("aliases"), F.col("p.a")).alias("t1"),
            F.col("p.x").alias("c1"),
            _resolve(F.col("aliases"), F.col("p.b")).alias("t2"),
            F.col("p.y").alias("c2"),
        )
        .where(F.col("t1").isNotNull() & F.col("t2").isNotNull())
    )
    swap = F.col("t1") > F.col("t2")

    def end(first: str, second: str) -> Column:
        return F.when(swap, F.col(second)).otherwise(F.col(first))

    return found.select(
        end("t1", "t2").alias("source_table"),
        end("c1", "c2").alias("source_column"),
        end("t2", "t1").alias("target_table"),
        end("c2", "c1").alias("target_column"),
        "times",
    )


def mine_joins(statements: DataFrame, column: str = "statement") -> DataFrame:
    """Inferred edges with how often each was seen and the confidence that gives."""
    n = F.col("join_count")
    confidence = F.when(n > 1000, 0.95).when(n > 100, 0.80).when(n > 10, 0.60).otherwise(0.30)
    return (
        join_pairs(statements, column)
        .groupBy(*END_COLUMNS)
        .agg(F.sum("times").alias("join_count"))
        .select(
            *END_COLUMNS,
            F.lit("FK_INFERRED").alias("relationship_type"),
            confidence.alias("confidence"),
            "join_count",
        )
    )


def inclusion(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row: how far the child's values lie in the parent's, and whether those are unique."""
    child_values = child.select(F.col(child_column).alias("_v")).where("_v is not null").distinct()
    parent_values = (
        parent.select(F.col(parent_column).alias("_v"))
        .where("_v is not null")
        .groupBy("_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    matched = child_values.withColumn("_c", F.lit(1)).join(parent_values, "_v", "full")
    return matched.agg(
        F.count("_c").alias("child_values"),
        F.count_if(F.col("_c").isNotNull() & F.col("_n").isNotNull()).alias("contained_values"),
        F.coalesce(F.count_if(F.col("_n").isNotNull()) == F.sum("_n"), F.lit(False)).alias("parent_unique"),
    ).select(
        "child_values",
        "contained_values",
        F.coalesce(F.try_divide("contained_values", "child_values"), F.lit(0.0)).alias("inclusion_ratio"),
        "parent_unique",
    )


def check_edges(tables: Tables, edges: Iterable[Edge]) -> DataFrame:
    """Inclusion of every candidate edge, one job for all of them."""
    return union_all(
        inclusion(tables[e.source_table], e.source_column, tables[e.target_table], e.target_column).select(
            *[F.lit(getattr(e, c)).alias(c) for c in END_COLUMNS], "*"
        )
        for e in edges
        if e.source_table in tables and e.target_table in tables
    )


def orient(tables: Tables, mined: Iterable[Edge], declared: Iterable[Edge] = (), least: float = 1.0) -> list[Edge]:
    """Point mined edges from child to parent and drop those already declared.

    A direction holds when the child's values lie in the parent's column (share
    at least ``least``) and that column is unique.  Pairs that hold in neither
    direction are dropped.
    """
    known = {(e.source_table, e.source_column, e.target_table, e.target_column) for e in declared}
    fresh = []
    for e in mined:
        ends = (e.source_table, e.source_column, e.target_table, e.target_column)
        if ends in known or ends[2:] + ends[:2] in known:
            continue
        if e.source_table in tables and e.target_table in tables:
            fresh.append(e)
    if not fresh:
        return []
    both = fresh + [
        Edge(e.target_table, e.target_column, e.source_table, e.source_column, e.relationship_type, e.confidence)
        for e in fresh
    ]
    held = {
        tuple(row[c] for c in END_COLUMNS)
        for row in check_edges(tables, both)
        .where((F.col("inclusion_ratio") >= least) & F.col("parent_unique"))
        .collect()  # at most two rows per mined edge
    }
    result = []
    for e, back in zip(fresh, both[len(fresh):]):
        for candidate in (e, back):
            if tuple(getattr(candidate, c) for c in END_COLUMNS) in held:
                result.append(candidate)
                break
    return result


def restrict(edges: DataFrame, tables: Iterable[str]) -> DataFrame:
    """Edges with both ends among the given tables (names compared in upper case)."""
    names = [t.upper() for t in tables]
    return edges.where(F.upper("source_table").isin(names) & F.upper("target_table").isin(names))


def merge_edges(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """All edges, one per pair of columns; an inferred row replaces a declared one."""
    columns = [*END_COLUMNS, "relationship_type", "confidence"]
    both = (
        declared.select(*columns, F.lit(0).alias("_ord"))
        .unionByName(inferred.select(*columns, F.lit(1).alias("_ord")))
    )
    window = Window.partitionBy(*[F.upper(c) for c in END_COLUMNS]).orderBy(F.desc("_ord"), F.desc("confidence"))
    return (
        both.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn", "_ord")
    )


def junction_tables(edges: DataFrame, column_counts: DataFrame, most_own: int = 5) -> DataFrame:
    """Tables with exactly two foreign keys and few columns of their own."""
    keys = edges.groupBy(F.upper("source_table").alias("table_name")).agg(F.count(F.lit(1)).alias("fk_count"))
    return (
        column_counts.join(keys, "table_name")
        .where((F.col("fk_count") == 2) & (F.col("column_count") - F.col("fk_count") <= most_own))
    )


def orphans(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key exists in no parent row; NULL keys are no orphans.

    A left anti join on the key: NULL parents do not hide orphans, and nothing is
    broadcast unless Spark has measured it to be small.
    """
    keys = parent.select(F.col(parent_column).alias("_pk")).where("_pk is not null")
    return child.where(F.col(child_column).isNotNull()).join(
        keys, F.col(child_column) == F.col("_pk"), "left_anti"
    )
