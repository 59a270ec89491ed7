"""Reading whole relational sources: a dict of upper-case table name to DataFrame."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.session import spread

Tables = dict[str, DataFrame]


def is_internal(name: str) -> bool:
    """Tables whose name starts with an underscore hold bookkeeping, not data."""
    return name.startswith("_")


def load_tables(
    spark: SparkSession,
    root: str,
    names: Iterable[str],
    fmt: str = "parquet",
    suffix: str = ".parquet",
    **options: str,
) -> Tables:
    """Read ``root/<name><suffix>`` for each name; internal tables are left out."""
    return {
        name.upper(): spark.read.format(fmt).options(**options).load(os.path.join(root, name + suffix))
        for name in names
        if not is_internal(name)
    }


def load_jdbc(
    spark: SparkSession,
    url: str,
    tables: Mapping[str, Mapping[str, str]],
    **options: str,
) -> Tables:
    """Read database tables in parallel.

    ``tables`` maps each name to its split options (``partitionColumn``,
    ``lowerBound``, ``upperBound``, ``numPartitions``); a table given no split
    column is read by one task, so every large table should name one.
    """
    return {
        name.upper(): spark.read.format("jdbc")
        .options(url=url, dbtable=name, **options)
        .options(**split)
        .load()
        for name, split in tables.items()
        if not is_internal(name)
    }


class SourceRegistry:
    """Named sources; the first one registered is the default."""

    def __init__(self, sources: Mapping[str, Mapping[str, object]]):
        self.sources = dict(sources)

    def names(self) -> list[str]:
        return list(self.sources)

    def resolve(self, name: str | None = None) -> tuple[str, Mapping[str, object]]:
        chosen = name or next(iter(self.sources))
        if chosen not in self.sources:
            raise KeyError(f"unknown source {chosen!r}; known: {', '.join(self.sources)}")
        return chosen, self.sources[chosen]

    def load(self, spark: SparkSession, name: str | None = None) -> Tables:
        _, spec = self.resolve(name)
        spec = dict(spec)
        if spec.pop("kind", "files") == "jdbc":
            return load_jdbc(spark, **spec)
        return load_tables(spark, **spec)


def visible_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Catalog tables without the internal ones."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not is_internal(t.name))


def column_catalog(spark: SparkSession, tables: Tables) -> DataFrame:
    """(table_name, column_name, data_type, ordinal, nullable), from schemas only."""
    rows = [
        (name, field.name, field.dataType.simpleString(), position, field.nullable)
        for name, df in tables.items()
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    schema = "table_name string, column_name string, data_type string, ordinal int, nullable boolean"
    return spark.createDataFrame(rows, schema)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def row_counts(tables: Tables) -> DataFrame:
    """(table_name, row_count) for all tables in one job; Parquet reads no columns for it."""
    return union_all(
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    )


def sample_values(df: DataFrame, column: str, n: int | None = 100) -> DataFrame:
    """Non-null values of a column as text (``n=None`` gives all of them)."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"))
    return values if n is None else values.limit(n)


def preview(df: DataFrame, n: int = 50) -> tuple[DataFrame, int]:
    """First ``n`` rows for display, and the total row count."""
    return df.limit(n), df.count()


def read_generated(
    spark: SparkSession, root: str, table: str, run_id: str | None = None
) -> DataFrame:
    """A delivered table; without ``run_id`` the newest run that delivered it, by its manifest's time.

    Where no manifest names the table, the run with the largest id.
    """
    run_id = run_id or newest_run(spark, root, table)
    everything = spark.read.option("basePath", root)
    for fmt in ("parquet", "csv"):
        pattern = os.path.join(root, f"run_id={run_id or '*'}", f"format={fmt}", table.upper())
        try:
            found = everything.format(fmt).option("header", True).load(pattern)
        except Exception as error:  # no such path in this format: try the next one
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        if run_id is None:
            newest = found.agg(F.max("run_id")).scalar()
            found = found.where(F.col("run_id") == newest)
        return found.drop("run_id", "format")
    raise FileNotFoundError(f"{table} was not delivered under {root}")


def newest_run(spark: SparkSession, root: str, table: str) -> str | None:
    """The run with the latest manifest that lists the table."""
    try:
        known = manifests(spark, root)
    except Exception as error:  # no manifest at all
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    listed = known.where(F.upper("table_name") == table.upper())
    return listed.agg(F.max_by("run_id", F.struct("created_at", "run_id"))).first()[0]


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per (run, table) from every manifest, newest run first."""
    read = spark.read.json(os.path.join(root, "run_id=*", "manifest"), schema=MANIFEST_SCHEMA)
    return (
        read.select("run_id", "source_name", "created_at", F.explode("row_counts"))
        .withColumnRenamed("key", "table_name")
        .withColumnRenamed("value", "rows_generated")
        .orderBy(F.desc("created_at"), "table_name")
    )


MANIFEST_SCHEMA = (
    "run_id string, source_name string, created_at string, tables array<string>,"
    " row_counts map<string,bigint>, edge_case_coverage map<string,double>,"
    " checks_passed map<string,bigint>, checks_total map<string,bigint>,"
    " domains map<string,string>, strategies map<string,string>"
)


def statements(texts: DataFrame, column: str = "value") -> DataFrame:
    """SQL statements of a text corpus, one per row, without comments.

    ``texts`` may hold one file or one statement per row.  Comments go first, so
    that a semicolon inside one does not split a statement.
    """
    text = F.col(column)
    lines = F.when(F.contains(text, F.lit("--")), F.regexp_replace(text, r"--[^\n]*", " ")).otherwise(text)
    kept = [c for c in texts.columns if c != column]
    clean = spread(texts).select(*kept, lines.alias("_lines")).select(*kept, _without_blocks("_lines").alias("_text"))
    return (
        clean.select(*kept, F.explode(F.split("_text", ";")).alias("statement"))
        .withColumn("statement", F.trim(F.regexp_replace("statement", r"\s+", " ")))
        .where(F.col("statement") != "")
    )


def _without_blocks(column: str) -> Column:
    """Text without block comments; most texts have none and skip the regex."""
    block = r"/\*[^*]*\*+([^/*][^*]*\*+)*/"
    text = F.col(column)
    return F.when(F.contains(text, F.lit("/*")), F.regexp_replace(text, block, " ")).otherwise(text)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Statements of every SQL file below ``path``."""
    return statements(spark.read.text(path, wholetext=True))
