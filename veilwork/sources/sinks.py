"""Writing delivered tables, manifests, reports and registries."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.sources.tables import Tables, union_all

EDGE_FLAG = "_edge_case"


def _export_column(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    if isinstance(kind, T.BinaryType):
        text = column.cast("string")
        return F.when(F.is_valid_utf8(text), text).otherwise(F.lower(F.hex(column)))
    return column


def normalize_for_export(df: DataFrame) -> DataFrame:
    """Collections become JSON; bytes become text when valid UTF-8, else hex."""
    return df.select(*[_export_column(f).alias(f.name) for f in df.schema.fields])


def iso_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, for formats without a timestamp type."""
    return df.select(
        *[
            F.date_format(F.col(f.name), "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def deliver(tables: Tables, root: str, run_id: str, fmt: str = "parquet") -> None:
    """Write each table of a run without its edge-case flag."""
    for name, df in tables.items():
        out = normalize_for_export(df.drop(EDGE_FLAG))
        target = os.path.join(root, f"run_id={run_id}", f"format={fmt}", name)
        if fmt == "csv":
            iso_timestamps(out).write.mode("overwrite").option("header", True).csv(target)
        else:
            out.write.mode("overwrite").format(fmt).save(target)


def _as_map(df: DataFrame, key: str, value: str) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key), F.col(value))))
    return df.agg(F.map_from_entries(pairs)).scalar()


def build_manifest(
    run_id: str,
    source_name: str,
    created_at: str,
    tables: Tables,
    validation: DataFrame | None = None,
    domains: Mapping[str, str] | None = None,
    strategies: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row that describes a run.  Its maps have one entry per table."""
    spark = next(iter(tables.values())).sparkSession
    facts = manifest_facts(tables)
    checks = None
    if validation is not None:
        checks = validation.groupBy("table_name").agg(
            F.count(F.lit(1)).alias("checks_total"), F.count_if("passed").alias("checks_passed")
        )

    def constant(values: Mapping[str, str] | None) -> Column:
        entries = [part for k, v in (values or {}).items() for part in (F.lit(k), F.lit(v))]
        return F.create_map(*entries).cast("map<string,string>")

    empty = F.create_map().cast("map<string,bigint>")
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(source_name).alias("source_name"),
        F.lit(created_at).alias("created_at"),
        F.array(*[F.lit(t) for t in sorted(tables)]).alias("tables"),
        _as_map(facts, "table_name", "row_count").alias("row_counts"),
        _as_map(facts, "table_name", "edge_case_coverage").alias("edge_case_coverage"),
        (_as_map(checks, "table_name", "checks_passed") if checks else empty).alias("checks_passed"),
        (_as_map(checks, "table_name", "checks_total") if checks else empty).alias("checks_total"),
        constant(domains).alias("domains"),
        constant(strategies).alias("strategies"),
    )


def manifest_facts(tables: Tables) -> DataFrame:
    """(table_name, row_count, column_count, edge_case_coverage), one job for all tables."""

    def one(name: str, df: DataFrame) -> DataFrame:
        flagged = EDGE_FLAG in df.columns
        coverage = F.avg(F.col(EDGE_FLAG).cast("int")) if flagged else F.lit(0.0)
        return df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.coalesce(coverage, F.lit(0.0)).alias("edge_case_coverage"),
        ).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns) - int(flagged)).cast("long").alias("column_count"),
            "edge_case_coverage",
        )

    return union_all(one(n, d) for n, d in tables.items())


def write_manifest(manifest: DataFrame, root: str, run_id: str) -> None:
    manifest.write.mode("overwrite").json(os.path.join(root, f"run_id={run_id}", "manifest"))


def write_report(defects: DataFrame, path: str) -> None:
    """Defect rows as JSON, one folder per table."""
    defects.write.mode("overwrite").partitionBy("table_name").json(path)


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Base rows replaced by newer updates with the same key; an update wins a tie."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return latest_rows(both, keys, [F.desc(order), F.desc("_new")]).drop("_new")


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a registry or log (boundary keys, record hashes, step logs)."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def copy_tables(tables: Tables, root: str, fmt: str = "parquet") -> None:
    """Replicate a source in another file format."""
    for name, df in tables.items():
        out = iso_timestamps(normalize_for_export(df)) if fmt == "csv" else df
        out.write.mode("overwrite").format(fmt).option("header", True).save(os.path.join(root, name.lower()))
