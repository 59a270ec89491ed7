"""Mode-aware removal of duplicate rows, with a registry of rows already delivered."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.operators.profile import as_text, fields_of
from veilwork.operators.synthesis import RID

REGISTRY_SCHEMA = "table_name string, record_hash string, run_id string"


def record_hash(df: DataFrame, columns: Iterable[str]) -> Column:
    """SHA-256 of the columns in name order, as text joined by a bar; NULL reads None."""
    fields = sorted(fields_of(df, list(columns)), key=lambda f: f.name)
    return F.sha2(F.concat_ws("|", *[F.coalesce(as_text(f), F.lit("None")) for f in fields]), 256)


def compared_columns(df: DataFrame, mode: str, fk_columns: Sequence[str], ignore: Sequence[str]) -> list[str]:
    columns = [c for c in df.columns if c not in ignore]
    if mode == "event":
        return [c for c in columns if c not in fk_columns] or columns
    return columns


def dedup(
    df: DataFrame,
    mode: str,
    order: str = RID,
    fk_columns: Sequence[str] = (),
    registry: DataFrame | None = None,
    table: str = "",
    run_id: str = "",
    ignore: Sequence[str] | None = None,
) -> DataFrame:
    """Keep the first row (by ``order``) of each group of duplicates.

    Modes: ``reference`` keeps everything, ``entity`` and ``event_full`` compare
    all columns, ``event`` all columns but the foreign keys.  Rows registered by
    this run are dropped too.  Adds ``record_hash``.

    Each task forwards one row per hash (window group limit), so a third of all
    rows being copies of one row does not load one task.
    """
    if mode == "reference":
        return df
    ignored = list(ignore) if ignore is not None else [order]
    hashed = df.withColumn("record_hash", record_hash(df, compared_columns(df, mode, fk_columns, ignored)))
    if registry is not None:
        seen = registry.where((F.col("run_id") == run_id) & (F.col("table_name") == table)).select("record_hash").distinct()
        hashed = hashed.join(seen, "record_hash", "left_anti")
    window = Window.partitionBy("record_hash").orderBy(order)
    return hashed.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def new_registry_rows(kept: DataFrame, registry: DataFrame, table: str, run_id: str) -> DataFrame:
    """Hashes to append: those no run has registered for this table."""
    fresh = kept.select("record_hash").distinct()
    known = registry.where(F.col("table_name") == table).select("record_hash").distinct()
    return fresh.join(known, "record_hash", "left_anti").select(
        F.lit(table).alias("table_name"), "record_hash", F.lit(run_id).alias("run_id")
    )
