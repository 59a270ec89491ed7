"""Edge-case injection: a fixed share of rows gets one extreme value each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import draws
from veilwork.functions.ordering import exact_share
from veilwork.operators.policies import ColumnPolicy
from veilwork.operators.profile import clean, is_numeric
from veilwork.operators.synthesis import RID
from veilwork.sources.sinks import EDGE_FLAG


def most_frequent(df: DataFrame, column: str) -> Column:
    """The commonest value, smallest on a tie, from a distributed count."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column)))).scalar()


def _kind(flag: str, column: str) -> str:
    flag, dated = flag.lower(), "date" in column.lower()
    # Words in a flag's name and the kind of value they ask for, first match wins.
    rules = [
        ("null", ("null", "missing"), True),
        ("zero", ("zero",), True),
        ("negative", ("negative",), True),
        ("max", ("max", "extreme", "boundary"), True),
        ("min", ("min",), True),
        ("duplicate", ("duplicate",), True),
        ("future", ("future",), dated),
        ("past", ("past",), dated),
        ("empty", ("empty",), True),
        ("special", ("special", "character"), True),
    ]
    return next((kind for kind, words, applies in rules if applies and any(w in flag for w in words)), "outlier")


def edge_value(df: DataFrame, field: T.StructField, flag: str, stats: Column) -> Column:
    """The value an edge case puts in place of the column's value, in the column's type."""
    column, numeric = F.col(field.name), is_numeric(field.dataType)
    kind = _kind(flag, field.name)

    def typed(value: Column) -> Column:
        return value.try_cast(field.dataType)

    if kind == "null":
        return F.lit(None).cast(field.dataType)
    if kind == "zero":
        return typed(F.lit("0"))
    if kind == "duplicate":
        return F.coalesce(most_frequent(df, field.name), column)
    if kind == "future":
        return typed(F.lit("2099-12-31"))
    if kind == "past":
        return typed(F.lit("1900-01-01"))
    if kind == "empty":
        return typed(F.lit(""))
    if kind == "special":
        return F.concat(column, F.lit("!@#$%")) if isinstance(field.dataType, T.StringType) else column
    if not numeric:
        return column
    high, low, mean, std = (stats[field.name][k] for k in ("high", "low", "mean", "std"))
    if kind == "negative":
        changed = F.when(column.isNull(), column).when(column == 0, F.lit(-1)).otherwise(-F.abs(column))
    elif kind == "max":
        changed = F.when(high == 0, F.lit(999999.0)).otherwise(high * 1.5)
    elif kind == "min":
        changed = F.when(low == 0, F.lit(0.0)).otherwise(low * 0.5)
    else:
        changed = F.when(std > 0, mean + 3 * std).otherwise(mean * 2)
    return typed(changed)


def inject_edge_cases(df: DataFrame, policies: Iterable[ColumnPolicy], share: float = 0.05, seed: int | str = 42, key: str = RID) -> DataFrame:
    """Replace values in exactly max(1, floor(n * share)) rows and flag those rows.

    Rows, and the one (column, flag) each of them gets, follow from keyed draws.
    The number of rows does not change.
    """
    specs = [
        (p.column_name, flag) for p in policies if p.column_name in df.columns for flag in p.edge_case_flags
    ]
    if share <= 0 or not specs:
        return df.withColumn(EDGE_FLAG, F.lit(False))
    fields = {f.name: f for f in df.schema.fields}
    numeric = sorted({c for c, _ in specs if is_numeric(fields[c].dataType)})
    stats = F.lit(None)
    if numeric:
        facts = [
            F.struct(
                F.max(v).alias("high"), F.min(v).alias("low"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")
            ).alias(c)
            for c in numeric
            for v in [clean(fields[c]).cast("double")]
        ]
        stats = df.agg(F.struct(*facts)).scalar()
    marked = (
        df.withColumn(EDGE_FLAG, exact_share(df, key, share, seed))
        .withColumn("_spec", draws.pick(len(specs), seed, "spec", F.col(key)))
        .withColumn("_stats", stats)
    )
    changed = {}
    for c in dict.fromkeys(c for c, _ in specs):
        value: Column = F.col(c)
        for i, (spec_column, flag) in enumerate(specs):
            if spec_column == c:
                hit = F.col(EDGE_FLAG) & (F.col("_spec") == i)
                value = F.when(hit, edge_value(df, fields[c], flag, F.col("_stats"))).otherwise(value)
        changed[c] = value
    return marked.withColumns(changed).drop("_spec", "_stats")


def edge_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.col(EDGE_FLAG).cast("int")), F.lit(0.0)).alias("edge_case_coverage"))
