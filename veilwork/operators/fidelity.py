"""Distribution tests between a real and a synthetic table, all columns in one go.

Both tables are reduced to (column_name, value, n_real, n_synth), one row per
distinct value, before anything is ordered or joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.ordering import CELLS, split_into_cells
from veilwork.functions.tails import chi_square_tail, kolmogorov_tail
from veilwork.operators.profile import clean, fields_of, is_numeric, long_form
from veilwork.session import cut_lineage, spread

BINS = 50  # fixed value: number of histogram bins
EPSILON = 1e-10  # fixed value: added to every normalised histogram entry


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(f.name).alias("column_name"), clean(f).cast("double").alias("value"))
            for f in fields_of(df, columns)
        ]
    )
    return spread(df).select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")


def _sides(real: DataFrame, synth: DataFrame) -> DataFrame:
    both = real.withColumn("_r", F.lit(1)).withColumn("_s", F.lit(0)).unionByName(
        synth.withColumn("_r", F.lit(0)).withColumn("_s", F.lit(1))
    )
    return both.groupBy("column_name", "value").agg(
        F.sum("_r").alias("n_real"), F.sum("_s").alias("n_synth")
    )


def numeric_counts(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _sides(numeric_long(real, columns), numeric_long(synth, columns))


def category_counts(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _sides(
        long_form(real, columns).where("value is not null"), long_form(synth, columns).where("value is not null")
    )


def side_totals(counts: DataFrame) -> DataFrame:
    """Per column: values on each side, and distinct values of the real side."""
    return counts.groupBy("column_name").agg(
        F.sum("n_real").alias("total_real"),
        F.sum("n_synth").alias("total_synth"),
        F.count_if(F.col("n_real") > 0).alias("distinct_real"),
    )


def ks_two_sample(counts: DataFrame, cells: int = CELLS, written: bool = False) -> DataFrame:
    """(column_name, total_real, total_synth, ks_stat, p_value) from numeric counts.

    The distribution functions run over ranges of values: each range knows the
    totals of the ranges below it, so no task sees a whole column.  The statistic
    is exact; the p-value is asymptotic.  The counts are read three times, so they
    are written first unless they are a table already.
    """
    counts = counts if written else cut_lineage(counts)
    celled = split_into_cells(counts, "value", ["column_name"], cells)
    sizes = celled.groupBy("column_name", "_cell").agg(F.sum("n_real").alias("_cr"), F.sum("n_synth").alias("_cs"))
    all_cells = Window.partitionBy("column_name")  # at most `cells` rows per column
    before = all_cells.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "column_name",
        "_cell",
        F.coalesce(F.sum("_cr").over(before), F.lit(0)).alias("_br"),
        F.coalesce(F.sum("_cs").over(before), F.lit(0)).alias("_bs"),
        F.sum("_cr").over(all_cells).alias("total_real"),
        F.sum("_cs").over(all_cells).alias("total_synth"),
    )
    inside = Window.partitionBy("column_name", "_cell").orderBy("value")
    running = celled.select(
        "column_name",
        "_cell",
        F.sum("n_real").over(inside).alias("_r"),
        F.sum("n_synth").over(inside).alias("_s"),
    ).join(offsets, ["column_name", "_cell"])
    gap = F.abs(
        F.try_divide(F.col("_r") + F.col("_br"), "total_real")
        - F.try_divide(F.col("_s") + F.col("_bs"), "total_synth")
    )
    effective = F.sqrt(F.try_divide(F.col("total_real") * F.col("total_synth").cast("double"), F.col("total_real") + F.col("total_synth")))
    return (
        running.groupBy("column_name", "total_real", "total_synth")
        .agg(F.max(gap).alias("ks_stat"))
        .withColumn("p_value", kolmogorov_tail(effective * F.col("ks_stat")))
    )


def histogram(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """(column_name, value = bin number, n_real, n_synth): equal widths over the joint range."""
    limits = counts.groupBy("column_name").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    limits = limits.select(
        "column_name",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        (F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")) / bins).alias("_width"),
    )
    position = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("_lo")) / F.col("_width")))
    return (
        counts.join(limits, "column_name")
        .groupBy("column_name", position.cast("int").alias("value"))
        .agg(F.sum("n_real").alias("n_real"), F.sum("n_synth").alias("n_synth"))
    )


def jensen_shannon(counts: DataFrame, bins: int | None = None) -> DataFrame:
    """(column_name, jsd): square root of the divergence in natural logarithms.

    ``bins`` is the number of histogram entries including empty ones, which add
    nothing to the sum but enter the normalisation; by default the entries present.
    """
    totals = side_totals(counts).join(
        counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("_present")), "column_name"
    )
    entries = F.lit(bins) if bins is not None else F.col("_present")
    norm = 1.0 + entries * EPSILON
    p = (F.try_divide("n_real", "total_real") + EPSILON) / norm
    q = (F.try_divide("n_synth", "total_synth") + EPSILON) / norm
    parts = counts.join(totals, "column_name").select("column_name", p.alias("p"), q.alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    divergence = F.sum(F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)) / 2
    return parts.groupBy("column_name").agg(
        F.sqrt(F.greatest(F.lit(0.0), divergence)).alias("jsd")
    ).where("jsd is not null")


def chi_square(counts: DataFrame, with_p: bool = True) -> DataFrame:
    """(column_name, chi2, dof, unseen_share, p_value): synthetic against scaled real counts.

    Categories the real side lacks stay out of the statistic, and their share is
    reported; columns with fewer than two categories are left out.
    """
    totals = side_totals(counts)
    joined = counts.join(totals, "column_name")
    expected = F.col("n_real") * (F.col("total_synth") / F.col("total_real"))
    gap = F.col("n_synth") - expected
    tested = (
        joined.where("total_real > 0 and total_synth > 0")
        .groupBy("column_name")
        .agg(
            F.sum(F.when(F.col("n_real") > 0, gap * gap / expected)).alias("chi2"),
            (F.count_if(F.col("n_real") > 0) - 1).alias("dof"),
            (F.sum(F.when(F.col("n_real") == 0, F.col("n_synth")).otherwise(0)) / F.max("total_synth")).alias("unseen_share"),
        )
        .where("dof >= 1")
    )
    if not with_p:
        return tested
    p = chi_square_tail(F.col("chi2"), F.col("dof").cast("double"))
    return tested.withColumn("p_value", F.when(F.col("unseen_share") > 0, F.lit(0.0)).otherwise(p))


def comparable_columns(real: DataFrame, synth: DataFrame, skip: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Columns both tables have: numeric ones, and the others."""
    theirs = {f.name: f for f in synth.schema.fields}
    numeric, other = [], []
    for f in real.schema.fields:
        if f.name in theirs and f.name not in skip:
            both = is_numeric(f.dataType) and is_numeric(theirs[f.name].dataType)
            (numeric if both else other).append(f.name)
    return numeric, other


def quality_score(counts_numeric: DataFrame | None, counts_other: DataFrame | None, real: DataFrame, synth: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """One row: mean column-shape score, mean pair-trend score, and their mean.

    Shapes are 1 - KS (numeric) and 1 - total variation (other); trends are
    1 - half the difference of the correlations of each numeric pair.
    """
    shapes = []
    if counts_numeric is not None:
        shapes.append(ks_two_sample(counts_numeric).select((1 - F.col("ks_stat")).alias("score")))
    if counts_other is not None:
        gap = F.abs(F.col("n_real") / F.col("total_real") - F.col("n_synth") / F.col("total_synth"))
        shapes.append(
            counts_other.join(side_totals(counts_other), "column_name")
            .groupBy("column_name")
            .agg((1 - F.sum(gap) / 2).alias("score"))
            .select("score")
        )
    shape = shapes[0] if len(shapes) == 1 else shapes[0].unionByName(shapes[1])
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]

    def correlations(df: DataFrame) -> Column:
        return df.agg(F.array(*[F.coalesce(F.corr(a, b), F.lit(0.0)) for a, b in pairs])).scalar()

    result = shape.agg(F.avg("score").alias("column_shapes"))
    if pairs:
        trends = F.transform(
            F.arrays_zip(F.col("_a").alias("a"), F.col("_b").alias("b")), lambda z: 1 - F.abs(z["a"] - z["b"]) / 2
        )
        result = (
            result.withColumn("_a", correlations(real))
            .withColumn("_b", correlations(synth))
            .withColumn("pair_trends", F.aggregate(trends, F.lit(0.0), lambda t, x: t + x) / len(pairs))
            .drop("_a", "_b")
        )
    else:
        result = result.withColumn("pair_trends", F.col("column_shapes"))
    return result.withColumn("quality_score", (F.col("column_shapes") + F.col("pair_trends")) / 2)
