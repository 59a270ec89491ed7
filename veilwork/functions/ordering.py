"""Exact global positions without a single-partition window.

A window without ``partitionBy`` sends every row to one task.  These helpers
split the order into cells, count the cells (a small table), turn the counts
into offsets, and number the rows inside each cell only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions import draws


CELLS = 1024


def _quantiles(column: str, cells: int) -> Column:
    shares = ", ".join(f"{i / cells}D" for i in range(1, cells))
    return F.expr(f"percentile_approx(CAST(`{column}` AS DOUBLE), array({shares}), 10000)")


def _with_cell(df: DataFrame, value: Column, cells: int, name: str) -> DataFrame:
    """Number of ``_bounds`` below ``value`` by binary search; equal values share a cell.

    Each halving is a column of its own, so every step is a plain array access.
    """
    step = 1 << (cells - 1).bit_length() - 1
    found = df.withColumn("_v", value).withColumn(name, F.lit(0))
    while step:
        probe = F.get("_bounds", F.col(name) + (step - 1))
        found = found.withColumn(name, F.col(name) + F.when(probe < F.col("_v"), step).otherwise(0))
        step //= 2
    return found.withColumn(name, F.when(F.col("_v").isNull(), -1).otherwise(F.col(name))).drop("_v", "_bounds")


def null_safe_join(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``facts`` (one row per group) to every row, NULL groups included."""
    renamed = facts.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    condition = reduce(and_, [df[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return df.join(renamed, condition, "left").drop(*[f"_k_{k}" for k in keys])


def split_into_cells(
    df: DataFrame, by: str, within: Sequence[str] = (), cells: int = CELLS, name: str = "_cell"
) -> DataFrame:
    """Add the range cell of ``by`` from approximate quantiles (per ``within`` group)."""
    if cells < 2:
        return df.withColumn(name, F.lit(0))
    value = F.col(by).cast("double")
    bounds = _quantiles(by, cells)
    if within:
        per_group = df.groupBy(*within).agg(bounds.alias("_bounds"))
        return _with_cell(null_safe_join(df, per_group, within), value, cells, name)
    limits = df.agg(bounds.alias("_bounds")).scalar()
    return _with_cell(df.withColumn("_bounds", limits), value, cells, name)


def cell_offsets(
    counted: DataFrame, within: Sequence[str], order: Sequence[str], count: str, offset: str
) -> DataFrame:
    """Running total of ``count`` before each cell.  ``counted`` has one row per cell."""
    window = (
        Window.partitionBy(*[F.col(c) for c in within])
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counted.withColumn(offset, F.coalesce(F.sum(count).over(window), F.lit(0)).cast("long"))


def ordered_index(
    df: DataFrame,
    by: str,
    *,
    within: Sequence[str] = (),
    lead: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    name: str = "_index",
    start: int = 0,
    cells: int = CELLS,
    chunk: int | None = None,
) -> DataFrame:
    """Dense position of each row in the order (lead, by, tiebreak), per ``within`` group.

    ``lead`` columns must have few values.  ``by`` must be numeric and should be
    near-unique, as a key is; ``tiebreak`` only separates equal ``by`` values.
    Where ``by`` is dense from zero, as row numbers are, ``chunk`` gives the rows
    per cell and saves the quantile pass.
    """
    group = [*within, *lead]
    if chunk is None:
        celled = split_into_cells(df, by, group, cells)
    else:
        celled = df.withColumn("_cell", F.floor(F.col(by) / chunk))
    sizes = celled.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = cell_offsets(sizes, within, [*lead, "_cell"], "_n", "_offset").drop("_n")
    inside = Window.partitionBy(*group, "_cell").orderBy(by, *tiebreak)
    numbered = celled.withColumn("_inside", F.row_number().over(inside))
    return (
        null_safe_join(numbered, offsets, [*group, "_cell"])
        .withColumn(name, F.col("_inside") + F.col("_offset") + F.lit(start - 1))
        .drop("_cell", "_inside", "_offset")
    )


ROWS_PER_RANGE = 1 << 16
MOST_RANGES = 1 << 14  # bounds the splitters, which every task gets
SAMPLES_PER_RANGE = 20


def range_splitters(df: DataFrame, keys: Sequence[str], rows: int, per_range: int = ROWS_PER_RANGE) -> Column | None:
    """Sorted array of key structs that cuts ``df`` into ranges of about ``per_range`` rows; None for one range.

    Splitters come from distinct sampled keys in the keys' own types, so text, decimals and longs beyond 2**53 are
    told apart as Spark orders them.  Keys are sampled by hash: the same table gives the same splitters.
    """
    ranges = min(MOST_RANGES, -(-rows // per_range))
    if ranges < 2:
        return None
    share = min(1.0, SAMPLES_PER_RANGE * ranges / rows)
    chosen = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1 << 30)) <= int(share * (1 << 30))
    sampled = df.where(chosen).select(F.struct(*[F.col(k) for k in keys]).alias("_key")).distinct()
    ordered = sampled.agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    place = lambda i: (F.floor(i * F.size("_keys") / ranges) + 1).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.element_at("_keys", place(i)))
    return ordered.select(F.when(F.size("_keys") > 0, F.array_distinct(cuts)).otherwise(F.slice("_keys", 1, 0))).scalar()


def with_range(df: DataFrame, keys: Sequence[str], splitters: Column | None, name: str = "_range") -> DataFrame:
    """Number of splitters below each row's key, by binary search; equal keys share a range."""
    if splitters is None:
        return df.withColumn(name, F.lit(0))
    step = MOST_RANGES >> 1
    found = df.withColumn("_splitters", splitters).withColumn("_key", F.struct(*[F.col(k) for k in keys])).withColumn(name, F.lit(0))
    while step:
        probe = F.get("_splitters", F.col(name) + (step - 1))
        found = found.withColumn(name, F.col(name) + F.when(probe < F.col("_key"), step).otherwise(0))
        step //= 2
    return found.drop("_splitters", "_key")


def typed_running(
    df: DataFrame,
    order: Sequence[str],
    weight: str | None = None,
    *,
    within: Sequence[str] = (),
    name: str = "_before",
    per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Sum of ``weight`` (None: number) of the rows before each row in ``order`` per ``within`` group, any orderable keys.

    Ranges are cut over (within, order) together and follow the number of rows: a group with a third of all rows
    is cut into as many ranges as it fills, many small groups share one.  Nulls come first.  Rows equal in all
    keys are placed one behind the other.  ``df`` is read three times, so it should be a written table.
    """
    keys = [*within, *order]
    rows = df.count()
    own = F.lit(1).cast("long") if weight is None else F.col(weight)
    ranged = with_range(df, keys, range_splitters(df, keys, rows, per_range)).withColumn("_weight", own)
    sizes = ranged.groupBy(*within, "_range").agg(F.sum("_weight").alias("_n"))
    offsets = cell_offsets(sizes, within, ["_range"], "_n", "_offset").drop("_n")
    inside = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_upto", F.sum("_weight").over(inside))
    return (
        null_safe_join(summed, offsets, [*within, "_range"])
        .withColumn(name, F.col("_upto") - F.col("_weight") + F.col("_offset"))
        .drop("_range", "_upto", "_weight", "_offset")
    )


def typed_index(df: DataFrame, order: Sequence[str], *, within: Sequence[str] = (), name: str = "_index", start: int = 0, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Dense position of each row in ``order`` per ``within`` group, see ``typed_running``."""
    placed = typed_running(df, order, within=within, name=name, per_range=per_range)
    return placed.withColumn(name, F.col(name) + F.lit(start)) if start else placed


def shuffled_index(
    df: DataFrame, key: Sequence[str], seed, name: str = "_index", cells_log2: int = 16
) -> DataFrame:
    """Dense 0-based position in a reproducible random order of a unique ``key``.

    Random order spreads evenly over cells, so no quantile pass is needed.
    """
    shift = draws.ORDER_KEY_BITS - cells_log2
    keyed = df.withColumn("_draw", draws.order_key(seed, *[F.col(k) for k in key])).withColumn(
        "_cell", F.shiftright("_draw", shift)
    )
    sizes = keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = cell_offsets(sizes, [], ["_cell"], "_n", "_offset").drop("_n")
    inside = Window.partitionBy("_cell").orderBy("_draw", *key)
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, "_cell")
        .withColumn(name, F.col("_inside") + F.col("_offset") - 1)
        .drop("_draw", "_cell", "_inside", "_offset")
    )


def exact_share(
    df: DataFrame, key: str, share: float | None, seed, *, rows: int | None = None, cells_log2: int = 16
) -> Column:
    """Condition that is true for exactly max(1, floor(n * share)) rows (or ``rows`` rows).

    Finds the cut-off draw with two small aggregates, so marking the chosen rows
    is a plain filter: the wide rows are neither sorted nor shuffled.
    """
    draw = draws.order_key(seed, F.col(key))
    shift = draws.ORDER_KEY_BITS - cells_log2
    keyed = df.select(draw.alias("_draw"), F.col(key).alias("_key")).withColumn(
        "_cell", F.shiftright("_draw", shift)
    )
    sizes = keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    running = cell_offsets(sizes, [], ["_cell"], "_n", "_before")
    n = F.sum("_n").over(Window.partitionBy())
    wanted = F.lit(rows) if rows is not None else F.greatest(F.lit(1), F.floor(n * F.lit(share)))
    cut = (
        running.withColumn("_want", wanted)
        .where((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_n")))
        .select("_cell", (F.col("_want") - F.col("_before")).alias("_need"))
    )
    last = (
        keyed.join(F.broadcast(cut), "_cell")  # one row at most
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_draw", "_key")))
        .where(F.col("_rank") == F.col("_need"))
        .agg(F.max(F.struct("_draw", "_key")))
        .scalar()
    )
    # fewer rows than asked for: no cut-off exists and every row is chosen
    return F.coalesce(F.struct(draw.alias("_draw"), F.col(key).alias("_key")) <= last, F.lit(True))
