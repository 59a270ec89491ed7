"""Rows drawn from a source by position, for any number of columns at once.

Every drawn column is a request (output row, position), and all requests of a table go through three steps together:

1. requests meet the positional index, a narrow table of positions and keys in a keyed random order;
2. what they found, still only keys, meets the source, which is shuffled once however many columns are drawn;
3. the values meet again by output row, one row of values per output row.

Wide output rows take part in none of it; the caller joins the values to them once.  Positions are uniform, so no
key is hot.  A NULL position asks for nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions import draws
from veilwork.functions.ordering import cell_offsets, typed_running
from veilwork.session import cut_lineage

RID = "_rid"
CELL_BITS = 16


@dataclass(frozen=True)
class Draw:
    """Columns that an output row takes from the source row at ``position`` (0-based; among rows with a ``present`` value)."""

    position: Column
    columns: tuple[str, ...]
    present: str | None = None


def positional_index(source: DataFrame, key: Sequence[str], seed, present: Sequence[str] = (), carried: Sequence[str] = ()) -> DataFrame:
    """``_which, _pos, _key``: each row's position in the keyed random order, and among rows with a value in a column.

    ``_which`` is 0 for the order of all rows and 1, 2, ... for those of ``present``.  ``key`` must be unique.
    ``carried`` columns come along as ``_v_`` and their name.
    """
    flags = [f"_f{i}" for i in range(1, len(present) + 1)]
    drawn = draws.order_key(seed, *[F.col(k) for k in key])
    keyed = source.select(
        F.struct(*[F.col(k) for k in key]).alias("_key"),
        drawn.alias("_draw"),
        F.lit(1).alias("_f0"),
        *[F.col(c).alias(f"_v_{c}") for c in carried],
        *[F.col(c).isNotNull().cast("int").alias(f) for c, f in zip(present, flags, strict=True)],
    ).withColumn("_cell", F.shiftright("_draw", draws.ORDER_KEY_BITS - CELL_BITS))
    orders = ["_f0", *flags]
    sizes = keyed.groupBy("_cell").agg(*[F.sum(f).alias(f) for f in orders])
    for f in orders:
        sizes = cell_offsets(sizes, [], ["_cell"], f, f"_o{f}")
    here = Window.partitionBy("_cell").orderBy("_draw", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.select("*", *[F.sum(f).over(here).alias(f"_i{f}") for f in orders]).join(sizes.select("_cell", *[f"_o{f}" for f in orders]), "_cell")
    entries = [
        F.when(F.col(f) == 1, F.struct(F.lit(i).alias("_which"), (F.col(f"_i{f}") + F.col(f"_o{f}") - 1).alias("_pos")))
        for i, f in enumerate(orders)
    ]
    kept = ["_key", *[f"_v_{c}" for c in carried]]
    return placed.select(*kept, F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("_e")).select("_e.*", *kept)


def fetch(rows: DataFrame, source: DataFrame, key: Sequence[str], seed, wanted: Sequence[Draw]) -> DataFrame:
    """``_rid`` and the drawn columns, for the rows that any of ``wanted`` gives something.

    A single draw's columns travel in the index itself, which saves the join with the source.
    """
    present = list(dict.fromkeys(d.present for d in wanted if d.present))
    which = {None: 0, **{c: i for i, c in enumerate(present, 1)}}
    asked = [
        F.when(
            d.position.isNotNull(),
            F.struct(F.lit(i).alias("_slot"), F.lit(which[d.present]).alias("_which"), d.position.cast("long").alias("_pos")),
        )
        for i, d in enumerate(wanted)
    ]
    requests = rows.select(RID, F.explode(F.array(*asked)).alias("_a")).where("_a is not null").select(RID, "_a.*")
    if len(wanted) == 1:
        index = positional_index(source, key, seed, present, wanted[0].columns)
        found = requests.join(index.where(F.col("_which") == max(which.values())), ["_which", "_pos"])
        return found.select(RID, *[F.col(f"_v_{c}").alias(c) for c in wanted[0].columns])
    located = requests.join(positional_index(source, key, seed, present), ["_which", "_pos"]).select(RID, "_slot", "_key")
    needed = list(dict.fromkeys(c for d in wanted for c in d.columns))
    values = located.join(source.select(F.struct(*[F.col(k) for k in key]).alias("_key"), *[F.col(c).alias(f"_v_{c}") for c in needed]), "_key")
    taken = [
        F.any_value(F.when(F.col("_slot") == i, F.struct(*[F.col(f"_v_{c}").alias(c) for c in d.columns])), True).alias(f"_s{i}")
        for i, d in enumerate(wanted)
    ]
    return values.groupBy(RID).agg(*taken).select(RID, *[F.col(f"_s{i}.`{c}`").alias(c) for i, d in enumerate(wanted) for c in d.columns])


CELL_ROWS = 1 << 16  # draws and categories that meet in one cell, about


def fetch_weighted(rows: DataFrame, counts: DataFrame, wanted: dict[str, Column], count: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``_rid`` and, per column of ``wanted``, the category whose share of the running total holds the draw.

    ``counts(column_name, value, frequency)`` may have any number of categories; ``wanted`` gives each column a draw from
    [0, its total) for the ``count`` rows.  Draws and the categories' lower ends meet in cells of the running total, in
    which the last category before a draw is found in one ordered pass.  A category that holds a third of the total
    begins anew in every cell it spans, and no cell holds more than its width of categories.
    """
    running = cut_lineage(typed_running(cut_lineage(counts.select("column_name", "value", "frequency")), ["value"], "frequency", within=["column_name"], name="lower"))
    facts = running.groupBy("column_name").agg(F.sum("frequency").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()  # a row per column
    width = {r["column_name"]: max(1, -(-r["total"] * cell_rows // (count + r["kinds"]))) for r in facts}
    span = F.element_at(F.create_map(*[F.lit(x) for c in width.items() for x in c]), F.col("column_name"))
    first, last = F.floor(F.col("lower") / F.col("span")), F.floor((F.col("lower") + F.col("frequency") - 1) / F.col("span"))
    ends = (
        running.withColumn("span", span.cast("long"))
        .select("column_name", "value", "lower", "span", F.explode(F.sequence(first, last)).alias("cell"))
        .select("column_name", "cell", F.greatest("lower", F.col("cell") * F.col("span")).alias("at"), F.lit(0).alias("kind"), "value", F.lit(None).cast("long").alias(RID))
    )
    drawn = F.array(*[F.struct(F.lit(c).alias("column_name"), d.cast("long").alias("at"), F.lit(width[c]).cast("long").alias("span")) for c, d in wanted.items() if c in width])
    asked = (
        rows.select(RID, F.explode(drawn).alias("_d"))
        .select(RID, "_d.*")
        .where("at is not null")
        .select("column_name", F.floor(F.col("at") / F.col("span")).alias("cell"), "at", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("value"), RID)
    )
    before = Window.partitionBy("column_name", "cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ends.unionByName(asked).withColumn("value", F.last("value", True).over(before)).where("kind = 1")
    return met.groupBy(RID).agg(*[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(c) for c in wanted])
