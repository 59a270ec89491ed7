"""Joins with a set of keys that drop rows without a partner before anything is shuffled.

A small key table is broadcast by Spark itself, which knows its size.  A larger one becomes a bit table with two probes,
of ``BITS_PER_KEY`` bits for a key and at most 8 MB: the wide side is filtered by it while it is scanned, so only rows
that very likely have a partner reach the exchange.  Beyond that bound the filter would let most rows pass and is left out.
The join behind it stays exact.  Both of its sides are plain exchanges, so Spark splits a key that holds a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 20  # 64-bit words: 8 MB
BITS_PER_KEY = 10
BROADCAST_KEYS = 1 << 17  # a table of so few keys is small enough for Spark to broadcast


def _probes(column: Column, words: int) -> list[Column]:
    """Bit numbers of a key: two disjoint parts of one hash, as far as the table needs no more than 32 bits."""
    h, mask = F.xxhash64(column), F.lit(words * 64 - 1)
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def bit_table(keys: DataFrame, column: str, count: int) -> tuple[Column, int] | None:
    """The bit table of ``count`` keys as one array of longs (a scalar subquery) and its size; None beyond the bound."""
    words = 1 << max(0, (count * BITS_PER_KEY // 64).bit_length())
    if words > MOST_WORDS:
        return None
    bits = keys.select(F.explode(F.array(*_probes(F.col(column), words))).alias("bit"))
    filled = bits.groupBy(F.shiftright("bit", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("word")
    )
    whole = keys.sparkSession.range(words).join(filled, "id", "left")
    placed = F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: F.coalesce(x["word"], F.lit(0).cast("long")))
    return whole.agg(placed.alias("words")).scalar(), words


def may_hold(table: tuple[Column, int], column: Column) -> Column:
    """False only for keys that are not in the table."""
    array, words = table

    def is_set(bit: Column) -> Column:
        word, place = F.get(array, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftrightunsigned", word, place).bitwiseAND(F.lit(1)) == 1

    first, second = _probes(column, words)
    return is_set(first) & is_set(second)


def prefiltered(df: DataFrame, column: Column, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without most of the rows whose ``column`` is not in ``keys[key]``, which is cheap to read again; NULLs go, too."""
    df = df.where(column.isNotNull())
    count = keys.count()
    if count <= BROADCAST_KEYS:
        return df
    table = bit_table(keys, key, count)
    return df if table is None else df.where(may_hold(table, column))


def semi_joined(df: DataFrame, column: Column, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``keys[key]``, with that column added as ``key``."""
    return prefiltered(df, column, keys, key).withColumn(key, column).join(keys, key, "left_semi")
