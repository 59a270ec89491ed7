"""Synthetic records that agree with some real record on more than a share of their columns.

Two records of k columns that agree on at least m of them differ on at most k - m, so of k - m + 1 groups of columns
one agrees as a whole.  Each record yields one key per group, and only records with an equal key are compared: rows are
linear in the number of columns.  A group that many real records share is no block to compare within: its records are
dealt again by k - m + 1 groups of the columns that are left, until every record meets at most ``block`` real ones.
Where no more than k - m columns are left, all records of a block are risky already, and keys of the subsets of those
few columns tell how much more they share.  Exact for every record above the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.operators.profile import as_text, fields_of
from veilwork.session import cut_lineage
from veilwork.sources.tables import union_all

Pattern = tuple[int, ...]  # columns that the records of a block share, ascending


def text_columns(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    by_name = {f.name: f for f in fields_of(df, columns)}
    return [F.coalesce(as_text(by_name[c]), F.lit("None")) for c in columns]


def _records(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct records as arrays of text, with the number of their copies."""
    whole = df.select(F.array(*text_columns(df, columns)).alias("v"))
    return whole.groupBy("v").agg(F.count(F.lit(1)).alias("copies")).withColumn("record", F.md5(F.to_json("v")))


def _key(pattern: Pattern) -> Column:
    return F.md5(F.to_json(F.array(*[F.get("v", F.lit(j)) for j in pattern])))


def _subset_key(subset: Pattern) -> Column:
    return F.unhex(F.md5(F.to_json(F.array(F.lit(_name(subset)), *[F.get("v", F.lit(j)) for j in subset]))))


def _name(pattern: Pattern) -> str:
    return ",".join(map(str, pattern))


def _refined(patterns: Sequence[Pattern], order: Sequence[int], groups: int) -> dict[Pattern, list[Pattern]]:
    """For each pattern, the patterns with one more group; columns are dealt so that every group has a telling one."""
    found = {}
    for p in patterns:
        left = [j for j in order if j not in p]
        found[p] = [tuple(sorted((*p, *left[g::groups]))) for g in range(groups)]
    return found


def _dealt(rows: DataFrame, steps: dict[Pattern, list[Pattern]], keep: Sequence[str]) -> DataFrame:
    """Each row once per pattern that follows its own."""
    blocks = None
    for p, following in steps.items():
        keys = F.array(*[F.struct(F.lit(_name(q)).alias("pattern"), _key(q).alias("key")) for q in following])
        here = F.when(F.col("pattern") == _name(p), keys)
        blocks = here if blocks is None else F.coalesce(blocks, here)
    dealt = rows.select(*keep, F.explode(blocks).alias("_b")).select(*keep, "_b.*")
    every = [q for following in steps.values() for q in following]
    return dealt if len(every) == len(set(every)) else dealt.distinct()


def _agreement(columns: int) -> Column:
    return sum((F.when(F.get("v", F.lit(j)) == F.get("w", F.lit(j)), 1).otherwise(0) for j in range(columns)), F.lit(0))


def reid_risk(real: DataFrame, synth: DataFrame, columns: Sequence[str], threshold: float = 0.85, block: int = 256) -> DataFrame:
    """(record, copies, matches, similarity): synthetic records closer to a real one than the threshold.

    ``matches`` is the most columns that any real record shares.  NULLs count as equal.
    """
    k = len(columns)
    need = floor(threshold * k + 1e-9) + 1
    if need > k:
        raise ValueError("no share of equal columns can exceed the threshold")
    spare = k - need
    if spare < 2:
        # the subsets are k + 1 at most: their keys need no comparison at all
        ours, theirs = (_records(df, columns).withColumn("pattern", F.lit("")) for df in (synth, real))
        best = _by_subsets(ours, theirs, [()], k, need)
        return best.withColumn("similarity", F.col("matches") / F.lit(k))
    kinds = real.agg(*[F.approx_count_distinct(c).alias(f"c{j}") for j, c in enumerate(text_columns(real, columns))]).first()
    order = sorted(range(k), key=lambda j: -kinds[f"c{j}"])
    ours, theirs = (_records(df, columns).withColumn("pattern", F.lit("")) for df in (synth, real))
    patterns: list[Pattern] = [()]
    found = []
    while patterns:
        steps = _refined(patterns, order, spare + 1)
        patterns = sorted({q for following in steps.values() for q in following})
        ours = cut_lineage(_dealt(ours, steps, ["record", "copies", "v"]))
        theirs = cut_lineage(_dealt(theirs, steps, ["v"]))
        sizes = theirs.groupBy("pattern", "key").agg(F.count(F.lit(1)).alias("n"))
        crowded = cut_lineage(sizes.where(F.col("n") > block).select("pattern", "key"))
        if crowded.isEmpty():
            few, patterns = theirs, []
        else:
            few = theirs.join(crowded, ["pattern", "key"], "left_anti")
        pairs = ours.join(few.withColumnRenamed("v", "w"), ["pattern", "key"])
        close = pairs.select("record", "copies", _agreement(k).alias("matches")).where(F.col("matches") >= need)
        found.append(close.groupBy("record", "copies").agg(F.max("matches").alias("matches")))
        if patterns:
            ours, theirs = (x.join(crowded, ["pattern", "key"], "left_semi") for x in (ours, theirs))
            last = [p for p in patterns if k - len(p) <= spare]
            if last:
                found.append(_by_subsets(ours, theirs, last, k, need))
            patterns = [p for p in patterns if p not in last]
            ours, theirs = (x.where(F.col("pattern").isin([_name(p) for p in patterns])) for x in (ours, theirs))
    best = union_all(found).groupBy("record", "copies").agg(F.max("matches").alias("matches"))
    return best.withColumn("similarity", F.col("matches") / F.lit(k))


def _by_subsets(ours: DataFrame, theirs: DataFrame, patterns: Sequence[Pattern], columns: int, need: int) -> DataFrame:
    """The most that records of crowded blocks share, ``need`` at least, by keys of subsets of the columns left.

    A key is 16 bytes and holds its subset.  The join is a merge join by hint: Spark's estimate of a side takes no notice
    of the keys per record, so it would broadcast many times the size that it allows.
    """

    def keyed(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        parts = []
        for p in patterns:
            left = [j for j in range(columns) if j not in p]
            sizes = range(max(0, need - len(p)), len(left) + 1)
            sets = [tuple(sorted((*p, *s))) for size in sizes for s in combinations(left, size)]
            keys = F.array(*[F.struct(F.lit(len(s)).alias("matches"), _subset_key(s).alias("key")) for s in sets])
            parts.append(df.where(F.col("pattern") == _name(p)).select(*keep, F.explode(keys).alias("_k")).select(*keep, "_k.*"))
        return union_all(parts)

    known = keyed(theirs, []).select("key").distinct()
    short = ours.withColumn("record", F.unhex("record"))
    met = keyed(short, ["record", "copies"]).join(known.hint("merge"), "key", "left_semi")
    best = met.groupBy("record", "copies").agg(F.max("matches").alias("matches"))
    return best.withColumn("record", F.lower(F.hex("record")))
