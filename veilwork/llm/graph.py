"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.store import Workspace


def _salted_min(pairs: DataFrame, salts: int = 16) -> DataFrame:
    """Least neighbour of every node.  The two-step minimum keeps a node of very many edges from one task."""
    part = pairs.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(salts)).alias("salt")).agg(F.min("v").alias("m"))
    return part.groupBy("u").agg(F.min("m").alias("m"))


def _star(space: Workspace, edges: DataFrame, name: str, large: bool) -> DataFrame:
    """Large star: link larger neighbours to the least node seen; small star: the same for smaller neighbours."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = space.save(_salted_min(pairs).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    done = space.save(out.where("u <> v").distinct(), name)
    space.drop(f"{name}-least")
    return done


def components(edges: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """``node, component`` (its least node) for all nodes of ``edges(u, v)``; loops until nothing changes.

    The tables of a step go when the next one is written; only the last is left in ``space``.
    """
    last = f"{name}-0"
    now = space.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), last)
    before, step = None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, step = state, step + 1
        large, small = f"{name}-{step}-large", f"{name}-{step}-small"
        now = _star(space, _star(space, now, large, True), small, False)
        space.drop(last)
        space.drop(large)
        last = small
    leaves = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
