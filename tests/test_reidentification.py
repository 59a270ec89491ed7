import random

import pytest
from pyspark.sql import functions as F

from veilwork.operators import reidentification as RI


def brute(real, synth, threshold):
    k, found = len(real[0]), {}
    for s in synth:
        best = max(sum(a == b for a, b in zip(s, r, strict=True)) for r in real)
        if best / k > threshold:
            found[s] = best
    return sorted(found.values())


@pytest.mark.parametrize("k,threshold,kinds,block", [(6, 0.6, 4, 256), (6, 0.6, 4, 3), (8, 0.7, 3, 2), (10, 0.85, 5, 4), (12, 0.7, 3, 5)])
def test_equals_brute_force(spark, k, threshold, kinds, block):
    """Columns of few values, so that blocks are crowded and are dealt again; NULLs are equal to each other."""
    rng = random.Random(k + block)
    row = lambda: tuple(rng.choice([None, *range(kinds)]) if j % 2 else rng.randrange(2 + kinds * (j // 3)) for j in range(k))
    real = list({row() for _ in range(150)})
    synth = [tuple(v if rng.random() > 0.2 else -1 for v in rng.choice(real)) if rng.random() < 0.6 else row() for _ in range(120)]
    columns = [f"c{j}" for j in range(k)]
    schema = ", ".join(f"{c} int" for c in columns)
    made = RI.reid_risk(spark.createDataFrame(real, schema), spark.createDataFrame(synth + synth[:9], schema), columns, threshold, block)
    got = made.collect()
    assert sorted(r.matches for r in got) == brute(real, synth, threshold)
    assert {r.copies for r in got} <= {1, 2, 3, 4} and all(r.similarity > threshold for r in got)


def test_keys_are_linear_in_the_columns(spark):
    for k in (10, 20, 30):
        spare = k - int(0.85 * k) - 1
        steps = RI._refined([()], range(k), spare + 1)
        assert len(steps[()]) == spare + 1 <= k and sorted(j for q in steps[()] for j in q) == list(range(k))


def test_a_common_value_makes_no_pairs(spark):
    """One column with one value on both sides: its block is dealt again instead of compared."""
    df = spark.range(3000).select(F.lit("x").alias("a"), F.col("id").alias("b"), (F.col("id") * 7).alias("c"), (F.col("id") + 1).alias("d"))
    other = df.withColumn("b", -1 - F.col("b"))
    assert RI.reid_risk(df, other, ["a", "b", "c", "d"], 0.7, 50).agg(F.count("*"), F.max("matches")).first()[:] == (3000, 3)


def test_keys_of_many_records_are_not_broadcast(spark):
    """Six keys a record: Spark's estimate of the table counts one, so it sent all of them to the driver and every executor."""
    n, columns = 40_000, ["id", "c1", "c2", "c3", "c4"]
    real = spark.range(n).select("id", *[(F.col("id") * k).alias(f"c{k}") for k in range(1, 5)])
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256k")
    try:
        found = RI.reid_risk(real, real.withColumn("id", -1 - F.col("id")), columns, 0.6)
        assert found.agg(F.count("*"), F.count_distinct("record"), F.min("matches"), F.max("matches")).first()[:] == (n, n, 4, 4)
        assert found.where(~F.col("record").rlike("^[0-9a-f]{32}$")).isEmpty()
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)


def test_no_records(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert RI.reid_risk(df.limit(0), df, ["a", "b"], 0.4).count() == 0 and RI.reid_risk(df, df.limit(0), ["a", "b"], 0.4).count() == 0
    with pytest.raises(ValueError):
        RI.reid_risk(df, df, ["a", "b"], 1.0)
