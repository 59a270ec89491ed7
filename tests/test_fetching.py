import random

from pyspark.sql import functions as F

from veilwork.functions import draws
from veilwork.operators import fetching as G
from veilwork.operators import repair as R
from veilwork.operators import synthesis as S
from veilwork.operators.relations import Edge


def table(spark, n=300):
    return spark.range(n).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), "id")).alias("v"), F.concat(F.lit("w"), "id").alias("w"))


def test_positions_are_dense_in_every_order(spark):
    index = G.positional_index(table(spark), ["g", "id"], "s", ["v"])
    got = {(r._which, r._pos): r._key.id for r in index.collect()}
    assert sorted(got) == [(0, i) for i in range(300)] + [(1, i) for i in range(200)]
    whole = [got[0, i] for i in range(300)]
    assert [got[1, i] for i in range(200)] == [i for i in whole if i % 3 > 0]  # the same order, only rows with a value


def test_all_draws_of_a_row_arrive(spark):
    rid = F.col("_rid")
    rows = spark.range(500).toDF("_rid")
    wanted = [
        G.Draw(draws.pick(300, 1, "a", rid), ("g", "w")),
        G.Draw(draws.pick(200, 1, "b", rid), ("v",), "v"),
        G.Draw(F.when(rid % 2 == 0, draws.pick(300, 1, "c", rid)), ("id",)),
    ]
    got = G.fetch(rows, table(spark), ["id"], "s", wanted).collect()
    assert len(got) == 500 and all(int(r.w[1:]) % 7 == r.g and r.v is not None and (r.id is None) == (r._rid % 2 == 1) for r in got)
    assert len({r.w for r in got}) > 200


def test_the_source_is_shuffled_once(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/t")
    source = spark.read.parquet(f"{tmp_path}/t").withColumn("id", F.col("id"))
    rid = F.col("_rid")
    wanted = [G.Draw(draws.pick(300, 1, c, rid), (c,)) for c in ("g", "v", "w")]
    made = spark.range(50).toDF("_rid").join(G.fetch(spark.range(50).toDF("_rid"), source, ["id"], "s", wanted), "_rid", "left")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("w#") and sum("ReadSchema" in x and ":string" in x for x in plan.splitlines()) == 1


def test_positions_beyond_32_bits(spark):
    size = 1 << 40
    got = [r[0] for r in spark.range(2000).select(draws.pick(size, "s", F.col("id"))).collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) and max(got) < size
    assert sum(v > 1 << 32 for v in got) > 1900 and sum(v % 2 for v in got) in range(850, 1150)
    assert spark.range(1).select(draws.pick(0, "s", F.col("id"))).first()[0] is None


def test_keys_of_several_columns_come_from_one_parent(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(80)})
    parent = spark.createDataFrame([(a, b, f"p{a}-{b}") for a, b in pairs] + [(None, 3, "x")], "a int, b int, name string")
    child = spark.range(400).select(
        F.col("id").alias("_rid"), F.when(F.col("id") % 5 > 0, 999).alias("pa"), F.when(F.col("id") % 5 > 0, 998).alias("pb"),
        F.lit("bill").alias("bill"), F.when(F.col("id") % 2 == 0, "ship").alias("ship"),
    )
    other = spark.createDataFrame([(f"n{i}",) for i in range(20)], "name string")
    edges = [Edge("C", "pa", "P", "a"), Edge("C", "pb", "P", "b"), Edge("C", "bill", "N", "name"), Edge("C", "ship", "N", "name")]
    rows = R.stitch_foreign_keys("C", child, edges, {"P": parent, "N": other}).collect()
    assert len(rows) == 400
    assert {(r.pa, r.pb) for r in rows if r.pa is not None} <= set(pairs) and sum(r.pa is None for r in rows) == 80
    assert all((r.pa is None) == (r.pb is None) for r in rows) and len({(r.pa, r.pb) for r in rows}) > 60
    assert sum(r.bill != r.ship for r in rows if r.ship) > 150  # two keys to one parent column are drawn apart
    assert R.stitch_foreign_keys("C", child, edges, {"N": other.limit(0)}).where("bill is not null").count() == 0


def test_junction_draws_other_columns(spark):
    real = spark.createDataFrame([(p, s, f"r{p}", p * s, k) for k, (p, s) in enumerate((p, s) for p in range(20) for s in range(3))], "p int, s int, note string, amt int, id int")
    out = S.junction(spark.range(30).toDF("pid"), "pid", spark.range(7).toDF("sid"), "sid", real, "p", "s", others=["note", "amt"], real_key=["id"])
    rows = out.collect()
    assert len(rows) >= 30 and all(r.note is not None and r.amt is not None for r in rows) and len({r.note for r in rows}) > 8


def test_weighted_draws_of_any_number_of_categories(spark):
    """Ten and ten thousand categories, one with a third of the weight, in cells of few rows: the running total decides."""
    weights = {"few": {f"v{i}": i + 1 for i in range(10)}, "many": {f"k{i:05d}": 1 + i % 3 for i in range(10_000)} | {"heavy": 9_000}}
    counts = [(c, v, n) for c, w in weights.items() for v, n in w.items()]
    total = {c: sum(w.values()) for c, w in weights.items()}
    rid = F.col("_rid")
    wanted = {c: draws.pick(total[c], 7, c, rid) for c in weights}
    rows = spark.range(3000).toDF("_rid")
    got = G.fetch_weighted(rows, spark.createDataFrame(counts, "column_name string, value string, frequency long"), wanted, 3000, cell_rows=64)
    drawn = {r._rid: r for r in rows.select("_rid", *[d.alias(c) for c, d in wanted.items()]).collect()}
    found = got.collect()
    assert len(found) == 3000
    for c, w in weights.items():
        ends, at = [], 0
        for v in sorted(w):
            at += w[v]
            ends.append((at, v))
        for r in found:
            assert r[c] == next(v for upto, v in ends if drawn[r._rid][c] < upto)
