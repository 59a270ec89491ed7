import pytest
from pyspark.sql import functions as F

from veilwork.functions import membership as M
from veilwork.operators import defects as D
from veilwork.operators import tracing as T
from veilwork.operators.relations import Edge


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bit_table_loses_no_key_and_passes_few_others(spark, kind):
    every = spark.range(40_000).select(F.col("id").cast(kind).alias("k"))
    keys = every.where(F.col("k").cast("long") % 8 == 0)
    table = M.bit_table(keys, "k", 5_000)
    passed = every.where(M.may_hold(table, F.col("k")))
    assert passed.join(keys, "k", "left_semi").count() == 5_000
    assert passed.count() < 5_000 + 0.08 * 35_000


def test_bound_of_the_bit_table(spark):
    keys = spark.range(3).toDF("k")
    most = M.MOST_WORDS * 64 // M.BITS_PER_KEY
    assert M.bit_table(keys, "k", most // 2)[1] <= M.MOST_WORDS and M.bit_table(keys, "k", 2 * most) is None


def test_semi_join_filters_before_the_exchange(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_KEYS", 10)
    spark.range(1000).select((F.col("id") * 7 % 300).alias("v"), "id").write.parquet(f"{tmp_path}/wide")
    spark.range(0, 300, 10).toDF("key").write.parquet(f"{tmp_path}/keys")
    wide, keys = spark.read.parquet(f"{tmp_path}/wide"), spark.read.parquet(f"{tmp_path}/keys")
    got = M.semi_joined(wide, F.col("v"), keys, "key")
    assert rows(got, "id") == sorted(((i,) for i in range(1000) if i * 7 % 300 % 10 == 0), key=repr)
    assert M.semi_joined(wide.withColumn("v", F.lit(None).cast("long")), F.col("v"), keys, "key").count() == 0


def shop(spark, root, hot):
    """Orders of customers, ``hot`` of every 3 of customer 0."""
    spark.range(40).select("id", (F.col("id") % 5 - 2).alias("balance")).write.parquet(f"{root}/cust")
    orders = spark.range(30_000).select("id", F.when(F.col("id") % 3 < hot, 0).otherwise(F.col("id") % 40).alias("cust"), F.lit("x" * 20).alias("mark"))
    orders.repartition(8).write.parquet(f"{root}/ord")
    return {n.upper(): spark.read.parquet(f"{root}/{n}") for n in ("cust", "ord")}


@pytest.fixture
def scans(monkeypatch):
    """Plans of the tables written by impacts and trace."""
    plans = []

    def record(module):
        real = module.cut_lineage

        def cut(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df)

        monkeypatch.setattr(module, "cut_lineage", cut)

    record(D)
    record(T)
    return plans


EDGE = Edge("ORD", "cust", "CUST", "id")


def test_impact_reads_a_child_once(spark, tmp_path, scans):
    tables = shop(spark, tmp_path, 1)
    found = D.detect(tables, [D.non_negative("CUST", "id", "balance", "negative")])
    impact = D.impacts(found, [EDGE], tables, samples=3)
    scans.append(impact._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("ReadSchema: struct<id:bigint,cust:") for p in scans) == 1
    got = {r.parent_value: (r.row_count, len(r.rows)) for r in impact.collect()}
    brute = {}
    for i in range(30_000):
        c = 0 if i % 3 < 1 else i % 40
        brute[c] = brute.get(c, 0) + 1
    assert got == {str(c): (n, 3) for c, n in brute.items() if c % 5 - 2 < 0}
    every = D.impacts(found, [EDGE], tables, samples=None)
    assert {r.parent_value: len(r.rows) for r in every.collect()} == {k: n for k, (n, _) in got.items()}


def test_trace_reads_each_table_once_per_edge_and_step(spark, tmp_path, scans):
    tables = shop(spark, tmp_path, 1)
    roots = tables["CUST"].where("id < 3").withColumn("case_id", F.lit("c"))
    found = T.trace(tables, [EDGE], "CUST", roots.select("case_id", "id", "balance"), depth=1)
    assert sum(p.count("ReadSchema: struct<id:bigint,cust:bigint,mark") for p in scans) == 1
    links = {r.match_value: r.row_count for r in found.links.where("direction = 'downstream'").collect()}
    assert links == {"0": 10_000 + 500, "1": 500, "2": 500}


def test_a_key_with_a_third_of_the_rows_splits(spark, tmp_path):
    tables = shop(spark, tmp_path, 1)
    keys = tables["CUST"].select(F.col("id").alias("_key"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = M.semi_joined(tables["ORD"], F.col("cust"), keys, "_key").select("_key", "id")
        assert len(joined.collect()) == 30_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
