import decimal
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.functions import draws, names, ordering, tails


def numbers(spark, n, partitions):
    values = list(range(n))
    random.Random(1).shuffle(values)
    return spark.createDataFrame([(v, v % 3) for v in values], "id long, g int").repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 8])
def test_ordered_index_is_the_row_number(spark, rows, partitions):
    df = ordering.ordered_index(numbers(spark, 500, partitions), "id", name="i", cells=7)
    assert rows(df, "id", "i") == sorted(((v, v) for v in range(500)), key=repr)


def test_ordered_index_runs_over_lead_columns_within_groups(spark, rows):
    df = spark.createDataFrame([(g, r, k) for g in "ab" for r in (0, 1) for k in range(20)], "g string, r int, k int")
    got = ordering.ordered_index(df, "k", within=["g"], lead=["r"], name="i", start=1, cells=4)
    assert rows(got, "g", "i", "r", "k") == sorted(
        ((g, r * 20 + k + 1, r, k) for g in "ab" for r in (0, 1) for k in range(20)), key=repr
    )


def test_ordered_index_with_chunks_nulls_and_one_row(spark, rows):
    df = numbers(spark, 100, 3)
    assert rows(ordering.ordered_index(df, "id", name="i", chunk=16), "id", "i") == sorted(((v, v) for v in range(100)), key=repr)
    one = spark.createDataFrame([(5.0,), (None,)], "v double")
    assert rows(ordering.ordered_index(one, "v", name="i"), "v", "i") == sorted([(None, 0), (5.0, 1)], key=repr)


def test_null_groups_keep_their_rows(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "g string, v int")
    assert rows(ordering.ordered_index(df, "v", within=["g"], name="i", cells=2), "g", "v", "i") == sorted([(None, 1, 0), (None, 2, 1), ("a", 5, 0)], key=repr)


def test_hot_values_share_a_cell_and_keep_a_dense_index(spark):
    df = spark.createDataFrame([(0, i) for i in range(300)] + [(i, i) for i in range(1, 50)], "v int, k int")
    got = ordering.ordered_index(df, "v", tiebreak=["k"], name="i", cells=8)
    assert sorted(r.i for r in got.collect()) == list(range(349))


def test_shuffled_index_does_not_depend_on_partitions(spark, rows):
    one = ordering.shuffled_index(numbers(spark, 300, 1), ["id"], "s", "i", cells_log2=3)
    eight = ordering.shuffled_index(numbers(spark, 300, 8), ["id"], "s", "i", cells_log2=3)
    assert rows(one, "id", "i") == rows(eight, "id", "i")
    assert sorted(r.i for r in one.collect()) == list(range(300))


@pytest.mark.parametrize("share,expected", [(0.05, 15), (0.0001, 1), (1.0, 300)])
def test_exact_share(spark, share, expected):
    for partitions in (1, 8):
        df = numbers(spark, 300, partitions)
        assert df.where(ordering.exact_share(df, "id", share, "s")).count() == expected


def test_exact_rows_beyond_the_table_takes_all(spark):
    df = numbers(spark, 20, 2)
    assert df.where(ordering.exact_share(df, "id", None, "s", rows=7)).count() == 7
    assert df.where(ordering.exact_share(df, "id", None, "s", rows=70)).count() == 20


def test_draws_are_uniform_and_normal(spark):
    df = spark.range(20000).select(draws.uniform("a", F.col("id")).alias("u"), draws.normal("b", F.col("id")).alias("z"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] and r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.02


@pytest.mark.parametrize("x,dof,p", [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (0.0, 3, 1.0), (124.342113, 100, 0.05), (2.705543, 1, 0.1)])
def test_chi_square_tail(x, dof, p):
    assert tails.chi_square_tail_value(x, dof) == pytest.approx(p, abs=1e-6)


def test_kolmogorov_tail(spark):
    df = spark.createDataFrame([(1.358099,), (1.627624,), (0.01,), (5.0,)], "x double")
    got = [r[0] for r in df.select(tails.kolmogorov_tail(F.col("x"))).collect()]
    assert np.allclose(got, [0.05, 0.01, 1.0, 0.0], atol=1e-5)


def test_expand_abbreviations(spark, rows):
    df = spark.createDataFrame([("CUST_TEN_MNT",), ("cust_foo",), ("CUST_TEN_MNT",)], "name string")
    got = names.expand_abbreviations(df, "name", names.abbreviation_table(spark, {"xyz": "Other"}))
    assert rows(got, "name", "expanded", "fully_resolved") == sorted(
        [("CUST_TEN_MNT", "Customer Tenure Month", True)] * 2 + [("cust_foo", "Customer FOO", False)], key=repr
    )


def test_candidate_id_columns():
    assert names.candidate_id_columns(["ORD_ID", "ORD_REF", "INVC_NO_TXT", "AMT"], ["ORD_ID"]) == ["ORD_ID", "ORD_REF", "INVC_NO_TXT"]
    assert names.candidate_id_columns(["A_ID", "X"]) == ["A_ID"]
    assert names.candidate_id_columns(["X", "Y"]) == ["X"]


def test_traceable_tables(spark):
    df = spark.createDataFrame([], "A_ID int")
    assert [t for t, _ in names.traceable_tables({"ZED": df, "SVC_ORD": df, "_LOG": df, "CUST": df})] == ["SVC_ORD", "CUST", "ZED"]


@pytest.mark.parametrize("kind", ["text", "long", "decimal", "two"])
def test_typed_index_orders_by_the_keys_own_type(spark, kind):
    """Keys with one prefix, keys above 2**53, decimals; nulls first; ranges follow the rows."""
    made = {
        "text": [f"CUSTOMER-{i:06d}" for i in range(1000)],
        "long": [(1 << 60) + i for i in range(1000)],
        "decimal": [decimal.Decimal(f"1234567890123456789.{i:04d}") for i in range(1000)],
        "two": [f"k{i // 500}" for i in range(1000)],
    }[kind]
    kinds = {"text": "string", "long": "long", "decimal": "decimal(38,4)", "two": "string"}[kind]
    data = [("g" if i % 3 else None, k, i) for i, k in enumerate([*made, None])]
    df = spark.createDataFrame(data, f"g string, k {kinds}, i long").repartition(4)
    got = ordering.typed_index(df, ["k", "i"], within=["g"], name="at", per_range=50)
    want = {}
    for g in ("g", None):
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]) if x[1] is not None else (False, 0, x[2]))
        want.update({x[2]: at for at, x in enumerate(own)})
    assert {r.i: r.at for r in got.collect()} == want


def test_ranges_are_many_and_even(spark):
    df = spark.createDataFrame([(f"CUSTOMER-{i:06d}",) for i in range(20_000)], "k string")
    cells = ordering.with_range(df, ["k"], ordering.range_splitters(df, ["k"], 20_000, per_range=200))
    sizes = [r["count"] for r in cells.groupBy("_range").count().collect()]
    assert len(sizes) == 100 and max(sizes) < 600
