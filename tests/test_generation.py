import datetime

import pytest
from pyspark.sql import functions as F

from veilwork.operators import dedup as DD
from veilwork.operators import edge_cases as E
from veilwork.operators import repair as R
from veilwork.operators import synthesis as S
from veilwork.operators.copula import copula_synthesize
from veilwork.operators.policies import ColumnPolicy, Strategy
from veilwork.operators.relations import Edge


def source(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("ROW_ID"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("AB-"), F.lpad(F.col("id").cast("string"), 3, "0"))).alias("DOC_UUID"),
        F.expr("date_add(DATE'2020-01-01', cast(id as int))").alias("STRT_DT"),
        F.expr("date_add(DATE'2020-01-05', cast(id as int))").alias("END_DT"),
        F.when(F.col("id") % 10 < 7, "A").otherwise("B").alias("STAT_CD"),
        (F.col("id") % 97 + 0.5).alias("AMT"),
        (F.col("id") % 97).cast("int").alias("QTY"),
        F.lit(None).cast("string").alias("EMPTY"),
        F.concat(F.lit("note "), "id").alias("NOTE"),
        F.when(F.col("id") % 2 == 0, (F.col("id") % 80).cast("string")).alias("TXT_NUM"),
    )


STRUCTURAL = ["ROW_ID", "DOC_UUID", "STRT_DT", "END_DT", "STAT_CD"]


def make(spark, n=None, partitions=4):
    return S.synthesize(source(spark).repartition(partitions, "ROW_ID"), STRUCTURAL, [], ["ROW_ID"], n)


def test_synthesize_keeps_schema_rates_and_date_order(spark):
    made = make(spark)
    assert [f.dataType for f in made.drop("_rid").schema.fields] == [f.dataType for f in source(spark).schema.fields]
    rows = made.orderBy("_rid").collect()
    assert len(rows) == 400 and [r.ROW_ID for r in rows] == list(range(1, 401))
    assert all((r.END_DT - r.STRT_DT).days == 4 for r in rows)
    assert 0.15 < sum(r.DOC_UUID is None for r in rows) / 400 < 0.35
    assert all(r.DOC_UUID is None or r.DOC_UUID == f"AB-{r._rid + 1:03d}" for r in rows)
    assert 0.6 < sum(r.STAT_CD == "A" for r in rows) / 400 < 0.8
    assert all(0.5 <= r.AMT <= 96.5 and 0 <= r.QTY <= 96 and r.EMPTY is None for r in rows)
    assert {r.NOTE for r in rows} <= {f"note {i}" for i in range(400)} and len({r.NOTE for r in rows}) > 200
    assert 0.4 < sum(r.TXT_NUM is None for r in rows) / 400 < 0.6 and all(r.TXT_NUM is None or float(r.TXT_NUM) <= 79 for r in rows)


def test_synthesis_does_not_depend_on_partitions(spark, rows):
    assert rows(make(spark, 50, 1)) == rows(make(spark, 50, 8))


def test_synthesize_other_sizes(spark):
    assert make(spark, 1000).count() == 1000
    assert make(spark, 0).count() == 0


def test_bounds_and_allowed_values(spark):
    policies = [ColumnPolicy("T", "AMT", min_value=10.0, max_value=20.0), ColumnPolicy("T", "NOTE", allowed_values=["x", "y"])]
    got = S.synthesize(source(spark), STRUCTURAL, policies, ["ROW_ID"]).agg(F.min("AMT"), F.max("AMT"), F.collect_set("NOTE")).first()
    assert got[0] >= 10 and got[1] <= 20 and sorted(got[2]) == ["x", "y"]


def test_numbered_text(spark):
    df = spark.createDataFrame([("AB-007x", 12345), ("AB-007x", 3), ("no digits!", 9), ("5", 123456)], "e string, n long")
    got = [r[0] for r in df.select(S.numbered_text(F.col("e"), F.col("n"))).collect()]
    assert got == ["AB-12345x", "AB-003x", "no digits!_00009", "123456"]


def test_junction_links_are_distinct_and_within_bounds(spark):
    real = spark.createDataFrame([(p, s) for p in range(20) for s in range(1 + p % 4)], "p int, s int")
    out = S.junction(spark.range(30).toDF("pid"), "pid", spark.range(7).toDF("sid"), "sid", real, "p", "s")
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    counts = {p: sum(1 for a, _ in rows if a == p) for p in range(30)}
    assert min(counts.values()) >= 1 and max(counts.values()) <= 4 and {s for _, s in rows} <= set(range(7))


def child(spark):
    return spark.range(200).select(F.col("id").alias("_rid"), F.when(F.col("id") % 3 > 0, F.col("id") + 5000).alias("fk"))


def test_stitching_leaves_no_orphans_and_keeps_nulls(spark):
    parent = spark.range(10, 20).toDF("pid")
    got = R.stitch_foreign_keys("C", child(spark), [Edge("C", "fk", "P", "pid"), Edge("C", "fk", "GONE", "x")], {"P": parent})
    rows = got.collect()
    assert len(rows) == 200 and all((r.fk is None) == (r._rid % 3 == 0) for r in rows)
    assert {r.fk for r in rows if r.fk is not None} == set(range(10, 20))


def test_repairs(spark, rows):
    df = spark.createDataFrame([(0, "A", "2024-02-02", "2024-01-01", 7), (1, "Z", "bad", "2024-01-01", 7), (2, None, "2024-01-01", None, None)],
                               "_rid long, K string, S string, E string, X_ID int")
    allowed = R.enforce_allowed(df, [ColumnPolicy("T", "K", allowed_values="['A']")])
    assert rows(allowed, "_rid", "K") == [(0, "A"), (1, "A"), (2, None)]
    dated = R.enforce_date_order(df, Strategy(temporal=[("S", "E")]))
    assert rows(dated, "S", "E") == sorted([("2024-01-01", "2024-02-02"), ("bad", "2024-01-01"), ("2024-01-01", None)], key=repr)
    entity = [ColumnPolicy("T", c, dedup_mode="entity") for c in ("X_ID", "K", "S")]
    assert rows(R.enforce_unique(df, entity, []), "_rid", "X_ID") == [(0, 1), (1, 2), (2, None)]
    assert rows(R.enforce_unique(df, entity, [Edge("T", "X_ID", "P", "p")]), "X_ID") == [(7,), (7,), (None,)]
    unique = df.where("_rid <> 1")
    assert rows(R.enforce_unique(unique, entity, []), "X_ID") == [(7,), (None,)]
    text = df.withColumn("C_KEY", F.lit("same"))
    assert rows(R.enforce_unique(text, [ColumnPolicy("T", "C_KEY", dedup_mode="entity")], []), "C_KEY") == [("C_KEY_000001",), ("C_KEY_000002",), ("C_KEY_000003",)]
    typed = R.restore_types(df.select("_rid", F.lit("x").alias("X_ID")), df)
    assert typed.schema["X_ID"].dataType.simpleString() == "int" and typed.first().X_ID is None


@pytest.mark.parametrize("column,flag,expected", [
    ("v", "null_value", None), ("v", "zero", 0.0), ("v", "negative_amount", -4.0), ("v", "max_boundary", 6.0), ("v", "min", 2.0), ("t", "zero", "0"),
    ("t", "duplicate", "a"), ("t", "empty", ""), ("t", "special_chars", "b!@#$%"), ("d_date", "future", datetime.date(2099, 12, 31)),
    ("d_date", "past", datetime.date(1900, 1, 1)), ("d", "future", datetime.date(2020, 1, 1)), ("v", "weird", 4.0), ("n", "max", 6)])
def test_edge_values(spark, column, flag, expected):
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([(0, 4.0, "b", day, day, 4)] + ([(1, 4.0, "a", day, day, 4), (2, 4.0, "a", day, day, 4)] if flag == "duplicate" else []),
                               "_rid long, v double, t string, d_date date, d date, n int")
    got = E.inject_edge_cases(df, [ColumnPolicy("T", column, edge_case_flags=[flag])], 1.0)
    row = got.where("_rid = 0").first()
    if flag == "weird":  # one row has no deviation: twice the mean
        expected = 8.0
    assert row[column] == expected and row["_edge_case"] and got.schema[column].dataType == df.schema[column].dataType


def test_edge_case_share(spark):
    df = spark.range(101).select(F.col("id").alias("_rid"), F.col("id").cast("double").alias("v"))
    flags = [ColumnPolicy("T", "v", edge_case_flags=["zero", "negative"])]
    assert E.inject_edge_cases(df, flags, 0.05).where("_edge_case").count() == 5
    assert E.inject_edge_cases(df, flags, 0.0).where("_edge_case").count() == 0
    assert E.inject_edge_cases(df, [], 0.5).where("_edge_case").count() == 0


def test_dedup_modes(spark, rows):
    df = spark.createDataFrame([(0, 1, "a"), (1, 2, "a"), (2, 1, "a"), (3, None, None), (4, None, None)], "_rid long, fk int, v string")
    assert DD.dedup(df, "reference").count() == 5
    assert rows(DD.dedup(df, "entity"), "_rid") == [(0,), (1,), (3,)]
    assert rows(DD.dedup(df, "event_full", fk_columns=["fk"]), "_rid") == [(0,), (1,), (3,)]
    kept = DD.dedup(df, "event", fk_columns=["fk"])
    assert rows(kept, "_rid") == [(0,), (3,)]
    empty = spark.createDataFrame([], DD.REGISTRY_SCHEMA)
    registry = DD.new_registry_rows(kept, empty, "T", "r1")
    again = DD.dedup(df, "event", fk_columns=["fk"], registry=registry, table="T", run_id="r1")
    other = DD.dedup(df, "event", fk_columns=["fk"], registry=registry, table="T", run_id="r2")
    assert again.count() == 0 and other.count() == 2
    assert DD.new_registry_rows(kept, registry, "T", "r2").count() == 0


def test_copula_keeps_margins_and_correlation(spark):
    df = spark.range(4000).select(F.rand(1).alias("a"), F.rand(2).alias("e")).select((F.col("a") * 10).alias("x"), (F.col("a") * 5 + F.col("e")).alias("y"), F.floor(F.col("e") * 9).cast("int").alias("k"))
    made = copula_synthesize(df, ["x", "y", "k"])
    r = made.agg(F.corr("x", "y"), F.avg("x"), F.min("x"), F.max("x"), F.max("k")).first()
    assert r[0] > 0.9 and abs(r[1] - 5) < 0.3 and 0 <= r[2] and r[3] <= 10 and r[4] <= 8
    assert made.schema["k"].dataType.simpleString() == "int"


def test_boundary_keys(spark, rows):
    df = spark.createDataFrame([(1, 5, 9), (2, 5, 9)], "A_ID int, B_ID int, code int")
    got = S.boundary_keys(df, "T", [Edge("C", "x", "T", "code")], "dom", "r")
    assert rows(got, "pk_column", "key_value") == [("A_ID", "1"), ("A_ID", "2"), ("code", "9")]


def test_unique_repair_numbers_all_duplicated_columns_at_once(spark):
    df = spark.range(100).select(
        F.col("id").alias("_rid"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("ACCT_ID"), F.col("id").cast("string").alias("DOC_ID"),
        F.concat(F.lit("x"), F.col("id") % 2).alias("CODE_KEY"), F.lit("wide").alias("w"))
    policies = [ColumnPolicy("T", c, dedup_mode="entity") for c in ("ACCT_ID", "DOC_ID", "CODE_KEY")]
    assert R.duplicated_columns(df, ["ACCT_ID", "DOC_ID", "CODE_KEY"]) == ["ACCT_ID", "CODE_KEY"]
    rows = R.enforce_unique(df.repartition(5), policies, []).orderBy("_rid").collect()
    assert [r.ACCT_ID for r in rows if r.ACCT_ID] == list(range(1, 67)) and all((r.ACCT_ID is None) == (r._rid % 3 == 0) for r in rows)
    assert [r.CODE_KEY for r in rows] == [f"CODE_KEY_{i:06d}" for i in range(1, 101)] and [r.DOC_ID for r in rows] == [str(i) for i in range(100)]


def test_unique_repair_leaves_the_plan_alone_without_duplicates(spark):
    df = spark.range(50).select(F.col("id").alias("_rid"), F.col("id").alias("ACCT_ID"))
    same = R.enforce_unique(df, [ColumnPolicy("T", "ACCT_ID", dedup_mode="entity")], [])
    plan = same._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Join", "Window"))
    one_null = df.withColumn("ACCT_ID", F.when(F.col("_rid") > 0, F.col("ACCT_ID")))
    assert R.duplicated_columns(one_null, ["ACCT_ID"]) == [] and R.duplicated_columns(one_null.unionByName(one_null.limit(1)), ["ACCT_ID"]) == ["ACCT_ID"]
