import json

import pytest
from pyspark.sql import functions as F

from veilwork.operators import reports as R
from veilwork.operators import tracing as T
from veilwork.operators.defects import non_negative
from veilwork.operators.policies import ColumnPolicy, Strategy
from veilwork.operators.relations import Edge
from veilwork.plans import delivery
from veilwork.sources import sinks, tables as S

EDGES = [Edge("ORD", "cust", "CUST", "id"), Edge("ITEM", "ord", "ORD", "id"), Edge("ITEM", "prod", "PROD", "id"), Edge("CUST", "area", "AREA", "id"), Edge("PROD", "maker", "MAKER", "id")]


def shop(spark):
    return {
        "AREA": spark.createDataFrame([(1, "north")], "id int, nm string"),
        "CUST": spark.createDataFrame([(1, 1, "ann"), (2, 1, "bob"), (3, None, "cy")], "id int, area int, name string"),
        "ORD": spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id int, cust int"),
        "ITEM": spark.createDataFrame([(100, 10, 7), (101, 10, 8), (102, 11, 7), (103, 12, 7)], "id int, ord int, prod int"),
        "PROD": spark.createDataFrame([(7, 70), (8, 70)], "id int, maker int"),
        "MAKER": spark.createDataFrame([(70,)], "id int"),
    }


def run(spark, where, **options):
    tables = shop(spark)
    roots = tables["CUST"].where(where).withColumn("case_id", F.col("name")).select("case_id", *tables["CUST"].columns)
    return T.trace(tables, EDGES, "cust", roots, **options)


def visits(found):
    return sorted((r.table_name, r["mode"], r.depth, json.loads(r.row)["id"]) for r in found.rows().where("case_id = 'ann'").collect())


def test_trace_modes_depth_and_links(spark):
    found = run(spark, "name = 'ann'")
    assert visits(found) == sorted([
        ("CUST", "root", 0, 1), ("AREA", "upstream", 1, 1), ("ORD", "downstream", 1, 10), ("ORD", "downstream", 1, 11), ("CUST", "context", 2, 1),
        ("ITEM", "downstream", 2, 100), ("ITEM", "downstream", 2, 101), ("ITEM", "downstream", 2, 102),
        ("ORD", "context", 3, 10), ("ORD", "context", 3, 11), ("PROD", "context", 3, 7), ("PROD", "context", 3, 8)])
    links = sorted((r.from_table, r.to_table, r.direction, r.match_value, r.row_count) for r in found.links.collect())
    assert ("CUST", "ORD", "downstream", "1", 2) in links and ("ORD", "ITEM", "downstream", "10", 2) in links
    assert not any(a == "PROD" for a, *_ in links)  # context rows are not expanded
    assert links.count(("ITEM", "PROD", "upstream", "7", 1)) == 2  # one link per looked-up row
    assert {t: df.count() for t, df in found.tables().items()} == {"AREA": 1, "CUST": 1, "ITEM": 3, "ORD": 2, "PROD": 2}


def test_trace_stops_at_depth_but_records_links(spark):
    found = run(spark, "name = 'ann'", depth=1)
    assert max(r.depth for r in found.rows().collect()) == 1
    assert found.links.where("from_table = 'ORD' and to_table = 'ITEM'").count() == 2


def test_trace_runs_many_cases_and_skips_null_keys(spark):
    found = run(spark, "true")
    per_case = {r["case_id"]: r["count"] for r in found.rows().groupBy("case_id").count().collect()}
    assert per_case["cy"] == 1 and visits(found) == visits(run(spark, "name = 'ann'"))


def test_trace_limit_per_link(spark):
    found = run(spark, "name = 'ann'", limit_per_link=1)
    assert found.tables()["ORD"].count() == 1 and found.links.agg(F.max("row_count")).first()[0] == 1


def test_masked_scenario_keeps_joins(spark):
    key = [ColumnPolicy("CUST", "name", masking_strategy="substitute_realistic"), ColumnPolicy("CUST", "id", masking_strategy="substitute_realistic"), ColumnPolicy("ORD", "cust", masking_strategy="substitute_realistic")]
    masked = T.masked_scenario(run(spark, "name = 'ann'"), key, EDGES, "k")
    assert masked["ORD"].select("cust").distinct().collect() == masked["CUST"].select("id").collect()


def test_id_search_takes_wildcards_literally(spark, rows):
    df = spark.createDataFrame([("a%1",), ("ab1",), ("a_1",), (None,), ("a%1",)], "v string")
    assert rows(T.id_values(df, "v", "a%")) == [("a%1",)]
    assert T.id_values(df, "v", limit=2).count() == 2
    wanted = spark.createDataFrame([("ab1",)], "w string")
    assert T.point_lookup(df, "v", wanted, limit=1).count() == 1


def small_run(spark, out, fmt="parquet"):
    tables = {
        "CUST": spark.range(120).select(F.col("id").alias("CUST_ID"), F.concat(F.lit("Name "), "id").alias("FULL_NM"), (F.col("id") % 13 - 2.5).alias("BAL_AMT")),
        "ORD": spark.range(300).select(F.col("id").alias("ORD_ID"), (F.col("id") % 120).alias("CUST_ID"), F.expr("date_add(DATE'2020-01-01', cast(id as int))").alias("STRT_DT"), F.expr("date_add(DATE'2020-01-03', cast(id as int))").alias("END_DT")),
    }
    return tables, delivery.Run(
        run_id="r1", created_at="2024-01-01", output=out, mask_key="k", keys={"CUST": ["CUST_ID"], "ORD": ["ORD_ID"]}, edges=[Edge("ORD", "CUST_ID", "CUST", "CUST_ID")],
        policies=[ColumnPolicy("CUST", "FULL_NM", masking_strategy="substitute_realistic", dedup_mode="entity"), ColumnPolicy("CUST", "CUST_ID", dedup_mode="entity"),
                  ColumnPolicy("CUST", "BAL_AMT", edge_case_flags=["zero"], dedup_mode="entity"), ColumnPolicy("ORD", "ORD_ID", dedup_mode="entity")],
        strategies={"ORD": Strategy(temporal=[("STRT_DT", "END_DT")], domain="sales")}, rules=[non_negative("CUST", "CUST_ID", "BAL_AMT")], fmt=fmt)


def test_delivery_end_to_end(spark, tmp_path):
    tables, plan = small_run(spark, str(tmp_path))
    made = delivery.deliver(tables, plan)
    assert {t: df.count() for t, df in made.generated.items()} == {"CUST": 120, "ORD": 300}
    checks = {r.check_name: r for r in made.validation.collect()}
    assert checks["FK Integrity: CUST_ID → CUST.CUST_ID"].passed and checks["Temporal: STRT_DT <= END_DT"].passed
    real = {r[0] for r in tables["CUST"].select("FULL_NM").collect()}
    back = S.read_generated(spark, str(tmp_path), "cust")
    assert back.columns == tables["CUST"].columns and not real & {r.FULL_NM for r in back.collect()}
    assert back.schema == S.read_generated(spark, str(tmp_path), "CUST", "r1").schema
    listed = {r.table_name: r.rows_generated for r in S.manifests(spark, str(tmp_path)).collect()}
    assert listed == {"CUST": 120, "ORD": 300}
    manifest = made.manifest.first()
    assert manifest["edge_case_coverage"]["CUST"] == pytest.approx(0.05) and manifest["domains"]["ORD"] == "sales"
    assert manifest["checks_total"]["CUST"] >= manifest["checks_passed"]["CUST"] > 0
    assert made.defects.count() == tables["CUST"].where("BAL_AMT < 0").count()
    assert spark.read.parquet(f"{tmp_path}/registry").count() == 420
    with pytest.raises(FileNotFoundError):
        S.read_generated(spark, str(tmp_path), "NONE")


def test_csv_delivery_and_copy(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], bytearray(b"\xff\x01"), bytearray(b"ok"))], "id int, tags array<string>, raw binary, txt binary").withColumn("at", F.to_timestamp(F.lit("2024-01-02 03:04:05"))).withColumn("_edge_case", F.lit(True))
    sinks.deliver({"T": df}, str(tmp_path), "r", "csv")
    row = S.read_generated(spark, str(tmp_path), "T").first()
    assert (row.tags, row.raw, row.txt, row["at"]) == ('["a","b"]', "ff01", "ok", "2024-01-02T03:04:05") and "_edge_case" not in row.asDict()
    sinks.copy_tables({"T": df.select("id")}, str(tmp_path / "copy"), "json")
    assert S.load_tables(spark, str(tmp_path / "copy"), ["t", "_hidden"], "json", "")["T"].count() == 1


def test_newest_run_goes_by_time(spark, tmp_path):
    root = str(tmp_path)
    for run, at, value in (("run-b", "2024-01-01", 1), ("run-a", "2024-02-01", 2)):
        tables = {"T": spark.createDataFrame([(value,)], "id int")}
        sinks.deliver(tables, root, run)
        sinks.write_manifest(sinks.build_manifest(run, "s", at, tables), root, run)
    assert S.read_generated(spark, root, "t").first().id == 2 and S.read_generated(spark, root, "T", "run-b").first().id == 1


def test_sources(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    assert rows(S.column_catalog(spark, {"T": df}), "table_name", "column_name", "ordinal") == [("T", "id", 1), ("T", "s", 2)]
    assert rows(S.row_counts({"T": df, "U": df.limit(0)})) == [("T", 2), ("U", 0)]
    assert rows(S.sample_values(df, "s")) == [("a",)] and S.preview(df, 1)[1] == 2
    registry = S.SourceRegistry({"lake": {"root": "/x", "names": []}, "other": {}})
    assert registry.resolve()[0] == "lake" and registry.names() == ["lake", "other"] and registry.load(spark) == {}
    with pytest.raises(KeyError):
        registry.resolve("none")
    df.createOrReplaceTempView("shown")
    df.createOrReplaceTempView("_hidden")
    visible = S.visible_tables(spark)
    assert "shown" in visible and "_hidden" not in visible


def test_upsert_and_models(spark, rows):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("c", 5, "new")], base.schema)
    assert rows(sinks.upsert_latest(base, new, ["k"], "at"), "k", "v") == [("a", "new"), ("b", "old"), ("c", "new")]
    models = spark.createDataFrame([("T", "m", 1, True), ("T", "m", 2, True), ("T", "m", 3, False)], "table_name string, model_type string, registered_at int, is_active boolean")
    assert rows(R.newest_model(models), "registered_at") == [(2,)]
