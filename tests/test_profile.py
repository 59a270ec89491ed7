import pytest
from pyspark.sql import functions as F

from veilwork.operators import profile as P
from veilwork.operators.policies import ColumnPolicy, policies_frame


def frame(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (2, "a", float("nan")), (3, None, -0.0), (4, "b", 0.0)], "k int, s string, v double"
    )


def test_profile(spark):
    got = {r["column_name"]: r for r in P.profile(frame(spark)).collect()}
    assert (got["s"].null_count, got["s"].distinct_count, got["s"].null_rate) == (1, 2, 0.25)
    assert (got["v"].null_count, got["v"].distinct_count, got["v"].max_value) == (1, 2, 1.0)  # NaN is NULL, -0.0 is 0.0
    assert (got["k"].min_value, got["k"].mean_value, got["k"].unique_ratio) == (1.0, 2.5, 1.0)
    assert got["s"].mean_value is None and got["k"].ordinal == 1


def test_profile_of_empty_and_sampled_tables(spark):
    got = {r["column_name"]: r for r in P.profile(frame(spark).limit(0)).collect()}
    assert got["k"].row_count == 0 and got["k"].null_rate == 0.0 and got["k"].distinct_count == 0
    assert P.profile(frame(spark), sample_rows=2).first()["row_count"] == 2


def test_approximate_distinct(spark):
    got = {r["column_name"]: r for r in P.profile(spark.range(5000).toDF("id"), distinct="approx").collect()}
    assert abs(got["id"].distinct_count - 5000) < 400


def test_boolean_like_and_top_values(spark, rows):
    df = spark.createDataFrame([("y", "p"), ("N", "q"), ("Y", "q"), (None, "r")], "f string, g string")
    got = {r["column_name"]: r["boolean_like"] for r in P.profile(df).collect()}
    assert got == {"f": True, "g": False}
    assert rows(P.top_values(df, ["g"], n=2), "value", "frequency", "rank") == [("p", 1, 2), ("q", 2, 1)]


def test_value_pattern(spark):
    df = spark.createDataFrame([("1.5", "A", "x", None), ("-2", "B", "y", None)], "n string, T_CD string, s string, e string")
    stats = P.profile(df)
    got = {r["column_name"]: r["pattern_type"] for r in P.value_pattern(stats, P.top_values(df)).collect()}
    assert got == {"n": "numeric_measure", "T_CD": "finite_categorical", "s": "high_cardinality_string", "e": "unknown"}


def test_roles_and_fingerprint(spark):
    df = spark.range(2000).select(
        F.col("id").alias("ROW_ID"), (F.col("id") * 1.5).alias("AMT"), F.lit("x").alias("KIND"),
        F.concat(F.lit("n"), "id").alias("FULL_NM"), F.current_date().alias("START_DT"), F.concat(F.lit("p"), "id").alias("NICK"),
    )
    policies = policies_frame(spark, [ColumnPolicy("T", "FULL_NM", masking_strategy="substitute_realistic", dedup_mode="entity"),
                                      ColumnPolicy("T", "NICK", dedup_mode="event"), ColumnPolicy("T", "AMT", masking_strategy="generalise", dedup_mode="entity")])
    stats = P.profile_tables({"T": df})
    got = P.generation_profile(P.column_roles(stats, policies)).first()
    assert got["structural_columns"] == ["ROW_ID", "KIND", "FULL_NM", "START_DT"]
    assert got["modeled_columns"] == ["AMT", "NICK"] and got["sensitive_columns"] == ["AMT", "FULL_NM"]
    other = P.generation_profile(P.column_roles(stats, policies.where("column_name <> 'NICK'"))).first()
    assert got["fingerprint"] != other["fingerprint"] and len(got["fingerprint"]) == 64


@pytest.mark.parametrize("modeled,structural,n,override,tier", [
    (0, 3, 9000, "ctgan", "rule_based"), (1, 8, 9000, None, "rule_based"), (3, 10, 6000, None, "rule_based"),
    (3, 10, 5999, None, "ctgan"), (2, 2, 4999, None, "tvae"), (2, 2, 199, None, "rule_based"), (2, 2, 10, "hybrid", "hybrid")])
def test_route_tier(spark, modeled, structural, n, override, tier):
    row = spark.createDataFrame([(["m"] * modeled, ["s"] * structural, n, override)],
                                "modeled_columns array<string>, structural_columns array<string>, row_count long, tier_override string")
    assert P.route_tier(row).first()["tier"] == tier


def test_profile_similarity(spark):
    schema = "a struct<row_count:long,structural_columns:array<string>,modeled_columns:array<string>>, b struct<row_count:long,structural_columns:array<string>,modeled_columns:array<string>>"
    df = spark.createDataFrame([((100, ["x"], ["m", "n"]), (50, ["x"], ["m"])), ((0, [], []), (5, [], []))], schema)
    assert sorted(r["score"] for r in P.profile_similarity(df).collect()) == [0.625, 0.95]


def test_multiplicity(spark, rows):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "p int")
    assert rows(P.multiplicity(df, ["p"]), "parents", "mean_count", "min_count", "max_count") == [(2, 1.5, 1, 2)]


def test_default_profile_moves_one_row_per_task(spark, monkeypatch):
    """No column's values are shuffled unless its estimate lies near a limit, and then only that column's."""
    df = spark.range(60_000).select(
        F.col("id").alias("KEY"), (F.col("id") % 30_000).alias("HALF"), (F.col("id") % 100).cast("string").alias("CODE"),
        F.when(F.col("id") % 2 == 0, "Y").otherwise("n").alias("FLAG"), F.lit(None).cast("string").alias("NONE"))
    asked = []
    real = P._exact_counts
    monkeypatch.setattr(P, "_exact_counts", lambda d, c: asked.append(list(c)) or real(d, c))
    got = {r.column_name: r for r in P.profile(df).collect()}
    assert asked == [["KEY"]]  # unique, so near the limits of 0.95 and 1
    assert got["KEY"].distinct_count == 60_000 and got["KEY"].unique_ratio == 1.0 and got["KEY"].distinct_exact
    assert abs(got["HALF"].distinct_count - 30_000) < 900 and not got["HALF"].distinct_exact
    assert (got["CODE"].distinct_count, got["CODE"].distinct_exact) == (100, True)
    assert got["FLAG"].boolean_like and not got["CODE"].boolean_like and (got["NONE"].distinct_count, got["NONE"].null_count) == (0, 60_000)


def test_sketched_and_exact_roles_agree(spark):
    df = spark.range(40_000).select(
        F.col("id").alias("ROW_KEY"), (F.col("id") % 38_500).cast("string").alias("MOST_KEY"), (F.col("id") % 800).alias("LOW"),
        (F.col("id") % 801).alias("NOT_LOW"), F.concat(F.lit("t"), F.col("id") % 14_000).alias("TXT"))
    policies = spark.createDataFrame([], "table_name string, column_name string, masking_strategy string, business_importance string, dedup_mode string")
    roles = [sorted(map(tuple, P.column_roles(P.profile_tables({"T": df}, distinct=d), policies).select("column_name", "role").collect())) for d in ("sketch", "exact")]
    assert roles[0] == roles[1] and dict(roles[0])["LOW"] == "structural" and dict(roles[0])["NOT_LOW"] == "modeled"
