import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.operators import fidelity as FI
from veilwork.operators import validation as V
from veilwork.operators.policies import ColumnPolicy, Strategy
from veilwork.operators.relations import Edge


def ks_statistic(a, b):
    grid = np.union1d(a, b)
    return np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)))


def test_ks_matches_the_definition_with_ties_and_hot_values(spark):
    rng = np.random.default_rng(3)
    a = np.round(rng.normal(0, 1, 700), 2)
    b = np.concatenate([np.zeros(300), np.round(rng.normal(0.3, 2, 500), 2)])
    real = spark.createDataFrame([(float(x),) for x in a], "v double")
    synth = spark.createDataFrame([(float(x),) for x in b] + [(None,), (float("nan"),)], "v double")
    counts = FI.numeric_counts(real, synth, ["v"])
    for cells in (1, 5, 64):
        row = FI.ks_two_sample(counts, cells).first()
        assert row["ks_stat"] == pytest.approx(ks_statistic(a, b), abs=1e-12)
    assert (row["total_real"], row["total_synth"]) == (700, 800) and row["p_value"] < 1e-6
    same = FI.ks_two_sample(FI.numeric_counts(real, real, ["v"])).first()
    assert same["ks_stat"] == 0 and same["p_value"] == 1.0


def jsd(p, q):
    p, q = (np.asarray(x, float) / np.sum(x) + 1e-10 for x in (p, q))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return np.sqrt((np.sum(p * np.log(p / m)) + np.sum(q * np.log(q / m))) / 2)


def test_jensen_shannon(spark):
    a, b = np.array([0.0, 1, 1, 2, 10]), np.array([5.0, 5, 6, 7, 8])
    frames = [spark.createDataFrame([(float(x), str(x)) for x in v], "v double, t string") for v in (a, b)]
    bins = np.histogram_bin_edges(np.concatenate([a, b]), bins=50)
    got = FI.jensen_shannon(FI.histogram(FI.numeric_counts(*frames, ["v"])), 50).first()["jsd"]
    assert got == pytest.approx(jsd(np.histogram(a, bins)[0], np.histogram(b, bins)[0]), abs=1e-9)
    text = FI.jensen_shannon(FI.category_counts(*frames, ["t"])).first()["jsd"]
    cats = sorted(set(a) | set(b))
    assert text == pytest.approx(jsd([list(a).count(c) for c in cats], [list(b).count(c) for c in cats]), abs=1e-9)
    flat = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert FI.jensen_shannon(FI.histogram(FI.numeric_counts(flat, flat, ["v"])), 50).first()["jsd"] == pytest.approx(0, abs=1e-9)


def test_chi_square_and_unseen_categories(spark):
    real = spark.createDataFrame([("a",)] * 60 + [("b",)] * 40, "t string")
    synth = spark.createDataFrame([("a",)] * 25 + [("b",)] * 25, "t string")
    row = FI.chi_square(FI.category_counts(real, synth, ["t"])).first()
    assert row["chi2"] == pytest.approx(25 / 30 + 25 / 20) and row["dof"] == 1 and row["p_value"] == pytest.approx(0.1489, abs=1e-3)
    drift = FI.chi_square(FI.category_counts(real, synth.union(spark.createDataFrame([("new",)], "t string")), ["t"])).first()
    assert drift["p_value"] == 0.0 and drift["unseen_share"] == pytest.approx(1 / 51)
    one = spark.createDataFrame([("a",)] * 9, "t string")
    assert FI.chi_square(FI.category_counts(one, one, ["t"])).count() == 0


def brute_force(real, synth):
    k = len(real[0])
    return [max(sum(a == b for a, b in zip(s, r)) for r in real) / k for s in synth]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85])
def test_reid_risk_equals_brute_force(spark, threshold):
    rng = np.random.default_rng(5)

    def sample(n):
        return [tuple(None if x == 4 else int(x) for x in row) for row in rng.integers(0, 5, (n, 6))] + [(1, 1, 1, 1, 1, 1)] * n

    real, synth = sample(60), sample(80)
    columns = [f"c{i}" for i in range(6)]
    schema = ", ".join(f"{c} int" for c in columns)
    risky = V.reid_risk(spark.createDataFrame(real, schema), spark.createDataFrame(synth, schema), columns, threshold)
    above = [s for s in brute_force(real, synth) if s > threshold]
    row = V.reid_summary(risky).first()
    assert row["high_risk_count"] == len(above) and row["max_similarity"] == pytest.approx(max(above))
    nearest = V.reid_sample(*[spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "id int, " + schema) for x in (real, synth)], columns, "id", 500)
    assert sorted(r["similarity"] for r in nearest.collect()) == pytest.approx(sorted(brute_force(real, synth)))


def test_leakage_checks(spark):
    real = spark.range(100).select(F.concat(F.lit("real"), "id").alias("FULL_NM"), F.lit("123-45-6789").alias("SSN_TXT"), F.col("id").alias("SECRET"), F.concat(F.lit("q"), F.col("id") % 30).alias("A"))
    synth = real.select(F.when(F.col("SECRET") < 10, F.col("FULL_NM")).otherwise(F.concat(F.lit("m"), "SECRET")).alias("FULL_NM"), F.lit("12-3").alias("SSN_TXT"), "SECRET", "A")
    policies = [ColumnPolicy("T", "FULL_NM", masking_strategy="substitute_realistic"), ColumnPolicy("T", "SSN_TXT", masking_strategy="format_preserving", regex=r"\d{3}-"),
                ColumnPolicy("T", "SECRET", masking_strategy="suppress")]
    got = {r["check_name"]: r for r in V.validate_leakage(real, synth, "T", policies, reid_limit=0.85).collect()}
    assert not got["PII Suppression: SECRET"].passed
    assert got["Format Check: SSN_TXT"].metric_value == 100
    assert got["Sensitive Value Overlap: FULL_NM"].metric_value == pytest.approx(0.1) and not got["Sensitive Value Overlap: FULL_NM"].passed
    assert not got["Re-identification Risk"].passed and "10 records" in got["Re-identification Risk"].details


def test_lineage_and_rules(spark):
    child = spark.createDataFrame([(1, "2024-01-01", "2024-02-01", -1.0), (9, "2024-03-01", "2024-02-01", None), (None, "bad", "2024-02-01", 0.0)], "fk int, STRT string, FINI string, AMT double")
    parent = spark.createDataFrame([(1,), (None,)], "id int")
    edges = [Edge("C", "fk", "P", "id"), Edge("C", "fk", "MISSING", "id")]
    got = {r["check_name"]: r for r in V.validate_lineage(child, "C", edges, {"P": parent}, Strategy(temporal=[("STRT", "FINI")])).collect()}
    assert got["FK Integrity: fk → P.id"].metric_value == 1 and not got["FK Integrity: fk → MISSING.id"].passed
    assert got["Temporal: STRT <= FINI"].metric_value == 1
    rules = {r["check_name"]: r for r in V.validate_rules(child, "C", ["amt must be positive", "AMT cannot be null", "x must be one of (1)", "free text"]).collect()}
    assert [rules[f"Business Rule: {k}"].metric_value for k in ("amt must be positive", "AMT cannot be null")] == [1.0, 1.0]
    assert rules["Business Rule: free text"].passed
    summary = V.validation_summary(V.validate_rules(child, "C", ["amt must be positive", "free text"])).first()
    assert (summary.total_checks, summary.passed_checks, summary.pass_rate) == (2, 1, 50.0)


def test_summary_names_every_failing_check(spark):
    child = spark.createDataFrame([(-1.0,)], "AMT double")
    results = V.validate_rules(child, "C", [f"amt must be positive {i:02d}" for i in range(11)])
    every = [f"Business Rule: amt must be positive {i:02d}" for i in range(11)]
    assert V.validation_summary(results).first().failing_checks == every
    assert V.validation_summary(results, shown=10).first().failing_checks == every[:10]


def test_fidelity_skips(spark):
    real = spark.range(60).select(F.col("id").alias("ROW_ID"), F.col("id").alias("ROW_KEY"), (F.col("id") % 7).alias("AMT"), F.when(F.col("id") < 3, "x").alias("FEW"), F.lit("z").alias("LOW"), F.concat(F.lit("c"), F.col("id") % 3).alias("CAT"))
    checks = V.validate_fidelity(real, real, "T", [ColumnPolicy("T", "LOW", business_importance="low")])
    names = {r["check_name"] for r in checks.collect()}
    assert names == {"KS Test: AMT", "JSD: AMT", "JSD: CAT", "Chi-Squared: CAT"} and all(r.passed for r in checks.collect())


def test_quality_score(spark):
    real = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"), F.lit("x").alias("c"))
    row = FI.quality_score(FI.numeric_counts(real, real, ["a", "b"]), FI.category_counts(real, real, ["c"]), real, real, ["a", "b"]).first()
    assert row["quality_score"] == pytest.approx(1.0)
