"""The validation gate: every check gives one row.

(check_name, table_name, column_name, passed, metric_value, threshold, details)
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import names
from veilwork.operators import fidelity
from veilwork.operators.policies import ColumnPolicy, Strategy
from veilwork.operators.profile import STAMPS, fields_of, is_numeric, long_form, sketched_distinct
from veilwork.operators.reidentification import reid_risk, text_columns
from veilwork.operators.relations import Edge
from veilwork.operators.repair import as_moment
from veilwork.session import cut_lineage
from veilwork.sources.sinks import EDGE_FLAG
from veilwork.sources.tables import union_all

RESULT_SCHEMA = (
    "check_name string, table_name string, column_name string, passed boolean,"
    " metric_value double, threshold double, details string"
)


def _result(check: Column, table: str, column: Column, passed: Column, metric: Column, limit: float | None, details: Column) -> list[Column]:
    return [
        check.alias("check_name"),
        F.lit(table).alias("table_name"),
        column.cast("string").alias("column_name"),
        passed.alias("passed"),
        metric.cast("double").alias("metric_value"),
        F.lit(limit).cast("double").alias("threshold"),
        details.alias("details"),
    ]


def _constant(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def validate_fidelity(real: DataFrame, synth: DataFrame, table: str, policies: Iterable[ColumnPolicy] = (), ks_alpha: float = 0.05, jsd_limit: float = 0.15) -> DataFrame | None:
    """KS and JSD for numeric columns, JSD and chi-squared for the others.

    Left out: columns of low importance, masked columns, columns with fewer than
    five values on a side, and identifiers.
    """
    skip = {EDGE_FLAG} | {
        p.column_name for p in policies if p.business_importance == "low" or p.masking_strategy != "passthrough"
    }
    skip |= {c for c in real.columns if c.upper().endswith(names.IDENTIFIER_SUFFIXES)}
    numeric, other = fidelity.comparable_columns(real, synth, skip)
    name = F.col("column_name")
    parts = []

    def usable(counts: DataFrame) -> DataFrame:
        counts = cut_lineage(counts)  # three tests read it
        ratio = F.col("distinct_real") / F.col("total_real")
        kept = fidelity.side_totals(counts).where(
            (F.col("total_real") >= 5)
            & (F.col("total_synth") >= 5)
            & ~((ratio >= 0.95) & names.any_token(name, names.UNIQUE_ID_TOKENS))
        )
        return counts.join(kept.select("column_name"), "column_name", "left_semi")

    def jsd_rows(distances: DataFrame) -> DataFrame:
        return distances.select(
            *_result(
                F.concat(F.lit("JSD: "), name), table, name, F.col("jsd") <= jsd_limit, F.round("jsd", 6), jsd_limit,
                F.format_string("Jensen-Shannon distance = %.6f", "jsd"),
            )
        )

    if numeric:
        counts = usable(fidelity.numeric_counts(real, synth, numeric))
        parts.append(
            fidelity.ks_two_sample(counts, written=True).select(
                *_result(
                    F.concat(F.lit("KS Test: "), name), table, name, F.col("p_value") >= ks_alpha,
                    F.round("p_value", 6), ks_alpha,
                    F.format_string("KS statistic = %.4f, p-value = %.6f", "ks_stat", "p_value"),
                )
            )
        )
        parts.append(jsd_rows(fidelity.jensen_shannon(fidelity.histogram(counts), fidelity.BINS)))
    if other:
        counts = usable(fidelity.category_counts(real, synth, other))
        parts.append(jsd_rows(fidelity.jensen_shannon(counts)))
        parts.append(
            fidelity.chi_square(counts).select(
                *_result(
                    F.concat(F.lit("Chi-Squared: "), name), table, name, F.col("p_value") >= 0.05,
                    F.round("p_value", 6), 0.05,
                    F.format_string("chi2 = %.4f, p-value = %.6f, unseen share = %.4f", "chi2", "p_value", "unseen_share"),
                )
            )
        )
    return union_all(parts) if parts else None


def format_failures(df: DataFrame, column: str, pattern: str) -> Column:
    """Values that do not match the pattern from their start on."""
    return F.count_if(~F.col(column).cast("string").rlike(f"^(?:{pattern})"))


def value_overlap(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, real_values, synth_values, shared_values, overlap), distinct values only."""
    sides = (
        long_form(real, columns).withColumn("_r", F.lit(1)).withColumn("_s", F.lit(0))
        .unionByName(long_form(synth, columns).withColumn("_r", F.lit(0)).withColumn("_s", F.lit(1)))
        .where("value is not null")
        .groupBy("column_name", "value")
        .agg(F.max("_r").alias("_r"), F.max("_s").alias("_s"))
    )
    return sides.groupBy("column_name").agg(
        F.sum("_r").alias("real_values"),
        F.sum("_s").alias("synth_values"),
        F.sum(F.col("_r") * F.col("_s")).alias("shared_values"),
    ).withColumn("overlap", F.coalesce(F.try_divide("shared_values", "synth_values"), F.lit(0.0)))


def reid_columns(real: DataFrame, synth: DataFrame, policies: Iterable[ColumnPolicy] = ()) -> list[str]:
    """Columns worth comparing for re-identification, judged by name and type.

    Columns with at most five distinct values are left out by the caller, who
    knows them from a profile.
    """
    suppressed = {p.column_name for p in policies if p.masking_strategy == "suppress"}
    return [
        f.name
        for f in real.schema.fields
        if f.name in synth.columns
        and f.name != EDGE_FLAG
        and f.name not in suppressed
        and not f.name.upper().endswith(names.IDENTIFIER_SUFFIXES)
        and not names.has_token(f.name, names.STATUS_TOKENS + names.DATE_TOKENS)
        and not isinstance(f.dataType, (*STAMPS, T.BooleanType))
    ]


def reid_summary(risky: DataFrame) -> DataFrame:
    return risky.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("high_risk_count"), F.max("similarity").alias("max_similarity")
    )


def reid_sample(real: DataFrame, synth: DataFrame, columns: Sequence[str], order: str, rows: int = 200) -> DataFrame:
    """(row, similarity): nearest real record of each of the first rows of a sample.

    The sample is the feature: two times ``rows`` records.  Use ``reid_risk`` for whole tables.
    """
    k = len(columns)

    def cells(df: DataFrame, name: str) -> DataFrame:
        first = df.orderBy(order).limit(rows)
        values = F.array(
            *[F.struct(F.lit(j).alias("c"), v.alias("v")) for j, v in enumerate(text_columns(df, columns))]
        )
        return first.select(F.col(order).alias(name), F.explode(values).alias("x")).select(name, "x.c", "x.v")

    pairs = (
        cells(synth, "row").join(cells(real, "other"), ["c", "v"]).groupBy("row", "other").agg(F.count(F.lit(1)).alias("n"))
    )
    nearest = pairs.groupBy("row").agg(F.max("n").alias("n"))
    every = synth.orderBy(order).limit(rows).select(F.col(order).alias("row"))
    return every.join(nearest, "row", "left").select("row", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("similarity"))


def validate_leakage(real: DataFrame, synth: DataFrame, table: str, policies: Iterable[ColumnPolicy], reid_limit: float = 0.85, overlap_limit: float = 0.05) -> DataFrame | None:
    """Suppression, format, overlap of sensitive values, and re-identification."""
    policies, spark = list(policies), real.sparkSession
    parts, constants = [], []
    overlap = []
    types = {f.name: f.dataType for f in real.schema.fields}
    for p in policies:
        c = p.column_name
        if p.masking_strategy == "suppress":
            gone = c not in synth.columns
            constants.append((f"PII Suppression: {c}", table, c, gone, None, None, "absent" if gone else "column is in the output"))
            continue
        if p.masking_strategy == "format_preserving" and c in synth.columns and p.regex:
            bad = F.col("_bad")
            parts.append(
                synth.agg(format_failures(synth, c, p.regex).alias("_bad")).select(
                    *_result(
                        F.lit(f"Format Check: {c}"), table, F.lit(c), bad == 0, bad, None,
                        F.format_string("%d values do not match", bad),
                    )
                )
            )
        structural = names.STATUS_TOKENS + names.DATE_TOKENS + ("_ID",)
        if (
            p.masking_strategy in ("substitute_realistic", "format_preserving")
            and c in synth.columns
            and c in types
            and not c.upper().endswith(names.IDENTIFIER_SUFFIXES)
            and not names.has_token(c, structural)
            and not is_numeric(types[c])
            and not isinstance(types[c], (*STAMPS, T.BooleanType))
        ):
            overlap.append(c)
    if overlap:
        name, share = F.col("column_name"), F.col("overlap")
        rows = real.count()
        id_like = (F.col("real_values") >= 0.95 * rows) & names.any_token(name, names.UNIQUE_ID_TOKENS)
        parts.append(
            value_overlap(real, synth, overlap)
            .where((F.col("real_values") > 20) & (F.col("synth_values") > 0) & ~id_like)
            .select(
                *_result(
                    F.concat(F.lit("Sensitive Value Overlap: "), name), table, name, share <= overlap_limit,
                    F.round(share, 6), overlap_limit,
                    F.format_string("%.2f%% of distinct synthetic values occur in the source", share * 100),
                )
            )
        )
    compared = reid_columns(real, synth, policies)
    if compared:
        counts = real.selectExpr(*[f"{sketched_distinct(f)} AS `{f.name}`" for f in fields_of(real, compared)]).first()
        compared = [c for c in compared if counts[c] > 5]
    if compared:
        n, most = F.col("high_risk_count"), F.coalesce("max_similarity", F.lit(None).cast("double"))
        parts.append(
            reid_summary(reid_risk(real, synth, compared, reid_limit)).select(
                *_result(
                    F.lit("Re-identification Risk"), table, F.lit(None), n == 0, F.round(most, 4), reid_limit,
                    F.format_string("%d records above the threshold", n),
                )
            )
        )
    if constants:
        parts.append(_constant(spark, constants))
    return union_all(parts) if parts else None


def orphan_values(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row: distinct non-null child values that no parent row has."""
    keys = parent.select(F.col(parent_column).alias("_v"))
    values = child.select(F.col(column).alias("_v")).where("_v is not null").distinct()
    return values.join(keys, "_v", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def temporal_violations(df: DataFrame, earlier: str, later: str) -> Column:
    return F.count_if(as_moment(df, earlier) > as_moment(df, later))


def validate_lineage(df: DataFrame, table: str, edges: Iterable[Edge], parents: dict[str, DataFrame], strategy: Strategy | None = None) -> DataFrame | None:
    """Foreign keys exist in their parents; date pairs are in order."""
    parts, constants = [], []
    for e in edges:
        if e.source_table.upper() != table.upper() or e.source_column not in df.columns:
            continue
        label = f"FK Integrity: {e.source_column} → {e.target_table}.{e.target_column}"
        parent = parents.get(e.target_table)
        if parent is None or e.target_column not in parent.columns:
            constants.append((label, table, e.source_column, False, None, None, f"no data for parent {e.target_table}"))
            continue
        n = F.col("orphans")
        parts.append(
            orphan_values(df, e.source_column, parent, e.target_column).select(
                *_result(F.lit(label), table, F.lit(e.source_column), n == 0, n, 0.0, F.format_string("%d orphaned values", n))
            )
        )
    pairs = [(a, b) for a, b in (strategy.temporal if strategy else []) if a in df.columns and b in df.columns]
    if pairs:
        wide = df.agg(*[temporal_violations(df, a, b).alias(f"_t{i}") for i, (a, b) in enumerate(pairs)])
        rows = F.array(
            *[F.struct(F.lit(f"Temporal: {a} <= {b}").alias("c"), F.col(f"_t{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
        )
        n = F.col("n")
        parts.append(
            wide.select(F.explode(rows).alias("r")).select("r.*").select(
                *_result(F.col("c"), table, F.lit(None), n == 0, n, 0.0, F.format_string("%d violations", n))
            )
        )
    if constants:
        parts.append(_constant(df.sparkSession, constants))
    return union_all(parts) if parts else None


def validate_rules(df: DataFrame, table: str, rules: Sequence[str]) -> DataFrame | None:
    """Plain-language rules as counts, one pass; rules without a known form pass as recorded.

    A "positive" or "non-negative" rule counts values below zero, so zero passes.
    """
    counted, constants = [], []
    for rule in rules:
        text, check = rule.lower(), f"Business Rule: {rule}"
        mentioned = [f for f in df.schema.fields if f.name.lower() in text]
        numeric = [f for f in mentioned if is_numeric(f.dataType)]
        if ("must be positive" in text or "must be non-negative" in text) and numeric:
            counted.append((check, numeric[0].name, F.count_if(F.col(numeric[0].name) < 0), "negative values"))
        elif ("must not be null" in text or "cannot be null" in text) and mentioned:
            counted.append((check, mentioned[0].name, F.count_if(F.col(mentioned[0].name).isNull()), "null values"))
        else:
            constants.append((check, table, None, True, None, None, "recorded; verify by hand"))
    parts = []
    if counted:
        wide = df.agg(*[n.alias(f"_r{i}") for i, (_, _, n, _) in enumerate(counted)])
        rows = F.array(
            *[
                F.struct(F.lit(c).alias("c"), F.lit(col).alias("col"), F.col(f"_r{i}").alias("n"), F.lit(what).alias("w"))
                for i, (c, col, _, what) in enumerate(counted)
            ]
        )
        n = F.col("n")
        parts.append(
            wide.select(F.explode(rows).alias("r")).select("r.*").select(
                *_result(F.col("c"), table, F.col("col"), n == 0, n, None, F.concat_ws(" ", n.cast("string"), F.col("w")))
            )
        )
    if constants:
        parts.append(_constant(df.sparkSession, constants))
    return union_all(parts) if parts else None


def validate_table(real: DataFrame, synth: DataFrame, table: str, policies: Iterable[ColumnPolicy], edges: Iterable[Edge], parents: dict[str, DataFrame], strategy: Strategy) -> DataFrame:
    """All checks of one table."""
    policies = list(policies)
    parts = [
        validate_fidelity(real, synth, table, policies),
        validate_leakage(real, synth, table, policies),
        validate_lineage(synth, table, edges, parents, strategy),
        validate_rules(synth, table, strategy.rules),
    ]
    return union_all(p for p in parts if p is not None)


def validation_summary(results: DataFrame, shown: int | None = None) -> DataFrame:
    """Per table: checks, passed checks, pass rate in percent, and the failing names, or the first ``shown`` of them."""
    failing = F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("check_name"))))
    return results.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.round(100.0 * F.count_if("passed") / F.count(F.lit(1)), 1).alias("pass_rate"),
        (failing if shown is None else F.slice(failing, 1, shown)).alias("failing_checks"),
    )
