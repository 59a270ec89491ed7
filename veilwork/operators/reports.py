"""Rollups over policies, validation results, step logs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pii_columns(policies: DataFrame) -> DataFrame:
    """PII columns per table; every classification but none counts."""
    return policies.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(F.col("pii_classification") != "none").alias("pii_columns"),
    )


def dashboard(policies: DataFrame, results: DataFrame, reviews: DataFrame, domains: DataFrame) -> DataFrame:
    """One row of totals.  ``domains``: (table_name, domain); internal tables are left out."""
    visible = ~F.col("table_name").startswith("_")
    columns = policies.where(visible).agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(F.col("pii_classification") != "none").alias("pii_columns_detected"),
    )
    tables = domains.where(visible).agg(
        F.count(F.lit(1)).alias("total_tables"), F.array_sort(F.collect_set("domain")).alias("domains")
    )
    checks = results.agg(
        F.round(F.coalesce(100.0 * F.try_divide(F.count_if("passed"), F.count(F.lit(1))), F.lit(0.0)), 1).alias(
            "validation_pass_rate"
        )
    )
    pending = reviews.agg(F.count_if(F.col("status") == "pending").alias("columns_pending_review"))
    one = F.lit(1).alias("_one")
    result = tables.select("*", one)
    for part in (columns, checks, pending):  # each is one row
        result = result.join(part.select("*", one), "_one")
    return result.drop("_one")


def latest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of a log (a top-n sort, not a full one)."""
    return df.orderBy(F.desc(order)).limit(n)


def elapsed_seconds(started: str, ended: str, now: Column | None = None) -> Column:
    end = F.coalesce(F.col(ended), now if now is not None else F.current_timestamp())
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / 1e6


def loss_per_epoch(log: DataFrame, how: str = "last") -> DataFrame:
    """(table_name, epoch, loss): the last logged value of an epoch, or the mean over it."""
    value = F.max_by("loss", F.col("logged_at")) if how == "last" else F.avg("loss")
    return log.groupBy("table_name", "epoch").agg(value.alias("loss"))


# The status each training step leaves a table in.
STEP_STATUS = {
    "training_start": "training",
    "training_metric": "training",
    "training_complete": "completed",
    "training_failed": "failed",
    "model_reuse": "reused",
    "generation_failed": "failed",
}


def training_rollup(steps: DataFrame) -> DataFrame:
    """Per table: latest status, epochs, metric count, newest loss.

    ``steps``: table_name, step_name, step_id, epoch, loss, tier.
    """
    status: Column = F.lit(None).cast("string")
    for step, value in STEP_STATUS.items():
        status = F.when(F.col("step_name") == step, value).otherwise(status)
    metric = F.col("step_name") == "training_metric"
    done = F.col("step_name") == "generation_complete"
    generated = F.when(F.bool_or(done), F.lit("completed")).otherwise("pending")
    return (
        steps.withColumn("_status", status)
        .groupBy("table_name")
        .agg(
            F.coalesce(F.max_by("_status", F.when(F.col("_status").isNotNull(), F.col("step_id"))), generated).alias("status"),
            F.coalesce(F.max(F.when(metric, F.col("epoch"))), F.lit(0)).alias("epochs_completed"),
            F.count_if(metric).alias("metric_count"),
            F.max_by("loss", F.when(metric, F.col("step_id"))).alias("latest_loss"),
            F.max_by("tier", F.when(F.col("tier").isNotNull(), F.col("step_id"))).alias("tier"),
        )
        .orderBy("table_name")
    )


def phase_rollup(steps: DataFrame, phases: DataFrame, run_status: str, progress: float) -> DataFrame:
    """Per phase: logs, status, progress within the phase, latest message and insight.

    ``steps``: step_id, phase_id, status, message, insight; ``phases``: phase_id,
    phase_order, start, end.  The current phase is that of the last step, or the
    one the progress falls into.
    """
    per_phase = steps.groupBy("phase_id").agg(
        F.count(F.lit(1)).alias("log_count"),
        F.bool_or(F.col("status") == "failed").alias("_failed"),
        F.bool_or(F.col("status") == "running").alias("_running"),
        F.max_by("message", "step_id").alias("latest_message"),
        F.max_by("insight", F.when(F.col("insight").isNotNull(), F.col("step_id"))).alias("insight"),
    )
    last = steps.agg(F.max_by("phase_id", "step_id")).scalar()
    by_step = phases.where(F.col("phase_id") == last).agg(F.max("phase_order")).scalar()
    by_progress = phases.agg(
        F.coalesce(F.min(F.when(F.lit(progress) <= F.col("end"), F.col("phase_order"))), F.max("phase_order"))
    ).scalar()
    current = F.coalesce(by_step, by_progress)
    logged = F.coalesce(F.col("log_count"), F.lit(0)) > 0
    active = F.lit("waiting_review" if run_status == "waiting_review" else "running")
    status = (
        F.when(F.col("_failed"), "failed")
        .when(F.lit(run_status == "completed"), "completed")
        .when(logged & (F.col("phase_order") < current), "completed")
        .when(logged & ((F.col("phase_order") == current) | F.col("_running")), active)
        .when(F.lit(progress) >= F.col("end"), "completed")
        .otherwise("pending")
    )
    within = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.lit(progress) - F.col("start")) / F.greatest(F.col("end") - F.col("start"), F.lit(1.0)) * 100)), 1)
    return (
        phases.join(per_phase, "phase_id", "left")
        .withColumn("phase_status", status)
        .select(
            "phase_id",
            "phase_order",
            F.coalesce("log_count", F.lit(0)).alias("log_count"),
            "phase_status",
            F.when(F.col("phase_status") == "completed", F.lit(100.0)).otherwise(within).alias("progress_pct"),
            "latest_message",
            "insight",
        )
        .orderBy("phase_order")
    )


def generation_log(steps: DataFrame, manifest_rows: DataFrame, run_status: str) -> DataFrame:
    """One row per (run, table): tier, rows, status; manifests fill what the steps lack.

    ``steps``: run_id, table_name, step_name, step_id, tier, row_count, completed_at;
    ``manifest_rows``: run_id, table_name, tier, rows_generated, completed_at.
    """
    keys = ["run_id", "table_name"]
    routed, done = F.col("step_name") == "tier_routing", F.col("step_name") == "generation_complete"
    logged = steps.where(routed | done).groupBy(*keys).agg(
        F.max_by("tier", F.when(F.col("tier").isNotNull(), F.col("step_id"))).alias("tier"),
        F.coalesce(
            F.max_by("row_count", F.when(done, F.col("step_id"))), F.max_by("row_count", F.when(routed, F.col("step_id")))
        ).alias("rows_generated"),
        F.max_by("completed_at", F.when(done, F.col("step_id"))).alias("completed_at"),
    )
    told = manifest_rows.select(
        *keys, F.col("tier").alias("_tier"), F.col("rows_generated").alias("_rows"), F.col("completed_at").alias("_at")
    )
    known = F.when(~F.col("tier").isin("unknown", "auto"), F.col("tier"))
    return (
        logged.join(told, keys, "full")
        .select(
            *keys,
            F.coalesce(known, "_tier", "tier", F.lit("unknown")).alias("tier"),
            F.coalesce(F.nullif("rows_generated", F.lit(0)), "_rows", F.lit(0)).alias("rows_generated"),
            F.coalesce("completed_at", "_at").alias("completed_at"),
            F.when(F.coalesce("_rows", F.lit(0)) > 0, "completed").otherwise(run_status).alias("status"),
        )
        .orderBy(F.col("status") != "completed", F.coalesce("completed_at", F.lit("")), *keys)
    )


def table_list(source: DataFrame, generated: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every known table with its source rows, generated rows and domain; generated ones first."""
    return (
        source.select("table_name", F.col("row_count").alias("source_rows"))
        .join(generated.select("table_name", F.col("row_count").alias("generated_rows")), "table_name", "full")
        .join(metadata.select("table_name", "domain"), "table_name", "full")
        .select(
            "table_name",
            F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
            F.coalesce("generated_rows", F.lit(0)).alias("generated_rows"),
            F.coalesce("domain", F.lit("unknown")).alias("domain"),
        )
        .orderBy(F.col("generated_rows") == 0, "table_name")
    )


def newest_model(models: DataFrame) -> DataFrame:
    """The active model of each table and type: the one registered last."""
    window = Window.partitionBy("table_name", "model_type").orderBy(F.desc("registered_at"))
    return models.where("is_active").withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")
