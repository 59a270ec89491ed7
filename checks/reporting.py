"""Registries, exports, manifests and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import ALL_TABLES, check, read
from checks.generation import SQL_EDGE, injected
from checks.privacy import SQL_POLICIES, TEXTS, derived
from checks.validity import _sql_lineage, lineage
from veilwork.operators import graph as G
from veilwork.operators import policies as P
from veilwork.operators import reports as R
from veilwork.sources import sinks, tables as T


@check(
    "manifest",
    SQL_EDGE
    + """ SELECT 'ORDERS' AS table_name, count(*) AS row_count, 6 AS column_count, avg(_edge_case::INT) AS edge_case_coverage FROM changed
        UNION ALL SELECT 'CUSTOMER', count(*), 5, 0.0 FROM customer UNION ALL SELECT 'LINEITEM', count(*), 11, 0.0 FROM lineitem""",
)
def manifest(spark, root):
    made = {"ORDERS": injected(spark, root), "CUSTOMER": read(spark, root, "customer"), "LINEITEM": read(spark, root, "lineitem")}
    return sinks.manifest_facts(made)


@check(
    "upsert_latest",
    """SELECT user_id, event_id, event_type FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, (event_type = 'click') DESC) = 1""",
)
def upsert_latest(spark, root):
    """Clicks upserted into the other events, by user."""
    events = read(spark, root, "events")
    merged = sinks.upsert_latest(events.where("event_type <> 'click'"), events.where("event_type = 'click'"), ["user_id"], "ts")
    return merged.select("user_id", "event_id", "event_type")


@check(
    "export_normalize",
    """SELECT doc_id, CAST(to_json([lang, source]) AS VARCHAR) AS tags, text AS raw, 'ff' || lower(hex(lang)) AS bytes,
              CAST(to_json({'lang': lang, 'n': n_chars}) AS VARCHAR) AS meta FROM documents""",
)
def export_normalize(spark, root):
    docs = read(spark, root, "documents").select(
        "doc_id",
        F.array("lang", "source").alias("tags"),
        F.encode("text", "UTF-8").alias("raw"),
        F.unhex(F.concat(F.lit("FF"), F.hex("lang"))).alias("bytes"),
        F.struct("lang", F.col("n_chars").alias("n")).alias("meta"),
    )
    return sinks.normalize_for_export(docs)


K = "CAST(json_extract(props, '$.k') AS INT)"


def k_of():
    return F.get_json_object("props", "$.k").cast("int")


@check(
    "training_rollup",
    f"""WITH steps AS (SELECT 'T' || user_id AS table_name, event_type AS e, event_id AS id, {K} AS epoch, value AS loss FROM events)
        SELECT table_name, coalesce(arg_max(CASE e WHEN 'view' THEN 'training' WHEN 'click' THEN 'training' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'reused' END, id) FILTER (e <> 'purchase'), 'completed') AS status,
          coalesce(max(epoch) FILTER (e = 'view'), 0) AS epochs_completed, count(*) FILTER (e = 'view') AS metric_count,
          arg_max(loss, id) FILTER (e = 'view') AS latest_loss, CASE WHEN count(*) FILTER (e = 'purchase') > 0 THEN 'tvae' END AS tier
        FROM steps GROUP BY table_name""",
)
def training_rollup(spark, root):
    """Events read as the step log of one table per user."""
    step = F.create_map(*[F.lit(x) for x in (
        "view", "training_metric", "click", "training_start", "error", "training_failed", "purchase", "generation_complete", "signup", "model_reuse")])
    steps = read(spark, root, "events").select(
        F.concat(F.lit("T"), "user_id").alias("table_name"), step[F.col("event_type")].alias("step_name"),
        F.col("event_id").alias("step_id"), k_of().alias("epoch"), F.col("value").alias("loss"),
        F.when(F.col("event_type") == "purchase", "tvae").alias("tier"),
    )
    return R.training_rollup(steps)


@check(
    "loss_per_epoch",
    f"SELECT event_type AS table_name, {K} AS epoch, arg_max(value, event_id) AS loss FROM events GROUP BY ALL",
)
def loss_per_epoch(spark, root):
    log = read(spark, root, "events").select(
        F.col("event_type").alias("table_name"), k_of().alias("epoch"), F.col("value").alias("loss"), F.col("event_id").alias("logged_at")
    )
    return R.loss_per_epoch(log)


PHASES = [("signup", 0, 0.0, 20.0), ("view", 1, 20.0, 40.0), ("click", 2, 40.0, 60.0), ("purchase", 3, 60.0, 80.0), ("error", 4, 80.0, 100.0)]


@check(
    "phase_rollup",
    f"""WITH phases(phase_id, phase_order, s, e) AS (VALUES {', '.join(str(p) for p in PHASES)}),
        steps AS (SELECT *, {K} AS k FROM events),
        cur AS (SELECT phase_order AS c FROM phases WHERE phase_id = (SELECT arg_max(event_type, event_id) FROM steps)),
        agg AS (SELECT event_type AS phase_id, count(*) AS n, bool_or(event_type = 'error' AND k > 90) AS failed, bool_or(event_type = 'click') AS running,
                'step ' || max(event_id) AS latest_message, arg_max('k ' || k, event_id) FILTER (k > 50) AS insight FROM steps GROUP BY 1),
        st AS (SELECT p.*, coalesce(n, 0) AS log_count, latest_message, insight,
             CASE WHEN failed THEN 'failed' WHEN n > 0 AND phase_order < c THEN 'completed' WHEN n > 0 AND (phase_order = c OR running) THEN 'running'
                  WHEN 65 >= e THEN 'completed' ELSE 'pending' END AS phase_status FROM phases p LEFT JOIN agg USING (phase_id), cur)
        SELECT phase_id, phase_order, log_count, phase_status, CASE WHEN phase_status = 'completed' THEN 100.0 ELSE round(greatest(0, least(100, (65 - s) / (e - s) * 100)), 1) END::DOUBLE AS progress_pct,
          latest_message, insight FROM st""",
)
def phase_rollup(spark, root):
    k = k_of()
    steps = read(spark, root, "events").select(
        F.col("event_id").alias("step_id"), F.col("event_type").alias("phase_id"),
        F.when((F.col("event_type") == "error") & (k > 90), "failed").when(F.col("event_type") == "click", "running").otherwise("completed").alias("status"),
        F.concat(F.lit("step "), "event_id").alias("message"), F.when(k > 50, F.concat(F.lit("k "), k)).alias("insight"),
    )
    phases = spark.createDataFrame(PHASES, "phase_id string, phase_order int, start double, end double")
    return R.phase_rollup(steps, phases, "running", 65.0)


@check(
    "generation_log",
    f"""WITH e AS (SELECT 'run-' || (user_id % 3) AS run_id, 'T' || user_id AS table_name, *, {K} AS k FROM events),
        logged AS (SELECT run_id, table_name, arg_max(CASE event_type WHEN 'click' THEN 'auto' ELSE 'ctgan' END, event_id) AS tier,
             coalesce(arg_max(k, event_id) FILTER (event_type = 'purchase'), arg_max(k, event_id) FILTER (event_type = 'click')) AS n,
             arg_max(CAST(ts AS VARCHAR), event_id) FILTER (event_type = 'purchase') AS done_at FROM e WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
        told AS (SELECT run_id, table_name, count(*) AS rows, max(CAST(ts AS VARCHAR)) AS mat FROM e WHERE event_type = 'signup' GROUP BY ALL)
        SELECT run_id, table_name, coalesce(CASE WHEN tier <> 'auto' THEN tier END, CASE WHEN rows IS NOT NULL THEN 'tvae' END, tier) AS tier,
          coalesce(nullif(n, 0), rows, 0) AS rows_generated, coalesce(done_at, mat) AS completed_at, CASE WHEN rows > 0 THEN 'completed' ELSE 'running' END AS status
        FROM logged FULL JOIN told USING (run_id, table_name)""",
)
def generation_log(spark, root):
    e = read(spark, root, "events").select(
        F.concat(F.lit("run-"), F.col("user_id") % 3).alias("run_id"), F.concat(F.lit("T"), "user_id").alias("table_name"),
        F.col("event_id").alias("step_id"), "event_type", k_of().cast("long").alias("row_count"), F.col("ts").cast("string").alias("completed_at"),
    )
    steps = e.where("event_type in ('click', 'purchase')").select(
        "*",
        F.when(F.col("event_type") == "click", "tier_routing").otherwise("generation_complete").alias("step_name"),
        F.when(F.col("event_type") == "click", "auto").otherwise("ctgan").alias("tier"),
    )
    told = e.where("event_type = 'signup'").groupBy("run_id", "table_name").agg(
        F.lit("tvae").alias("tier"), F.count(F.lit(1)).alias("rows_generated"), F.max("completed_at").alias("completed_at")
    )
    return R.generation_log(steps, told, "running")


@check("latest_activity", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC LIMIT 200")
def latest_activity(spark, root):
    """The activity page: the newest 200 entries."""
    return R.latest(read(spark, root, "events"), "ts", 200).select("event_id", "user_id", "event_type")


@check(
    "user_elapsed",
    "SELECT user_id, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds FROM events GROUP BY 1",
)
def user_elapsed(spark, root):
    runs = read(spark, root, "events").groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return runs.select("user_id", F.round(R.elapsed_seconds("started", "ended"), 3).alias("seconds"))


@check(
    "dashboard_stats",
    SQL_POLICIES
    + f""", results AS ({_sql_lineage()})
      SELECT 4 AS total_tables, 'customer_management,general' AS domains, (SELECT count(*) FROM policies) AS total_columns,
        (SELECT count(*) FROM policies WHERE pii_classification <> 'none') AS pii_columns_detected,
        (SELECT round(100.0 * count(*) FILTER (passed) / count(*), 1) FROM results) AS validation_pass_rate,
        (SELECT count(*) FROM policies WHERE confidence < 0.6) AS columns_pending_review""",
)
def dashboard_stats(spark, root):
    policies = derived(spark, root)
    reviews = P.review_queue(policies).select(F.lit("pending").alias("status"))
    domains = policies.select("table_name").distinct().withColumn("domain", G.rule_domain(F.col("table_name")))
    return R.dashboard(policies, lineage(spark, root), reviews, domains).withColumn("domains", F.array_join("domains", ","))


@check(
    "pii_per_table",
    SQL_POLICIES + "SELECT table_name, count(*) AS total_columns, count(*) FILTER (pii_classification <> 'none') AS pii_columns FROM policies GROUP BY 1",
)
def pii_per_table(spark, root):
    return R.pii_columns(derived(spark, root))


@check(
    "graph_snapshot",
    SQL_POLICIES
    + """SELECT node, CASE WHEN node = 'CUSTOMER' THEN 'customer_management' ELSE 'general' END AS domain, column_count, coalesce(pii, 0) AS pii_columns
        FROM (VALUES ('DOCUMENTS', 5), ('CONVERSATIONS', 4), ('PAGES', 3), ('CUSTOMER', 5)) AS t(node, column_count)
        LEFT JOIN (SELECT table_name AS node, count(*) FILTER (pii_classification <> 'none') AS pii FROM policies GROUP BY 1) USING (node)""",
)
def graph_snapshot(spark, root):
    known = {t.upper(): read(spark, root, t) for t in TEXTS}
    empty = spark.createDataFrame([], "source_table string, target_table string")
    return G.graph_snapshot(T.column_catalog(spark, known), empty, derived(spark, root))[0]


@check(
    "table_list",
    "SELECT table_name, source_rows, CASE WHEN table_name IN ('ORDERS', 'LINEITEM') THEN source_rows ELSE 0 END AS generated_rows,"
    " CASE WHEN table_name = 'ORDERS' THEN 'billing_revenue' ELSE 'unknown' END AS domain FROM ("
    + " UNION ALL ".join(f"SELECT '{t.upper()}' AS table_name, count(*) AS source_rows FROM {t}" for t in ALL_TABLES) + ")",
)
def table_list(spark, root):
    source = T.row_counts({t.upper(): read(spark, root, t) for t in ALL_TABLES})
    generated = T.row_counts({t.upper(): read(spark, root, t) for t in ("orders", "lineitem")})
    metadata = spark.createDataFrame([("ORDERS", "billing_revenue")], "table_name string, domain string")
    return R.table_list(source, generated, metadata)


@check(
    "dominant_dedup_mode",
    SQL_POLICIES
    + """, modes AS (SELECT table_name, dedup_mode, count(*) AS n, min(column_name) AS f FROM policies GROUP BY ALL)
      SELECT table_name, dedup_mode FROM modes QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY n DESC, f) = 1""",
)
def dominant_dedup_mode(spark, root):
    policies = derived(spark, root)
    order = {c: i for i, c in enumerate(sorted(c for cs in TEXTS.values() for c in cs))}
    ordinal = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("column_name")]
    return P.dominant_dedup_mode(policies.withColumn("ordinal", ordinal))
