"""The whole run over customers and their orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import check, read
from checks.privacy import KEY
from checks.relations import EDGES
from veilwork.operators import defects as D
from veilwork.operators.policies import ColumnPolicy, Strategy
from veilwork.operators.validation import orphan_values
from veilwork.plans import delivery
from veilwork.session import shared_folder
from veilwork.sources.tables import row_counts, union_all

TABLES = ("region", "nation", "customer", "orders")


def make_run(spark, root, output):
    tables = {t.upper(): read(spark, root, t) for t in TABLES}
    keys = {"REGION": ["r_regionkey"], "NATION": ["n_nationkey"], "CUSTOMER": ["c_custkey"], "ORDERS": ["o_orderkey"]}
    policies = [
        ColumnPolicy("CUSTOMER", "c_custkey", dedup_mode="entity"),
        ColumnPolicy("CUSTOMER", "c_name", masking_strategy="substitute_realistic", dedup_mode="entity"),
        ColumnPolicy("CUSTOMER", "c_acctbal", edge_case_flags=["negative", "max"], dedup_mode="entity"),
        ColumnPolicy("ORDERS", "o_orderkey", dedup_mode="entity"),
        ColumnPolicy("ORDERS", "o_totalprice", dedup_mode="event", edge_case_flags=["zero"]),
        ColumnPolicy("ORDERS", "o_orderstatus", dedup_mode="entity", allowed_values=["O", "F", "P"]),
        ColumnPolicy("REGION", "r_regionkey", dedup_mode="entity"),
        ColumnPolicy("NATION", "n_nationkey", dedup_mode="entity"),
    ]
    run = delivery.Run(
        run_id=f"run-{uuid.uuid4().hex[:8]}", created_at="2024-01-01T00:00:00", output=output, mask_key=KEY, keys=keys,
        edges=[e for e in EDGES if e.source_table in tables and e.target_table in tables],
        policies=policies, strategies={"CUSTOMER": Strategy(rules=["c_acctbal must not be null"], domain="customer_management")},
        rules=[D.non_negative("CUSTOMER", "c_custkey", "c_acctbal", "negative_balance")],
    )
    return tables, run


@check(
    "deliver_run",
    " UNION ALL ".join(f"SELECT '{t.upper()}' AS table_name, count(*) AS row_count, 0 AS orphans FROM {t}" for t in TABLES),
)
def deliver_run(spark, root):
    """Row counts as in the source, and no orphaned keys in the delivered tables."""
    tables, run = make_run(spark, root, f"{shared_folder(spark)}/delivery-{uuid.uuid4().hex}")
    made = delivery.deliver(tables, run)
    orphans = union_all(
        orphan_values(made.generated[e.source_table], e.source_column, made.generated[e.target_table], e.target_column).select(
            F.lit(e.source_table).alias("table_name"), "orphans"
        )
        for e in run.edges
    )
    return row_counts(made.generated).join(orphans, "table_name", "left").select(
        "table_name", "row_count", F.coalesce("orphans", F.lit(0)).alias("orphans")
    )
