"""The whole run: profile, mask, synthesise, repair, inject, de-duplicate, validate, deliver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.operators import dedup as dd
from veilwork.operators import defects as de
from veilwork.operators import masking, profile, repair, synthesis, validation
from veilwork.operators.edge_cases import inject_edge_cases
from veilwork.operators.policies import ColumnPolicy, Strategy, policies_frame
from veilwork.operators.relations import Edge
from veilwork.session import cut_lineage
from veilwork.sources import sinks
from veilwork.sources.tables import Tables, union_all


@dataclass(frozen=True)
class Run:
    """What one run needs to know besides the tables."""

    run_id: str
    created_at: str
    output: str
    mask_key: str
    keys: Mapping[str, Sequence[str]]  # unique columns of each table
    edges: Sequence[Edge] = ()
    policies: Sequence[ColumnPolicy] = ()
    strategies: Mapping[str, Strategy] = field(default_factory=dict)
    rules: Sequence[de.Rule] = ()
    only: Sequence[str] | None = None
    source_name: str = "default"
    seed: int | str = 42
    fmt: str = "parquet"
    registry: DataFrame | None = None

    def policies_of(self, table: str) -> list[ColumnPolicy]:
        return [p for p in self.policies if p.table_name == table]

    def strategy_of(self, table: str) -> Strategy:
        return self.strategies.get(table, Strategy())


@dataclass
class Delivery:
    generated: Tables
    validation: DataFrame
    manifest: DataFrame
    defects: DataFrame | None


def table_order(tables: Sequence[str], edges: Sequence[Edge]) -> list[str]:
    """Tables with parents first; members of a cycle come last.

    A schema has a handful of tables, so this is ordinary list work; use
    ``graph.dependency_levels`` for graphs that are data.
    """
    waiting, ordered = sorted(tables), []
    parents = {t: {e.target_table for e in edges if e.source_table == t} - {t} for t in waiting}
    while waiting:
        ready = [t for t in waiting if not parents[t] & set(waiting)] or waiting
        ordered += ready
        waiting = [t for t in waiting if t not in ready]
    return ordered


def dedup_mode(policies: Sequence[ColumnPolicy]) -> str:
    """The commonest mode of a table's policies; the first seen wins a tie."""
    modes = [p.dedup_mode for p in policies]
    return max(dict.fromkeys(modes), key=modes.count) if modes else "reference"


def structural_columns(frames: Tables, run: Run) -> dict[str, list[str]]:
    """Columns of each table that follow structure; known from profiles of all tables."""
    spark = next(iter(frames.values())).sparkSession
    ends = [(e.source_table, e.source_column) for e in run.edges] + [(e.target_table, e.target_column) for e in run.edges]
    roles = profile.column_roles(profile.profile_tables(frames), policies_frame(spark, run.policies), ends)
    found: dict[str, list[str]] = {t: [] for t in frames}
    for row in roles.where("role = 'structural'").select("table_name", "column_name").collect():
        found[row["table_name"]].append(row["column_name"])  # one row per column
    return found


def generate_table(table: str, source: DataFrame, structural: Sequence[str], run: Run, generated: Tables) -> DataFrame:
    """Rows of one table, repaired against the parents generated before it."""
    policies, strategy = run.policies_of(table), run.strategy_of(table)
    own_edges = [e for e in run.edges if e.source_table == table]
    made = synthesis.synthesize(source, structural, policies, list(run.keys[table]), seed=run.seed)
    # repairs and edge cases measure the rows before they change them: do not draw twice
    made = cut_lineage(made)
    made = repair.repair(table, made, own_edges, generated, policies, strategy, run.seed)
    if strategy.edge_case_share > 0 and any(p.edge_case_flags for p in policies):
        made = cut_lineage(made)
    made = inject_edge_cases(made, policies, strategy.edge_case_share, run.seed)
    made = dd.dedup(
        made, dedup_mode(policies), fk_columns=[e.source_column for e in own_edges], registry=run.registry,
        table=table, run_id=run.run_id, ignore=[synthesis.RID, sinks.EDGE_FLAG],
    )
    return repair.restore_types(made, source)


def deliver(tables: Tables, run: Run) -> Delivery:
    """Run every step and write tables, manifest and defect report.

    Each generated table is written once: its children, its checks and its
    delivery all read that copy.
    """
    chosen = {t: df for t, df in tables.items() if run.only is None or t in {n.upper() for n in run.only}}
    edges = [e for e in run.edges if e.source_table in chosen and e.target_table in chosen]
    frames = {
        t: masking.training_frame(df, run.policies_of(t), run.mask_key, masking.key_domains(edges, t))
        for t, df in chosen.items()
    }
    structural = structural_columns(frames, run)
    generated: Tables = {}
    for table in table_order(list(chosen), edges):
        made = generate_table(table, frames[table], structural[table], run, generated)
        generated[table] = cut_lineage(made)
    public = {t: df.drop(synthesis.RID, "record_hash") for t, df in generated.items()}
    checks = cut_lineage(
        union_all(
            validation.validate_table(
                chosen[t], df, t, run.policies_of(t), [e for e in edges if e.source_table == t], public, run.strategy_of(t)
            )
            for t, df in public.items()
        )
    )
    sinks.deliver(public, run.output, run.run_id, run.fmt)
    manifest = sinks.build_manifest(
        run.run_id, run.source_name, run.created_at, public, checks,
        domains={t: run.strategy_of(t).domain for t in public},
        strategies={t: dedup_mode(run.policies_of(t)) for t in public},
    )
    sinks.write_manifest(manifest, run.output, run.run_id)
    for t, df in generated.items():
        if "record_hash" in df.columns:
            hashes = df.select(F.lit(t).alias("table_name"), "record_hash", F.lit(run.run_id).alias("run_id"))
            sinks.append(hashes, f"{run.output}/registry")
    report = None
    if run.rules:
        found = de.detect(chosen, run.rules)
        if found:
            report = de.defect_report(found)
            sinks.write_report(report, f"{run.output}/run_id={run.run_id}/defects")
    return Delivery(public, checks, manifest, report)
