"""Tracing business cases through the foreign keys of a schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.membership import prefiltered
from veilwork.operators.masking import key_domains, mask
from veilwork.operators.policies import ColumnPolicy
from veilwork.operators.relations import Edge
from veilwork.session import cut_lineage
from veilwork.sources.tables import Tables, union_all

CASE = "case_id"
LINK_COLUMNS = [
    CASE, "from_table", "to_table", "via_source_column", "via_target_column", "match_value", "direction",
    "depth", "row_count",
]


def id_values(df: DataFrame, column: str, search: str | None = None, limit: int | None = 50) -> DataFrame:
    """Distinct ids as text, in text order, that contain the search text (taken literally)."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null")
    if search:
        values = values.where(F.contains(F.col("value"), F.lit(search)))
    values = values.distinct().orderBy("value")
    return values if limit is None else values.limit(limit)


def point_lookup(df: DataFrame, column: str, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose ``column`` is among the single-column ``wanted``, for any number of values at once."""
    keys = wanted.toDF(column).distinct()
    found = df.join(keys, column, "left_semi")
    if limit is None:
        return found
    window = Window.partitionBy(column).orderBy(*df.columns)
    return found.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= limit).drop("_rn")


@dataclass
class Trace:
    """Rows found per (table, mode, depth), with typed columns, and the links between them."""

    found: dict[tuple[str, str, int], DataFrame]
    links: DataFrame | None

    def rows(self, show: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        """(case_id, table_name, mode, depth, row): one line per visit, rows as JSON."""

        def one(table: str, mode: str, depth: int, df: DataFrame) -> DataFrame:
            columns = (show or {}).get(table) or [c for c in df.columns if c != CASE]
            return df.select(
                CASE,
                F.lit(table).alias("table_name"),
                F.lit(mode).alias("mode"),
                F.lit(depth).alias("depth"),
                F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row"),
            )

        return union_all(one(t, m, d, df) for (t, m, d), df in self.found.items())

    def tables(self) -> dict[str, DataFrame]:
        """The distinct rows of each table, per case."""
        grouped: dict[str, list[DataFrame]] = {}
        for (table, _, _), df in self.found.items():
            grouped.setdefault(table, []).append(df)
        return {t: union_all(parts).distinct() for t, parts in sorted(grouped.items())}


def _limited(related: DataFrame, keys: Sequence[str], limit: int | None) -> DataFrame:
    if limit is None:
        return related
    window = Window.partitionBy(*keys).orderBy(*related.columns)
    return related.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= limit).drop("_rn")


def trace(
    tables: Tables,
    edges: Iterable[Edge],
    root_table: str,
    roots: DataFrame,
    depth: int = 3,
    limit_per_link: int | None = None,
) -> Trace:
    """Follow every case up and down the foreign keys.

    ``roots`` holds rows of ``root_table`` plus ``case_id``; any number of cases
    run together.  From root, upstream and downstream rows the trace goes to
    parents; from root and downstream rows to children.  A parent reached from a
    downstream row is context and is not expanded.  Rows at ``depth`` still
    record their links.  ``limit_per_link`` caps the rows one lookup follows.

    Which tables a step can reach follows from the edges alone, so the loop runs
    over schema states, each a join of a frontier with one table.
    """
    edges = list(edges)
    root_table = root_table.upper()
    frontier: dict[tuple[str, str], DataFrame] = {(root_table, "root"): roots}
    visited: dict[tuple[str, str], DataFrame] = {}
    found: dict[tuple[str, str, int], DataFrame] = {}
    links: list[DataFrame] = []
    for level in range(depth + 1):
        following: dict[tuple[str, str], list[DataFrame]] = {}
        for state, arrivals in frontier.items():
            table, mode = state
            fresh = arrivals.distinct() if state not in visited else arrivals.subtract(visited[state])
            fresh = cut_lineage(fresh)
            found[(table, mode, level)] = fresh
            visited[state] = fresh if state not in visited else visited[state].unionByName(fresh)
            for e in edges:
                if mode != "context" and e.source_table == table and e.target_table in tables:
                    step = _step(fresh, e.source_column, tables[e.target_table], e.target_column, limit_per_link)
                    links.append(_links(step, e.source_column, e.target_column, table, e.target_table, "upstream", level))
                    next_mode = "upstream" if mode in ("root", "upstream") else "context"
                    following.setdefault((e.target_table, next_mode), []).append(step.related)
                if mode in ("root", "downstream") and e.target_table == table and e.source_table in tables:
                    step = _step(fresh, e.target_column, tables[e.source_table], e.source_column, limit_per_link)
                    links.append(_links(step, e.target_column, e.source_column, table, e.source_table, "downstream", level))
                    following.setdefault((e.source_table, "downstream"), []).append(step.related)
        frontier = {s: union_all(parts) for s, parts in following.items()}
    return Trace(found, union_all(links) if links else None)


@dataclass
class _Step:
    related: DataFrame
    per_row: DataFrame


def _step(fresh: DataFrame, own: str, other: DataFrame, theirs: str, limit: int | None) -> _Step:
    """Rows of ``other`` matching the frontier, and the number of matches per frontier row.

    ``other`` is read once: the matches are written, and both the rows to follow
    and their counts come from there.  Keys are distinct by case and key but met
    by key, so both sides of the join are plain exchanges, which Spark splits
    where one key has very many rows.
    """
    rows = fresh.select(CASE, F.col(f"`{own}`").alias("_key")).where("_key is not null")
    keys = rows.distinct()
    columns = [F.col(f"`{c}`") for c in other.columns]
    near = prefiltered(other, F.col(f"`{theirs}`"), keys, "_key").withColumn("_key", F.col(f"`{theirs}`"))
    matched = cut_lineage(keys.join(near, "_key").select(CASE, "_key", *columns))
    size = F.count(F.lit(1))
    counts = matched.groupBy(CASE, "_key").agg((size if limit is None else F.least(size, F.lit(limit))).alias("row_count"))
    return _Step(_limited(matched, [CASE, "_key"], limit).select(CASE, *columns), rows.join(counts, [CASE, "_key"]))


def _links(step: _Step, own: str, theirs: str, from_table: str, to_table: str, direction: str, depth: int) -> DataFrame:
    constants: dict[str, Column] = {
        "from_table": F.lit(from_table),
        "to_table": F.lit(to_table),
        "via_source_column": F.lit(own),
        "via_target_column": F.lit(theirs),
        "match_value": F.col("_key").cast("string"),
        "direction": F.lit(direction),
        "depth": F.lit(depth),
    }
    return step.per_row.withColumns(constants).select(*LINK_COLUMNS)


def masked_scenario(found: Trace, policies: Iterable[ColumnPolicy], edges: Iterable[Edge], key: str) -> dict[str, DataFrame]:
    """The traced rows of each table, masked so that keys still match across tables."""
    policies, edges = list(policies), list(edges)
    return {
        table: mask(df, [p for p in policies if p.table_name == table], key, key_domains(edges, table))
        for table, df in found.tables().items()
    }
