"""Replacement rows drawn from the distributions of a source table.

Output rows are numbered ``_rid`` 0..n-1.  Every draw is keyed by (seed, column,
_rid), so a recomputed partition holds the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import draws, names
from veilwork.functions.ordering import shuffled_index
from veilwork.operators.fetching import RID, Draw, fetch, fetch_weighted
from veilwork.operators.policies import ColumnPolicy, allowed_list
from veilwork.operators.profile import (
    STAMPS,
    clean_sql,
    fields_of,
    is_numeric,
    sketched_distinct,
    value_counts,
)
from veilwork.sources.tables import union_all

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
CATEGORY_LIMIT = 50


@dataclass(frozen=True)
class ColumnStats:
    """What the generators need to know of one column; one per column, on the driver."""

    rows: int
    present: int
    distinct: int
    numbers: int
    whole_numbers: int
    low: float | None
    high: float | None
    mean: float | None
    std: float | None

    @property
    def null_rate(self) -> float:
        return (self.rows - self.present) / self.rows if self.rows else 0.0


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    """Statistics of the columns: one pass for moments and sketched distinct counts.

    Distinct counts only decide how a column is drawn.  They are exact where a
    sketch is near a limit that matters, see ``_exact_distinct``.
    """
    fields = fields_of(df, columns)
    if not fields:
        return {}
    aggregates = ["count(1) AS rows"]
    for i, f in enumerate(fields):
        value = clean_sql(f)
        if is_numeric(f.dataType):
            number = f"CAST({value} AS DOUBLE)"
        elif isinstance(f.dataType, T.StringType):
            number = f"TRY_CAST({value} AS DOUBLE)"
        else:
            number = "CAST(NULL AS DOUBLE)"
        aggregates += [
            f"count({value}) AS present{i}",
            f"{sketched_distinct(f)} AS distinct{i}",
            f"count({number}) AS numbers{i}",
            f"count_if({number} = floor({number})) AS whole{i}",
            f"min({number}) AS low{i}",
            f"max({number}) AS high{i}",
            f"avg({number}) AS mean{i}",
            f"stddev_samp({number}) AS std{i}",
        ]
    row = df.selectExpr(*aggregates).first()
    limits = {CATEGORY_LIMIT, max(12, int(row["rows"] * 0.02))}
    close = [
        f.name
        for i, f in enumerate(fields)
        if any(0.85 * lim - 2 <= row[f"distinct{i}"] <= 1.15 * lim + 2 for lim in limits)
    ]
    exact = _exact_distinct(df, close)
    return {
        f.name: ColumnStats(
            row["rows"], row[f"present{i}"], exact.get(f.name, row[f"distinct{i}"]), row[f"numbers{i}"],
            row[f"whole{i}"], row[f"low{i}"], row[f"high{i}"], row[f"mean{i}"], row[f"std{i}"],
        )
        for i, f in enumerate(fields)
    }


def _exact_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    if not columns:
        return {}
    counted = value_counts(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    return {r["column_name"]: r["n"] for r in counted.collect()}


def category_weights(df: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """(value, frequency) by value for columns known to have few values."""
    if not columns:
        return {}
    rows = value_counts(df, columns).select("column_name", "value", "frequency").collect()
    found: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in rows:
        found[r["column_name"]].append((r["value"], r["frequency"]))
    return {c: sorted(v) for c, v in found.items()}


def weighted_choice(weights: Sequence[tuple[str, int]], draw: Column) -> Column:
    """The value whose share of the running frequency total holds ``draw``.

    ``draw`` is a uniform long below the total and should be a plain column, as
    every branch refers to it.
    """
    upper, branches = 0, []
    for value, frequency in weights:
        upper += frequency
        branches.append((upper, value))
    if len(branches) == 1:
        return F.lit(branches[0][1])
    chosen = F.when(draw < branches[0][0], F.lit(branches[0][1]))
    for limit, value in branches[1:-1]:
        chosen = chosen.when(draw < limit, F.lit(value))
    return chosen.otherwise(F.lit(branches[-1][1]))


def gaussian(stats: ColumnStats, policy: ColumnPolicy | None, whole: bool, *key) -> Column:
    """Clipped normal draw; whole numbers are truncated, others rounded to cents."""
    low = stats.low if policy is None or policy.min_value is None else float(policy.min_value)
    high = stats.high if policy is None or policy.max_value is None else float(policy.max_value)
    spread = max(stats.std or 0.0, 1.0 if whole else 0.01)
    drawn = F.least(
        F.greatest(F.lit(stats.mean) + F.lit(spread) * draws.normal(*key), F.lit(low)), F.lit(high)
    )
    return drawn.cast("long") if whole else F.round(drawn, 2)


def with_nulls(value: Column, rate: float, *key) -> Column:
    """NULL at the given rate."""
    if rate <= 0:
        return value
    return F.when(draws.uniform("null", *key) >= F.lit(rate), value)


def numbered_text(exemplar: Column, number: Column) -> Column:
    """The exemplar with its digits replaced by ``number``, padded to the same width."""
    pattern = r"^([A-Za-z_-]*)([0-9]+)([A-Za-z_-]*)$"
    text = number.cast("string")

    def padded(width: Column) -> Column:
        return F.lpad(text, F.greatest(F.length(text), width), F.lit("0"))

    return F.when(
        exemplar.rlike(pattern),
        F.concat(
            F.regexp_extract(exemplar, pattern, 1),
            padded(F.length(F.regexp_extract(exemplar, pattern, 2))),
            F.regexp_extract(exemplar, pattern, 3),
        ),
    ).otherwise(F.concat(exemplar, F.lit("_"), padded(F.lit(5))))


@dataclass(frozen=True)
class Plan:
    """How each column of a table will be drawn."""

    sequence: list[str]
    renumbered: list[str]
    resampled: list[str]
    weighted: list[str]
    weighted_many: list[str]
    gaussian: list[str]
    allowed: list[str]
    empty: list[str]
    independent: list[str]


def plan_columns(df: DataFrame, structural: Iterable[str], stats: dict[str, ColumnStats], policies: dict[str, ColumnPolicy]) -> Plan:
    structural = set(structural)
    plan = Plan([], [], [], [], [], [], [], [], [])
    for f in fields_of(df, list(stats)):
        s, upper, name = stats[f.name], f.name.upper(), f.name
        policy = policies.get(name)
        stamp = isinstance(f.dataType, STAMPS) or names.has_token(name, names.DATE_TOKENS)
        numeric = is_numeric(f.dataType)
        if name in structural:
            few = s.distinct <= max(12, int(s.rows * 0.02)) or names.has_token(name, names.STATUS_TOKENS)
            if s.present == 0:
                plan.empty.append(name)
            elif upper.endswith("_ID") and numeric:
                plan.sequence.append(name)
            elif not numeric and (upper.endswith("_ID") or "UUID" in upper or "KEY" in upper):
                plan.renumbered.append(name)
            elif not stamp and few:
                # the same draw for any number of values; only short lists become constants
                (plan.weighted if s.distinct <= CATEGORY_LIMIT else plan.weighted_many).append(name)
            else:
                plan.resampled.append(name)
        elif policy is not None and allowed_list(policy.allowed_values):
            plan.allowed.append(name)
        elif s.present == 0:
            plan.empty.append(name)
        elif numeric or (isinstance(f.dataType, T.StringType) and s.numbers > 0):
            plan.gaussian.append(name)
        elif s.distinct <= CATEGORY_LIMIT:
            plan.weighted.append(name)
        else:
            plan.independent.append(name)
    return plan


def synthesize(
    df: DataFrame,
    structural: Iterable[str],
    policies: Iterable[ColumnPolicy],
    key: Sequence[str],
    n: int | None = None,
    seed: int | str = 42,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``n`` rows (default: as many as the source) with the source's columns and types.

    ``key`` must be unique in the source.  Dates and other resampled structural
    columns of one output row come from one source row, so start and end dates
    stay in order.  ``key`` columns need not be among ``columns``.
    """
    spark, source = df.sparkSession, df
    columns = list(columns or source.columns)
    chosen = {p.column_name: p for p in policies}
    stats = column_stats(source, columns)
    total = next(iter(stats.values())).rows if stats else df.count()
    n = total if n is None else n
    plan = plan_columns(source, structural, stats, chosen)
    weights = category_weights(source, plan.weighted)
    types = {f.name: f.dataType for f in source.schema.fields}

    out = spark.range(n).withColumnRenamed("id", RID)
    rid = F.col(RID)
    wanted = [Draw(draws.pick(total, seed, "row", rid), tuple(plan.resampled))] if plan.resampled else []
    wanted += [Draw(draws.pick(total, seed, c, rid), (c,)) for c in plan.independent]
    # NULLs come back at the source's rate, so exemplars are the rows with a value
    wanted += [Draw(F.pmod(rid, F.lit(stats[c].present)), (c,), c) for c in plan.renumbered]
    if wanted:
        out = out.join(fetch(out, source, key, seed, wanted), RID, "left")
    if plan.weighted_many:
        chosen_at = {c: draws.pick(stats[c].present, seed, c, rid) for c in plan.weighted_many}
        out = out.join(fetch_weighted(spark.range(n).withColumnRenamed("id", RID), value_counts(source, plan.weighted_many), chosen_at, n), RID, "left")
        for c in plan.weighted_many:
            out = out.withColumn(c, with_nulls(F.col(c), stats[c].null_rate, seed, c, rid))
    for c in plan.renumbered:
        out = out.withColumn(c, with_nulls(numbered_text(F.col(c).cast("string"), rid + 1), stats[c].null_rate, seed, c, rid))

    drawn = {}
    for c in plan.sequence:
        drawn[c] = with_nulls(rid + 1, stats[c].null_rate, seed, c, rid)
    for c in plan.weighted:
        out = out.withColumn(f"_d_{c}", draws.pick(sum(w for _, w in weights[c]), seed, c, rid))
        chosen_value = weighted_choice(weights[c], F.col(f"_d_{c}"))
        drawn[c] = with_nulls(chosen_value, stats[c].null_rate, seed, c, rid)
    for c in plan.gaussian:
        s = stats[c]
        whole = isinstance(types[c], INTEGERS) or (
            isinstance(types[c], T.StringType) and s.whole_numbers == s.numbers == s.present
        )
        drawn[c] = with_nulls(gaussian(s, chosen.get(c), whole, seed, c, rid), s.null_rate, seed, c, rid)
    for c in plan.allowed:
        drawn[c] = draws.pick_from(allowed_list(chosen[c].allowed_values), seed, c, rid)
    for c in plan.empty:
        drawn[c] = F.lit(None)
    return out.select(
        RID, *[drawn.get(c, F.col(f"`{c}`")).try_cast(types[c]).alias(c) for c in columns]
    )


def boundary_keys(df: DataFrame, table: str, edges, domain: str, run_id: str) -> DataFrame:
    """Distinct values of key columns: targets of edges, and ``_ID`` columns that are unique."""
    targets = {e.target_column for e in edges if e.target_table.upper() == table.upper()}
    ids = [c for c in df.columns if c.upper().endswith("_ID") and c not in targets]
    found = [c for c in df.columns if c in targets]
    if ids:
        unique = df.agg(*[(F.count_distinct(F.col(c)) == F.count(F.lit(1))).alias(c) for c in ids]).first()
        found += [c for c in ids if unique[c]]
    if not found:
        return df.sparkSession.createDataFrame(
            [], "domain string, table_name string, pk_column string, key_value string, run_id string"
        )
    return union_all(
        df.select(F.col(c).cast("string").alias("key_value"))
        .where("key_value is not null")
        .distinct()
        .select(
            F.lit(domain).alias("domain"),
            F.lit(table).alias("table_name"),
            F.lit(c).alias("pk_column"),
            "key_value",
            F.lit(run_id).alias("run_id"),
        )
        for c in found
    )


def junction(
    primary: DataFrame,
    primary_key: str,
    secondary: DataFrame,
    secondary_key: str,
    real: DataFrame,
    primary_fk: str,
    secondary_fk: str,
    seed: int | str = 42,
    others: Sequence[str] = (),
    real_key: Sequence[str] = (),
) -> DataFrame:
    """Link rows between two parents with the real number of links per primary key.

    Each primary key draws a count and then that many different secondary keys:
    a start position and a step prime to the number of keys visit distinct
    positions, so nothing needs to be de-duplicated.
    """
    per_key = (
        real.where(F.col(primary_fk).isNotNull()).groupBy(primary_fk).agg(F.count(F.lit(1)).alias("n"))
    )
    facts = per_key.agg(
        F.avg("n").alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std"), F.max("n").alias("most")
    ).first()
    keys = secondary.select(F.col(secondary_key).alias("_sk")).where("_sk is not null").distinct()
    size = keys.count()
    if facts["mean"] is None or size == 0:
        raise ValueError("junction needs real link rows and secondary keys")
    parent = F.col(primary_fk)
    count = F.greatest(
        F.lit(1),
        (F.lit(facts["mean"]) + F.lit(max(facts["std"], 0.5)) * draws.normal(seed, "count", parent)).cast("long"),
    )
    count = F.least(count, F.lit(int(facts["most"])), F.lit(size))
    stride = _coprime_stride(size)
    links = (
        primary.select(F.col(primary_key).alias(primary_fk))
        .where(parent.isNotNull())
        .distinct()
        .select(
            primary_fk,
            draws.pick(size, seed, "start", parent).alias("_start"),
            F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("_i"),
        )
        .withColumn("_pos", F.pmod(F.col("_start") + F.col("_i") * F.lit(stride), F.lit(size)))
    )
    indexed = shuffled_index(keys, ["_sk"], seed, name="_pos")
    out = links.join(indexed, "_pos").select(primary_fk, F.col("_sk").alias(secondary_fk))
    if not others:
        return out
    total, pair = real.count(), F.struct(F.col(primary_fk), F.col(secondary_fk))
    wanted = [Draw(draws.pick(total, seed, c, parent, F.col(secondary_fk)), (c,)) for c in others]
    placed = out.withColumn(RID, pair)
    return placed.join(fetch(placed, real, real_key, seed, wanted), RID, "left").drop(RID)


def _coprime_stride(size: int) -> int:
    """A step near the golden ratio of ``size`` that shares no factor with it."""
    from math import gcd

    step = max(1, int(size * 0.618))
    while gcd(step, size) != 1:
        step += 1
    return step
