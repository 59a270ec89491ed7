"""Joint-distribution synthesis of numeric columns with a Gaussian copula.

Marginals are quantile grids, dependence is the correlation of normal scores;
both are aggregates of a few numbers per column.  Rows are then drawn without
touching the source again.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import draws
from veilwork.operators.profile import clean, fields_of
from veilwork.operators.synthesis import RID, with_nulls


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    a = F.abs(x) / F.lit(2**0.5)
    t = F.lit(1.0) / (1.0 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    half = (1.0 - poly * F.exp(-a * a)) / 2
    return F.when(x < 0, 0.5 - half).otherwise(0.5 + half)


def copula_synthesize(df: DataFrame, columns: Sequence[str], n: int | None = None, seed: int | str = 42, grid: int = 100) -> DataFrame:
    """``n`` rows (default: as many as the source) with the source's marginals and correlations."""
    fields = fields_of(df, columns)
    values = [clean(f).cast("double") for f in fields]
    shares = [i / grid for i in range(grid + 1)]
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(v, shares, F.lit(10_000)).alias(f"q{i}") for i, v in enumerate(values)],
        *[F.count(v).alias(f"c{i}") for i, v in enumerate(values)],
    ).first()
    rows = facts["n"]
    scores = [NormalDist().inv_cdf((i + 0.5) / (grid + 2)) for i in range(grid + 2)]
    score_array = F.array(*[F.lit(s) for s in scores])
    scored = _scores(df, values, [facts[f"q{i}"] for i in range(len(values))], score_array)
    d = len(values)
    pairs = [(i, j) for i in range(d) for j in range(i)]
    matrix = np.eye(d)
    if pairs:
        measured = scored.agg(*[F.corr(f"z{i}", f"z{j}").alias(f"r{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            matrix[i, j] = matrix[j, i] = measured[f"r{i}_{j}"] or 0.0
    lower = np.linalg.cholesky(matrix + 1e-9 * np.eye(d))
    out = df.sparkSession.range(rows if n is None else n).withColumnRenamed("id", RID)
    rid = F.col(RID)
    out = out.select(RID, *[draws.normal(seed, "copula", i, rid).alias(f"e{i}") for i in range(d)])
    mixed = [sum((F.lit(float(lower[i, j])) * F.col(f"e{j}") for j in range(i + 1)), F.lit(0.0)) for i in range(d)]
    out = out.select(RID, *[(normal_cdf(m) * grid).alias(f"u{i}") for i, m in enumerate(mixed)])
    columns_out = []
    for i, f in enumerate(fields):
        knots = F.array(*[F.lit(float(q)) for q in facts[f"q{i}"]])
        cell = F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor(f"u{i}"))).cast("int")
        low, high = F.element_at(knots, cell + 1), F.element_at(knots, cell + 2)
        value = low + (high - low) * (F.col(f"u{i}") - cell)
        if not f.dataType.simpleString() in ("double", "float"):
            value = F.round(value)
        rate = 1 - facts[f"c{i}"] / rows if rows else 0.0
        columns_out.append(with_nulls(value, rate, seed, f.name, rid).try_cast(f.dataType).alias(f.name))
    return out.select(RID, *columns_out)


def _scores(df: DataFrame, values: Sequence[Column], knots: Sequence[Sequence[float]], score_array: Column) -> DataFrame:
    """Normal score of each value from its place in the quantile grid."""
    placed = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])

    def score(i: int) -> Column:
        grid = F.array(*[F.lit(float(q)) for q in knots[i]])
        below = F.size(F.filter(grid, lambda q: q < F.col(f"v{i}")))
        return F.when(F.col(f"v{i}").isNotNull(), F.element_at(score_array, below + 1)).alias(f"z{i}")

    return placed.select(*[score(i) for i in range(len(values))])
