"""Tail probabilities of test statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def kolmogorov_tail(scaled: Column, terms: int = 100) -> Column:
    """P(K > scaled) of the Kolmogorov distribution, by its alternating series."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * scaled * scaled),
    )
    return F.when(scaled < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def chi_square_tail_value(statistic: float, dof: float) -> float:
    """P(X > statistic) for chi-squared with ``dof`` degrees of freedom."""
    if statistic is None or dof is None or dof <= 0 or math.isnan(statistic):
        return math.nan
    if statistic <= 0:
        return 1.0
    if math.isinf(statistic):
        return 0.0
    a, x = dof / 2.0, statistic / 2.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # power series of the lower part
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    # continued fraction of the upper part, by the modified Lentz method
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        value *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, front * value)


@F.pandas_udf(DoubleType())
def chi_square_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Called once per tested column, never per data row."""
    return pd.Series([chi_square_tail_value(x, k) for x, k in zip(statistic, dof)])
