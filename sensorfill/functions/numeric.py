"""Numeric column expressions Spark does not ship."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ln(n!) for n = 0..9, where the series below is not yet exact.
_LN_FACTORIAL = [math.log(math.factorial(n)) for n in range(10)]


def invlogit(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def log1p_exp(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ln_factorial(n: Column) -> Column:
    """ln(n!) for integers n >= 0, by Stirling's series from 10 on."""
    z = F.greatest(n.cast("double"), F.lit(10.0)) + 1.0
    series = (
        (z - 0.5) * F.ln(z)
        - z
        + 0.5 * math.log(2 * math.pi)
        + 1.0 / (12.0 * z)
        - 1.0 / (360.0 * F.pow(z, F.lit(3.0)))
        + 1.0 / (1260.0 * F.pow(z, F.lit(5.0)))
        - 1.0 / (1680.0 * F.pow(z, F.lit(7.0)))
    )
    small = F.element_at(
        F.array(*[F.lit(v) for v in _LN_FACTORIAL]), F.least(n, F.lit(9)).cast("int") + 1
    )
    return F.when(n < 10, small).otherwise(series)


def normal_logpdf(x: Column, mean: Column, precision: Column) -> Column:
    return (
        0.5 * F.ln(precision) - 0.5 * math.log(2 * math.pi)
        - 0.5 * precision * F.pow(x - mean, F.lit(2.0))
    )
