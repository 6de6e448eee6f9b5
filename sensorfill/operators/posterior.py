"""Summaries of parameter draws."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.functions.numeric import invlogit
from sensorfill.operators.scale import lookup_join

# The plotted quantities and the upper end of their grids.
GRID_ENDS = {
    "p_false_zero": 1.0,
    "false_zero_mean_weekday": 10.0,
    "false_zero_mean_weekend": 10.0,
    "multiplier_weekday": 5.0,
    "multiplier_weekend": 5.0,
}


def long_draws(draws: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide draws as ``(param, chain, draw, sensor, value)``."""
    parts = []
    for n in names:
        parts += [F.lit(n), F.col(n)]
    return draws.select(
        "chain", "draw", *S.SENSOR, F.stack(F.lit(len(names)), *parts).alias("param", "value")
    )


def posterior_means(draws: DataFrame, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Mean of each parameter over its draws, e.g. as a start of the next fit."""
    return draws.groupBy(*keys).agg(F.avg("value").alias("mean"))


def posterior_summary(draws: DataFrame, keys: Sequence[str] = ("param",)) -> DataFrame:
    """Mean, sd, quantiles and chain-mixing ratio of each parameter.

    The ratio compares the variance between chains with that within them. Each
    group holds the draws of one parameter, a number the caller sets.
    """
    keys = list(keys)
    chains = (
        draws.groupBy(*keys, "chain")
        .agg(
            F.avg("value").alias("c_mean"),
            F.var_samp("value").alias("c_var"),
            F.count(F.lit(1)).alias("c_n"),
        )
        .groupBy(*keys)
        .agg(
            F.avg("c_var").alias("within"),
            F.coalesce(F.var_samp("c_mean"), F.lit(0.0)).alias("between"),
            F.avg("c_n").alias("n"),
        )
        .withColumn(
            "r_hat",
            F.sqrt((F.col("n") - 1) / F.col("n") + F.try_divide(F.col("between"), F.col("within"))),
        )
    )
    quantiles = [
        F.percentile("value", F.lit(p)).alias(name)
        for p, name in (
            (0.025, "q025"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.975, "q975")
        )
    ]
    whole = draws.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), *quantiles
    )
    return whole.join(chains.select(*keys, "r_hat"), keys)


def back_transform(draws: DataFrame) -> DataFrame:
    """Draws of the probability, the means and the multipliers themselves."""
    return draws.select(
        "chain",
        "draw",
        *S.SENSOR,
        invlogit(F.col("d")).alias("p_false_zero"),
        F.exp("L").alias("false_zero_mean_weekday"),
        F.exp(F.col("L") + F.col("L_cov")).alias("false_zero_mean_weekend"),
        F.exp("a").alias("multiplier_weekday"),
        F.exp(F.col("a") + F.col("a_cov")).alias("multiplier_weekend"),
    )


def bandwidth(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``width`` and number ``n`` of each group's draws.

    The width is ``0.9 min(sd, IQR / 1.34) n^(-1/5)``, of the sd where the quartiles
    coincide. A group of equal draws falls back on the size of the first, then on 1.
    """
    spread = F.least(F.col("sd"), F.col("iqr") / 1.34)
    fallback = F.coalesce(
        *[F.when(F.col(c) > 0, F.col(c)) for c in ("sd", "size")], F.lit(1.0)
    )
    quartiles = F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))
    width = 0.9 * F.when(spread > 0, spread).otherwise(fallback) * F.pow("n", F.lit(-0.2))
    return (
        draws.groupBy(*keys)
        .agg(
            F.stddev_samp("value").alias("sd"),
            quartiles.alias("iqr"),
            F.abs(F.min_by("value", "draw")).alias("size"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(*keys, width.alias("width"), "n")
    )


def density_grid(
    draws: DataFrame,
    end: float,
    start: float = 0.0,
    n: int = 512,
    keys: Sequence[str] = ("param", *S.SENSOR),
) -> DataFrame:
    """Gaussian kernel density of each group's draws on an even grid, by ``bandwidth``.

    Every draw adds to every grid point; sums combine before the shuffle.
    """
    keys = list(keys)
    width = bandwidth(draws, keys).drop("n")
    z = (F.col("x") - F.col("value")) / F.col("width")
    kernel = F.exp(-0.5 * z * z) / (F.col("width") * F.sqrt(2 * F.pi()))
    step = (end - start) / (n - 1)
    return (
        draws.join(width, keys)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("x", start + F.col("i") * F.lit(step))
        .groupBy(*keys, "i", "x")
        .agg(F.avg(kernel).alias("density"))
    )


#: Cells of a bandwidth, and bandwidths beyond which a kernel is zero to double precision.
CELLS_PER_WIDTH = 16
REACH = 9.0


def binned_density(
    draws: DataFrame,
    ends: dict[str, float],
    n: int = 512,
    keys: Sequence[str] = ("param", *S.SENSOR),
) -> DataFrame:
    """``density_grid`` of all quantities in ``ends`` at once, from binned draws.

    A draw gives its weight to the two cells beside it, in proportion to its nearness.
    Weights of a cell are added up before the shuffle, and one row for each group holds
    its cells, so what is moved follows the cells, not the draws times the grid. The
    kernel then runs over the cells. Cells are those of the grid, cut in equal parts
    until a bandwidth has 16, which keeps the density within 1/2048 of its kernel's peak.
    ``keys`` must have ``param``; grids start at zero.
    """
    keys = list(keys)
    top = F.element_at(F.create_map(*[F.lit(v) for pair in ends.items() for v in pair]), F.col("param"))
    step = F.col("end") / (n - 1)
    parts = F.greatest(F.ceil(CELLS_PER_WIDTH * step / F.col("width")), F.lit(1))
    groups = (
        bandwidth(draws.filter(F.col("param").isin(*ends)), keys)
        .withColumn("end", top)
        .withColumn("parts", parts.cast("bigint"))
    )
    at = F.col("value") / (step / F.col("parts"))
    low = F.floor(at)
    reach = REACH * F.col("width")
    near = F.col("value").between(-reach, F.col("end") + reach)
    cells = F.array(
        F.struct(low.alias("cell"), (low + 1 - at).alias("weight")),
        F.struct((low + 1).alias("cell"), (at - low).alias("weight")),
    )
    # A group has a width and a number alone, so the table of groups is small or joined.
    sums = (
        lookup_join(draws, groups, keys)
        .filter(near)
        .select(*keys, "width", "n", "end", "parts", F.inline(cells))
        .groupBy(*keys, "width", "n", "end", "parts", "cell")
        .agg(F.sum("weight").alias("weight"))
        .groupBy(*keys, "width", "n", "end", "parts")
        .agg(F.collect_list("cell").alias("cells"), F.collect_list("weight").alias("weights"))
    )
    # Groups without a draw near the grid have a density of zero.
    every = groups.join(sums, [*keys, "width", "n", "end", "parts"], "left")

    @F.pandas_udf("array<double>")
    def over_cells(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_convolved(*row, n) for row in zip(*batch)])

    density = over_cells("cells", "weights", "width", "n", "end", "parts")
    return every.select(*keys, "end", F.posexplode(density).alias("i", "density")).select(
        *keys, "i", (F.col("i") * step).alias("x"), "density"
    )


def _convolved(cells, weights, width: float, count: int, end: float, parts: int, n: int) -> np.ndarray:
    """The density on the grid's points from a group's cells."""
    out = np.zeros(n)
    if cells is None:
        return out
    step = end / (n - 1)
    x = np.arange(n) * step
    middle = np.asarray(cells, dtype=float) * (step / parts)
    share = np.asarray(weights) / (count * width * np.sqrt(2 * np.pi))
    order = np.argsort(middle)
    # A stretch of cells at a time, with the grid's points that it reaches.
    for part in np.array_split(order, -(-len(order) // 1024)):
        first, last = np.searchsorted(x, (middle[part[0]] - REACH * width, middle[part[-1]] + REACH * width))
        z = (x[first:last, None] - middle[part]) / width
        out[first:last] += np.exp(-0.5 * z * z) @ share[part]
    return out


def new_sensor_density(effects: DataFrame, n: int = 512) -> DataFrame:
    """Density of each plotted quantity at a sensor without ground counts, on its grid.

    ``effects`` has the Normal effects by variant. The quantity is a transformed effect,
    an inverse logit or an exponential, so its density is exact: that of the effect where
    the transformation comes from, times the slope there. At the ends it is zero.
    """
    # The variant and the effect behind each quantity.
    sources = [
        ("p_false_zero", "d", "theta"),
        ("false_zero_mean_weekday", "L_wk", "theta"),
        ("false_zero_mean_weekend", "L_wk", "both"),
        ("multiplier_weekday", "a_wk", "theta"),
        ("multiplier_weekend", "a_wk", "both"),
    ]
    x = F.col("x")
    parts = []
    for param, variant, effect in sources:
        end = GRID_ENDS[param]
        grid = effects.filter(F.col("variant") == variant).select(
            F.lit(param).alias("param"),
            F.col(f"{effect}_mean").alias("mean"),
            F.col(f"{effect}_sd").alias("sd"),
            F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"),
        )
        grid = grid.withColumn("x", F.col("i") * F.lit(end / (n - 1)))
        inner = (x > 0) & (x < 1) if param == "p_false_zero" else x > 0
        source = F.ln(x / (1 - x)) if param == "p_false_zero" else F.ln(x)
        slope = 1 / (x * (1 - x)) if param == "p_false_zero" else 1 / x
        z = (source - F.col("mean")) / F.col("sd")
        density = F.exp(-0.5 * z * z) / (F.col("sd") * F.sqrt(2 * F.pi())) * slope
        parts.append(grid.select("param", "i", "x", F.when(inner, density).otherwise(0.0).alias("density")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_fits(
    first: DataFrame, second: DataFrame, keys: Sequence[str] = ("param",)
) -> DataFrame:
    """Estimates of two fits side by side, with their difference."""
    a = first.select(*keys, F.col("estimate").alias("first"))
    b = second.select(*keys, F.col("estimate").alias("second"))
    return a.join(b, list(keys), "full_outer").withColumn(
        "difference", F.col("first") - F.col("second")
    )
