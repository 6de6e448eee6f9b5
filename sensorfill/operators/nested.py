"""The hyperparameters' own uncertainty, and posteriors that are not Normal.

``hyper_grid`` explores the marginal posterior of the hyperparameters around its mode on a
grid turned along its covariance and weights the points; ``mixed_vectors`` draws the
sensors' effects from the mixture of their posteriors over the points. ``exact_vectors``
and ``sensor_quantiles`` invert a sensor's own posterior instead of taking it as Normal,
which it is not with few pairs. The effects come as arrays, one row per sensor.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.functions.draws import key_digest, key_uniforms, uniform
from sensorfill.functions.quadrature import exact_draws
from sensorfill.operators import model as M
from sensorfill.operators.scale import default_tasks, materialize
from sensorfill.operators.vectors import normal_vectors

#: Steps of the grid, in standard deviations, by the number of hyperparameters, and how
#: far it reaches; of the differences that its covariance comes from.
GRID_STEP, GRID_REACH, DIFFERENCE = {2: 0.75, 4: 1.5}, 3.0, 0.1
_GRID = "variant string, point int, m double, p double, m_cov double, p_cov double, weight double"


def _digits(x: float, n: int = 2) -> float:
    """``x`` to ``n`` significant digits."""
    return round(x, n - 1 - math.floor(math.log10(abs(x)))) if x else 0.0


def _axes(hessian: np.ndarray) -> np.ndarray:
    """Lower triangular: steps of one standard deviation, to two digits."""
    curve, turn = np.linalg.eigh(-hessian)
    # A direction that the data leave open gets a wide step, and the bounds end it.
    covariance = (turn / np.maximum(curve, 0.1)) @ turn.T
    return np.vectorize(_digits)(np.linalg.cholesky(covariance))


def hyper_grid(effects: DataFrame, fit: DataFrame, nodes: int = 0) -> DataFrame:
    """Weighted hyperparameters: ``(variant, point, m, p, m_cov, p_cov, weight)``.

    The grid begins at the fitted mode, rounded, as it need not sit on it; its axes are
    the Cholesky factor of the covariance. Points beyond the bounds of the fit are left
    out. Two jobs for all variants; ``nodes`` as in ``model.marginal_at``.
    """
    # A row for each variant.
    fitted = {r["variant"]: r for r in fit.collect()}
    effects = effects.filter(F.col("variant").isin(*fitted))
    effects = materialize(effects.repartition(default_tasks(effects.sparkSession), *S.SENSOR))
    centre, at = {}, {}
    for v, r in fitted.items():
        x = [r["m"], math.log(r["p"])] + ([r["m_cov"], math.log(r["p_cov"])] if "_" in v else [])
        errors = [r["m_se"], r["log_p_se"], r["m_cov_se"], r["log_p_cov_se"]]
        digits = [max(2, -math.floor(math.log10(e))) if e else 2 for e in errors]
        centre[v] = np.array([round(value, d) for value, d in zip(x, digits)])
    found = M.marginal_at(effects, {v: M.stencil(x, DIFFERENCE) for v, x in centre.items()}, nodes)
    for v, x in centre.items():
        step, n = GRID_STEP[len(x)], len(x)
        axes = _axes(M.differences(found[v], n, DIFFERENCE)[1])
        cells = int(GRID_REACH / step)
        places = itertools.product(range(-cells, cells + 1), repeat=n)
        moves = [np.array(z) * step for z in places if sum(i * i for i in z) <= cells * cells]
        points = [x + axes @ z for z in moves]
        at[v] = [y for y in points if np.array_equal(M.within(y), y)] or [M.within(x)]
    values = M.marginal_at(effects, at, nodes)
    rows = []
    for v, points in at.items():
        weight = np.exp(np.array(values[v]) - max(values[v]))
        for i, (y, w) in enumerate(zip(points, weight / weight.sum())):
            rows.append((v, i, *M.as_row(v, y)[1:], float(w)))
    return effects.sparkSession.createDataFrame(rows, _GRID)


def _pivot(drawn: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Rows (sensor, variant, theta, beta) of arrays as one row per sensor."""
    picks = []
    for variant in chosen:
        effect, here = variant.split("_")[0], F.col("variant") == variant
        picks.append(F.first(F.when(here, F.col("theta")), ignorenulls=True).alias(effect))
        picks.append(F.first(F.when(here, F.col("beta")), ignorenulls=True).alias(f"{effect}_cov"))
    return drawn.groupBy(*S.SENSOR).agg(*picks)


def _effect() -> Column:
    return F.substring_index("variant", "_", 1)


def mixed_vectors(effects: DataFrame, grid: DataFrame, model: int, n_draws: int, seed: int = 1) -> DataFrame:
    """Draws of a model's effects with the hyperparameters drawn too.

    Each draw takes a point of the grid for every effect, by its weight and for all
    sensors alike, and draws the sensors' effects around their modes at that point.
    """
    chosen = M.MODELS[model]
    grid = grid.filter(F.col("variant").isin(*chosen))
    weights: dict[str, list[float]] = {}
    # Some dozens of points for each of the three effects.
    for r in grid.orderBy("variant", "point").collect():
        weights.setdefault(r["variant"], []).append(r["weight"])
    picks = []
    for v, w in weights.items():
        ends = np.cumsum(w)[:-1]
        u, _ = key_uniforms(seed, ("hyper", v), n_draws)
        picks.append((v, [int(i) for i in np.searchsorted(ends, u)]))
    picks = effects.sparkSession.createDataFrame(picks, "variant string, picks array<int>")
    wanted = effects.filter(F.col("variant").isin(*chosen))
    modes = M.with_modes(wanted.join(F.broadcast(grid), "variant"))
    at_point = F.struct("point", "theta", "beta", "theta_var", "beta_var", "cov")
    by_sensor = modes.groupBy("variant", *S.SENSOR).agg(F.array_sort(F.collect_list(at_point)).alias("at"))
    by_sensor = by_sensor.join(F.broadcast(picks), "variant")
    z = normal_vectors(seed, _effect(), n_draws)

    def theta(k: Column, z: Column) -> Column:
        x = F.get("at", k)
        return x["theta"] + F.sqrt(x["theta_var"]) * z["z1"]

    def beta(k: Column, z: Column) -> Column:
        x = F.get("at", k)
        left = F.sqrt(F.greatest(x["beta_var"] - x["cov"] * x["cov"] / x["theta_var"], F.lit(0.0)))
        return F.when(x["beta_var"] > 0, x["beta"] + x["cov"] / F.sqrt(x["theta_var"]) * z["z1"] + left * z["z2"]).otherwise(0.0)

    drawn = by_sensor.withColumn("_z", z).select(
        *S.SENSOR, "variant", F.zip_with("picks", "_z", theta).alias("theta"), F.zip_with("picks", "_z", beta).alias("beta")
    )
    return _pivot(drawn, chosen)


def _exact(modes: DataFrame, u1: Column, u2: Column) -> DataFrame:
    """(variant, sensor, theta, beta): arrays of quantiles of each row's posterior."""
    columns = [F.col(c) for c in ("hits_0", "size_0", "hits_1", "size_1", *M.HYPER, "theta", "theta_var", "beta_var")]
    # Few rows, much work on each.
    spread = modes.repartition(default_tasks(modes.sparkSession), *S.SENSOR, "variant")
    found = spread.withColumn("_x", exact_draws()(F.col("variant").startswith("d"), *columns, u1, u2))
    return found.select("variant", *S.SENSOR, F.col("_x.theta").alias("theta"), F.col("_x.beta").alias("beta"))


def exact_vectors(modes: DataFrame, model: int, n_draws: int, seed: int = 1) -> DataFrame:
    """Draws of a model's effects from the exact posterior of each sensor, as arrays.

    ``modes`` are ``model.effect_modes``. The uniform numbers behind a draw are those
    that ``model.draw_parameters`` makes its Normal ones from.
    """
    chosen = M.MODELS[model]
    draws = F.sequence(F.lit(1), F.lit(n_draws))

    def lane(i: int) -> Column:
        return F.transform(
            draws, lambda k: uniform(key_digest(seed, _effect(), F.col("site_id"), F.col("location"), k), i)
        )

    return _pivot(_exact(modes.filter(F.col("variant").isin(*chosen)), lane(0), lane(1)), chosen)


def sensor_quantiles(modes: DataFrame, at: Sequence[float] = (0.025, 0.25, 0.5, 0.75, 0.975)) -> DataFrame:
    """Quantiles of the exact posterior of every effect without its covariate.

    ``(variant, sensor, p, exact, normal)``: beside each the quantile of the Normal
    distribution around the mode.
    """
    from statistics import NormalDist

    plain = modes.filter(~F.col("variant").contains("_"))
    u = F.array(*[F.lit(float(p)) for p in at])
    found = _exact(plain, u, u).select("variant", *S.SENSOR, "theta")
    normal = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in at])
    both = found.join(plain.select("variant", *S.SENSOR, F.col("theta").alias("_mode"), "theta_var"), ["variant", *S.SENSOR])
    rows = both.select("variant", *S.SENSOR, "_mode", "theta_var", F.explode(F.arrays_zip(u.alias("p"), F.col("theta").alias("exact"), normal.alias("z"))).alias("q"))
    return rows.select(
        "variant", *S.SENSOR, F.col("q.p").alias("p"), F.col("q.exact").alias("exact"),
        (F.col("_mode") + F.sqrt("theta_var") * F.col("q.z")).alias("normal"),
    )
