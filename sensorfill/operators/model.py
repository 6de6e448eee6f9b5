"""The calibration model, fitted from per-sensor sufficient statistics.

For a sensor with effects d, L, a (each optionally with a covariate part):

* a zero camera count is a false zero with probability ``invlogit(d)``; the
  covariate is the afternoon;
* the ground count at a false zero is Poisson with mean ``exp(L)``; the covariate
  is the weekend;
* the ground count at a positive camera count is Poisson with mean
  ``camera count * exp(a)``; the covariate is the weekend.

Each effect and each covariate part is Normal over sensors with a mean ``m`` and a
precision ``p``. The pairs are read once, into twelve sums per sensor; everything
after that works on a table with one row per sensor and effect.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.functions.draws import key_digest, normal_pair, uniform
from sensorfill.functions.numeric import invlogit, ln_factorial, log1p_exp, normal_logpdf
from sensorfill.functions.quadrature import laplace_correction
from sensorfill.operators.scale import default_tasks, lookup_join, materialize

# The effects, each without and with its covariate; the variants
# each of the eight models is made of; and the priors and bounds of every mean and
# precision.
VARIANTS = ("d", "d_tod", "L", "L_wk", "a", "a_wk")
MODELS = {
    1: ("d", "L", "a"),
    2: ("d", "L", "a_wk"),
    3: ("d", "L_wk", "a"),
    4: ("d_tod", "L", "a"),
    5: ("d", "L_wk", "a_wk"),
    6: ("d_tod", "L", "a_wk"),
    7: ("d_tod", "L_wk", "a"),
    8: ("d_tod", "L_wk", "a_wk"),
}
PRIOR_MEAN_SD = 2.0
PRIOR_PRECISION_SHAPE = 0.001
PRIOR_PRECISION_SCALE = 1000.0
MEAN_BOUNDS = (-5.0, 5.0)
PRECISION_BOUNDS = (1e-4, 1e5)

EFFECTS = ("d", "L", "a")
HYPER = ("m", "p", "m_cov", "p_cov")
SUMS = [
    f"{name}_{level}"
    for name in ("false_zeros", "zero_pairs", "fz_ground", "fz_rows", "pos_ground", "pos_cam")
    for level in (0, 1)
]


# --- sufficient statistics ------------------------------------------------------


def sensor_stats(
    pairs: DataFrame,
    sensors: DataFrame | None = None,
    season: tuple[int, int] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Twelve sums per sensor (and ``by``), for covariate level 0 and 1.

    ``sensors`` adds sensors without any pair, with sums of zero (and NULL ``by``). ``season`` names
    one (year, site_id) to take the false zeros' and the positives' counts from;
    the number of false zeros among zeros is always that of all pairs. One
    aggregation; a sensor with a third of the pairs is combined before the shuffle.
    """
    zero = (F.col("cam_count") == 0) & F.col("ground_count").isNotNull()
    false_zero = (F.col("cam_count") == 0) & (F.col("ground_count") > 0)
    positive = (F.col("cam_count") > 0) & F.col("ground_count").isNotNull()
    here = F.lit(True)
    if season is not None:
        here = (F.col("year") == season[0]) & (F.col("site_id") == season[1])
    ground, cam, one = F.col("ground_count"), F.col("cam_count"), F.lit(1)
    afternoon, weekend = F.col("time_of_day") - 1, F.col("weekend")
    parts = {
        "false_zeros": (false_zero, afternoon, one),
        "zero_pairs": (zero, afternoon, one),
        "fz_ground": (false_zero & here, weekend, ground),
        "fz_rows": (false_zero & here, weekend, one),
        "pos_ground": (positive & here, weekend, ground),
        "pos_cam": (positive & here, weekend, cam),
    }
    values = [
        F.when(rows & (level == x), value).otherwise(0).cast("bigint").alias(f"{name}_{x}")
        for name, (rows, level, value) in parts.items()
        for x in (0, 1)
    ]
    long = pairs.select(*by, "site_id", F.col("cam_location").alias("location"), *values)
    long = long.filter(F.col("location").isNotNull())
    if sensors is not None:
        none = [F.lit(0).cast("bigint").alias(name) for name in SUMS]
        long = long.unionByName(sensors.select(*[F.lit(None).alias(c) for c in by], *S.SENSOR, *none))
    return long.groupBy(*by, *S.SENSOR).agg(*[F.sum(name).alias(name) for name in SUMS])


def effect_table(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per sensor (and ``by``) and variant: events and exposure at either level.

    Without a covariate both levels count as level 0.
    """
    rows: list[Column] = []
    for effect, covariate, hits, size in (
        ("d", "tod", "false_zeros", "zero_pairs"),
        ("L", "wk", "fz_ground", "fz_rows"),
        ("a", "wk", "pos_ground", "pos_cam"),
    ):
        h0, h1, s0, s1 = (F.col(f"{c}_{x}").cast("double") for c in (hits, size) for x in (0, 1))
        none = F.lit(0.0)
        rows += [F.lit(effect), h0 + h1, s0 + s1, none, none]
        rows += [F.lit(f"{effect}_{covariate}"), h0, s0, h1, s1]
    return stats.select(
        *by, *S.SENSOR, F.stack(F.lit(6), *rows).alias("variant", "hits_0", "size_0", "hits_1", "size_1")
    )


def _is_logistic() -> Column:
    return F.col("variant").startswith("d")


def _has_covariate() -> Column:
    return F.col("variant").contains("_")


def _plug_in(hits: Column, size: Column) -> Column:
    """A sensor's own estimate, finite for any counts."""
    logit = F.ln((hits + 0.5) / (size - hits + 0.5))
    return F.when(_is_logistic(), logit).otherwise(F.ln((hits + 0.5) / (size + 0.5)))


def plug_in_estimates(effects: DataFrame) -> DataFrame:
    """Each sensor's own estimates, without pooling; NULL where it has no data."""
    level_0 = _plug_in(F.col("hits_0"), F.col("size_0"))
    level_1 = _plug_in(F.col("hits_1"), F.col("size_1"))
    has_0, has_1 = F.col("size_0") > 0, F.col("size_1") > 0
    return effects.select(
        *S.SENSOR,
        "variant",
        F.when(has_0, level_0).alias("theta"),
        F.when(has_0 & has_1, level_1 - level_0).alias("beta"),
    )


def start_hyper(effects: DataFrame) -> DataFrame:
    """Means and precisions of the plug-in estimates over sensors, per variant."""

    def precision(name: str) -> Column:
        spread = F.greatest(F.var_samp(name), F.lit(1e-4))
        return F.coalesce(1.0 / spread, F.lit(1.0))

    return (
        plug_in_estimates(effects)
        .groupBy("variant")
        .agg(
            F.coalesce(F.avg("theta"), F.lit(0.0)).alias("m"),
            precision("theta").alias("p"),
            F.coalesce(F.avg("beta"), F.lit(0.0)).alias("m_cov"),
            precision("beta").alias("p_cov"),
        )
    )


# --- posterior modes ------------------------------------------------------------


def _terms(theta: Column, beta: Column) -> list[Column]:
    """Log-likelihood and curvature of a sensor's effect, at both levels."""
    logistic = _is_logistic()
    out = []
    for x, eta in ((0, theta), (1, theta + beta)):
        hits, size = F.col(f"hits_{x}"), F.col(f"size_{x}")
        prob = invlogit(eta)
        fitted = size * F.when(logistic, prob).otherwise(F.exp(eta))
        curve = F.when(logistic, fitted * (1 - prob)).otherwise(fitted)
        out += [hits * eta - F.when(logistic, size * log1p_exp(eta)).otherwise(fitted), curve]
    return out


def _best(x: int) -> tuple[Column, Column, Column]:
    """Whether level ``x`` has an inner best value, that value, and the share of hits."""
    hits, size = F.col(f"hits_{x}"), F.col(f"size_{x}")
    inner = (hits > 0) & (~_is_logistic() | (hits < size))
    rest = F.when(_is_logistic(), size - hits).otherwise(size)
    value = F.when(inner, F.ln(F.try_divide(hits, rest)))
    return inner, value, F.try_divide(hits, size)


def _best_loglik() -> Column:
    """Largest log-likelihood a sensor's own values could reach, both levels."""
    total = F.lit(0.0)
    for x in (0, 1):
        hits, size = F.col(f"hits_{x}"), F.col(f"size_{x}")
        inner, value, _ = _best(x)
        at_best = hits * value - F.when(_is_logistic(), size * log1p_exp(value)).otherwise(hits)
        total = total + F.when(inner, at_best).otherwise(0.0)
    return total


def _shortfall(theta: Column, beta: Column) -> Column:
    """Log-likelihood at (theta, beta) less ``_best_loglik``, without cancellation.

    The two are as large as the number of rows, their difference is not: sums of
    it over sensors keep their digits whatever the size of the data.
    """
    logistic, total = _is_logistic(), F.lit(0.0)
    for x, eta in ((0, theta), (1, theta + beta)):
        hits, size = F.col(f"hits_{x}"), F.col(f"size_{x}")
        inner, value, share = _best(x)
        move = eta - value
        lost = F.when(logistic, size * F.log1p(share * F.expm1(move))).otherwise(
            hits * F.expm1(move)
        )
        # All or no hits: nothing large to subtract.
        plain = hits * eta - F.when(logistic, size * log1p_exp(eta)).otherwise(size * F.exp(eta))
        all_hits = logistic & (hits > 0) & (hits == size)
        plain = F.when(all_hits, -size * log1p_exp(-eta)).otherwise(plain)
        total = total + F.when(inner, hits * move - lost).otherwise(plain)
    return total


def _newton():
    """Pandas UDF: the posterior mode (theta, beta) of each row.

    Newton's method for all rows of a batch at once, at most two units a step,
    until no row moves. A row that still moves after ``steps`` steps is an error. Written as a nested column expression the same steps were
    much slower, for want of shared terms.
    """

    # Nested, so that the function is shipped whole to the Python workers.
    def solve(logistic, hits_0, size_0, hits_1, size_1, m, p, m_cov, p_cov):
        import numpy as np
        import pandas as pd

        logistic = np.asarray(logistic, dtype=bool)
        h0, s0, h1, s1, m, p, mc, pc = (
            np.asarray(c, dtype=float) for c in (hits_0, size_0, hits_1, size_1, m, p, m_cov, p_cov)
        )

        def fitted(size, eta):
            odds = np.exp(np.clip(eta, -700.0, 700.0))
            prob = odds / (1.0 + odds)
            mean = size * np.where(logistic, prob, odds)
            return mean, np.where(logistic, mean * (1.0 - prob), mean)

        hits, size = h0 + h1, s0 + s1
        own = np.log((hits + 0.5) / np.where(logistic, size - hits + 0.5, size + 0.5))
        weight = np.where(logistic, size / 4.0, hits)
        theta, beta = (p * m + weight * own) / (p + weight), mc.copy()
        steps, still = 200, 0.0
        for _ in range(steps):
            mean_0, curve_0 = fitted(s0, theta)
            mean_1, curve_1 = fitted(s1, theta + beta)
            to_beta = h1 - mean_1 - pc * (beta - mc)
            to_theta = h0 - mean_0 + h1 - mean_1 - p * (theta - m)
            a, b, c = curve_0 + curve_1 + p, curve_1, curve_1 + pc
            det = a * c - b * b
            move_theta = np.clip((c * to_theta - b * to_beta) / det, -2.0, 2.0)
            move_beta = np.clip((a * to_beta - b * to_theta) / det, -2.0, 2.0)
            theta, beta = theta + move_theta, beta + move_beta
            still = max(np.abs(move_theta).max(initial=0), np.abs(move_beta).max(initial=0))
            if still < 1e-12:
                break
        # Rounding keeps the last digits moving where counts are very large.
        if not still < 1e-3:
            raise RuntimeError(f"a posterior mode still moves by {still} after {steps} steps")
        return pd.DataFrame({"theta": theta, "beta": beta})

    return F.pandas_udf(solve, "theta double, beta double")


def with_modes(effects: DataFrame) -> DataFrame:
    """Add the posterior mode, its covariance and the Laplace log evidence.

    The evidence is relative to ``_best_loglik``, which no hyperparameter enters.
    ``effects`` carries the hyperparameters ``m, p, m_cov, p_cov`` on each row.
    Without a covariate beta stays at its mean and adds nothing.
    """
    m, p, mc, pc = (F.col(c) for c in HYPER)
    counts = [F.col(c) for c in ("hits_0", "size_0", "hits_1", "size_1")]
    out = effects.withColumn("_mode", _newton()(_is_logistic(), *counts, m, p, mc, pc))
    out = out.withColumns({"theta": F.col("_mode.theta"), "beta": F.col("_mode.beta")})
    theta, beta = F.col("theta"), F.col("beta")
    _, c0, _, c1 = _terms(theta, beta)
    htt, htb, hbb = c0 + c1 + p, c1, c1 + pc
    det = c0 * hbb + p * hbb + c1 * pc
    evidence = (
        _shortfall(theta, beta)
        + 0.5 * F.ln(p) - 0.5 * p * F.pow(theta - m, F.lit(2.0))
        + 0.5 * F.ln(pc) - 0.5 * pc * F.pow(beta - mc, F.lit(2.0))
        - 0.5 * F.ln(det)
    )
    return out.withColumns(
        {
            "theta_var": hbb / det,
            "beta_var": F.when(_has_covariate(), htt / det).otherwise(0.0),
            "cov": -htb / det,
            "log_evidence": evidence,
        }
    ).drop("_mode")


def effect_modes(effects: DataFrame, hyper: DataFrame) -> DataFrame:
    """Modes of every sensor and variant at given hyperparameters.

    Beta is 0 where the variant has no covariate.
    """
    six_rows = hyper.select(
        "variant",
        "m",
        "p",
        F.when(_has_covariate(), F.col("m_cov")).otherwise(0.0).alias("m_cov"),
        F.when(_has_covariate(), F.col("p_cov")).otherwise(1.0).alias("p_cov"),
    )
    return with_modes(effects.join(F.broadcast(six_rows), "variant"))


# --- fit ------------------------------------------------------------------------


def log_prior(point: Sequence[float], covariate: bool) -> float:
    """Log prior density of (m, ln p[, m_cov, ln p_cov])."""
    shape, scale = PRIOR_PRECISION_SHAPE, PRIOR_PRECISION_SCALE
    total = 0.0
    for m, log_p in zip(point[0 : 4 if covariate else 2 : 2], point[1::2]):
        total -= 0.5 * (m / PRIOR_MEAN_SD) ** 2 + math.log(PRIOR_MEAN_SD * math.sqrt(2 * math.pi))
        total += (shape - 1) * log_p - math.exp(log_p) / scale
        total -= math.lgamma(shape) + shape * math.log(scale)
    return total


def as_row(variant: str, point: Sequence[float]) -> tuple:
    full = [float(x) for x in point] + [0.0, 0.0]
    return (variant, full[0], math.exp(full[1]), full[2], math.exp(full[3]))


def marginal_at(
    effects: DataFrame, points: Mapping[str, Sequence[Sequence[float]]], nodes: int = 0
) -> dict[str, list[float]]:
    """Log marginal posterior of each variant at each of its points.

    By Laplace's method, or with ``nodes`` by adaptive Gauss-Hermite quadrature.
    Relative to the sum of ``_best_loglik``, a constant of the data. One job for all variants and points; one number per point comes back.
    """
    spark: SparkSession = effects.sparkSession
    rows = [(i, *as_row(v, x)) for v, xs in points.items() for i, x in enumerate(xs)]
    table = spark.createDataFrame(
        rows, "point int, variant string, m double, p double, m_cov double, p_cov double"
    )
    # Every sensor meets every trial point of its variant; the trial points are
    # made here, a few dozen of them.
    modes = with_modes(effects.join(F.broadcast(table), "variant"))
    evidence = F.col("log_evidence")
    if nodes:
        given = ("hits_0", "size_0", "hits_1", "size_1", *HYPER)
        columns = [F.col(c) for c in (*given, "theta", "beta", "theta_var", "beta_var", "cov")]
        evidence = evidence + laplace_correction(nodes)(_is_logistic(), *columns)
    sums = modes.groupBy("variant", "point").agg(F.sum(evidence).alias("total")).collect()
    found = {(r["variant"], r["point"]): r["total"] for r in sums}
    return {
        v: [found[v, i] + log_prior(x, "_" in v) for i, x in enumerate(xs)]
        for v, xs in points.items()
    }


def within(x: np.ndarray) -> np.ndarray:
    """The nearest point whose means and log precisions are within their bounds."""
    pair = list(zip(MEAN_BOUNDS, (math.log(b) for b in PRECISION_BOUNDS)))
    low, high = (np.tile(side, len(x) // 2) for side in pair)
    return np.clip(x, low, high)


def stencil(x: np.ndarray, h: float) -> list[np.ndarray]:
    """``x``, then the points around it that second differences need."""
    unit = np.eye(len(x)) * h
    points = [x]
    for e in unit:
        points += [x + e, x - e]
    for i, j in itertools.combinations(range(len(x)), 2):
        points += [x + unit[i] + unit[j], x - unit[i] - unit[j]]
    return points


def differences(f: Sequence[float], n: int, h: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian from the values at ``stencil``."""
    up, down = np.array(f[1 : 1 + 2 * n : 2]), np.array(f[2 : 2 + 2 * n : 2])
    gradient = (up - down) / (2 * h)
    hessian = np.diag((up - 2 * f[0] + down) / h**2)
    for k, (i, j) in enumerate(itertools.combinations(range(n), 2)):
        both = f[1 + 2 * n + 2 * k] + f[2 + 2 * n + 2 * k]
        mixed = (both - up[i] - down[i] - up[j] - down[j] + 2 * f[0]) / (2 * h**2)
        hessian[i, j] = hessian[j, i] = mixed
    return gradient, hessian


Point = Sequence[float]


def climb(
    start: Mapping[str, Point],
    evaluate: Callable[[Mapping[str, Sequence[Point]]], Mapping[str, Sequence[float]]],
    tolerance: float,
    max_rounds: int,
    h: float,
) -> dict[str, tuple[np.ndarray, float | None, np.ndarray | None, bool]]:
    """Newton's method on several functions at once, all values of a round in one call.

    Derivatives are differences of values. Each round tries the full step, with the
    points its differences need, and shorter ones. Returns for every function the
    point, the value there, the Hessian and whether the search has converged.
    """
    scales = (1.0, 0.3, 0.05)
    now = {v: within(np.array(x, dtype=float)) for v, x in start.items()}
    moves = {v: np.zeros(len(x)) for v, x in now.items()}
    value = dict.fromkeys(now, -math.inf)
    hessians: dict[str, np.ndarray | None] = dict.fromkeys(now)
    done = set()
    for _ in range(max_rounds):
        open_ = [v for v in now if v not in done]
        if not open_:
            break
        found = evaluate(
            {
                v: stencil(now[v] + moves[v], h) + [now[v] + s * moves[v] for s in scales[1:]]
                for v in open_
            }
        )
        for v in open_:
            n, f = len(now[v]), np.nan_to_num(found[v], nan=-math.inf)
            tries = [f[0], *f[len(f) - len(scales) + 1 :]]
            best = int(np.argmax(tries))
            if tries[best] < value[v]:  # nothing better this way: look closer
                moves[v] = moves[v] * scales[-1]
            elif best > 0:  # differences are known at the full step only
                now[v], value[v] = now[v] + scales[best] * moves[v], -math.inf
                moves[v] = np.zeros(n)
                continue
            else:
                now[v], value[v] = now[v] + moves[v], tries[0]
                gradient, hessians[v] = differences(f, n, h)
                moves[v] = _uphill(now[v], gradient, hessians[v])
            if np.abs(moves[v]).max() < tolerance:
                done.add(v)
    return {
        v: (now[v], value[v] if math.isfinite(value[v]) else None, hessians[v], v in done)
        for v in now
    }


def _uphill(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """A Newton step that goes uphill along every axis, within the bounds.

    Coordinates that sit at a bound and want to leave it are held there.
    """
    free = within(x + np.sign(gradient) * 1e-9) != x
    move = np.zeros(len(x))
    if free.any():
        curve, axes = np.linalg.eigh(-hessian[np.ix_(free, free)])
        step = axes @ ((axes.T @ gradient[free]) / np.maximum(np.abs(curve), 1e-3))
        move[free] = step * min(1.0, 1.5 / max(np.abs(step).max(), 1e-300))
    return within(x + move) - x


def fit_hierarchical(
    effects: DataFrame,
    variants: Sequence[str] = VARIANTS,
    tolerance: float = 1e-5,
    max_rounds: int = 60,
    h: float = 1e-3,
    nodes: int = 0,
) -> DataFrame:
    """Hyperparameters at the maximum of the marginal posterior.

    The sensor effects are integrated out by Laplace's method, or with ``nodes`` by
    adaptive Gauss-Hermite quadrature, as they are independent given the hyperparameters; Newton's method on (m, ln p) does the
    rest. The likelihood separates over effects, so all variants, and with them
    all eight models, are fitted in the same jobs. Only one number per trial point
    reaches the driver. Too few sensors with data leave a precision undecided; it
    then ends at a bound.

    Returns a row per variant: the estimates, standard errors of the means and of
    the log precisions, the log marginal and whether the search converged.
    """
    # A set number of partitions: the rows are few, the work on each is not.
    tasks = default_tasks(effects.sparkSession)
    wanted = effects.filter(F.col("variant").isin(*variants))
    effects = materialize(wanted.repartition(tasks, *S.SENSOR))
    constants = {
        r["variant"]: r["total"]
        for r in effects.groupBy("variant").agg(F.sum(_best_loglik()).alias("total")).collect()
    }
    start = {}
    for row in start_hyper(effects).collect():  # one row per variant
        start[row["variant"]] = [row["m"], math.log(row["p"])]
        if "_" in row["variant"]:
            start[row["variant"]] += [row["m_cov"], math.log(row["p_cov"])]
    found = climb(start, lambda points: marginal_at(effects, points, nodes), tolerance, max_rounds, h)
    rows = []
    for v, (x, value, hessian, converged) in sorted(found.items()):
        errors: list[float | None] = [None] * 4
        if hessian is not None:
            for i, variance in enumerate(np.diag(np.linalg.pinv(-hessian))):
                errors[i] = float(math.sqrt(variance)) if variance > 0 else None
        total = None if value is None else float(value) + constants[v]
        rows.append((*as_row(v, x), *errors, total, converged))
    return effects.sparkSession.createDataFrame(
        rows,
        "variant string, m double, p double, m_cov double, p_cov double, m_se double, "
        "log_p_se double, m_cov_se double, log_p_cov_se double, log_marginal double, "
        "converged boolean",
    )


# --- parameters -----------------------------------------------------------------


def sensor_params(modes: DataFrame, model: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """One row per sensor (and ``by``) with the three effects of a model.

    For effect ``e``: ``e``, ``e_cov`` and the variances and covariance of the two.
    """
    chosen = MODELS[model]
    picks = []
    for variant in chosen:
        effect, here = variant.split("_")[0], F.col("variant") == variant
        for column, name in (
            ("theta", effect), ("beta", f"{effect}_cov"), ("theta_var", f"{effect}_var"),
            ("beta_var", f"{effect}_cov_var"), ("cov", f"{effect}_cross"),
        ):
            picks.append(F.max(F.when(here, F.col(column))).alias(name))
    return modes.filter(F.col("variant").isin(*chosen)).groupBy(*by, *S.SENSOR).agg(*picks)


def standard_errors(params: DataFrame) -> DataFrame:
    """Standard errors of the effects and, by the delta method, of their transforms."""
    delta = invlogit(F.col("d"))
    lam, alpha = F.exp("L"), F.exp("a")
    se = {e: F.sqrt(f"{e}_var") for e in EFFECTS}
    return params.select(
        *S.SENSOR,
        *[F.col(e).alias(e) for e in EFFECTS],
        *[se[e].alias(f"{e}_se") for e in EFFECTS],
        delta.alias("p_false_zero"),
        (1 - delta).alias("p_true_zero"),
        (delta * (1 - delta) * se["d"]).alias("p_zero_se"),
        lam.alias("false_zero_mean"),
        (lam * se["L"]).alias("false_zero_mean_se"),
        alpha.alias("multiplier"),
        (alpha * se["a"]).alias("multiplier_se"),
    )


def positive_mean_errors(pairs: DataFrame, params: DataFrame) -> DataFrame:
    """Fitted mean of each positive pair, with its standard error."""
    location = F.col("cam_location")
    rows = pairs.filter(F.col("cam_count") > 0).withColumn("pair_location", F.col("location"))
    rows = rows.withColumn("location", location)
    mean = F.col("cam_count") * F.exp("a")
    return lookup_join(rows, params.select(*S.SENSOR, "a", "a_var"), S.SENSOR).select(
        "obs_seq", "cam_location", mean.alias("mean"), (mean * F.sqrt("a_var")).alias("mean_se")
    )


# --- log posterior and model choice ---------------------------------------------


def row_log_likelihood(
    pairs: DataFrame, true_zero_counts: DataFrame, params: DataFrame
) -> DataFrame:
    """Log-likelihood of each row of the three partitions: ``(sensor, part, loglik)``.

    Rows of ``true_zero_counts`` are binomial, the others Poisson.
    """
    zero = true_zero_counts.select(
        "site_id", F.col("cam_location").alias("location"), F.lit("zero").alias("part"),
        F.col("n_zero_cam").alias("size"), F.col("n_zero_eff").alias("count"),
    )
    counted = pairs.filter(F.col("ground_count").isNotNull()).select(
        "site_id",
        F.col("cam_location").alias("location"),
        F.when(F.col("cam_count") > 0, "positive").otherwise("false_zero").alias("part"),
        F.col("cam_count").cast("bigint").alias("size"),
        F.col("ground_count").cast("bigint").alias("count"),
    )
    counted = counted.filter((F.col("size") > 0) | ((F.col("size") == 0) & (F.col("count") > 0)))
    n, k = F.col("size"), F.col("count")
    choose = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
    binomial = choose + (n - k) * F.col("d") - n * log1p_exp(F.col("d"))
    log_mean = F.when(F.col("part") == "false_zero", F.col("L")).otherwise(
        F.col("a") + F.ln(F.greatest(n, F.lit(1)))
    )
    poisson = k * log_mean - F.exp(log_mean) - ln_factorial(k)
    known = params.select(*S.SENSOR, *EFFECTS)
    return lookup_join(zero.unionByName(counted), known, S.SENSOR).select(
        *S.SENSOR,
        "part",
        F.when(F.col("part") == "zero", binomial).otherwise(poisson).alias("loglik"),
    )


def log_posterior(
    row_loglik: DataFrame, params: DataFrame, hyper: DataFrame
) -> DataFrame:
    """Per sensor: log-likelihood of each part and log prior of its effects."""
    stacked: list[Column] = []
    for e in EFFECTS:
        stacked += [F.lit(e), F.col(e)]
    effects = params.select(
        *S.SENSOR, F.stack(F.lit(len(EFFECTS)), *stacked).alias("variant", "theta")
    )
    # Three rows, one per effect.
    density = normal_logpdf(F.col("theta"), F.col("m"), F.col("p"))
    prior = effects.join(F.broadcast(hyper.select("variant", "m", "p")), "variant").select(
        *S.SENSOR, F.lit("log_prior").alias("part"), density.alias("loglik")
    )
    return (
        row_loglik.unionByName(prior)
        .groupBy(*S.SENSOR)
        .agg(
            *[
                F.sum(F.when(F.col("part") == part, F.col("loglik")).otherwise(0.0)).alias(part)
                for part in ("zero", "false_zero", "positive", "log_prior")
            ]
        )
    )


def total_log_posterior(per_sensor: DataFrame, hyper: DataFrame) -> DataFrame:
    """The log posterior of model 1, with the prior of the hyperparameters."""
    shape, scale = PRIOR_PRECISION_SHAPE, PRIOR_PRECISION_SCALE
    at_mean = normal_logpdf(F.col("m"), F.lit(0.0), F.lit(PRIOR_MEAN_SD**-2))
    at_precision = (
        (shape - 1) * F.ln("p") - F.col("p") / scale
        - (math.lgamma(shape) + shape * math.log(scale))
    )
    hyper_prior = hyper.filter(F.col("variant").isin(*EFFECTS)).agg(F.sum(at_mean + at_precision))
    parts = per_sensor.agg(
        F.sum(F.col("zero") + F.col("false_zero") + F.col("positive")).alias("log_likelihood"),
        F.sum("log_prior").alias("log_prior"),
    )
    return parts.withColumn("log_hyper_prior", hyper_prior.scalar()).withColumn(
        "log_posterior",
        F.col("log_likelihood") + F.col("log_prior") + F.col("log_hyper_prior"),
    )


# --- draws ----------------------------------------------------------------------


def draw_effects(modes: DataFrame, n_draws: int, seed: int = 1, n_chains: int = 2) -> DataFrame:
    """Draws of (theta, beta) of every sensor and variant around its mode.

    Normal with the covariance of the mode. A draw depends on the seed, the
    sensor, the effect and the draw number alone; chains take turns.
    """
    spread = modes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    digest = key_digest(
        seed, F.col("variant"), F.col("site_id"), F.col("location"), F.col("draw")
    )
    spread = spread.withColumn("_d", digest)
    z1, z2 = normal_pair(uniform(F.col("_d"), 0), uniform(F.col("_d"), 1))
    sd = F.sqrt("theta_var")
    left = F.sqrt(F.greatest(F.col("beta_var") - F.col("cov") * F.col("cov") / F.col("theta_var"), F.lit(0.0)))
    covariate = F.col("beta") + F.col("cov") / sd * z1 + left * z2
    return spread.select(
        "variant",
        *S.SENSOR,
        "draw",
        ((F.col("draw") - 1) % n_chains + 1).alias("chain"),
        (F.col("theta") + sd * z1).alias("theta"),
        F.when(_has_covariate(), covariate).otherwise(0.0).alias("beta"),
    )


def model_draws(effect_draws: DataFrame, model: int = 1) -> DataFrame:
    """Draws of a model's effects, one row per sensor and draw."""
    chosen = MODELS[model]
    picks = []
    for variant in chosen:
        effect, here = variant.split("_")[0], F.col("variant") == variant
        picks.append(F.max(F.when(here, F.col("theta"))).alias(effect))
        picks.append(F.max(F.when(here, F.col("beta"))).alias(f"{effect}_cov"))
    return (
        effect_draws.filter(F.col("variant").isin(*chosen))
        .groupBy("chain", "draw", *S.SENSOR)
        .agg(*picks)
    )


def draw_parameters(params: DataFrame, n_draws: int, seed: int = 1, n_chains: int = 2) -> DataFrame:
    """Draws of one model's effects from its ``sensor_params``, without a shuffle."""
    spread = params.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    columns = []
    for e in EFFECTS:
        digest = key_digest(seed, F.lit(e), F.col("site_id"), F.col("location"), F.col("draw"))
        spread = spread.withColumn(f"_{e}", digest)
        z1, z2 = normal_pair(uniform(F.col(f"_{e}"), 0), uniform(F.col(f"_{e}"), 1))
        sd, cross = F.sqrt(f"{e}_var"), F.col(f"{e}_cross")
        left = F.sqrt(F.greatest(F.col(f"{e}_cov_var") - cross * cross / F.col(f"{e}_var"), F.lit(0.0)))
        covariate = F.col(f"{e}_cov") + cross / sd * z1 + left * z2
        columns += [
            (F.col(e) + sd * z1).alias(e),
            F.when(F.col(f"{e}_cov_var") > 0, covariate).otherwise(0.0).alias(f"{e}_cov"),
        ]
    chain = ((F.col("draw") - 1) % n_chains + 1).alias("chain")
    return spread.select(chain, "draw", *S.SENSOR, *columns)


def thin_draws(draws: DataFrame, burn: int, thin: int) -> DataFrame:
    """Leave out the first ``burn`` draws, then keep every ``thin``-th."""
    after = F.col("draw") - burn
    return draws.filter((after > 0) & (after % thin == 0))


def new_sensor_effects(hyper: DataFrame) -> DataFrame:
    """Mean and standard deviation of the effects of a sensor never seen against ground
    counts: Normal with the mean and the precision of the effect over sensors.

    ``theta`` is the plain effect, ``both`` its sum with the effect of the covariate.
    """
    covariate = F.when(_has_covariate(), F.lit(1.0)).otherwise(0.0)
    return hyper.select(
        "variant",
        F.col("m").alias("theta_mean"),
        (1 / F.sqrt("p")).alias("theta_sd"),
        (F.col("m") + covariate * F.col("m_cov")).alias("both_mean"),
        F.sqrt(1 / F.col("p") + covariate / F.col("p_cov")).alias("both_sd"),
    )


def hyper_estimates(fit: DataFrame) -> DataFrame:
    """``(param, estimate)``: the fitted means and log precisions in long form."""
    names = F.stack(F.lit(2), F.lit("m"), F.col("m"), F.lit("log_p"), F.ln("p")).alias("name", "estimate")
    return fit.select("variant", names).select(F.concat_ws(".", "variant", "name").alias("param"), "estimate")


def hyper_summary(fit: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Estimate, standard error and interval of each fitted hyperparameter, in long form.

    Those without a standard error, which the data leave undecided, are left out.
    """
    names = F.stack(
        F.lit(4),
        F.lit("m"), F.col("m"), F.col("m_se"),
        F.lit("log_p"), F.ln("p"), F.col("log_p_se"),
        F.lit("m_cov"), F.col("m_cov"), F.col("m_cov_se"),
        F.lit("log_p_cov"), F.ln("p_cov"), F.col("log_p_cov_se"),
    ).alias("name", "estimate", "error")
    long = fit.select("variant", names).filter(F.col("error").isNotNull())
    return long.select(
        F.concat_ws(".", "variant", "name").alias("param"),
        "estimate",
        "error",
        (F.col("estimate") - z * F.col("error")).alias("low"),
        (F.col("estimate") + z * F.col("error")).alias("high"),
    )


# --- model choice ---------------------------------------------------------------


def log_constants(pairs: DataFrame, true_zero_counts: DataFrame) -> DataFrame:
    """The part of the log-likelihood that no parameter enters, as one row."""
    n, k = F.col("n_zero_cam"), F.col("n_zero_eff")
    choose = true_zero_counts.select(
        (ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)).alias("c")
    )
    cam, ground = F.col("cam_count"), F.col("ground_count")
    counted = pairs.filter((cam > 0) | ((cam == 0) & (ground > 0))).select(
        (F.when(cam > 0, ground * F.ln(F.greatest(cam, F.lit(1)))).otherwise(0.0) - ln_factorial(ground)).alias("c")
    )
    return choose.unionByName(counted).agg(F.sum("c").alias("log_constant"))


def variant_deviance(effect_draws: DataFrame, effects: DataFrame) -> DataFrame:
    """Deviance of each variant at each draw, up to the constant."""
    joined = effect_draws.join(effects, ["variant", *S.SENSOR])
    v0, _, v1, _ = _terms(F.col("theta"), F.col("beta"))
    return joined.groupBy("variant", "draw").agg((-2.0 * F.sum(v0 + v1)).alias("deviance"))


def model_dic(deviance: DataFrame, constant: DataFrame) -> DataFrame:
    """DIC of the eight models: mean deviance plus half its variance over draws."""
    members = [(m, v) for m, variants in MODELS.items() for v in variants]
    table = deviance.sparkSession.createDataFrame(members, "model int, variant string")
    per_draw = (
        deviance.join(F.broadcast(table), "variant")
        .groupBy("model", "draw")
        .agg(F.sum("deviance").alias("deviance"))
    )
    return (
        per_draw.groupBy("model")
        .agg(
            F.avg("deviance").alias("_mean"),
            (F.var_samp("deviance") / 2).alias("p_effective"),
        )
        .withColumn("mean_deviance", F.col("_mean") - 2.0 * constant.scalar())
        .withColumn("dic", F.col("mean_deviance") + F.col("p_effective"))
        .drop("_mean")
    )


def best_model(dic: DataFrame) -> DataFrame:
    """The model with the smallest DIC; all of them if tied."""
    # One row per model, so a single ordered window is enough.
    by_dic = Window.orderBy("dic")
    return dic.withColumn("_rank", F.rank().over(by_dic)).filter("_rank = 1").drop("_rank")
