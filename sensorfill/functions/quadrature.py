"""Integrals over the effects of one sensor, many sensors at a time.

A sensor's log posterior is a sum over the two levels of its covariate and is concave:
events times the linear predictor, less exposure times its ``log(1 + exp)`` or ``exp``,
with a Normal prior on the effect and one on the covariate's. All functions work on
arrays with a row per sensor; those that return pandas UDFs are used by Spark on batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Log density, relative to the mode, beyond which nothing is left.
NEGLIGIBLE = -45.0
#: Cells of a grid that a distribution function is summed over.
CELLS = 1024


def gain(logistic, hits, size, eta, move):
    """Log-likelihood at ``eta + move`` less that at ``eta``, without cancellation."""
    odds = np.exp(np.clip(eta, -700.0, 700.0))
    with np.errstate(over="ignore", invalid="ignore"):
        by_log = np.log1p(odds / (1.0 + odds) * np.expm1(np.minimum(move, 700.0)))
        lost = np.where(logistic, by_log, odds * np.expm1(np.minimum(move, 700.0)))
    return hits * move - np.where(size > 0, size * lost, 0.0)


def prior_gain(mean, precision, value, move):
    """Log prior at ``value + move`` less that at ``value``."""
    return -precision * move * ((value - mean) + 0.5 * move)


def laplace_correction(nodes: int = 25, nodes_2d: int = 15):
    """Pandas UDF: log of the integral over a sensor's effects less Laplace's value.

    Gauss-Hermite quadrature around the mode, scaled by the curvature there: with the
    covariate's effect (``beta_var`` > 0) on a grid turned along the covariance.
    """

    def correct(logistic, h0, s0, h1, s1, m, p, mc, pc, theta, beta, theta_var, beta_var, cov):
        logistic = np.asarray(logistic, dtype=bool)[:, None]
        h0, s0, h1, s1, m, p, mc, pc, theta, beta, tv, bv, cv = (
            np.asarray(c, dtype=float)[:, None]
            for c in (h0, s0, h1, s1, m, p, mc, pc, theta, beta, theta_var, beta_var, cov)
        )
        out = np.zeros(len(theta))
        for both in (False, True):
            rows = np.flatnonzero((bv[:, 0] > 0) == both)
            if not len(rows):
                continue
            x, w = np.polynomial.hermite.hermgauss(nodes_2d if both else nodes)
            y, log_w = np.zeros_like(x), np.log(w / math.sqrt(math.pi)) + x * x
            if both:
                x, y = (a.ravel() for a in np.meshgrid(x, x))
                log_w = (log_w[:, None] + log_w[None, :]).ravel()
            lg, a0, n0, a1, n1, mm, pp, mb, pb, t, b, v, vb, c = (
                column[rows] for column in (logistic, h0, s0, h1, s1, m, p, mc, pc, theta, beta, tv, bv, cv)
            )
            sd = np.sqrt(v)
            dt = math.sqrt(2) * sd * x
            db = math.sqrt(2) * (c / sd * x + np.sqrt(np.maximum(vb - c * c / v, 0.0)) * y) if both else 0.0 * dt
            total = gain(lg, a0, n0, t, dt) + gain(lg, a1, n1, t + b, dt + db)
            total += prior_gain(mm, pp, t, dt) + prior_gain(mb, pb, b, db) + log_w
            top = total.max(axis=1)
            out[rows] = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
        return pd.Series(out)

    return F.pandas_udf(correct, "double")


def _reach(log_density, sd: np.ndarray, side: float) -> np.ndarray:
    """How far from the mode, on one side, the log density falls to ``NEGLIGIBLE``."""
    far = 8.0 * sd
    for _ in range(60):
        short = log_density(side * far) > NEGLIGIBLE
        if not short.any():
            break
        far = np.where(short, 2.0 * far, far)
    near = np.zeros_like(far)
    for _ in range(20):
        middle = 0.5 * (near + far)
        inside = log_density(side * middle) > NEGLIGIBLE
        near, far = np.where(inside, middle, near), np.where(inside, far, middle)
    return side * far


def invert(log_density, sd: np.ndarray, u: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Moves from the mode at which the distribution function reaches ``u`` (row, draw).

    ``log_density`` takes moves from the mode as (row,) or (row, place) arrays. A cell's
    share is integrated by Simpson's rule; inside a cell the density is a parabola.
    """
    low, high = (_reach(log_density, sd, side) for side in (-1.0, 1.0))
    at = low[:, None] + (high - low)[:, None] * np.linspace(0.0, 1.0, 2 * cells + 1)
    f = np.exp(np.maximum(log_density(at), -700.0))
    left, middle, right = f[:, :-2:2], f[:, 1::2], f[:, 2::2]
    total = np.cumsum((left + 4.0 * middle + right) / 6.0, axis=1)
    wanted = u * total[:, -1:]
    out = np.empty_like(wanted)
    for row in range(len(wanted)):
        cell = np.minimum(np.searchsorted(total[row], wanted[row]), cells - 1)
        rest = wanted[row] - np.where(cell > 0, total[row, cell - 1], 0.0)
        a, mid, c = left[row, cell], middle[row, cell], right[row, cell]
        b, c = -3.0 * a + 4.0 * mid - c, 2.0 * a - 4.0 * mid + 2.0 * c
        lo, hi = np.zeros(len(cell)), np.ones(len(cell))
        t = np.clip(rest / np.maximum((a + 4.0 * mid + right[row, cell]) / 6.0, 1e-300), 0.0, 1.0)
        for _ in range(40):
            over = t * (a + t * (b / 2.0 + t * c / 3.0)) - rest
            lo, hi = np.where(over < 0, t, lo), np.where(over >= 0, t, hi)
            slope = a + t * (b + t * c)
            step = t - over / np.where(slope > 0, slope, np.inf)
            t = np.where((step > lo) & (step < hi) & (slope > 0), step, 0.5 * (lo + hi))
        out[row] = low[row] + (high - low)[row] * (cell + t) / cells
    return out


def _mode(logistic, hits, size, mean, precision):
    """Mode and sd of the effect behind one count with a Normal prior."""
    own = np.log((hits + 0.5) / np.where(logistic, size - hits + 0.5, size + 0.5))
    weight = np.where(logistic, size / 4.0, hits)
    eta = (precision * mean + weight * own) / (precision + weight)
    for _ in range(200):
        odds = np.exp(np.clip(eta, -700.0, 700.0))
        fitted = size * np.where(logistic, odds / (1.0 + odds), odds)
        curve = np.where(logistic, fitted / (1.0 + odds), fitted) + precision
        move = np.clip((hits - fitted - precision * (eta - mean)) / curve, -2.0, 2.0)
        eta = eta + move
        if np.abs(move).max(initial=0.0) < 1e-12:
            break
    return eta, 1.0 / np.sqrt(curve)


def inverse_cdf(logistic, hits, size, mean, precision, u, cells: int = CELLS) -> np.ndarray:
    """Quantiles at ``u`` (row, draw) of the effect behind one count each."""
    eta, sd = _mode(logistic, hits, size, mean, precision)

    def log_density(move):
        lg, h, n, m, p, e = (
            x[:, None] if move.ndim == 2 else x for x in (logistic, hits, size, mean, precision, eta)
        )
        return gain(lg, h, n, e, move) + prior_gain(m, p, e, move)

    return eta[:, None] + invert(log_density, sd, u, cells)


def _both_draws(logistic, h0, s0, h1, s1, m, p, mc, pc, theta, sd, u1, u2):
    """Draws of (theta, beta) of one sensor: theta from its marginal, beta given theta."""

    def log_marginal(move):
        t = (theta + move).ravel()
        same = np.ones(len(t))
        # Given theta, the other level's predictor has a Normal prior around theta + mc.
        eta, spread = _mode(logistic, h1 * same, s1 * same, t + mc, pc * same)
        x, w = np.polynomial.hermite.hermgauss(21)
        d = math.sqrt(2) * spread[:, None] * x
        inner = gain(logistic, h1, s1, eta[:, None], d) + prior_gain((t + mc)[:, None], pc, eta[:, None], d)
        inner = np.log(np.exp(inner + x * x) @ w) + np.log(spread)
        at_mode = h1 * eta - s1 * np.where(logistic, np.logaddexp(0.0, eta), np.exp(np.minimum(eta, 700.0)))
        inner += at_mode - 0.5 * pc * (eta - t - mc) ** 2
        own = gain(logistic, h0, s0, theta, t - theta) + prior_gain(m, p, theta, t - theta)
        return (inner + own).reshape(move.shape)

    base = log_marginal(np.zeros(1))[0]
    drawn = theta + invert(lambda x: log_marginal(x) - base, np.array([sd]), u1[None, :], 256)[0]
    same = np.ones(len(drawn))
    eta = inverse_cdf(np.full(len(drawn), logistic), h1 * same, s1 * same, drawn + mc, pc * same, u2[:, None], 128)
    return drawn, eta[:, 0] - drawn


def exact_draws():
    """Pandas UDF: draws of (theta, beta) from the posterior of each sensor, as arrays.

    ``u1`` and ``u2`` are arrays of numbers between 0 and 1. Without the covariate's
    effect (``beta_var`` = 0) beta is one 0.
    """

    def draw(logistic, h0, s0, h1, s1, m, p, mc, pc, theta, theta_var, beta_var, u1, u2):
        logistic = np.asarray(logistic, dtype=bool)
        numbers = [np.asarray(c, dtype=float) for c in (h0, s0, h1, s1, m, p, mc, pc, theta, theta_var)]
        thetas: list = [None] * len(logistic)
        betas: list = [np.zeros(1)] * len(logistic)
        plain = np.asarray(beta_var, dtype=float) == 0
        for i in np.flatnonzero(~plain):
            *sums, tv = (c[i] for c in numbers)
            thetas[i], betas[i] = _both_draws(logistic[i], *sums, math.sqrt(tv), np.asarray(u1[i]), np.asarray(u2[i]))
        rows = np.flatnonzero(plain)
        for some in np.array_split(rows, max(1, len(rows) // 256)):
            if len(some):
                a0, n0, mean, precision = (numbers[k][some] for k in (0, 1, 4, 5))
                u = np.stack([np.asarray(u1[i], dtype=float) for i in some])
                for i, t in zip(some, inverse_cdf(logistic[some], a0, n0, mean, precision, u)):
                    thetas[i] = t
        return pd.DataFrame({"theta": thetas, "beta": betas})

    return F.pandas_udf(draw, "theta array<double>, beta array<double>")
