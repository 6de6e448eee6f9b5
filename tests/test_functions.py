import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorfill.functions import draws, numeric


def test_ln_factorial(spark):
    n = [0, 1, 2, 9, 10, 11, 25, 170, 10_000, 10**9]
    df = spark.createDataFrame([(v,) for v in n], "n long")
    got = [r[0] for r in df.select(numeric.ln_factorial(F.col("n"))).collect()]
    assert np.allclose(got, [math.lgamma(v + 1) for v in n], rtol=1e-13, atol=1e-12)


def test_log1p_exp_does_not_overflow(spark):
    df = spark.createDataFrame([(-800.0,), (-1.0,), (0.0,), (30.0,), (800.0,)], "x double")
    got = [r[0] for r in df.select(numeric.log1p_exp(F.col("x"))).collect()]
    assert np.allclose(got, [0.0, math.log1p(math.exp(-1)), math.log(2), 30.0, 800.0])


def test_uniforms_are_even_independent_and_fixed(spark):
    digest = draws.key_digest(3, F.col("id"))
    df = spark.range(20000).select(draws.uniform(digest, 0).alias("u"), draws.uniform(digest, 1).alias("v"))
    u, v = df.toPandas().to_numpy().T
    for x in (u, v):
        assert 0 < x.min() and x.max() < 1
        assert abs(x.mean() - 0.5) < 0.01 and abs(x.var() - 1 / 12) < 0.003
    assert abs(np.corrcoef(u, v)[0, 1]) < 0.02 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02
    again = spark.range(20000).repartition(17).select(draws.uniform(digest, 0).alias("u"))
    assert sorted(u) == sorted(again.toPandas()["u"])


def quantiles(spark, trials, p, mean, u1, u2):
    rows = [tuple(map(float, r)) for r in np.broadcast(trials, p, mean, u1, u2)]
    df = spark.createDataFrame([(int(t), *r) for t, *r in rows], "t long, p double, m double, u1 double, u2 double")
    return [r[0] for r in df.select(draws.thinned_poisson()("t", "p", "m", "u1", "u2")).collect()]


def pmf(n, p):
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


@pytest.mark.parametrize("mean", [0.0, 0.3, 4.0, 60.0, 480.0])
def test_poisson_quantile_is_exact(spark, mean):
    u = np.linspace(0.0005, 0.9995, 400)
    k = np.arange(0, int(mean + 15 * math.sqrt(mean) + 30))
    log = -mean + (k * math.log(mean) if mean else np.where(k, -np.inf, 0.0))
    cdf = np.cumsum(np.exp(log - np.array([math.lgamma(v + 1) for v in k])))
    assert quantiles(spark, 1, 1.0, mean, 0.5, u) == list(np.searchsorted(cdf, u))


@pytest.mark.parametrize("n,p", [(1, 0.3), (1, 0.8), (6, 0.5), (40, 0.93), (5, 0.0), (5, 1.0)])
def test_binomial_quantile_is_exact(spark, n, p):
    # A mean of 1e9 per hit shows the number of hits.
    u = np.linspace(0.0013, 0.9987, 200)
    hits = [round(c / 400) for c in quantiles(spark, n, p, 400.0, u, 0.5)]
    assert hits == [min(int(x), n) for x in np.searchsorted(np.cumsum(pmf(n, p)), u)]


@pytest.mark.parametrize("mean", [501.0, 5e4, 3e8])
def test_large_poisson_moments(spark, mean):
    u = (np.arange(20000) + 0.5) / 20000
    x = np.array(quantiles(spark, 1, 1.0, mean, 0.5, u), dtype=float)
    sd = math.sqrt(mean)
    assert abs(x.mean() - mean) < 0.01 * sd
    assert abs(x.std() / sd - 1) < 0.01
    assert abs((((x - mean) / sd) ** 3).mean() - 1 / sd) < 0.02


def test_large_binomial_moments(spark):
    u = (np.arange(4000) + 0.5) / 4000
    x = np.array(quantiles(spark, 10**7, 0.9, 1.0, u, 0.5), dtype=float)
    assert abs(x.mean() - 9e6) < 60 and abs(x.std() / math.sqrt(9e5) - 1) < 0.02


@pytest.mark.parametrize("mean", [501.0, 800.0, 5e3, 1e5, 5e6])
def test_large_poisson_quantile_is_exact(spark, mean):
    sd = math.sqrt(mean)
    low, high = max(0, int(mean - 9 * sd)), int(mean + 9 * sd)
    mode = int(mean)
    # From the mode outwards, so that no large logarithms cancel.
    up = np.cumsum(np.log(mean / np.arange(mode + 1, high)))
    down = np.cumsum(np.log(np.arange(mode, low, -1) / mean))[::-1]
    log = np.concatenate((down, [0.0], up))
    pmf = np.exp(log)
    cdf = np.cumsum(pmf) / pmf.sum()
    u = np.linspace(0.0003, 0.9997, 3000)
    # Where u is a value of the function but for rounding, either side will do.
    clear = np.abs(cdf[np.clip(np.searchsorted(cdf, u), 0, len(cdf) - 1)] - u) > 1e-12
    got = np.array(quantiles(spark, 1, 1.0, mean, 0.5, u))
    assert (got == low + np.searchsorted(cdf, u))[clear].all() and clear.mean() > 0.99


@pytest.mark.parametrize("n,p", [(5000, 0.2), (5000, 0.8), (2_000_000, 0.4), (10**8, 1e-5)])
def test_large_binomial_quantile_is_exact(spark, n, p):
    mean, sd = n * p, math.sqrt(n * p * (1 - p))
    mode, low, high = int(mean), max(0, int(mean - 9 * sd)), min(n + 1, int(mean + 9 * sd))
    k = np.arange(mode + 1, high)
    up = np.cumsum(np.log((n - k + 1) / k * (p / (1 - p))))
    k = np.arange(mode, low, -1)
    down = np.cumsum(np.log(k / (n - k + 1) * ((1 - p) / p)))[::-1]
    pmf = np.exp(np.concatenate((down, [0.0], up)))
    cdf = np.cumsum(pmf) / pmf.sum()
    u = np.linspace(0.0003, 0.9997, 1000)
    clear = np.abs(cdf[np.clip(np.searchsorted(cdf, u), 0, len(cdf) - 1)] - u) > 1e-12
    # With a mean of 400 a hit the median count shows the number of hits.
    hits = np.array([round(c / 400) for c in quantiles(spark, n, p, 400.0, u, 0.5)])
    assert (hits == low + np.searchsorted(cdf, u))[clear].all()


def test_missing_inputs_give_missing_counts(spark):
    df = spark.createDataFrame([(1, None, 3.0), (1, 0.5, None), (1, 1.0, 3.0)], "t long, p double, m double")
    got = df.select(draws.thinned_poisson()("t", "p", "m", F.lit(0.5), F.lit(0.5))).collect()
    assert [r[0] for r in got] == [None, None, 3]
