import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import queries as K
from sensorfill.functions.quadrature import exact_draws, inverse_cdf, laplace_correction
from sensorfill.operators import model as M
from sensorfill.operators import nested as N

SF = "/root/testdata/sf0.01"
EFFECTS = "site_id long, location int, variant string, hits_0 double, size_0 double, hits_1 double, size_1 double"
HYPER = {"m": 0.3, "p": 2.0, "m_cov": -0.2, "p_cov": 4.0}


def log_density(logistic, row, t, b):
    """Unnormalised log posterior of (theta, beta), by its definition."""
    h0, s0, h1, s1 = row
    total = -0.5 * HYPER["p"] * (t - HYPER["m"]) ** 2 - 0.5 * HYPER["p_cov"] * (b - HYPER["m_cov"]) ** 2
    for h, s, eta in ((h0, s0, t), (h1, s1, t + b)):
        total = total + h * eta - s * (np.logaddexp(0, eta) if logistic else np.exp(eta))
    return total


@pytest.fixture(scope="module")
def modes(spark):
    """Sensors with no pair up to three pairs, and one with many."""
    rows = []
    sums = [(0, 0, 0, 0), (0, 1, 0, 0), (1, 1, 0, 1), (0, 3, 1, 2), (2, 3, 2, 2), (40, 90, 30, 45)]
    for i, s in enumerate(sums):
        for variant in M.VARIANTS:
            both = [float(s[0] + s[2]), float(s[1] + s[3]), 0.0, 0.0]
            rows.append((i, 1, variant, *([float(x) for x in s] if "_" in variant else both)))
    hyper = spark.createDataFrame([(v, *HYPER.values()) for v in M.VARIANTS], "variant string, m double, p double, m_cov double, p_cov double")
    return M.effect_modes(spark.createDataFrame(rows, EFFECTS), hyper).toPandas()


def grids(row, cells=600, reach=9.0):
    t = np.linspace(row["theta"] - reach * math.sqrt(row["theta_var"]), row["theta"] + reach * math.sqrt(row["theta_var"]), cells)
    b = np.zeros(1)
    if row["beta_var"] > 0:
        b = np.linspace(row["beta"] - reach * math.sqrt(row["beta_var"]), row["beta"] + reach * math.sqrt(row["beta_var"]), cells)
    return t, b


def arguments(modes):
    names = ["hits_0", "size_0", "hits_1", "size_1", "m", "p", "m_cov", "p_cov", "theta"]
    return [modes["variant"].str.startswith("d"), *[modes[n] for n in names]]


def test_quadrature_is_the_integral(modes):
    found = laplace_correction(41, 31).func(*arguments(modes), modes["beta"], modes["theta_var"], modes["beta_var"], modes["cov"])
    for (_, row), correction in zip(modes.iterrows(), found):
        t, b = grids(row)
        sums, logistic = (row["hits_0"], row["size_0"], row["hits_1"], row["size_1"]), row["variant"][0] == "d"
        if "_" not in row["variant"]:  # beta stays at 0, where its prior is the same for all
            t, b = np.linspace(t[0], t[-1], 20_001), np.zeros(1)
        f = log_density(logistic, sums, t[:, None], b[None, :])
        at_mode = log_density(logistic, sums, row["theta"], row["beta"] if len(b) > 1 else 0.0)
        cell = (t[1] - t[0]) * (b[1] - b[0] if len(b) > 1 else 1.0)
        integral = math.log(np.exp(f - at_mode).sum() * cell)
        det = row["theta_var"] * (row["beta_var"] or 1.0) - row["cov"] ** 2 * (len(b) > 1)
        laplace = 0.5 * math.log(det) + math.log(2 * math.pi) * (1.0 if len(b) > 1 else 0.5)
        assert correction == pytest.approx(integral - laplace, abs=2e-5)


def test_quantiles_of_sensors_with_few_pairs(spark, modes):
    at = (0.001, 0.025, 0.5, 0.975, 0.999)
    found = N.sensor_quantiles(spark.createDataFrame(modes), at).toPandas()
    assert len(found) == 3 * 6 * len(at)
    off = 0.0
    for _, row in modes[~modes["variant"].str.contains("_")].iterrows():
        t = np.linspace(row["theta"] - 14 * math.sqrt(row["theta_var"]), row["theta"] + 14 * math.sqrt(row["theta_var"]), 400_001)
        f = log_density(row["variant"] == "d", (row["hits_0"], row["size_0"], 0, 0), t, 0.0)
        cdf = np.cumsum(np.exp(f - f.max()))
        mine = found[(found["site_id"] == row["site_id"]) & (found["variant"] == row["variant"])].sort_values("p")
        want = np.interp(np.array(at) * cdf[-1], cdf, t)
        assert mine["exact"].to_numpy() == pytest.approx(want, abs=1e-3)
        off = max(off, np.abs(mine["normal"] - want).max())
    assert off > 0.1  # which the Normal distribution misses


def test_draws_with_a_covariate_follow_the_posterior(modes):
    some = modes[modes["variant"].str.contains("_") & modes["site_id"].isin([0, 2, 4])].reset_index(drop=True)
    n = 40
    u = (np.arange(n) + 0.5) / n
    u1, u2 = (x.ravel() for x in np.meshgrid(u, u, indexing="ij"))
    column = pd.Series([u1] * len(some)), pd.Series([u2] * len(some))
    found = exact_draws().func(*arguments(some), some["theta_var"], some["beta_var"], *column)
    for (_, row), theta, beta in zip(some.iterrows(), found["theta"], found["beta"]):
        t, b = grids(row, 900, 10.0)
        f = log_density(row["variant"][0] == "d", (row["hits_0"], row["size_0"], row["hits_1"], row["size_1"]), t[:, None], b[None, :])
        w = np.exp(f - f.max())
        w /= w.sum()
        for draws, values in ((theta, t[:, None] + 0 * w), (beta, b[None, :] + 0 * w), (theta + beta, t[:, None] + b[None, :])):
            mean = (w * values).sum()
            sd = math.sqrt((w * (values - mean) ** 2).sum())
            assert draws.mean() == pytest.approx(mean, abs=0.01 * sd)
            assert draws.std() == pytest.approx(sd, rel=0.03)
        edges = np.cumsum(w.sum(axis=1))
        assert np.quantile(theta, 0.25) == pytest.approx(np.interp(0.25, edges, t), abs=0.05 * math.sqrt(row["theta_var"]))


def test_inverse_holds_for_large_counts_and_far_quantiles():
    logistic = np.array([True, False, False])
    hits, size = np.array([5e8, 3e9, 0.0]), np.array([1e9, 1e9, 1e9])
    one = np.ones(3)
    u = np.tile([1e-9, 0.5, 1 - 1e-9], (3, 1))
    x = inverse_cdf(logistic, hits, size, 0 * one, one, u)
    assert (np.diff(x, axis=1) > 0).all() and np.isfinite(x).all()
    assert x[0, 1] == pytest.approx(0.0, abs=1e-6) and x[1, 1] == pytest.approx(math.log(3), abs=1e-6)


def test_grid_of_hyperparameters(spark):
    table = K.effects(spark, SF)
    fit = M.fit_hierarchical(table, ["d", "a_wk"])
    grid = N.hyper_grid(table, fit).toPandas()
    for r in fit.collect():
        mine = grid[grid["variant"] == r["variant"]]
        assert mine["weight"].sum() == pytest.approx(1.0)
        assert len(mine) <= (49 if r["variant"] == "d" else 89)
        mean = (mine["weight"] * mine["m"]).sum()
        assert mean == pytest.approx(r["m"], abs=0.5 * r["m_se"])
        spread = math.sqrt((mine["weight"] * (mine["m"] - mean) ** 2).sum())
        assert 0.7 * r["m_se"] < spread < 1.6 * r["m_se"]


def test_mixture_is_drawn_at_the_points_by_their_weights(spark):
    table = K.effects(spark, SF).filter("site_id < 5")
    points = [(v, i, m, p, 0.1, 3.0, w) for v in ("d", "L_wk", "a") for i, (m, p, w) in enumerate([(-3.0, 2.0, 0.25), (2.0, 5.0, 0.75)])]
    grid = spark.createDataFrame(points, N._GRID)
    n = 400
    drawn = [N.mixed_vectors(table.repartition(k), grid, 3, n, 5).toPandas().sort_values(["site_id", "location"], ignore_index=True) for k in (1, 4)]
    for e in ("d", "L", "L_cov", "a"):
        assert np.allclose(np.stack(drawn[0][e]), np.stack(drawn[1][e]), atol=1e-9)
    modes = M.with_modes(table.join(grid, "variant")).toPandas().set_index(["variant", "site_id", "location", "point"])
    first = drawn[0].iloc[0]
    assert len(first["d"]) == len(first["L_cov"]) == n and set(first["a_cov"]) == {0.0}
    for v, e in (("d", "d"), ("L_wk", "L"), ("a", "a")):
        here = [modes.loc[(v, first["site_id"], first["location"], i)] for i in (0, 1)]
        mean = 0.25 * here[0]["theta"] + 0.75 * here[1]["theta"]
        second = sum(w * (x["theta_var"] + x["theta"] ** 2) for w, x in zip((0.25, 0.75), here))
        sd = math.sqrt(second - mean**2)
        draws = np.array(first[e])
        assert draws.mean() == pytest.approx(mean, abs=5 * sd / math.sqrt(n))
        assert draws.std() == pytest.approx(sd, rel=0.25)


def test_uncertain_hyperparameters_do_not_narrow_the_years(spark):
    keys = ["year", "site_id"]
    wide = K.i6_effort_annual_posterior(spark, SF).toPandas().set_index(keys).sort_index()
    fixed = K.i6_effort_annual_draws(spark, SF).toPandas().set_index(keys).sort_index()
    assert (wide.index == fixed.index).all() and len(wide)
    assert (wide["sd"] >= fixed["sd"]).mean() > 0.95


def test_two_fits_agree_where_sensors_have_many_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i, (variant, location) in enumerate(itertools.product(("d", "L", "a"), range(30))):
        size = 5000.0
        rate = 1 / (1 + math.exp(-rng.normal(0, 0.5))) if variant == "d" else math.exp(rng.normal(0, 0.5))
        rows.append((i, location, variant, float(rng.poisson(size * rate) if variant != "d" else rng.binomial(5000, rate)), size, 0.0, 0.0))
    table = spark.createDataFrame(rows, EFFECTS)
    fits = [M.hyper_estimates(M.fit_hierarchical(table, ["d", "L", "a"], nodes=n)).toPandas().set_index("param")["estimate"] for n in (0, 25)]
    assert np.allclose(fits[0], fits[1][fits[0].index], atol=1e-3)
