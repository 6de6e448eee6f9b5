import numpy as np
from pyspark.sql import functions as F

from sensorfill.operators import posterior


def draws(spark, values, chain=None):
    rows = [("x", 1, 1, (i % 2) + 1 if chain is None else chain, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "param string, site_id int, location int, chain int, draw int, value double")


def test_summary(spark):
    v = np.random.default_rng(1).normal(2, 3, 400)
    r = posterior.posterior_summary(draws(spark, v)).first()
    assert np.allclose([r["mean"], r["sd"], r["q50"], r["q975"]], [v.mean(), v.std(ddof=1), np.median(v), np.quantile(v, 0.975)])
    a, b = v[::2], v[1::2]
    within, between = (a.var(ddof=1) + b.var(ddof=1)) / 2, np.var([a.mean(), b.mean()], ddof=1)
    assert abs(r["r_hat"] - np.sqrt(199 / 200 + between / within)) < 1e-9


def test_chains_that_do_not_mix_show(spark):
    v = np.random.default_rng(1).normal(0, 1, 200) + np.tile([0, 8], 100)
    assert posterior.posterior_summary(draws(spark, v)).first()["r_hat"] > 3


def density(v, end, n):
    q = np.quantile(v, [0.25, 0.75])
    low = min(v.std(ddof=1), (q[1] - q[0]) / 1.34)
    width = 0.9 * (low or v.std(ddof=1) or abs(v[0]) or 1.0) * len(v) ** -0.2
    x = np.linspace(0, end, n)[:, None]
    return (np.exp(-0.5 * ((x - v) / width) ** 2) / (width * np.sqrt(2 * np.pi))).mean(axis=1)


def test_density_grid(spark):
    v = np.random.default_rng(5).gamma(3, 0.5, 150)
    for values in (v, np.full(10, 1.5), np.zeros(4), np.array([1.0] * 9 + [3.0])):
        got = posterior.density_grid(draws(spark, values), 4.0, n=64).orderBy("i").collect()
        assert np.allclose([r["x"] for r in got], np.linspace(0, 4, 64))
        assert np.allclose([r["density"] for r in got], density(np.asarray(values), 4.0, 64))


def test_back_transform_and_long_form(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 1, 0.0, 0.0, 1.0, 0.5, -1.0, 0.0)],
        "chain int, draw int, site_id int, location int, d double, d_cov double, L double, L_cov double, a double, a_cov double",
    )
    r = posterior.back_transform(df).first()
    assert np.allclose(
        [r["p_false_zero"], r["false_zero_mean_weekday"], r["false_zero_mean_weekend"], r["multiplier_weekend"]],
        [0.5, np.e, np.exp(1.5), np.exp(-1)],
    )
    long = posterior.long_draws(df, ["d", "L"])
    assert {r["param"]: r["mean"] for r in posterior.posterior_means(long).collect()} == {"d": 0.0, "L": 1.0}


def test_compare_fits_keeps_parameters_of_either_side(spark):
    a = spark.createDataFrame([("m", 1.0), ("p", 2.0)], "param string, estimate double")
    b = a.filter("param = 'm'").withColumn("estimate", F.lit(0.75))
    got = {r["param"]: (r["first"], r["second"], r["difference"]) for r in posterior.compare_fits(a, b).collect()}
    assert got == {"m": (1.0, 0.75, 0.25), "p": (2.0, None, None)}


def sensors(spark, groups):
    rows = [(p, s, 1, 1, i, float(v)) for s, (p, values) in enumerate(groups) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "param string, site_id int, location int, chain int, draw int, value double")


def test_binned_density_is_near_the_exact_sum(spark):
    rng = np.random.default_rng(9)
    ends = {"p": 1.0, "q": 4.0}
    groups = [
        ("p", rng.beta(2, 5, 300)), ("p", rng.normal(0.5, 1e-4, 200)), ("p", np.full(6, 0.25)),
        ("q", rng.gamma(3, 0.5, 250)), ("q", rng.normal(-1, 3, 100)), ("q", np.r_[rng.normal(2, 0.01, 50), 3.9]),
        ("q", rng.normal(90, 0.5, 40)),
    ]
    got = posterior.binned_density(sensors(spark, groups), ends, n=64).toPandas()
    assert len(got) == 64 * len(groups)
    for s, (param, values) in enumerate(groups):
        one = got[got.site_id == s].sort_values("i")
        exact = density(np.asarray(values), ends[param], 64)
        peak = 1 / (np.sqrt(2 * np.pi) * width_of(np.asarray(values)))
        assert np.allclose(one["x"], np.linspace(0, ends[param], 64))
        assert np.abs(one["density"] - exact).max() <= peak / 2048 + 1e-12


def width_of(v):
    q = np.quantile(v, [0.25, 0.75])
    low = min(v.std(ddof=1), (q[1] - q[0]) / 1.34)
    return 0.9 * (low or v.std(ddof=1) or abs(v[0]) or 1.0) * len(v) ** -0.2


def test_binned_density_of_no_draws_and_of_other_quantities(spark):
    df = sensors(spark, [("p", [0.5, 0.6]), ("other", [1.0, 2.0])])
    assert posterior.binned_density(df, {"p": 1.0}, n=8).select("param").distinct().count() == 1
    assert posterior.binned_density(df.filter("false"), {"p": 1.0}, n=8).count() == 0
