import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorfill.operators import model, posterior

COLUMNS = "site_id int, location int, variant string, hits_0 double, size_0 double, hits_1 double, size_1 double"


def poisson_sensors(rng, n, m, p, size=40, mc=None, pc=None, variant="L"):
    rows = []
    for i in range(n):
        theta = rng.normal(m, 1 / math.sqrt(p))
        beta = rng.normal(mc, 1 / math.sqrt(pc)) if mc is not None else 0.0
        h0 = float(rng.poisson(size * math.exp(theta)))
        h1 = float(rng.poisson(size * math.exp(theta + beta))) if mc is not None else 0.0
        rows.append((i, 1, variant, h0, float(size), h1, float(size) if mc is not None else 0.0))
    return rows


def logistic_sensors(rng, n, m, p, size=60, mc=None, pc=None, variant="d"):
    rows = []
    for i in range(n):
        theta = rng.normal(m, 1 / math.sqrt(p))
        beta = rng.normal(mc, 1 / math.sqrt(pc)) if mc is not None else 0.0
        draw = lambda x: float(rng.binomial(size, 1 / (1 + math.exp(-x))))
        rows.append(
            (i, 1, variant, draw(theta), float(size),
             draw(theta + beta) if mc is not None else 0.0, float(size) if mc is not None else 0.0)
        )
    return rows


def laplace(rows, m, lp, mc=0.0, lpc=0.0):
    """Log marginal posterior by plain Newton steps in NumPy, one sensor at a time."""
    covariate = "_" in rows[0][2]
    p, pc = math.exp(lp), math.exp(lpc) if covariate else 1.0
    total = model.log_prior([m, lp, mc, lpc][: 4 if covariate else 2], covariate)
    for _, _, v, h0, s0, h1, s1 in rows:
        h, s, x = np.array([h0, h1]), np.array([s0, s1]), np.array([[1.0, 0.0], [1.0, 1.0]])
        t = np.array([m, mc])

        def parts(t):
            eta = x @ t
            if v[0] == "d":
                mu = s / (1 + np.exp(-eta))
                return h @ eta - s @ np.logaddexp(0, eta), mu, mu * (1 - mu / np.maximum(s, 1e-9))
            mu = s * np.exp(eta)
            return h @ eta - mu.sum(), mu, mu

        prior = np.diag([p, pc])
        for _ in range(200):
            _, mu, c = parts(t)
            g = x.T @ (h - mu) - prior @ (t - [m, mc])
            t = t + np.clip(np.linalg.solve(x.T @ np.diag(c) @ x + prior, g), -1, 1)
        f, _, c = parts(t)
        d = t - [m, mc]
        total += f + 0.5 * np.log(np.diag(prior)).sum() - 0.5 * d @ prior @ d
        total -= 0.5 * np.linalg.slogdet(x.T @ np.diag(c) @ x + prior)[1]
    return total


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_marginal_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    for rows, points in (
        (poisson_sensors(rng, 8, 0.5, 9), [(0.1, 1.0), (0.6, 2.5)]),
        (logistic_sensors(rng, 8, 0.5, 9), [(0.1, 1.0), (2.5, -1.0)]),
        (poisson_sensors(rng, 6, 0.5, 9, mc=0.3, pc=20, variant="a_wk"), [(0.1, 1.0, 0.5, 2.0)]),
        (logistic_sensors(rng, 6, -0.5, 9, mc=0.3, pc=20, variant="d_tod"), [(0.1, 1.0, -0.5, 2.0)]),
    ):
        rows = rows + [(99, 1, rows[0][2], 0.0, 0.0, 0.0, 0.0)]  # a sensor without pairs
        df = table(spark, rows)
        best = df.agg(F.sum(model._best_loglik())).first()[0]
        got = model.marginal_at(df, {rows[0][2]: points})[rows[0][2]]
        assert np.allclose(np.array(got) + best, [laplace(rows, *x) for x in points], rtol=1e-10)


@pytest.mark.parametrize("scale", [1, 10**9])
def test_fit_keeps_its_digits_on_huge_counts(spark, scale):
    """Counts a billion times as large: the sensors' own values become exact."""
    rng = np.random.default_rng(5)
    rows = poisson_sensors(rng, 30, 0.5, 9.0, size=200 * scale)
    rows += logistic_sensors(rng, 30, 0.2, 4.0, size=200 * scale)
    rows += poisson_sensors(rng, 30, 0.5, 9.0, size=200 * scale, mc=0.3, pc=16.0, variant="a_wk")
    # Sensors with all, no or hardly any hits.
    rows += [(90, 1, "d", 200.0 * scale, 200.0 * scale, 0.0, 0.0), (91, 1, "d", 0.0, 5.0, 0.0, 0.0)]
    rows += [(92, 1, "L", 0.0, 3.0, 0.0, 0.0), (93, 1, "a_wk", 4.0, 3.0, 0.0, 2.0)]
    rounds = []
    kept, model.marginal_at = model.marginal_at, lambda *a: rounds.append(1) or kept(*a)
    try:
        fit = {r["variant"]: r for r in model.fit_hierarchical(table(spark, rows), ["d", "L", "a_wk"]).collect()}
    finally:
        model.marginal_at = kept
    assert all(r["converged"] for r in fit.values()) and len(rounds) < 25
    assert abs(fit["L"]["m"] - 0.5) < 4 * fit["L"]["m_se"]
    assert abs(math.log(fit["L"]["p"] / 9)) < 4 * fit["L"]["log_p_se"]
    assert abs(fit["a_wk"]["m_cov"] - 0.3) < 4 * fit["a_wk"]["m_cov_se"]


def test_marginal_equals_brute_force_without_data(spark):
    rows = [(1, 1, "L", 0.0, 0.0, 0.0, 0.0)]
    got = model.marginal_at(table(spark, rows), {"L": [(0.1, 1.0)]})["L"]
    assert np.allclose(got, [laplace(rows, 0.1, 1.0)])


def test_fit_is_the_maximum_and_covers_the_truth(spark):
    rng = np.random.default_rng(7)
    rows = logistic_sensors(rng, 40, 0.4, 4.0) + poisson_sensors(rng, 40, 0.9, 12.0)
    rows += poisson_sensors(rng, 40, -0.5, 9.0, variant="a")
    truth = {"d": (0.4, 4.0), "L": (0.9, 12.0), "a": (-0.5, 9.0)}
    fit = {r["variant"]: r for r in model.fit_hierarchical(table(spark, rows), list(truth)).collect()}
    for v, (m, p) in truth.items():
        r, own = fit[v], [x for x in rows if x[2] == v]
        assert r["converged"]
        assert abs(r["m"] - m) < 3 * r["m_se"]
        assert abs(math.log(r["p"]) - math.log(p)) < 3 * r["log_p_se"]
        best = laplace(own, r["m"], math.log(r["p"]))
        assert abs(best - r["log_marginal"]) < 1e-6
        for dm, dp in ((0.01, 0), (-0.01, 0), (0, 0.02), (0, -0.02), (0.2, 0.3), (-0.2, -0.3)):
            assert laplace(own, r["m"] + dm, math.log(r["p"]) + dp) < best


def test_covariate_fit_is_the_maximum_and_covers_the_truth(spark):
    rng = np.random.default_rng(11)
    rows = poisson_sensors(rng, 50, 0.6, 10.0, mc=0.4, pc=15.0, variant="L_wk")
    rows += logistic_sensors(rng, 50, 0.2, 3.0, size=150, mc=-0.5, pc=8.0, variant="d_tod")
    truth = {"L_wk": (0.6, 10.0, 0.4, 15.0), "d_tod": (0.2, 3.0, -0.5, 8.0)}
    fit = {r["variant"]: r for r in model.fit_hierarchical(table(spark, rows), list(truth)).collect()}
    for v, (m, p, mc, pc) in truth.items():
        r, own = fit[v], [x for x in rows if x[2] == v]
        assert r["converged"]
        assert abs(r["m"] - m) < 3 * r["m_se"] and abs(r["m_cov"] - mc) < 3 * r["m_cov_se"]
        assert abs(math.log(r["p"] / p)) < 3 * r["log_p_se"]
        assert abs(math.log(r["p_cov"] / pc)) < 3 * r["log_p_cov_se"]
        at = [r["m"], math.log(r["p"]), r["m_cov"], math.log(r["p_cov"])]
        best = laplace(own, *at)
        for i in range(4):
            for h in (0.02, -0.02):
                moved = list(at)
                moved[i] += h
                assert laplace(own, *moved) < best


def test_sensor_without_pairs_takes_the_mean(spark):
    rows = [(1, 1, "L", 80.0, 40.0, 0.0, 0.0), (2, 1, "L", 0.0, 0.0, 0.0, 0.0)]
    hyper = spark.createDataFrame([("L", 0.3, 5.0, 0.0, 1.0)], "variant string, m double, p double, m_cov double, p_cov double")
    got = {r["site_id"]: r for r in model.effect_modes(table(spark, rows), hyper).collect()}
    assert abs(got[2]["theta"] - 0.3) < 1e-12 and abs(got[2]["theta_var"] - 0.2) < 1e-12
    assert 0.3 < got[1]["theta"] < math.log(2) and got[1]["theta_var"] < 0.02


def pair_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "site_id int, cam_location int, cam_count int, ground_count int, time_of_day int, weekend int",
    )


def test_sensor_stats(spark):
    pairs = pair_rows(
        spark,
        [(1, 1, 0, 0, 1, 0), (1, 1, 0, 3, 2, 1), (1, 1, 0, None, 2, 1), (1, 1, 2, 5, 2, 0),
         (1, 1, 4, 0, 1, 1), (1, 1, 3, None, 1, 1), (1, 1, None, 2, 1, 1), (1, None, None, 2, 1, 1)],
    )
    sensors = spark.createDataFrame([(1, 1), (2, 1)], "site_id int, location int")
    got = {r["site_id"]: r.asDict() for r in model.sensor_stats(pairs, sensors).collect()}
    want = dict(
        false_zeros_0=0, false_zeros_1=1, zero_pairs_0=1, zero_pairs_1=1, fz_ground_0=0, fz_ground_1=3,
        fz_rows_0=0, fz_rows_1=1, pos_ground_0=5, pos_ground_1=0, pos_cam_0=2, pos_cam_1=4,
    )
    assert {k: got[1][k] for k in want} == want
    assert all(got[2][k] == 0 for k in want)
    dated = pairs.withColumn("year", F.lit(2010))
    for season, kept in (((2010, 1), True), ((2009, 1), False)):
        one = {r["site_id"]: r for r in model.sensor_stats(dated, sensors, season).collect()}[1]
        assert (one["false_zeros_1"], one["zero_pairs_0"]) == (1, 1)
        assert one["pos_ground_0"] == (5 if kept else 0) and one["fz_rows_1"] == int(kept)


def test_log_likelihood_of_rows_sums_to_that_of_the_statistics(spark):
    rng = np.random.default_rng(3)
    rows = [
        (int(rng.integers(1, 4)), 1, int(rng.poisson(0.8)), int(rng.poisson(1.0)), int(rng.integers(1, 3)), int(rng.integers(0, 2)))
        for _ in range(300)
    ]
    pairs = pair_rows(spark, rows)
    keys = ["site_id", "cam_location", "time_of_day", "weekend"]
    from sensorfill.operators import pairing

    zeros = pairing.true_zero_counts(pairs, keys)
    params = spark.createDataFrame(
        [(s, 1, 0.1 * s, 0.2 * s, -0.1 * s) for s in (1, 2, 3)], "site_id int, location int, d double, L double, a double"
    )
    loglik = model.row_log_likelihood(pairs, zeros, params).agg(F.sum("loglik")).first()[0]
    constant = model.log_constants(pairs, zeros).first()[0]
    total = 0.0
    for s in (1, 2, 3):
        own = [r for r in rows if r[0] == s]
        d, L, a = 0.1 * s, 0.2 * s, -0.1 * s
        zero = [r for r in own if r[2] == 0]
        k = sum(r[3] > 0 for r in zero)
        total += k * d - len(zero) * math.log1p(math.exp(d))
        total += sum(r[3] * L - math.exp(L) for r in zero if r[3] > 0)
        total += sum(r[3] * a - r[2] * math.exp(a) for r in own if r[2] > 0)
    assert abs(loglik - constant - total) < 1e-8


def test_draws_have_the_moments_of_the_mode_and_do_not_depend_on_partitions(spark):
    rows = [(1, 1, "L_wk", 80.0, 40.0, 100.0, 45.0), (2, 1, "d", 20.0, 60.0, 0.0, 0.0)]
    hyper = spark.createDataFrame(
        [("L_wk", 0.3, 5.0, 0.1, 4.0), ("d", 0.0, 2.0, 0.0, 1.0)],
        "variant string, m double, p double, m_cov double, p_cov double",
    )
    modes = model.effect_modes(table(spark, rows), hyper)
    mode = {r["variant"]: r for r in modes.collect()}
    frames = [
        model.draw_effects(modes.repartition(n), 20000, seed=5).toPandas().sort_values(["variant", "draw"], ignore_index=True)
        for n in (1, 4, 17)
    ]
    assert frames[0].equals(frames[1]) and frames[0].equals(frames[2])
    wk = frames[0][frames[0]["variant"] == "L_wk"]
    cov = np.cov(wk["theta"], wk["beta"])
    r = mode["L_wk"]
    assert np.allclose([wk["theta"].mean(), wk["beta"].mean()], [r["theta"], r["beta"]], atol=0.005)
    assert np.allclose(cov, [[r["theta_var"], r["cov"]], [r["cov"], r["beta_var"]]], rtol=0.05)
    assert (frames[0][frames[0]["variant"] == "d"]["beta"] == 0).all()
    thin = model.thin_draws(model.draw_effects(modes, 20, seed=5), burn=6, thin=4)
    assert {x["draw"] for x in thin.collect()} == {10, 14, 18}


def test_dic_and_best_model(spark):
    deviance = spark.createDataFrame(
        [(v, d, float(10 * i + d)) for i, v in enumerate(model.VARIANTS) for d in (1, 2, 3)],
        "variant string, draw int, deviance double",
    )
    constant = spark.createDataFrame([(-5.0,)], "log_constant double")
    dic = model.model_dic(deviance, constant)
    got = {r["model"]: r for r in dic.collect()}
    place = {v: i for i, v in enumerate(model.VARIANTS)}
    for m, members in model.MODELS.items():
        per_draw = [sum(10 * place[v] + d for v in members) for d in (1, 2, 3)]
        assert abs(got[m]["dic"] - (np.mean(per_draw) + 10 + np.var(per_draw, ddof=1) / 2)) < 1e-9
    assert [r["model"] for r in model.best_model(dic).collect()] == [1]
    tied = dic.withColumn("dic", F.when(F.col("model") == 8, F.lit(1.0)).when(F.col("model") == 3, F.lit(1.0)).otherwise(2.0))
    assert sorted(r["model"] for r in model.best_model(tied).collect()) == [3, 8]


def test_new_sensor_effects_and_densities(spark):
    rows = [("d", -0.5, 16.0, 0.0, 1.0), ("L_wk", 0.3, 4.0, 0.2, 25.0), ("a_wk", -0.5, 16.0, 0.2, 25.0)]
    hyper = spark.createDataFrame(rows, "variant string, m double, p double, m_cov double, p_cov double")
    found = model.new_sensor_effects(hyper)
    x = found.toPandas().set_index("variant")
    assert np.allclose(x["theta_sd"], [0.25, 0.5, 0.25])
    assert np.allclose(x["both_mean"], [-0.5, 0.5, -0.3])
    assert np.allclose(x["both_sd"], [0.25, math.sqrt(0.25 + 0.04), math.sqrt(0.0625 + 0.04)])
    grid = posterior.new_sensor_density(found, 4001).toPandas()
    rng = np.random.default_rng(1)
    drawn = {
        "p_false_zero": 1 / (1 + np.exp(-rng.normal(-0.5, 0.25, 200_000))),
        "false_zero_mean_weekend": np.exp(rng.normal(0.5, math.sqrt(0.29), 200_000)),
        "multiplier_weekday": np.exp(rng.normal(-0.5, 0.25, 200_000)),
    }
    for param, values in drawn.items():
        g = grid[grid["param"] == param].sort_values("i")
        step = g["x"].iloc[1]
        assert abs((g["density"] * step).sum() - 1) < 0.01
        assert abs((g["density"] * g["x"] * step).sum() - values.mean()) < 0.02
    assert set(grid["param"]) == set(posterior.GRID_ENDS)


@pytest.mark.parametrize("variants", [["d", "L", "a"]])
def test_fit_returns_one_row_per_variant(spark, variants):
    rng = np.random.default_rng(2)
    rows = logistic_sensors(rng, 5, 0, 4) + poisson_sensors(rng, 5, 0, 4) + poisson_sensors(rng, 5, 0, 4, variant="a")
    fit = model.fit_hierarchical(table(spark, rows), variants)
    assert sorted(r["variant"] for r in fit.collect()) == sorted(variants)
    summary = model.hyper_summary(fit).collect()
    assert summary and all(r["low"] < r["estimate"] < r["high"] for r in summary)


@pytest.mark.parametrize("start", [(0.6, 0.0), (-4.0, 8.0), (5.0, -9.0)])
def test_one_informative_sensor_ends_at_a_bound(start):
    rows = [(1, 1, "L", 8.0, 4.0, 0.0, 0.0), (2, 1, "L", 0.0, 0.0, 0.0, 0.0)]
    calls = []

    def evaluate(points):
        calls.append(1)
        return {v: [laplace(rows, *x) for x in xs] for v, xs in points.items()}

    x, value, _, converged = model.climb({"L": start}, evaluate, 1e-5, 60, 1e-3)["L"]
    assert converged and len(calls) < 30
    assert abs(x[1] - math.log(model.PRECISION_BOUNDS[0])) < 1e-9
    assert abs(value - laplace(rows, *x)) < 1e-9
