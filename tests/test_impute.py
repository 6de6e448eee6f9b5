import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorfill.operators import coverage, impute

PARAMS = "site_id int, location int, d double, d_cov double, L double, L_cov double, a double, a_cov double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(400):
        day = int(rng.integers(1, 7))
        hour = int(rng.choice([8, 12, 16]))
        data.append(
            (i, 2010, 1, day, hour, int(rng.integers(1, 3)), 1 + (hour >= 12), int(day > 5), 0.6, int(rng.poisson(0.8)))
        )
    return spark.createDataFrame(
        data,
        "obs_seq long, year int, site_id int, julian_day int, hour int, location int, time_of_day int, "
        "weekend int, p_seen double, cam_count int",
    )


@pytest.fixture(scope="module")
def params(spark):
    return spark.createDataFrame(
        [(1, 1, 0.4, -0.3, 0.9, 0.2, -0.5, 0.1), (1, 2, -0.2, 0.3, 0.5, -0.1, -0.2, 0.0)], PARAMS
    )


def hours_of(rows):
    extra = set(coverage.HOUR_KEYS) - set(rows.columns) - {"is_zero"}
    return coverage.camera_hours(rows.withColumns({c: F.lit(1) for c in sorted(extra)}))


@pytest.mark.parametrize("mode", impute.P_SEEN_MODES)
def test_moments_of_rows_and_of_groups_are_the_same(spark, rows, params, mode):
    by_row = impute.expected_effort(impute.as_groups(coverage.sensors_per_slot(rows)), params, mode)
    by_group = impute.expected_effort(impute.effort_groups(hours_of(rows)), params, mode)
    a, b = (impute.sum_variance_daily(x).toPandas().sort_values("julian_day") for x in (by_row, by_group))
    assert len(a) == 6
    assert np.allclose(a["effort"], b["effort"]) and np.allclose(a["effort_var"], b["effort_var"])


def test_expected_effort_by_hand(spark, rows, params):
    got = impute.expected_effort(impute.as_groups(coverage.sensors_per_slot(rows)), params)
    effects = {r["location"]: r for r in params.collect()}
    for r in got.collect():
        e = effects[r["location"]]
        delta = 1 / (1 + math.exp(-(e["d"] + e["d_cov"] * (r["time_of_day"] - 1))))
        lam = math.exp(e["L"] + e["L_cov"] * r["weekend"])
        alpha = math.exp(e["a"] + e["a_cov"] * r["weekend"])
        want = delta * lam if r["cam_count"] == 0 else alpha * r["cam_count"]
        assert abs(r["effort"] - want / r["n_cam"]) < 1e-12


def test_draws_have_the_expected_moments(spark, rows, params):
    n = 4000
    groups = impute.effort_groups(hours_of(rows))
    expected = impute.sum_variance_daily(impute.expected_effort(groups, params)).toPandas().set_index("julian_day")
    x = impute.effort_draws(groups, params, n, seed=3).toPandas()
    assert len(x) == 6 * n
    for day, drawn in x.groupby("julian_day")["effort"]:
        mean, var = expected.loc[day, ["effort", "effort_var"]]
        assert abs(drawn.mean() - mean) < 4.5 * math.sqrt(var / n)
        assert abs(drawn.var() / var - 1) < 0.15


def test_row_draws_have_the_moments_of_group_draws(spark, rows, params):
    n = 600
    drawn = impute.impute_rows(coverage.sensors_per_slot(rows), params, n, seed=8)
    total = impute.sum_effort_daily(drawn, ["draw"]).toPandas()
    groups = impute.effort_groups(hours_of(rows))
    expected = impute.sum_variance_daily(impute.expected_effort(groups, params)).toPandas().set_index("julian_day")
    for day, x in total.groupby("julian_day")["effort"]:
        mean, var = expected.loc[day, ["effort", "effort_var"]]
        assert abs(x.mean() - mean) < 4.5 * math.sqrt(var / n)
    zero = impute.impute_zero_rows(coverage.sensors_per_slot(rows), params, n_draws=2)
    positive = impute.impute_positive_rows(coverage.sensors_per_slot(rows), params, n_draws=2)
    assert zero.count() + positive.count() == 2 * rows.count()


@pytest.mark.parametrize("parts", [4, 17])
def test_draws_do_not_depend_on_partitions(spark, rows, params, parts):
    key = ["draw", "julian_day"]
    a, b = (
        impute.effort_draws(impute.effort_groups(hours_of(r)), params, 20, seed=3).toPandas().sort_values(key, ignore_index=True)
        for r in (rows.coalesce(1), rows.repartition(parts))
    )
    assert np.allclose(a["effort"], b["effort"])


def test_each_parameter_draw_is_used_once(spark, rows, params):
    two = params.withColumn("draw", F.explode(F.array(F.lit(1), F.lit(2))))
    x = impute.effort_draws(impute.effort_groups(hours_of(rows)), two, None, seed=3)
    assert sorted(r[0] for r in x.select("draw").distinct().collect()) == [1, 2]


def test_intervals(spark):
    df = spark.createDataFrame(
        [(2010, 1, 5, d, float(d)) for d in range(101)],
        "year int, site_id int, julian_day int, draw int, effort double",
    )
    r = impute.effort_intervals(df, 0.1, 0.9).first()
    assert (r["mean"], r["low"], r["median"], r["high"]) == (50.0, 10.0, 50.0, 90.0)


def test_holdout_error(spark):
    df = spark.createDataFrame([(True, 2.0, 1), (True, 0.5, 1), (False, 4.0, 4)], "is_zero boolean, effort double, ground_count int")
    got = {r["is_zero"]: (r["n_rows"], r["mse"], r["bias"]) for r in impute.holdout_error(df).collect()}
    assert got == {True: (2, 0.625, 0.25), False: (1, 0.0, 0.0)}


def test_unknown_mode_is_refused(spark, rows, params):
    with pytest.raises(ValueError):
        impute.expected_effort(rows, params, "half")
