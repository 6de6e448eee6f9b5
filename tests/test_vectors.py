import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorfill.functions.draws import key_digest, key_uniforms, uniform
from sensorfill.operators import gapfill, impute, model
from sensorfill.operators import vectors as V

PARAMS = "site_id int, location int, d double, d_cov double, L double, L_cov double, a double, a_cov double"
GROUPS = (
    "year int, site_id int, julian_day int, location int, time_of_day int, weekend int, p_seen double, "
    "is_zero boolean, n_cam long, n_rows long, cam_sum long"
)
N = 12
DAY = ["draw", "year", "site_id", "julian_day"]


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):
        zero = bool(rng.integers(2))
        rows.append(
            (2009 + int(rng.integers(2)), int(rng.integers(1, 4)), int(rng.integers(100, 112)), int(rng.integers(1, 3)),
             int(rng.integers(1, 3)), int(rng.integers(2)), None if i % 40 == 0 else 0.6, zero, i + 1, int(rng.integers(1, 6)),
             0 if zero else int(rng.integers(1, 900)))
        )
    rows += [(2009, 1, 200, 9, 1, 0, 0.5, True, 500, 2, 0), (2009, 1, 201, 9, 1, 0, 0.5, False, 501, 2, 4)]
    return spark.createDataFrame(rows, GROUPS)


@pytest.fixture(scope="module")
def params(spark):
    rng = np.random.default_rng(3)
    rows = [(s, c, *[float(x) for x in rng.normal(0, 0.5, 6)]) for s in (1, 2, 3) for c in (1, 2) if (s, c) != (2, 1)]
    return spark.createDataFrame(rows, PARAMS)


def table(df, keys):
    return df.toPandas().sort_values(keys, ignore_index=True)


def same(a, b, keys, names):
    a, b = table(a, keys), table(b, keys)
    assert len(a) == len(b) and (a[keys] == b[keys]).all().all()
    for name in names:
        assert np.allclose(a[name].to_numpy(float), b[name].to_numpy(float), rtol=1e-12, equal_nan=True)


def test_uniforms_are_those_of_the_digests(spark):
    want = spark.range(1, 30).select(key_digest(5, F.lit("x"), F.lit(3), F.col("id")).alias("k"))
    want = want.select(uniform(F.col("k"), 0).alias("a"), uniform(F.col("k"), 1).alias("b")).toPandas()
    a, b = key_uniforms(5, ("x", 3), 29)
    assert (a == want["a"]).all() and (b == want["b"]).all()


@pytest.mark.parametrize("mode", impute.P_SEEN_MODES)
def test_vectors_are_the_draws_by_row(groups, params, mode):
    days = V.effort_vectors(groups, V.fixed_params(params), N, 7, mode)
    names = ("zero_effort", "pos_effort", "effort")
    got = V.long_vectors(days, names, DAY[1:], N)
    same(got, impute.effort_draws(groups, params, N, 7, mode), DAY, names)
    lost = got.filter("julian_day >= 200 and draw = 1").orderBy("julian_day").collect()
    assert [(r["zero_effort"], r["pos_effort"], r["effort"]) for r in lost] == [(None, 0.0, None), (0.0, None, None)]


def test_small_steps_change_nothing(groups, params, monkeypatch):
    want = table(V.long_vectors(V.effort_vectors(groups, V.fixed_params(params), N, 7), ("effort",), DAY[1:], N), DAY)
    monkeypatch.setattr(V, "STEP_DRAWS", 30)
    got = table(V.long_vectors(V.effort_vectors(groups, V.fixed_params(params), N, 7), ("effort",), DAY[1:], N), DAY)
    assert got.equals(want)


def test_drawn_parameters_as_arrays(spark, groups):
    rng = np.random.default_rng(4)
    columns = [f"{e}{x}" for e in "dLa" for x in ("", "_cov", "_var", "_cov_var", "_cross")]
    rows = []
    for s in (1, 2, 3):
        for c in (1, 2):
            row = [s, c]
            for _ in "dLa":
                cov_var = 0.05 if c == 1 else 0.0
                row += [float(rng.normal()), 0.3 if c == 1 else 0.0, 0.1, cov_var, -0.02 if c == 1 else -0.1]
            rows.append(tuple(row))
    params = spark.createDataFrame(rows, "site_id int, location int, " + ", ".join(f"{c} double" for c in columns))
    long = model.draw_parameters(params, N, 7)
    known = groups.filter("location < 3")
    got = V.long_vectors(V.effort_vectors(known, V.param_vectors(params, N, 7), N, 7), ("effort",), DAY[1:], N)
    same(got, impute.effort_draws(known, long, None, 7), DAY, ("effort",))


def test_years_are_those_of_draws_by_row(spark):
    rng = np.random.default_rng(6)
    days = [(2009, s, d) for s in range(1, 6) for d in range(100, 130) if rng.random() < 0.6]
    vectors = []
    for i, (y, s, d) in enumerate(days):
        effort = None if i % 17 == 0 else [0.0 if s == 4 else float(x) for x in rng.poisson(0.15, N)]
        vectors.append((y, s, d, effort))
    daily = spark.createDataFrame(vectors, "year int, site_id int, julian_day int, effort array<double>")
    donors = [(2009, s, d, r) for s in range(1, 6) for r, d in ((1, s % 5 + 1), (2, (s + 1) % 5 + 1))]
    donors = spark.createDataFrame(donors, "year int, site_id int, donor_site_id int, donor_rank int")
    given = gapfill.donor_days(donors, spark.createDataFrame(days, "year int, site_id int, julian_day int"))
    pairs = gapfill.usable_pairs(gapfill.donor_usable(given))
    long = V.long_vectors(daily, ("effort",), DAY[1:], N)
    want = gapfill.effort_annual(long, gapfill.fill_effort(long, given, pairs, ["draw"]), ["draw"])
    yearly = V.annual_vectors(daily, given, pairs, N)
    names = ("observed_effort", "filled_effort", "n_days", "effort")
    same(V.long_vectors(yearly, names, ["year", "site_id"], N), want, DAY[:3], names)


def test_summary_of_a_vector(spark):
    values = [3.0, 1.0, None, 2.0, 10.0]
    df = spark.createDataFrame([(1, values), (2, None), (3, [4.0]), (4, [None])], "k int, v array<double>")
    got = {r["k"]: r for r in V.vector_summary(df, "v", ["k"], {"low": 0.1, "mid": 0.5}).collect()}
    known = np.array([3.0, 1.0, 2.0, 10.0])
    assert got[1]["mean"] == known.mean() and got[1]["sd"] == pytest.approx(known.std(ddof=1))
    assert (got[1]["low"], got[1]["mid"]) == (pytest.approx(np.quantile(known, 0.1)), 2.5)
    assert (got[3]["mean"], got[3]["sd"], got[3]["low"]) == (4.0, None, 4.0)
    assert all(got[k][c] is None for k in (2, 4) for c in ("mean", "sd", "low", "mid"))
