import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries as C
from sensorfill.operators import coverage, folds, model
from sensorfill.plans import effort

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

PAIR = (
    "obs_seq long, year int, site_id int, julian_day int, hour int, cam_location int, time_of_day int, "
    "weekend int, cam_count int, ground_count int, p_seen double"
)


def some_pairs(spark, n=400, hot=0.0, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        site = 1 if rng.random() < hot else int(rng.integers(1, 6))
        ground = None if rng.random() < 0.05 else int(rng.poisson(4))
        cam = None if rng.random() < 0.05 else int(rng.poisson(1))
        rows.append((i, 2010, site, int(rng.integers(1, 60)), 9, int(rng.integers(1, 3)), int(rng.integers(1, 3)),
                     int(rng.integers(0, 2)), cam, ground, 0.5))
    return spark.createDataFrame(rows, PAIR)


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_training_statistics_are_those_of_the_other_folds(spark, hot):
    folded = folds.with_fold(some_pairs(spark, hot=hot), 4, 7).cache()
    sensors = spark.createDataFrame([(1, 1), (99, 1)], "site_id int, location int")
    sums = model.sensor_stats(folded, sensors, None, ["fold"])
    got = folds.training_stats(sums, 4).toPandas()
    assert sorted(got["fold"].unique()) == [0, 1, 2, 3]
    for k in range(4):
        alone = model.sensor_stats(folded.filter(F.col("fold") != k), sensors).toPandas()
        here = got[got["fold"] == k].drop(columns="fold")
        here = here[alone.columns].set_index(["site_id", "location"])
        alone = alone.set_index(["site_id", "location"])
        # A sensor that all has its pairs in this fold is known with sums of zero.
        assert set(alone.index) <= set(here.index) and (99, 1) in here.index
        assert (here.loc[alone.index] == alone).all().all()
        assert (here.drop(alone.index) == 0).all().all()


def test_a_pair_has_one_fold_whatever_the_partitions(spark):
    pairs = some_pairs(spark)
    a, b = (
        {(r.obs_seq, r.cam_location): r.fold for r in folds.with_fold(x, 5, 7).collect()}
        for x in (pairs.coalesce(1), pairs.repartition(7))
    )
    assert a == b and set(a.values()) == {0, 1, 2, 3, 4}


def test_no_pairs(spark):
    empty = folds.with_fold(some_pairs(spark).limit(0), 3, 7)
    sensors = spark.createDataFrame([(1, 1)], "site_id int, location int")
    effects = folds.fold_effects(empty, sensors, 3)
    assert effects.count() == 3 * 6
    params = folds.fold_params(model.effect_modes(effects, model.start_hyper(effects)))
    assert params.count() == 3
    assert folds.cross_validation_error(empty, params).count() == 0


def test_folds_fitted_together_equal_separate_fits(spark):
    rows = C.inputs(spark, SF)
    pairs = C.R.matched_pairs(rows.ground, rows.camera_copies)
    folded = folds.with_fold(pairs, 2, 7).cache()
    sensors = coverage.sensors_of(rows.camera_copies).cache()
    together = {r.variant: r for r in folds.fit_folds(folds.fold_effects(folded, sensors, 2), 2, 2).collect()}
    assert set(together) == {f"{v}@{k}" for v in ("d", "L", "a_wk") for k in (0, 1)}
    stats = model.sensor_stats(folded.filter("fold <> 1"), sensors)
    for alone in model.fit_hierarchical(model.effect_table(stats), model.MODELS[2]).collect():
        got = together[f"{alone.variant}@1"]
        assert got.converged == alone.converged
        assert got.m == pytest.approx(alone.m, abs=1e-4)
        assert got.log_marginal == pytest.approx(alone.log_marginal, abs=1e-4)


def test_the_job_reports_the_error_of_every_fold(spark):
    raw = C.raw_obs(spark, SF), C.raw_sites(spark, SF)
    out = effort.estimate_effort(*raw, replace(C.SETTINGS, folds=3, accept_unconverged=True))
    found = out["cross_validation"].collect()
    assert {(r.fold, r.is_zero) for r in found} == {(k, z) for k in range(3) for z in (False, True)}
    assert all(r.n_rows > 0 and r.mse >= 0 for r in found)
