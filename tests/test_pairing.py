import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorfill.operators import pairing

GROUND = "obs_seq long, site_id int, slot long, location int, ground_count int"
CAMERA = "obs_seq long, site_id int, slot long, location int, cam_count int"


def frames(spark, ground, cameras):
    return spark.createDataFrame(ground, GROUND), spark.createDataFrame(cameras, CAMERA)


def rows(df):
    keys = ["obs_seq", "cam_location", "cam_count", "sensor_code"]
    return sorted(map(tuple, df.select(*keys).collect()), key=str)


def test_first_camera_row_of_each_location(spark):
    ground, cameras = frames(
        spark,
        [(1, 1, 10, 3, 4), (2, 1, None, 3, 5)],
        [(9, 1, 10, 1, 7), (8, 1, 10, 1, 6), (7, 2, 10, 1, 5), (6, 1, None, 1, 1)],
    )
    # Location 3 has ground rows only; a row without a slot matches nothing.
    assert rows(pairing.pair_counts(ground, cameras)) == sorted(
        [(1, 1, 6, 11), (1, 3, None, None), (2, 1, None, None), (2, 3, None, None)], key=str
    )
    assert rows(pairing.matched_pairs(ground, cameras)) == [(1, 1, 6, 11)]


def test_first_row_with_unknown_count_still_matches(spark):
    ground, cameras = frames(spark, [(1, 1, 10, 1, 4)], [(5, 1, 10, 1, None), (6, 1, 10, 1, 3)])
    assert rows(pairing.pair_counts(ground, cameras)) == [(1, 1, None, 11)]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_against_brute_force_with_a_hot_slot(spark, parts):
    rng = random.Random(5)
    slot = lambda: 1 if rng.random() < 0.4 else rng.randrange(2, 30)
    ground = [(i, rng.randrange(3), slot(), rng.randrange(1, 4), rng.randrange(4)) for i in range(300)]
    cams = [(i, rng.randrange(3), slot(), rng.randrange(1, 4), rng.randrange(4)) for i in range(500)]
    g, c = frames(spark, ground, cams)
    got = rows(pairing.pair_counts(g.repartition(parts), c.repartition(parts)))
    want = []
    for seq, site, s, _, _ in ground:
        for loc in (1, 2, 3):
            found = [r for r in cams if r[1:4] == (site, s, loc)]
            want.append((seq, loc, found[0][4], 10 * site + loc) if found else (seq, loc, None, None))
    assert got == sorted(want, key=str)


def test_unknown_ground_count_makes_true_zeros_unknown(spark):
    df = spark.createDataFrame(
        [(1, 0, 0), (1, 0, 3), (2, 0, 0), (2, 0, None), (3, 5, 0)], "site_id int, cam_count int, ground_count int"
    )
    got = {r["site_id"]: (r["n_zero_cam"], r["n_zero_eff"]) for r in pairing.true_zero_counts(df, ["site_id"]).collect()}
    assert got == {1: (2, 1), 2: (2, None)}


def test_partitions_of_pairs(spark):
    df = spark.createDataFrame(
        [(1, 0, 0), (2, 0, 3), (3, 2, 1), (4, None, 1), (5, 0, None)], "obs_seq int, cam_count int, ground_count int"
    )
    assert [r[0] for r in pairing.positive_pairs(df).collect()] == [3]
    assert [r[0] for r in pairing.false_zeros(df).collect()] == [2]


def test_holdout_depends_on_keys_alone(spark):
    df = spark.range(4000).select(
        F.col("id").alias("obs_seq"), (F.col("id") % 3).cast("int").alias("cam_location"),
        F.when(F.col("id") % 10 > 0, 1).alias("cam_count"),
    )
    sides = []
    for parts in (1, 4, 17):
        train, valid = pairing.holdout_split(df.repartition(parts), 0.8, seed=4)
        sides.append((frozenset(r[0] for r in train.collect()), frozenset(r[0] for r in valid.collect())))
    assert len(set(sides)) == 1
    train, valid = sides[0]
    assert not train & valid and abs(len(train) / 4000 - 0.8) < 0.03
    assert all(i % 10 for i in valid)


def test_brute_force_true_zeros(spark):
    rng = random.Random(2)
    data = [(rng.randrange(3), rng.randrange(2), rng.randrange(3)) for _ in range(400)]
    df = spark.createDataFrame(data, "hour int, cam_count int, ground_count int")
    got = pairing.true_zero_counts(df, ["hour"]).toPandas().set_index("hour").sort_index()
    zero = pd.DataFrame(data, columns=["hour", "c", "g"]).query("c == 0")
    assert got["n_zero_cam"].to_dict() == zero.groupby("hour").size().to_dict()
    assert got["n_zero_eff"].to_dict() == zero.groupby("hour").g.apply(lambda g: (g == 0).sum()).to_dict()
