import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorfill.operators import coverage


def hours(spark, rows):
    """Rows of (year, site, day, cam_count); obs_seq is their order."""
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "obs_seq long, year int, site_id int, julian_day int, cam_count int",
    )
    extra = set(coverage.HOUR_KEYS) - set(df.columns) - {"is_zero"}
    return coverage.camera_hours(df.withColumns({c: F.lit(1) for c in sorted(extra)}))


def test_a_season_at_exactly_the_cutoff_stays(spark):
    rows = [(2010, 1, d, 0) for d in range(10)] + [(2010, 2, d, 1) for d in range(3)]
    rows += [(2010, 3, d, 1) for d in range(2)]
    table = hours(spark, rows)
    share = coverage.season_coverage(coverage.season_days(table))
    kept = coverage.drop_low_coverage(table, share, 0.3)
    assert {r["site_id"] for r in kept.select("site_id").distinct().collect()} == {1, 2}
    assert coverage.days_total(coverage.season_days(table)).first()[0] == 10


def test_days_count_rows_with_an_unknown_count(spark):
    days = coverage.season_days(hours(spark, [(2010, 1, 5, None), (2010, 1, 5, 0), (2010, 1, 6, None)]))
    got = {r["julian_day"]: (r["n_rows"], r["n_zero"], r["n_pos"]) for r in days.collect()}
    assert got == {5: (2, 1, 0), 6: (1, 0, 0)}
    assert coverage.merge_daily(days).count() == 1


def test_calendar_and_day_list(spark):
    days = coverage.season_days(hours(spark, [(2010, 1, 9, 2), (2010, 1, 7, 0), (2010, 2, 8, 1)]))
    calendar = {(r["site_id"], r["julian_day"]): (r["n_zero"], r["n_pos"]) for r in coverage.season_day_calendar(days).collect()}
    assert calendar == {
        (1, 7): (1, 0), (1, 8): (0, 0), (1, 9): (0, 1), (2, 7): (0, 0), (2, 8): (0, 1), (2, 9): (0, 0),
    }
    listed = sorted((r["site_id"], r["k"], r["julian_day"]) for r in coverage.season_day_list(days).collect())
    assert listed == [(1, 1, 9), (1, 2, 7), (2, 1, 8)]  # by appearance, not by day


def test_groups_whose_joined_codes_would_be_equal_stay_apart(spark, many_parts):
    # Season 1 and day 121, season 11 and day 21: both spell 1121.
    days = coverage.season_days(hours(spark, [(2010, 1, 121, 0), (2010, 11, 21, 0), (2010, 11, 21, 4)]))
    merged = {(r["site_id"], r["julian_day"]): (r["zero_group"], r["pos_group"]) for r in coverage.merge_daily(days).collect()}
    assert merged == {(11, 21): (1, 1), (1, 121): (2, None)}


def test_sensors_per_slot_counts_parts_apart(spark):
    df = spark.createDataFrame(
        [(1, 2010, 1, 5, 8, 0), (2, 2010, 1, 5, 8, 0), (3, 2010, 1, 5, 8, 4), (4, 2010, 1, 5, 9, 0), (5, 2010, 1, 5, 8, None)],
        "obs_seq long, year int, site_id int, julian_day int, hour int, cam_count int",
    )
    assert {r["obs_seq"]: r["n_cam"] for r in coverage.sensors_per_slot(df).collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    assert {r["obs_seq"]: r["day_index"] for r in coverage.day_index(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 3}


def test_match_index_gives_null_where_absent(spark):
    dictionary = coverage.sensor_dictionary(
        spark.createDataFrame([(1, 2), (11, 1)], "site_id int, location int"),
        spark.createDataFrame([(1, 2), (2, 1)], "site_id int, location int"),
    )
    df = spark.createDataFrame([(1, 2), (2, 1), (11, 1), (5, 5)], "site_id int, location int")
    got = {tuple(r)[:2]: r["sensor_idx"] for r in coverage.match_index(df, dictionary, ["site_id", "location"]).collect()}
    assert got == {(1, 2): 1, (2, 1): 2, (11, 1): 3, (5, 5): None}
    assert coverage.known_sensors_only(df, dictionary).count() == 3


@pytest.mark.parametrize("n", [1, 2, 97])
def test_table_summary_is_exact(spark, many_parts, n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 9, n), rng.normal(size=n)
    data = [(int(a), float(b), None) for a, b in zip(x, y)] + [(None, None, None)]
    df = spark.createDataFrame(data, "x int, y double, z double").repartition(5)
    got = {r["column"]: r for r in coverage.table_summary(df, ["x", "y", "z"]).collect()}
    for name, v in (("x", x), ("y", y)):
        r = got[name]
        want = [v.min(), *np.quantile(v, [0.25, 0.5, 0.75]), v.max(), v.mean()]
        assert np.allclose([r["min"], r["q1"], r["median"], r["q3"], r["max"], r["mean"]], want)
        assert (r["n_null"], r["n_rows"]) == (1, n + 1)
    assert got["z"]["n_null"] == n + 1 and got["z"]["median"] is None


def test_unmatched_keys(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(map(tuple, coverage.unmatched_keys(a, b, ["k"]).collect())) == [(1, 1, 0), (3, 0, 1)]
