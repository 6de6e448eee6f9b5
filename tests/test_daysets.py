import random

import pytest
from pyspark.sql import functions as F

from sensorfill.operators import coverage, daysets, gapfill

HOURS = "year int, site_id int, julian_day int, is_zero boolean, n_rows long, first_seq long"
DONORS = "year int, site_id int, donor_site_id int, donor_rank int"


def hours(spark, seed=1, days=(-3, 0, 1, 2, 63, 64, 65, 127, 128, 366, 486), sites=6):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        rows.append((2010 + i % 2, rng.randrange(sites), rng.choice(days), rng.choice([True, False, None]), rng.randrange(1, 4), i))
    return spark.createDataFrame(rows, HOURS)


def rows_of(df):
    return sorted(tuple(sorted(r.asDict().items())) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    table = hours(spark)
    days = coverage.season_days(table)
    donors = [(y, s, (s + k) % 8, k) for y in (2010, 2011) for s in range(7) for k in (1, 2)]
    donors = spark.createDataFrame(donors, DONORS)
    sets = daysets.season_sets(table)
    return days, gapfill.donor_days(donors, days), sets, daysets.pair_sets(donors, sets)


def test_days_come_back(tables):
    days, _, sets, _ = tables
    got = daysets.exploded(sets.select("year", "site_id", "observed"), "observed")
    assert rows_of(got) == rows_of(days.select("year", "site_id", "julian_day"))
    known = daysets.exploded(sets.select("year", "site_id", "known"), "known")
    assert rows_of(known) == rows_of(days.filter("n_zero + n_pos > 0").select("year", "site_id", "julian_day"))
    assert daysets.days_total(sets).first()[0] == coverage.days_total(days).first()[0]
    assert rows_of(daysets.season_coverage(sets)) == rows_of(coverage.season_coverage(days))


def test_pairs_equal_those_joined_by_day(tables):
    _, given, _, pairs = tables
    assert rows_of(daysets.common_days(pairs)) == rows_of(gapfill.common_days(given))
    assert rows_of(daysets.uncommon_days(pairs)) == rows_of(gapfill.uncommon_days(given))
    assert rows_of(daysets.donor_days(pairs)) == rows_of(given)
    assert rows_of(daysets.donor_usable(pairs)) == rows_of(gapfill.donor_usable(given))


def test_fill_and_active_days(tables):
    days, given, sets, pairs = tables
    usable = gapfill.usable_pairs(gapfill.donor_usable(given))
    want = gapfill.fill_days(given, usable)
    fill = daysets.fill_sets(pairs.filter("usable"))
    assert want.count() > 0 and rows_of(daysets.fill_days(fill)) == rows_of(want)
    assert rows_of(daysets.fill_day_counts(fill)) == rows_of(gapfill.fill_day_counts(want))
    active = gapfill.active_days(days, want)
    assert rows_of(daysets.active_days(sets, fill)) == rows_of(active)
    assert rows_of(daysets.active_day_counts(sets, fill)) == rows_of(gapfill.active_day_counts(active))


def test_rows_without_a_day_and_empty_tables(spark):
    none = spark.createDataFrame([(2010, 1, None, True, 1, 1), (2010, 2, 5, None, 1, 2)], HOURS)
    sets = daysets.season_sets(none)
    assert [(r["site_id"], r["observed"], r["known"]) for r in sets.collect()] == [(2, {0: 32}, {})]
    donors = spark.createDataFrame([(2010, 1, 2, 1)], DONORS)
    assert daysets.pair_sets(donors, sets).count() == 0
    empty = daysets.season_sets(none.filter("false"))
    assert empty.count() == 0 and daysets.days_total(empty).first()[0] == 0
    assert daysets.season_coverage(empty).count() == 0
    assert daysets.fill_sets(daysets.pair_sets(donors, empty).filter("usable")).count() == 0


def test_the_last_bit_of_a_stretch(spark):
    table = spark.createDataFrame([(2010, s, d, True, 1, 1) for s, ds in ((1, [63, 64]), (2, [63, 127])) for d in ds], HOURS)
    pairs = daysets.pair_sets(spark.createDataFrame([(2010, 1, 2, 1)], DONORS), daysets.season_sets(table))
    row = pairs.first()
    assert (row["n_common"], row["n_uncommon"], row["usable"]) == (1, 1, True)
    assert daysets.common_days(pairs).select(F.col("julian_day")).first()[0] == 63
    assert daysets.uncommon_days(pairs).first()["julian_day"] == 127
