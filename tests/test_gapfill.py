import random

import pytest

from sensorfill.operators import gapfill

ATTRS = "year int, site_id int, region string, access int, dist_kam double"
DAYS = "year int, site_id int, julian_day int"


def nearest(rows, n):
    out = set()
    for y, s, r, a, d in rows:
        alike = sorted((abs(d - x[4]), x[1]) for x in rows if (x[0], x[2], x[3]) == (y, r, a) and x[1] != s)
        out |= {(y, s, t, k + 1) for k, (_, t) in enumerate(alike[:n])}
    return out


def found(df):
    return {(r["year"], r["site_id"], r["donor_site_id"], r["donor_rank"]) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 4])
@pytest.mark.parametrize("levels", [1, 3, 40])
def test_nearest_sites_equal_brute_force(spark, many_parts, n, levels):
    # Few levels: many ties, one of them holding most of the sites.
    rng = random.Random(levels)
    rows = [
        (2009 + i % 2, i, "r" + str(i % 3), int(rng.random() < 0.8),
         0.0 if rng.random() < 0.3 else float(rng.randrange(levels)))
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, ATTRS)
    assert found(gapfill.similar_seasons(df, n)) == nearest(rows, n)


def test_a_season_may_have_one_donor_or_none(spark):
    rows = [(2010, 1, "a", 1, 5.0), (2010, 2, "a", 1, 9.0), (2010, 3, "b", 1, 5.0), (2009, 4, "a", 1, 5.0)]
    got = gapfill.donors(spark.createDataFrame(rows, ATTRS)).collect()
    assert {(r["site_id"], r["donor_site_id"], r["n_similar"]) for r in got} == {(1, 2, 1), (2, 1, 1)}


def setup(spark, days, donors):
    d = spark.createDataFrame([(2010, s, t) for s, ts in days.items() for t in ts], DAYS)
    p = spark.createDataFrame(
        [(2010, s, g, r) for s, g, r in donors], "year int, site_id int, donor_site_id int, donor_rank int"
    )
    return d, gapfill.donor_days(p, d)


def effort(spark, values):
    return spark.createDataFrame([(2010, s, t, float(e)) for (s, t), e in values.items()], DAYS + ", effort double")


def test_a_donor_needs_common_and_uncommon_days(spark):
    _, given = setup(spark, {1: [1, 2], 2: [2, 3], 3: [1, 2], 4: [7]}, [(1, 2, 1), (1, 3, 2), (2, 4, 1)])
    got = {(r["site_id"], r["donor_site_id"]): (r["n_common"], r["n_uncommon"], r["usable"]) for r in gapfill.donor_usable(given).collect()}
    assert got == {(1, 2): (1, 1, True), (1, 3): (2, 0, False), (2, 4): (0, 1, False)}


def test_fill_days_and_their_donors(spark):
    days = {1: [1, 2], 2: [2, 3, 4], 3: [1, 4, 5], 6: [2, 3], 7: [2]}
    d, given = setup(spark, days, [(1, 2, 1), (1, 3, 2), (7, 6, 1)])
    pairs = gapfill.usable_pairs(gapfill.donor_usable(given))
    fill = gapfill.fill_days(given, pairs)
    assert sorted((r["site_id"], r["julian_day"]) for r in fill.collect()) == [(1, 3), (1, 4), (1, 5), (7, 3)]
    by_day = {(r["site_id"], r["julian_day"]): (r["donor_ranks"], r["n_donors"]) for r in gapfill.donors_per_fill_day(given, pairs).collect()}
    # The number of donors is the number that has the day.
    assert by_day == {(1, 3): ([1], 1), (1, 4): ([1, 2], 2), (1, 5): ([2], 1), (7, 3): ([1], 1)}
    strict = gapfill.usable_pairs(gapfill.donor_usable(given), require_all_donors=True)
    assert {r["site_id"] for r in gapfill.fill_days(given, strict).collect()} == {1}
    active = {r["site_id"]: r["n_active"] for r in gapfill.active_day_counts(gapfill.active_days(d, fill)).collect()}
    assert active == {1: 5, 2: 3, 3: 3, 6: 2, 7: 2}
    todo = {r["site_id"]: (r["donor_ranks"], r["n_donors"]) for r in gapfill.seasons_to_fill(pairs).collect()}
    assert todo == {1: ([1, 2], 2), 7: ([1], 1)}


def test_fill_effort_scales_and_averages_donors(spark):
    days = {1: [1, 2], 2: [1, 2, 3], 3: [2, 3]}
    _, given = setup(spark, days, [(1, 2, 1), (1, 3, 2)])
    pairs = gapfill.usable_pairs(gapfill.donor_usable(given))
    daily = effort(spark, {(1, 1): 4, (1, 2): 6, (2, 1): 2, (2, 2): 3, (2, 3): 7, (3, 2): 12, (3, 3): 8})
    filled = {(r["site_id"], r["julian_day"]): r["effort"] for r in gapfill.fill_effort(daily, given, pairs).collect()}
    # Donor 2: 7 * 10 / 5 = 14; donor 3: 8 * 6 / 12 = 4.
    assert filled == {(1, 3): 9.0}
    year = {r["site_id"]: (r["observed_effort"], r["filled_effort"], r["n_days"]) for r in gapfill.effort_annual(daily, gapfill.fill_effort(daily, given, pairs)).collect()}
    assert year == {1: (10.0, 9.0, 3), 2: (12.0, 0.0, 3), 3: (20.0, 0.0, 2)}


def test_a_donor_without_common_effort_is_passed_over(spark):
    days = {1: [1], 2: [1, 2], 3: [1, 2]}
    _, given = setup(spark, days, [(1, 2, 1), (1, 3, 2)])
    pairs = gapfill.usable_pairs(gapfill.donor_usable(given))
    daily = effort(spark, {(1, 1): 4, (2, 1): 0, (2, 2): 5, (3, 1): 2, (3, 2): 3})
    assert [r["effort"] for r in gapfill.fill_effort(daily, given, pairs).collect()] == [6.0]
