"""Rules for missing values, doubled rows and very large counts, on hand-sized tables."""

import pytest
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.operators import gapfill, impute, prepare
from sensorfill.sources import text

DAYS = "year int, site_id bigint, julian_day int, n_rows bigint, n_zero bigint, n_pos bigint"


def test_a_very_hot_hour_does_not_overflow(spark):
    key = "year int, site_id bigint, julian_day int, location int, time_of_day int, weekend int, p_seen double"
    groups = spark.createDataFrame(
        [(2010, 1, 100, 1, 1, 0, 0.5, zero, 4_000_000_000, 4_000_000_000, 7) for zero in (True, False)],
        f"{key}, is_zero boolean, n_cam bigint, n_rows bigint, cam_sum bigint",
    )
    effects = ", ".join(f"{c} double" for c in ("d", "d_cov", "L", "L_cov", "a", "a_cov"))
    params = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], f"site_id bigint, location int, {effects}")
    rows = {r["is_zero"]: r for r in impute.expected_effort(groups, params).collect()}
    assert rows[True]["effort"] == 0.5
    assert rows[True]["effort_var"] == pytest.approx(0.75 / 4e9)
    assert rows[False]["effort_var"] == pytest.approx(7 / 16e18)


def test_unknown_sensors_and_chances_stay_unknown_in_draws(spark):
    key = "year int, site_id bigint, julian_day int, location int, time_of_day int, weekend int, p_seen double"
    rows = [(2010, 1, 100, 1, 1, 0, None), (2010, 1, 100, 2, 1, 0, 0.5), (2010, 1, 100, 9, 1, 0, 0.5)]
    groups = spark.createDataFrame(
        [(*r, True, 1, 1, 0) for r in rows], f"{key}, is_zero boolean, n_cam bigint, n_rows bigint, cam_sum bigint"
    )
    effects = ["d", "d_cov", "L", "L_cov", "a", "a_cov"]
    params = spark.createDataFrame(
        [(1, i, 9.0, 0.0, 3.0, 0.0, 0.0, 0.0) for i in (1, 2)],
        "site_id bigint, location int, " + ", ".join(f"{c} double" for c in effects),
    )
    for table in (
        impute.expected_effort(groups, params, "prob"),
        impute.draw_efforts(groups, params, ["julian_day", "location"], 1, p_seen_mode="prob"),
    ):
        effort = {r["location"]: r["effort"] for r in table.collect()}
        assert effort[1] is None and effort[9] is None and effort[2] is not None


def test_days_with_only_missing_counts_are_filled(spark):
    # Two equal sites, 10 a day on six days; the first site's last two days are all NULL.
    days = [(2010, site, d, 4, 0, 0 if site == 1 and d > 4 else 4) for site in (1, 2) for d in range(1, 7)]
    days = spark.createDataFrame(days, DAYS)
    effort = [(2010, site, d, 10.0) for site in (1, 2) for d in range(1, 7) if site == 2 or d <= 4]
    effort = spark.createDataFrame(effort, "year int, site_id bigint, julian_day int, effort double")
    donors = spark.createDataFrame(
        [(2010, 1, 2, 1), (2010, 2, 1, 1)], "year int, site_id bigint, donor_site_id bigint, donor_rank int"
    )
    given = gapfill.donor_days(donors, days)
    pairs = gapfill.usable_pairs(gapfill.donor_usable(given))
    filled = gapfill.fill_effort(effort, given, pairs)
    assert sorted((r["site_id"], r["julian_day"], r["effort"]) for r in filled.collect()) == [(1, 5, 10.0), (1, 6, 10.0)]
    annual = {r["site_id"]: r for r in gapfill.effort_annual(effort, filled).collect()}
    assert annual[1]["effort"] == annual[2]["effort"] == 60.0 and annual[1]["n_days"] == 6


def test_common_days_need_both_efforts(spark):
    donor_days = spark.createDataFrame(
        [(2010, 1, 2, 1, d, d < 4) for d in range(1, 5)],
        "year int, site_id bigint, donor_site_id bigint, donor_rank int, julian_day int, common boolean",
    )
    effort = [(2010, 2, d, 10.0) for d in range(1, 5)] + [(2010, 1, 1, 5.0), (2010, 1, 2, None)]
    effort = spark.createDataFrame(effort, "year int, site_id bigint, julian_day int, effort double")
    pairs = donor_days.select(*gapfill.PAIR, "donor_rank").distinct()
    assert [r["effort"] for r in gapfill.fill_effort(effort, donor_days, pairs).collect()] == [5.0]


def site_rows(spark, names, region="r"):
    columns = ["name", *S.SITE_ATTRIBUTES]
    rows = [(n, *([region] * len(S.SITE_ATTRIBUTES))) for n in names]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def test_sites_listed_twice_and_rows_without_a_name(spark):
    seen = spark.createDataFrame([("B",), (None,), ("A",), ("A",)], "name string")
    table = prepare.site_table(seen, site_rows(spark, ["A", "A", "B", None]))
    assert sorted((r["name"], r["site_id"]) for r in table.collect()) == [("A", 1), ("B", 2)]
    with pytest.raises(ValueError, match="'A'"):
        prepare.site_table(seen, site_rows(spark, ["A"]).union(site_rows(spark, ["A"], "other")))
    kept = prepare.exclude_sites(seen, ["B"])
    assert sorted(str(r["name"]) for r in kept.collect()) == ["A", "A", "None"]


def test_text_rows_are_numbered_over_files_and_blocks(spark, tmp_path):
    names = [f.name for f in S.RAW_SITES]
    width = len(names)
    for part in range(3):
        lines = [" ".join(names)] + [" ".join([str(1000 * part + i)] * width) for i in range(400)]
        (tmp_path / f"{part}.txt").write_text("\n".join(lines) + "\n")
    small = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(small)
    spark.conf.set(small, "4k")  # many blocks in each file
    try:
        rows = text.read_table(spark, str(tmp_path), S.RAW_SITES).orderBy("obs_seq").collect()
    finally:
        spark.conf.set(small, before)
    first = S.RAW_SITES.fieldNames()[0]
    got = [int(float(r[first])) for r in rows]
    assert got == [1000 * part + i for part in range(3) for i in range(400)]
    assert len({r["obs_seq"] for r in rows}) == 1200 and rows[-1]["obs_seq"] < 1300
