import random

import pytest

from sensorfill import schema as S
from sensorfill.operators import coverage, model, pairing, prepare, statistics
from sensorfill.plans import effort

RAW = "obs_seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.RAW_OBSERVATIONS)
SITES = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.RAW_SITES)
SETTINGS = effort.Settings(excluded=("out",), n_draws=5, cutoff=0.0)


def raw_rows(n, seed=3):
    """Rows with copies, a hot slot, unknown counts, sites, slots, places and methods."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.3:
            out.append((i, *rng.choice(out)[1:]))
            continue
        hot = rng.random() < 0.4
        day, hour = (3, 9) if hot else (rng.randrange(1, 6), rng.choice([9, 15]))
        name = "a" if hot else rng.choice(["a", "b", "c", "out", None])
        count = rng.choice([0, 0, 1, 4, None])
        when = None if rng.random() < 0.05 else 3000.0 + day + hour / 24
        out.append((
            i, 2010, name, "north", rng.choice(["GR", "CAM", "CAM", None]), hour, count, day, 1 + (hour > 12),
            when, rng.choice([1, 2, None]), day % 2, f"d{day}", day, 5, "w", f"{rng.randrange(3)}", 1, "x",
        ))
    return out


def tables(spark, rows):
    sites = [
        (name, 5.0 + k, k, 1.0 * k, 2.0, 0.5, 1, 0, 0, "w", "north", 1.0, 1.0, 1.0, 1.0, 1.0)
        for k, name in enumerate(["a", "b", "out", "never seen"])
    ]
    return spark.createDataFrame(rows, RAW), spark.createDataFrame(sites, SITES)


def rows_of(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def both(spark):
    raw = tables(spark, raw_rows(600))
    rows = effort.keyed_inputs(*raw, SETTINGS)
    return effort.statistics_stage(*raw, SETTINGS), rows, pairing.matched_pairs(rows.ground, rows.camera_copies)


def test_cells_give_what_the_rows_give(both):
    once, rows, pairs = both
    assert pairs.count() > 100 and once.cells.count() < pairs.count()
    assert rows_of(statistics.true_zero_counts(once.cells)) == rows_of(pairing.true_zero_counts(pairs))
    by = ["site_id", "cam_location", "hour"]
    assert rows_of(statistics.true_zero_counts(once.cells, by)) == rows_of(pairing.true_zero_counts(pairs, by))
    sensors = coverage.sensors_of(rows.camera_copies)
    assert rows_of(once.sensors) == rows_of(sensors)
    for season in (None, (2010, 1), (2010, 99)):
        got = statistics.sensor_stats(once.cells, sensors, season)
        assert rows_of(got) == rows_of(model.sensor_stats(pairs, sensors, season))
    want = model.log_constants(pairs, pairing.true_zero_counts(pairs)).first()[0]
    assert statistics.log_constants(once.cells).first()[0] == pytest.approx(want, rel=1e-12)


def test_unknown_ground_counts_enter_the_numbers_of_pairs_alone(both):
    once, _, pairs = both
    unknown = pairs.filter("ground_count IS NULL").count()
    sums = once.cells.selectExpr("sum(n_pairs) AS n", "sum(zero_rows - zero_known) AS z").first()
    assert unknown > 0 and sums["n"] == pairs.count()
    assert sums["z"] == pairs.filter("ground_count IS NULL AND cam_count = 0").count()


def test_camera_hours_of_counted_rows(both):
    once, rows, _ = both
    assert rows_of(coverage.camera_hours(once.cameras)) == rows_of(coverage.camera_hours(rows.cameras))


def test_cells_of_single_rows_and_of_folds(both):
    once, _, pairs = both
    by_row = statistics.pair_cells(pairs)
    exact = [c for c in by_row.columns if c != "log_counts"]
    assert rows_of(by_row.select(*exact)) == rows_of(once.cells.select(*exact))
    folded = pairs.selectExpr("*", "int(obs_seq % 3) AS fold")
    parts = statistics.pair_cells(folded, ["fold"])
    got = statistics.sensor_stats(parts, None, None, ["fold"])
    assert rows_of(got) == rows_of(model.sensor_stats(folded, None, None, ["fold"]))


def test_partitioning_and_order_change_nothing(spark):
    rows = raw_rows(300, seed=8)
    first, sites = tables(spark, rows)
    again = tables(spark, rows[::-1])[0].repartition(7)
    exact = [*statistics.CELL_KEYS, "n_pairs", "zero_known", "true_zeros", "fz_ground", "pos_cam"]
    one, two = (effort.statistics_stage(r, sites, SETTINGS).cells.select(*exact) for r in (first, again))
    assert rows_of(one) == rows_of(two)


def test_no_rows_give_no_cells(spark):
    once = effort.statistics_stage(*tables(spark, []), SETTINGS)
    assert once.cells.count() == once.sensors.count() == 0
    assert statistics.sensor_stats(once.cells, once.sensors).count() == 0
    assert statistics.log_constants(once.cells).first()[0] is None


def test_observations_are_read_once_by_the_whole_job(spark):
    rows = raw_rows(500, seed=5)
    raw, sites = tables(spark, rows)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = raw.mapInArrow(counted, raw.schema)
    settings = effort.Settings(
        excluded=("out",), n_draws=5, cutoff=0.0, run_all=True, accept_unconverged=True
    )
    out = effort.estimate_effort(watched, sites, settings)
    assert out["dic"].count() == 8
    assert out["annual"].count() > 0 and out["annual_draws"].count() > 0
    assert read.value == len(rows)


def test_slot_counts_keep_every_name_and_are_fewer_than_the_rows(spark):
    rows = raw_rows(400)
    counts = statistics.slot_counts(tables(spark, rows)[0])
    unique = prepare.dedup_rows(tables(spark, rows)[0])
    assert counts.agg({"n_rows": "sum"}).first()[0] == unique.count()
    assert counts.count() < unique.count()
    assert {r["name"] for r in counts.select("name").distinct().collect()} == {"a", "b", "c", "out", None}
