from pyspark.sql import functions as F

from sensorfill.operators import prepare

OBS = "obs_seq long, year int, name string, method string, datetime double, location int, angler_count int"


def test_dedup_keeps_the_first_and_takes_null_as_equal(spark):
    df = spark.createDataFrame(
        [(3, "a", None), (1, "a", None), (2, "a", 5), (7, None, None), (9, None, None)],
        "obs_seq long, x string, y int",
    )
    got = sorted(map(tuple, prepare.dedup_rows(df).select("x", "y", "obs_seq").collect()), key=str)
    assert got == sorted([("a", None, 1), ("a", 5, 2), (None, None, 7)], key=str)


def test_ids_are_alphabetical_and_keep_gaps_after_exclusion(spark):
    df = spark.createDataFrame([(n,) for n in ("b", "a", "LAKE_2", "LAKE_10", "b")], "name string")
    ids = {r["name"]: r["site_id"] for r in prepare.assign_site_ids(df).collect()}
    assert ids == {"LAKE_10": 1, "LAKE_2": 2, "a": 3, "b": 4}
    kept = prepare.exclude_sites(prepare.assign_site_ids(df), ["LAKE_2"])
    assert sorted(r["site_id"] for r in kept.collect()) == [1, 3, 4]


def test_sites_are_joined_by_name_not_by_place(spark):
    obs = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    zeros = {c: F.lit(0.0) for c in prepare.S.SITE_ATTRIBUTES}
    sites = spark.createDataFrame([("y", 2.0), ("x", 1.0)], "name string, a double")
    sites = sites.withColumns(zeros).withColumn("area", F.col("a"))
    joined = prepare.join_sites(obs, prepare.site_table(obs, sites))
    assert {r["name"]: r["area"] for r in joined.collect()} == {"x": 1.0, "y": 2.0, "z": None}


def test_keys_do_not_collide_where_packed_codes_do(spark):
    df = spark.createDataFrame(
        [(1, 2010, "a", "CAM", 1.0, 11, 0), (2, 2009, "a", "CAM", 1.0, 1, 0)], OBS
    ).withColumn("site_id", F.when(F.col("year") == 2010, 1).otherwise(101))
    keyed = prepare.add_keys(df)
    assert keyed.select("season_code").distinct().count() == 1
    assert keyed.select("year", "site_id").distinct().count() == 2


def test_slots_are_hundredths_of_a_day(spark):
    df = spark.createDataFrame([(1.004,), (1.006,), (3414.3333333,), (None,)], "d double")
    assert [r[0] for r in df.select(prepare.slot(F.col("d"))).collect()] == [100, 101, 341433, None]


def test_split_by_method(spark):
    df = spark.createDataFrame(
        [(1, 2010, "a", "CAM", 1.0, 2, 5), (2, 2010, "a", "GR", 1.0, 1, 7), (3, 2010, "a", "?", 1.0, 1, 7)],
        OBS,
    ).withColumn("site_id", F.lit(4))
    ground, cameras = prepare.split_by_method(prepare.add_keys(df))
    assert [r["ground_count"] for r in ground.collect()] == [7]
    assert [(r["cam_count"], r["sensor_code"]) for r in cameras.collect()] == [(5, 42)]
