"""The test tables seen as raw counts and raw sites.

Every event is one count at the nation ``user_id % 25``; every nation is a site.
Clicks and errors are ground counts, the rest camera counts. While a camera is
down, its counts are made from the ground. No row is dropped. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_NATIONS = 25


def raw_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_name").alias("Lake"),
        (10.0 + 5 * (key % 4)).alias("SA"),
        F.floor(key / 13).cast("int").alias("Access"),
        ((key * 37) % 100).cast("double").alias("DistKam"),
        ((key * 53) % 100).cast("double").alias("DistVan"),
        ((3 + key % 7) / 10.0).alias("Pseen"),
        (key % 2).alias("Launch"),
        (key % 3).alias("Camp"),
        (key % 5).alias("Resort"),
        key.cast("string").alias("WBID"),
        F.col("r_name").alias("Region"),
        (key * 100.0).alias("Elevation"),
        (key * 2.0).alias("Perim"),
        (key * 3.0).alias("Mdepth"),
        (key * 1.5).alias("MuDepth"),
        (key * 1.0).alias("Distgravel"),
    )


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    site = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        "n_nationkey", "n_name", "r_name"
    )
    key, ts = F.col("n_nationkey"), F.col("ts")
    year = (2008 + F.col("event_id") % 3).cast("int")
    day = F.dayofyear(ts) + 120
    hour = (8 + 4 * F.floor(F.hour(ts) / 8)).cast("int")
    down = (
        ((key == 11) & (day > 128))
        | ((key % 2 == 0) & ((day + 3 * key) % 6 == 0))
        | ((key % 3 == 1) & day.between(140, 144))
    )
    ground = F.col("event_type").isin("click", "error") | down
    return events.join(
        site, (F.col("user_id") % N_NATIONS).cast("int") == F.col("n_nationkey")
    ).select(
        F.col("event_id").alias("obs_seq"),
        year.alias("Year"),
        F.col("n_name").alias("Name"),
        F.col("r_name").alias("Region"),
        F.when(ground, "GR").otherwise("CAM").alias("Method"),
        hour.alias("Hour"),
        F.floor(F.col("value") / 25).cast("int").alias("TotalAnglerCount"),
        day.alias("DoY"),
        F.when(hour >= 12, 2).otherwise(1).alias("ToD"),
        ((year - 2000) * 366 + day + hour / F.lit(24.0)).alias("datetime"),
        (1 + F.col("event_id") % 2).cast("int").alias("location"),
        (F.weekday(ts) >= 5).cast("int").alias("weekend"),
        F.to_date(ts).cast("string").alias("Date"),
        F.dayofmonth(ts).alias("Day"),
        F.month(ts).alias("Month"),
        key.cast("string").alias("WBID"),
        F.concat(hour.cast("string"), F.lit(":00")).alias("Time"),
        F.lit(1).alias("Include"),
        F.weekday(ts).cast("string").alias("DoW"),
    )
