"""Ground counts paired with camera counts of the same site and time slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.functions.draws import key_digest, uniform
from sensorfill.operators.scale import materialize

# What tells groups of zero counts apart.
TRUE_ZERO_KEYS = [
    "p_seen", "area", "weekend", "time_of_day", "hour", "year", "cam_location", "site_id",
]


# More location codes than this are a mistake: every ground row is repeated for each.
MAX_LOCATIONS = 1000


def first_camera_counts(cameras: DataFrame) -> DataFrame:
    """The first camera row of each site, slot and location.

    An aggregate with partial sums instead of a ranked window: a slot with any
    number of camera rows reaches the shuffle as one row per task. Copies of a row
    change nothing, so the camera rows need no deduplication first.
    """
    return cameras.groupBy(
        "site_id", "slot", F.col("location").alias("cam_location")
    ).agg(F.min_by("cam_count", "obs_seq").alias("cam_count"))


def _with_sensor_code(pairs: DataFrame) -> DataFrame:
    # Known only where a camera row matched.
    code = 10 * F.col("site_id") + F.col("cam_location")
    return pairs.withColumn("sensor_code", F.when(F.col("matched"), code)).drop("matched")


def matched_pairs(ground: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each ground row with the first camera row of each location in its slot.

    This is ``pair_counts`` without its unmatched rows, which every later step
    drops. Ground rows are shuffled once, on (site, slot), and never multiplied
    before the join.
    """
    first = first_camera_counts(cameras).withColumn("matched", F.lit(True))
    return _with_sensor_code(ground.join(first, ["site_id", "slot"]))


def pair_counts(ground: DataFrame, cameras: DataFrame) -> DataFrame:
    """Every ground row once per location, with the first camera row there.

    ``cam_count`` and ``sensor_code`` are NULL where no camera row matches; a
    ground row without a time slot matches none. ``location`` stays that of the
    ground row; ``cam_location`` is the camera's.
    """
    # The location codes are a handful of digits; they reach the rows as one array.
    found = F.array_sort(F.collect_list("location"))
    few = F.size(found) <= MAX_LOCATIONS
    error = F.raise_error(F.lit(f"more than {MAX_LOCATIONS} location codes"))
    codes = (
        ground.select("location")
        .unionByName(cameras.select("location"))
        .distinct()
        .agg(F.when(few, found).otherwise(error))
    )
    # Written first, so that both sides of the join are shuffled for it and adaptive
    # execution can split a slot with very many ground rows.
    first = materialize(first_camera_counts(cameras)).withColumn("matched", F.lit(True))
    spread = ground.withColumn("cam_location", F.explode(codes.scalar()))
    return _with_sensor_code(spread.join(first, ["site_id", "slot", "cam_location"], "left"))


def positive_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("cam_count") > 0)


def false_zeros(pairs: DataFrame) -> DataFrame:
    return pairs.filter((F.col("ground_count") > 0) & (F.col("cam_count") == 0))


def true_zero_counts(
    pairs: DataFrame, keys: Sequence[str] = tuple(TRUE_ZERO_KEYS)
) -> DataFrame:
    """Zero camera counts per group, and how many of them were true zeros.

    A group with an unknown ground count has an unknown number of true zeros.
    Other groupings are given by ``keys``: add ``season_code``, leave out
    ``p_seen``.
    """
    known = F.count("ground_count") == F.count(F.lit(1))
    return (
        pairs.filter(F.col("cam_count") == 0)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_zero_cam"),
            F.when(known, F.count_if(F.col("ground_count") == 0)).alias("n_zero_eff"),
        )
    )


def holdout_split(
    pairs: DataFrame, psamp: float = S.TRAINING_SHARE, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Training and validation pairs; the latter without any NULL.

    A pair's side depends on its keys and the seed alone, so both results agree
    however often and on however many partitions they are computed.
    """
    u = uniform(key_digest(seed, F.col("obs_seq"), F.col("cam_location")))
    return pairs.filter(u < psamp), pairs.filter(u >= psamp).dropna()


def pairings_by_location(pairs: DataFrame) -> DataFrame:
    """Rows and matches of the pairing at each camera location."""
    return pairs.groupBy("cam_location").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("cam_count").alias("n_matched")
    )
