"""The one statistics stage: raw rows are read once, and what needs them starts here.

``slot_counts`` counts the different rows of each site, slot and count. ``keyed_counts``
gives them their site ids, ``matched_counts`` pairs them, and ``pair_cells`` adds the
pairs up by season, sensor, hour and covariate level. True zeros of any grouping, the
sums of the calibration for all or for one season, and the constant of the
log-likelihood are read from the cells, whose number follows the sensors and hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.functions.numeric import ln_factorial
from sensorfill.operators import pairing, prepare
from sensorfill.operators.model import SUMS
from sensorfill.operators.scale import written

#: What later steps read of a row; rows alike in it are one row with their number.
SLOT_KEYS = [
    "name", "region", "method", "year", "julian_day", "hour", "time_of_day", "weekend",
    "slot", "location", "angler_count",
]
CELL_KEYS = [*pairing.TRUE_ZERO_KEYS, "season_code"]


def slot_counts(raw_observations: DataFrame) -> DataFrame:
    """Unique raw rows counted by ``SLOT_KEYS`` in ``n_rows``; ``obs_seq`` is the first's.

    Written to the checkpoint folder by column, so later steps read only what they use.
    Where a ground count was made from makes no difference to it. Sites that are left
    out later are in it, as their names number the others.
    """
    rows = prepare.normalize_observations(prepare.dedup_rows(raw_observations))
    camera = F.col("method") == S.CAMERA
    rows = rows.withColumns(
        {"slot": prepare.slot(F.col("datetime")), "location": F.when(camera, F.col("location"))}
    )
    counted = rows.groupBy(*SLOT_KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("obs_seq").alias("obs_seq")
    )
    return written(counted)


def keyed_counts(
    counts: DataFrame, site_dim: DataFrame, excluded: Sequence[str] = S.EXCLUDED_SITES
) -> DataFrame:
    """``slot_counts`` with site ids, attributes and the season's label."""
    named = prepare.exclude_sites(counts, excluded).filter(F.col("name").isNotNull())
    code = 100 * F.col("year") + F.col("site_id")
    return prepare.join_sites(named, site_dim).withColumn("season_code", code).drop("name")


def matched_counts(keyed: DataFrame) -> DataFrame:
    """``pairing.matched_pairs`` of the counted rows; ``n_rows`` is a pair's number."""
    return pairing.matched_pairs(prepare.ground_rows(keyed), prepare.camera_rows(keyed))


def pair_cells(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums over the pairs of each season, sensor, hour and covariate level (and ``by``).

    ``n_rows`` is a pair's number, one where the column is missing. Pairs with an unknown
    ground count enter ``n_pairs`` and ``zero_rows`` alone.
    """
    n = F.col("n_rows") if "n_rows" in pairs.columns else F.lit(1)
    cam, ground = F.col("cam_count"), F.col("ground_count")
    zero, positive = cam == 0, (cam > 0) & ground.isNotNull()
    false_zero = zero & (ground > 0)
    log_cam = F.when(cam > 0, ground * F.ln(F.greatest(cam, F.lit(1)))).otherwise(0.0)
    sums = {
        "n_pairs": (F.lit(True), n),
        "zero_rows": (zero, n),
        "zero_known": (zero & ground.isNotNull(), n),
        "true_zeros": (zero & (ground == 0), n),
        "false_zeros": (false_zero, n),
        "fz_ground": (false_zero, ground * n),
        "pos_ground": (positive, ground * n),
        "pos_cam": (positive, cam * n),
        "log_counts": (false_zero | positive, (log_cam - ln_factorial(ground)) * n),
    }
    return pairs.groupBy(*by, *CELL_KEYS).agg(
        *[F.sum(F.when(rows, value).otherwise(0)).alias(name) for name, (rows, value) in sums.items()]
    )


def true_zero_counts(
    cells: DataFrame, keys: Sequence[str] = tuple(pairing.TRUE_ZERO_KEYS)
) -> DataFrame:
    """``pairing.true_zero_counts`` for any grouping by keys of the cells."""
    known = F.sum("zero_known") == F.sum("zero_rows")
    return (
        cells.filter(F.col("zero_rows") > 0)
        .groupBy(*keys)
        .agg(
            F.sum("zero_rows").alias("n_zero_cam"),
            F.when(known, F.sum("true_zeros")).alias("n_zero_eff"),
        )
    )


def sensor_stats(
    cells: DataFrame,
    sensors: DataFrame | None = None,
    season: tuple[int, int] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``model.sensor_stats`` from the cells."""
    here = F.lit(True)
    if season is not None:
        here = (F.col("year") == season[0]) & (F.col("site_id") == season[1])
    afternoon, weekend = F.col("time_of_day") - 1, F.col("weekend")
    # The sum, its covariate, the cells it is over, and the cells' column.
    parts: dict[str, tuple[Column, Column, str]] = {
        "false_zeros": (afternoon, F.lit(True), "false_zeros"),
        "zero_pairs": (afternoon, F.lit(True), "zero_known"),
        "fz_ground": (weekend, here, "fz_ground"),
        "fz_rows": (weekend, here, "false_zeros"),
        "pos_ground": (weekend, here, "pos_ground"),
        "pos_cam": (weekend, here, "pos_cam"),
    }
    values = [
        F.when(rows & (level == x), F.col(source)).otherwise(F.lit(0)).cast("bigint").alias(f"{name}_{x}")
        for name, (level, rows, source) in parts.items()
        for x in (0, 1)
    ]
    long = cells.select(*by, "site_id", F.col("cam_location").alias("location"), *values)
    long = long.filter(F.col("location").isNotNull())
    if sensors is not None:
        none = [F.lit(0).cast("bigint").alias(name) for name in SUMS]
        long = long.unionByName(sensors.select(*[F.lit(None).alias(c) for c in by], *S.SENSOR, *none))
    return long.groupBy(*by, *S.SENSOR).agg(*[F.sum(name).alias(name) for name in SUMS])


def log_constants(cells: DataFrame) -> DataFrame:
    """``model.log_constants`` from the cells."""
    n, k = F.col("n_zero_cam"), F.col("n_zero_eff")
    choose = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
    return (
        true_zero_counts(cells)
        .select(choose.alias("c"))
        .unionByName(cells.select(F.col("log_counts").alias("c")))
        .agg(F.sum("c").alias("log_constant"))
    )
