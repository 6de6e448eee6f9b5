"""Camera rows to impute: selection, coverage, dictionaries and day tables.

``camera_hours`` counts the rows once; ``season_days`` reduces that to at most 366
rows per site-season. The coverage, calendar and gap-filling steps all work on
these two tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.operators.scale import (
    global_index,
    lookup_join,
    running_number,
    running_sums,
)


def is_zero() -> Column:
    return F.col("cam_count") == 0


def is_positive() -> Column:
    return F.col("cam_count") > 0


def imputation_rows(cameras: DataFrame, min_year: int = S.FIRST_IMPUTED_YEAR) -> DataFrame:
    """Camera rows from ``min_year`` on, with an unknown ground count."""
    return cameras.filter(F.col("year") >= min_year).withColumn(
        "ground_count", F.lit(None).cast("int")
    )


def restrict_to(df: DataFrame, year: int, site_id: int) -> DataFrame:
    """The rows of one site-season."""
    return df.filter((F.col("year") == year) & (F.col("site_id") == site_id))


def add_day_keys(rows: DataFrame) -> DataFrame:
    """Packed day and day-hour labels of rows that carry ``season_idx``."""
    return rows.withColumns(
        {
            "season_day_code": 1000 * F.col("season_idx") + F.col("julian_day"),
            "day_hour_season_code": 100000 * F.col("julian_day")
            + 1000 * F.col("hour")
            + F.col("season_idx"),
        }
    )


def zero_positive_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter(is_zero()), rows.filter(is_positive())


def covariate_columns(df: DataFrame) -> DataFrame:
    """``afternoon`` as 0/1; ``weekend`` already is."""
    return df.withColumn("afternoon", F.col("time_of_day") - 1)


# --- day tables -----------------------------------------------------------------

HOUR_KEYS = list(
    dict.fromkeys(
        [*S.SEASON_DAY, "hour", "location", "time_of_day", "weekend", "is_zero", "p_seen"]
        + S.SEASON_ATTRIBUTES
    )
)


def camera_hours(rows: DataFrame) -> DataFrame:
    """Camera rows counted per site-season, day, hour, sensor and part.

    ``n_rows`` is a row's number, one where the column is missing.

    Everything after the pairing needs no more than this table, whose size follows
    the sensors and hours, not the rows. Rows with an unknown count are kept as a
    part of their own, as they count as observed.
    """
    n = F.col("n_rows") if "n_rows" in rows.columns else F.lit(1)
    return (
        rows.withColumn("is_zero", is_zero())
        .groupBy(*HOUR_KEYS)
        .agg(
            F.sum(n).alias("n_rows"),
            F.sum(F.col("cam_count") * n).alias("cam_sum"),
            F.min("obs_seq").alias("first_seq"),
        )
    )


def season_days(hours: DataFrame) -> DataFrame:
    """One row per site-season and observed day, with its number of rows.

    Works on ``camera_hours``.
    """
    n = F.col("n_rows")

    def total(rows: Column) -> Column:
        return F.sum(F.when(rows, n).otherwise(0))

    return hours.groupBy(*S.SEASON_DAY).agg(
        F.sum(n).alias("n_rows"),
        total(F.col("is_zero")).alias("n_zero"),
        total(~F.col("is_zero")).alias("n_pos"),
        F.min("first_seq").alias("first_seq"),
    )


def days_total(days: DataFrame) -> DataFrame:
    """Number of different days over all site-seasons, as one row."""
    return days.agg(F.count_distinct("julian_day").alias("n_days_total"))


def season_coverage(days: DataFrame) -> DataFrame:
    """Observed days of each site-season and their share of all days."""
    total = days_total(days).scalar()
    return (
        days.groupBy(*S.SEASON)
        .agg(F.count(F.lit(1)).alias("n_days"))
        .withColumn("share", F.col("n_days") / total)
    )


def drop_low_coverage(
    rows: DataFrame, coverage: DataFrame, cutoff: float = S.COVERAGE_CUTOFF
) -> DataFrame:
    """Rows of site-seasons with at least ``cutoff`` of all days.

    Apply it to the calibration pairs as well to leave them out there too.
    """
    kept = coverage.filter(F.col("share") >= cutoff).select(*S.SEASON)
    return lookup_join(rows, kept, S.SEASON, "left_semi")


def obs_per_day(days: DataFrame) -> DataFrame:
    """Rows per site-season and day, for the zero and the positive part."""
    parts = F.stack(F.lit(2), F.lit("zero"), F.col("n_zero"), F.lit("positive"), F.col("n_pos"))
    return days.select(*S.SEASON_DAY, parts.alias("part", "n_obs")).filter("n_obs > 0")


def days_per_season(days: DataFrame) -> DataFrame:
    return days.groupBy(*S.SEASON).agg(F.count(F.lit(1)).alias("n_days"))


def day_range(days: DataFrame) -> DataFrame:
    """Number of different days and the last day, as one row."""
    return days.agg(
        F.count_distinct("julian_day").alias("n_days"), F.max("julian_day").alias("max_day")
    )


def season_day_list(days: DataFrame) -> DataFrame:
    """The k-th observed day of each site-season, in order of appearance."""
    # At most 366 days per site-season, so a plain window is bounded.
    by_appearance = Window.partitionBy(*S.SEASON).orderBy("first_seq")
    return days.select(
        *S.SEASON, F.row_number().over(by_appearance).alias("k"), "julian_day"
    )


def season_day_calendar(days: DataFrame) -> DataFrame:
    """Every day of the observed range for every site-season, with its counts."""
    span = days.agg(F.sequence(F.min("julian_day"), F.max("julian_day")))
    calendar = days.select(*S.SEASON).distinct().withColumn(
        "julian_day", F.explode(span.scalar())
    )
    return calendar.join(days, S.SEASON_DAY, "left").select(
        *S.SEASON_DAY,
        F.coalesce("n_zero", F.lit(0)).alias("n_zero"),
        F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
    )


def merge_daily(days: DataFrame) -> DataFrame:
    """Days with a zero or a positive part, and the ordinal of each part's group.

    Groups are numbered by day, then site-season, over the whole table; a missing
    part has a NULL ordinal. The day table already holds both parts, so the two
    numberings come from one sorted pass instead of an outer join.
    """
    zero, positive = F.col("n_zero") > 0, F.col("n_pos") > 0
    parts = days.filter(zero | positive).select(*S.SEASON_DAY, "n_zero", "n_pos")
    numbered = running_sums(
        parts,
        ["julian_day", *S.SEASON],
        {"zero_group": zero.cast("int"), "pos_group": positive.cast("int")},
    )
    return numbered.withColumns(
        {
            "zero_group": F.when(zero, F.col("zero_group")),
            "pos_group": F.when(positive, F.col("pos_group")),
        }
    )


def group_ordinal(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Each zero or positive row with the ordinal of its day group."""
    groups = merged.select(*S.SEASON_DAY, "zero_group", "pos_group")
    ordinal = F.when(is_zero(), F.col("zero_group")).otherwise(F.col("pos_group"))
    # A row for each day at most, so the camera rows need no shuffle.
    known = lookup_join(rows.filter(is_zero() | is_positive()), groups, S.SEASON_DAY)
    return known.withColumn("group_ordinal", ordinal).drop("zero_group", "pos_group")


# --- windows --------------------------------------------------------------------


def sensors_per_slot(rows: DataFrame) -> DataFrame:
    """Add ``n_cam``: rows of the same part, site-season, day and hour.

    Counted by an aggregate and joined back, so that an hour with very many rows
    is combined before the shuffle and its rows can be split between tasks; a
    window would hold them in one.
    """
    rows = rows.filter(is_zero() | is_positive()).withColumn("is_zero", is_zero())
    keys = [*S.SEASON_DAY, "hour", "is_zero"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cam"))
    return lookup_join(rows, counts, keys)


def day_index(rows: DataFrame) -> DataFrame:
    """Add the running number of each row in its part, site-season and day."""
    rows = rows.filter(is_zero() | is_positive()).withColumn("is_zero", is_zero())
    return running_number(rows, [*S.SEASON_DAY, "is_zero"], "obs_seq", "day_index")


# --- dictionaries ---------------------------------------------------------------


def reindex_seasons(days: DataFrame) -> DataFrame:
    """``(year, site_id, season_idx)``: site-seasons numbered 1..n in order."""
    return global_index(days.select(*S.SEASON).distinct(), S.SEASON, "season_idx")


def sensors_of(df: DataFrame, location: str = "location") -> DataFrame:
    return df.select("site_id", F.col(location).alias("location")).distinct()


def sensor_dictionary(*sensors: DataFrame) -> DataFrame:
    """``(site_id, location, sensor_idx)``: all sensors of the tables, 1..n.

    Give it the calibration partitions and the imputation rows, or a part of them
    for a dictionary of their own.
    """
    together = reduce(DataFrame.unionByName, [s.select(*S.SENSOR) for s in sensors])
    return global_index(together.distinct(), S.SENSOR, "sensor_idx")


def match_index(df: DataFrame, dictionary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the dictionary's index to each row; NULL where the key is not in it."""
    return lookup_join(df, dictionary, on, "left")


def known_sensors_only(rows: DataFrame, sensors: DataFrame) -> DataFrame:
    """Rows whose sensor occurs in ``sensors``."""
    return lookup_join(rows, sensors.select(*S.SENSOR), S.SENSOR, "left_semi")


def sensor_p_seen(cameras: DataFrame) -> DataFrame:
    return cameras.select(*S.SENSOR, "p_seen").distinct()


def align_p_seen(dictionary: DataFrame, p_seen: DataFrame) -> DataFrame:
    """``p_seen`` by sensor index; sensors without one are left out."""
    return dictionary.join(p_seen, S.SENSOR).select("sensor_idx", *S.SENSOR, "p_seen")


# --- inspection -----------------------------------------------------------------


def partition_profile(partitions: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows and different sensors of each named partition.

    ``partitions`` maps a name to a table and its two sensor columns.
    """
    rows = [
        df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("part"), "n")
        for name, (df, keys) in partitions.items()
    ]
    return (
        reduce(DataFrame.unionByName, rows)
        .groupBy("part")
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_sensors"))
    )


def table_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and NULL count of numeric columns.

    Exact at any size: values are counted, sorted over all tasks and picked by
    rank; no task holds a whole column.
    """
    pairs: list[Column] = []
    for name in columns:
        pairs += [F.lit(name), F.col(name).cast("double")]
    long = df.select(F.stack(F.lit(len(columns)), *pairs).alias("column", "value"))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Columns follow each other in one order; NULLs come first in each.
    ranked = running_sums(counts, ["column", "value"], {"upto": F.col("n")})
    totals = ranked.groupBy("column").agg(
        (F.max("upto") - F.sum("n")).alias("before"),
        F.sum("n").alias("n_all"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean"),
    )
    totals = totals.withColumn("n_val", F.col("n_all") - F.col("n_null"))
    placed = (
        ranked.filter(F.col("value").isNotNull())
        .join(F.broadcast(totals), "column")
        .withColumn("last", F.col("upto") - F.col("before") - F.col("n_null") - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )

    def order_statistic(position: Column) -> Column:
        here = (F.col("first") <= position) & (position <= F.col("last"))
        return F.max(F.when(here, F.col("value")))

    picks = []
    for i, p in enumerate((0.25, 0.5, 0.75)):
        h = (F.col("n_val") - 1) * p
        picks += [
            order_statistic(F.floor(h)).alias(f"lo{i}"),
            order_statistic(F.ceil(h)).alias(f"hi{i}"),
        ]
    picked = placed.groupBy("column").agg(*picks)

    def quartile(i: int, p: float) -> Column:
        h = (F.col("n_val") - 1) * p
        return F.col(f"lo{i}") + (h - F.floor(h)) * (F.col(f"hi{i}") - F.col(f"lo{i}"))

    return totals.join(F.broadcast(picked), "column", "left").select(
        "column", "min", quartile(0, 0.25).alias("q1"), quartile(1, 0.5).alias("median"),
        "mean", quartile(2, 0.75).alias("q3"), "max", "n_null", F.col("n_all").alias("n_rows"),
    )


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur in one of the two tables only, and in which."""
    sides = (
        left.select(*keys).withColumns({"in_left": F.lit(1), "in_right": F.lit(0)})
    ).unionByName(right.select(*keys).withColumns({"in_left": F.lit(0), "in_right": F.lit(1)}))
    return (
        sides.groupBy(*keys)
        .agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))
        .filter(F.col("in_left") != F.col("in_right"))
    )
