"""From raw tables to keyed observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.operators.scale import as_lookup, global_index


def dedup_rows(df: DataFrame, seq: str = "obs_seq") -> DataFrame:
    """Drop rows equal in every column but ``seq``; keep the first of them.

    Copies are combined before the shuffle, so a row repeated a billion times
    crosses the network once per task. NULL equals NULL.
    """
    columns = [c for c in df.columns if c != seq]
    return df.groupBy(*columns).agg(F.min(seq).alias(seq))


def normalize_observations(df: DataFrame) -> DataFrame:
    return df.drop(*S.OBSERVATION_UNUSED).withColumnsRenamed(S.OBSERVATION_NAMES)


def normalize_sites(df: DataFrame) -> DataFrame:
    return df.drop(*S.SITE_UNUSED).withColumnsRenamed(S.SITE_NAMES)


def assign_site_ids(observations: DataFrame) -> DataFrame:
    """``(name, site_id)``: 1..n over all observed names in alphabetical order.

    Ids are given before any site is excluded, so they may have gaps later. A missing
    name gets none.
    """
    names = observations.select("name").filter(F.col("name").isNotNull())
    return global_index(names.distinct(), ["name"], "site_id")


def site_table(observations: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per observed site: its id and its attributes, matched by name.

    A site may be listed again with the same attributes, not with others.
    """
    attributes = sites.select("name", *S.SITE_ATTRIBUTES).distinct()
    twice = attributes.filter(F.col("name").isNotNull()).groupBy("name").count().filter("count > 1")
    if (first := twice.orderBy("name").first()) is not None:
        raise ValueError(f"site {first['name']!r} is listed with different attributes")
    return as_lookup(assign_site_ids(observations).join(attributes, "name", "left"))


def join_sites(observations: DataFrame, site_dim: DataFrame) -> DataFrame:
    """Attach the columns of ``site_table``; a site without attributes gets NULLs."""
    return observations.join(site_dim, "name", "left")


def exclude_sites(df: DataFrame, names: Sequence[str] = S.EXCLUDED_SITES) -> DataFrame:
    """Leave out the named sites; rows without a name are none of them and stay."""
    return df.filter(F.coalesce(~F.col("name").isin(*names), F.lit(True)))


def slot(datetime: Column) -> Column:
    """The time slot, a hundredth of a day, as an exact integer."""
    return F.round(datetime * 100).cast("bigint")


def add_keys(df: DataFrame) -> DataFrame:
    """Season and time-slot keys, and their packed forms for output.

    ``season_code`` and ``slot_code`` are labels only: joins and groups use
    ``(year, site_id)`` and ``(site_id, slot)``.
    """
    return (
        df.withColumn("slot", slot(F.col("datetime")))
        .withColumns(
            {
                "season_code": 100 * F.col("year") + F.col("site_id"),
                "slot_code": 1000 * F.col("slot") + F.col("site_id"),
            }
        )
        .drop("name", "datetime")
    )


def ground_rows(keyed: DataFrame) -> DataFrame:
    return (
        keyed.filter(F.col("method") == S.GROUND)
        .withColumnRenamed("angler_count", "ground_count")
        .drop("method")
    )


def camera_rows(keyed: DataFrame) -> DataFrame:
    return (
        keyed.filter(F.col("method") == S.CAMERA)
        .withColumnRenamed("angler_count", "cam_count")
        .withColumn("sensor_code", 10 * F.col("site_id") + F.col("location"))
        .drop("method")
    )


def split_by_method(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ground rows and camera rows."""
    return ground_rows(keyed), camera_rows(keyed)


def key_rows(
    observations: DataFrame, site_dim: DataFrame, excluded: Sequence[str] = S.EXCLUDED_SITES
) -> DataFrame:
    """Normalized rows with site ids, attributes and keys.

    Rows without a site name belong to no site and are left out here.
    """
    named = exclude_sites(observations, excluded).filter(F.col("name").isNotNull())
    return add_keys(join_sites(named, site_dim))


def prepare_observations(
    raw_observations: DataFrame,
    raw_sites: DataFrame,
    excluded: Sequence[str] = S.EXCLUDED_SITES,
) -> DataFrame:
    """Raw tables to unique, keyed observations with site attributes."""
    copies = normalize_observations(raw_observations)
    # Ids need the names only: a scan of one column, without the deduplication.
    site_dim = site_table(copies, normalize_sites(raw_sites))
    unique = normalize_observations(dedup_rows(raw_observations))
    return key_rows(unique, site_dim, excluded)
