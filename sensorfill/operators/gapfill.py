"""Days without a working camera, filled from the most similar sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.operators.scale import global_index

PAIR = [*S.SEASON, "donor_site_id"]
_ALIKE = ["region", "access", "year"]


def season_attributes(rows: DataFrame) -> DataFrame:
    return rows.select(*S.SEASON_ATTRIBUTES).distinct()


def similar_seasons(attributes: DataFrame, n: int = S.N_DONORS) -> DataFrame:
    """The ``n`` nearest other sites of the same region, access and year.

    Nearest by ``|dist_kam - dist_kam'|``, ties by site id; ``donor_rank`` counts
    from 1. Sites without a distance have and give no donors.

    Distance is one-dimensional, so the answer lies within ``n`` distance levels
    on either side and among the ``n + 1`` lowest site ids of each level. Levels
    are numbered by a sort and joined by number: the pairs tried per season are
    (2n + 1)(n + 1), however many seasons are alike.
    """
    sites = attributes.select("site_id", "dist_kam", *_ALIKE).dropna()
    level = [*_ALIKE, "dist_kam"]
    levels = global_index(sites.select(*level).distinct(), level, "level")
    by_id = Window.partitionBy(*level).orderBy("site_id")
    lowest = (
        sites.withColumn("_r", F.row_number().over(by_id))
        .filter(F.col("_r") <= n + 1)
        .join(levels, level)
        .select(
            *_ALIKE,
            F.col("level").alias("near"),
            F.col("site_id").alias("donor_site_id"),
            F.col("dist_kam").alias("donor_dist"),
        )
    )
    nearest = Window.partitionBy(*S.SEASON).orderBy("distance", "donor_site_id")
    return (
        sites.join(levels, level)
        .withColumn("near", F.explode(F.sequence(F.col("level") - n, F.col("level") + n)))
        .join(lowest, [*_ALIKE, "near"])
        .filter(F.col("site_id") != F.col("donor_site_id"))
        .withColumn("distance", F.abs(F.col("dist_kam") - F.col("donor_dist")))
        .withColumn("donor_rank", F.row_number().over(nearest))
        .filter(F.col("donor_rank") <= n)
        .select(*PAIR, "donor_rank", "distance")
    )


def donors(attributes: DataFrame, n: int = S.N_DONORS) -> DataFrame:
    """``similar_seasons`` with the number of donors each season has."""
    # At most n rows per season, so the window is bounded.
    season = Window.partitionBy(*S.SEASON)
    return similar_seasons(attributes, n).withColumn(
        "n_similar", F.count(F.lit(1)).over(season).cast("int")
    )


def donor_days(donors: DataFrame, days: DataFrame) -> DataFrame:
    """Each day of each donor, and whether the season has that day itself.

    A day on which no count is known is a day to fill, and nothing a donor can give.
    """
    if "n_zero" in days.columns:
        days = days.filter(F.col("n_zero") + F.col("n_pos") > 0)
    given = days.select(
        "year", F.col("site_id").alias("donor_site_id"), "julian_day"
    )
    own = days.select(*S.SEASON_DAY, F.lit(True).alias("own"))
    return (
        donors.select(*PAIR, "donor_rank")
        .join(given, ["year", "donor_site_id"])
        .join(own, S.SEASON_DAY, "left")
        .withColumn("common", F.col("own").isNotNull())
        .drop("own")
    )


def common_days(donor_days: DataFrame) -> DataFrame:
    return donor_days.filter("common").drop("common")


def uncommon_days(donor_days: DataFrame) -> DataFrame:
    return donor_days.filter("not common").drop("common")


def donor_usable(donor_days: DataFrame) -> DataFrame:
    """Common and uncommon days of each pair; usable if there are both."""
    return (
        donor_days.groupBy(*PAIR, "donor_rank")
        .agg(
            F.count_if("common").alias("n_common"),
            F.count_if(~F.col("common")).alias("n_uncommon"),
        )
        .withColumn("usable", (F.col("n_common") > 0) & (F.col("n_uncommon") > 0))
    )


def usable_pairs(
    usable: DataFrame, require_all_donors: bool = False, n: int = S.N_DONORS
) -> DataFrame:
    """Pairs to fill from; optionally only in seasons with all ``n`` donors usable."""
    pairs = usable.filter("usable").select(*PAIR, "donor_rank")
    if require_all_donors:
        full = pairs.groupBy(*S.SEASON).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n)
        pairs = pairs.join(full.select(*S.SEASON), S.SEASON, "left_semi")
    return pairs


def _supplied_days(donor_days: DataFrame, pairs: DataFrame) -> DataFrame:
    return uncommon_days(donor_days).join(pairs.select(*PAIR), PAIR, "left_semi")


def fill_days(donor_days: DataFrame, pairs: DataFrame) -> DataFrame:
    """Days each season can borrow."""
    return _supplied_days(donor_days, pairs).select(*S.SEASON_DAY).distinct()


def fill_day_counts(fill: DataFrame) -> DataFrame:
    return fill.groupBy(*S.SEASON).agg(F.count(F.lit(1)).alias("n_fill"))


def donors_per_fill_day(donor_days: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ranks of the donors that supply each fill day, and how many."""
    return (
        _supplied_days(donor_days, pairs)
        .groupBy(*S.SEASON_DAY)
        .agg(F.array_sort(F.collect_list("donor_rank")).alias("donor_ranks"))
        .withColumn("n_donors", F.size("donor_ranks"))
    )


def active_days(days: DataFrame, fill: DataFrame) -> DataFrame:
    """Own and borrowed days; the two never overlap."""
    own = days.select(*S.SEASON_DAY, F.lit(False).alias("filled"))
    return own.unionByName(fill.select(*S.SEASON_DAY, F.lit(True).alias("filled")))


def active_day_counts(active: DataFrame) -> DataFrame:
    return active.groupBy(*S.SEASON).agg(F.count(F.lit(1)).alias("n_active"))


def seasons_to_fill(pairs: DataFrame) -> DataFrame:
    """Seasons with a usable donor, the number of donors and their ranks."""
    return (
        pairs.groupBy(*S.SEASON)
        .agg(F.array_sort(F.collect_list("donor_rank")).alias("donor_ranks"))
        .withColumn("n_donors", F.size("donor_ranks"))
    )


def fill_effort(
    effort_daily: DataFrame,
    donor_days: DataFrame,
    pairs: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """Effort on each fill day (an inferred formula: a ratio estimator).

    A donor's effort on the day, scaled by the ratio of the two sites' sums over
    their common days, averaged over the donors of that day. Common days on which
    either effort is unknown enter neither sum. A donor whose sum over the common
    days is zero is passed over. ``by`` names further keys of
    ``effort_daily``, such as the draw.
    """
    by = list(by)
    own = effort_daily.select(*by, *S.SEASON_DAY, F.col("effort").alias("own_effort"))
    given = effort_daily.select(
        *by, "year", F.col("site_id").alias("donor_site_id"), "julian_day",
        F.col("effort").alias("donor_effort"),
    )
    wanted = donor_days.join(pairs.select(*PAIR), PAIR, "left_semi")
    both = wanted.join(given, ["year", "donor_site_id", "julian_day"]).join(
        own, [*by, *S.SEASON_DAY], "left"
    )
    # A season and donor share at most 366 days, so the window is bounded.
    pair = Window.partitionBy(*by, *PAIR)
    both_known = F.col("common") & F.col("own_effort").isNotNull() & F.col("donor_effort").isNotNull()
    ratio = F.try_divide(
        F.sum(F.when(both_known, F.col("own_effort"))).over(pair),
        F.sum(F.when(both_known, F.col("donor_effort"))).over(pair),
    )
    return (
        both.withColumn("ratio", ratio)
        .filter(~F.col("common") & F.col("ratio").isNotNull())
        .groupBy(*by, *S.SEASON_DAY)
        .agg(F.avg(F.col("donor_effort") * F.col("ratio")).alias("effort"))
    )


def effort_annual(
    effort_daily: DataFrame, filled: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Effort of each season over its own and its filled days."""
    parts = effort_daily.select(
        *by, *S.SEASON, F.col("effort").alias("observed"), F.lit(0.0).alias("filled")
    ).unionByName(
        filled.select(
            *by, *S.SEASON, F.lit(0.0).alias("observed"), F.col("effort").alias("filled")
        )
    )
    return (
        parts.groupBy(*by, *S.SEASON)
        .agg(
            F.sum("observed").alias("observed_effort"),
            F.sum("filled").alias("filled_effort"),
            F.count(F.lit(1)).alias("n_days"),
        )
        .withColumn("effort", F.col("observed_effort") + F.col("filled_effort"))
    )
