"""Sets of days as bits: one row per season, or per season and donor.

A set is a map from a stretch of 64 days to a number whose bits are its days. Sets are
made by a bitwise-or aggregate, which combines before its shuffle. Common days are an
"and", days only the donor has an "and not", days of several donors an "or", and the
numbers of days are counts of bits: seasons are joined, days are not. A row without a
day is in no set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.operators.gapfill import PAIR

#: Days in a stretch: the bits of a long.
WORD = 64


def _word(day: Column) -> Column:
    return F.floor(day / WORD).cast("int")


def _bit(day: Column) -> Column:
    place = F.pmod(day, F.lit(WORD)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _packed(words: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows (keys, word, bits of each name) as one row per key with a map of each name."""
    pairs = F.collect_list(F.struct("word", *names))
    packed = words.groupBy(*keys).agg(pairs.alias("_words"))
    return packed.select(*keys, *[_map_of(name).alias(name) for name in names])


def _map_of(name: str) -> Column:
    # A stretch without a day of the set is no part of it.
    kept = F.filter("_words", lambda w: w[name] != 0)
    return F.map_from_entries(F.transform(kept, lambda w: F.struct(w["word"], w[name])))


def size(days: Column) -> Column:
    """The number of days in a set."""
    return F.aggregate(F.map_values(days), F.lit(0).cast("bigint"), lambda n, bits: n + F.bit_count(bits))


def both(first: Column, second: Column) -> Column:
    """Days in the first set and the second."""
    return _without_empty(
        F.transform_values(first, lambda w, bits: bits.bitwiseAND(_bits_of(second, w)))
    )


def only_first(first: Column, second: Column) -> Column:
    """Days in the first set and not in the second."""
    return _without_empty(
        F.transform_values(first, lambda w, bits: bits.bitwiseAND(F.bitwise_not(_bits_of(second, w))))
    )


def _bits_of(days: Column, word: Column) -> Column:
    # Of a missing set too, as of an empty one.
    return F.coalesce(F.try_element_at(days, word), F.lit(0).cast("bigint"))


def _without_empty(days: Column) -> Column:
    return F.map_filter(days, lambda _, bits: bits != 0)


def exploded(df: DataFrame, days: str, name: str = "julian_day") -> DataFrame:
    """A row for each day of the set in column ``days``, which ``name`` replaces."""
    others = [c for c in df.columns if c != days]
    words = df.select(*others, F.explode(days).alias("_word", "_bits"))
    one = F.lit(1).cast("bigint")
    in_word = F.filter(
        F.sequence(F.lit(0), F.lit(WORD - 1)),
        lambda i: F.call_function("shiftrightunsigned", F.col("_bits"), i).bitwiseAND(one) == 1,
    )
    return words.select(*others, F.explode(in_word).alias("_i"), "_word").select(
        *others, (F.col("_word") * WORD + F.col("_i")).cast("int").alias(name)
    )


def season_sets(hours: DataFrame) -> DataFrame:
    """``observed``: the days of each site-season with a camera row, and ``known``: those
    on which a count is known. Works on ``coverage.camera_hours``."""
    day = F.col("julian_day")
    bits = hours.filter(day.isNotNull()).select(
        *S.SEASON, _word(day).alias("word"), "is_zero", _bit(day).alias("bit")
    )
    none = F.lit(0).cast("bigint")
    words = bits.groupBy(*S.SEASON, "word").agg(
        F.bit_or("bit").alias("observed"),
        F.bit_or(F.when(F.col("is_zero").isNotNull(), F.col("bit")).otherwise(none)).alias("known"),
    )
    return _packed(words, S.SEASON, ["observed", "known"])


def days_total(sets: DataFrame) -> DataFrame:
    """Number of different days over all site-seasons, as one row."""
    words = sets.select(F.explode("observed").alias("word", "bits"))
    merged = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    total = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
    return merged.agg(total.cast("bigint").alias("n_days_total"))


def season_coverage(sets: DataFrame) -> DataFrame:
    """``coverage.season_coverage`` from the sets."""
    counted = sets.select(*S.SEASON, size(F.col("observed")).alias("n_days"))
    return counted.withColumn("share", F.col("n_days") / days_total(sets).scalar())


def pair_sets(donors: DataFrame, sets: DataFrame) -> DataFrame:
    """The days a season and each donor have in common, and those only the donor has.

    ``n_common`` and ``n_uncommon`` are their numbers; usable if there are both. A donor
    without a known day gives no row.
    """
    given = sets.filter(F.size("known") > 0).select(
        "year", F.col("site_id").alias("donor_site_id"), F.col("known").alias("_given")
    )
    own = sets.select(*S.SEASON, F.col("known").alias("_own"))
    return (
        donors.select(*PAIR, "donor_rank")
        .join(given, ["year", "donor_site_id"])
        .join(own, S.SEASON, "left")
        .select(
            *PAIR, "donor_rank",
            both(F.col("_given"), F.col("_own")).alias("common"),
            only_first(F.col("_given"), F.col("_own")).alias("uncommon"),
        )
        .withColumns({"n_common": size(F.col("common")), "n_uncommon": size(F.col("uncommon"))})
        .withColumn("usable", (F.col("n_common") > 0) & (F.col("n_uncommon") > 0))
    )


def donor_usable(pairs: DataFrame) -> DataFrame:
    """``gapfill.donor_usable`` from the sets."""
    return pairs.drop("common", "uncommon")


def common_days(pairs: DataFrame) -> DataFrame:
    return exploded(pairs.select(*PAIR, "donor_rank", "common"), "common")


def uncommon_days(pairs: DataFrame) -> DataFrame:
    return exploded(pairs.select(*PAIR, "donor_rank", "uncommon"), "uncommon")


def donor_days(pairs: DataFrame) -> DataFrame:
    """``gapfill.donor_days`` from the sets, for what needs a row for each day."""
    common = common_days(pairs).withColumn("common", F.lit(True))
    return common.unionByName(uncommon_days(pairs).withColumn("common", F.lit(False)))


def fill_sets(pairs: DataFrame) -> DataFrame:
    """The days each season can borrow: those of any of ``pairs``, which are usable."""
    words = pairs.select(*S.SEASON, F.explode("uncommon").alias("word", "bits"))
    merged = words.groupBy(*S.SEASON, "word").agg(F.bit_or("bits").alias("fill"))
    return _packed(merged, S.SEASON, ["fill"])


def fill_days(fill: DataFrame) -> DataFrame:
    return exploded(fill, "fill")


def fill_day_counts(fill: DataFrame) -> DataFrame:
    return fill.select(*S.SEASON, size(F.col("fill")).alias("n_fill"))


def active_days(sets: DataFrame, fill: DataFrame) -> DataFrame:
    """Own and borrowed days. A day with rows but no known count may be both."""
    own = exploded(sets.select(*S.SEASON, "observed"), "observed")
    return own.withColumn("filled", F.lit(False)).unionByName(
        fill_days(fill).withColumn("filled", F.lit(True))
    )


def active_day_counts(sets: DataFrame, fill: DataFrame) -> DataFrame:
    """Own and borrowed days of each season, counted without listing them."""
    borrowed = fill_day_counts(fill)
    n = size(F.col("observed")) + F.coalesce(F.col("n_fill"), F.lit(0))
    return sets.join(borrowed, S.SEASON, "left").select(*S.SEASON, n.alias("n_active"))
