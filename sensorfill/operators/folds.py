"""Cross-validation by subtraction: every pair is held out once, and read once.

The pairs become sums for each sensor and fold in one aggregation. What a fold's fit may
use is the total less the fold's own sums, so no fold reads the pairs again. A fold is
part of the variant's name ("d_tod@3"), and variants are fitted in the same jobs, so all
folds are too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.functions.draws import key_digest, uniform
from sensorfill.operators import impute, model
from sensorfill.operators.scale import materialize

N_FOLDS = 5


def with_fold(pairs: DataFrame, n_folds: int = N_FOLDS, seed: int = 1) -> DataFrame:
    """Add ``fold``, from 0. It depends on a pair's keys and the seed alone."""
    u = uniform(key_digest(seed, F.col("obs_seq"), F.col("cam_location")))
    return pairs.withColumn("fold", F.least(F.floor(u * n_folds), F.lit(n_folds - 1)).cast("int"))


def training_stats(sums: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Per fold and sensor, the sums over all other folds.

    ``sums`` has one row for each sensor and fold that has pairs; rows without a fold
    name sensors. A sensor's rows are ``n_folds`` + 1 at most, so they fit in one value.
    """
    names = [c for c in sums.columns if c not in (*S.SENSOR, "fold")]
    per_sensor = sums.groupBy(*S.SENSOR).agg(
        *[F.sum(c).alias(c) for c in names],
        F.collect_list(F.struct("fold", *names)).alias("parts"),
    )
    own = F.get(F.filter("parts", lambda x: x["fold"] == F.col("fold")), F.lit(0))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")
    return (
        per_sensor.select("*", every)
        .withColumn("own", own)
        .select(
            "fold", *S.SENSOR, *[(F.col(c) - F.coalesce(F.col("own")[c], F.lit(0))).alias(c) for c in names]
        )
    )


def fold_effects(
    folded: DataFrame,
    sensors: DataFrame | None = None,
    n_folds: int = N_FOLDS,
    season: tuple[int, int] | None = None,
) -> DataFrame:
    """``model.effect_table`` of every fold's training pairs, the fold in the variant."""
    sums = model.sensor_stats(folded, sensors, season, ["fold"])
    table = model.effect_table(training_stats(sums, n_folds), ["fold"])
    return materialize(table.withColumn("variant", _named(F.col("variant"), F.col("fold"))).drop("fold"))


def _named(variant: Column, fold: Column) -> Column:
    return F.concat(variant, F.lit("@"), fold.cast("string"))


def fit_folds(effects: DataFrame, chosen: int = 1, n_folds: int = N_FOLDS, **options) -> DataFrame:
    """The fits of a model's variants on every fold, all in the same jobs."""
    names = [f"{v}@{k}" for v in model.MODELS[chosen] for k in range(n_folds)]
    return model.fit_hierarchical(effects, names, **options)


def fold_params(modes: DataFrame, chosen: int = 1) -> DataFrame:
    """One row per fold and sensor with the effects of a model."""
    parts = F.split("variant", "@")
    split = modes.withColumns({"variant": parts[0], "fold": parts[1].cast("int")})
    return model.sensor_params(split, chosen, ["fold"])


def cross_validation_error(
    folded: DataFrame, params: DataFrame, p_seen_mode: str = "none"
) -> DataFrame:
    """Mean squared error and bias of each fold's pairs, imputed at parameters that have
    not seen them, per fold and part."""
    rows = impute.as_groups(impute.holdout_rows(folded.dropna(), ["fold"]))
    expected = impute.expected_effort(rows, params, p_seen_mode, ["fold"])
    return impute.holdout_error(expected, ["fold"])
