"""Total effort behind each camera row: moments, draws and their sums.

A zero camera row stands for ``Bernoulli(delta) * Poisson(lambda)`` total effort,
a positive one for ``Poisson(alpha * camera count)``; both are divided by the
number of rows of the same part, site-season, day and hour.

Sums over days need no row-level work: rows alike in everything that matters are
collapsed first (``effort_groups``), which is exact, as sums of equal Poisson
variables are Poisson. Draws then scale with groups, not with rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.functions.draws import key_digest, thinned_poisson, uniform
from sensorfill.functions.numeric import invlogit
from sensorfill.operators.coverage import is_positive, is_zero
from sensorfill.operators.scale import default_tasks, lookup_join

P_SEEN_MODES = ("none", "logit", "prob")
_EFFECTS = ["d", "d_cov", "L", "L_cov", "a", "a_cov"]
_GROUP = [
    *S.SEASON_DAY, "location", "time_of_day", "weekend", "p_seen", "is_zero",
]


def _rates(p_seen_mode: str) -> tuple[Column, Column, Column]:
    """P(false zero), mean at a false zero and multiplier of a row."""
    if p_seen_mode not in P_SEEN_MODES:
        raise ValueError(f"p_seen_mode must be one of {P_SEEN_MODES}")
    logit = F.col("d") + F.col("d_cov") * (F.col("time_of_day") - 1)
    if p_seen_mode == "logit":
        logit = logit * F.col("p_seen")
    delta = invlogit(logit)
    if p_seen_mode == "prob":
        delta = delta * F.col("p_seen")
    weekend = F.col("weekend")
    return (
        delta,
        F.exp(F.col("L") + F.col("L_cov") * weekend),
        F.exp(F.col("a") + F.col("a_cov") * weekend),
    )


def effort_groups(hours: DataFrame) -> DataFrame:
    """``camera_hours`` collapsed to ``(n_rows, cam_sum)`` per day, sensor and ``n_cam``.

    ``n_cam`` is the number of rows of the same part, site-season, day and hour, a
    sum over the sensors of a site.
    """
    hour = Window.partitionBy(*S.SEASON_DAY, "hour", "is_zero")
    # Placed by day once: the window, this sum and the sum over a day all fit it.
    return (
        hours.filter(F.col("is_zero").isNotNull())
        .select(*_GROUP, "hour", "n_rows", "cam_sum")
        .repartition(*S.SEASON_DAY)
        .withColumn("n_cam", F.sum("n_rows").over(hour))
        .groupBy(*_GROUP, "n_cam")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("cam_sum").alias("cam_sum"))
    )


def as_groups(rows: DataFrame) -> DataFrame:
    """Rows that carry ``is_zero`` and ``n_cam``, each as a group of its own."""
    return rows.withColumns(
        {"n_rows": F.lit(1).cast("bigint"), "cam_sum": F.col("cam_count").cast("bigint")}
    )


def expected_effort(
    groups: DataFrame, params: DataFrame, p_seen_mode: str = "none", by: Sequence[str] = ()
) -> DataFrame:
    """Add the mean and the variance of each group's effort at given parameters, which
    are those of its sensor (and ``by``)."""
    delta, lam, alpha = _rates(p_seen_mode)
    # As doubles: the square of a hot hour's count is beyond a bigint.
    n, rows, cam = (F.col(c).cast("double") for c in ("n_cam", "n_rows", "cam_sum"))
    keys = [*by, *S.SENSOR]
    known = lookup_join(groups, params.select(*keys, *_EFFECTS), keys, "left")
    hit = delta * lam
    return known.withColumns(
        {
            "effort": F.when(F.col("is_zero"), rows * hit / n).otherwise(alpha * cam / n),
            "effort_var": F.when(
                F.col("is_zero"), rows * (hit * (1 + lam) - hit * hit) / (n * n)
            ).otherwise(alpha * cam / (n * n)),
        }
    ).drop(*_EFFECTS)


def sum_effort_daily(imputed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Effort per site-season and day: both parts and their sum.

    One aggregation instead of a merge of two; a missing part is 0.
    """
    zero = F.col("is_zero")
    return (
        imputed.groupBy(*by, *S.SEASON_DAY)
        .agg(
            F.sum(F.when(zero, F.col("effort")).otherwise(0.0)).alias("zero_effort"),
            F.sum(F.when(~zero, F.col("effort")).otherwise(0.0)).alias("pos_effort"),
        )
        .withColumn("effort", F.col("zero_effort") + F.col("pos_effort"))
    )


def sum_variance_daily(imputed: DataFrame) -> DataFrame:
    """Mean and variance of the effort per site-season and day."""
    return imputed.groupBy(*S.SEASON_DAY).agg(
        F.sum("effort").alias("effort"), F.sum("effort_var").alias("effort_var")
    )


def draw_efforts(
    groups: DataFrame,
    params: DataFrame,
    key: Sequence[str],
    n_draws: int | None = None,
    seed: int = 1,
    p_seen_mode: str = "none",
) -> DataFrame:
    """Effort of each group at each draw.

    ``key`` names the integer columns that tell groups apart. With ``n_draws`` the
    parameters are held fixed and only the counts are drawn, and the effort at a
    sensor without parameters is unknown, as in ``expected_effort``; without it,
    ``params`` is a table of parameter draws and each is used once, for its sensors.
    """
    if n_draws is None:
        joined = groups.join(params.select("draw", *S.SENSOR, *_EFFECTS), S.SENSOR)
    else:
        joined = lookup_join(groups, params.select(*S.SENSOR, *_EFFECTS), S.SENSOR, "left")
        joined = joined.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    digest = key_digest(
        seed, F.col("is_zero").cast("int"), *[F.col(k) for k in key], F.col("draw")
    )
    delta, lam, alpha = _rates(p_seen_mode)
    zero = F.col("is_zero")
    drawn = joined.withColumn("_digest", digest).withColumn(
        "count",
        thinned_poisson()(
            F.when(zero, F.col("n_rows")).otherwise(F.lit(1)).cast("bigint"),
            F.when(zero, delta).otherwise(F.lit(1.0)),
            F.when(zero, lam).otherwise(alpha * F.col("cam_sum")),
            uniform(F.col("_digest"), 0),
            uniform(F.col("_digest"), 1),
        ),
    )
    return drawn.withColumn("effort", F.col("count") / F.col("n_cam")).drop("_digest", *_EFFECTS)


def impute_rows(
    rows: DataFrame, params: DataFrame, n_draws: int | None = None, seed: int = 1,
    p_seen_mode: str = "none",
) -> DataFrame:
    """Draws of the effort of every camera row that carries ``is_zero`` and ``n_cam``."""
    return draw_efforts(
        as_groups(rows), params, ["obs_seq", "location"], n_draws, seed, p_seen_mode
    )


def impute_zero_rows(rows: DataFrame, params: DataFrame, **options) -> DataFrame:
    return impute_rows(rows.filter("is_zero"), params, **options)


def impute_positive_rows(rows: DataFrame, params: DataFrame, **options) -> DataFrame:
    return impute_rows(rows.filter("not is_zero"), params, **options)


def effort_draws(
    groups: DataFrame,
    params: DataFrame,
    n_draws: int | None = 1000,
    seed: int = 1,
    p_seen_mode: str = "none",
) -> DataFrame:
    """Daily effort of every site-season at each draw.

    Groups are placed by site-season and day before they are multiplied by the
    draws, so a day's sum is complete before it is shuffled: what is shuffled is
    the result, not the drawn counts.
    """
    # A set number of partitions: they are small now and grow with the draws.
    placed = groups.repartition(default_tasks(groups.sparkSession), *S.SEASON_DAY)
    key = [*S.SEASON_DAY, "location", "time_of_day", "weekend", "n_cam"]
    drawn = draw_efforts(placed, params, key, n_draws, seed, p_seen_mode)
    return sum_effort_daily(drawn, ["draw"])


def effort_intervals(draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean, standard deviation and quantiles over the draws of each day."""
    return draws.groupBy(*S.SEASON_DAY).agg(
        F.avg("effort").alias("mean"),
        F.stddev_samp("effort").alias("sd"),
        F.percentile("effort", F.lit(low)).alias("low"),
        F.percentile("effort", F.lit(0.5)).alias("median"),
        F.percentile("effort", F.lit(high)).alias("high"),
    )


def holdout_rows(validation: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Validation pairs as rows to impute, with the known count kept; cameras share a
    slot's count within ``by``."""
    rows = validation.withColumn("location", F.col("cam_location")).drop("cam_location")
    rows = rows.filter(is_zero() | is_positive()).withColumn("is_zero", is_zero())
    keys = [*by, *S.SEASON_DAY, "hour", "is_zero"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cam"))
    return lookup_join(rows, counts, keys)


def holdout_error(imputed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error and bias of imputed against known effort, per part."""
    error = F.col("effort") - F.col("ground_count")
    return imputed.groupBy(*by, "is_zero").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(error * error).alias("mse"),
        F.avg(error).alias("bias"),
    )
