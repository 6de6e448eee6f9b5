"""Draws as vectors: one row per day or season with an array of its draws.

The sums, joins and ratios that a draw needs are the same for all draws, so they are made
once, on arrays. What is shuffled are the groups of a season, then its days: their number
does not grow with the draws. A season has at most 366 days, so a task holds a few
megabytes at a time.

Parameters come as arrays too, one row per sensor: of one number if they are held fixed,
of one number for each draw otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.functions.draws import key_digest, key_uniforms, normal_pair, thinned_poisson_counts, uniform
from sensorfill.operators.impute import P_SEEN_MODES
from sensorfill.operators.scale import default_tasks

EFFECTS = ("d", "d_cov", "L", "L_cov", "a", "a_cov")
#: Draws of counts that one vectorised step makes.
STEP_DRAWS = 1 << 20
_KEY = ("year", "site_id", "julian_day", "location", "time_of_day", "weekend", "n_cam")


def fixed_params(params: DataFrame) -> DataFrame:
    """``sensor_params`` as arrays of one number."""
    return params.select(*S.SENSOR, *[F.array(e).alias(e) for e in EFFECTS])


def normal_vectors(seed: int, name: Column, n_draws: int) -> Column:
    """A sensor's pairs ``z1, z2`` of normal numbers, one for each draw."""

    def pair(i: Column) -> Column:
        digest = key_digest(seed, name, F.col("site_id"), F.col("location"), i)
        z1, z2 = normal_pair(uniform(digest, 0), uniform(digest, 1))
        return F.struct(z1.alias("z1"), z2.alias("z2"))

    return F.transform(F.sequence(F.lit(1), F.lit(n_draws)), pair)


def param_vectors(params: DataFrame, n_draws: int, seed: int = 1) -> DataFrame:
    """The draws of ``model.draw_parameters`` as arrays, one row per sensor."""
    columns = []
    for e in ("d", "L", "a"):
        z = normal_vectors(seed, F.lit(e), n_draws)
        sd, cross = F.sqrt(f"{e}_var"), F.col(f"{e}_cross")
        left = F.sqrt(F.greatest(F.col(f"{e}_cov_var") - cross * cross / F.col(f"{e}_var"), F.lit(0.0)))
        covariate = F.transform(z, lambda x: F.col(f"{e}_cov") + cross / sd * x["z1"] + left * x["z2"])
        columns += [
            F.transform(z, lambda x: F.col(e) + sd * x["z1"]).alias(e),
            F.when(F.col(f"{e}_cov_var") > 0, covariate).otherwise(F.array(F.lit(0.0))).alias(f"{e}_cov"),
        ]
    return params.select(*S.SENSOR, *columns)


def _array(values: np.ndarray | None):
    """For Arrow: an unknown number is null, and so is a vector of them alone."""
    if values is None or np.isnan(values).all():
        return None
    return pa.array(values, from_pandas=True)


def _vectors(rows: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if r is None else _array(r) for r in rows], pa.list_(pa.float64()))


def _matrix(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    return [None if v is None else np.array(v, dtype=float) for v in column.to_pylist()]


def _known(values: list) -> np.ndarray | None:
    return None if values is None or None in values else np.array(values, dtype=float)


def _rates(r: dict, effects: list, p_seen_mode: str) -> tuple:
    """Trials, probability and mean of a group's count; arrays, or one number each."""
    d, d_cov, lam, lam_cov, a, a_cov = effects
    if not r["is_zero"]:
        return 1, 1.0, np.exp(a + a_cov * r["weekend"]) * r["cam_sum"]
    seen = np.nan if r["p_seen"] is None else r["p_seen"]
    logit = (d + d_cov * (r["time_of_day"] - 1)) * (seen if p_seen_mode == "logit" else 1)
    delta = 1.0 / (1.0 + np.exp(-logit)) * (seen if p_seen_mode == "prob" else 1)
    return r["n_rows"], delta, np.exp(lam + lam_cov * r["weekend"])


def _draw_days(n_draws: int, seed: int, p_seen_mode: str):
    """applyInArrow function: groups of a season and its sensors' parameters, to days."""

    def drawn(rows: list[dict], effects: dict) -> list[np.ndarray | None]:
        """The draws of each group's effort; None where it is unknown."""
        out: list[np.ndarray | None] = [None] * len(rows)
        known, columns = [], [[] for _ in range(5)]
        for i, r in enumerate(rows):
            found = effects.get((r["site_id"], r["location"]))
            if found is None or any(e is None for e in found):
                continue
            rates = [np.broadcast_to(np.asarray(v, dtype=float), n_draws) for v in _rates(r, found, p_seen_mode)]
            if np.isnan(rates).any():
                continue
            known.append(i)
            key = (int(r["is_zero"]), *[r[k] for k in _KEY])
            for column, v in zip(columns, (*rates, *key_uniforms(seed, key, n_draws))):
                column.append(v)
        if known:
            counts = thinned_poisson_counts()(*map(np.concatenate, columns)).to_numpy(dtype=float)
            for i, c in zip(known, counts.reshape(len(known), n_draws)):
                out[i] = c / rows[i]["n_cam"]
        return out

    def run(groups: pa.Table, params: pa.Table) -> pa.Table:
        effects = {
            (r["_site"], r["location"]): [_known(r[e]) for e in EFFECTS] for r in params.to_pylist()
        }
        rows = groups.to_pylist()
        # Of each day: both parts' sums, rows, and unknown rows of both parts.
        days: dict[tuple, list] = {}
        per_step = max(1, STEP_DRAWS // n_draws)
        for at in range(0, len(rows), per_step):
            some = rows[at : at + per_step]
            for r, effort in zip(some, drawn(some, effects)):
                sums, n, unknown = days.setdefault(
                    tuple(r[k] for k in S.SEASON_DAY), [[np.zeros(n_draws), np.zeros(n_draws)], [0], [0, 0]]
                )
                n[0] += 1
                if effort is None:
                    unknown[r["is_zero"]] += 1
                else:
                    sums[r["is_zero"]] = sums[r["is_zero"]] + effort
        # A part is unknown if the day has unknown rows of it and no other rows.
        part = {
            name: [None if unknown[i] == n[0] else sums[i] for sums, n, unknown in days.values()]
            for name, i in (("zero_effort", 1), ("pos_effort", 0))
        }
        keys = {k: pa.array([day[i] for day in days], pa.int64()) for i, k in enumerate(S.SEASON_DAY)}
        return pa.table({**keys, **{name: _vectors(values) for name, values in part.items()}})

    return run


def effort_vectors(
    groups: DataFrame, params: DataFrame, n_draws: int = 1000, seed: int = 1, p_seen_mode: str = "none"
) -> DataFrame:
    """Daily effort of every site-season, all draws of a day in one row.

    ``params`` has the six effects of each sensor as arrays, of one number or of
    ``n_draws``. The same numbers as ``impute.effort_draws`` gives, whose rows these are:
    the effort at a sensor without parameters is unknown.
    """
    if p_seen_mode not in P_SEEN_MODES:
        raise ValueError(f"p_seen_mode must be one of {P_SEEN_MODES}")
    # Few rows now and many numbers later: a set number of partitions.
    tasks = default_tasks(groups.sparkSession)
    left = groups.repartition(tasks, *S.SEASON)
    seasons = groups.select(*S.SEASON).distinct()
    right = seasons.join(params.select(*S.SENSOR, *EFFECTS), "site_id")
    # Other names, as both sides come from the same groups.
    right = right.select(F.col("year").alias("_year"), F.col("site_id").alias("_site"), "location", *EFFECTS)
    right = right.repartition(tasks, "_year", "_site")
    types = dict(groups.dtypes)
    schema = ", ".join(f"{k} long" for k in S.SEASON_DAY) + ", zero_effort array<double>, pos_effort array<double>"
    drawn = (
        left.groupBy(*S.SEASON)
        .cogroup(right.groupBy("_year", "_site"))
        .applyInArrow(_draw_days(n_draws, seed, p_seen_mode), schema)
    )
    both = F.zip_with("zero_effort", "pos_effort", lambda a, b: a + b)
    kept = [F.col(k).cast(types[k]).alias(k) for k in S.SEASON_DAY]
    return drawn.select(*kept, "zero_effort", "pos_effort", both.alias("effort"))


def long_vectors(vectors: DataFrame, names: tuple[str, ...], keys: list[str], n_draws: int) -> DataFrame:
    """One row per draw, numbered from 1; null vectors give null numbers."""
    draw = F.explode(F.sequence(F.lit(1), F.lit(n_draws))).alias("draw")
    spread = vectors.select(draw, *keys, *names)
    return spread.select("draw", *keys, *[F.get(n, F.col("draw") - 1).alias(n) for n in names])


def _quantile(ordered: Column, p: float) -> Column:
    """The quantile between neighbours of a sorted array, as ``percentile`` has it."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    left, right = F.get(ordered, low), F.get(ordered, F.ceil(at).cast("int"))
    return F.when(left == right, left).otherwise((low + 1 - at) * left + (at - low) * right)


def vector_summary(vectors: DataFrame, name: str, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Mean, sd and quantiles over the known draws of each row's vector."""
    known = F.array_sort(F.filter(F.coalesce(name, F.array().cast("array<double>")), lambda x: x.isNotNull()))
    rows = vectors.select(*keys, known.alias("_v"))
    n = F.size("_v")
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("mean", F.try_divide(total, n))
    squares = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    return rows.select(
        *keys,
        "mean",
        F.when(n > 1, F.sqrt(squares / (n - 1))).alias("sd"),
        *[F.when(n > 0, _quantile(F.col("_v"), p)).alias(q) for q, p in quantiles.items()],
    )


def _annual(table: pa.Table) -> pa.Table:
    """applyInArrow function: own and donors' days of a season to its yearly effort."""
    days = table.column("julian_day").to_pylist()
    donors = table.column("donor_site_id").to_pylist()
    common = table.column("common").to_pylist()
    effort = _matrix(table.column("effort"))
    n = table.column("n_draws")[0].as_py()
    own = {day: e for day, donor, e in zip(days, donors, effort) if donor is None}
    by_donor: dict[int, list[int]] = {}
    for i, donor in enumerate(donors):
        if donor is not None:
            by_donor.setdefault(donor, []).append(i)
    filled: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for _, rows in sorted(by_donor.items()):
        mine, theirs, shared = np.zeros(n), np.zeros(n), 0
        for i in rows:
            if common[i] and effort[i] is not None and own.get(days[i]) is not None:
                mine, theirs, shared = mine + own[days[i]], theirs + effort[i], shared + 1
        usable = (theirs != 0) if shared else np.zeros(n, dtype=bool)
        if not usable.any():
            continue
        ratio = np.divide(mine, theirs, out=np.zeros(n), where=usable)
        for i in rows:
            if not common[i]:
                total, known, given = filled.get(days[i], (np.zeros(n),) * 3)
                if effort[i] is not None:
                    total, known = total + np.where(usable, effort[i] * ratio, 0.0), known + usable
                filled[days[i]] = (total, known, given + usable)
    observed, borrowed = np.zeros(n), np.zeros(n)
    has_own, has_filled = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    n_days = np.full(n, len(own), dtype=np.int64)
    for e in own.values():
        if e is not None:
            observed, has_own = observed + e, np.ones(n, dtype=bool)
    for total, known, given in filled.values():
        mean = np.divide(total, known, out=np.zeros(n), where=known > 0)
        borrowed = borrowed + mean
        has_filled |= known > 0
        n_days += given > 0
    # Own days add nothing to the filled sum and filled ones nothing to the own sum.
    observed = np.where(has_own | (n_days > len(own)), observed, np.nan)
    borrowed = np.where(has_filled | (len(own) > 0), borrowed, np.nan)
    key = {k: table.column(k).slice(0, 1) for k in S.SEASON}
    return pa.table(
        {
            **key,
            "observed_effort": _vectors([observed]),
            "filled_effort": _vectors([borrowed]),
            "n_days": pa.array([n_days.tolist()], pa.list_(pa.int64())),
            "effort": _vectors([observed + borrowed]),
        }
    )


def annual_vectors(daily: DataFrame, donor_days: DataFrame, pairs: DataFrame, n_draws: int) -> DataFrame:
    """Yearly effort of each season, missing days filled from its donors, for all draws.

    As ``gapfill.fill_effort`` and ``effort_annual`` by draw, on one row a day.
    """
    pair = [*S.SEASON, "donor_site_id"]
    wanted = donor_days.join(pairs.select(*pair), pair, "left_semi").select(*pair, "julian_day", "common")
    given = daily.select("year", F.col("site_id").alias("donor_site_id"), "julian_day", "effort")
    theirs = wanted.join(given, ["year", "donor_site_id", "julian_day"])
    columns = [*pair, "julian_day", "common", "effort"]
    none = {"donor_site_id": F.lit(None).cast("bigint"), "common": F.lit(None).cast("boolean")}
    rows = daily.withColumns(none).select(*columns).unionByName(theirs.select(*columns))
    rows = rows.withColumn("n_draws", F.lit(n_draws))
    types = dict(daily.dtypes)
    schema = (
        ", ".join(f"{k} {types[k]}" for k in S.SEASON)
        + ", observed_effort array<double>, filled_effort array<double>, n_days array<long>, effort array<double>"
    )
    return rows.groupBy(*S.SEASON).applyInArrow(_annual, schema)
