"""Whole jobs: calibrate, impute, fill and report.

The observations are read once, into counts of unique rows by site, slot and count
(``statistics``). Site names, sensors, pairs and camera hours come from these counts;
the pairs become cells, the cells twelve sums per sensor. Only a hold-out and the
folds, which tell single rows apart, read the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.operators import coverage, daysets, folds, gapfill, impute, model, nested, pairing, prepare, statistics, vectors
from sensorfill.operators.scale import materialize, written


@dataclass(frozen=True)
class Settings:
    """Options of a run, with the defaults users know.

    ``model`` is the covariate model; ``run_all`` chooses the one with the least
    DIC instead. ``detail`` names one (year, site_id) to report by day; counts at
    false zeros and at positives are then calibrated on it alone. ``eval_fit``
    holds out a share of the pairs and measures the error there; ``folds`` holds out
    every pair once, in so many fits that read the pairs together.
    ``vary_parameters`` draws the sensors' parameters too, for each draw of the effort,
    instead of holding them at their modes: as Normal around them, with
    ``exact_posteriors`` from each sensor's own posterior, and with ``vary_hyper`` from
    the mixture over the uncertain hyperparameters too. ``require_all_donors`` fills only seasons with all donors usable;
    ``restrict_calibration`` leaves the seasons that are not reported out of the
    fit altogether. A fit that did not converge is refused unless
    ``accept_unconverged``.
    """

    excluded: Sequence[str] = S.EXCLUDED_SITES
    min_year: int = S.FIRST_IMPUTED_YEAR
    cutoff: float = S.COVERAGE_CUTOFF
    n_compl: int = S.N_DONORS
    model: int = 1
    run_all: bool = False
    detail: tuple[int, int] | None = None
    eval_fit: bool = False
    psamp: float = S.TRAINING_SHARE
    folds: int = 0
    n_draws: int = 1000
    seed: int = 1
    vary_parameters: bool = False
    exact_posteriors: bool = False
    vary_hyper: bool = False
    p_seen_mode: str = "none"
    require_all_donors: bool = False
    restrict_calibration: bool = False
    accept_unconverged: bool = False


@dataclass(frozen=True)
class Inputs:
    """Keyed rows of a run.

    ``ground`` and ``cameras`` are free of copies. ``camera_copies`` is not: what
    copies cannot change is taken from it, and spared a shuffle of all rows.
    """

    ground: DataFrame
    cameras: DataFrame
    camera_copies: DataFrame


@dataclass(frozen=True)
class Seasons:
    """Hour counts of the kept site-seasons and what follows from them."""

    hours: DataFrame
    days: DataFrame
    coverage: DataFrame


@dataclass(frozen=True)
class Stage:
    """What one reading of the observations leaves: counted camera rows, cells of the
    pairs (``statistics.pair_cells``), and the sensors."""

    cameras: DataFrame
    cells: DataFrame
    sensors: DataFrame


def statistics_stage(
    raw_observations: DataFrame, raw_sites: DataFrame, settings: Settings = Settings()
) -> Stage:
    counts = statistics.slot_counts(raw_observations)
    site_dim = prepare.site_table(counts, prepare.normalize_sites(raw_sites))
    keyed = statistics.keyed_counts(counts, site_dim, settings.excluded)
    cameras = prepare.camera_rows(keyed)
    cells = written(statistics.pair_cells(statistics.matched_counts(keyed)))
    return Stage(cameras, cells, coverage.sensors_of(cameras))


def stage_effects(
    stage: Stage, seasons: Seasons | None = None, settings: Settings = Settings()
) -> DataFrame:
    """``calibration_effects`` from the cells."""
    cells = calibration_pairs(stage.cells, seasons, settings)
    stats = statistics.sensor_stats(cells, stage.sensors, settings.detail)
    return model.effect_table(materialize(stats))


def keyed_inputs(
    raw_observations: DataFrame, raw_sites: DataFrame, settings: Settings = Settings()
) -> Inputs:
    copies = prepare.normalize_observations(raw_observations)
    site_dim = prepare.site_table(copies, prepare.normalize_sites(raw_sites))
    unique = prepare.normalize_observations(prepare.dedup_rows(raw_observations))
    ground, cameras = prepare.split_by_method(
        prepare.key_rows(unique, site_dim, settings.excluded)
    )
    return Inputs(
        ground,
        cameras,
        prepare.camera_rows(prepare.key_rows(copies, site_dim, settings.excluded)),
    )


def kept_seasons(cameras: DataFrame, settings: Settings = Settings()) -> Seasons:
    """Count the camera rows once and drop site-seasons with low coverage."""
    rows = coverage.imputation_rows(cameras, settings.min_year)
    hours = materialize(coverage.camera_hours(rows))
    shares = coverage.season_coverage(coverage.season_days(hours))
    kept = coverage.drop_low_coverage(hours, shares, settings.cutoff)
    if settings.detail is not None:
        kept = coverage.restrict_to(kept, *settings.detail)
    return Seasons(kept, coverage.season_days(kept), shares)


def calibration_pairs(
    pairs: DataFrame, seasons: Seasons | None = None, settings: Settings = Settings()
) -> DataFrame:
    """The pairs to calibrate on: all, or those of the seasons that are reported."""
    if settings.restrict_calibration:
        if settings.detail is not None:
            return coverage.restrict_to(pairs, *settings.detail)
        if seasons is not None:
            return coverage.drop_low_coverage(pairs, seasons.coverage, settings.cutoff)
    return pairs


def calibration_effects(
    pairs: DataFrame, cameras: DataFrame, seasons: Seasons | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Sufficient statistics of the pairs, for every sensor and model variant."""
    pairs = calibration_pairs(pairs, seasons, settings)
    stats = model.sensor_stats(pairs, coverage.sensors_of(cameras), settings.detail)
    return model.effect_table(materialize(stats))


def choose_model(
    effects: DataFrame, modes: DataFrame, constant: DataFrame, settings: Settings
) -> DataFrame:
    """DIC of the eight models, from draws around the fitted modes."""
    draws = model.draw_effects(modes, settings.n_draws, settings.seed)
    return model.model_dic(model.variant_deviance(draws, effects), constant)


def given_days(
    seasons: Seasons, settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame]:
    """The days of each season's donors, and the pairs to fill from."""
    attributes = gapfill.season_attributes(seasons.hours)
    donors = gapfill.donors(attributes, settings.n_compl)
    # A row per season and donor, its days as bits; no join on days.
    found = materialize(daysets.pair_sets(donors, daysets.season_sets(seasons.hours)))
    pairs = gapfill.usable_pairs(
        daysets.donor_usable(found), settings.require_all_donors, settings.n_compl
    )
    return daysets.donor_days(found), pairs


def fill_gaps(
    effort_daily: DataFrame, seasons: Seasons, settings: Settings, by: Sequence[str] = ()
) -> DataFrame:
    """Yearly effort of each season, its missing days filled from its donors."""
    filled = gapfill.fill_effort(effort_daily, *given_days(seasons, settings), by)
    return gapfill.effort_annual(effort_daily, filled, by)


def estimate_effort(
    raw_observations: DataFrame, raw_sites: DataFrame, settings: Settings = Settings()
) -> dict[str, DataFrame]:
    """The whole job. Returns the tables a user asks for, by name.

    ``fit`` and ``params`` are the calibration, ``daily`` and ``annual`` the
    expected effort, ``draws`` the daily effort at each draw, ``intervals`` and
    ``annual_draws`` its spread by day and by year, ``dic`` the model
    comparison (with ``run_all``), ``error`` the hold-out error (with ``eval_fit``) and
    ``cross_validation`` that of every fold (with ``folds``). The fit and the daily means are computed here, the rest when used.
    """
    stage = statistics_stage(raw_observations, raw_sites, settings)
    seasons = kept_seasons(stage.cameras, settings)
    validation = None
    if settings.eval_fit or settings.folds:
        rows = keyed_inputs(raw_observations, raw_sites, settings)
        pairs = pairing.matched_pairs(rows.ground, rows.camera_copies)
    if settings.eval_fit:
        pairs, validation = pairing.holdout_split(pairs, settings.psamp, settings.seed)
        stage = replace(stage, cells=written(statistics.pair_cells(pairs)))

    effects = stage_effects(stage, seasons, settings)
    fit = model.fit_hierarchical(effects)
    _refuse_unconverged(fit, settings)
    modes = materialize(model.effect_modes(effects, fit))
    out = {"fit": fit, "coverage": seasons.coverage}
    chosen = settings.model
    if settings.run_all:
        constant = statistics.log_constants(stage.cells)
        out["dic"] = materialize(choose_model(effects, modes, constant, settings))
        chosen = model.best_model(out["dic"]).orderBy("model").first()["model"]
    params = model.sensor_params(modes, chosen)

    groups = impute.effort_groups(seasons.hours)
    expected = impute.expected_effort(groups, params, settings.p_seen_mode)
    daily = materialize(impute.sum_effort_daily(expected))
    given = vectors.fixed_params(params)
    drawn = (chosen, settings.n_draws, settings.seed)
    if settings.vary_hyper:
        parts = fit.filter(F.col("variant").isin(*model.MODELS[chosen]))
        grid = materialize(nested.hyper_grid(effects, parts))
        given = nested.mixed_vectors(effects, grid, *drawn)
    elif settings.exact_posteriors:
        given = nested.exact_vectors(modes, *drawn)
    elif settings.vary_parameters:
        given = vectors.param_vectors(params, *drawn[1:])
    days = vectors.effort_vectors(groups, given, settings.n_draws, settings.seed, settings.p_seen_mode)
    out.update(
        params=params,
        daily=daily,
        annual=fill_gaps(daily, seasons, settings),
        draws=effort_draws(days, settings),
        intervals=effort_intervals(days),
        annual_draws=annual_draws(days, seasons, settings),
    )
    if settings.folds:
        out["cross_validation"] = cross_validation(
            pairs, stage.sensors, chosen, seasons, settings
        )
    if validation is not None:
        rows = impute.as_groups(impute.holdout_rows(validation))
        out["error"] = impute.holdout_error(
            impute.expected_effort(rows, params, settings.p_seen_mode)
        )
    return out


def _refuse_unconverged(fit: DataFrame, settings: Settings) -> None:
    if not settings.accept_unconverged:
        # One row for each variant, six at most, and fold.
        failed = sorted(r["variant"] for r in fit.filter("not converged").collect())
        if failed:
            raise RuntimeError(f"the fit did not converge for {', '.join(failed)}")


def cross_validation(
    pairs: DataFrame, sensors: DataFrame, chosen: int = 1, seasons: Seasons | None = None,
    settings: Settings = Settings(), fitted: bool = True,
) -> DataFrame:
    """Error of each fold at a model fitted on the others; with ``fitted`` False at the
    moments of the sensors' own estimates, without the fits."""
    n = settings.folds
    folded = folds.with_fold(pairs, n, settings.seed)
    # Written once: the statistics and the rows to impute are both read from it.
    folded = materialize(calibration_pairs(folded, seasons, settings))
    effects = folds.fold_effects(folded, sensors, n, settings.detail)
    if fitted:
        hyper = folds.fit_folds(effects, chosen, n)
        _refuse_unconverged(hyper, settings)
    else:
        hyper = model.start_hyper(effects)
    params = folds.fold_params(model.effect_modes(effects, hyper), chosen)
    return folds.cross_validation_error(folded, materialize(params), settings.p_seen_mode)


def effort_draws(days: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Daily effort, one row per draw, from its vectors."""
    names = ("zero_effort", "pos_effort", "effort")
    return vectors.long_vectors(days, names, S.SEASON_DAY, settings.n_draws)


def effort_intervals(days: DataFrame) -> DataFrame:
    """Mean, sd and quantiles over the draws of each day's vector."""
    quantiles = {"low": 0.025, "median": 0.5, "high": 0.975}
    return vectors.vector_summary(days, "effort", S.SEASON_DAY, quantiles)


def annual_draws(
    days: DataFrame, seasons: Seasons, settings: Settings = Settings()
) -> DataFrame:
    """Mean, sd and quantiles of the yearly effort over the draws of the daily effort."""
    yearly = vectors.annual_vectors(days, *given_days(seasons, settings), settings.n_draws)
    return vectors.vector_summary(yearly, "effort", S.SEASON, {"low": 0.025, "high": 0.975})
