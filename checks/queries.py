
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorfill import schema as S
from sensorfill.operators import (
    coverage as C,
    daysets as D,
    gapfill as G,
    impute as I,
    model as M,
    nested as N,
    pairing as R,
    posterior as Q,
    prepare as P,
    statistics as T,
    vectors as V,
)
from sensorfill.operators.scale import materialize, use_checkpoint_dir
from sensorfill.plans import effort as E
from sensorfill.sources import stages, star_schema, text

EXCLUDED = ("NATION_7", "NATION_9")
SEASON = (2010, 6)
#: As many as the reference makes.
N_DRAWS = 1000
SEED = 7
#: Parts of a cross-validation.
N_FOLDS = 5
#: Nodes of the quadrature over a sensor's effect.
NODES = 25
SETTINGS = E.Settings(excluded=EXCLUDED, n_draws=N_DRAWS)

Query = Callable[[SparkSession, str], DataFrame]


# --- shared beginnings ----------------------------------------------------------


def raw_obs(spark, sf):
    return star_schema.raw_observations(spark, sf)


def raw_sites(spark, sf):
    return star_schema.raw_sites(spark, sf)


def keyed(spark, sf):
    return P.prepare_observations(raw_obs(spark, sf), raw_sites(spark, sf), EXCLUDED)


def normalized(spark, sf):
    return P.normalize_observations(P.dedup_rows(raw_obs(spark, sf)))


def sites_with_ids(spark, sf):
    names = P.normalize_observations(raw_obs(spark, sf)).select("name")
    return P.site_table(names, P.normalize_sites(raw_sites(spark, sf)))


def inputs(spark, sf):
    return E.keyed_inputs(raw_obs(spark, sf), raw_sites(spark, sf), SETTINGS)


def ground_and_cameras(spark, sf):
    return P.split_by_method(keyed(spark, sf))


def cameras(spark, sf):
    return P.camera_rows(keyed(spark, sf))


def pairs(spark, sf):
    rows = inputs(spark, sf)
    return R.matched_pairs(rows.ground, rows.camera_copies)


def stage(spark, sf):
    """What one reading of the observations leaves."""
    return E.statistics_stage(raw_obs(spark, sf), raw_sites(spark, sf), SETTINGS)


def seasons(spark, sf):
    return E.kept_seasons(cameras(spark, sf), SETTINGS)


def kept_rows(cams: DataFrame, found: E.Seasons) -> DataFrame:
    rows = C.imputation_rows(cams, SETTINGS.min_year)
    return C.drop_low_coverage(rows, found.coverage, SETTINGS.cutoff)


def imputed_rows(spark, sf):
    cams = cameras(spark, sf)
    return kept_rows(cams, E.kept_seasons(cams, SETTINGS))


def effects(spark, sf):
    return E.stage_effects(stage(spark, sf))


def modes(spark, sf):
    table = effects(spark, sf)
    return M.effect_modes(table, M.start_hyper(table))


def calibrated(spark, sf):
    """The stage, the effects and the modes at the starting hyperparameters."""
    once = stage(spark, sf)
    table = E.stage_effects(once)
    return once, table, M.effect_modes(table, M.start_hyper(table))


def everything(spark, sf):
    """Inputs, pairs, effects, starting hyperparameters and modes, from the rows."""
    rows = inputs(spark, sf)
    both = R.matched_pairs(rows.ground, rows.camera_copies)
    table = E.calibration_effects(both, rows.camera_copies)
    hyper = M.start_hyper(table)
    return rows, both, table, hyper, M.effect_modes(table, hyper)


def given_days(spark, sf):
    """Seasons, the days of their donors row by row, and the pairs to fill from."""
    found = seasons(spark, sf)
    donors = G.donors(G.season_attributes(found.hours))
    given = materialize(G.donor_days(donors, found.days))
    return found, given, G.usable_pairs(G.donor_usable(given))


def sets(spark, sf):
    """Day sets of the kept seasons, and those of the seasons with their donors."""
    hours = E.kept_seasons(stage(spark, sf).cameras, SETTINGS).hours
    found = materialize(D.season_sets(hours))
    return found, materialize(D.pair_sets(G.donors(G.season_attributes(hours)), found))


def fill_sets(spark, sf):
    found, pairs = sets(spark, sf)
    return found, materialize(D.fill_sets(pairs.filter("usable")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles: sums of doubles depend on their order in the last digits."""
    return df.select(
        *[
            # Adding 0.0 turns a rounded -0.0 into 0.0.
            (F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def stage_path(spark, name):
    use_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/stage-{name}-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------


def as_text(df: DataFrame, path: str) -> str:
    df.write.csv(path, sep=" ", header=True, nullValue="NA", emptyValue="NA")
    return path


def s1_read_observations(spark, sf):
    path = as_text(raw_obs(spark, sf).drop("obs_seq"), stage_path(spark, "counts"))
    return text.read_observations(spark, path).drop("obs_seq")


def s1_read_observations_parquet(spark, sf):
    path = stage_path(spark, "counts")
    raw_obs(spark, sf).write.parquet(path)
    return text.read_observations(spark, path, "parquet")


def s2_read_sites(spark, sf):
    path = as_text(raw_sites(spark, sf), stage_path(spark, "sites"))
    return text.read_sites(spark, path)


def s3_write_and_read_stage(spark, sf):
    path = stage_path(spark, "cameras")
    stages.write_stage(cameras(spark, sf), path)
    return stages.read_stage(spark, path)


def s4_export_csv(spark, sf):
    rows = cameras(spark, sf)
    path = stage_path(spark, "csv")
    stages.export_csv(rows, path)
    return spark.read.csv(path, header=True, schema=rows.schema)


# --- projections, filters, keys ---------------------------------------------------


def p1_dedup_rows(spark, sf):
    return P.dedup_rows(raw_obs(spark, sf))


def p2_normalize_observations(spark, sf):
    return normalized(spark, sf)


def p3_normalize_sites(spark, sf):
    return P.normalize_sites(raw_sites(spark, sf))


def p4_assign_site_ids(spark, sf):
    return P.assign_site_ids(P.normalize_observations(raw_obs(spark, sf)))


def p5_exclude_sites(spark, sf):
    return P.exclude_sites(normalized(spark, sf), EXCLUDED)


def p6_add_keys(spark, sf):
    return keyed(spark, sf)


def p7_ground_rows(spark, sf):
    return P.ground_rows(keyed(spark, sf))


def p7_camera_rows(spark, sf):
    return cameras(spark, sf)


def p8_positive_pairs(spark, sf):
    return R.positive_pairs(pairs(spark, sf))


def p9_false_zeros(spark, sf):
    return R.false_zeros(pairs(spark, sf))


def p10_imputation_rows(spark, sf):
    return C.imputation_rows(cameras(spark, sf))


def p11_restrict_to(spark, sf):
    return C.restrict_to(imputed_rows(spark, sf), *SEASON)


def _indexed_rows(spark, sf):
    cams = cameras(spark, sf)
    found = E.kept_seasons(cams, SETTINGS)
    return C.match_index(kept_rows(cams, found), C.reindex_seasons(found.days), S.SEASON)


def p12_add_day_keys(spark, sf):
    keys = ["obs_seq", "location", "season_idx", "season_day_code", "day_hour_season_code"]
    return C.add_day_keys(_indexed_rows(spark, sf)).select(*keys)


def p13_zero_part(spark, sf):
    return C.zero_positive_split(imputed_rows(spark, sf))[0]


def p13_positive_part(spark, sf):
    return C.zero_positive_split(imputed_rows(spark, sf))[1]


def p14_covariate_columns(spark, sf):
    named = {"false_zero": R.false_zeros, "positive": R.positive_pairs}
    both = pairs(spark, sf)
    parts = [
        C.covariate_columns(f(both)).select(
            F.lit(name).alias("part"), "obs_seq", "cam_location", "afternoon", "weekend"
        )
        for name, f in named.items()
    ]
    return parts[0].unionByName(parts[1])


def p16_training_pairs(spark, sf):
    return R.holdout_split(R.pair_counts(*ground_and_cameras(spark, sf)), seed=SEED)[0]


def p16_validation_pairs(spark, sf):
    return R.holdout_split(R.pair_counts(*ground_and_cameras(spark, sf)), seed=SEED)[1]


# --- joins and lookups ------------------------------------------------------------


def j1_join_sites(spark, sf):
    return P.join_sites(normalized(spark, sf), sites_with_ids(spark, sf))


def j2_pair_counts(spark, sf):
    return R.pair_counts(*ground_and_cameras(spark, sf))


def j2_matched_pairs(spark, sf):
    return pairs(spark, sf)


def j3_match_index(spark, sf):
    ground, cams = ground_and_cameras(spark, sf)
    dictionary = C.reindex_seasons(E.kept_seasons(cams, SETTINGS).days)
    missed = R.false_zeros(R.matched_pairs(ground, cams))
    keys = ["obs_seq", "cam_location", *S.SEASON, "season_idx"]
    return C.match_index(missed, dictionary, S.SEASON).select(*keys)


def j4_known_sensors_only(spark, sf):
    ground, cams = ground_and_cameras(spark, sf)
    known = C.sensors_of(R.false_zeros(R.matched_pairs(ground, cams)), "cam_location")
    return C.known_sensors_only(C.imputation_rows(cams), materialize(known))


def j5_merge_daily(spark, sf):
    return C.merge_daily(seasons(spark, sf).days)


def j6_align_p_seen(spark, sf):
    ground, cams = ground_and_cameras(spark, sf)
    sensors = C.sensors_of(R.false_zeros(R.matched_pairs(ground, cams)), "cam_location")
    return C.align_p_seen(C.sensor_dictionary(sensors), C.sensor_p_seen(cams))


def j7_similar_seasons(spark, sf):
    return G.similar_seasons(G.season_attributes(seasons(spark, sf).hours))


def j8_compare_fits(spark, sf):
    table = effects(spark, sf)
    pooled = M.effect_modes(table, M.start_hyper(table))
    alone = M.plug_in_estimates(table)
    keys = ["variant", *S.SENSOR]
    first = pooled.select(*keys, F.col("theta").alias("estimate"))
    second = alone.select(*keys, F.col("theta").alias("estimate"))
    return rounded(Q.compare_fits(first, second, keys))


def j8_compare_fits_hyper(spark, sf):
    """The fit by Laplace's method beside that by quadrature."""
    table = effects(spark, sf)
    first, second = (
        M.hyper_estimates(M.fit_hierarchical(table, ["d", "L", "a"], nodes=n)) for n in (0, NODES)
    )
    both = Q.compare_fits(first, second)
    digits = [
        F.when(F.col("param").endswith(".m"), F.round(c, 3)).otherwise(F.round(c, 2)) + 0.0
        for c in ("first", "second", "difference")
    ]
    return both.select("param", *[d.alias(c) for d, c in zip(digits, ("first", "second", "difference"))])


# --- aggregations -----------------------------------------------------------------


def a1_true_zero_counts(spark, sf):
    return R.true_zero_counts(pairs(spark, sf))


def a1_true_zero_counts_by_season(spark, sf):
    keys = [k for k in R.TRUE_ZERO_KEYS if k != "p_seen"] + ["season_code"]
    return R.true_zero_counts(pairs(spark, sf), keys)


def a1_true_false_zeros_by_hour(spark, sf):
    zeros = R.true_zero_counts(pairs(spark, sf), ["site_id", "cam_location", "hour"])
    return zeros.withColumn("n_false_zero", F.col("n_zero_cam") - F.col("n_zero_eff"))


def a1_true_zero_counts_from_cells(spark, sf):
    return T.true_zero_counts(stage(spark, sf).cells)


def a1_true_zero_counts_by_season_from_cells(spark, sf):
    keys = [k for k in R.TRUE_ZERO_KEYS if k != "p_seen"] + ["season_code"]
    return T.true_zero_counts(stage(spark, sf).cells, keys)


def a2_days_total(spark, sf):
    return C.days_total(C.season_days(C.camera_hours(C.imputation_rows(cameras(spark, sf)))))


def a2_days_total_by_sets(spark, sf):
    hours = C.camera_hours(C.imputation_rows(cameras(spark, sf)))
    return D.days_total(D.season_sets(hours))


def a3_season_coverage_by_sets(spark, sf):
    hours = C.camera_hours(C.imputation_rows(cameras(spark, sf)))
    return rounded(D.season_coverage(materialize(D.season_sets(hours))))


def a3_season_coverage(spark, sf):
    return rounded(seasons(spark, sf).coverage)


def a4_drop_low_coverage(spark, sf):
    return imputed_rows(spark, sf)


def a4_drop_low_coverage_pairs(spark, sf):
    ground, cams = ground_and_cameras(spark, sf)
    found = E.kept_seasons(cams, SETTINGS)
    return C.drop_low_coverage(R.matched_pairs(ground, cams), found.coverage)


def a5_obs_per_day(spark, sf):
    return C.obs_per_day(seasons(spark, sf).days)


def a6_days_per_season(spark, sf):
    return C.days_per_season(seasons(spark, sf).days)


def a6_day_range(spark, sf):
    return C.day_range(seasons(spark, sf).days)


def a7_sensor_p_seen(spark, sf):
    return C.sensor_p_seen(cameras(spark, sf))


def a8_sensor_stats(spark, sf):
    rows = inputs(spark, sf)
    both = R.matched_pairs(rows.ground, rows.camera_copies)
    return M.sensor_stats(both, C.sensors_of(rows.camera_copies))


def a8_sensor_stats_one_season(spark, sf):
    rows = inputs(spark, sf)
    both = R.matched_pairs(rows.ground, rows.camera_copies)
    return M.sensor_stats(both, C.sensors_of(rows.camera_copies), SEASON)


def a8_sensor_stats_from_cells(spark, sf):
    once = stage(spark, sf)
    return T.sensor_stats(once.cells, once.sensors)


def a8_sensor_stats_one_season_from_cells(spark, sf):
    once = stage(spark, sf)
    return T.sensor_stats(once.cells, once.sensors, SEASON)


def a8_pair_cells(spark, sf):
    return rounded(stage(spark, sf).cells, 4)


def a9_sum_effort_daily(spark, sf):
    return rounded(expected_daily(spark, sf)[1])


def a10_partition_profile(spark, sf):
    ground, cams = ground_and_cameras(spark, sf)
    both = R.matched_pairs(ground, cams)
    zero, positive = C.zero_positive_split(kept_rows(cams, E.kept_seasons(cams, SETTINGS)))
    pair_keys = ["site_id", "cam_location"]
    return C.partition_profile(
        {
            "zero_pairs": (R.true_zero_counts(both), pair_keys),
            "false_zero": (R.false_zeros(both), pair_keys),
            "positive": (R.positive_pairs(both), pair_keys),
            "imputation_zero": (zero, S.SENSOR),
            "imputation_positive": (positive, S.SENSOR),
        }
    )


def a11_table_summary(spark, sf):
    columns = ["cam_count", "hour", "julian_day", "year", "dist_kam", "p_seen", "ground_count"]
    rows = C.imputation_rows(cameras(spark, sf))
    return rounded(C.table_summary(rows, columns))


def a11_unmatched_keys(spark, sf):
    ground, cams = ground_and_cameras(spark, sf)
    return C.unmatched_keys(ground, cams, [*S.SEASON_DAY, "location"])


# --- windows and indexes ----------------------------------------------------------


def w1_sensors_per_slot(spark, sf):
    return C.sensors_per_slot(imputed_rows(spark, sf)).select("obs_seq", "location", "n_cam")


def w2_day_index(spark, sf):
    return C.day_index(imputed_rows(spark, sf)).select("obs_seq", "location", "day_index")


def w3_reindex_seasons(spark, sf):
    return C.reindex_seasons(seasons(spark, sf).days)


def w4_sensor_dictionary(spark, sf):
    ground, cams = ground_and_cameras(spark, sf)
    paired = R.matched_pairs(ground, cams).filter("cam_count is not null")
    rows = kept_rows(cams, E.kept_seasons(cams, SETTINGS))
    return C.sensor_dictionary(C.sensors_of(paired, "cam_location"), C.sensors_of(rows))


def w4_sensor_dictionary_calibration(spark, sf):
    paired = pairs(spark, sf).filter("cam_count is not null")
    return C.sensor_dictionary(C.sensors_of(paired, "cam_location"))


def w4_sensor_dictionary_positive(spark, sf):
    return C.sensor_dictionary(C.sensors_of(R.positive_pairs(pairs(spark, sf)), "cam_location"))


def w5_group_ordinal(spark, sf):
    cams = cameras(spark, sf)
    found = E.kept_seasons(cams, SETTINGS)
    merged = C.merge_daily(found.days)
    rows = C.group_ordinal(kept_rows(cams, found), merged)
    return rows.select("obs_seq", "location", "group_ordinal")


# --- sorts and top-k --------------------------------------------------------------


def t1_ordering(spark, sf):
    keys = [*S.SEASON, "obs_seq", "location"]
    return imputed_rows(spark, sf).orderBy(*keys).select(*keys, "julian_day", "cam_count")


def t2_nearest_three(spark, sf):
    return G.similar_seasons(G.season_attributes(seasons(spark, sf).hours), 3)


def t3_best_model(spark, sf):
    return rounded(M.best_model(_dic(spark, sf)), 4)


# --- set operators ----------------------------------------------------------------


def u1_pairings_by_location(spark, sf):
    return R.pairings_by_location(R.pair_counts(*ground_and_cameras(spark, sf)))


def u2_common_days(spark, sf):
    return G.common_days(given_days(spark, sf)[1])


def u3_uncommon_days(spark, sf):
    return G.uncommon_days(given_days(spark, sf)[1])


def u2_common_days_by_sets(spark, sf):
    return D.common_days(sets(spark, sf)[1])


def u3_uncommon_days_by_sets(spark, sf):
    return D.uncommon_days(sets(spark, sf)[1])


def u4_active_days_by_sets(spark, sf):
    return D.active_days(*fill_sets(spark, sf))


def u4_active_day_counts_by_sets(spark, sf):
    return D.active_day_counts(*fill_sets(spark, sf))


def u4_active_days(spark, sf):
    found, given, usable = given_days(spark, sf)
    return G.active_days(found.days, G.fill_days(given, usable))


def u4_active_day_counts(spark, sf):
    found, given, usable = given_days(spark, sf)
    return G.active_day_counts(G.active_days(found.days, G.fill_days(given, usable)))


# --- reshape ----------------------------------------------------------------------


def r1_season_day_list(spark, sf):
    return C.season_day_list(seasons(spark, sf).days)


def r2_season_day_calendar(spark, sf):
    return C.season_day_calendar(seasons(spark, sf).days)


# --- model ------------------------------------------------------------------------


def _log_posterior(spark, sf):
    _, both, _, hyper, found = everything(spark, sf)
    hyper = materialize(hyper)
    params = materialize(M.sensor_params(found, 1))
    rows = M.row_log_likelihood(both, R.true_zero_counts(both), params)
    return M.log_posterior(rows, params, hyper), hyper


def m1_log_posterior(spark, sf):
    return rounded(_log_posterior(spark, sf)[0])


def m1_total_log_posterior(spark, sf):
    return rounded(M.total_log_posterior(*_log_posterior(spark, sf)), 4)


def m2_fit_hierarchical(spark, sf):
    fit = M.fit_hierarchical(effects(spark, sf), ["d", "L", "a"])
    return fit.select(
        "variant",
        (F.round("m", 3) + 0.0).alias("m"),
        (F.round(F.ln("p"), 2) + 0.0).alias("log_p"),
        F.round("log_marginal", 4).alias("log_marginal"),
        "converged",
    )


def m3_fit_covariates(spark, sf):
    return M.fit_hierarchical(effects(spark, sf), ["d_tod", "L_wk", "a_wk"])


def m3_modes_covariates(spark, sf):
    keys = ["variant", *S.SENSOR, "theta", "beta", "theta_var", "beta_var", "cov"]
    return rounded(modes(spark, sf).select(*keys))


def m4_standard_errors(spark, sf):
    return rounded(M.standard_errors(M.sensor_params(modes(spark, sf), 1)))


def m4_positive_mean_errors(spark, sf):
    _, both, _, _, found = everything(spark, sf)
    params = materialize(M.sensor_params(found, 1))
    return rounded(M.positive_mean_errors(both, params))


def m5_draw_parameters(spark, sf):
    params = M.sensor_params(modes(spark, sf), 8)
    return rounded(M.draw_parameters(params, N_DRAWS, SEED))


def m5_sensor_quantiles(spark, sf):
    """Quantiles of the exact posteriors, which few pairs leave skewed."""
    return rounded(N.sensor_quantiles(modes(spark, sf)), 4)


def m5_draw_parameters_exact(spark, sf):
    drawn = N.exact_vectors(modes(spark, sf), 1, N_DRAWS, SEED)
    return rounded(V.long_vectors(drawn, ("d", "L", "a"), S.SENSOR, N_DRAWS), 3)


def m6_thin_draws(spark, sf):
    draws = M.draw_parameters(M.sensor_params(modes(spark, sf), 1), N_DRAWS, SEED)
    return rounded(M.thin_draws(draws, burn=6, thin=2))


def _dic(spark, sf):
    once, table, found = calibrated(spark, sf)
    return E.choose_model(table, found, T.log_constants(once.cells), replace(SETTINGS, seed=SEED))


def m7_model_dic(spark, sf):
    return rounded(_dic(spark, sf), 4)


def m7_log_constant(spark, sf):
    return rounded(T.log_constants(stage(spark, sf).cells), 4)


def m8_new_sensor_effects(spark, sf):
    return rounded(M.new_sensor_effects(M.start_hyper(effects(spark, sf))))


# --- imputation -------------------------------------------------------------------


def expected_daily(spark, sf, p_seen_mode="none", model=1):
    """Seasons, expected daily effort, groups and parameters."""
    once, _, pooled = calibrated(spark, sf)
    found = E.kept_seasons(once.cameras, SETTINGS)
    params = materialize(M.sensor_params(pooled, model))
    groups = I.effort_groups(found.hours)
    expected = I.expected_effort(groups, params, p_seen_mode)
    return found, I.sum_effort_daily(expected), groups, params, expected


def _expected_groups(spark, sf, mode, model=1):
    keys = [*S.SEASON_DAY, "location", "time_of_day", "weekend", "is_zero", "n_cam", "n_rows"]
    expected = expected_daily(spark, sf, mode, model)[4]
    return rounded(expected.select(*keys, "effort", "effort_var"))


def i1_expected_effort(spark, sf):
    return _expected_groups(spark, sf, "none")


def i1_expected_effort_covariates(spark, sf):
    return _expected_groups(spark, sf, "logit", 8)


def i1_expected_effort_by_row(spark, sf):
    rows, _, _, _, found = everything(spark, sf)
    cams = rows.cameras
    rows = kept_rows(cams, E.kept_seasons(cams, SETTINGS))
    params = materialize(M.sensor_params(found, 1))
    expected = I.expected_effort(I.as_groups(C.sensors_per_slot(rows)), params, "prob")
    return rounded(expected.select("obs_seq", "location", "effort", "effort_var"))


def _row_draws(spark, sf, part, n=3):
    rows, _, _, _, found = everything(spark, sf)
    cams = rows.cameras
    rows = C.sensors_per_slot(kept_rows(cams, E.kept_seasons(cams, SETTINGS)))
    params = materialize(M.sensor_params(found, 1))
    drawn = part(rows, params, n_draws=n, seed=SEED)
    return rounded(drawn.select("obs_seq", "location", "draw", "effort"))


def i2_impute_zero_rows(spark, sf):
    return _row_draws(spark, sf, I.impute_zero_rows)


def i3_impute_positive_rows(spark, sf):
    return _row_draws(spark, sf, I.impute_positive_rows)


def i2_impute_zero_rows_all_draws(spark, sf):
    return _row_draws(spark, sf, I.impute_zero_rows, N_DRAWS)


def i3_impute_positive_rows_all_draws(spark, sf):
    return _row_draws(spark, sf, I.impute_positive_rows, N_DRAWS)


def _day_vectors(groups, params):
    return V.effort_vectors(groups, params, N_DRAWS, SEED)


def i4_effort_draws(spark, sf):
    _, _, groups, params, _ = expected_daily(spark, sf)
    return rounded(E.effort_draws(_day_vectors(groups, V.fixed_params(params)), SETTINGS))


def i4_effort_draws_with_parameters(spark, sf):
    _, _, groups, params, _ = expected_daily(spark, sf)
    return rounded(E.effort_draws(_day_vectors(groups, V.param_vectors(params, N_DRAWS, SEED)), SETTINGS))


def i5_effort_intervals(spark, sf):
    _, _, groups, params, _ = expected_daily(spark, sf)
    return rounded(E.effort_intervals(_day_vectors(groups, V.fixed_params(params))))


def i6_effort_annual(spark, sf):
    found, daily, _, _, _ = expected_daily(spark, sf)
    return rounded(E.fill_gaps(materialize(daily), found, SETTINGS))


def i6_effort_annual_draws(spark, sf):
    found, _, groups, params, _ = expected_daily(spark, sf)
    days = _day_vectors(groups, V.fixed_params(params))
    return rounded(E.annual_draws(days, found, SETTINGS))


def i6_effort_annual_fitted(spark, sf):
    """The whole job, with fitted hyperparameters."""
    found = E.estimate_effort(raw_obs(spark, sf), raw_sites(spark, sf), SETTINGS)
    return rounded(found["annual"], 0)


def i6_effort_annual_posterior(spark, sf):
    """Yearly effort over draws of the hyperparameters, the effects and the counts."""
    once = stage(spark, sf)
    table = E.stage_effects(once)
    grid = materialize(N.hyper_grid(table, M.fit_hierarchical(table, ["d", "L", "a"])))
    found = E.kept_seasons(once.cameras, SETTINGS)
    params = N.mixed_vectors(table, grid, 1, N_DRAWS, SEED)
    days = _day_vectors(I.effort_groups(found.hours), params)
    return rounded(E.annual_draws(days, found, SETTINGS), 4)


def _holdout(spark, sf):
    rows = inputs(spark, sf)
    both = R.matched_pairs(rows.ground, rows.camera_copies)
    training, validation = R.holdout_split(both, seed=SEED)
    table = E.calibration_effects(training, rows.camera_copies)
    params = M.sensor_params(M.effect_modes(table, M.start_hyper(table)), 1)
    return I.holdout_rows(validation), materialize(params)


def i7_holdout_error(spark, sf):
    rows, params = _holdout(spark, sf)
    return rounded(I.holdout_error(I.expected_effort(I.as_groups(rows), params)))


def i7_holdout_error_by_draw(spark, sf):
    rows, params = _holdout(spark, sf)
    key = ["obs_seq", "location"]
    drawn = I.draw_efforts(I.as_groups(rows), params, key, N_DRAWS, SEED)
    return rounded(I.holdout_error(drawn, ["draw"]))


def i7_cross_validation(spark, sf):
    """Each fold's error at the moments of the others, all folds from one aggregation."""
    rows = inputs(spark, sf)
    both = R.matched_pairs(rows.ground, rows.camera_copies)
    settings = replace(SETTINGS, folds=N_FOLDS, seed=SEED)
    sensors = C.sensors_of(rows.camera_copies)
    return rounded(E.cross_validation(both, sensors, 1, None, settings, fitted=False))


# --- gap filling ------------------------------------------------------------------


def g1_season_attributes(spark, sf):
    return G.season_attributes(seasons(spark, sf).hours)


def g2_donors(spark, sf):
    return G.donors(G.season_attributes(seasons(spark, sf).hours))


def g3_donor_usable(spark, sf):
    return G.donor_usable(given_days(spark, sf)[1])


def g3_donor_usable_by_sets(spark, sf):
    return D.donor_usable(sets(spark, sf)[1])


def g4_fill_days_by_sets(spark, sf):
    return D.fill_days(fill_sets(spark, sf)[1])


def g4_fill_days(spark, sf):
    _, given, usable = given_days(spark, sf)
    return G.fill_days(given, usable)


def g4_fill_day_counts_all_donors(spark, sf):
    _, given, _ = given_days(spark, sf)
    strict = G.usable_pairs(G.donor_usable(given), require_all_donors=True)
    return G.fill_day_counts(G.fill_days(given, strict))


def g5_donors_per_fill_day(spark, sf):
    _, given, usable = given_days(spark, sf)
    out = G.donors_per_fill_day(given, usable)
    return out.withColumn("donor_ranks", F.concat_ws(",", "donor_ranks"))


def g6_fill_effort(spark, sf):
    found, daily, _, _, _ = expected_daily(spark, sf)
    return rounded(G.fill_effort(materialize(daily), *E.given_days(found, SETTINGS)))


def g7_seasons_to_fill(spark, sf):
    _, _, usable = given_days(spark, sf)
    out = G.seasons_to_fill(usable)
    return out.withColumn("donor_ranks", F.concat_ws(",", "donor_ranks"))


# --- posterior summaries ----------------------------------------------------------


def _draws(spark, sf, model=8, n=N_DRAWS):
    return M.draw_parameters(materialize(M.sensor_params(modes(spark, sf), model)), n, SEED)


def q1_posterior_means(spark, sf):
    draws = Q.long_draws(_draws(spark, sf), ["d", "d_cov", "L", "L_cov", "a", "a_cov"])
    return rounded(Q.posterior_means(draws, ["param"]))


def q1_posterior_means_hyper(spark, sf):
    return rounded(M.hyper_summary(M.fit_hierarchical(effects(spark, sf))), 3)


def q2_posterior_summary(spark, sf):
    draws = Q.long_draws(_draws(spark, sf, n=40), ["d", "L", "a"])
    return rounded(Q.posterior_summary(draws, ["param", *S.SENSOR]))


def q2_posterior_summary_all_draws(spark, sf):
    draws = Q.long_draws(_draws(spark, sf), ["d", "L", "a"])
    return rounded(Q.posterior_summary(draws, ["param", *S.SENSOR]))


def q3_back_transform(spark, sf):
    return rounded(Q.back_transform(_draws(spark, sf)))


def q4_density_grid(spark, sf):
    name = "multiplier_weekday"
    draws = Q.long_draws(Q.back_transform(_draws(spark, sf)), [name])
    return rounded(Q.density_grid(draws, Q.GRID_ENDS[name]), 4)


def q4_density_grid_quantities(spark, sf):
    """All reported quantities, each on its own grid."""
    draws = materialize(Q.long_draws(Q.back_transform(_draws(spark, sf)), list(Q.GRID_ENDS)))
    out = None
    for name, end in Q.GRID_ENDS.items():
        one = Q.density_grid(draws.filter(F.col("param") == name), end)
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


def q4_binned_density(spark, sf):
    """All reported quantities in one job, from weights of cells."""
    natural = Q.back_transform(_draws(spark, sf))
    # Written, as the bandwidths and the cells both read the draws.
    draws = materialize(Q.long_draws(natural, list(Q.GRID_ENDS)))
    return rounded(Q.binned_density(draws, Q.GRID_ENDS), 4)


def q4_density_grid_new_sensor(spark, sf):
    found = M.new_sensor_effects(M.start_hyper(effects(spark, sf)))
    return rounded(Q.new_sensor_density(found), 4)


QUERIES: dict[str, Query] = {
    name: value
    for name, value in list(globals().items())
    if callable(value) and name[:1] in "spjawturmigq" and name[1:2].isdigit()
}
