import os

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import EXCLUDED, QUERIES
from sensorfill.plans import effort
from sensorfill.sources import star_schema

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

# At the smallest size the data leave a hyperparameter at a bound, where the SQL's grid ends.
LARGER = {
    "m2_fit_hierarchical", "i6_effort_annual_fitted", "j8_compare_fits_hyper", "i6_effort_annual_posterior",
}


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    sf = SF.replace("sf0.001", "sf0.01") if name in LARGER else SF
    assert compare(spark, connect(sf), QUERIES[name], ORACLE[name], sf) == ""


def test_every_query_has_sql_but_those_without_one():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"m3_fit_covariates", "q1_posterior_means_hyper"}


def run(spark, **options):
    settings = effort.Settings(excluded=EXCLUDED, n_draws=20, **options)
    raw = star_schema.raw_observations(spark, SF), star_schema.raw_sites(spark, SF)
    return effort.estimate_effort(*raw, settings)


def test_whole_job_with_model_choice_and_holdout(spark):
    out = run(spark, run_all=True, eval_fit=True, cutoff=0.1)
    assert out["dic"].count() == 8
    assert out["error"].count() == 2
    annual = out["annual"].collect()
    assert annual and all(r["effort"] > 0 and r["filled_effort"] >= 0 for r in annual)
    daily, draws = out["daily"].toPandas(), out["draws"].toPandas()
    assert len(draws) == 20 * len(daily)
    assert out["intervals"].count() == len(daily)


def test_whole_job_for_one_season(spark):
    out = run(spark, detail=(2010, 6), cutoff=0.0)
    assert {(r["year"], r["site_id"]) for r in out["daily"].collect()} == {(2010, 6)}


def test_calibration_can_leave_out_poor_seasons(spark):
    out = run(spark, restrict_calibration=True, require_all_donors=True, p_seen_mode="logit", cutoff=0.2)
    assert out["fit"].count() == 6 and out["annual"].count() > 0


def test_parameter_uncertainty_widens_the_yearly_effort(spark):
    fixed, varied = run(spark, cutoff=0.1), run(spark, cutoff=0.1, vary_parameters=True)
    spread = []
    for out in (fixed, varied, run(spark, cutoff=0.1, exact_posteriors=True), run(spark, cutoff=0.1, vary_hyper=True)):
        years = out["annual_draws"].toPandas().set_index(["year", "site_id"]).sort_index()
        assert (years["low"] <= years["mean"]).all() and (years["mean"] <= years["high"]).all()
        spread.append(years["sd"])
    assert all((wide > spread[0]).mean() > 0.7 for wide in spread[1:])
