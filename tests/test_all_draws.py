"""The queries of draws make as many as the reference, and say what these draws say."""

import os

import numpy as np
import pytest

from checks import queries as K
from sensorfill.operators import posterior as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_intervals_are_quantiles_of_all_draws(spark):
    draws = K.i4_effort_draws(spark, SF).toPandas()
    assert draws["draw"].nunique() == 1000
    keys = ["year", "site_id", "julian_day"]
    got = K.i5_effort_intervals(spark, SF).toPandas().set_index(keys)
    for day, rows in draws.groupby(keys):
        assert len(rows) == 1000
        want = np.quantile(rows["effort"], [0.025, 0.5, 0.975])
        assert np.allclose(got.loc[day, ["low", "median", "high"]].astype(float), want, atol=1e-5)


def test_rows_are_drawn_as_often(spark):
    for query in (K.i2_impute_zero_rows_all_draws, K.i3_impute_positive_rows_all_draws):
        rows = query(spark, SF).groupBy("obs_seq", "location").count().toPandas()
        assert len(rows) and (rows["count"] == 1000).all()


def test_densities_of_all_quantities(spark):
    got = K.q4_density_grid_quantities(spark, SF).toPandas()
    drawn = Q.back_transform(K._draws(spark, SF)).toPandas()
    n_sensors = drawn.groupby(["site_id", "location"]).ngroups
    assert set(got["param"]) == set(Q.GRID_ENDS) and len(got) == 5 * 512 * n_sensors
    first = drawn[["site_id", "location"]].iloc[0]
    mine = drawn[(drawn[["site_id", "location"]] == first).all(axis=1)]
    for name, end in Q.GRID_ENDS.items():
        value = mine[name].to_numpy()
        assert len(value) == 1000
        q25, q75 = np.quantile(value, [0.25, 0.75])
        width = 0.9 * min(value.std(ddof=1), (q75 - q25) / 1.34) * 1000**-0.2
        x = np.linspace(0, end, 512)
        want = np.exp(-0.5 * ((x[:, None] - value) / width) ** 2).mean(axis=1) / (width * np.sqrt(2 * np.pi))
        rows = got[(got["param"] == name) & (got["site_id"] == first["site_id"]) & (got["location"] == first["location"])]
        rows = rows.sort_values("i")
        assert np.allclose(rows["x"], x, atol=1e-4) and np.allclose(rows["density"], want, atol=1e-3)
