from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorfill.llm import whitening as W

SCHEMA = "vec_id long, x array<long>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'a' AS component", "1L AS n", "2 AS w", "3 AS dim")


def brute(rows, weights=None):
    x = np.array([r[1] for r in rows], dtype=object)
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object) if weights == "one" else x
    n, sums = len(fit), fit.sum(axis=0)
    exact = [[float(Fraction(int(v)) - Fraction(int(s), n)) for v, s in zip(row, sums)] for row in x]
    some = [[float(Fraction(int(v)) - Fraction(int(s), n)) for v, s in zip(row, sums)] for row in fit]
    matrix = np.array(some).T @ np.array(some) / n
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviation, np.array(exact) @ axes / np.sqrt(values), values / np.trace(matrix)


def check(found, rows, **options):
    n, deviation, z, explained = brute(rows, **options)
    order = {r[0]: i for i, r in enumerate(rows)}
    assert len(found) == z.size
    sign = {}
    for r in found:
        i, c = order[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
        assert r["identity_error"] < 1e-9
        s = sign.setdefault(c, 1.0 if r["whitened"] * z[i, c] >= 0 else -1.0)
        assert r["whitened"] * s == pytest.approx(z[i, c], abs=1e-8)


def vectors(n, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(dims, dims))
    return [(i, [int(v) + 100_000 for v in rng.normal(0, 300, dims) @ mixing]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(200)
    rows += [(1000 + i, rows[3][1]) for i in range(100)]  # a third are copies of one
    found = W.whiten(frame(spark, [*rows, (9, None)])).collect()
    check(found, rows)


def test_distinct_vectors_alone_as_the_fit_list(spark):
    rows = vectors(100) + [(1000 + i, vectors(1)[0][1]) for i in range(80)]
    check(W.whiten(frame(spark, rows), copies_count=False).collect(), rows, weights="one")


def test_repeated_rows_and_null_ids_are_returned(spark):
    rows = vectors(50)
    found = W.whiten(frame(spark, rows + rows[:5] + [(None, rows[0][1])])).collect()
    assert len(found) == 8 * 56 and {r["n"] for r in found} == {56}
    assert sum(r["vec_id"] is None for r in found) == 8
    assert sum(r["vec_id"] == 3 for r in found) == 16


def test_no_spread_no_components(spark):
    assert W.whiten(frame(spark, [])).collect() == []
    assert W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert W.whiten(frame(spark, [(1, [5, 6]), (2, [5, 6])])).collect() == []
    line = [(i, [100_000 + i, 100_000 + 2 * i, 7]) for i in range(9)]
    found = W.whiten(frame(spark, line)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 9
    assert all(r["explained"] == pytest.approx(1.0) for r in found)


def test_lengths_are_fitted_apart(spark):
    some, others = vectors(60), [(500 + i, x[:9]) for i, x in vectors(40, seed=2)]
    found = W.whiten(frame(spark, some + others)).collect()
    check([r for r in found if r["vec_id"] < 500], some)
    check([r for r in found if r["vec_id"] >= 500], others)


def test_deviation_is_exact_up_to_the_largest_long():
    top = (1 << 63) - 1
    centre = W.Centre(3, [3, -6])
    x = np.array([[1, -2], [10**9, 5], [1_012_000_000, 0], [-top, top]], dtype=np.int64)
    want = [min(top, sum((3 * int(v) - s) ** 2 for v, s in zip(row, centre.sums))) for row in x]
    assert centre.deviation(x).tolist() == want


def test_numbers_as_the_contract_makes_them(spark):
    df = spark.sql("SELECT array(0.1F, -0.1F, CAST('Infinity' AS FLOAT)) AS a, array(0.1F, -0.1F, 3e38F) AS b")
    a, b = df.select(W.shifted_numbers(F.col("a")), W.shifted_numbers(F.col("b"))).first()
    assert a is None and b == [100_102, 99_897, (1 << 63) - 1]


def test_query(spark):
    found = W.op13_whitening(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = rows.select("vec_id", W.shifted_numbers(F.col("embedding")).alias("x")).collect()
    check(found.collect(), [(r[0], r[1]) for r in x])
