import random

from pyspark.sql import functions as F

from sensorfill.llm import topk as K


def brute(rows, asked, k):
    out = []
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None}
    for q, v in rows:
        if asked(q):
            found = [
                (-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)
            ]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def got(spark, rows, k=5, **options):
    d = spark.createDataFrame(rows, "id long, v array<long>")
    return sorted(map(tuple, K.top_k(d, F.col("id") % 10 == 0, k, **options).collect()))


def test_against_brute_force_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-3, 3) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [3, 3, 3, 3, 3, 3]) for i in range(50)]  # many copies of one vector
    rows += [(2000, [0] * 6), (2010, [1]), (2011, [5]), (2020, [])]
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert got(spark, rows) == want
    assert got(spark, rows, candidates=60, queries=7) == want


def test_stops_before_the_end():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-100, 100, (5000, 2))
    lists = K.Lists(np.arange(5000), x)
    seen = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    query = np.array([1.0, 1.0])
    found = lists.top(np.array([1, 1]), -1, 5, (x.astype(float).view(Watched), query))
    score = x.sum(axis=1)
    assert found == sorted(zip(score.tolist(), range(5000)), key=lambda r: (-r[0], r[1]))[:5]
    assert sum(seen) < 1500


def test_large_numbers(spark):
    big = (1 << 40) + 1
    rows = [(0, [big, 3]), (1, [2, big]), (2, [big, big]), (3, [-big, 1])]
    limit = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = sorted((q, r, i, limit(s)) for q, r, i, s in brute(rows, lambda i: i == 0, 5))
    assert got(spark, rows) == want


def test_whole_numbers(spark):
    odd = [None, float("nan"), float("inf"), -float("inf")]
    rows = [([0.5, -0.00001, 2.0],), (None,), ([],), *[([1.0, x],) for x in odd], ([1e300, -1e300],)]
    d = spark.createDataFrame(rows, "x array<double>")
    found = [r.v for r in d.select(K.whole_numbers(F.col("x")).alias("v")).collect()]
    assert found == [[512, -1, 2048], None, [], *[None] * 4, [(1 << 63) - 1, -(1 << 63)]]


def test_odd_rows(spark):
    rows = [(None, [1, 2]), (10, None), (20, [1, 2]), (20, [1, 2]), (20, [5, 5]), (3, [1, 1])]
    assert got(spark, rows) == sorted([(20, 1, 3, 3), (20, 1, 3, 10)])
    assert got(spark, []) == []
    assert got(spark, [(10, [1])]) == []
