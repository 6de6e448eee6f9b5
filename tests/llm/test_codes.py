import hashlib

import numpy as np
import pytest

from checks.compare import compare, connect
from sensorfill.llm import codes as C

SCHEMA = "vec_id long, x array<long>, label int"


def brute(rows, parts=C.PARTS, entries=C.ENTRIES, rounds=C.ROUNDS):
    """Rows of one vector length, in plain Python."""
    rows = [r for r in rows if r[1] is not None]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    bounds = C.part_bounds(len(rows[0][1]), parts)
    books = [[list(r[1][a:b]) for r in rows[:entries]] for a, b in bounds]

    def nearest(book, part):
        return min((sum((p - q) ** 2 for p, q in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(bounds):
            mine = {}
            for r in rows:
                mine.setdefault(nearest(books[p], r[1][a:b])[1], []).append(r[1][a:b])
            for e, some in mine.items():
                books[p][e] = [sum(c) // len(some) for c in zip(*some)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for i, x, label in rows:
        found = [nearest(books[p], x[a:b]) for p, (a, b) in enumerate(bounds)]
        error = min(sum(d for d, _ in found), (1 << 63) - 1)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label, digest))
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return [(i, code, error, min(sums[label], (1 << 63) - 1), digest) for i, code, error, label, digest in out]


def key(r):
    return tuple((v is None, str(v)) for v in r)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS code", "2 AS error", "3 AS dim")
    return sorted(map(tuple, C.compress(df, **options).collect()), key=key)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [int(v) for v in rng.normal(0, 500, 24)], int(i) % 5 or None) for i in range(300)]
    rows += rows[:40] + [(None, rows[7][1], None), (1000, None, 2)]
    assert got(spark, rows) == sorted(brute(rows), key=key)


def test_a_third_of_equal_rows_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [int(v) for v in rng.integers(-2, 3, 16)], 1) for i in range(200)]
    rows += [(200 + i, [1] * 16, None) for i in range(100)]
    assert got(spark, rows) == sorted(brute(rows), key=key)


def test_few_rows_other_lengths_and_huge_numbers(spark):
    huge = (1 << 63) - 1
    rows = [(1, [huge] * 8, 1), (2, [-huge] * 8, 1), (3, [0] * 8, None), (4, [5] * 8, None)]
    uneven = [(i, [i * j % 7 for j in range(10)], 9) for i in range(40)]
    empty = [(50, [], 4)]
    want = brute(rows) + brute(uneven)
    found = got(spark, rows + uneven + empty)
    assert [r for r in found if r[0] != 50] == sorted(want, key=key)
    assert [r[1:4] for r in found if r[0] == 50] == [("00" * 8, 0, 0)]


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None)]) == []


def test_only_entries_that_can_be_nearest_are_evaluated():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 3000, (4000, 4)).astype(np.int64)
    book = C.Codebook(x[:16])
    want = ((x[:, None] - x[None, :16]) ** 2).sum(axis=2)
    for some in (slice(0, 2000), slice(2000, 4000), slice(0, 4000)):
        code, distance = book.nearest(x[some])
        assert (code == want[some].argmin(axis=1)).all() and (distance == want[some].min(axis=1)).all()
    assert book.evaluated < 0.5 * book.all_pairs
    assert len(book.keys) == len(np.unique(x >> book.bits, axis=0))


def test_a_full_memo_changes_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 3000, (3000, 4)).astype(np.int64)
    free = C.Codebook(x[:16]).nearest(x)
    monkeypatch.setattr(C, "MEMO_CELLS", 10)
    book = C.Codebook(x[:16])
    for _ in range(2):
        assert all((a == b).all() for a, b in zip(book.nearest(x), free))
    assert len(book.keys) == 10


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert compare(spark, connect(folder), C.op11_vector_codes, C.OP11_SQL, folder) == ""
