import math
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sensorfill.llm import mixing as M


def water_fill(sizes, weights, repeats=3):
    """Share out, cap what is above, share the excess again, until none is above."""
    target, open_ = {}, set(sizes)
    rest = sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / total > repeats * sizes[s]}
        if not over:
            target |= {s: rest * weights[s] / total for s in open_}
            break
        for s in over:
            target[s] = repeats * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def sizes_table(text, n=400):
    return [(i, f"s{text.number(7) ** 2 % 5}" if i % 11 else None, text.number(90)) for i in range(n)]


def test_targets_are_those_of_the_rounds(spark, text):
    for n in (1, 3, 40, 400):
        rows = sizes_table(text, n)
        sizes = {}
        for _, s, z in rows:
            sizes[s] = sizes.get(s, 0) + z
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = {s: 1 + i % 3 for i, s in enumerate(order)}
        want = water_fill(sizes, weights)
        d = spark.createDataFrame(rows, "doc_id long, source string, size long")
        got = {r.source: r.target for r in M.targets(d).collect()}
        assert set(got) == set(want)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_taken_words_meet_the_targets(spark, text):
    rows = sizes_table(text)
    d = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = M.curriculum(d).collect()
    assert len(mixed) == len(rows)
    by_source = {}
    for r in mixed:
        words = sum(c.taken for c in r.copies)
        assert words <= 3 * r.size and all(0 <= c.position <= 1 for c in r.copies)
        by_source.setdefault((r.source, r.target), []).append(words)
    for (_, target), words in by_source.items():
        assert sum(words) == math.floor(target)
    again = M.curriculum(d.repartition(5)).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_position_inverts_the_integral(spark):
    for a, b in M.SHAPES:
        for t in (0.0, 0.1, 0.5, 0.99, 1.0):
            demand = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            found = spark.range(1).select(M.position(F.lit(demand), F.lit(a), F.lit(b)).alias("t")).head().t
            assert math.isclose(found, t, abs_tol=1e-9)


def test_training_order(spark, text):
    d = spark.createDataFrame(sizes_table(text), "doc_id long, source string, size long")
    rows = M.in_training_order(M.curriculum(d)).collect()
    positions = [r.copy.position for r in rows]
    assert positions == sorted(positions)


def test_stage_takes_copies_and_cuts_one(spark):
    docs = [(i, f"a{i} b  c\nd", "s0", 9) for i in range(10)] + [(20, "x y", "s1", 3), (21, None, "s1", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    rows = M.mix(d).collect()
    words = {}
    for r in rows:
        words.setdefault(r.source, []).append(len(r.text.split()))
        assert r.text in ("x y", f"a{r.doc_id} b  c\nd") or r.n_chars == len(r.text)
    # 42 words: s1 is capped at 3 * 2, s0 gets the other 36.
    assert {s: sum(x) for s, x in words.items()} == {"s0": 36, "s1": 6}


def test_odd_rows(spark, odd_docs, no_docs):
    mixed = M.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert all(r.text for r in mixed.collect())
    assert M.mix(no_docs).count() == 0
    empty = odd_docs.where("doc_id in (2, 3)")
    sizes = M.with_size(empty.select("doc_id", "source", "text"))
    assert [r["size"] for r in M.curriculum(sizes.drop("text")).collect()] == [0, 0]
    assert M.mix(empty).count() == 0


def test_mix_cuts_no_text(spark):
    # Of 30 words a (weight 1) gets 10 and b (weight 2) 20. Documents of 4 words leave a
    # copy of which half is taken in a, and one of 13 words a part of a long text in b.
    docs = [(i, f"w{i} x\ny  z", "a", 7) for i in range(1, 5)] + [(9, "\n".join(["v"] * 13) + " ", "b", 27), (8, "u", "b", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    sizes = M.with_size(d.select("doc_id", "source", "text")).drop("text")
    copies = {r.doc_id: (r["size"], [c.taken for c in r.copies]) for r in M.curriculum(sizes).collect()}
    assert any(t < size for size, taken in copies.values() for t in taken)
    given = {r[0]: (r[1], r[3]) for r in docs}
    rows = M.mix(d).collect()
    assert all((r.text, r.n_chars) == given[r.doc_id] for r in rows)
    for i, (size, taken) in copies.items():
        assert sum(r.doc_id == i for r in rows) == sum(2 * t >= size for t in taken)


KIND = "doc_id long, text string, source string"


def mixed_docs(text, n=300):
    """Documents with repeated and null ids, null sources, and some without words."""
    rows = [(i, " ".join(text.words(text.number(40))), f"s{i % 4}" if i % 9 else None) for i in range(n)]
    return rows + [(5, "again and again", "s1")] * 3 + [(None, "no id", "s0"), (None, "no id", None), (9000, None, "s2")]


def test_query_goes_through_the_training_order(spark, text, tmp_path, monkeypatch, many_parts):
    d = spark.createDataFrame(mixed_docs(text), KIND)
    d.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    written, plain = {}, M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: written.setdefault(name, plain(df, name)))
    rows = M.op8_mixing(spark, str(tmp_path)).collect()

    # The files hold all copies, in the order of their positions from file to file.
    files = sorted({Path(name.removeprefix("file:")) for name in written["order"].inputFiles()})
    order = [r for f in files for r in pq.read_table(f).to_pylist()]
    positions = [r["copy"]["position"] for r in order]
    assert len(files) > 1 and positions == sorted(positions)
    sizes = M.with_size(d.select("doc_id", "source", "text")).drop("text")
    want = M.curriculum(sizes).collect()
    copies = [(r.doc_id, c.epoch, c.taken, c.position) for r in want for c in r.copies]
    assert sorted(map(str, copies)) == sorted(str((r["doc_id"], *r["copy"].values())) for r in order)

    assert len(rows) == len(want)
    found = [(r.doc_id, r["size"], r.source_size, r.target, r.taken, r.first_position) for r in rows]
    want = [
        (r.doc_id, r["size"], r.source_size, r.target, sum(c.taken for c in r.copies), min((c.position for c in r.copies), default=None))
        for r in want
    ]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_query_takes_what_the_training_order_holds(spark, text, tmp_path, monkeypatch):
    spark.createDataFrame(mixed_docs(text), KIND).write.parquet(f"{tmp_path}/documents.parquet")
    plain = M.in_training_order
    whole = M.op8_mixing(spark, str(tmp_path)).agg(F.sum("taken")).head()[0]
    monkeypatch.setattr(M, "in_training_order", lambda *a: plain(*a).where("copy.epoch > 0"))
    assert 0 < M.op8_mixing(spark, str(tmp_path)).agg(F.sum("taken")).head()[0] < whole


def test_query_on_tables_without_words_or_rows(spark, tmp_path):
    for name, rows in (("none", []), ("empty", [(1, None, "a"), (1, "", None), (None, " \n", "a")])):
        spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = M.op8_mixing(spark, f"{tmp_path}/{name}").collect()
        assert [(r["size"], r.taken, r.first_position) for r in found] == [(0, 0, None)] * len(rows)
