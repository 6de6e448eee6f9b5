import hashlib

import numpy as np

from sensorfill.llm import lines as L


def brute(docs):
    space = " \t\n\x0b\x0c\r"
    keys = {}
    split = []
    for at, (doc, text) in enumerate(docs):
        rows = []
        for line in (text or "").split("\n"):
            key = "".join(c.lower() if c.isascii() else c for c in line.strip(space))
            rows.append((line, key))
            if len(key) >= 40:
                keys.setdefault(key, set()).add(at)
        split.append((doc, rows))
    low = lambda d: L.NO_ID if d is None else d
    last = {k: max(low(docs[i][0]) for i in v) for k, v in keys.items() if len(v) >= 5}
    out = []
    for doc, rows in split:
        kept = [line for line, key in rows if not (key in last and low(doc) < last[key])]
        out.append((doc, len(rows), len(rows) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(docs, **options):
    rows = L.without_repeated_lines(docs, **options).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows), key=str)


def test_perfect_hash_is_minimal_and_tells_halves_apart():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    keys[1000:2000, 0] = keys[:1000, 0]  # the first half alone does not tell them apart
    found = L.PerfectHash.build(keys).index(keys)
    assert sorted(found) == list(range(5000))
    assert len(L.PerfectHash.build(keys[:0]).index(keys)) == 5000


def test_strangers_are_not_found():
    rng = np.random.default_rng(2)
    keys = rng.integers(-(1 << 62), 1 << 62, (3000, 2))
    index = L.Index(**L.Index.pack(keys, np.full(3000, 9), np.full(3000, 7)))
    assert index.dropped(keys, np.full(3000, 6), 5).all()
    assert not index.dropped(keys, np.full(3000, 7), 5).any()
    others = rng.integers(-(1 << 62), 1 << 62, (3000, 2))
    others[:, 0] = keys[:, 0]
    assert not index.dropped(others, np.full(3000, 6), 5).any()


def test_both_ways_against_brute_force(spark, text):
    common = [" ".join(text.words(12)) for _ in range(30)] + ["é" * 39, "É" * 40, "x" * 39, "Y" * 40]
    docs = []
    for i in range(120):
        lines = [common[text.number(len(common))] for _ in range(text.number(6))]
        lines = [f" \t{x.upper() if text.number(2) else x}\r" for x in lines] + [" ".join(text.words(3))]
        docs.append((i, "\n".join(lines)))
    docs += [(None, common[0]), (119, common[1]), (3, None), (4, ""), (5, "\n\n")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert sum(r[2] for r in want) > 50
    assert got(d) == want
    assert got(d, limit=-1, shard_lines=7) == want


def test_null_ids_alone_keep_their_lines(spark):
    line = "a line that is long enough to be looked at, it is"
    docs = spark.createDataFrame([(None, line)] * 6, "doc_id long, text string")
    assert [r[2] for r in got(docs)] == [0] * 6


def test_odd_rows(spark, odd_docs, no_docs):
    for limit in (1 << 20, -1):
        rows = L.without_repeated_lines(odd_docs, limit=limit)
        assert rows.columns == [*odd_docs.columns, "n_lines", "n_dropped", "kept"]
        assert all(r.n_dropped == 0 and r.kept == (r.text or "") for r in rows.collect())
        assert L.without_repeated_lines(no_docs, limit=limit).count() == 0


def test_query(spark, tmp_path):
    line = "THIS LINE IS IN FIVE DOCUMENTS AND LONG ENOUGH"
    docs = [(i, f"{line}\nown {i}") for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in L.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert [rows[i].n_dropped for i in range(5)] == [1, 1, 1, 1, 0]
    assert rows[2].kept_sha256 == hashlib.sha256(b"own 2").hexdigest()
