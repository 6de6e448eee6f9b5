import hashlib

from sensorfill.llm import passages as P


def brute(docs):
    first = {}
    split = [(d, [w for w in (t or "").encode().split()]) for d, t in docs]
    for doc, words in split:
        if doc is not None:
            for i in range(len(words) - 49):
                key = tuple(words[i : i + 50])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, words in split:
        gone = set()
        if doc is not None:
            for i in range(len(words) - 49):
                if first[tuple(words[i : i + 50])] < doc:
                    gone.update(range(i, i + 50))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=str)


def got(docs):
    rows = P.without_repeated_passages(docs).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str)


def test_cover():
    assert {(a - b) % P.PERIOD for a in P.COVER for b in P.COVER} == set(range(P.PERIOD))


def test_against_brute_force(spark, text):
    passages = [text.words(45 + 4 * i, of=10_000) for i in range(25)]
    docs = []
    for i in range(150):
        words = text.words(text.number(70))
        for _ in range(text.number(4)):
            p = passages[text.number(25)]
            cut = text.number(3)
            words = words + p[cut : len(p) - text.number(3)] + text.words(text.number(40))
        docs.append((997 * i % 150, (" \n"[i % 2]).join(words)))
    docs += [(200 + i, docs[i][1]) for i in range(20)]  # whole copies
    docs += [(300, " ".join(passages[7] * 3)), (301, " ".join(["same"] * 300)), (302, " ".join(["same"] * 90))]
    docs += [(None, docs[3][1]), (5, docs[9][1]), (5, docs[9][1]), (400, None), (401, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(docs)
    assert sum(r[2] for r in want) > 3000
    assert got(d) == want


def test_every_shift_of_a_passage_is_found(spark, text):
    passage = text.words(50, of=10_000)
    docs = [(0, " ".join(passage))]
    docs += [(i + 1, " ".join(text.words(i, of=10_000) + passage)) for i in range(2 * P.PERIOD)]
    rows = got(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    assert sorted((r[0], r[2]) for r in rows) == [(0, 0)] + [(i + 1, 50) for i in range(2 * P.PERIOD)]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = P.without_repeated_passages(odd_docs)
    assert rows.columns == [*odd_docs.columns, "n_words", "n_removed", "kept"]
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows.collect() if r.n_removed) == [(6, 30_000)]
    assert P.without_repeated_passages(no_docs).count() == 0


def test_query(spark, text, tmp_path):
    passage = " ".join(text.words(60, of=10_000))
    docs = spark.createDataFrame([(2, f"x  {passage} y"), (1, passage)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in P.op10_substring_dedup(spark, str(tmp_path)).collect()}
    assert (rows[2].n_words, rows[2].n_removed) == (62, 60)
    assert rows[2].kept_sha256 == hashlib.sha256(b"x y").hexdigest()
