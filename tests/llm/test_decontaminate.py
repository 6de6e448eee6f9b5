import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from sensorfill.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = {}
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (which := windows.get(tuple(w[i : i + size]))) is not None:
                    found |= which
                    hit.update(range(i, i + size))
        out[doc] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def got(docs, items, **options):
    rows = D.with_hits(docs, items, **options).withColumn("hit", D.n_hit()).collect()
    return {r.doc_id: (r.n_words, r.hit, r["items"]) for r in rows}


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    for size in (2, 3, 30):
        seq = rng.integers(0, size, 500)
        index = D.FMIndex(seq, size)
        phrases = np.array([seq[i : i + 3] for i in (0, 5, 77, 400, 497)] + [[1, 1, 1]])
        phrases[phrases == 0] = 1
        first, end = index.search(phrases, np.array([3] * 6))
        for p, a, b in zip(phrases, first, end):
            want = [i for i in range(498) if (seq[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_suffix_array_of_repetitions():
    text = np.array([2, 1] * 100 + [0])
    order = D.suffix_array(text, 3)
    assert list(order) == sorted(range(len(text)), key=lambda i: list(text[i:]))


def test_against_brute_force(spark, text):
    items = [(i, " ".join(text.words(20, of=40))) for i in range(12)]
    items += [(20, "short Item"), (21, "a"), (22, ""), (23, None), (None, " ".join(text.words(15))), (1, items[0][1])]
    docs = []
    for i in range(40):
        w = text.words(60, of=40)
        item = items[i % 12][1].split()
        w[10:10] = item[i % 5 : 13 + i % 9]
        docs.append((i, ", ".join(w).upper() if i % 2 else "\n".join(w)))
    docs += [(90, "Short, ITEM"), (91, "x a x a"), (92, items[3][1] * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert got(d, it) == want
    # Many blocks of phrases give the same.
    assert got(d, it, block_bytes=200) == want


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    items = spark.createDataFrame([(1, "one two three four five"), (2, None)], "item_id long, text string")
    rows = D.with_hits(odd_docs, items).withColumn("hit", D.n_hit()).collect()
    assert [r.hit for r in rows if r.text and r.text.startswith("one")] == [5, 5, 5]
    assert D.with_hits(no_docs, items).count() == 0
    none = D.with_hits(odd_docs, items.where("false")).withColumn("hit", D.n_hit()).collect()
    assert len(none) == 10 and not any(r.hit for r in none)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = odd_docs.withColumn("n_words", F.lit("mine")).withColumn("items", F.lit(1))
    kept = D.drop_contaminated(spark, clash, str(tmp_path))
    assert kept.columns == clash.columns and kept.count() == 7
    assert {r.n_words for r in kept.collect()} == {"mine"}


def test_query_columns(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(13))
    spark.createDataFrame([(7, item), (10, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, item + " z" * 247), (2, item + " z" * 248), (3, "z")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in D.op6_decontaminate(spark, str(tmp_path)).collect()}
    assert [rows[i].contaminated for i in (1, 2, 3)] == [True, False, False]
    assert rows[1].n_items == 2 and rows[1].items_sha256 == hashlib.sha256(b"10,7").hexdigest()
    assert rows[3].items_sha256 == hashlib.sha256(b"").hexdigest()
