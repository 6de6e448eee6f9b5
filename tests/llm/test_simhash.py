import itertools
import random

import xxhash

from sensorfill.llm import simhash as S


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_masks_cover_every_pair_within_the_radius():
    masks = S.masks(2)
    for bits in itertools.combinations(range(64), 2):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)
    rng = random.Random(1)
    masks = S.masks()
    assert len(masks) == 31
    for _ in range(3000):
        bits = rng.sample(range(64), 4)
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_links_connect_like_brute_force(spark):
    rng = random.Random(2)
    fps = {}
    for i in range(40):
        fp = rng.getrandbits(64)
        for _ in range(12):
            fps[len(fps)] = fp
            fp ^= sum(1 << b for b in rng.sample(range(64), rng.randint(2, 6)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps.values()]
    rows = spark.createDataFrame(signed, "fp long").distinct()
    want = brute_components(fps)
    of_fp = {}
    for i, (f,) in enumerate(signed):
        of_fp.setdefault(want[i], set()).add(f)
    groups = {frozenset(g) for g in of_fp.values() if len(g) > 1}
    for block in (S.BLOCK, 3):  # the second cuts buckets into blocks
        found = {}
        for r in S.components(S.links(rows, block=block)).collect():
            found.setdefault(r.root, {r.root}).add(r.node)
        assert {frozenset(g) for g in found.values()} == groups


def test_query_against_brute_force(spark, text):
    texts = {}
    for i in range(60):
        words = text.words(80)
        texts[4 * i] = " ".join(words)
        texts[4 * i + 1] = " ".join(words).upper()
        words[text.number(80)] = "other"
        texts[4 * i + 2] = "\n".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = {i: (fps[i], c) for i, c in brute_components(fps).items()}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in S.near_copies(docs).collect()}
    assert got == want
    kept = sorted(r.doc_id for r in S.drop_near_copies(docs).collect())
    assert kept == sorted({c for _, c in want.values()})


def test_odd_rows(spark, odd_docs, no_docs):
    rows = S.near_copies(odd_docs).collect()
    assert len(rows) == 10
    empty = [r for r in rows if r.fp == 0]
    assert len(empty) == 4 and {r.component_id for r in empty} == {2}
    same = [r.component_id for r in rows if r.doc_id in (1, None) and r.fp != 0]
    assert same == [1, 1, 1]
    kept = S.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7]
    assert S.near_copies(no_docs).count() == S.drop_near_copies(no_docs).count() == 0


def test_groups_without_ids_keep_one_row(spark):
    docs = spark.createDataFrame([(None, "a b c d e")] * 3 + [(None, "f g h i j")], "doc_id long, text string")
    assert sorted(r.text for r in S.drop_near_copies(docs).collect()) == ["a b c d e", "f g h i j"]


def test_an_id_with_two_texts_keeps_the_chosen_one(spark):
    rows = [(1, "a b c d e"), (2, "f g h i j"), (2, "a b c d e"), (3, "f g h i j")]
    kept = S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [(1, "a b c d e"), (2, "f g h i j")]
