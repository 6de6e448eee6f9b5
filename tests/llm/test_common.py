import numpy as np
import pytest

from sensorfill.llm.common import ALNUM, LONG_WORD, SPACED, Hasher, Words
from sensorfill.llm.decontaminate import with_hits
from sensorfill.llm.passages import without_repeated_passages


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def hashes(texts, kind=SPACED, seed=1):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    return Words(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds, kind, Hasher(seed)).hash


def test_words_have_one_hash_wherever_they_stand(text):
    words = sorted({"x" * n for n in range(1, 40)} | {f"w{text.number(10**9)}" for _ in range(5000)})
    words += ["é" * n for n in (1, 4, 5, LONG_WORD, LONG_WORD + 3)] + ["a" * (LONG_WORD + n) for n in (0, 1, 8)]
    first = hashes([" ".join(words)])
    assert len(set(first.tolist())) == len(words)
    order = np.random.default_rng(1).permutation(len(words))
    assert (hashes([f"\n{words[i]}" for i in order]) == first[order]).all()
    assert not (hashes(words, seed=2) == first).any()


def test_case_counts_only_where_the_kind_of_word_says_so():
    same = hashes(["Word", "word"], ALNUM)
    assert same[0] == same[1]
    other = hashes(["Word", "word"], SPACED)
    assert other[0] != other[1]
    assert len(hashes(["", " "])) == 0


@pytest.mark.parametrize("n", [64, 128, 256, 512, 1024, 2048, 4096])
def test_alternating_words_and_their_complements_differ(n):
    for seed in (1, 6, 10, 11):
        a, b = hashes([thue_morse(n), thue_morse(n, True)], seed=seed)
        assert a != b and (int(a) ^ int(b)).bit_count() > 8


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_texts_that_differ_in_such_a_word_are_not_the_same(spark, n):
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{thue_morse(n)} {rest}"), (2, f"{thue_morse(n, True)} {rest}"), (3, f"{thue_morse(n)} {rest}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in without_repeated_passages(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 50}
    item = spark.createDataFrame([(7, f"{thue_morse(n, True)} {' '.join(rest.split()[:12])}")], "item_id long, text string")
    found = {r["doc_id"]: r["items"] for r in with_hits(docs, item).collect()}
    assert found == {1: [], 2: ["7"], 3: []}
