import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sensorfill.llm import token_counts as C


@pytest.fixture(scope="module")
def both():
    return C.Counter(), Tokenizer.from_file(C.TOKENIZER)


def exact(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_like_the_library(both):
    counter, library = both
    rng = random.Random(1)
    letters = " \n\t  abcdest'.,1 2é　\x85\xa0x<|>ß界🙂㈻\U000323b0"
    for i in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(18)))
        if i % 7 == 0:
            text += "<|endoftext|>" * (i % 3) + text
        assert counter.count(text) == exact(library, text), repr(text)


def test_any_text(both):
    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=60))
    def same(text):
        assert both[0].count(text) == exact(both[1], text)

    same()


def test_memo_does_not_change_counts(both, monkeypatch):
    counter, library = both
    monkeypatch.setattr(C, "MEMO", 3)
    text = "the cat sat on the mat, the  cat\n\nsat. " * 20
    assert counter.count(text) == exact(library, text)


def test_one_long_word(both):
    counter, library = both
    word = "abcde" * 8000
    assert counter.count(word) == exact(library, word)


def test_classes_of_all_code_points(both):
    _, library = both
    words = C.word_pattern()
    for low in range(0, 0x110000, 64):
        text = " ".join(f"a{c}1{c} {c}.{c}" for c in map(chr, range(low, low + 64)) if not "\ud800" <= c <= "\udfff")
        split = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert split == words.findall(text), hex(low)


def test_odd_rows(spark, both, odd_docs, no_docs):
    rows = C.with_counts(odd_docs).collect()
    for r in rows:
        assert r.n_tokens == exact(both[1], r.text or "") and r.n_bytes == len((r.text or "").encode())
    assert C.with_counts(no_docs).count() == 0


def test_query(spark, tmp_path):
    docs = [(1, "a " * 512), (2, "a " * 300), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in C.op4_token_counts(spark, str(tmp_path)).collect()}
    assert [rows[i].over_limit for i in (1, 2, 3)] == [True, False, False]
    assert rows[3].n_tokens == rows[3].n_bytes == 0
