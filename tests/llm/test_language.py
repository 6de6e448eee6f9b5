import math
import zlib

import numpy as np
import pytest

from sensorfill.llm import language as L

SOUNDS = {"aa": ["ba", "da", "ga", "lo"], "bb": ["ñe", "xi", "qu", "zi"], "cc": ["ür", "sch", "ock", "ei"]}


def prose(text, language, words):
    parts = SOUNDS[language]
    return " ".join("".join(parts[text.number(4)] for _ in range(1 + text.number(3))) for _ in range(words))


def sample(text, n=150):
    return [(lang, prose(text, lang, 12).encode()[: L.TRAIN_SPAN]) for lang in SOUNDS for _ in range(n)]


@pytest.fixture(scope="module")
def net():
    from tests.llm.conftest import Text

    return L.train(sample(Text(5)), steps=80)


def plain(net, raw):
    """Mean probabilities of a text, byte by byte in Python."""

    def states(layer, window):
        size, h, out = len(layer.bias), [0.0] * len(layer.bias), []
        for byte in window:
            a = layer.bytes_in[byte].tolist()
            b = [sum(h[i] * float(layer.states_in[i, j]) for i in range(size)) for j in range(3 * size)]
            sig = [1 / (1 + math.exp(-(a[j] + b[j]))) for j in range(2 * size)]
            new = [math.tanh(a[2 * size + j] + sig[size + j] * (b[2 * size + j] + float(layer.bias[j]))) for j in range(size)]
            h = [new[j] + sig[j] * (h[j] - new[j]) for j in range(size)]
            out.append(h)
        return out

    total, count = [0.0] * len(net.languages), 0
    for start in range(0, len(raw), L.SPAN):
        window = [int(L.AS_READ[b]) for b in raw[start : start + L.SPAN]]
        ahead, back = states(net.ahead, window), states(net.back, window[::-1])[::-1]
        for byte, x, y in zip(raw[start : start + L.SPAN], ahead, back):
            if not L.LETTER[byte]:
                continue
            logit = [sum(s * float(w) for s, w in zip([*x, *y, 1.0], net.out[:, k])) for k in range(len(total))]
            top = [math.exp(v - max(logit)) for v in logit]
            total = [t + v / sum(top) for t, v in zip(total, top)]
            count += 1
    return [t / max(1, count) for t in total]


def test_gradients_are_those_of_finite_differences(text):
    net = L.new_network(["a", "b"], hidden=3)
    for layer in (net.ahead, net.back):
        layer.bytes_in, layer.states_in, layer.bias = (w.astype(float) for w in layer.weights)
    net.out = net.out.astype(float)
    rng = np.random.default_rng(1)
    symbols = rng.integers(97, 103, (7, 5)).astype(np.uint8)
    mask = (np.arange(7)[:, None] < np.array([7, 3, 1, 5, 0])).astype(float)
    counted, target = mask * (symbols != 99), np.array([0, 1, 1, 0, 1])
    _, gradients = net.loss_and_gradients(symbols, mask, counted, target)
    for w, g in zip(net.weights, gradients):
        for at in [tuple(rng.integers(n) for n in w.shape) for _ in range(8)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            values = []
            for move in (1e-3, -2e-3):
                w[at] += move
                values.append(net.loss_and_gradients(symbols, mask, counted, target)[0])
            w[at] += 1e-3
            assert g[at] == pytest.approx((values[0] - values[1]) / 2e-3, abs=2e-4)


def test_whole_texts_are_labelled_as_byte_by_byte(net, text, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 3)
    texts = [prose(text, lang, n).encode() for lang, n in (("aa", 90), ("bb", 1), ("cc", 40), ("bb", 25))]
    texts[2:2] = [b"", b"12 34"]
    bounds = np.cumsum([0, *map(len, texts)])
    found = net.pooled(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
    for raw, p in zip(texts, found):
        assert p == pytest.approx(plain(net, raw), abs=1e-4)


def test_languages_are_told_apart(net, text):
    for lang in SOUNDS:
        texts = [prose(text, lang, 1 + i % 20).encode() for i in range(60)]
        bounds = np.cumsum([0, *map(len, texts)])
        p = net.pooled(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
        assert (p.argmax(axis=1) == net.languages.index(lang)).mean() > 0.9


def test_steep_weights_do_not_overflow(net):
    import copy

    steep = copy.deepcopy(net)
    steep.out *= 1e4
    p = steep.pooled(np.frombuffer(b"badalo", dtype=np.uint8), np.array([0, 6]))
    assert np.isfinite(p).all() and p.sum() == pytest.approx(1.0, abs=1e-5)


def test_the_sample_depends_on_texts_and_languages_alone(spark, text, monkeypatch):
    monkeypatch.setattr(L, "DOCS_PER_LANGUAGE", 5)
    rows = [(i, prose(text, lang, 30), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(100 + i, rows[0][1], "aa") for i in range(60)] + [(None, "x", "aa"), (7, "y", None), (8, None, "bb")]
    samples = []
    for parts, some in ((1, rows), (5, rows[::-1])):
        df = spark.createDataFrame(some, "doc_id long, text string, lang string").repartition(parts)
        samples.append(sorted(map(tuple, L.training_windows(df).collect())))
    assert samples[0] == samples[1] and len(samples[0]) == 2 * 5 * L.WINDOWS_PER_DOC
    texts = {t: zlib.crc32(str(i).encode()) % 5 for i, t, lang in rows if t and i is not None}
    assert all(any(w in t for t, rest in texts.items() if rest) for _, w in samples[0])
    assert all(w != "x" and w != "y" for _, w in samples[0])


def test_odd_rows(spark, odd_docs, no_docs, net):
    def labelled(df, net):
        rows = df.withColumn("held_out", L.held_out(df.doc_id))
        return L.with_language(rows.selectExpr("*", "1 AS lang_pred", "2 AS score"), net)

    found = labelled(odd_docs, net).collect()
    assert len(found) == 10
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0] == by_id[1][1] and by_id[1][0]["lang_pred"] in SOUNDS
    assert all(by_id[i][0][2:] == ("und", 0.0) for i in (2, 3, 4))
    assert by_id[5][0][2:] == by_id[6][0][2:]
    assert sorted(r["lang_pred"] == "und" for r in by_id[None]) == [False, True]
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    assert labelled(no_docs, net).collect() == []
    assert {r["lang_pred"] for r in labelled(odd_docs, None).collect()} == {"und"}
    assert L.train([]) is None and L.train([("aa", b"12")]) is None


def test_letters_outside_ascii_and_none(spark, net):
    rows = [(1, "漢字"), (2, "🙂 12"), (3, "é"), (4, "١٢"), (5, "5 = 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "false AS held_out")
    found = {r["doc_id"]: r["lang_pred"] == "und" for r in L.with_language(df, net).collect()}
    assert found == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_query_on_documents_it_did_not_learn_from(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in L.op12_language(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(docs)
    held = [(found[i]["lang_pred"], lang) for i, lang in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r["held_out"]} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([a == b for a, b in held]) > 0.97
