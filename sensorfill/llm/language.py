"""Language of texts by a bidirectional gated recurrent network over bytes.

Two recurrent layers read a window of bytes, one from each end. Both states at a position
give the probabilities of the languages there; a document's are the mean over the
positions of its letters. Whole texts are read: a document is cut into windows that follow
each other, every byte is in one. The network is trained by backpropagation through time,
in numpy, on a bounded sample of windows; its weights, a few thousand numbers, go to the
tasks, which label many windows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from sensorfill.llm.common import byte_class, text_chunks

HIDDEN = 8
#: Bytes of a window, when texts are read.
SPAN = 96
#: Windows of a block that is labelled at once.
BLOCK = 2048
#: The sample: documents of each language at most, and of all; windows of a document.
DOCS_PER_LANGUAGE, MAX_DOCS, WINDOWS_PER_DOC = 600, 20_000, 4
#: Bytes of a training window.
TRAIN_SPAN = 48
BATCH, STEPS, RATE = 256, 260, 0.02
SEED = 11
HASHES = 1 << 60
UNDECIDED = "und"

#: Bytes that belong to letters, and bytes as the network reads them: A-Z as a-z.
LETTER, AS_READ = byte_class(bytes(range(97, 123)), high=True, lower=True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class Layer:
    """Gated recurrent units that read one way: update, reset and new-state parts."""

    #: A row for each byte value: what it adds to the three parts.
    bytes_in: np.ndarray
    states_in: np.ndarray
    #: Of the new-state part alone, inside the reset.
    bias: np.ndarray

    def step(self, symbols: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states after one byte each; a column for each row of the block."""
        size = len(h)
        a, b = self.bytes_in.T.take(symbols, axis=1), self.states_in.T @ h
        gates = a[: 2 * size]
        gates += b[: 2 * size]
        _sigmoid(gates)
        new = b[2 * size :]
        new += self.bias[:, None]
        new *= gates[size:]
        new += a[2 * size :]
        np.tanh(new, out=new)
        out = h - new
        out *= gates[:size]
        out += new
        return out

    def forward(self, symbols: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each of the (time, row) symbols, and what ``backward`` needs.

        Where ``mask`` is 0 the state is zero: nothing was read yet, or no more is.
        """
        size = len(self.bias)
        h = np.zeros((symbols.shape[1], size), dtype=np.float32)
        states, kept = [], []
        for s, m in zip(symbols, mask):
            a, b = self.bytes_in[s], h @ self.states_in
            gates = _sigmoid(a[:, : 2 * size] + b[:, : 2 * size])
            inner = b[:, 2 * size :] + self.bias
            new = np.tanh(a[:, 2 * size :] + gates[:, size:] * inner)
            kept.append((h, gates, inner, new))
            h = (new + gates[:, :size] * (h - new)) * m[:, None]
            states.append(h)
        return np.stack(states), kept

    def backward(self, symbols: np.ndarray, mask: np.ndarray, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of the three weights, backwards through time."""
        size = len(self.bias)
        d_bytes = np.zeros_like(self.bytes_in)
        d_states_in, d_bias = np.zeros_like(self.states_in), np.zeros_like(self.bias)
        d_h = np.zeros_like(d_states[0])
        for t in range(len(symbols) - 1, -1, -1):
            before, gates, inner, new = kept[t]
            update, reset = gates[:, :size], gates[:, size:]
            d = (d_states[t] + d_h) * mask[t][:, None]
            d_new = d * (1 - update) * (1 - new * new)
            d_gates = np.concatenate((d * (before - new), d_new * inner), axis=1) * gates * (1 - gates)
            d_inner = d_new * reset
            d_a = np.concatenate((d_gates, d_new), axis=1)
            d_b = np.concatenate((d_gates, d_inner), axis=1)
            one_hot = np.zeros((len(self.bytes_in), len(d_a)), dtype=np.float32)
            one_hot[symbols[t], np.arange(len(d_a))] = 1.0
            d_bytes += one_hot @ d_a
            d_states_in += before.T @ d_b
            d_bias += d_inner.sum(axis=0)
            d_h = d * update + d_b @ self.states_in.T
        return [d_bytes, d_states_in, d_bias]

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.bytes_in, self.states_in, self.bias]


@dataclass
class Network:
    """The two layers, and from both states to the languages."""

    languages: list[str]
    ahead: Layer
    back: Layer
    #: A row for each of both layers' states, then the bias.
    out: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights, *self.back.weights, self.out]

    def loss_and_gradients(self, symbols, mask, counted, target) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the ``counted`` positions of (time, row) symbols."""
        ahead, kept_ahead = self.ahead.forward(symbols, mask)
        back, kept_back = self.back.forward(symbols[::-1], mask[::-1])
        one = np.ones((*symbols.shape, 1), dtype=np.float32)
        states = np.concatenate((ahead, back[::-1], one), axis=2)
        p = _softmax(states @ self.out)
        total = max(1.0, float(counted.sum()))
        rows = np.arange(symbols.shape[1])
        loss = -(np.log(p[:, rows, target] + 1e-30) * counted).sum() / total
        d = p.copy()
        d[:, rows, target] -= 1.0
        d *= counted[:, :, None] / np.float32(total)
        flat = d.reshape(-1, d.shape[2])
        d_out = states.reshape(-1, states.shape[2]).T @ flat
        d_states = (d @ self.out.T).astype(np.float32)
        size = ahead.shape[2]
        g_ahead = self.ahead.backward(symbols, mask, kept_ahead, d_states[:, :, :size])
        g_back = self.back.backward(symbols[::-1], mask[::-1], kept_back, d_states[::-1, :, size : 2 * size])
        return float(loss), [*g_ahead, *g_back, d_out]

    def window_sums(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sums of the probabilities over each window's letters. Longer windows first."""
        size, width = len(self.ahead.bias), int(length[0])
        at = np.minimum(start[:, None] + np.arange(width), len(data) - 1)
        raw = np.ascontiguousarray(data[at].T)
        symbols, letters = AS_READ[raw], LETTER[raw].astype(np.float32)
        # Rows that still have a byte at each place: the first ones, as windows are sorted.
        active = len(start) - np.searchsorted(length[::-1], np.arange(width), side="right")
        seen = np.zeros((width, size, len(start)), dtype=np.float32)
        h = np.zeros((size, len(start)), dtype=np.float32)
        for t in range(width):
            n = active[t]
            h = self.ahead.step(symbols[t, :n], h[:, :n])
            seen[t, :, :n] = h
        sums = np.zeros((len(self.languages), len(start)), dtype=np.float32)
        h = np.zeros((size, len(start)), dtype=np.float32)
        to_ahead, to_back, bias = self.out[:size].T, self.out[size : 2 * size].T, self.out[-1][:, None]
        # States are between -1 and 1; beyond this bound exponentials could overflow.
        steep = float(np.abs(self.out).sum(axis=0).max()) > 60.0
        for t in range(width - 1, -1, -1):
            n = active[t]
            h[:, :n] = self.back.step(symbols[t, :n], h[:, :n])
            p = to_ahead @ seen[t, :, :n]
            p += to_back @ h[:, :n]
            p += bias
            if steep:
                p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= letters[t, :n] / p.sum(axis=0)
            sums[:, :n] += p
        return sums.T

    def pooled(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean probabilities over the letters of each text; zeros without a letter."""
        sizes = np.diff(bounds)
        windows = -(-sizes // SPAN)
        text = np.repeat(np.arange(len(sizes)), windows)
        place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = bounds[text] + place * SPAN
        length = np.minimum(SPAN, bounds[text + 1] - start)
        order = np.argsort(-length, kind="stable")
        total = np.zeros((len(sizes), len(self.languages)))
        for some in np.split(order, range(BLOCK, len(order), BLOCK)):
            if len(some):
                np.add.at(total, text[some], self.window_sums(data, start[some], length[some]))
        count = total.sum(axis=1, keepdims=True)
        return total / np.where(count > 0, count, 1.0)


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)

    def layer() -> Layer:
        bytes_in = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        states_in = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        bytes_in[:, :hidden] += 0.5  # begin with some memory
        return Layer(bytes_in, states_in, np.zeros(hidden, dtype=np.float32))

    out = rng.normal(0, 0.1, (2 * hidden + 1, len(languages))).astype(np.float32)
    return Network(languages, layer(), layer(), out)


def train(sample: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network | None:
    """The network after ``steps`` steps over (language, window) pairs; None without any.

    Languages get equal shares of each batch, whatever their shares of the sample.
    """
    by_language: dict[str, list[bytes]] = {}
    for language, window in sorted(sample):
        if LETTER[np.frombuffer(window, dtype=np.uint8)].any():
            by_language.setdefault(language, []).append(window)
    if not by_language:
        return None
    languages = sorted(by_language)
    net = new_network(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        target = (np.arange(BATCH) + rng.integers(len(languages))) % len(languages)
        windows = [by_language[languages[i]][rng.integers(len(by_language[languages[i]]))] for i in target]
        symbols = np.zeros((BATCH, TRAIN_SPAN), dtype=np.uint8)
        mask = np.zeros((BATCH, TRAIN_SPAN), dtype=np.float32)
        for row, window in enumerate(windows):
            raw = np.frombuffer(window[:TRAIN_SPAN], dtype=np.uint8)
            symbols[row, : len(raw)], mask[row, : len(raw)] = raw, 1.0
        counted = (mask * LETTER[symbols]).T
        _, gradients = net.loss_and_gradients(AS_READ[symbols].T, mask.T, counted, target)
        norm = float(np.sqrt(sum((g * g).sum() for g in gradients)))
        rate = RATE * (1 - (step - 1) / steps)
        for w, g, m, v in zip(net.weights, gradients, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5. A null id is
    not held out, but nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_windows(docs: DataFrame) -> DataFrame:
    """(lang, window): windows of the documents with the least hashes of each language.

    Of equal texts of a language one is taken. Which rows these are depends on the texts
    and languages alone. Languages share ``MAX_DOCS`` evenly, and ``DOCS_PER_LANGUAGE``
    is the most that each has; ``WINDOWS_PER_DOC`` windows lie anywhere in a text.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    last = F.greatest(F.length("text") - F.lit(TRAIN_SPAN), F.lit(0)) + 1
    windows = [
        F.substring(F.col("text"), (1 + F.pmod(F.xxhash64("text", F.lit(i)), last)).cast("int"), F.lit(TRAIN_SPAN))
        for i in range(WINDOWS_PER_DOC)
    ]
    hashed = known.withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(HASHES)))
    # A row for each language, of about how many texts it has.
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()
    each = max(1, min(DOCS_PER_LANGUAGE, MAX_DOCS // max(1, len(sizes))))
    # Twice what is needed, so that the least hashes are surely among them.
    limits = [(r["lang"], min(HASHES, HASHES * 2 * (each + 50) // r["n"])) for r in sizes]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, below long")
    near = hashed.join(F.broadcast(limits), "lang").where("hash < below")
    cut = near.groupBy("lang", "hash").agg(F.min(F.array(*windows)).alias("windows"))
    order = SqlWindow.partitionBy("lang").orderBy("hash")
    ranked = cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    return ranked.select("lang", F.explode("windows").alias("window"))


def trained(docs: DataFrame) -> Network | None:
    """The network for the languages of ``docs``; its bounded sample goes to the driver."""
    rows = training_windows(docs).collect()
    return train([(r["lang"], r["window"].encode()) for r in rows])


def _label(net: Network | None, keep: list[str]):
    """mapInArrow function: language and probability of each text that has a letter."""

    def run(batches):
        for batch in batches:
            names, scores = [UNDECIDED] * len(batch), np.zeros(len(batch))
            wanted = batch.column("_letter").to_numpy(zero_copy_only=False)
            for first, last, data, bounds in text_chunks(batch) if net else ():
                # Further digits depend on which windows share a block.
                p = net.pooled(data, bounds).round(6)
                best = p.argmax(axis=1)
                for i in np.flatnonzero(wanted[first:last]):
                    names[first + i] = net.languages[best[i]]
                    scores[first + i] = min(1.0, p[i, best[i]])
            kept = {c: batch.column(c) for c in keep}
            yield pa.record_batch({**kept, "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    return run


def with_language(docs: DataFrame, net: Network | None) -> DataFrame:
    """Add ``lang_pred`` and ``score``, its probability to six digits, to
    (doc_id, held_out, text); ties go to the language that sorts first.

    A text that is null, empty or without a letter is ``und`` with score 0, and so is
    every text if nothing could be learned. Repeated rows are labelled alike; texts of any
    length are read whole. Null ids are ids like others; other columns are not read.
    """
    keep = ["doc_id", "held_out"]
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, "text", letter.alias("_letter"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in keep) + ", lang_pred string, score double"
    return rows.mapInArrow(_label(net, keep), schema)


def op12_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = trained(docs.select("doc_id", "text", "lang"))
    return with_language(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), net)
