"""Benchmark passages in training texts, found with an FM-index of each shard.

A shard is a stretch of whole documents inside a task. Its words become symbols, all
words of no phrase one separator; runs of phrase words shorter than the shortest phrase
cannot hold an occurrence and are left out. Over the rest an FM-index is built: the
Burrows-Wheeler transform in a wavelet matrix, and every eighth suffix position. All
phrases are searched backwards at once, their occurrences located by walking to the next
sampled position, and the spans of each document merged.

Phrases are sent to the tasks in blocks of bounded size; each block is one more pass
over the documents in the same stage, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorfill.llm.common import ALNUM, Hasher, Words, text_chunks

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Bytes of phrase texts that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Every so many-th suffix position is kept.
SAMPLE = 8
SEED = 6


def _symbol_runs(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``lengths``, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in order; symbols are below ``size``
    and the last one occurs once. Ranks of 2^k symbols give those of 2^(k+1)."""
    n, width = len(text), 1
    rank = text.astype(np.int64)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (size + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        if n < 2 or new[order[-1]] == n - 1:
            return order
        rank, size, width = new, n, 2 * width


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit row for each bit of the symbols."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        row = sequence
        for level in reversed(range(bits)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(row) - int(bit.sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, at = np.zeros_like(at), at
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            one = ((symbol >> level) & 1).astype(bool)
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - start


class FMIndex:
    def __init__(self, text: np.ndarray, size: int):
        """``text``: symbols from 1, separators 0; the end is added here."""
        # The end is symbol 0 and occurs once; all others move up by one.
        text = np.append(text + 1, 0)
        size += 1
        order = suffix_array(text, size)
        self.last = text[order - 1]  # the Burrows-Wheeler transform
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.matrix = WaveletMatrix(self.last, max(1, size.bit_length()))
        sampled = order % SAMPLE == 0
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.position = order[sampled]
        self.n = len(text)

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.matrix.rank(symbol, row)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [first, end) of the suffixes that begin with each phrase.

        ``phrases`` has a phrase in each row, flush right, in symbols from 1.
        """
        first = np.zeros(len(phrases), dtype=np.int64)
        end = np.full(len(phrases), self.n, dtype=np.int64)
        width = phrases.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (first < end))
            symbol = phrases[live, width - 1 - k] + 1
            first[live], end[live] = self._step(symbol, first[live]), self._step(symbol, end[live])
        return first, end

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of suffixes: walk backwards to the next sampled one."""
        found = np.zeros(len(row), dtype=np.int64)
        live, steps = np.arange(len(row)), 0
        row = row.copy()
        while len(live):
            at = row[live]
            here = self.sampled[at + 1] > self.sampled[at]
            found[live[here]] = self.position[self.sampled[at[here]]] + steps
            live, at = live[~here], at[~here]
            row[live] = self._step(self.last[at], at)
            steps += 1
        return found


@dataclass(frozen=True)
class Phrases:
    """Windows of items as rows of symbols, and what tells symbols and items from them."""

    words: np.ndarray  # hashes of the words, sorted; word i is symbol i + 1
    rows: np.ndarray  # distinct windows, flush right
    lengths: np.ndarray
    item_of: np.ndarray  # (window, item) pairs, sorted by window
    first_item: np.ndarray  # place of each window's first pair
    items: list[str | None]


def make_phrases(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases | None:
    """The windows of (id, text) rows; None if no item has a word."""
    data = [text.encode() for _, text in items]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    found = Words(np.frombuffer(b"".join(data), dtype=np.uint8), bounds, ALNUM, Hasher(SEED))
    words, symbol = np.unique(found.hash, return_inverse=True)
    n = np.diff(found.first_word)
    lengths = np.minimum(n, window)
    windows = np.where(n > 0, n - lengths + 1, 0)
    item = np.repeat(np.arange(len(items)), windows)
    if not len(item):
        return None
    start = np.repeat(found.first_word[:-1], windows) + _symbol_runs(windows)
    size = lengths[item]
    at = np.arange(window) - (window - size)[:, None]
    rows = np.where(at >= 0, symbol[np.clip(start[:, None] + at, 0, len(symbol) - 1)] + 1, 0)
    rows, which = np.unique(rows, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), item], axis=1), axis=0)
    return Phrases(
        words,
        rows,
        (rows > 0).sum(axis=1),
        pairs[:, 1],
        np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)),
        [i for i, _ in items],
    )


def _hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, length, window) of all occurrences of windows in a shard's texts."""
    n = len(words.hash)
    place = np.searchsorted(phrases.words, words.hash)
    known = phrases.words[np.minimum(place, len(phrases.words) - 1)] == words.hash
    # Runs of phrase words inside one text, long enough for the shortest window.
    text_of = np.searchsorted(words.first_word, np.arange(n), side="right")
    split = np.ones(n, dtype=bool)
    split[1:] = ~(known[1:] & known[:-1] & (text_of[1:] == text_of[:-1]))
    starts = np.flatnonzero(split & known)
    run_end = np.append(np.flatnonzero(split[1:]) + 1, n)
    ends = run_end[np.searchsorted(run_end, starts, side="right")]
    long = ends - starts >= phrases.lengths.min()
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 3
    # Each run and one separator.
    inside = _symbol_runs(sizes + 1)
    word = np.repeat(starts, sizes + 1) + inside
    separator = inside == np.repeat(sizes, sizes + 1)
    text = np.where(separator, 0, place[np.minimum(word, n - 1)] + 1)
    index = FMIndex(text, len(phrases.words) + 1)
    first, end = index.search(phrases.rows, phrases.lengths)
    count = np.maximum(end - first, 0)
    which = np.repeat(np.arange(len(count)), count)
    at = index.locate(np.repeat(first, count) + _symbol_runs(count))
    return word[at], phrases.lengths[which], which


def _shard(words: Words, phrases: Phrases, n_texts: int):
    """For each text, its merged spans [start, end) in words, and the items found."""
    at, length, which = _hits(words, phrases)
    n = len(words.hash)
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    # An occurrence stays in its text, so spans do too, but for touching ones of two texts.
    covered = np.cumsum(step[:-1]) > 0
    new_text = np.zeros(n + 1, dtype=bool)
    new_text[words.first_word] = True
    begins = np.flatnonzero(covered & (new_text[:-1] | ~np.concatenate(([False], covered[:-1])))) if n else at
    stops = np.flatnonzero(covered & (new_text[1:] | ~np.concatenate((covered[1:], [False])))) + 1 if n else at
    spans: list[list[int]] = [[] for _ in range(n_texts)]
    text = np.searchsorted(words.first_word, begins, side="right") - 1
    for t, b, e in zip(text, begins, stops):
        base = words.first_word[t]
        spans[t] += [int(b - base), int(e - base)]
    items: list[set] = [set() for _ in range(n_texts)]
    text = np.searchsorted(words.first_word, at, side="right") - 1
    for t, w in np.unique(np.stack([text, which], axis=1), axis=0):
        items[t].update(phrases.item_of[phrases.first_item[w] : phrases.first_item[w + 1]])
    return spans, [sorted({phrases.items[i] for i in x} - {None}) for x in items]


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _pass(phrases: Phrases | None, text: str, first: bool):
    """mapInArrow function of one block of phrases; later ones add to the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in batches:
            n_words, spans, items = [], [], []
            for low, high, data, bounds in text_chunks(batch, text):
                words = Words(data, bounds, ALNUM, hasher)
                n_words.append(np.diff(words.first_word))
                if phrases is None:
                    s, i = [[]] * (high - low), [[]] * (high - low)
                else:
                    s, i = _shard(words, phrases, high - low)
                spans += s
                items += i
            columns, names = list(batch.columns), list(batch.schema.names)
            if first:
                columns += [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), None, None]
                names += ["n_words", "spans", "items"]
            else:
                spans = [_merged(a + b) for a, b in zip(columns[-2].to_pylist(), spans)]
                items = [sorted({*a, *b}) for a, b in zip(columns[-1].to_pylist(), items)]
            columns[-2:] = [pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def with_hits(
    docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``spans`` (merged, as start, end, start, end ... in words) and
    ``items`` (ids as strings, sorted) to each document.

    ``items`` has texts in column ``text`` too. Null texts have no words. Items without
    words match nothing; items with a null id match but are not listed; repeated ids are
    listed once. Empty tables are fine. ``docs`` must not have the three columns.
    """
    known = items.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = known.agg(F.sum(F.octet_length("text") + 32)).head()[0] or 0
    blocks = -(-size // block_bytes) or 1
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.LongType())),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    out = docs
    for block in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        # At most about block_bytes reach the driver and each task.
        phrases = make_phrases([(r.id, r.text) for r in mine.collect()], window)
        out = out.mapInArrow(_pass(phrases, text, block == 0), schema)
    return out


def n_hit() -> Column:
    """Words inside spans."""
    at = F.sequence(F.lit(1), F.size("spans"), F.lit(2))
    each = F.transform(at, lambda i: F.element_at("spans", i + 1) - F.element_at("spans", i))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size("spans") > 0, total).otherwise(F.lit(0).cast("long"))


def contaminated(hit: Column, words: Column) -> Column:
    """A twentieth of a document's words or more lie inside occurrences."""
    return (hit > 0) & (20 * hit >= words)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(n_hit(), F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go; all others stay as they are."""
    names = docs.columns
    clash = {c: f"_doc_{c}" for c in names if c in ("n_words", "spans", "items")}
    found = with_hits(docs.withColumnsRenamed(clash), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    kept = found.where(~contaminated(n_hit(), F.col("n_words")))
    return kept.select(*[F.col(clash.get(c, c)).alias(c) for c in names])
