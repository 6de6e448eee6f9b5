"""Long passages repeated over documents, found from difference-cover anchors.

A difference cover modulo v is a set of residues whose differences give every residue.
Hashes are made of short windows, anchors, only where a word's place modulo v is in the
cover. Two equal passages, wherever they start, then have an anchor at the same distance
from their starts, less than v: every passage of ``WINDOW`` words that two documents share
has an anchor of ``WINDOW`` - v + 1 words in both. Anchors found in several documents are
extended: first to the stretch that all windows over the anchor cover, which settles these
windows together if a smaller document has it too, then, where that fails at the edges of
a passage, to the single windows. Both are looked up by their smallest document.

Equal hashes inside a stretch of documents are brought together before anything is
shuffled, so a passage in very many documents sends a row or two from each stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorfill.llm.common import SPACED, Hasher, Words, joined, mix, plain_bytes, stored, text_chunks

WINDOW = 50
#: A perfect difference set: each residue but 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words of an anchor.
ANCHOR = WINDOW - PERIOD + 1
#: A stretch is what the windows over an anchor cover: so many words before and after.
BEFORE, AFTER = PERIOD - 1, WINDOW
SEED, SECOND_SEED = 10, 11
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 20


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids as longs, whether there is one)."""
    ids = batch.column("doc_id").cast(pa.int64())
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ~ids.is_null().to_numpy(zero_copy_only=False)


def _places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in its text) of each word."""
    n = np.diff(words.first_word)
    text = np.repeat(np.arange(len(n)), n)
    return text, np.arange(len(words.hash)) - words.first_word[text]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, pos) of anchors. pos is negative (its complement) if a stretch itself
    shows that others have the anchor; h is then a number that nothing else has."""
    hasher, in_cover = Hasher(SEED), np.isin(np.arange(PERIOD), COVER)
    for batch in batches:
        ids, known = _ids(batch)
        for low, high, data, bounds in text_chunks(batch, size=STEP_BYTES):
            words = Words(data, bounds, SPACED, hasher)
            text, pos = _places(words)
            size = np.diff(words.first_word)
            size = np.where(known[low:high] & (size >= WINDOW), size, 0)
            at = np.flatnonzero(in_cover[pos % PERIOD] & (pos + ANCHOR <= size[text]))
            if not len(at):
                continue
            h = hasher.stretches(words.hash, at, at + ANCHOR)
            doc, pos = ids[low:high][text[at]], pos[at]
            order = np.lexsort((doc, h))
            h, doc, pos = h[order], doc[order], pos[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            last = np.append(first[1:], len(h)) - 1
            group = np.repeat(np.arange(len(first)), last - first + 1)
            shared = (doc[first] != doc[last])[group]
            sent = ~shared
            sent[first] = True
            sent[last] = True
            unlike = mix(h + np.arange(len(h), dtype=np.uint64) + mix(doc.view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(sent, h, unlike).view(np.int64)),
                    pa.array(doc),
                    pa.array(np.where(sent, pos, ~pos)),
                ],
                names=["h", "doc", "pos"],
            )


def _runs(group: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the stretches start .. start + size within each group: (group, from, to)."""
    if not len(start):
        return group, start, start
    order = np.lexsort((start, group))
    group, start = group[order], start[order]
    new = np.append(True, (group[1:] != group[:-1]) | (start[1:] > start[:-1] + size))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return group[first], start[first], start[last] + size


def _packed(batch: pa.RecordBatch, values: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """The batch's columns ``names`` and the values as 32-bit numbers in ``packed``."""
    binary = pa.array([x.astype("<i4").tobytes() for x in values], pa.binary())
    return pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], binary], names=[*names, "packed"])


def _pack_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _packed(batch, [np.array(x) for x in batch.column("at").to_pylist()], ["doc"])


def _pack_runs(back: int):
    """mapInArrow function: places ``at`` to runs (from, to) of windows, a place standing
    for the windows from ``back`` places before it on up to its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_pylist()
            rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
            flat = np.array([p for x in at for p in x], dtype=np.int64)
            row, low, high = _runs(rows, flat - back, back + 1)
            edge = np.searchsorted(row, np.arange(len(at) + 1))
            pairs = np.stack([low, high], axis=1)
            yield _packed(batch, [pairs[a:b].ravel() for a, b in zip(edge, edge[1:])], ["doc", "key"])

    return run


def _numbers(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", dtype="<i4").astype(np.int64)


def _marked(runs: Iterator[np.ndarray], size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each place of some texts lies in its text's runs (from, to)."""
    step = np.zeros(int(size.sum()) + 1, dtype=np.int64)
    for pairs, n, base in zip(runs, size, first):
        if len(pairs) and n:
            np.add.at(step, np.clip(pairs[:, 0], 0, n) + base, 1)
            np.add.at(step, np.clip(pairs[:, 1], 0, n) + base, -1)
    return np.cumsum(step[:-1]) > 0


def _extend(single: bool):
    """mapInArrow function: rows (h1, h2, doc, key, pos) of the stretches around the
    anchors ``anchors`` of each text, or (``single``) of the windows over them that
    ``settled`` does not have. pos is negative if a smaller document of the same step has
    the same words; h1 is then a number that nothing else has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second = Hasher(SEED), Hasher(SECOND_SEED)
        for batch in batches:
            ids, _ = _ids(batch)
            key = batch.column("key").to_numpy(zero_copy_only=False)
            anchors = [_numbers(x) for x in batch.column("anchors").to_pylist()]
            settled = [_numbers(x).reshape(-1, 2) for x in batch.column("settled").to_pylist()] if single else []
            for low, high, data, bounds in text_chunks(batch, size=STEP_BYTES):
                words = Words(data, bounds, SPACED, hasher)
                text, pos = _places(words)
                size, first = np.diff(words.first_word), words.first_word[:-1]
                if single:
                    over = (np.stack([x - BEFORE, x + 1], axis=1) for x in anchors[low:high])
                    todo = _marked(over, size, first) & ~_marked(settled[low:high], size, first)
                    at = np.flatnonzero(todo & (pos + WINDOW <= size[text]))
                    start, end = at, at + WINDOW
                else:
                    inside = [x[(x >= BEFORE) & (x + AFTER <= n)] + b for x, n, b in zip(anchors[low:high], size, first)]
                    at = np.concatenate(inside)
                    start, end = at - BEFORE, at + AFTER
                h1 = hasher.stretches(words.hash, start, end)
                h2 = second.stretches(Words(data, bounds, SPACED, second).hash, start, end)
                doc, mine, place = ids[low:high][text[at]], key[low:high][text[at]], pos[at]
                order = np.lexsort((doc, h2, h1))
                h1, h2, doc, mine, place = (x[order] for x in (h1, h2, doc, mine, place))
                new = np.ones(len(at), dtype=bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                found = doc > least
                unlike = mix(h1 + np.arange(len(h1), dtype=np.uint64) + mix(doc.view(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(found, unlike, h1).view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.array(doc),
                        pa.array(mine),
                        pa.array(np.where(found, ~place, place)),
                    ],
                    names=["h1", "h2", "doc", "key", "pos"],
                )

    return run


def _with_key(docs: DataFrame, name: str = "key") -> DataFrame:
    """Add a hash of the text, which tells apart rows that share an id."""
    return docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))


def _place():
    return F.when(F.col("pos") < 0, F.bitwise_not("pos")).otherwise(F.col("pos"))


def _in_smaller(extended: DataFrame, back: int, name: str) -> DataFrame:
    """doc, key, packed: runs of the windows that a smaller document has too."""
    same = Window.partitionBy("h1", "h2")
    later = (F.col("doc") > F.min("doc").over(same)) | (F.col("pos") < 0)
    gone = extended.select("doc", "key", _place().alias("at"), later.alias("later")).where("later")
    gone = gone.groupBy("doc", "key").agg(F.collect_list("at").alias("at"))
    return stored(gone.mapInArrow(_pack_runs(back), "doc long, key long, packed binary"), name)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc, key (hash of the text), packed: for every row (doc_id, text) that has any, the
    windows to remove, as lists of packed (from, to) pairs of 32-bit numbers."""
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    same = Window.partitionBy("h")
    shared = (F.min("doc").over(same) < F.max("doc").over(same)) | (F.col("pos") < 0)
    found = rows.mapInArrow(_anchors, "h long, doc long, pos long")
    found = found.select("doc", _place().alias("at"), shared.alias("shared")).where("shared")
    found = found.groupBy("doc").agg(F.collect_list("at").alias("at"))
    anchors = stored(found.mapInArrow(_pack_places, "doc long, packed binary"), "anchors")
    anchors = anchors.select(F.col("doc").alias("doc_id"), F.col("packed").alias("anchors"))
    size = F.octet_length("anchors") + 32
    texts = joined(_with_key(rows), anchors, "doc_id", "inner", size).select("doc_id", "key", "text", "anchors")
    rows_of = "h1 long, h2 long, doc long, key long, pos long"
    settled = _in_smaller(texts.mapInArrow(_extend(single=False), rows_of), BEFORE, "settled")
    of_text = settled.select(F.col("doc").alias("doc_id"), "key", F.col("packed").alias("settled"))
    left = joined(texts, of_text, ["doc_id", "key"], "left", F.octet_length("settled") + 40)
    single = _in_smaller(left.select(*texts.columns, "settled").mapInArrow(_extend(single=True), rows_of), 0, "single")
    both = settled.union(single).groupBy("doc", "key").agg(F.collect_list("packed").alias("packed"))
    return stored(both, "passages")


def without_repeated_passages(docs: DataFrame) -> DataFrame:
    """Add n_words, n_removed and ``kept`` to rows with doc_id (long) and text.

    A word goes if a window of ``WINDOW`` words over it also starts in a row with a smaller
    id; windows are those of the input. Words are runs of ``[^\\x20\\x09-\\x0D]``; kept
    ones are joined by one space. Null and empty texts have no words. Rows with a null id
    neither lose words nor make others lose any; rows that share an id do not affect each
    other. Texts are read whole; ``docs`` must not have the three new columns.
    """
    gone = repeated_passages(docs)
    gone = gone.select(F.col("doc").alias("_id"), F.col("key").alias("_key"), F.col("packed").alias("_runs"))
    names = docs.columns
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, packed in zip(plain_bytes(batch), batch.column("_runs").to_pylist()):
                words = text.split()
                n_words.append(len(words))
                # Windows from .. to - 1 cover the words up to WINDOW - 1 after the last.
                pairs = np.concatenate([_numbers(x) for x in packed or [b""]]).reshape(-1, 2)
                at, left = 0, []
                for low, high in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]:
                    left += words[at:low]
                    at = max(at, high + WINDOW - 1)
                left += words[at:]
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            columns = [batch.column(c) for c in names]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_removed", "kept"])

    keyed = _with_key(docs, "_text")
    same = (keyed["doc_id"] == F.col("_id")) & (keyed["_text"] == F.col("_key"))
    size = F.aggregate("_runs", F.lit(0), lambda a, x: a + F.octet_length(x)) + 60
    rows = joined(keyed, gone, same, "left", size)
    return rows.drop("_text", "_id", "_key").mapInArrow(cut, schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document, how many are removed, and the sha256 of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = without_repeated_passages(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
