"""Lines repeated over documents, dropped by probing a sharded minimal perfect hash.

The hashes of all lines found in enough documents are dealt into shards. Each shard
builds a minimal perfect hash: in level after level, keys that are alone in their place
of a bit row stay there, the others go on. The number of set bits before a key's place is
its index into compact arrays of fingerprints, counts and largest document ids. Documents
probe these arrays; no line is joined to a line.

Shards that are small together are sent to all tasks. Beyond that the documents' line
hashes go to their shard in packed rows, and the numbers of the lines to drop come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorfill.llm.common import ASCII_SPACE, mix, plain_bytes, stored
from sensorfill.operators.scale import BROADCAST_BYTES

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines in a shard of the index, and lines that probe a shard in one task, about.
SHARD_LINES = 500_000
#: Bits of a level of the perfect hash for each key that is left.
SPREAD = 2
#: Stands for a null id, so below all ids.
NO_ID = -(1 << 63)


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line, its 16-byte hash as read without case and outer white space, or
    None if that is too short. Hashes are of 128 bits, so different lines do not meet."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(ASCII_SPACE)
        # A code point has one to four bytes.
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key.lower()))
    return out


def _ids(batch: pa.RecordBatch) -> list[int]:
    return batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_pylist()


def _halves(keys: list[bytes]) -> np.ndarray:
    """The two 64-bit halves of hashes, as rows."""
    return np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n (documents), last (largest id) of every line that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[bytes, int] = {}
            last: dict[bytes, int] = {}
            for doc, text in zip(_ids(batch), plain_bytes(batch)):
                for key in set(line_keys(text, min_chars)) - {None}:
                    n[key] = n.get(key, 0) + 1
                    last[key] = max(last.get(key, doc), doc)
            h = _halves(list(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(n.values()), pa.int64()), pa.array(list(last.values()), pa.int64())],
                names=["h1", "h2", "n", "last"],
            )

    found = docs.select("doc_id", "text").mapInArrow(run, "h1 long, h2 long, n long, last long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


class PerfectHash:
    """Distinct 128-bit keys (rows of two halves) to 0 .. n - 1, by their places in one
    bit row after another."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(x.view(np.uint64)) for x in levels]
        self.before, total = [], 0
        for c in counts:
            sums = np.concatenate(([0], np.cumsum(c))) + total
            self.before.append(sums)
            total = int(sums[-1])

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        turn = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        halves = keys.view(np.uint64)
        # Keys that agree in one half part by the other, at some level.
        return (mix(halves[:, 0] + turn) ^ mix(halves[:, 1] - turn)) % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            words = -(-SPREAD * len(rest) // 64)
            place = cls._place(rest, len(levels), words)
            alone = np.bincount(place.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[place.astype(np.int64)]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; any number or -1 for keys that it was not built from."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (row, before) in enumerate(zip(self.levels, self.before)):
            words = row.view(np.uint64)
            place = self._place(keys[left], level, len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            out[left[here]] = before[word[here]] + below
            left = left[~here]
        return out


class Index:
    """One shard: which lines are repeated, and the largest id that holds each."""

    def __init__(self, levels: list[bytes], prints: bytes, counts: bytes, last: bytes):
        self.hash = PerfectHash([np.frombuffer(x, dtype=np.uint8) for x in levels])
        self.prints = np.frombuffer(prints, dtype=np.int64)
        self.counts = np.frombuffer(counts, dtype=np.int32)
        self.last = np.frombuffer(last, dtype=np.int64)

    @staticmethod
    def pack(h: np.ndarray, n: np.ndarray, last: np.ndarray) -> dict:
        made = PerfectHash.build(h)
        order = np.empty(len(h), dtype=np.int64)
        order[made.index(h)] = np.arange(len(h))
        return {
            "levels": [x.tobytes() for x in made.levels],
            "prints": h[order, 1].tobytes(),
            # Counts tell only how common a line is; they need no more than 31 bits.
            "counts": np.minimum(n[order], (1 << 31) - 1).astype(np.int32).tobytes(),
            "last": last[order].tobytes(),
        }

    def dropped(self, h: np.ndarray, doc: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether each line (hash, document) goes: it is repeated, and in a later one."""
        if not len(self.prints):
            return np.zeros(len(h), dtype=bool)
        at = self.hash.index(h)
        at = np.where((at >= 0) & (self.prints[at] == h[:, 1]), at, -1)
        return (at >= 0) & (self.counts[at] >= min_docs) & (doc < self.last[at])


def line_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row for each shard that has lines: shard, levels, prints, counts, last."""

    def build(rows):
        h = np.ascontiguousarray(np.stack([rows.column(c).to_numpy() for c in ("h1", "h2")], axis=1))
        made = Index.pack(h, rows.column("n").to_numpy(), rows.column("last").to_numpy())
        row = {"shard": [rows.column("shard")[0].as_py()]} | {k: [v] for k, v in made.items()}
        kinds = [pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(row.values(), kinds)], names=list(row))

    dealt = counts.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        build, "shard long, levels array<binary>, prints binary, counts binary, last binary"
    )


def _keep(text: bytes, dropped: set[int]) -> bytes:
    if not dropped:
        return text
    return b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in dropped)


def _appended(batch: pa.RecordBatch, drops: list[set[int]]) -> pa.RecordBatch:
    texts = plain_bytes(batch)
    return pa.RecordBatch.from_arrays(
        [
            *batch.columns,
            pa.array([x.count(b"\n") + 1 for x in texts], pa.int64()),
            pa.array([len(x) for x in drops], pa.int64()),
            pa.array([_keep(x, d).decode() for x, d in zip(texts, drops)], pa.string()),
        ],
        names=[*batch.schema.names, "n_lines", "n_dropped", "kept"],
    )


def _probe_all(index, shards: int, min_chars: int, min_docs: int):
    """mapInArrow function: documents probe a broadcast index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {r[0]: Index(*r[1:]) for r in index.value}
        for batch in batches:
            keys, row, line = [], [], []
            for i, text in enumerate(plain_bytes(batch)):
                for j, key in enumerate(line_keys(text, min_chars)):
                    if key is not None:
                        keys.append(key)
                        row.append(i)
                        line.append(j)
            h, row, line = _halves(keys), np.array(row, dtype=np.int64), np.array(line, dtype=np.int64)
            doc = np.array(_ids(batch), dtype=np.int64)[row]
            drops: list[set[int]] = [set() for _ in range(batch.num_rows)]
            shard = h[:, 0] % shards
            for s in np.unique(shard):
                if s in parts:
                    mine = np.flatnonzero(shard == s)
                    mine = mine[parts[s].dropped(h[mine], doc[mine], min_docs)]
                    for i, j in zip(row[mine], line[mine]):
                        drops[i].add(int(j))
            yield _appended(batch, drops)

    return run


def _routed(rows: DataFrame, index: DataFrame, shards: int, salts: int, min_chars: int, min_docs: int) -> DataFrame:
    """(uid, lines) to drop, found where each shard of the index is."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Line hashes packed by shard; a batch goes to one salt of each shard."""
        for batch in batches:
            uids, out = batch.column("uid").to_pylist(), {}
            for uid, doc, text in zip(uids, _ids(batch), plain_bytes(batch)):
                for j, key in enumerate(line_keys(text, min_chars)):
                    if key is not None:
                        s = int.from_bytes(key[:8], "little", signed=True) % shards
                        out.setdefault((s, uid % salts), []).append((uid, doc, j, key))
            columns = [[], [], [], [], [], []]
            for (s, salt), found in out.items():
                uid, doc, j, keys = zip(*found)
                packed = [np.array(x, dtype=np.int64).tobytes() for x in (uid, doc, j)]
                for c, v in zip(columns, (s, salt, *packed, b"".join(keys))):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "salt", "uid", "doc", "line", "keys"]
            )

    def probe(left, right):
        part = [Index(*[r[c] for c in ("levels", "prints", "counts", "last")]) for r in right.to_pylist()]
        uids, lines = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for r in left.to_pylist() if part else []:
            uid, doc, line = (np.frombuffer(r[c], dtype=np.int64) for c in ("uid", "doc", "line"))
            gone = part[0].dropped(_halves([r["keys"]]), doc, min_docs)
            uids.append(uid[gone])
            lines.append(line[gone])
        return pa.table([np.concatenate(uids), np.concatenate(lines)], names=["uid", "line"])

    lines = rows.select("uid", "doc_id", "text").mapInArrow(
        emit, "shard long, salt long, uid binary, doc binary, line binary, keys binary"
    )
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    gone = lines.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(probe, "uid long, line long")
    return gone.groupBy("uid").agg(F.collect_list("line").alias("lines"))


def without_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, limit: int = BROADCAST_BYTES,
    shard_lines: int = SHARD_LINES,
) -> DataFrame:
    """Add n_lines, n_dropped and ``kept`` to rows with doc_id (long) and text.

    Lines end at \\n; a null or empty text is one empty line. Lines of ``min_chars`` code
    points or more (without outer white space, A-Z as a-z) that are in ``min_docs`` rows or
    more go, but for the row with the largest id that has them; rows that share this id
    keep theirs. A null id is below all others. Other lines stay, joined by \\n. Texts are
    read whole; ``docs`` must not have the three new columns.
    """
    spark = docs.sparkSession
    counts = stored(line_counts(docs, min_chars).where(F.col("n") >= min_docs), "lines")
    total = counts.count()
    shards = max(1, -(-total // shard_lines))
    index = stored(line_index(counts, shards), "line-index")
    size = F.octet_length("prints") + F.octet_length("counts") + F.octet_length("last")
    size = index.agg(F.sum(size)).head()[0] or 0
    kind = T.StructType(
        [*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
    )
    if size <= limit:
        rows = [(r.shard, [bytes(x) for x in r.levels], bytes(r.prints), bytes(r.counts), bytes(r["last"])) for r in index.collect()]
        sent = spark.sparkContext.broadcast(rows)
        return docs.mapInArrow(_probe_all(sent, shards, min_chars, min_docs), kind)

    names = docs.columns
    rows = stored(docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), F.monotonically_increasing_id().alias("uid")), "documents")
    plain = rows.select("uid", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    n_docs = rows.count()
    salts = max(1, n_docs // shard_lines)
    gone = _routed(plain, index, shards, salts, min_chars, min_docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = [set(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield _appended(pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]), drops)

    back = rows.join(gone, "uid", "left").select(*[F.col("doc").getField(c).alias(c) for c in names], "lines")
    return back.mapInArrow(cut, kind)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of every document, how many are dropped, and the sha256 of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = without_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM ln),
rep AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id < r.last, false) AS gone FROM k LEFT JOIN rep r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
