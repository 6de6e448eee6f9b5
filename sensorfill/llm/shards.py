"""Token ids in training order, as fixed-stride shards.

Texts become token ids and are cut into sequences of ``seq_len`` ids, the last one of a
document padded. A keyed Feistel network over the numbers of the sequences, walked until
it falls among them, gives every sequence its own slot. Range partitions hold consecutive
slots in order and become shards of ``per_shard`` records of one size, so that slot s is
record s % per_shard of shard s // per_shard: a reader goes through them in sequence and
resumes anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorfill.llm.common import start_offsets, stored
from sensorfill.operators.scale import default_tasks, lookup_join

#: Merge ranks of the tokenizer; the next id after them ends a document and pads.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SEQ_LEN = 512
PER_SHARD = 1024
KEY = 0x5EED
ROUNDS = 6
#: Bytes of shards that one task writes, about.
TASK_BYTES = 64 << 20


def encoder(ranks: str = RANKS):
    """(text -> token ids, the id that ends a document) for a file of merge ranks."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    made = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return made.encode_ordinary, max(table.values()) + 1


def with_tokens(docs: DataFrame, ranks: str = RANKS, seq_len: int = SEQ_LEN) -> DataFrame:
    """uid, doc_id, place, n_tokens, n_seqs, tokens (16-bit little-endian ids, or 32-bit
    where the vocabulary needs it) of rows (uid, doc_id, place, text).

    Every document ends with one end id, so an empty or null text is a sequence too.
    """
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks)
        kind = "<u2" if end < 1 << 16 else "<u4"
        for batch in batches:
            size, packed = np.zeros(batch.num_rows, dtype=np.int64), []
            for i, text in enumerate(batch.column("text")):
                # Packed at once: a batch of ids as Python numbers would be very large.
                ids = encode(text.as_py() or "")
                ids.append(end)
                size[i] = len(ids)
                packed.append(np.array(ids, dtype=kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(size), pa.array(-(-size // seq_len)), pa.array(packed, pa.binary())],
                names=["uid", "doc_id", "place", "n_tokens", "n_seqs", "tokens"],
            )

    return docs.select("uid", "doc_id", "place", "text").mapInArrow(
        run, f"uid long, doc_id {id_type}, place long, n_tokens long, n_seqs long, tokens binary"
    )


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The places of 0 <= ``index`` < n under a keyed permutation of 0 .. n - 1.

    A balanced Feistel network permutes the numbers of the next even number of bits;
    places from n on are walked through it again until they fall below n.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)

    def shuffled(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for i in range(ROUNDS):
            h = (right + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & low)
        return (left << half) | right

    out = shuffled(index.astype(np.uint64))
    while len(over := np.flatnonzero(out >= np.uint64(n))):
        out[over] = shuffled(out[over])
    return out.astype(np.int64)


def _sequences(n: int, key: int, seq_len: int, pad: int, kind: str):
    """mapInArrow function: a document's tokens to its sequences with their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = seq_len * np.dtype(kind).itemsize
        fill = np.full(seq_len, pad, dtype=kind).tobytes()
        for batch in batches:
            # A few documents at a time bound the memory.
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                count = rows.column("n_seqs").to_numpy()
                first = np.repeat(rows.column("first").to_numpy(), count)
                part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                size = np.repeat(rows.column("n_tokens").to_numpy(), count) - part * seq_len
                texts = []
                for tokens, k in zip(rows.column("tokens").to_pylist(), count):
                    whole = tokens + fill[: k * record - len(tokens)]
                    texts += [whole[i * record : (i + 1) * record] for i in range(k)]
                of_row = pa.array(np.repeat(np.arange(len(count)), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(feistel(first + part, n, key)),
                        rows.column("doc_id").take(of_row),
                        pa.array(part.astype(np.int32)),
                        pa.array(np.minimum(size, seq_len).astype(np.int32)),
                        pa.array(texts, pa.binary()),
                    ],
                    names=["slot", "doc_id", "part", "n_tokens", "tokens"],
                )

    return run


def _pack(per_shard: int):
    """mapInArrow function: sequences sorted by slot to one row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: pa.Table) -> pa.RecordBatch:
            slots = rows.column("slot").to_numpy()
            if not (np.diff(slots) == 1).all():
                raise ValueError("slots of a shard must follow one another")
            one = lambda x, t: pa.array([x], t)
            lists = [pa.array([rows.column(c).combine_chunks()], pa.list_(rows.schema.field(c).type)) for c in ("doc_id", "part", "n_tokens")]
            return pa.RecordBatch.from_arrays(
                [
                    one(int(slots[0]) // per_shard, pa.int64()),
                    one(int(slots[0]), pa.int64()),
                    one(len(slots), pa.int64()),
                    *lists,
                    one(b"".join(rows.column("tokens").to_pylist()), pa.binary()),
                ],
                names=["shard", "first_slot", "n_slots", "doc_ids", "parts", "n_tokens", "tokens"],
            )

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None else pa.concat_tables([rest, rows])
            while rest.num_rows and rest.column("slot")[-1].as_py() // per_shard > rest.column("slot")[0].as_py() // per_shard:
                size = per_shard - rest.column("slot")[0].as_py() % per_shard
                yield shard(rest.slice(0, size))
                rest = rest.slice(size)
        if rest is not None and rest.num_rows:
            yield shard(rest)

    return run


def training_shards(
    docs: DataFrame, ranks: str = RANKS, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY,
) -> DataFrame:
    """One row for each shard: shard, first_slot, n_slots, the doc_ids, parts and numbers
    of real tokens of its records in order, and ``tokens``, its n_slots records of
    ``seq_len`` ids each.

    Slots depend on the key and the rows (doc_id, text) alone; rows that are alike are
    interchangeable. Null texts are empty, null ids are kept. An empty table has no shard.
    Partitions are in slot order.
    """
    spark = docs.sparkSession
    # By id and text: rows of one id, or without any, are spread and ordered by their texts.
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", place.alias("place"), "text")
    tokens = stored(with_tokens(rows, ranks, seq_len), "tokens")
    end = sum(1 for line in open(ranks, "rb") if line.strip())
    kind = "<u2" if end < 1 << 16 else "<u4"
    n = tokens.agg(F.sum("n_seqs")).head()[0] or 0
    first = start_offsets(tokens.select("doc_id", "n_tokens", "n_seqs", "uid", "place"), [], F.col("place"), "n_seqs", "first")
    numbered = lookup_join(tokens, first.select("uid", "first"), "uid")
    id_type = dict(docs.dtypes)["doc_id"]
    sequences = numbered.mapInArrow(
        _sequences(n, key, seq_len, end, kind),
        f"slot long, doc_id {id_type}, part int, n_tokens int, tokens binary",
    )
    shards = max(1, -(-n // per_shard))
    record = seq_len * np.dtype(kind).itemsize
    parts = min(shards, max(-(-n * record // TASK_BYTES), default_tasks(spark)))
    place = F.floor(F.floor(F.col("slot") / per_shard) * parts / shards).cast("int")
    return (
        sequences.repartitionById(parts, place)
        .sortWithinPartitions("slot")
        .mapInArrow(
            _pack(per_shard),
            "shard long, first_slot long, n_slots long, "
            f"doc_ids array<{id_type}>, parts array<int>, n_tokens array<int>, tokens binary",
        )
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shards as Parquet, each range partition a file in slot order."""
    training_shards(docs, **options).write.option("compression", "zstd").parquet(path)


def read_slots(spark, path: str, start: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, doc_id, part, n_tokens, tokens from ``start`` on. Only the shards from there
    on are read; the order is by slot within each file."""
    shards = spark.read.parquet(path).where(F.col("shard") >= start // per_shard)
    stride = F.floor(F.octet_length("tokens") / F.col("n_slots")).cast("int")
    at = F.explode(F.sequence(F.lit(0), (F.col("n_slots") - 1).cast("int"))).alias("i")
    each = shards.select("*", stride.alias("stride"), at)
    pick = lambda c: F.element_at(c, F.col("i") + 1)
    return each.select(
        (F.col("first_slot") + F.col("i")).alias("slot"),
        pick("doc_ids").alias("doc_id"),
        pick("parts").alias("part"),
        pick("n_tokens").alias("n_tokens"),
        F.substring("tokens", F.col("i") * F.col("stride") + 1, F.col("stride")).alias("tokens"),
    ).where(F.col("slot") >= start)


def op3_shards(spark, sf_dir: str) -> DataFrame:
    """The training shards of all documents."""
    return training_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
