"""What several operators share: stored tables, word splitting in numpy, offsets.

Words are found on the raw UTF-8 bytes of a whole Arrow batch at once and hashed eight
bytes a step, all words together, so hardly a word becomes a Python object. A word's hash
is no polynomial in its bytes: those modulo 2^64 agree on words that are easily made. A
sequence of words has a polynomial in the hashes of its words, from one running sum.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sensorfill.operators.scale import BROADCAST_BYTES, use_checkpoint_dir

#: Bytes of text that one vectorised step works on; longer batches are cut.
CHUNK_BYTES = 4 << 20

#: Words of more bytes are hashed one by one.
LONG_WORD = 256

ASCII_SPACE = b" \t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def byte_class(chars: bytes, high: bool, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte as hashed) for each of the 256 bytes.

    ``chars`` are the ASCII word bytes, ``high`` says whether bytes from 128 on belong
    to words, ``lower`` maps A-Z to a-z.
    """
    as_read = np.arange(256, dtype=np.uint8)
    if lower:
        as_read[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[list(chars)] = True
    word[128:] = high
    return word[as_read], as_read


#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM = byte_class(bytes(range(48, 58)) + bytes(range(97, 123)), high=True, lower=True)
#: Words of ``[^\x20\x09-\x0D]+``, unchanged.
SPACED = byte_class(bytes(set(range(128)) - set(ASCII_SPACE)), high=True, lower=False)

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of stretches of a sequence of 64-bit numbers, from one running sum."""

    def __init__(self, seed: int):
        base = (int(_BASE) * (2 * seed + 1)) % (1 << 64) | 1
        self.base, self.inverse = np.uint64(base), _inverse(np.uint64(base))
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.seed = seed

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)

    def stretches(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each ``values[start:end]``; equal stretches have equal hashes."""
        self._grow(len(values))
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        length = (end - start).astype(np.uint64)
        return mix((total[end] - total[start]) * self.down[start] + length)


    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each word ``data[start:end]`` of bytes; equal words have equal hashes."""
        length = end - start
        with np.errstate(over="ignore"):
            h = mix(length.astype(np.uint64) * _BASE + np.uint64(self.seed))
        if not len(h):
            return h
        # The eight bytes from each place on, as one number.
        padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        long = length > LONG_WORD
        rows, at, left = np.flatnonzero(~long), start[~long], length[~long]
        while len(rows):
            unused = (8 * np.maximum(8 - left, 0)).astype(np.uint64)
            block = (eight[at] << unused) >> unused
            h[rows] = mix((h[rows] ^ block) * _BASE + np.uint64(self.seed))
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(long):
            h[i] = xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), self.seed)
        return h


class Words:
    """The words of some texts: where each starts and ends, its text, its hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind, hasher: Hasher):
        """``data``: bytes of all texts; ``bounds``: n + 1 offsets of the n texts."""
        is_word, as_read = kind
        inside = is_word[data]
        # A step from outside to inside starts a word; so does the start of a text.
        first = np.zeros(len(data), dtype=bool)
        first[bounds[:-1][bounds[:-1] < len(data)]] = True
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (first | ~before))
        after = np.zeros(len(data), dtype=bool)
        if len(data):
            after[:-1] = inside[1:] & ~first[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Words of text i are ``first_word[i] : first_word[i + 1]``.
        self.first_word = np.searchsorted(self.start, bounds)
        self.hash = hasher.words(as_read[data], self.start, self.end)


def text_chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, bytes, offsets), about ``size`` bytes at a time.

    A null text is an empty one. No text is cut.
    """
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(at, at[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop, raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def plain_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as bytes, null as empty."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


def start_offsets(
    df: DataFrame, group: list[str], order: Column, weight: str, name: str, span: int = 4096
) -> DataFrame:
    """Add the sum of ``weight`` over the rows before each row of its group.

    ``order`` is a 63-bit hash, not negative: rows fall into stretches of about ``span``
    rows by its high bits, and within a stretch follow it. One task sorts one stretch;
    the table of stretches has a row for ``span`` rows. Rows that tie are equal in all
    other columns or get one of their places each.
    """
    rows = df.withColumn("_order", order)
    if group:
        sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    else:
        sizes = rows.agg(F.count(F.lit(1)).alias("_rows"))
    # The number of stretches is one for all groups: enough for the largest.
    most = sizes.agg(F.max("_rows")).head()[0] or 0
    bits = max(0, (most // span).bit_length())
    cut = [*group, "_stretch"]
    rows = rows.withColumn("_stretch", F.shiftright("_order", 63 - bits) if bits else F.lit(0))
    earlier = Window.partitionBy(*group).orderBy("_stretch")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*cut).agg(F.sum(weight).alias("_n"))
    totals = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in cut],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*cut).orderBy("_order", *df.columns)
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cut]
    joined = inner.join(totals, on=same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def joined(df: DataFrame, lookup: DataFrame, on: str | list[str] | Column, how: str, row_bytes: Column) -> DataFrame:
    """Join to a stored table, broadcast if the sum of ``row_bytes`` shows that it is small.

    Beyond ``BROADCAST_BYTES`` it is an ordinary shuffle join.
    """
    size = lookup.agg(F.sum(row_bytes)).head()[0] or 0
    return df.join(F.broadcast(lookup) if size <= BROADCAST_BYTES else lookup, on, how)
