"""Near copies by 64-bit fingerprints, found with covering locality-sensitive hashing.

``fingerprints`` turns texts into fingerprints, ``links`` finds links between
fingerprints that differ in few bits, ``components`` follows links to groups.

Covering masks: every bit gets a vector of r + 1 bits, and every non-zero vector v of
r + 1 bits a table, whose mask has the bits with an odd product with v. The vectors of
at most r differing bits span less than the whole space, so some v is orthogonal to
all of them: in its table the two fingerprints agree on every masked bit. So every pair
within the radius meets in one of 2^(r+1) - 1 tables, always, not only likely.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorfill.llm.common import discard, plain_bytes, stored
from sensorfill.operators.scale import as_lookup, lookup_join

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints compared in one task; larger buckets are cut into blocks of about this size.
BLOCK = 4096


def fingerprint(text: bytes, width: int = SHINGLE) -> bytes:
    """Eight bytes, big-endian: a bit is set if it is in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_digest(line, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: -width]]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])])
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), 1 << 16):  # bounds the memory for long texts
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(rows)).tobytes()


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint of each text as a long.

    A null or empty text has fingerprint zero. Texts are read whole.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(map(fingerprint, plain_bytes(batch, text)))
            fps = pa.array(np.frombuffer(found, dtype=">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, fps], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, schema)


def masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """The covering masks for 64 bits, as signed longs."""
    vectors = range(1, 1 << (radius + 1))
    of_bit = [list(vectors)[i % len(vectors)] for i in range(64)]
    random.Random(seed).shuffle(of_bit)
    out = []
    for v in vectors:
        mask = sum(1 << i for i in range(64) if (of_bit[i] & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _distance(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    # bitwise_count of a negative number would count the bits of its absolute value.
    return np.bitwise_count((a ^ b).view(np.uint64))


def _spanning(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints; no pair list is made."""
    left, right, rest = [], [], fps
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = _distance(rest, at) <= radius
            new = rest[near]
            if len(new):
                rest = rest[~near]
                left.append(new)
                right.append(np.full(len(new), at))
                reached.extend(new)
    if not left:
        return fps[:0], fps[:0]
    return np.concatenate(left), np.concatenate(right)


def _linker(tables: list[int], radius: int):
    """mapInArrow function: links of rows (fp, t, pair) sorted by bucket."""
    by_table = np.array(tables, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(fp, key, t, pair, last):
            """Links of all whole buckets; what may go on in the next batch is kept."""
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(t) != 0) | (np.diff(pair) != 0)) + 1
            ends = np.append(cut, len(fp))
            starts = np.append(0, cut)
            whole = len(ends) if last else len(ends) - 1
            kept = starts[whole] if whole < len(starts) else len(fp)
            size = ends[:whole] - starts[:whole]
            two = starts[:whole][size == 2]
            two = two[_distance(fp[two], fp[two + 1]) <= radius]
            a, b = [fp[two + 1]], [fp[two]]
            for s, e in zip(starts[:whole][size > 2], ends[:whole][size > 2]):
                x, y = _spanning(fp[s:e], radius)
                a.append(x)
                b.append(y)
            return np.concatenate(a), np.concatenate(b), kept

        rest = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            t = batch.column("t").to_numpy(zero_copy_only=False).astype(np.int64)
            pair = batch.column("pair").to_numpy(zero_copy_only=False)
            new = [fp, fp & by_table[t], t, pair]
            rows = [np.concatenate(x) for x in zip(rest, new)]
            if not len(rows[0]):
                continue
            a, b, kept = forest(*rows, last=False)
            rest = [x[kept:] for x in rows]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if len(rest[0]):
            a, b, _ = forest(*rest, last=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among the distinct longs of column ``fp`` that connect whatever
    differs in at most ``radius`` bits: a spanning forest of each bucket, not all pairs.

    A bucket of more than ``block`` fingerprints is cut into blocks, and every two of
    its blocks meet in a task of their own, so no task holds a large bucket whole.
    """
    tables = masks(radius)
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, tables)), F.col("t") + 1))
    each = fps.select(
        "fp", F.explode(F.array(*[F.lit(i) for i in range(len(tables))])).alias("t")
    ).withColumn("key", key)
    large = (
        each.groupBy("t", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > block)
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .drop("n")
    )
    cut = lookup_join(each, large, ["t", "key"], "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine),
    )
    pair = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(met))
    dealt = cut.select("fp", "t", "key", pair.alias("pair"))
    return (
        dealt.repartition("t", "key", "pair")
        .sortWithinPartitions("t", "key", "pair", "fp")
        .select("fp", "t", "pair")
        .mapInArrow(_linker(tables, radius), "a long, b long")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Alternates two star contractions until nothing changes: every node's larger
    neighbours, then its smaller ones, are hung on its smallest neighbour. Only minima
    are grouped; they are written before they are joined back, so that both sides of the
    join are freshly shuffled and adaptive execution can split a node with very many links.
    """
    now = stored(edges.where("a <> b").distinct(), "links")
    before = None
    while True:
        seen = now.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).head()
        if tuple(seen) == before:
            break
        before = tuple(seen)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stored(larger.where("a <> b").distinct(), "links")
        lower = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        smaller = down.join(lower, "a")
        smaller = smaller.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lower.select("a", F.col("m").alias("b"))
        )
        after = stored(smaller.where("a <> b").distinct(), "links")
        for done in (now, least, down, lower):
            discard(done)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest id it reaches),
    root (a fingerprint that names the group).

    Documents are linked if their fingerprints differ in at most ``RADIUS`` bits, and
    grouped by whatever links reach. Null and empty texts have fingerprint zero and are
    linked like any other. Null ids are never the smallest; a group of null ids alone
    has a null component. Repeated rows come back as often as they are there. Other
    columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = stored(with_fingerprint(rows).select("doc_id", "fp"), "fingerprints")
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(own.select("fp")))
    grouped = own.join(roots, own.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    grouped = stored(grouped, "grouped")
    # Written, so that its join is freshly shuffled on both sides.
    of_root = stored(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    of_fp = grouped.join(of_root, "root").select("fp", "root", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id", "root")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over all documents."""
    found = near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays, whole.

    It is the one with the smallest doc_id. Rows that repeat this doc_id with the same
    fingerprint count as one document, of which one row stays.
    """
    found = stored(near_copies(docs), "near-copies")
    rows_of_id = found.groupBy(F.col("doc_id").alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    chosen = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("doc_id").alias("_id"), F.min("fp").alias("_fp"))
        .join(rows_of_id, F.col("_id").eqNullSafe(F.col("_i")))
        .select("_id", "_fp", ((F.col("_n") == 1) & F.col("_id").isNotNull()).alias("_single"))
    )
    chosen = stored(chosen, "chosen")
    single = as_lookup(chosen.where("_single").select("_id"))
    several = as_lookup(chosen.where("not _single").select("_id", "_fp"))
    once = docs.join(single, docs["doc_id"] == single["_id"], "left_semi")
    # An id with several rows needs the fingerprint too, to tell them apart.
    many = with_fingerprint(
        docs.join(several, docs["doc_id"].eqNullSafe(several["_id"]), "left_semi"), name="_fp0"
    )
    same = many["doc_id"].eqNullSafe(several["_id"]) & (many["_fp0"] == several["_fp"])
    many = many.join(several, same, "left_semi").dropDuplicates(["doc_id", "_fp0"])
    return once.unionByName(many.drop("_fp0"))
