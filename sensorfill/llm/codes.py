"""Vectors as short codes: each part's nearest entry in a codebook of its own.

A round gives every part its nearest entry and moves the entries to the floor of the mean
of their parts. All arithmetic is on whole numbers, so the result depends on nothing but
the rows. To find the nearest entry, the coarse grid cell of a part is hashed and looked
up; the memo says which entries can be nearest anywhere in the cell's box, those whose
least distance to the box is not above the least of the largest distances. Only these are
evaluated exactly. The memo is kept for the time of a task. What a round adds up is a
number for each entry's component: the codebooks alone pass through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorfill.llm.common import discard, joined, mix, stored
from sensorfill.llm.topk import whole_numbers
from sensorfill.llm.vectors import by_length, column_sums, decimals, largest

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Low bits that a coarse cell leaves out: its box is 2^CELL_BITS wide.
CELL_BITS = 9
#: Cells that a task remembers for one codebook; further ones are worked out each time.
MEMO_CELLS = 1 << 17
_TOP = (1 << 63) - 1

#: The codebooks of each vector length: for each part its entries as rows.
Books = dict[int, list[np.ndarray]]


def part_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts begin and end; the first are one longer if they cannot be equal."""
    sizes = [length // parts + (i < length % parts) for i in range(parts)]
    ends = np.cumsum(sizes).tolist()
    return [(end - size, end) for size, end in zip(sizes, ends)]


class Codebook:
    """One part's entries, with the memo of cells."""

    def __init__(self, entries: np.ndarray, cell_bits: int = CELL_BITS):
        self.entries, self.bits = entries, cell_bits
        self.size = largest(entries)
        width = entries.shape[1]
        self.factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        self.keys = np.zeros(0, dtype=np.uint64)
        self.cells = np.zeros((0, width), dtype=np.int64)
        self.masks = np.zeros((0, len(entries)), dtype=bool)
        #: Exact distances that were computed, and those of a search of all entries.
        self.evaluated = self.all_pairs = 0

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """Which entries can be nearest in each cell's box."""
        low = (cells << self.bits)[:, None, :]
        high = low + (1 << self.bits) - 1
        e = self.entries[None]
        gap = np.maximum(np.maximum(low - e, e - high), 0)
        far = np.maximum(np.abs(e - low), np.abs(e - high))
        least, most = (gap * gap).sum(axis=2), (far * far).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def _masks(self, x: np.ndarray) -> np.ndarray:
        cells = x >> self.bits
        keys = mix((cells.astype(np.uint64) * self.factors).sum(axis=1, dtype=np.uint64))
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        mine = cells[first]
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            known = (self.keys[near] == distinct) & (self.cells[near] == mine).all(axis=1)
        masks = np.empty((len(distinct), len(self.entries)), dtype=bool)
        if known.any():
            masks[known] = self.masks[at[known]]
        new = np.flatnonzero(~known)
        for some in np.array_split(new, max(1, len(new) // 4096)):
            masks[some] = self._candidates(mine[some])
        taken = np.isin(distinct[new], self.keys)
        new = new[~taken][: max(0, MEMO_CELLS - len(self.keys))]
        if len(new):
            keys_all = np.concatenate((self.keys, distinct[new]))
            order = np.argsort(keys_all)
            self.keys = keys_all[order]
            self.cells = np.concatenate((self.cells, mine[new]))[order]
            self.masks = np.concatenate((self.masks, masks[new]))[order]
        out = masks[which]
        # Two cells of one batch with one hash: the second tries every entry.
        out[(cells != mine[which]).any(axis=1)] = True
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower one, and the squared distance."""
        exact = 4.0 * max(largest(x), self.size) ** 2 * max(1, x.shape[1]) < 2.0**62
        entries = self.entries if exact else self.entries.astype(object)
        if not exact:
            x = x.astype(object)
        masks = self._masks(x) if exact and x.shape[1] else np.ones((len(x), len(entries)), dtype=bool)
        best = np.full(len(x), -1, dtype=np.int64)
        least = np.zeros(len(x), dtype=x.dtype)
        for i, entry in enumerate(entries):
            rows = np.flatnonzero(masks[:, i])
            d = x[rows] - entry
            d = (d * d).sum(axis=1)
            better = (best[rows] < 0) | (d < least[rows])
            best[rows[better]], least[rows[better]] = i, d[better]
        self.evaluated += int(masks.sum())
        self.all_pairs += masks.size
        return best, least


def _assigned(books: Books, batch: pa.RecordBatch, memo: dict):
    """Yield (length, rows, part number, part, its codes, its squared distances)."""
    for length, rows, x in by_length(batch.column("x")):
        for part, (start, end) in enumerate(part_bounds(length, len(books[length]))):
            book = memo.setdefault((length, part), Codebook(books[length][part]))
            here = x[:, start:end]
            yield (length, rows, part, here, *book.nearest(here))


_SUMS = "dim int, part int, entry int, place int, total decimal(38,0)"


def _round(books: Books):
    """mapInArrow function: the sums of each entry's parts, and at place -1 their number."""

    def run(batches):
        memo, totals = {}, {}
        for batch in batches:
            for length, _, part, x, code, _ in _assigned(books, batch, memo):
                for entry in np.unique(code):
                    mine = x[code == entry]
                    one = np.ones(len(mine), dtype=np.int64)
                    key = length, part, int(entry)
                    new = [len(mine), *column_sums(one, mine)]
                    totals[key] = [a + b for a, b in zip(totals.get(key, [0] * len(new)), new)]
        rows = [(*key, place - 1, v) for key, values in totals.items() for place, v in enumerate(values)]
        columns = list(zip(*rows)) or [[]] * 5
        ints = [pa.array(c, pa.int32()) for c in columns[:4]]
        yield pa.record_batch([*ints, decimals(columns[4])], ["dim", "part", "entry", "place", "total"])

    return run


def start_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Books:
    """The parts of the vectors with the smallest ids, of each vector length."""
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "x")
    ranked = vectors.withColumn("dim", F.size("x")).withColumn("rank", F.row_number().over(order))
    first: dict[int, list] = {}
    # ``entries`` rows for each vector length.
    for r in ranked.where(F.col("rank") <= entries).orderBy("dim", "rank").collect():
        first.setdefault(r["dim"], []).append(r["x"])
    return {
        dim: [np.array(rows, dtype=np.int64).reshape(len(rows), dim)[:, a:b] for a, b in part_bounds(dim, parts)]
        for dim, rows in first.items()
    }


def next_books(vectors: DataFrame, books: Books) -> Books:
    """The codebooks after one round."""
    rows = vectors.select("x").mapInArrow(_round(books), _SUMS)
    found = rows.groupBy("dim", "part", "entry", "place").agg(F.sum("total").alias("total")).collect()
    totals = {(r["dim"], r["part"], r["entry"], r["place"]): int(r["total"]) for r in found}
    out = {dim: [b.copy() for b in parts] for dim, parts in books.items()}
    for (dim, part, entry, place), total in totals.items():
        if place >= 0:
            out[dim][part][entry, place] = total // totals[dim, part, entry, -1]
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def _encode(books: Books):
    """mapInArrow function: the code and the error of every vector."""

    def run(batches):
        memo: dict = {}
        digests = {dim: books_digest(b) for dim, b in books.items()}
        for batch in batches:
            n = len(batch)
            codes, errors, digest = [""] * n, [0] * n, [None] * n
            for length, rows, _, _, code, distance in _assigned(books, batch, memo):
                for row, c, d in zip(rows.tolist(), code.tolist(), distance.tolist()):
                    codes[row] += f"{c:02x}"
                    errors[row] += d
                    digest[row] = digests[length]
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id"),
                    "label": batch.column("label"),
                    "code": pa.array(codes, pa.string()),
                    "error": pa.array([min(e, _TOP) for e in errors], pa.int64()),
                    "codebooks_sha256": pa.array(digest, pa.string()),
                }
            )

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of
    (vec_id long, x array<long>, label int).

    Rows with a null vector are left out; a null id or label is a value like others, null
    ids last in the order of ids. A row that is there twice counts and is returned twice.
    Vectors of different lengths have codebooks of their own; those whose length the parts
    do not divide have longer parts first. Fewer rows than entries give fewer entries, no
    rows none. A sum beyond the longs is the largest long. Other columns are not read.
    """
    rows = vectors.select("vec_id", "x", F.col("label").cast("int").alias("label"))
    rows = stored(rows.where("x is not null"), "vectors")
    books = start_books(rows, parts, entries)
    for _ in range(rounds):
        before, books = books, next_books(rows, books)
        if all(np.array_equal(a, b) for d in books for a, b in zip(books[d], before[d])):
            break  # further rounds would change nothing
    schema = "vec_id long, label int, code string, error long, codebooks_sha256 string"
    coded = stored(rows.mapInArrow(_encode(books), schema), "codes")
    discard(rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_TOP).cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.cast("long").alias("label_error"))
    out = joined(coded, stored(sums, "label-errors"), F.col("label").eqNullSafe(F.col("_label")), "inner", F.lit(16))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Eight two-digit codes for every vector, after six rounds."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = whole_numbers(F.col("embedding"), SCALE)
    return compress(rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), "label"))


def op11_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same as a chain of tables, one for each round."""
    ctes = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""w AS MATERIALIZED (
  SELECT r, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS y FROM v, range({parts}) t(p))""",
        f"b0 AS MATERIALIZED (SELECT p, (r - 1)::INTEGER AS e, y AS c FROM w WHERE r <= {entries})",
    ]

    def nearest(i: int) -> str:
        dist = "list_sum(list_transform(list_zip(w.y, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return (
            f"a{i} AS MATERIALIZED (SELECT r, w.p, any_value(y) AS y, min_by(e, (d, e)) AS e, min(d) AS d FROM "
            f"(SELECT w.r, w.p, w.y, b.e, {dist} AS d FROM w JOIN b{i} b ON b.p = w.p) w GROUP BY r, w.p)"
        )

    for i in range(rounds):
        ctes += [
            nearest(i),
            f"""s{i} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY j) AS c FROM (
    SELECT p, e, j, floor(sum(y[j]) / count(*))::BIGINT AS m
    FROM (SELECT p, e, y, unnest(range(1, len(y) + 1)) AS j FROM a{i}) GROUP BY p, e, j) GROUP BY p, e)""",
            f"""b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s ON s.p = b.p AND s.e = b.e)""",
        ]
    ctes.append(nearest(rounds))
    ctes.append(
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})"
    )
    ctes.append(
        f"""f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
FROM a{rounds} GROUP BY r)"""
    )
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, "
        "sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 "
        "FROM v JOIN f USING (r), h"
    )


OP11_SQL = op11_sql()
