"""Whitened vectors from a covariance in which copies count by their number.

Equal vectors are grouped first, combined before their shuffle; everything that costs
arithmetic is done once for each distinct vector, weighted by its number of copies. The
weighted sums are exact whole numbers; the covariance is a matrix product of centred rows
in every task, added up by Spark; its eigenvectors are found where the fit is set up, from
a matrix whose size is that of one vector. The distinct vectors are whitened and joined
back to the rows; the join has two fresh shuffles, so adaptive execution can split the
copies of one vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorfill.llm.common import discard, stored
from sensorfill.llm.topk import whole_numbers
from sensorfill.llm.vectors import by_length, column_sums, decimals, largest

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
_CELLS = "dim int, cell int, value double"


def shifted_numbers(vector: Column) -> Column:
    """floor(SCALE * x) + SHIFT of each component; null as in ``whole_numbers``."""
    top = (1 << 63) - 1 - SHIFT
    return F.transform(
        whole_numbers(vector, SCALE),
        lambda v: F.when(v > top, F.lit((1 << 63) - 1)).otherwise(v + SHIFT),
    )


@dataclass(frozen=True)
class Centre:
    """Exact sums of the fitted vectors of one length."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, rounded once: the whole part is taken off exactly."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        if max(largest(x), max(map(abs, whole), default=0)) < 2.0**61:
            return (x - np.array(whole, dtype=np.int64)).astype(float) - rest
        return x.astype(float) - np.array(whole, dtype=float) - rest

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum of (n x - sums)^2 of each row, exact; the largest long if it is beyond.

        Computed modulo 2^64, which is exact wherever the result fits a long.
        """
        wrap = np.array([s % (1 << 64) for s in self.sums], dtype=np.uint64)
        d = x.astype(np.uint64) * np.uint64(self.n) - wrap
        out = (d * d).sum(axis=1, dtype=np.uint64).astype(np.int64)
        near = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        top = (1 << 63) - 1
        out[near > 2.0**63 * (1 + 1e-6)] = top
        for i in np.flatnonzero(np.abs(near / 2.0**63 - 1) <= 1e-6):
            out[i] = min(top, sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums)))
        return out


@dataclass(frozen=True)
class Fit:
    """Components of the vectors of one length, by falling eigenvalue."""

    centre: Centre
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.centred(x) @ self.axes) / np.sqrt(self.values)


def _sums(batches):
    for batch in batches:
        weight = batch.column("w").to_numpy()
        for dim, rows, x in by_length(batch.column("x")):
            sums = column_sums(weight[rows], x)
            yield pa.record_batch(
                {
                    "dim": pa.array([dim] * (dim + 1), pa.int32()),
                    "cell": pa.array(range(-1, dim), pa.int32()),
                    "value": decimals([int(weight[rows].sum()), *sums]),
                }
            )


def centres(distinct: DataFrame) -> dict[int, Centre]:
    """The sums by vector length; a number for each component reaches the driver."""
    found = distinct.mapInArrow(_sums, "dim int, cell int, value decimal(38,0)")
    rows = found.groupBy("dim", "cell").agg(F.sum("value").alias("value")).collect()
    cells = {(r["dim"], r["cell"]): int(r["value"]) for r in rows}
    return {
        dim: Centre(n, [cells[dim, j] for j in range(dim)])
        for (dim, j), n in sorted(cells.items())
        if j == -1 and dim
    }


def _products(column: str, centred):
    """mapInArrow function: one matrix of weighted products a task and vector length."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column("w").to_numpy().astype(float)
            dims = batch.column("dim").to_numpy()
            for size, rows, x in by_length(batch.column(column)):
                for dim in np.unique(dims[rows]) if size else []:
                    here = dims[rows] == dim
                    c = centred(int(dim), x[here])
                    product = (c * weight[rows[here]][:, None]).T @ c
                    totals[int(dim)] = totals.get(int(dim), 0.0) + product
        for dim, total in totals.items():
            yield pa.record_batch(
                {
                    "dim": pa.array([dim] * total.size, pa.int32()),
                    "cell": pa.array(range(total.size), pa.int32()),
                    "value": pa.array(total.ravel()),
                }
            )

    return run


def _matrices(distinct: DataFrame, column: str, centred, n: dict[int, int]) -> dict[int, np.ndarray]:
    """The covariance by vector length, divisor n; one matrix each reaches the driver."""
    cells = distinct.mapInArrow(_products(column, centred), _CELLS)
    out: dict[int, dict[int, float]] = {}
    for r in cells.groupBy("dim", "cell").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["dim"], {})[r["cell"]] = r["value"]
    return {
        dim: np.array([found[i] for i in range(len(found))]).reshape(int(len(found) ** 0.5), -1) / n[dim]
        for dim, found in out.items()
    }


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Fit (x, w, dim), by vector length. Directions without spread are no components."""
    sums = centres(distinct)
    found = _matrices(distinct, "x", lambda dim, x: sums[dim].centred(x), {d: c.n for d, c in sums.items()})
    fits = {}
    for dim, matrix in found.items():
        values, axes = np.linalg.eigh(matrix)
        values, axes = values[::-1], axes[:, ::-1]
        # Below this an eigenvalue is rounding alone.
        kept = values[:components] > max(values[0], 0.0) * dim * 2.0**-50
        values, axes = values[:components][kept], axes[:, :components][:, kept]
        # The entry that is largest, of several the first, is positive.
        top = np.argmax(np.abs(axes) > np.abs(axes).max(axis=0) * (1 - 1e-9), axis=0)
        axes = axes * np.sign(axes[top, np.arange(axes.shape[1])])
        fits[dim] = Fit(sums[dim], axes, values, float(np.trace(matrix)))
    return fits


def _whiten(fits: dict[int, Fit]):
    def run(batches):
        for batch in batches:
            z: list = [[]] * len(batch)
            deviation = np.zeros(len(batch), dtype=np.int64)
            for dim, rows, x in by_length(batch.column("x")):
                if dim in fits:
                    deviation[rows] = fits[dim].centre.deviation(x)
                    for row, values in zip(rows, fits[dim].whiten(x)):
                        z[row] = values
            yield pa.record_batch(
                {
                    **{c: batch.column(c) for c in ("x", "w", "dim")},
                    "deviation": pa.array(deviation),
                    "z": pa.array(z, pa.list_(pa.float64())),
                }
            )

    return run


def whiten(vectors: DataFrame, copies_count: bool = True, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row
    of (vec_id, x array<long>) and each of the first ``components`` components.

    The fit list has every row, or with ``copies_count`` false every distinct vector once;
    ``n`` is its length. Rows with a null vector are left out; those with a null id are
    not; a row that is there twice is returned twice. Vectors of different lengths are
    fitted apart. A direction in which the vectors do not differ is no component, so
    a table of equal vectors, of empty ones or of none gives no rows. A deviation beyond
    the longs is the largest long. Other columns are not read.
    """
    rows = vectors.select("vec_id", "x").where("x is not null")
    weight = F.count(F.lit(1)) if copies_count else F.first(F.lit(1).cast("long"))
    grouped = rows.groupBy("x").agg(weight.alias("w")).withColumn("dim", F.size("x"))
    distinct = stored(grouped, "distinct-vectors")
    fits = fit(distinct, components)
    n = {dim: f.centre.n for dim, f in fits.items()}
    schema = "x array<long>, w long, dim int, deviation long, z array<double>"
    white = stored(distinct.mapInArrow(_whiten(fits), schema), "whitened-vectors")
    discard(distinct)

    by_component = white.select("dim", "w", F.posexplode("z").alias("i", "z")).groupBy("dim", "i")
    means: dict[int, dict[int, float]] = {dim: {} for dim in fits}
    for r in by_component.agg(F.sum(F.col("w") * F.col("z")).alias("total")).collect():
        means[r["dim"]][r["i"]] = r["total"] / n[r["dim"]]
    at = {dim: np.array([m[i] for i in range(len(m))]) for dim, m in means.items()}
    spread = _matrices(white, "z", lambda dim, z: z - at[dim], n)
    facts = [
        (dim, i, f.centre.n, float(f.values[i] / f.trace), float(np.abs(spread[dim] - np.eye(len(f.values))).max()))
        for dim, f in fits.items()
        for i in range(len(f.values))
    ]
    # At most ``components`` rows for each vector length.
    facts = vectors.sparkSession.createDataFrame(
        facts, "dim int, i int, n long, explained double, identity_error double"
    )
    back = rows.join(white.select("x", "dim", "deviation", "z"), "x")
    long = back.select("vec_id", "dim", "deviation", F.posexplode("z").alias("i", "whitened"))
    return long.join(F.broadcast(facts), ["dim", "i"]).select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        "explained",
        "identity_error",
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Eight whitened components of every vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(rows.select("vec_id", shifted_numbers(F.col("embedding")).alias("x")))
