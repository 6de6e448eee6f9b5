"""Building blocks that keep the jobs safe on large and skewed data.

* ``materialize`` writes a table to the shared checkpoint folder, so later steps
  neither recompute it nor depend on the executors that made it.
* ``written`` does the same by column, for tables read in part by several steps.
* ``as_lookup`` and ``lookup_join`` broadcast a table only after measuring it.
* ``running_sums`` and ``global_index`` number rows over a whole table by a range
  partitioned sort plus one offset per partition, never in a single task.
* ``running_number`` numbers rows inside groups of any size.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest lookup table that is sent whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024

# ``monotonically_increasing_id`` puts the partition number above this bit.
_PARTITION_BIT = 33


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; make one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is not None:
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sensorfill-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def default_tasks(spark: SparkSession) -> int:
    """Partitions for rows that are few but costly to work on."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and continue from there.

    Later steps read the columns they use alone, and their filters reach the files.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_measured(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize``, and the size of the table as seen while writing.

    Eight bytes a field plus the text. A task that is retried may be counted
    twice, so the size is never too small.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    size = F.count(F.lit(1)) * (8 * len(df.columns))
    for name in text:
        size = size + F.coalesce(F.sum(F.octet_length(name)), F.lit(0))
    seen = Observation()
    written = materialize(df.observe(seen, size.alias("bytes")))
    return written, seen.get["bytes"]


def as_lookup(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written, measured, and marked for broadcast if it is small enough.

    Beyond ``limit`` joins with it are ordinary shuffle joins, in which adaptive
    execution splits hot keys.
    """
    written, size = materialize_measured(df)
    return F.broadcast(written) if size <= limit else written


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a big table to a lookup table; small lookups spare it a shuffle."""
    return df.join(as_lookup(lookup, limit), [on] if isinstance(on, str) else list(on), how)


def _ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` range partitioned and sorted, written, with its row numbers as ``_row``."""
    return materialize(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))


def _part() -> Column:
    return F.shiftright("_row", _PARTITION_BIT).cast("int")


def _before(ordered: DataFrame, totals: Mapping[str, Column]) -> dict[str, Column]:
    """For each total, its sum over the partitions before a row's own.

    The totals are one number per partition of the sort, a few thousand on a large
    cluster, and come back as literals.
    """
    parts = ordered.rdd.getNumPartitions()
    if parts == 1:
        return {name: F.lit(0).cast("bigint") for name in totals}
    found = ordered.groupBy(_part().alias("_part")).agg(
        *[F.sum(c).alias(name) for name, c in totals.items()]
    )
    rows = {r["_part"]: r for r in found.collect()}
    out = {}
    for name in totals:
        sums = [rows[i][name] if i in rows else 0 for i in range(parts)]
        starts = list(itertools.accumulate(sums, initial=0))[:-1]
        literal = F.expr("array(" + ", ".join(f"{n}L" for n in starts) + ")")
        out[name] = F.element_at(literal, _part() + 1)
    return out


def running_sums(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Add running sums of integer columns over the whole table in ``order``.

    ``order`` must be unique, or rows that tie must have interchangeable sums.
    """
    weighted = df.select(
        "*", *[c.cast("bigint").alias(f"_w_{name}") for name, c in sums.items()]
    )
    ordered = _ordered(weighted, order)
    before = _before(ordered, {name: F.col(f"_w_{name}") for name in sums})
    # One partition of the sort per window.
    within = Window.partitionBy(_part()).orderBy("_row")
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ordered.select(
        *df.columns,
        *[(before[name] + F.sum(f"_w_{name}").over(within)).alias(name) for name in sums],
    )


def global_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number the rows 1..n in ``order``, which must be unique."""
    ordered = _ordered(df, order)
    in_part = F.col("_row").bitwiseAND(F.lit((1 << _PARTITION_BIT) - 1))
    before = _before(ordered, {"n": F.lit(1)})["n"]
    return ordered.select(*df.columns, (before + in_part + 1).alias(name))


def running_number(
    df: DataFrame, group: Sequence[str], order: str, name: str, span: int = 1_000_000
) -> DataFrame:
    """Number the rows of each group 1..n by a unique integer column.

    A group is cut into stretches of ``span`` order values; a task sorts one
    stretch at most, so a group holding a third of the table does no harm.
    """
    cut = [*group, "_stretch"]
    rows = df.withColumn("_stretch", F.floor(F.col(order) / span).cast("bigint"))
    before = (
        Window.partitionBy(*group)
        .orderBy("_stretch")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy(*cut)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    numbered = rows.withColumn(
        "_in", F.row_number().over(Window.partitionBy(*cut).orderBy(order))
    )
    return (
        numbered.join(offsets, cut)
        .withColumn(name, F.col("_before") + F.col("_in"))
        .select(*df.columns, name)
    )
