"""Mixing sources to target weights along a curriculum that changes with time.

Every source has a target in words and a weight schedule over the training time from 0
to 1. Its cumulative demand is the integral of the schedule; its documents, in a hashed
order and repeated up to ``MAX_REPEATS`` times, lie one after another on that demand. The
time at which the demand reaches a copy's first word is the copy's training position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorfill.llm.common import plain_bytes, start_offsets, stored
from sensorfill.operators.scale import lookup_join

#: No document is taken more often.
MAX_REPEATS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: How the weight of a source changes from time 0 to time 1, in the same order: the
#: sources of small weight fade, those of large weight grow.
SHAPES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def with_size(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Add the number of words ``[^\\x20\\x09-\\x0D]+`` of each whole text; null has none."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(x.split()) for x in plain_bytes(batch, text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    shapes: Sequence[tuple[float, float]] = SHAPES,
    repeats: int = MAX_REPEATS,
) -> DataFrame:
    """source, source_size, target, shape_start, shape_end from rows (source, size).

    All words are shared out by weight; no target is above ``repeats`` times its source,
    and what is above goes to the others by weight. That is the level L at which the
    targets min(repeats * size, L * weight) add up to all words: sources are capped in
    the order of size / weight. The table has one row for each source.
    """
    whole = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(
        F.array(*map(F.lit, values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int")
    )
    known = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = known.select(
        "*",
        pick(weights).cast("long").alias("w"),
        pick([float(a) for a, _ in shapes]).alias("shape_start"),
        pick([float(b) for _, b in shapes]).alias("shape_end"),
    )
    cap = F.col("source_size") * repeats
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    later = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = known.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(earlier), F.lit(0))).alias("rest"),
        F.sum("w").over(later).alias("rest_w"),
        F.row_number().over(by_cap).alias("place"),
    )
    # The first source that its share of what is left does not fill sets the level.
    fits = F.col("rest") * F.col("w") <= cap * F.col("rest_w")
    first = F.min(F.when(fits, F.struct("place", "rest", "rest_w"))).over(whole)
    level = ranked.withColumn("first", first)
    share = F.col("first.rest") * F.col("w") / F.col("first.rest_w")
    return level.select(
        "source",
        "source_size",
        F.when(F.col("place") < F.col("first.place"), cap.cast("double")).otherwise(share).alias("target"),
        "shape_start",
        "shape_end",
    )


def position(demand: Column, a: Column, b: Column) -> Column:
    """The time at which a schedule going linearly from weight a to b has used the share
    ``demand`` of its integral: the root of a quadratic."""
    mean = (a + b) / 2
    root = F.sqrt(a * a + 2 * (b - a) * mean * demand)
    return F.when(demand > 0, 2 * mean * demand / (a + root)).otherwise(F.lit(0.0))


def hashed_order(doc_id: Column) -> Column:
    """63 bits of the md5 of an id, the order of a source's documents; null as ''."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") * 8


def curriculum(sizes: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """Add source_size, target and ``copies`` to rows (doc_id, source, size, ...).

    ``copies`` has epoch, taken (words) and position of each copy that the mix takes. All
    are whole but for the one in which a source's target is reached. Documents without
    words have none. A null source is a source. ``sizes`` is read several times, so it
    should be a stored table.
    """
    placed = start_offsets(sizes, ["source"], hashed_order(F.col("doc_id")), "size", "_begin")
    known = targets(sizes, repeats=repeats).withColumnRenamed("source", "_source")
    rows = lookup_join(
        placed.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))),
        known.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("null"))).drop("_source"),
        "_key",
    )

    def copy(epoch: Column) -> Column:
        begin = epoch * F.col("source_size") + F.col("_begin")
        taken = F.least(F.col("size"), F.floor("target") - begin)
        demand = F.when(F.col("target") > 0, begin / F.col("target")).otherwise(F.lit(0.0))
        at = position(demand, F.col("shape_start"), F.col("shape_end"))
        return F.struct(epoch.alias("epoch"), taken.alias("taken"), at.alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), copy), lambda x: x["taken"] > 0)
    return rows.select(*sizes.columns, "source_size", "target", copies.alias("copies"))


def in_training_order(mixed: DataFrame, tie: str = "doc_id") -> DataFrame:
    """One row for each copy, range-sorted by position over all partitions."""
    each = mixed.select("*", F.explode("copies").alias("copy")).drop("copies")
    order = [F.col("copy.position"), F.col(tie), F.col("copy.epoch")]
    return each.repartitionByRange(*order).sortWithinPartitions(*order)


def taken_in_order(mixed: DataFrame) -> DataFrame:
    """Add ``taken`` (words) and first_position to rows (uid, doc_id, copies, ...) of a stored
    table, from the copies of each unique ``uid`` in the training order.

    The copies are range-sorted and written in that order, one file for each partition;
    rows without copies have no words taken and no position.
    """
    order = stored(in_training_order(mixed.select("uid", "doc_id", "copies")), "order")
    each = order.groupBy("uid").agg(
        F.sum("copy.taken").alias("taken"), F.min("copy.position").alias("first_position")
    )
    # Both sides have a row for each uid at most, so no key of the join is hot.
    return mixed.join(each, "uid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and when first, from its training order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("uid"))
    sizes = stored(with_size(docs).select("doc_id", "source", "size", "uid"), "sizes")
    mixed = stored(curriculum(sizes), "mixed")
    return taken_in_order(mixed).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def mix(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the copies that the mix takes, in training order.

    A document taken k times is there k times, always whole: the copy in which a source's
    target is reached stays if the words taken come nearer to the target with it than
    without it. Documents of which nothing is taken go.
    """
    names = docs.columns
    rows = stored(docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), F.monotonically_increasing_id().alias("uid")), "mix")
    sizes = stored(
        with_size(rows.select("uid", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), F.col("doc.text").alias("text"))).drop("text"),
        "sizes",
    )
    whole = F.filter("copies", lambda c: 2 * c["taken"] >= F.col("size"))
    taken = curriculum(sizes).withColumn("copies", whole).where(F.size("copies") > 0).select("uid", "doc_id", "copies")
    each = in_training_order(lookup_join(rows, taken, "uid"), "uid")
    return each.select(*[F.col("doc").getField(c).alias(c) for c in names])


SIZE_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP8_SQL = rf"""
WITH docs AS (SELECT doc_id, source, {SIZE_SQL}::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r FROM s0),
s2 AS (SELECT *, r + 1 AS w, CASE r WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS a,
         CASE r WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS b FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w,
         row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place FROM s2),
lvl AS (SELECT * FROM s3 WHERE rest * w <= 3 * source_size * rest_w ORDER BY place LIMIT 1),
s4 AS (SELECT s.source, s.source_size, s.a, s.b,
         CASE WHEN s.place < l.place THEN (3 * s.source_size)::DOUBLE
              ELSE (l.rest * s.w)::BIGINT::DOUBLE / l.rest_w::BIGINT::DOUBLE END AS target
       FROM s3 s CROSS JOIN lvl l),
d1 AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15), doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS beg FROM docs),
d2 AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.a, s.b,
         d.beg AS b0, d.beg + s.source_size AS b1, d.beg + 2 * s.source_size AS b2
       FROM d1 d JOIN s4 s ON d.source IS NOT DISTINCT FROM s.source),
d3 AS (SELECT *, greatest(least(size, floor(target)::BIGINT - b0), 0) AS t0, greatest(least(size, floor(target)::BIGINT - b1), 0) AS t1,
         greatest(least(size, floor(target)::BIGINT - b2), 0) AS t2, (a + b) / 2 AS mean, b0 / target AS y FROM d2)
SELECT doc_id, size, source_size, target, (t0 + t1 + t2)::BIGINT AS taken,
  CASE WHEN t0 > 0 THEN CASE WHEN y > 0 THEN 2 * mean * y / (a + sqrt(a * a + 2 * (b - a) * mean * y)) ELSE 0.0 END END::DOUBLE AS first_position
FROM d3
"""
