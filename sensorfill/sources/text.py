"""Headed, blank-delimited text tables, at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorfill import schema as S
from sensorfill.operators.scale import lookup_join, running_sums

# What separates, quotes, comments and marks missing values.
_FIELD = r""""[^"]*"|'[^']*'|[^\s"']+"""
_COMMENT = r"""^((?:[^"'#]|"[^"]*"|'[^']*')*)#.*$"""
_QUOTES = r"""^["']|["']$"""
_MISSING = "NA"


def _fields(line: Column) -> Column:
    """The fields of a line, unquoted; anything after ``#`` is a comment."""
    kept = F.regexp_replace(line, _COMMENT, "$1")
    found = F.regexp_extract_all(kept, F.lit(_FIELD), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, _QUOTES, ""))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of one or many text files, with ``obs_seq`` in file order.

    The header names the columns; those in ``schema`` are cast to its types and
    any others are left out. A header with one name fewer than the lines have
    fields means the lines begin with a row label. ``obs_seq`` is the line's place
    among all lines in the order of files and lines: the lines in earlier blocks,
    counted once for each block, and the line's place in its own. So files are read
    by many tasks, and neither their number nor their size has a limit.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line"),
    )
    parsed = lines.withColumn("fields", _fields(F.col("value"))).filter(F.size("fields") > 0)
    # One line of the data: the header.
    header = parsed.select("fields").first()["fields"]
    labelled = (F.size("fields") == len(header) + 1).cast("int")
    body = parsed.filter(F.col("fields") != F.array(*[F.lit(h) for h in header]))

    def column(field: T.StructField) -> Column:
        if field.name not in header:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.element_at("fields", header.index(field.name) + 1 + labelled)
        return F.when(text != _MISSING, text).cast(field.dataType).alias(field.name)

    at = ["file", "block"]
    blocks = lines.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    placed = running_sums(blocks, at, {"until": F.col("n")})
    seq = F.col("until") - F.col("n") + F.col("line") - F.col("first")
    return lookup_join(body, placed, at, "left").select(
        seq.alias("obs_seq"), *[column(f) for f in schema.fields]
    )


def read_observations(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Raw counts from text, or from a columnar format that carries ``obs_seq``."""
    if fmt == "text":
        return read_table(spark, path, S.RAW_OBSERVATIONS)
    return spark.read.format(fmt).load(path)


def read_sites(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    if fmt == "text":
        return read_table(spark, path, S.RAW_SITES).drop("obs_seq")
    return spark.read.format(fmt).load(path)
