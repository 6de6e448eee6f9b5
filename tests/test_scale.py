import random

import pytest
from pyspark.sql import functions as F

from sensorfill.operators import scale


def test_global_index_over_many_partitions(spark, many_parts):
    names = [f"n{random.Random(3).random():.6f}{i}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    got = scale.global_index(df, ["name"], "i")
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert [tuple(r) for r in got.orderBy("i").collect()] == [
        (n, i + 1) for i, n in enumerate(sorted(names))
    ]


def test_running_sums_over_many_partitions(spark, many_parts):
    df = spark.range(1000).withColumn("w", F.col("id") % 3)
    got = scale.running_sums(df, ["id"], {"s": F.col("w"), "n": F.lit(1)}).orderBy("id").collect()
    total = 0
    for i, r in enumerate(got):
        total += i % 3
        assert (r["s"], r["n"]) == (total, i + 1)


@pytest.mark.parametrize("span", [1, 7, 1_000_000])
def test_running_number_does_not_depend_on_the_span(spark, span):
    # One group holds most of the rows.
    df = spark.range(0, 600, 3).select(
        F.when(F.col("id") % 5 == 0, F.col("id") % 4).otherwise(F.lit(9)).alias("g"),
        F.col("id").alias("seq"),
    )
    seen: dict[int, int] = {}
    for r in scale.running_number(df, ["g"], "seq", "k", span).orderBy("seq").collect():
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["k"] == seen[r["g"]]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_is_the_same_beyond_the_broadcast_limit(spark, how):
    big = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(k, f"name {k}") for k in range(5)], "k long, t string")
    both = [scale.lookup_join(big, small, "k", how, limit) for limit in (scale.BROADCAST_BYTES, 10)]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in both]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]
    rows = [sorted(map(tuple, df.collect()), key=str) for df in both]
    assert rows[0] == rows[1] and rows[0]


def test_measured_size_counts_text(spark):
    df = spark.createDataFrame([("abc",), ("é",), (None,)], "t string")
    assert scale.materialize_measured(df)[1] == 3 * 8 + 3 + 2
