"""Rows before, in slices: what one window over the whole group gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import detectors as D
from tracemill.operators.windows import lagged


@pytest.mark.parametrize("bits", [1, 4, 16, 40])
@pytest.mark.parametrize("levels", [0, 1, 3])
def test_lag_in_slices_equals_a_window(spark, bits, levels):
    rng = random.Random(bits * 10 + levels)
    # a hot group, leaps, repeated numbers, null values, a null group, negative numbers
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([rng.randrange(-20, 200), rng.randrange(1 << 40)]), k, rng.choice([None, k])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, at long, k int, v int")
    order = Window.partitionBy("g").orderBy("at", "k")
    expected = df.withColumn("pv", F.lag("v").over(order)).withColumn("pk", F.lag("k").over(order))
    got = lagged(df, "g", F.col("at"), ["k"], ["v", "k"], bits, levels)
    assert sorted(map(repr, got.select("g", "at", "k", "v", "before.v", "before.k").collect())) == sorted(map(repr, expected.select("g", "at", "k", "v", F.col("pv").alias("v"), F.col("pk").alias("k")).collect()))


def test_one_agent_with_all_rows_uses_all_tasks(spark):
    tr = spark.range(40000).select(F.lit("a").alias("agent_id_hash"), F.concat(F.lit("t"), "id").alias("trace_id"), (F.col("id") + F.floor(F.col("id") / 1000) * 70000).alias("audit_sequence_number"))
    gaps = D.hash_chain_gaps(tr)
    assert gaps.count() == 39
    rows = tr.select("agent_id_hash", "trace_id", F.col("audit_sequence_number").alias("seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = lagged(rows, "agent_id_hash", F.col("seq"), ["trace_id"], ["seq"]).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in done.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 6 and max(sizes) < 20000
