"""Lineage cuts."""

import os

from pyspark.sql import functions as F

from lodestone.operators.durable import durable, forget


def estimate(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_estimates_do_not_multiply(spark):
    now = spark.range(36).select("id", (F.col("id") % 6).alias("k"))
    for _ in range(60):
        other = now.select(F.col("k").alias("j"), F.col("id").alias("to"))
        before, now = now, durable(now.join(other, now.id == other.j).groupBy(F.col("to").alias("id")).agg(F.min("k").alias("k")))
        forget(before)
    assert estimate(now) < 1 << 20
    assert not os.path.exists(before._durable.removeprefix("file:")) and os.path.exists(now._durable.removeprefix("file:"))


def test_names_may_clash(spark):
    df = spark.createDataFrame([(1, "x", None, [1])], "a long, A string, `b c.d` string, e array<int>").select("*", F.lit(2).alias("a"))
    out = durable(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "x", None, [1], 2)]
    assert durable(df.limit(0)).collect() == []
