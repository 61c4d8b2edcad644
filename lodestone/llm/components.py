"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.durable import durable, forget

#: Edges of a partition: a table of few edges is not dealt into as many partitions as one of many.
PARTITION_EDGES = 50_000


def _stars(edges: DataFrame, large: bool, partitions: int) -> DataFrame:
    """Ties neighbours to the smallest one: for large stars those above a node, else
    those below it and the node itself. ``edges`` has u > v. One shuffle by u serves both the least
    neighbours and their join."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(partitions, "u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        edges = edges.repartition(partitions, "u")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return tied.where("u > v").repartition(partitions, "u").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b; 64-bit integers), where label is the
    smallest node that can be reached. The number of rounds grows with the logarithm
    of the longest path; each is written to the checkpoint folder, and the one before it removed."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, state = now.count(), None
    while True:
        partitions = min(most, max(4, -(-n // PARTITION_EDGES)))
        before, now = now, durable(_stars(_stars(now, True, partitions), False, partitions))
        forget(before)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        n = seen[0]
        if seen == state or not n:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v")).distinct()
