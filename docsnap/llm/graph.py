"""Connected components of an edge table, by joins and minima on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsnap.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of an edge.

    ``edges`` has ``a`` and ``b`` of one type; nulls and loops do not count. Each round hangs all
    neighbours of a node on the smallest of them, first the larger neighbours, then the smaller
    ones; the rounds grow with the logarithm of the longest path. Edge tables are written to the
    shared folder between rounds, and only counts come to the driver.
    """
    rows = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, seen = keep(rows.distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        # The join never meets a node's whole neighbourhood in one place but by its key.
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        larger = larger.distinct()
        low = larger.groupBy("u").agg(F.min("v").alias("least"))
        small = larger.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")
        )
        now = keep(small.select("e.*").filter("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
