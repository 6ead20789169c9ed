"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def free_shuffles(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced.

    Spark removes them when the driver's JVM collects the plan; a driver with a large heap may not
    do so for a long time, while the executors' disks fill up.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node it can reach.

    Alternating large-star and small-star rounds: every node is re-linked to the smallest neighbour
    it knows, so the number of rounds grows with the logarithm of the longest path. Minima are
    pre-aggregated before the shuffle and each round is a written table.
    """
    a, b = F.col(left), F.col(right)
    now = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "links")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.unionByName(low.filter("u != m").select("u", F.col("m").alias("v"))).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == last:
            break
        last = mark
    nodes = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = now.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return nodes.unionByName(roots).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))
