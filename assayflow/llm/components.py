"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored


def connected_components(edges: DataFrame, path: str, a: str = "a", b: str = "b") -> DataFrame:
    """v, root (least node of its component) of every node that has an edge to another one.

    Alternating large-star and small-star steps: each node points its neighbours to the least of
    them. Every step is written to the shared folder path, so a lost executor repeats one step; the
    number of steps grows with the logarithm of the component size. Nodes are integers; null nodes
    and loops are ignored.
    """
    spark = edges.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = stored(now.where((x.isNotNull()) & (y.isNotNull()) & (F.col("u") != F.col("v"))).distinct(), f"{path}/cc0")
    before, step = None, 0
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if mark == before or not mark["n"]:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(
                now.select("v").distinct().select("v", F.col("v").alias("root"))
            )
        before, step = mark, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        least = least.select("w", F.least("w", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        following = stored(small, f"{path}/cc{step}")
        remove(spark, f"{path}/cc{step - 1}")
        now = following
