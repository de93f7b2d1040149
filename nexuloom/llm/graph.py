"""Connected components by alternating star contraction, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_HOT, beside, stage


def components(edges: DataFrame, most_rounds: int = 40, least_hot: int = LEAST_HOT) -> DataFrame:
    """``u, v`` (longs) -> ``node, root``: every node of an edge and the smallest node of its component.

    Large star: every node hands its larger neighbours to its smallest one; small star: every node hands its smaller
    neighbours and itself to the smallest. Both keep components and end in stars; the rounds grow with the logarithm of
    a component's width. Each round is staged in the shared folder, so nothing is lost with an executor. From
    ``least_hot`` edges on, the hot nodes of a round are joined apart. A graph that does not settle is an error.
    """
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    seen = mark(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("deg")).withColumnRenamed("u", "lu")
        large = beside(both.filter("v > u"), low, "u", "lu", "deg", seen[0], least_hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")).withColumnRenamed("u", "lu")
        small = beside(large, low, "u", "lu", "deg", seen[0], least_hot).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.*").filter("u <> v").distinct()
        e = stage(small, "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
