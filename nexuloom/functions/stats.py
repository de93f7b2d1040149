"""Statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scalars import significant


def log_factorials(spark: SparkSession, most: int) -> DataFrame:
    """One row with ``lf``: ln(i!) for i in 0..most. Its size is the universe's, which is checked."""
    if most > 2_000_000:
        raise ValueError("the table of log factorials is not broadcast at this size")
    return F.broadcast(spark.createDataFrame([([math.lgamma(i + 1) for i in range(most + 1)],)], "lf array<double>"))


def hypergeom_tail(k: Column, universe: Column, marked: Column, drawn: Column, lf: Column) -> Column:
    """P(X >= k): the sum of the terms from k to least(marked, drawn), clipped to 1."""
    f = lambda x: F.element_at(lf, (x + 1).cast("int"))
    upper = F.least(marked, drawn)
    below = F.greatest(k, drawn - (universe - marked))
    base = f(universe) - f(drawn) - f(universe - drawn)
    term = lambda x: F.exp(f(marked) - f(x) - f(marked - x) + f(universe - marked) - f(drawn - x) - f(universe - marked - drawn + x) - base)
    total = F.aggregate(F.sequence(below, upper), F.lit(0.0), lambda acc, x: acc + term(x))
    return F.when(k <= 0, 1.0).when(k > upper, 0.0).when(below > upper, 0.0).otherwise(F.least(F.lit(1.0), total))


def benjamini_hochberg(rows: DataFrame, p: str, ties: list[str], by: list[str] | None = None, out: str = "fdr") -> DataFrame:
    """Running minimum of p * m / rank from the largest p down. Tests are few (terms), so one window holds them."""
    by = by or []
    up = W.partitionBy(*by).orderBy(p, *ties)
    r = rows.withColumn("__r", F.row_number().over(up)).withColumn("__m", F.count(F.lit(1)).over(W.partitionBy(*by)))
    down = W.partitionBy(*by).orderBy(F.desc("__r")).rowsBetween(W.unboundedPreceding, 0)
    return r.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(down))).drop("__r", "__m")


def enrich(annotations: DataFrame, genes: DataFrame, min_size: int = 3, max_size: int = 2000, min_overlap: int = 2, fdr_max: float = 0.25, top: int | None = 60) -> DataFrame:
    """``gene, term`` pairs and queried genes -> ranked terms. Only tested terms count for the FDR."""
    spark = annotations.sparkSession
    pairs = annotations.select("gene", "term").distinct()
    universe = pairs.select("gene").distinct()
    n = universe.count()
    query = genes.select("gene").distinct().join(universe, "gene", "left_semi")
    drawn = query.count()
    sizes = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("term_size")).filter(F.col("term_size").between(min_size, max_size))
    hits = pairs.join(query, "gene").groupBy("term").agg(F.count(F.lit(1)).alias("overlap"), F.array_sort(F.collect_list("gene")).alias("genes")).filter(F.col("overlap") >= min_overlap)
    t = sizes.join(hits, "term").join(log_factorials(spark, n))  # one row
    t = t.withColumn("p_value", hypergeom_tail(F.col("overlap"), F.lit(n), F.col("term_size"), F.lit(drawn), F.col("lf"))).drop("lf")
    t = benjamini_hochberg(t, "p_value", ["term"]).filter(F.col("fdr") <= fdr_max)
    t = t.orderBy("fdr", "p_value", "term").limit(top) if top else t
    return t.withColumn("p_value", significant(F.col("p_value"))).withColumn("fdr", significant(F.col("fdr")))


def rate(flag: Column) -> Column:
    """Share of true among the rows, null if there are none."""
    return F.avg(flag.cast("int"))


def wald(p: Column, n: Column) -> Column:
    """A19"""
    return 1.96 * F.sqrt(p * (1 - p) / n)


def macro_average(rows: DataFrame, stratum: str, flag: str) -> DataFrame:
    """Rate of each stratum, and their mean in a row of its own."""
    per = rows.groupBy(stratum).agg(rate(F.col(flag)).alias("rate"), F.count(F.lit(1)).alias("n"))
    return per.unionByName(per.agg(F.lit("(macro)").alias(stratum), F.avg("rate").alias("rate"), F.sum("n").alias("n")))


def last_median(rows: DataFrame, key: list[str], order: list[Column], value: str, last: int = 10) -> DataFrame:
    """Median of the last values of each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("__r") <= last).groupBy(*key).agg(F.expr(f"percentile({value}, 0.5)").alias("median"))


def cost_estimate(pages: Column, profiles: Column, page_s: float = 720.0, graph_s: float = 90.0, start_s: float = 60.0) -> Column:
    """E15"""
    return F.lit(start_s) + pages * page_s + profiles * graph_s


def page_cost(elapsed: Column, pages: Column, graphs_s: Column, start_s: float = 60.0) -> Column:
    """Seconds a page from a finished job, 30 at least."""
    return F.greatest(F.lit(30.0), (elapsed - graphs_s - start_s) / F.greatest(pages, F.lit(1)))


def energy(rows: DataFrame, seconds: str, assumptions: DataFrame) -> DataFrame:
    """kWh and grams of CO2 for each power level and region of a short table ``watts, region, g_per_kwh``."""
    kwh = F.col(seconds) * F.col("watts") / 3.6e6
    return rows.join(F.broadcast(assumptions)).withColumn("kwh", kwh).withColumn("g_co2", kwh * F.col("g_per_kwh"))
