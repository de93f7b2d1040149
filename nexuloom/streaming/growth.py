"""Degrees kept up to date while edges arrive (an extra; batch queries do not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """Running degree of each node of a stream of ``subject, object``; state grows with nodes, not with edges."""
    return edges.select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def windowed_peaks(samples: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Peaks of a stream of ``ts, kind, value`` by window; rows later than the watermark are left out."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "peak", "n")


def into_memory(d: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return d.writeStream.outputMode(mode).format("memory").queryName(name).start()


def edge_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
