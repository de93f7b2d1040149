"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and shuffle partitions sized to the cores (local) or left to the cluster."""
    b = SparkSession.builder.appName("nexuloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master or "SPARK_MASTER" not in os.environ:
        master = master or "local[*]"
        b = b.master(master).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
