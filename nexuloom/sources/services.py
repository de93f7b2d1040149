"""Calls of outside services from tasks (S12, R13, R14, R17, N13): each question once, so many at a time, replies in a table."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import _folder, stage

REPLY = "question string, reply string, failed boolean, tries int"


@dataclass(frozen=True)
class Http:
    """A service behind a URL: ``{question}`` in it is replaced, quoted. Refusals for load (429) and faults of the server are
    raised, to be tried again; any other refusal means that there is no answer."""

    url: str
    headers: tuple[tuple[str, str], ...] = ()
    timeout: float = 10.0

    def __call__(self, question: str) -> str | None:
        request = urllib.request.Request(self.url.replace("{question}", urllib.parse.quote(question, safe="")), headers=dict(self.headers))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as found:
                return found.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise
            return None


@dataclass(frozen=True)
class Service:
    """A provider for ``retrieval.once_per``, ``agent.decide`` and ``agent.episodes`` that makes the calls itself.

    ``call`` takes a question and returns its answer or None; what it raises counts as a fault. At most ``tasks`` times
    ``at_once`` calls run at a time. A fault is tried again after ``wait`` seconds, then twice that, ``tries`` times in all;
    then the answer is null, and the question is asked again by the next call. Answers, None too, lie in ``store``, a
    folder that driver and executors share: a question that has one there is never asked again. Questions go in waves, each
    committed by itself, so what a lost driver has to ask again is one wave, and what a lost task has to, its share of it."""

    call: Callable[[str], str | None]
    store: str
    tasks: int = 8
    at_once: int = 8
    tries: int = 3
    wait: float = 0.5
    wave: int = 100_000

    def replies(self, spark: SparkSession) -> DataFrame:
        """Answers that the store has: ``question, reply, tries``, a question once."""
        fs, _, waves = _folder(spark, self.store)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        done = [str(w.getPath()) for w in waves if fs.exists(path(w.getPath(), "_SUCCESS"))]
        known = spark.read.schema(REPLY).parquet(*done) if done else spark.createDataFrame([], REPLY)
        return known.filter("NOT failed").dropDuplicates(["question"]).drop("failed")

    def _ask(self, batches):
        def one(question: str):
            for n in range(self.tries):
                try:
                    return question, self.call(question), False, n + 1
                except Exception:  # whatever a service raises is a fault of it
                    if n + 1 < self.tries:
                        time.sleep(self.wait * 2**n)
            return question, None, True, self.tries

        with ThreadPoolExecutor(self.at_once) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(one, b["question"])), columns=["question", "reply", "failed", "tries"])

    def __call__(self, asked: DataFrame) -> DataFrame:
        """``key`` and, if it is there, ``prompt`` (else the key is the question) -> ``key, reply``, a row for each row. Null
        questions have null replies and are not asked."""
        spark = asked.sparkSession
        rows = asked.select("key", F.col("prompt" if "prompt" in asked.columns else "key").cast("string").alias("question"))
        lacking = stage(rows.select("question").filter("question IS NOT NULL").distinct().join(self.replies(spark), "question", "left_anti"), "questions")
        waves = -(-lacking.count() // self.wave)
        for w in range(waves):
            now = lacking.filter(F.pmod(F.xxhash64("question"), F.lit(waves)) == w).repartition(self.tasks, "question")
            now.mapInPandas(self._ask, REPLY).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.store.rstrip('/')}/{uuid.uuid4().hex}")
        return rows.join(self.replies(spark), "question", "left").select("key", "reply")
