"""The shared scratch folder, staged tables and the fixpoint loop."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where unset on a local master (tests), a
    temporary one. A cluster without one is an error: each executor would write to its own disk."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="nexuloom-")
            _LOCAL.append(own)
            sc.setCheckpointDir(f"file://{own}")
        path = sc.getCheckpointDir()
    return path.rstrip("/")


@atexit.register
def _drop_local() -> None:
    for p in _LOCAL:
        shutil.rmtree(p, ignore_errors=True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/nexuloom/{label}-{uuid.uuid4().hex}"


#: Bytes of input files a partition takes at least before small ones are packed together.
PACK_BYTES = 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as Spark's file index lists them; tables without a size count as nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def packed(df: DataFrame) -> DataFrame:
    """Thousands of tiny files cost more than they spread: at most two partitions a core of the cluster, or one for
    each 32 MB that ``df`` reads if that is more. So what a task takes does not grow with the input."""
    return df.coalesce(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism, input_bytes(df) // PACK_BYTES))


def stage(df: DataFrame, label: str, pack: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, columns can be pruned,
    and a lost executor costs nothing that was staged. ``pack`` is for what comes out of shuffles; what comes straight
    from a scan keeps the scan's partitions."""
    path = new_path(df.sparkSession, label)
    (packed(df) if pack else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table staged by this library in the shared folder (call when no result is pending)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/nexuloom")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def content_digest(df: DataFrame) -> str:
    """What ``df`` holds, whatever the order of its rows: names, types, the number of rows and two sums of 64-bit hashes of
    them. Null columns count by their place. One scan, summed before anything moves; columns of maps have no hash."""
    each = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    sums = [F.sum(F.xxhash64(F.lit(seed), *each).cast("decimal(28,0)")) for seed in (1, 2)]
    found = df.agg(F.count(F.lit(1)), *sums).head()
    return hashlib.sha256(json.dumps([df.schema.json(), *map(str, found)]).encode()).hexdigest()


def _folder(spark: SparkSession, path: str):
    """The file system of ``path``, the path, and what lies in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p, list(fs.listStatus(p)) if fs.exists(p) else []


def cached(spark: SparkSession, label: str, inputs: Sequence[DataFrame], parts: object, build: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """What ``build`` makes of ``inputs`` and the parameters ``parts`` (anything JSON takes), made once for each content
    of them. An entry is named by their digest and lies in ``folder`` (of the shared scratch folder if not given).

    Each writer has a folder of its own inside the entry, which counts once Spark has left its success mark, so a lost
    driver leaves nothing that is read, two writers do no harm, and no file is renamed."""
    key = hashlib.sha256(json.dumps([label, parts, *map(content_digest, inputs)], sort_keys=True).encode()).hexdigest()
    entry = f"{(folder or scratch(spark) + '/nexuloom-cache').rstrip('/')}/{label}-{key}"
    fs, _, attempts = _folder(spark, entry)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done = sorted(str(a.getPath()) for a in attempts if fs.exists(hadoop_path(a.getPath(), "_SUCCESS")))
    if done:
        return spark.read.parquet(done[0])
    made, path = build(), f"{entry}/{uuid.uuid4().hex}"
    packed(made).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def evict(spark: SparkSession, keep: int, folder: str | None = None) -> int:
    """Drops all but the ``keep`` entries of a cache that were made last; returns how many went."""
    fs, _, entries = _folder(spark, folder or f"{scratch(spark)}/nexuloom-cache")
    old = sorted(entries, key=lambda e: (e.getModificationTime(), str(e.getPath())), reverse=True)[keep:]
    for e in old:
        fs.delete(e.getPath(), True)
    return len(old)


def grow(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], label: str, most: int = 1000) -> DataFrame:
    """Semi-naive fixpoint: ``step`` maps the rows added last to candidate rows; those whose keys are new are added.
    Ends when nothing is added; an unfinished result is an error. Every round is staged."""
    everything = delta = stage(start, label)
    for _ in range(most):
        fresh = step(delta).dropDuplicates(keys).join(everything.select(*keys), keys, "left_anti")
        delta = stage(fresh.select(*everything.columns), label)
        if delta.isEmpty():
            return everything
        everything = everything.unionByName(delta)
    raise RuntimeError(f"{label} did not settle in {most} rounds")
