"""Helpers shared by the training-data operators: shared scratch space, staged tables, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import drop_staged, input_bytes, new_path, packed, scratch, stage

__all__ = ["WORD", "beside", "drop_staged", "input_bytes", "n_words", "new_path", "numbered", "packed", "read", "release", "running_total", "scratch", "stage", "unused"]

#: Plans that hand on the rows of a file as they are, some left out.
ROW_BY_ROW = ("LogicalRelation", "Project", "Filter", "SubqueryAlias")

#: A word: a run of characters that are neither a blank nor ASCII 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores after it until no table has such a column, in whatever case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, identical ones too, and that column's name: the file of a row
    and its place in it. What is not read straight from files is staged first."""
    name = unused("__row", docs)
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ROW_BY_ROW:
        plan = plan.children().head()
    if plan.nodeName().split(" ")[0] in ROW_BY_ROW:
        try:
            at = docs.metadataColumn("_metadata")
            return docs.withColumn(name, F.struct(at["file_path"].alias("file"), at["row_index"].alias("at"))), name
        except AnalysisException:  # not files, or files without places
            pass
    return numbered(stage(docs, "numbered"))


#: Rows of a key from which it is a hot one, as a share of all rows, and rows from which on hot keys are looked for.
HOT, LEAST_HOT = 1 / 2000, 1_000_000


def beside(rows: DataFrame, table: DataFrame, left: str, right: str, weight: str, total: int, least: int = LEAST_HOT) -> DataFrame:
    """``rows`` inner-joined with ``table`` (one row a key ``right`` and how many rows have it, ``weight``; ``total`` in
    all). One key may have any share of the rows, so those of hot keys meet a broadcast list instead of a task. A hot
    key has more than ``HOT`` of the rows, so the list has fewer than 1 / HOT keys."""
    on = F.col(left) == F.col(right)
    if total < least:
        return rows.join(table.drop(weight), on)
    hot = F.col(weight) > F.lit(HOT * total)
    many = F.broadcast(table.filter(hot).drop(weight))
    cold = rows.join(many.select(right), on, "left_anti").join(table.filter(~hot).drop(weight), on)
    return cold.unionByName(rows.join(many, on))


def release() -> None:
    """Hands memory back to the machine at the end of a task: its Python worker lives on, beside those of later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def running_total(df: DataFrame, by: Sequence[str], hashed: str, ties: Sequence[str], value: str, out: str, rank: str | None = None, bits: int = 10) -> DataFrame:
    """Inclusive running total ``out`` of ``value`` within ``by``, ordered by the long ``hashed`` and then ``ties``.

    No window ever holds a whole group: rows are cut into 2**bits slices by the leading bits of ``hashed`` (arithmetic
    shift keeps the order), slice totals give offsets, and only a slice is sorted. ``df`` is read twice, so stage it.
    With ``rank`` a 1-based row number in the same order is added.
    """
    cell = "__cell"
    d = df.withColumn(cell, F.shiftright(hashed, 64 - bits))
    sums = d.groupBy(*by, cell).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*by).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    offs = sums.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*by, cell])], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__row"))
    on = F.lit(True)
    for i, c in enumerate([*by, cell]):
        on = on & d[c].eqNullSafe(offs[f"__k{i}"])
    w = W.partitionBy(*by, cell).orderBy(hashed, *ties)
    j = d.join(offs, on).withColumn(out, F.col("__off") + F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    if rank:
        j = j.withColumn(rank, F.col("__row") + F.row_number().over(w))
    return j.drop(cell, "__off", "__row", *[f"__k{i}" for i in range(len(by) + 1)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
