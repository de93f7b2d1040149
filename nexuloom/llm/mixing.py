"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source gets a target number of words. Its documents are shuffled by a seeded hash; a document that ends at
running total ``c`` of its source in pass ``e`` has the virtual finish time ``(e * source_size + c) / target``. All
passes of all sources are ordered by that time and the mix ends where the words so far reach the budget.

Defined cases: a null source is a source of its own, ranked last; null or wordless texts have size 0 and are returned
with ``taken`` 0; texts of any length are one document of their size; documents that tie in a source's order (same id
and text) or in virtual time follow id, size and source; identical rows are separate documents; an empty table gives an
empty result; columns of the input other than the three named ones are ignored by ``mix`` and kept by
``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, numbered, running_total, stage, unused

#: Slices of the virtual time up to 1, and per doubling beyond it.
SLICES = 4096
#: Copies that are sorted in one window at most, unless they tie in time.
MOST_SORTED = 100_000


def targets(per_source: DataFrame, weights: Sequence[float], max_copies: int, budget: float | None = None) -> DataFrame:
    """``src, source_size`` -> adds ``rank`` (by code point, null last) and ``target``.

    Targets share the budget by weight; none is above ``max_copies`` times its source's size and the excess is shared
    anew by weight. That fixed point is ``least(cap, level * weight)``; the level follows from one pass over the
    sources in the order of cap / weight. One row a source: the windows hold sources, never documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = per_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("src").asc_nulls_last()))).withColumn("weight", w)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_copies))).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    order = W.orderBy("ratio", "rank")
    total = F.sum("source_size").over(everything).cast("double") if budget is None else F.lit(float(budget))
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("nth", F.row_number().over(order))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything)["level"]
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    return s.select("src", "source_size", "rank", "target")


def virtual_time(e) -> Column:
    """When a document of running total ``upto`` ends in pass ``e`` of its source; null where there is no target."""
    return F.try_divide((e * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))


def _slice(t):
    """Slices are ordered as the times are; their number is bounded whatever the times."""
    return F.when(t <= 1, F.ceil(t * SLICES)).otherwise(SLICES + 1 + F.floor(F.log2(t) * SLICES)).cast("long")


def _cut(copies: DataFrame, total: float):
    """The place (``t, rank, nth, e``) of the first copy that does not fit into ``total`` words, or None if all do.

    The time is narrowed down by sums over slices, each time within the slice where the sum passes ``total``, until few
    copies are left in it or all of them have one time; only those are sorted."""
    inside, before, cell = copies, 0, _slice(F.col("t"))
    for _ in range(8):  # a double has no more digits than that
        sums = inside.groupBy(cell.alias("slice")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("t").alias("low"), F.max("t").alias("high"))
        upto = F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, 0))
        last = sums.withColumn("upto", upto + F.lit(before)).filter(F.col("upto") > total).orderBy("slice").limit(1).head()
        if last is None:
            return None
        inside, before = inside.filter(cell == last["slice"]), last["upto"] - last["n"]
        low, high = last["low"], last["high"]
        if last["rows"] <= MOST_SORTED or not low < high:
            break
        cell = F.floor((F.col("t") - F.lit(low)) / F.lit(high - low) * SLICES)
    w = W.orderBy("t", "rank", "nth", "e").rowsBetween(W.unboundedPreceding, 0)
    ends = inside.withColumn("sum", F.sum("size").over(w) + F.lit(before))
    return ends.filter(F.col("sum") > total).agg(F.min(F.struct("t", "rank", "nth", "e")).alias("c")).head()["c"]


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_copies: int = 3, budget: float | None = None, seed: int = 42, key: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken, copies`` (and ``key, upto, rank,
    nth``, if a key column is named: with them ``virtual_time`` gives the place of each copy in the mix)."""
    key_col = F.col(key) if key else F.lit(None).cast("long")  # any type that has an order
    base = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), key_col.alias("key")), "mix-sizes", pack=False)
    t = targets(base.groupBy("src").agg(F.sum("size").alias("source_size")), weights, max_copies, budget)
    ordered = running_total(base, ["src"], "h", ["doc_id", "size", "key"], "size", "upto", rank="nth")
    salt = F.pmod(F.col("h"), F.lit(64))
    t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumnRenamed("src", "t_src")  # a hot source is joined in 64 parts
    ordered = ordered.withColumn("part", salt)
    j = ordered.join(t, ordered["src"].eqNullSafe(t["t_src"]) & (ordered["part"] == t["salt"]))
    j = stage(j.select("doc_id", "size", "key", "upto", "nth", "source_size", "rank", "target"), "mix-order")

    passes = F.coalesce(F.least(F.lit(max_copies), F.ceil(F.try_divide(F.col("target"), F.col("source_size").cast("double")))).cast("int"), F.lit(0))
    copies = j.filter((F.col("size") > 0) & (F.col("target") > 0)).select("size", "source_size", "upto", "target", "rank", "nth", F.explode(F.sequence(F.lit(0), passes - 1)).alias("e")).withColumn("t", virtual_time(F.col("e")))
    total = budget if budget is not None else j.agg(F.sum("size")).head()[0] or 0
    cut = _cut(copies, total)
    count = F.lit(0)
    for e in range(max_copies):
        here = (F.lit(e) < passes) & (F.col("target") > 0) & (F.col("size") > 0)
        if cut is not None:
            here = here & (F.struct(virtual_time(F.lit(e)).alias("t"), F.col("rank"), F.col("nth"), F.lit(e).alias("e")) < F.struct(F.lit(cut["t"]).alias("t"), F.lit(cut["rank"]).alias("rank"), F.lit(cut["nth"]).alias("nth"), F.lit(cut["e"]).alias("e")))
        count = count + F.when(F.coalesce(here, F.lit(False)), 1).otherwise(0)
    out = j.select("doc_id", "size", "source_size", "target", (F.col("size") * count).cast("long").alias("taken"), count.alias("copies"), *(["key", "upto", "rank", "nth"] if key else []))
    return out


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in its order: each document's row, all columns kept, as often as the mix takes it (not at all if
    never), range-sorted by virtual finish time, then source, place in the source and pass.

    Rows meet their counts by their place in the table, which no two rows share, so identical rows are kept apart and
    none is lost; copies are made after the join."""
    names = [f"`{c}`" for c in docs.columns]
    rows, row = numbered(docs)
    key, place = unused("__key", rows), unused("__place", rows)
    times = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: F.struct(virtual_time(e).alias("t"), "rank", "nth", e.alias("e")))
    places = mix(rows, key=row, **options).filter("copies > 0").select(F.col("key").alias(key), times.alias(place))
    return rows.join(places, F.col(row) == F.col(key)).withColumn(place, F.explode(place)).orderBy(place).select(*names)
