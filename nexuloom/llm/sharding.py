"""Sharding by balanced label propagation over groups of equal texts, under the law ``bytes``.

Documents start with labels (shards) dealt by their hash. Linked documents (equal texts) are a star around their text, so
no pair is ever made; long stars are cut into parts of a bounded size, which move as one. In each round every part asks
for the shard that most of its text's bytes are on, by the labels as they are now (a neighbour vote; shards that have
turned a part away, other than its own, are left out), and a shard takes parts in while its quota lasts. Labels that have changed are counted anew
in the next round, and rounds go on until nobody moves. Documents that are not linked, and parts that no shard has room
for, then fill every shard up to the same size along one running total.

A text of one part has no neighbours once it is placed, so only parts of long stars stay in the rounds. These are few at
any size of the table: a part has a ``parts_a_shard``-th of a shard's bytes or rows, all but the last of a text.

Defined cases: a null text has size 1 and CRC 0 and is not linked; empty texts are linked; texts of any length are one
document of their size; ties of a vote go to a shard by the text's hash; null ids and repeated rows are ordinary
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT, running_total, stage


def _votes(parts: DataFrame, chunked: DataFrame, shards: int) -> DataFrame:
    """``vg, votes``: of each text, its labels by bytes, most first: of placed parts the label, of others those of their
    documents. At most one entry a shard."""
    placed = parts.filter(F.col("label").isNotNull()).select("g", "label", "bytes")
    waiting = parts.filter(F.col("label").isNull()).select(F.col("g").alias("wg"), F.col("part").alias("wp"))
    dealt = chunked.join(waiting, (F.col("g") == F.col("wg")) & (F.col("part") == F.col("wp"))).select("g", "label", F.col("size").alias("bytes"))
    here = placed.unionByName(dealt).groupBy("g", "label").agg(F.sum("bytes").alias("here"))
    order = F.struct((-F.col("here")).alias("most"), F.pmod(F.col("label") + F.xxhash64("g"), F.lit(shards)).alias("tie"), "label")
    return here.groupBy(F.col("g").alias("vg")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["label"]).alias("votes"))


def propagate(chunked: DataFrame, shards: int, quota: float, most_rounds: int = 100) -> tuple[DataFrame, dict[int, float]]:
    """``pg, pp, shard`` of the parts that found one, and the room left on each shard. ``chunked``: size, g, part, label."""
    parts = chunked.groupBy("g", "part").agg(F.sum("size").alias("bytes")).withColumn("ph", F.xxhash64("g", "part"))
    parts = stage(parts.withColumn("label", F.lit(None).cast("int")), "shard-parts")
    left, full, done = {s: quota for s in range(shards)}, set(), []
    for r in range(most_rounds):
        room = [s for s in range(shards) if left[s] > 0 and s not in full]
        if not room:
            break
        free = F.element_at(F.array(*map(F.lit, room)), (F.pmod(F.xxhash64("g", F.lit(r)), F.lit(len(room))) + 1).cast("int"))
        open_ = F.filter("votes", lambda s: s.isin(room) | (s == F.col("label")) & F.col("label").isNotNull())
        asked = parts.join(_votes(parts, chunked, shards), F.col("g") == F.col("vg"), "left").withColumn("want", F.coalesce(F.get(open_, F.lit(0)), free))
        asked = stage(asked.select("g", "part", "bytes", "ph", "label", "want", F.xxhash64("g").alias("gh")), "shard-asked")
        moving = F.col("label").isNull() | (F.col("want") != F.col("label"))
        limits = reduce(lambda c, s: c.when(F.col("want") == s, F.lit(left[s])), room, F.when(F.lit(False), F.lit(0.0)))
        movers = running_total(asked.filter(moving), ["want"], "gh", ["ph", "bytes"], "bytes", "upto")
        after = movers.withColumn("ok", F.col("upto") <= limits).unionByName(asked.filter(~moving).withColumn("upto", F.lit(0)).withColumn("ok", F.lit(False)))
        after = stage(after.select("g", "part", "bytes", "ph", F.col("label").alias("old"), F.when(F.col("ok"), F.col("want")).otherwise(F.col("label")).alias("label"), "ok", (moving & ~F.col("ok")).alias("refused"), "want"), "shard-moved")
        closed = {row["want"] for row in after.filter("refused").select("want").distinct().collect()} - full  # at most one row a shard
        moved = 0
        for row in after.filter("ok").groupBy("old", "label").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # at most one row a pair of shards
            moved += row["n"]
            left[row["label"]] -= row["b"]
            if row["old"] is not None:
                left[row["old"]] += row["b"]
        long = after.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNull()).alias("open")).filter("n > 1 OR open > 0").select(F.col("g").alias("lg"))
        done.append(after.join(long, F.col("g") == F.col("lg"), "left_anti").select("g", "part", "label"))
        parts = stage(after.join(long, F.col("g") == F.col("lg"), "left_semi").select("g", "part", "bytes", "ph", "label"), "shard-long")
        full |= closed
        if not (moved or closed) or parts.isEmpty():
            break
    else:
        raise RuntimeError("labels did not settle")
    done.append(parts.filter(F.col("label").isNotNull()).select("g", "part", "label"))
    return reduce(DataFrame.unionAll, done).select(F.col("g").alias("pg"), F.col("part").alias("pp"), F.col("label").alias("shard")), left


def cut_links(placed: DataFrame, group: str, shard: str) -> DataFrame:
    """``links, cut``: of the links between the documents of a group and the group, those that lead to another shard
    than the one that holds most of the group."""
    n = placed.filter(F.col(group).isNotNull()).groupBy(group, shard).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    n = n.filter("n > 1")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def linked_and_rest(base: DataFrame, groups: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``base`` whose ``g`` is one of ``groups`` (``gg, n``: its texts and their counts), and the others. A text
    with more than ``HOT`` of the rows, of which there are fewer than 1 / HOT, meets a broadcast list; only the others
    are dealt by their text, so no task takes a large group of copies."""
    on = F.col("g") == F.col("gg")
    hot = F.broadcast(groups.filter(F.col("n") > F.lit(HOT * total)).select("gg"))
    cold = base.join(hot, on, "left_anti")
    few = groups.filter(F.col("n") <= F.lit(HOT * total)).select("gg").hint("merge")
    return base.join(hot, on, "left_semi").unionByName(cold.join(few, on, "left_semi")), cold.join(few, on, "left_anti")


def shard(docs: DataFrame, shards: int = 16, parts_a_shard: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.when(F.col(text_col).isNotNull(), F.struct(F.xxhash64(text).alias("hash"), F.crc32(text).alias("crc"), F.octet_length(text).alias("length"))).alias("g"),
            F.xxhash64(F.col(id_col), text).alias("h"),
        ),
        "shard-sizes",
        pack=False,
    )
    sums = base.agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).head()
    total = sums["s"] or 0
    quota, part, rows = total / shards, max(1.0, total / shards / parts_a_shard), max(1.0, sums["n"] / shards / parts_a_shard)
    groups = base.filter(F.col("g").isNotNull()).groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = stage(groups.select(F.col("g").alias("gg"), "n"), "shard-groups")
    linked, alone = linked_and_rest(base, groups, sums["n"])
    linked = stage(linked.withColumn("label", F.pmod(F.col("h"), F.lit(shards)).cast("int")), "shard-linked")
    # a part ends where its bytes or its rows are full: copies of a short text are many rows and few bytes
    chunked = running_total(linked, ["g"], "h", ["doc_id"], "size", "upto", rank="nth")
    chunked = chunked.withColumn("part", F.floor((F.col("upto") - F.col("size")) / F.lit(part)) + F.floor((F.col("nth") - 1) / F.lit(rows)))
    chunked = stage(chunked.select("doc_id", "size", "g", "h", "part", "label"), "shard-chunks")
    spots, left = propagate(chunked, shards, quota)
    where = chunked.join(spots, (F.col("g") == F.col("pg")) & (F.col("part") == F.col("pp")), "left")
    where = stage(where.select("doc_id", "size", "g", "h", "shard"), "shard-where")

    settled = where.filter(F.col("shard").isNotNull()).select("doc_id", "size", "g", "h", "shard")
    rest = alone.select("doc_id", "size", "g", "h").unionByName(where.filter(F.col("shard").isNull()).select("doc_id", "size", "g", "h"))
    rest = stage(rest, "shard-rest")
    ends, at = [], 0.0
    for s in range(shards):
        at += max(0.0, left[s])
        ends.append(at)
    middle = F.col("upto") - F.col("size") / 2
    fill = reduce(lambda c, s: c.when(middle <= F.lit(ends[s]), s), range(shards), F.when(F.lit(False), -1)).otherwise(max(range(shards), key=lambda s: left[s]))
    filled = running_total(rest, [], "h", ["doc_id", "size"], "size", "upto").withColumn("shard", fill).select("doc_id", "size", "g", "h", "shard")
    every = stage(settled.unionByName(filled).withColumn("one", F.lit(1)), "shard-every")
    slotted = running_total(every, ["shard"], "h", ["doc_id", "size"], "one", "row")
    return slotted.select("doc_id", "size", F.coalesce(F.col("g.crc"), F.lit(0)).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
