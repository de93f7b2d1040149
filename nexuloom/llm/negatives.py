"""Hard negatives of anchors by ball trees: rows of another label that score in a window below a positive's score.

A score is the integer inner product with the anchor. Rows are dealt evenly; each partition builds a tree of balls for every
label in it (a node has a centre and a radius), so the inner product of an anchor with all that is below a node
lies between ``q.c - |q| r`` and ``q.c + |q| r``. Two searches go down from the roots with many anchors at once:
first for the best rows of an anchor's own label, its positives, then, with a window for each positive, for rows of all
others. A node is left where its bounds lie outside every window of an anchor or strictly beneath the score of its last place
so far; ties are followed, as a smaller id may win them. A partition gives its best rows an anchor and window, and a
rank by anchor joins the partitions' answers.

Anchors are the queries of a stated set: they go to the partitions in blocks of ``BLOCK_BYTES`` of vectors.
Of equal vectors of one label in a partition only those with the smallest ids are kept, as many as could be returned, so
a vector that very many rows share is a few entries.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors meet those of their own
length only; a null id is no anchor and loses ties; a row that is there twice is two rows, and two anchors; where a positive's
score is negative its window is empty; an anchor without positives or negatives gives no row; so does an empty table; other columns
are ignored, whatever their names. Scores of more than 62 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, stage

LEAF = 64
#: Bytes of vectors of a block of anchors, and of a partition of rows.
BLOCK_BYTES, PARTITION_BYTES = 16 << 20, 32 << 20
LOWEST, HIGHEST = -(1 << 62), 1 << 62
NO_ID = (1 << 63) - 1


class Ball:
    """A tree of balls over the rows of a matrix. Rows are put in order so that a node is a run of them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.x, self.ids, self.rows = x.astype(np.float64), ids, rows
        self.centre, self.radius, self.run, self.below = [], [], [], []
        order = np.arange(len(x))
        todo = [(0, len(x), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            here = self.x[order[lo:hi]]
            c = here.mean(axis=0)
            away = np.sqrt(((here - c) ** 2).sum(axis=1))
            node = len(self.run)
            if parent >= 0:
                self.below[parent].append(node)
            self.centre.append(c)
            self.radius.append(away.max())
            self.run.append((lo, hi))
            self.below.append([])
            if hi - lo > leaf and away.max() > 0:
                far = here[away.argmax()]
                other = here[((here - far) ** 2).sum(axis=1).argmax()]
                middle = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(here @ (other - far), middle)]
                todo += [(lo, lo + middle, node), (lo + middle, hi, node)]
        self.x, self.ids, self.rows = self.x[order], ids[order], rows[order]
        self.ints = x[order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.size = np.abs(self.x).max(initial=0)


def products(q: np.ndarray, tree: Ball, lo: int, hi: int, size: float) -> np.ndarray:
    """Exact inner products: in floating point where every partial sum is an exact integer, else in whole numbers."""
    if size * tree.size * q.shape[1] < 2**53:
        return (q @ tree.x[lo:hi].T).astype(np.int64)
    whole = q.astype(object) @ tree.ints[lo:hi].astype(object).T
    if (abs(whole) >= HIGHEST).any():
        raise OverflowError("a score takes more than 62 bits")
    return whole.astype(np.int64)


class Best:
    """The best ``k`` rows of each slot (an anchor and a window) so far, by score and id."""

    def __init__(self, slots: int, k: int):
        self.k, self.last = k, np.full(slots, LOWEST, np.int64)
        self.held, self.waiting, self.size = [np.zeros(0, np.int64)] * 3, [], 0
        self.room = 2 * slots * k

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((slot, score, ids))
        self.size += len(slot)
        if self.size > self.room:
            self.cut()

    def cut(self) -> None:
        slot, score, ids = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        edge = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
        place = np.arange(len(slot)) - np.repeat(edge, np.diff(np.r_[edge, len(slot)]))
        keep = place < self.k
        full = place == self.k - 1
        self.last[slot[full]] = score[full]
        self.held, self.waiting, self.size = [slot[keep], score[keep], ids[keep]], [], 0


def search(tree: Ball, q: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best, slots: np.ndarray) -> int:
    """Puts the tree's rows into ``best`` that score between ``low`` and ``high`` (anchors x windows) with the
    anchors ``q``; the row of an anchor itself (``rows``) is not one of them. How many scores were computed."""
    norm, size, looked = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), np.abs(q).max(initial=0), 0
    qf, todo = q.astype(np.float64), [(0, np.arange(len(q)))]
    while todo:
        node, a = todo.pop()
        middle, reach = qf[a] @ tree.centre[node], norm[a] * tree.radius[node]
        slack = 0.5 + 1e-9 * (np.abs(middle) + reach)  # scores are whole numbers
        beneath = np.maximum(low[a], best.last[slots[a]])
        ok = ((middle + reach + slack)[:, None] >= beneath) & ((middle - reach - slack)[:, None] <= high[a]) & (low[a] <= high[a])
        a = a[ok.any(axis=1)]
        if not len(a):
            continue
        if tree.below[node]:
            near = sorted(tree.below[node], key=lambda n: (qf[a] @ tree.centre[n]).sum() + norm[a].sum() * tree.radius[n])
            todo += [(n, a) for n in near]  # the more promising one is opened first
            continue
        lo, hi = tree.run[node]
        score = products(q[a], tree, lo, hi, size)
        looked += score.size
        own = rows[a][:, None] == tree.rows[None, lo:hi]
        for w in range(low.shape[1]):
            hit = (score >= np.maximum(low[a, w], best.last[slots[a, w]])[:, None]) & (score <= high[a, w][:, None]) & ~own
            i, j = np.nonzero(hit)
            if len(i):
                best.add(slots[a[i], w], score[i, j], tree.ids[lo + j])
    return looked


def trees(batches: Iterator[pd.DataFrame], copies: int) -> dict[tuple[int, int], Ball]:
    """A tree for each label and length of the rows of a partition; of equal vectors, ``copies`` at most."""
    held: dict[tuple[int, int], list] = {}
    for b in batches:
        length, label = b["vector"].map(len).to_numpy(), b["label"].to_numpy()
        for key in sorted(set(zip(label.tolist(), length.tolist()))):
            d = b[(label == key[0]) & (length == key[1])]
            held.setdefault(key, []).append((np.stack(d["vector"].to_list()).astype(np.int64).reshape(len(d), key[1]), d["id"].to_numpy(), d["row"].to_numpy()))
    out = {}
    for key, parts in held.items():
        x, ids, rows = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((rows, ids))
        x, ids, rows = x[order], ids[order], rows[order]
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, max(1, x.shape[1]) * 8))).ravel(), return_inverse=True)[1].ravel() if x.shape[1] else np.zeros(len(x), np.int64)
        by = np.argsort(same, kind="stable")
        edge = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
        nth = np.empty(len(x), np.int64)
        nth[by] = np.arange(len(x)) - np.repeat(edge, np.diff(np.r_[edge, len(x)]))
        out[key] = Ball(x[nth < copies], ids[nth < copies], rows[nth < copies])
    return out


class Anchors:
    """A block of anchors by label and length, with the windows of scores that are looked for."""

    def __init__(self, held: pd.DataFrame, low: np.ndarray, high: np.ndarray):
        self.row, self.label = held["row"].to_numpy(np.int64), held["label"].to_numpy(np.int64)
        self.length = held["vector"].map(len).to_numpy() if len(held) else np.zeros(0, np.int64)
        self.vectors, self.low, self.high = list(held["vector"]), low, high

    def of(self, pick: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.flatnonzero(pick)
        q = np.stack([self.vectors[i] for i in at]).astype(np.int64)
        windows = self.low.shape[1]
        return q, self.row[at], self.low[at], self.high[at], at[:, None] * windows + np.arange(windows)


FOUND = "slot long, score long, id long, looked long"


def _searched(anchors, k: int, own_label: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = anchors.value
        best, looked = Best(a.low.size, k), 0
        for (label, length), tree in trees(batches, k + 1).items():
            pick = (a.length == length) & ((a.label == label) == own_label)
            if pick.any():
                q, rows, low, high, slots = a.of(pick)
                looked += search(tree, q, rows, low, high, best, slots)
        best.cut()
        slot, score, ids = best.held
        yield pd.DataFrame({"slot": slot, "score": score, "id": ids, "looked": 0})
        yield pd.DataFrame({"slot": [-1], "score": [0], "id": [0], "looked": [looked]})
        release()

    return run


def _found(rows: DataFrame, anchors: Anchors, k: int, own_label: bool) -> DataFrame:
    """``slot, place, score, id``: the first ``k`` of each slot over all partitions."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)
    found = stage(rows.mapInPandas(_searched(sent, k, own_label), FOUND), "negatives-found")
    place = F.row_number().over(W.partitionBy("slot").orderBy(F.col("score").desc(), "id"))
    return found.filter("slot >= 0").withColumn("place", place).filter(F.col("place") <= k)


def finite(vector: Column) -> Column:
    """A vector without a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def mine(table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", block_bytes: int = BLOCK_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its best
    ``positives`` rows of its label, the best ``negatives`` rows of other labels whose score is between ``low`` and
    ``high`` percent of the positive's. ``vector_col``: an array of longs."""
    spark = table.sparkSession
    named = table.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<bigint>").alias("vector"), (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("asks"))
    named = named.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    rows = stage(named, "negatives-rows", pack=False)
    n, width, asking = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1)), F.count_if("asks")).head()
    width = max(1, width)
    parts = max(spark.sparkContext.defaultParallelism, -(-n * width * 8 // partition_bytes))
    dealt = stage(rows.select("id", "label", "vector", "row").repartition(parts, "row"), "negatives-dealt", pack=False)
    blocks = -(-asking * width * 8 // block_bytes)
    out = None
    for k in range(blocks):
        block = rows.filter("asks").filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).select("id", "label", "vector", "row").orderBy("row").toPandas()  # about ``block_bytes``
        whole = np.ones((len(block), 1), np.int64)
        first = _found(dealt, Anchors(block, LOWEST * whole, HIGHEST * whole), positives, True).select("slot", "place", "score", "id").toPandas()  # ``positives`` an anchor
        at, nth = first["slot"].to_numpy(np.int64), first["place"].to_numpy(np.int64) - 1
        score, ids = np.zeros((len(block), positives), np.int64), np.full((len(block), positives), NO_ID)
        lowest, highest = np.ones((len(block), positives), np.int64), np.zeros((len(block), positives), np.int64)
        score[at, nth], ids[at, nth] = first["score"], first["id"]
        lowest[at, nth] = [-(-low * s // 100) for s in first["score"].tolist()]
        highest[at, nth] = [high * s // 100 for s in first["score"].tolist()]
        pairs = pd.DataFrame({"pslot": np.arange(score.size), "anchor_id": np.repeat(block["id"].to_numpy(np.int64), positives), "positive_id": ids.ravel(), "positive_score": score.ravel()})
        found = _found(dealt, Anchors(block, lowest, highest), negatives, False)
        pairs = F.broadcast(spark.createDataFrame(pairs, "pslot long, anchor_id long, positive_id long, positive_score long"))
        plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        got = found.join(pairs, F.col("slot") == F.col("pslot")).select("anchor_id", plain("positive_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).withColumn("negative_id", plain("negative_id"))
        got = stage(got, "negatives-mined")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
