"""Relational operators with explicit order: first wins, top-k, interval and fuzzy joins, reconciliation, sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import stage


def first_wins(rows: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; the filter limits the window before the shuffle."""
    out = rows.withColumn(rank or "__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank or "__r") <= k)
    return out if rank else out.drop("__r")


def seeds_from_mentions(mentions: DataFrame) -> DataFrame:
    """One seed an id, in the order of ``seq``: first label that is not empty, distinct pages and mentions."""
    listed = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), lambda v: v.isNotNull()))
    named = F.when(F.coalesce("label", F.lit("")) != "", F.col("label"))
    return mentions.filter(F.coalesce("kg_id", F.lit("")) != "").groupBy("kg_id").agg(F.min_by(named, F.when(named.isNotNull(), F.col("seq"))).alias("label"), listed("page").alias("pages"), listed("mention").alias("mentions"), F.lit(1.0).alias("weight"))


def merge_maps(rows: DataFrame, block: str, key: str, weight: str) -> DataFrame:
    """A12"""
    return rows.groupBy(block, key).agg(F.max(weight).alias(weight))


def interval_join(points: DataFrame, spans: DataFrame, t: str, lo: str, hi: str, on: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """Points within closed spans. With equal keys it is an equi-join; with ``width`` spans and points are dealt
    by buckets of that width (a long span is dealt once a bucket it touches), so neither side is broadcast."""
    if width is None:
        s = spans.withColumnsRenamed({c: f"__s_{c}" for c in on})
        cond = (F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi))
        for c in on:
            cond = cond & points[c].eqNullSafe(s[f"__s_{c}"])
        return points.join(s, cond).drop(*[f"__s_{c}" for c in on])
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    s = spans.withColumnsRenamed({c: f"__s_{c}" for c in on}).withColumn("__sb", F.explode(F.sequence(bucket(lo), bucket(hi))))
    p = points.withColumn("__b", bucket(t))
    cond = p["__b"] == s["__sb"]
    for c in on:
        cond = cond & p[c].eqNullSafe(s[f"__s_{c}"])
    return p.join(s, cond).filter((F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi))).drop("__b", "__sb", *[f"__s_{c}" for c in on])


def stage_windows(marks: DataFrame, by: Sequence[str], order: str, done: str, start: str) -> DataFrame:
    """A stage begins where the one before it ended, the first where the run began."""
    return marks.withColumn("t0", F.coalesce(F.lag(done).over(W.partitionBy(*by).orderBy(order)), F.col(start))).withColumn("t1", F.col(done))


def stage_peaks(samples: DataFrame, stages: DataFrame, t: str, value: str, on: Sequence[str], name: str) -> DataFrame:
    """A21"""
    j = interval_join(samples, stages, t, "t0", "t1", on)
    return j.groupBy(*on, name).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))


def held_in(inner: DataFrame, outer: DataFrame, inner_text: str, outer_text: str, size: int = 3) -> DataFrame:
    """Pairs where the text of ``inner`` is a part of that of ``outer``, without looking at every pair.

    A text is a part of another only if its rarest piece of ``size`` letters is (or the whole of it, if it is shorter), so
    pieces meet by an equi-join and only those pairs are tested. Of the outer texts only pieces that an inner one has are
    counted and joined. The key columns of the two sides must differ in name."""
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(*[F.when(F.length(outer_text) >= n, pieces(F.col(outer_text), n)).otherwise(none) for n in range(1, size + 1)]))
    own = F.when(F.length("__t") >= size, F.array_distinct(pieces(F.col("__t"), size))).otherwise(F.array("__t"))
    texts = inner.select(F.col(inner_text).alias("__t")).distinct().select("__t", F.explode(own).alias("__p"))
    o = outer.withColumn("__p", F.explode(every)).join(texts.select("__p").distinct(), "__p", "left_semi")
    count = o.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    rare = texts.join(count, "__p", "left").groupBy("__t").agg(F.min_by("__p", F.struct(F.coalesce("__n", F.lit(0)), F.col("__p"))).alias("__p"))
    return inner.join(rare, F.col(inner_text) == F.col("__t")).drop("__t").join(o, "__p").filter(F.col(outer_text).contains(F.col(inner_text))).drop("__p")


#: Rows of a key from which it is split, and the share of all rows that a key split has at least.
SPLIT_ROWS, SPLIT_SHARE = 100_000, 2000


def split_join(many: DataFrame, few: DataFrame, key: str, split: int = SPLIT_ROWS) -> DataFrame:
    """Inner join by ``key``, of which ``many`` may hold any number of rows: those of a hot key are dealt to several
    tasks, each of which gets the rows of ``few``. A hot key has more than ``split`` rows and a 2,000th of all, so the list
    of them that is broadcast has fewer than 2,000 entries."""
    counts = stage(many.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "key-counts")
    least = max(split, (counts.agg(F.sum("__n")).head()[0] or 0) // SPLIT_SHARE)
    hot = F.broadcast(counts.filter(F.col("__n") > least).select(F.col(key).alias("__k"), F.ceil(F.col("__n") / least).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = many.join(hot, F.col(key) == F.col("__k"), "left").withColumn("__salt", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("__k", "__parts")
    right = few.join(hot, F.col(key) == F.col("__k"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__k", "__parts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\W+"), lambda x: x != ""))


def _contained(inner: DataFrame, outer: DataFrame, split: int) -> DataFrame:
    """``x, y``: texts of ``inner`` that may be a part of texts of ``outer``.

    Each token of a text is within one token of any text that holds it, so the two vocabularies are matched
    first, each token once; a text then meets others through the one of its tokens that fewest of them have within theirs."""
    it, ot = inner.select(F.col("text").alias("x"), F.size("words").alias("size"), F.explode("words").alias("t")), stage(outer.select(F.col("text").alias("y"), F.explode("words").alias("u")), "outer-tokens")
    known = ot.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    within = stage(held_in(it.select("t").distinct(), known, "t", "u", 6), "within")
    reach = within.groupBy("t").agg(F.sum("n").alias("n"))
    anchor = it.join(reach, "t").groupBy("x").agg(F.min_by("t", F.struct("n", "t")).alias("t"), F.count(F.lit(1)).alias("found"), F.first("size").alias("size")).filter("found = size")
    return split_join(ot, anchor.select("x", "t").join(within.select("t", "u"), "t").select("x", "u"), "u", split).select("x", "y")


def _subset(inner: DataFrame, outer: DataFrame, split: int) -> DataFrame:
    """``x, y``: texts of ``inner`` all of whose tokens may be among those of texts of ``outer``: by the token that fewest
    of these have."""
    it, ot = inner.select(F.col("text").alias("x"), F.size("words").alias("size"), F.explode("words").alias("u")), stage(outer.select(F.col("text").alias("y"), F.explode("words").alias("u")), "outer-tokens")
    known = ot.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    rare = it.join(known, "u").groupBy("x").agg(F.min_by("u", F.struct("n", "u")).alias("u"), F.count(F.lit(1)).alias("found"), F.first("size").alias("size")).filter("found = size")
    return split_join(ot, rare.select("x", "u"), "u", split).select("x", "y")


def candidate_pairs(left: DataFrame, right: DataFrame, split: int = SPLIT_ROWS) -> DataFrame:
    """``x, y``: pairs of distinct texts (``text``, ``words``) that ``text_pairs`` has to test, each once."""
    flip = lambda d: d.select(F.col("y").alias("x"), F.col("x").alias("y"))
    legs = _contained(left, right, split).unionByName(flip(_contained(right, left, split))).unionByName(_subset(left, right, split)).unionByName(flip(_subset(right, left, split)))
    bare = lambda d, name: d.filter(F.size("words") == 0).select(F.col("text").alias(name))  # noqa: E731  nothing but signs
    if not bare(left, "x").isEmpty():
        legs = legs.unionByName(held_in(bare(left, "x"), right.select(F.col("text").alias("y")), "x", "y").select("x", "y"))
    if not bare(right, "y").isEmpty():
        legs = legs.unionByName(held_in(bare(right, "y"), left.select(F.col("text").alias("x")), "y", "x").select("x", "y"))
    return legs.distinct()


def texts_of(rows: DataFrame, column: str) -> DataFrame:
    """The distinct texts of a column that are not empty, with their tokens, staged."""
    return stage(rows.select(F.col(column).alias("text")).filter("text <> ''").distinct().withColumn("words", token_set(F.col("text"))), "texts")


def text_pairs(left: DataFrame, right: DataFrame, split: int = SPLIT_ROWS) -> DataFrame:
    """``x, y, status`` of pairs of distinct texts (from ``texts_of``) where one contains the other, or all tokens of one
    are among the other's. Each text is joined once, however many rows have it."""
    xt, yt = token_set(F.col("x")), token_set(F.col("y"))
    inside = F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x"))
    subset = (F.size(F.array_except(xt, yt)) == 0) & (F.size(xt) > 0) | (F.size(F.array_except(yt, xt)) == 0) & (F.size(yt) > 0)
    pairs = candidate_pairs(left, right, split).filter(inside | subset)
    return pairs.withColumn("status", F.when(F.col("x") == F.col("y"), "exact").otherwise("partial"))


def theta_match(gold: DataFrame, mentions: DataFrame, gold_text: str, mention_text: str) -> DataFrame:
    """``status`` of pairs where one text contains the other, or all tokens of one are among the other's, for every
    row of either side. Equi-joins all: no side is broadcast, no pair is looked at that shares no rare token."""
    pairs = text_pairs(texts_of(gold, gold_text), texts_of(mentions, mention_text))
    return mentions.join(pairs, F.col(mention_text) == F.col("y")).join(gold, F.col("x") == F.col(gold_text)).select(*mentions.columns, *gold.columns, "status")


def cognate_match(forms: Column, tokens: Column) -> Column:
    """Some form all of whose words are in the text or share five first letters with a word of it."""
    near = lambda w: F.exists(tokens, lambda t: (t == w) | ((F.length(w) >= 5) & (F.length(t) >= 5) & (F.substring(t, 1, 5) == F.substring(w, 1, 5))))
    return F.exists(forms, lambda f: F.forall(F.filter(F.split(f, r"\W+"), lambda x: x != ""), near))


def reconcile(source: DataFrame, derived: DataFrame, key: str, cells: Sequence[str]) -> DataFrame:
    """Cells that differ between two tables of one key, as ``key, cell, source, derived``; nulls are values."""
    long = lambda d, name: d.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).cast("string").alias(name)) for c in cells])).alias("x")).select(key, "x.*")
    j = long(source, "source").withColumn("in_s", F.lit(True)).join(long(derived, "derived").withColumn("in_d", F.lit(True)), [key, "cell"], "full")
    return j.filter(~F.col("source").eqNullSafe(F.col("derived")) | F.col("in_s").isNull() | F.col("in_d").isNull()).select(key, "cell", "source", "derived")


def regions(members: DataFrame, sets: Sequence[str]) -> DataFrame:
    """``item, set_name`` -> size of each region of the Venn diagram, named by the sets that hold its items."""
    held = members.filter(F.col("set_name").isin(*sets)).groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("set_name")), "&").alias("region"))
    return held.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def jaccard(members: DataFrame, most: int = 1000) -> DataFrame:
    """Jaccard of each pair of sets, of which there are few (at most ``most``, checked). The sets of an item are
    one short list, from which its pairs are taken, so no item is joined with itself."""
    m = members.select("set_name", "item").distinct()
    n = m.groupBy("set_name").agg(F.count(F.lit(1)).alias("n"))
    if n.count() > most:
        raise ValueError(f"more than {most} sets: their pairs are a matrix for reading")
    held = m.groupBy("item").agg(F.array_sort(F.collect_list("set_name")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    pair = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("set_name"), b.alias("other")))))
    both = held.select("k", F.explode(pair).alias("p")).groupBy("p.set_name", "p.other").agg(F.sum("k").alias("both"))
    pairs = n.join(F.broadcast(n.select(F.col("set_name").alias("other"), F.col("n").alias("n2"))), F.col("set_name") < F.col("other"))
    j = pairs.join(both, ["set_name", "other"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return j.select("set_name", "other", "both", (F.col("both") / (F.col("n") + F.col("n2") - F.col("both"))).alias("jaccard"))


def custom_order(rows: DataFrame, column: str, order: Sequence[str], out: str = "place") -> DataFrame:
    """Place in a list, unknown values last."""
    e = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        e = F.when(F.col(column) == v, i).otherwise(e)
    return rows.withColumn(out, e)


def number_repeats(rows: DataFrame, stem: str, order: str, out: str = "name") -> DataFrame:
    """``x``, ``x_2``, ``x_3`` in order of arrival."""
    n = F.row_number().over(W.partitionBy(stem).orderBy(order))
    return rows.withColumn(out, F.when(n == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("_"), n.cast("string"))))


def carry_over(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Old rows of the keys that the new ones lack."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def draw_key(key: str, seed: int) -> Column:
    """A seeded digest of a key: the same in every engine, whatever the partitions."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 77) -> DataFrame:
    """N rows in the order of a seeded digest."""
    return rows.orderBy(draw_key(key, seed), key).limit(n)


def weighted_order(rows: DataFrame, key: str, weight: str, seed: int = 77) -> DataFrame:
    """Keys of weighted random order, u ** (1 / (1 + weight)) with u from a seeded digest."""
    u = (F.conv(F.substring(draw_key(key, seed), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return rows.withColumn("draw", F.round(F.pow(u, 1 / (1 + F.col(weight))), 12))


def review(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """``send`` of each mention (yes where nobody decided); an unknown decision is an error; dropped ones go."""
    d = decisions.select("text", "type", F.lower(F.trim("send")).alias("send"))
    checked = F.when(F.col("send").isNull(), "yes").when(F.col("send").isin("yes", "local", "drop"), F.col("send")).otherwise(F.raise_error(F.concat(F.lit("unknown decision: "), F.col("send"))))
    return mentions.join(d, ["text", "type"], "left").withColumn("send", checked).filter("send <> 'drop'")


def overlapping_boxes(boxes: DataFrame, cell: float = 100.0) -> DataFrame:
    """Pairs of boxes ``id, x0, x1, y0, y1`` that overlap by more than half a unit, found on a grid of cells."""
    at = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    g = boxes.withColumn("cx", F.explode(at("x0", "x1"))).withColumn("cy", F.explode(at("y0", "y1")))
    h = g.select(*[F.col(c).alias(f"o_{c}") for c in ("id", "x0", "x1", "y0", "y1")], "cx", "cy")
    hit = (F.col("id") < F.col("o_id")) & (F.col("x0") + 0.5 < F.col("o_x1")) & (F.col("o_x0") + 0.5 < F.col("x1")) & (F.col("y0") + 0.5 < F.col("o_y1")) & (F.col("o_y0") + 0.5 < F.col("y1"))
    return g.join(h, ["cx", "cy"]).filter(hit).select("id", "o_id").distinct()


def heat_matrix(rows: DataFrame, row: str, column: str, value: str, columns: list, cap: int, least: int = 25) -> DataFrame:
    """Counts by category and graph; categories at the cap everywhere, or of few nodes, are left out."""
    m = rows.groupBy(row).pivot(column, columns).agg(F.sum(value)).fillna(0)
    total = sum((F.col(str(c)) for c in columns), F.lit(0))
    capped = F.lit(True)
    for c in columns:
        capped = capped & (F.col(str(c)) >= cap)
    return m.withColumn("total", total).filter((F.col("total") >= least) & ~capped)


def wanted(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Attributes of a short list of ids from a large table, which is filtered by the list, not
    indexed; Spark broadcasts the list if it is as short as it should be."""
    return table.join(ids.select(key).distinct(), key)


def export_order(kept: DataFrame) -> DataFrame:
    """By category, best score first; ties by node."""
    return kept.orderBy("category", F.desc("score"), "node")
