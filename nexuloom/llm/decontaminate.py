"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Numbers, names (capitalised words inside a sentence) and units after numbers become typed placeholders. Windows of
five template words are hash-joined with the benchmark's windows; windows of both sides have the hash of their plain
words as well, so a passage whose placeholders are typed differently (lost capitals, quoted mid-sentence) is still found. Matches lie on diagonals (place in the document minus place in the
item). On each diagonal the values in the slots must be consistent: a value of the item always stands for the same
value of the document. An item is in a document if the consistent diagonals cover at least ``least`` of its windows.

Where four or five words of a window are placeholders, its template says too little; its key then takes in the two next
plain words after the window's start, or the two last before its end, and how far off they are. An item of fewer than
two plain words is found by its plain words only: any other numbers would match it.

Defined cases: null or empty texts match nothing; texts of any length are compared whole; an item of fewer than five
words is found only where it is the whole text; repeated rows of one id give one row, windows of different rows never
count together; documents with a null id are found under the null id, and items too; repeated items are items each; of
several rows of one id and item the best coverage is given; a document may hold several items; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, stage, unused

WINDOW = 5
NUMBER, NAME, UNIT = "#", "@", "~"
MARK = ""
#: Units of measure that are placeholders after a number: fixed values.
UNITS = "km kilometers kilometres m meters metres cm mm miles mile feet foot ft inches inch in kg kilograms g grams mg lb lbs pounds oz liters litres l ml gallons hours hour h minutes minute min seconds second s days day weeks week months month years year dollars euros cents percent degrees mph kmh kph".split()
#: Four placeholders among five words of a template.
DENSE = "(?:^| )(?:X X X X|X [^ ]+ X X X|X X [^ ]+ X X|X X X [^ ]+ X)(?= |$)".replace("X", f"[{NUMBER}{NAME}{UNIT}]")
#: A benchmark with more windows than this is not broadcast but shuffled, a window's hash in so many parts.
BROADCAST_WINDOWS, SALTS = 500_000, 16
#: Groups of words that tell of an item; words that documents are asked for at most, a benchmark with more meets them all.
GROUPS, TELLING_WORDS = 3, 5_000


def canonical(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys, __p, __q``: plain and template words as blank-joined lines of equally many words."""
    marked = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?<=[\p{Ll}\p{N},;] )(?=\p{Lu}\p{Ll})", MARK)
    d = rows.select(*keys, F.trim(F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{MARK}]+", " ")).alias("__l")).filter(F.col("__l") != "")
    template = F.regexp_replace("__l", rf"(?<![\p{{L}}\p{{N}}{MARK}])\p{{N}}[\p{{L}}\p{{N}}]*", NUMBER)
    template = F.lower(F.regexp_replace(template, rf"{MARK}[\p{{L}}\p{{N}}]+", NAME))
    d = d.select(*keys, F.lower(F.replace("__l", F.lit(MARK), F.lit(""))).alias("__p"), template.alias("__q"))
    unit = F.regexp_replace("__q", rf"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", UNIT)
    return d.select(*keys, "__p", F.when(F.col("__q").contains(NUMBER), unit).otherwise(F.col("__q")).alias("__q"))


def plain_around(v: Column) -> tuple[Column, Column]:
    """Of template words: for each place the next two plain words from it on, and the last two up to it, with their
    places; null where there are not two. Linear in the words, however long a run of placeholders is."""
    n = F.size(v)
    at = F.filter(F.transform(v, lambda x, i: F.when(~x.isin(NUMBER, NAME, UNIT), F.struct(i.alias("i"), x.alias("x")))), lambda x: x.isNotNull())
    none = F.lit(None).cast("struct<i:int,x:string>")
    start, end = F.struct(F.lit(-1).alias("i"), F.lit("").alias("x")), F.struct(n.alias("i"), F.lit("").alias("x"))
    steps = F.arrays_zip(F.concat(F.array(start), at).alias("a"), F.concat(at, F.array(end)).alias("b"), F.concat(F.slice(at, 2, 1 << 30), F.array(none, none)).alias("c"), F.concat(F.array(none, none), at).alias("z"))
    after = lambda t: F.array_repeat(F.when(t["c"].isNotNull(), F.struct(t["b"].alias("p"), t["c"].alias("q"))), F.least(t["b"]["i"], n - 1) - t["a"]["i"])
    # a and z lie one plain word apart: z is the one before a
    before = lambda t: F.array_repeat(F.when(t["z"].isNotNull(), F.struct(t["z"].alias("p"), t["a"].alias("q"))), F.when(t["a"]["i"] < 0, t["b"]["i"]).otherwise(t["b"]["i"] - t["a"]["i"]))
    whole = F.filter(steps, lambda t: t["a"].isNotNull() & t["b"].isNotNull())
    return F.flatten(F.transform(whole, after)), F.flatten(F.transform(whole, before))


def windows(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys, place, h, plain5, slots5, told5``: ``plain5, slots5`` only where there are placeholders; ``told5`` are the
    plain words that are none.

    A window has the hash of its plain words and, if one to three of its words are placeholders, that of its template.
    If more are, it has the hashes of its template with the plain words around. A text of fewer words is one window.
    """
    d = canonical(rows, keys, text_col).select(*keys, F.split("__p", " ").alias("__w"), F.when(F.col("__p") != F.col("__q"), F.split("__q", " ")).alias("__v"), F.col("__q").rlike(DENSE).alias("__dense"))
    after, before = plain_around(F.col("__v"))
    nothing = F.array().cast("array<struct<p:struct<i:int,x:string>,q:struct<i:int,x:string>>>")
    d = d.withColumn("__after", F.when(F.col("__dense"), after).otherwise(nothing)).withColumn("__before", F.when(F.col("__dense"), F.slice(before, WINDOW, 1 << 30)).otherwise(nothing))
    d = d.withColumn("__v", F.coalesce("__v", "__w"))
    shifted = [F.slice(c, i + 1, 1 << 30).alias(f"{n}{i}") if i else F.col(c).alias(f"{n}{i}") for c, n in (("__w", "p"), ("__v", "q")) for i in range(WINDOW)]
    shifted += [F.col("__after").alias("after"), F.col("__before").alias("before")]
    w = d.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("place", "z")).filter(F.col(f"z.p{WINDOW - 1}").isNotNull() | (F.col("place") == 0))
    p, q = ([F.col(f"z.{n}{i}") for i in range(WINDOW)] for n in "pq")
    held = sum((F.when(x.isin(NUMBER, NAME, UNIT), 1).otherwise(0) for x in q), F.lit(0))
    few, many = held.between(1, WINDOW - 2), held > WINDOW - 2
    around = lambda n: F.when(many & F.col(f"z.{n}").isNotNull(), F.xxhash64(F.lit(n), *q, F.col(f"z.{n}.p.i") - F.col("place"), F.col(f"z.{n}.p.x"), F.col(f"z.{n}.q.i") - F.col("place"), F.col(f"z.{n}.q.x")))
    keyed = w.select(*keys, "place", F.xxhash64(*p).alias("hp"), F.when(few, F.xxhash64(*q)).alias("hq"), around("after").alias("ha"), around("before").alias("hb"), F.when(held > 0, F.array(*p)).alias("plain5"), F.when(held > 0, F.array(*q)).alias("slots5"), F.array_compact(F.array(*[F.when(~y.isin(NUMBER, NAME, UNIT), x) for x, y in zip(p, q)])).alias("told5"))
    return keyed.select(*keys, "place", F.explode(F.array_compact(F.array("hp", "hq", "ha", "hb"))).alias("h"), "plain5", "slots5", "told5")


def telling_words(b: DataFrame, least: float) -> dict[str, list[int]] | None:
    """Words that a text with an item must have: ``b`` has windows of items and ``n_windows``. Item ``i`` has ``GROUPS``
    groups of words, and a text that holds it has a word of each; a word comes with the numbers ``i * GROUPS + group`` of
    its groups. None if there are too many, or an item has no such group.

    An item needs ``least`` of its windows, so one of any ``n_windows * (1 - least) + 1`` of them is in the text, and with
    it, by whichever key, the window's plain words; the longest one stands for it. Windows of longer words go to earlier
    groups. Placeholders tell nothing, nor do words that lower case spells by what stands around."""
    told = F.array_max(F.transform(F.filter("told5", lambda x: x.rlike(r"^[\p{L}\p{N}&&[^σς]]+$")), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    each = b.dropDuplicates(["item_key", "item_place"]).select("item_key", "item_place", "n_windows", told.alias("told"))
    w = W.partitionBy("item_key").orderBy(F.col("told.n").desc_nulls_last(), "told.x", "item_place")
    size = F.floor(F.col("n_windows") * (1 - least)) + 2  # one more than needed: quotients are rounded
    each = each.withColumn("group", F.floor((F.row_number().over(w) - 1) / size))
    each = each.filter(F.col("group") < F.greatest(F.lit(1), F.least(F.lit(GROUPS), F.floor(F.col("n_windows") / size))))
    found = each.select("item_key", "group", "told.x").distinct().limit(TELLING_WORDS + 1).collect()
    if len(found) > TELLING_WORDS:
        return None
    items: dict[int, dict[int, set]] = {}
    for r in found:
        items.setdefault(r["item_key"], {}).setdefault(r["group"], set()).add(r["x"])
    out: dict[str, list[int]] = {}
    for i, groups in enumerate(items.values()):
        whole = [words for words in groups.values() if None not in words]
        if not whole:
            return None
        for k in range(GROUPS):  # where there are fewer, one counts again
            for word in whole[min(k, len(whole) - 1)]:
                out.setdefault(word, []).append(i * GROUPS + k)
    return out


def having(docs: DataFrame, text_col: str, words: dict[str, list[int]]) -> DataFrame:
    """The rows whose text has, for some item, a word of each group; its words are told apart as in ``canonical``."""
    split = F.split(F.lower(F.replace(F.col(text_col), F.lit(MARK), F.lit(""))), r"[^\p{L}\p{N}]+")
    table = F.from_json(F.lit(json.dumps(words)), "map<string,array<int>>")  # a literal to the plan
    met = F.flatten(F.transform(F.array_distinct(F.filter(split, lambda x: x.isin(list(words)))), lambda x: table[x]))
    every = lambda c, m: reduce(lambda a, k: a & F.array_contains(m, c + k), range(1, GROUPS), c % GROUPS == 0)
    return docs.filter(F.exists(F.array(met), lambda m: F.exists(m, lambda c: every(c, m))))


def matches(docs: DataFrame, keys: list[str], benchmark: DataFrame, least: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``keys, item_id, item_key, covered, n_windows, n_slots``: one row for each item found in a row of ``docs``, which
    ``keys`` tell apart."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text"))
    items = stage(items.withColumn("item_key", F.monotonically_increasing_id()), "items")  # a number tells items apart, whatever they hold
    b = windows(items, ["item_id", "item_key"], "item_text").withColumnsRenamed({"place": "item_place", "plain5": "item_plain", "slots5": "item_slots"}).dropDuplicates(["item_key", "item_place", "h"])
    whole = b.groupBy("item_key").agg(F.countDistinct("item_place").alias("n_windows")).withColumnRenamed("item_key", "k")
    b = b.join(whole, F.col("item_key") == F.col("k")).drop("k")
    d, few = docs.select(*keys, F.col(text_col).alias("doc_text")), b.count() <= broadcast_windows
    words, b = telling_words(b, least) if few else None, b.drop("told5")
    d = windows(d if words is None else having(d, "doc_text", words), keys, "doc_text").drop("told5")
    if few:
        hits = d.join(F.broadcast(b), "h")
    else:  # a window may be in any share of the documents
        salted = b.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
        hits = d.withColumn("salt", F.pmod(F.xxhash64("place", *keys), F.lit(SALTS))).join(salted, ["h", "salt"])
    both = F.col("plain5").isNotNull() & F.col("item_slots").isNotNull()  # on equal plain keys there is nothing to compare
    values = F.filter(F.arrays_zip(F.col("item_slots").alias("kind"), F.col("item_plain").alias("item"), F.col("plain5").alias("doc")), lambda z: z["kind"].isin(NUMBER, NAME, UNIT))
    pairs = F.coalesce(F.when(both, F.transform(values, lambda z: F.struct(z["kind"].alias("kind"), z["item"].alias("item"), z["doc"].alias("doc")))), F.array().cast("array<struct<kind:string,item:string,doc:string>>"))
    hits = hits.select(*keys, "item_id", "item_key", "n_windows", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_place", pairs.alias("pairs"))
    one = [*keys, "item_id", "item_key", "n_windows"]
    lines = hits.groupBy(*one, "diagonal").agg(F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["item"])))) == F.size("pairs")
    found = lines.filter(consistent).groupBy(*one).agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.max(F.size("pairs")).alias("n_slots"))
    return found.filter(F.col("covered") / F.col("n_windows") >= least)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, item_id, coverage, n_windows, n_slots``: one row for each item found in a document."""
    rows, row = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text")))
    found = matches(rows, ["doc_id", row], benchmark, least, "doc_text", **options).withColumn("coverage", F.col("covered") / F.col("n_windows"))
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("n_windows").cast("long").alias("n_windows"), F.max("n_slots").cast("long").alias("n_slots"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text_col: str = "text", **options) -> DataFrame:
    """The rows that hold no item, all columns kept; a row that shares its id with one that does stays."""
    rows, row = numbered(docs)
    bad = unused("__bad", rows)
    named = rows.select(row, F.col(text_col).alias("doc_text"))
    found = matches(named, [row], benchmark, least, "doc_text", **options).select(F.col(row).alias(bad)).distinct()
    return rows.join(found, F.col(row) == F.col(bad), "left_anti").select(*[f"`{c}`" for c in docs.columns])
