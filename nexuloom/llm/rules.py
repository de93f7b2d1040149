"""Quality rules with verdicts on hosts (DataFrame functions only, no shuffle of texts).

The counts of a document are array expressions over its own words, so a text never leaves its row. A host (the source,
or the host of a url) fails as often as its documents do; its rate is shrunk towards all hosts by a beta prior fitted
to the hosts' rates, and hosts whose shrunk rate is above a limit have all their documents turned down.

Defined cases: a null or empty text has no words and fails; a text may have 2**31 words, as many as an array can hold; a
null host is a host of its own; a host whose shrunk rate equals the limit is kept; repeated rows count each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stage

SALTS = 16
#: Bits of a word's place: arrays have no more entries than these can count.
PLACE = 31


def base_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` beside the columns in ``keep``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*keep, text.alias("__t")).withColumn("__w", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0))).withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD)))
    n = F.size("__w")
    # Each 3-word window as one long: 33 bits of its hash and 31 bits of its place; sorted, equal hashes are neighbours.
    windows = F.transform(
        F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, F.greatest(n, F.lit(1))).alias("b"), F.slice("__w", 3, F.greatest(n, F.lit(1))).alias("c")),
        lambda z, i: F.shiftleft(F.xxhash64(z["a"], z["b"], z["c"]), PLACE).bitwiseOR(i.cast("long")),
    )
    d = d.withColumn("__x", F.when(n >= 3, F.sort_array(F.slice(windows, 1, n - 2))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("__y", F.concat(F.slice("__x", 2, F.greatest(F.size("__x"), F.lit(1))), F.array(F.lit(None).cast("bigint"))))
    top = lambda x: F.shiftrightunsigned(x, PLACE)
    twins = F.filter(F.zip_with("__x", "__y", lambda a, b: F.when(top(a) == top(b), a)), lambda a: a.isNotNull())
    d = d.withColumn("__first", F.when(F.size("__x") > 0, twins).otherwise(F.array().cast("array<bigint>")))
    follow = F.filter(F.zip_with("__x", "__y", lambda a, b: F.when(top(a) == top(b), b)), lambda a: a.isNotNull())
    places = F.array_distinct(F.concat(F.col("__first"), F.when(F.size("__first") > 0, follow).otherwise(F.array().cast("array<bigint>"))))
    d = d.withColumn("__p", places)
    # equal hashes are only candidates: the words of the candidates decide
    at = lambda p: p.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    strings = F.sort_array(F.transform("__p", lambda p: F.struct(F.array_join(F.slice("__w", at(p) + 1, 3), " ").alias("s"), at(p).alias("i"))))
    d = d.withColumn("__s", F.when(F.size("__p") > 0, strings))
    nxt = F.concat(F.slice("__s", 2, F.greatest(F.size("__s"), F.lit(1))), F.array(F.lit(None).cast("struct<s:string,i:int>")))
    pairs = F.filter(F.zip_with("__s", nxt, lambda a, b: F.when(a["s"] == b["s"], F.array(a["i"], b["i"]))), lambda a: a.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(pairs)), lambda i: F.array(i, i + 1, i + 2)))))
    return d.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    """Rules beside the base rule; each adds to a host's evidence, none turns a document down by itself."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": ~(F.col("word_chars") / words).between(2, 15),
        "symbols": F.col("n_symbols") > F.lit(0.5) * words,
        "dup_lines": F.col("n_dup_lines") > 20,
    }


def host_verdicts(counts: DataFrame, host: str, limit: float = 0.5) -> DataFrame:
    """``h_host, n_docs, fail_rate, shrunk_rate, host_ok``; one row a host.

    The prior is beta(a, b) with the mean and spread of the hosts' rates (method of moments, at least one and at most
    1,000 documents strong). Rows are summed by host and salt first, so a hot host is not one task.
    """
    bad = F.when(F.col("base_failed") | F.col("rule_failed"), 1).otherwise(0)
    cells = counts.groupBy(host, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("k"))
    hosts = cells.groupBy(F.col(host).alias("h_host")).agg(F.sum("n").alias("n_docs"), F.sum("k").alias("k")).withColumn("fail_rate", F.col("k") / F.col("n_docs"))
    prior = hosts.agg(F.sum("k").alias("k"), F.sum("n_docs").alias("n"), F.var_pop("fail_rate").alias("v"), F.avg(1 / F.col("n_docs")).alias("inv")).head()
    mean = (prior["k"] or 0) / prior["n"] if prior["n"] else 0.0
    noise = mean * (1 - mean) * (prior["inv"] or 0.0)  # the part of the spread that sampling alone makes
    spread = max((prior["v"] or 0.0) - noise, 0.0)
    strength = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
    shrunk = (F.col("k") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("h_host", "n_docs", "fail_rate", shrunk.alias("shrunk_rate"), (shrunk <= limit).alias("host_ok"))


def judge(docs: DataFrame, host: Column | None = None, limit: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts, ``base_failed``, ``rule_failed``, the host's shrunk rate and ``kept`` of every document."""
    host = F.col("source") if host is None else host
    named = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), F.col(text_col).alias("text"))
    counts = base_counts(named, "text", ("doc_id", "host"))
    counts = counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rule = F.lit(False)
    for failed in failures().values():
        rule = rule | failed
    counts = stage(counts.withColumn("rule_failed", rule), "rule-counts", pack=False)
    verdicts = host_verdicts(counts, "host", limit).withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    j = salted.join(verdicts, salted["host"].eqNullSafe(verdicts["h_host"]) & (salted["salt"] == verdicts["h_salt"]))
    return j.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("salt", "h_salt", "h_host", "n_docs")
