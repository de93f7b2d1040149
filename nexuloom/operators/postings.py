"""A stored inverted index with score bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..staging import cached, stage
from .relational import split_join, top_k

#: Documents of a block, and blocks of a query that are scored to learn what its k-th score is at least.
BLOCK, FIRST = 128, 4
#: What a sum of doubles may be off by.
SLACK = 1e-6


def posting_blocks(docs: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """``doc, text`` -> ``term, block, idf, most, n, entries``: the documents of a block that hold the term, each with its
    length factor, and the largest score that the term gives to one of them.

    Blocks are runs of documents sorted by the least hash of their tokens, so copies and texts of like words lie together
    and few blocks score high. A row has at most 128 entries, however frequent its term is."""
    t = docs.select("doc", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t")).withColumn("near", F.array_min(F.transform("t", lambda x: F.xxhash64(x))))
    sorted_ = t.repartitionByRange("near", "len", "doc").sortWithinPartitions("near", "len", "doc")
    t = stage(sorted_.withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}")), "tokens")
    corpus = t.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))
    norm = (k1 + 1) / (1 + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    entry = F.struct("doc", "norm")
    rows = t.join(F.broadcast(corpus)).withColumn("norm", norm).select("block", "doc", "norm", F.explode("t").alias("term"))  # one row
    rows = stage(rows.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.collect_list(entry).alias("entries")), "blocks")
    df = rows.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(corpus))
    raw = df.withColumn("raw", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return _by_term(rows, stage(idf, "idf")).select("term", "block", "idf", F.greatest(F.col("idf") * F.col("top"), F.lit(0.0)).alias("most"), "n", "entries")


#: Terms of a list that is broadcast at most.
MOST_TERMS = 100_000


def _by_term(many: DataFrame, few: DataFrame) -> DataFrame:
    """Inner join by term; a short list is broadcast, so that rows with their entries stay where they are."""
    return many.join(F.broadcast(few), "term") if few.count() <= MOST_TERMS else split_join(many, few, "term")


class Index:
    """Posting blocks on disk, made once for each content of the documents and each set of parameters."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def over(cls, docs: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, folder: str | None = None) -> Index:
        docs = docs.select("doc", "text")
        return cls(cached(docs.sparkSession, "postings", [docs], [k1, b, epsilon, BLOCK], lambda: posting_blocks(docs, k1, b, epsilon), folder))

    def search(self, queries: DataFrame, k: int, report: dict | None = None) -> DataFrame:
        """``query, text`` -> ``query, doc, score, rank``: what ``retrieval.bm25`` gives for documents of unique ids.

        A block can give a document no more than the sum of its terms' bounds. The blocks of the highest sums are scored
        first; their k-th score is a floor, and of the others only blocks whose sum reaches it are scored. Bounds are
        read without the entries. ``report`` gets the postings scored and those that hold a term of the query."""
        asked = stage(queries.select("query", F.explode(tokens(F.col("text"))).alias("term")), "asked")
        bounds = _by_term(self.table.select("term", "block", "most", "n"), asked)
        reach = stage(bounds.groupBy("query", "block").agg(F.sum("most").alias("reach"), F.sum("n").alias("n")).filter("reach > 0"), "reach")

        def scored(blocks: DataFrame) -> DataFrame:
            # entries move once, to their block, not once a query; a document lies in one block, so sums are made there
            need = blocks.groupBy("block").agg(F.collect_set("query").alias("by"))
            held = self.table.select("term", "block", "idf", "entries").join(asked.select("term").distinct(), "term", "left_semi").join(need, "block")
            each = _by_term(held, asked).filter(F.array_contains("by", F.col("query"))).select("query", "block", "idf", F.explode("entries").alias("e"))
            s = each.groupBy("query", "block", F.col("e.doc").alias("doc")).agg(F.round(F.sum(F.col("idf") * F.col("e.norm")), 9).alias("score"))
            return s.filter("score > 0").drop("block")

        head = stage(top_k(reach, ["query"], [F.desc("reach"), "block"], FIRST, "place").select("query", "block", "n"), "head")
        one = stage(top_k(scored(head), ["query"], [F.desc("score"), "doc"], k, "place").select("query", "doc", "score"), "first")
        floor = one.groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).select("query", F.when(F.col("found") >= k, F.col("least") - SLACK).otherwise(0.0).alias("floor"))
        rest = reach.join(head.select("query", "block"), ["query", "block"], "left_anti").join(floor, "query", "left").filter(F.col("reach") >= F.coalesce("floor", F.lit(0.0)))
        if report is not None:
            count = lambda d: d.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
            report |= {"scored": count(head) + count(rest), "matching": count(reach)}
        return top_k(one.unionByName(scored(rest)), ["query"], [F.desc("score"), "doc"], k, "rank").select("query", "doc", "score", "rank")
