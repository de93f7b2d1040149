"""From raw documents to token shards: quality, near-duplicates, decontamination, mixing, token ids.

Every stage tells rows apart by their place in the table it is given, never by a digest or an id, so identical rows and
rows with nulls in any column are rows each. Defined cases, for all stages: an empty table gives an empty table; columns
beside the named ones are handed on, whatever their names. A null or empty text, or one of any length, is scored as it is
by the classifier (a score equal to the limit is kept); texts without a word are copies of each other in the second stage,
where the smallest id stays (null first, then the first row); they hold no benchmark item; the mix takes no text without
a word, nor any document of a source without words. A null source is a source of its own, ranked last. A null id is never
learned from and encoded first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nexuloom.llm import decontaminate, mixing, quality, queries, simhash, tokens
from nexuloom.llm.common import packed, read, stage

NEAR_BITS = 6


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents outside the held-out rows; documents it rejects go."""
    model = quality.train(docs, read(spark, sf_dir, "labels"), ~queries.held_out())
    return quality.accepted(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id. Fingerprints within six bits are
    candidates, further ones of a common bucket too if a second fingerprint agrees; a link is a pair that shares 80 % of
    its five-word shingles."""
    return packed(simhash.one_of_similar(docs, most=NEAR_BITS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return packed(decontaminate.clean(docs, read(spark, sf_dir, "benchmark")))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return packed(mixing.mixed_documents(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards with their index; returns what reading them back gives, one row a document of the mix."""
    return tokens.encode_and_read(spark, docs, queries.vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mixing_to_weights),
    ("token ids", token_ids),
]
#: A fitted classifier, fingerprints and a tokenizer are not expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
