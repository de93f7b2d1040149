"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts are gathered from a bounded sample of labelled rows (``rows_a_language``, chosen by a hash of the id), summed by
Spark; the matrix of log probabilities has ``2**bits`` rows and one column a language, is broadcast (its size is that
product, checked) and scores concatenated texts with numpy, a bounded number of characters at a time.

Defined cases: a null text, a text without a letter and an untrained model give ``und`` with score 0; ties go to the
first language by code point; repeated rows are scored each; null languages are never learned; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import slices

ORDERS = (1, 2, 3)
#: Odd multipliers of the hash, one a position, and the seeds of the orders: fixed values.
STEPS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
SEEDS = (0x27D4EB2F, 0x165667B1, 0xD3A2646C)
MAX_MODEL = 64_000_000


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Hashed n-grams of an array of code points, one array an order of at most its length; entry i starts at i."""
    with np.errstate(over="ignore"):
        at = [c * np.uint32(s) for s in STEPS]
        for order in ORDERS:
            if len(c) < order:
                continue
            n = len(c) - order + 1
            h = at[0][:n] ^ np.uint32(SEEDS[order - 1])
            for k in range(1, order):
                h = (h << np.uint32(5)) ^ (h >> np.uint32(27)) ^ at[k][k : k + n]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            yield h >> np.uint32(32 - bits)


def _counted(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                have = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                for lo in range(0, len(text), 1_000_000):
                    for h in grams(codes(f" {text[lo:lo + 1_000_000]} "), bits):
                        have += np.bincount(h, minlength=1 << bits)
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int32), "n": have[at]})

    return run


def train(docs: DataFrame, learn: Column, bits: int = 14, rows_a_language: int = 1500, alpha: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix ``2**bits x languages`` of log probabilities."""
    usable = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # the first rows of each of 64 parts of a language: no task holds a language
    ids = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h")).withColumn("part", F.pmod(F.col("h"), F.lit(64)))
    first = F.row_number().over(W.partitionBy("lang", "part").orderBy("h", "id"))
    chosen = ids.withColumn("r", first).filter(F.col("r") <= -(-rows_a_language // 64)).select("id").distinct()
    sample = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id", "left_semi")  # at most rows_a_language ids a language
    counts = sample.select("lang", "text").mapInPandas(_counted(bits), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    if len(langs) << bits > MAX_MODEL:
        raise ValueError("too many languages for this number of buckets")
    table = np.full((1 << bits, len(langs)), alpha)
    for k, lang in enumerate(langs):
        c = counts[counts["lang"] == lang]
        table[c["gram"].to_numpy(), k] += c["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32) if langs else table.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` beside the columns in ``keep``."""
    spark = docs.sparkSession
    langs, table = model
    bits = int(table.shape[0]).bit_length() - 1
    shared = spark.sparkContext.broadcast((langs, table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, table = shared.value
        table = np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])  # the last row is for grams over two texts
        for b in batches:
            texts = b["__text"]
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if langs:
                for lo, hi in slices(texts, 300_000):
                    sums = np.zeros((hi - lo, len(langs)))
                    if hi - lo == 1:
                        t = texts.iloc[lo]
                        for a in range(0, max(1, len(t)), 1_000_000):
                            for h in grams(codes(f" {t[a:a + 1_000_000]} "), bits):
                                sums[0] += _summed(table, h, np.array([0]))[0]
                    else:
                        parts = [codes(f" {t} ") for t in texts.iloc[lo:hi]]
                        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
                        for order, h in zip(ORDERS, grams(np.concatenate(parts), bits)):
                            h = np.append(h, np.full(order - 1, 1 << bits, h.dtype))  # the last text can be shorter than a gram
                            for back in range(1, order):
                                h[starts[1:] - back] = 1 << bits
                            sums += _summed(table, h, starts)
                    top = sums.max(axis=1, keepdims=True)
                    p = np.exp(sums - top)
                    best[lo:hi], score[lo:hi] = sums.argmax(axis=1), 1 / p.sum(axis=1)
            names = np.array([*langs, "und"], object)[best if langs else np.zeros(len(texts), int)]
            yield b.drop(columns="__text").assign(lang_pred=names, score=score)

    text = F.col(text_col)
    d = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = ", ".join(f"`{n}` {t}" for n, t in d.dtypes if n != "__text") + ", lang_pred string, score double"
    out = d.mapInPandas(run, schema)
    return out.select(*keep, F.when(F.col("__letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("__letter") & (F.col("lang_pred") != "und"), F.col("score")).otherwise(0.0).alias("score"))


def _summed(table: np.ndarray, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``h`` of the table, by span of texts."""
    return np.stack([np.add.reduceat(table[:, k].take(h), starts, dtype=np.float64) for k in range(table.shape[1])], axis=1)
