"""Language-model scores of texts by a weighted backoff automaton.

Tokens are words (``A-Z`` in lower case) and one end a text. With ``c`` the counts of the learned texts, ``h`` a history
and ``h'`` the same without its first token, the model is

    p(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w | h) = (c(hw) + strength p(w | h')) / (c(h) + strength)

Every n-gram seen is an arc from the state of its history, weighted by the logarithm of p; every history seen is a state,
with a failure arc to the state of its shorter one, weighted by the logarithm of strength / (c(h) + strength). A text
is one walk from the state of the text's beginning: it takes the arc of the next token, or fails until a state has
one (the root has them all), and adds up what it passes.

The counts grow with the corpus, so no machine ever holds them all. Texts are gathered in blocks of a bounded number of
tokens; a block counts its n-grams, sorted by a 64-bit key, and sends a compressed run of them to each slice of the
keys. A slice is merged in a stream, holding its distinct keys only. To score, blocks ask the slices for the
counts of what they hold, slices answer in the order of the question, and a block builds the part of the automaton
that its own texts can reach. Blocks are staged in buckets, so only answers move to them. A text of many tokens is walked in pieces, each from the state where the one before ends.

Keys of n-grams of two and more tokens keep ``KEY_BITS`` more bits than it takes to number all n-grams, so one of them is
taken for another with a chance of 2 ** -``KEY_BITS``; keys of single tokens keep all 64.

Defined cases: a null or empty text is its end alone; a null id is not learned from, unless ``learn`` says so; repeated rows are
rows each; where nothing is learned, every token has probability one by the base; an empty table gives no row; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, new_path, release, stage

ORDER, STRENGTH = 2, 64.0
#: Tokens of a block, tokens for each slice of the keys, keys merged at once.
BLOCK_TOKENS, SLICE_TOKENS, MERGE_KEYS = 500_000, 2_000_000, 4_000_000
KEY_BITS = 20
#: Bytes of input a bucket of blocks, and the most buckets Spark should be asked for.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 50_000
#: No word holds a line break.
END, START = b"\n/", b"\n"
U = np.uint64


# ---- packed arrays --------------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """The bytes of the entries by their place in the entry: the leading ones, mostly zero, cost next to nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return pack(np.diff(keys, prepend=U(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, U), dtype=U)


def joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a history and one more token (a SplitMix64 step)."""
    h = history * U(0x9E3779B97F4A7C15) + word + U(0x632BE59BD9B4E019)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


# ---- blocks of texts ------------------------------------------------------------------------------------------------

BLOCKS = "block long, words binary, tokens binary, doc_id array<bigint>, no_id array<boolean>, held array<boolean>, owner array<bigint>, lead array<int>, length array<int>"


def numbers() -> defaultdict:
    """A dictionary that numbers what it is asked for, from 0 on."""
    out: defaultdict = defaultdict()
    out.default_factory = out.__len__
    return out


def token_blocks(docs: DataFrame, learn: Column, order: int, block_tokens: int, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """A row a block: the keys of its words, its tokens as places in them, and the pieces of texts they are. A piece
    begins with ``lead`` tokens that are history only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        part, n, owner = TaskContext.get().partitionId(), 0, 0
        place, tokens, pieces, size = numbers(), [], [], 0

        def close() -> pd.DataFrame:
            nonlocal place, tokens, pieces, size, n
            keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in place), U, len(place))
            names = ("doc_id", "no_id", "held", "owner", "lead", "length")
            block = {"block": part << 32 | n, "words": pack(keys), "tokens": pack(np.concatenate(tokens))} | dict(zip(names, map(list, zip(*pieces))))
            place, tokens, pieces, size, n = numbers(), [], [], 0, n + 1
            return pd.DataFrame([block])

        for b in batches:
            for key, null, held, text in zip(b["id"], b["no_id"], b["held"], b["whole"]):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                for lo in range(0, len(words), block_tokens):
                    before = words[max(0, lo - order + 1) : lo] if lo else [START]
                    piece = before + words[lo : lo + block_tokens]
                    if size and size + len(piece) > block_tokens:
                        yield close()
                    tokens.append(np.fromiter(map(place.__getitem__, piece), np.uint32, len(piece)))
                    pieces.append((int(key), bool(null), bool(held), part << 40 | owner, len(before), len(piece)))
                    size += len(piece)
                owner += 1
        if pieces:
            yield close()
        release()

    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("no_id"), (~F.coalesce(learn, F.lit(False))).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    return bucketed(d.mapInPandas(run, BLOCKS), "block", buckets)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` staged in buckets of ``key``, so that a join by it doesn't move these rows. The table's name is dropped at
    once; its files stay in the shared folder."""
    spark, name = df.sparkSession, f"nexuloom_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", new_path(spark, "buckets")).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


class Grams:
    """The n-grams of a block: by order, their sorted keys, where each first ends and which one ends at each token."""

    def __init__(self, row: dict, order: int, bits: int):
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        words = unpack(row["words"], U)
        self.length, self.lead = np.array(row["length"], np.int64), np.array(row["lead"], np.int64)
        self.held = np.repeat(np.array(row["held"], bool), self.length)
        begin = np.cumsum(self.length) - self.length
        inside = np.arange(len(self.tokens)) - np.repeat(begin, self.length)
        #: tokens that are scored; of the others only the first of a text, its beginning, is counted
        self.scored = inside >= np.repeat(self.lead, self.length)
        opening = np.repeat((self.lead == 1) & (words[self.tokens[begin]] == start_key()), self.length) & (inside == 0)
        self.counted = self.scored | opening
        spot = np.argsort(words, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[spot] = np.arange(len(words))
        self.keys, self.which, self.first = [words[spot]], [rank[self.tokens]], [None]
        whole = words[self.tokens]
        mask = ~U(0) << U(64 - bits)
        for k in range(2, order + 1):
            ends = np.flatnonzero(inside >= k - 1)
            before = whole
            whole = np.zeros(len(self.tokens), U)
            whole[ends] = joined(before[ends - 1], words[self.tokens[ends]]) & mask
            keys, where, inverse = np.unique(whole[ends], return_index=True, return_inverse=True)
            which = np.full(len(self.tokens), -1, np.int64)
            which[ends] = inverse
            self.keys.append(keys)
            self.which.append(which)
            self.first.append(ends[where])

    def counts(self, k: int) -> np.ndarray:
        """How often each n-gram of ``k + 1`` tokens is in the learned texts of the block."""
        here = (self.which[k] >= 0) & ~self.held & self.counted
        return np.bincount(self.which[k][here], minlength=len(self.keys[k]))

    def questions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Sorted keys of single tokens (0) and of longer n-grams (1), with the places that sort them: each key once."""
        yield 0, self.keys[0], np.arange(len(self.keys[0]))
        if len(self.keys) == 2:
            yield 1, self.keys[1], np.arange(len(self.keys[1]))
        elif len(self.keys) > 2:
            keys, inverse = np.unique(np.concatenate(self.keys[1:]), return_inverse=True)
            yield 1, keys, inverse


def start_key() -> np.uint64:
    import xxhash

    return U(xxhash.xxh3_64_intdigest(START))


def sliced(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """``slice, from, to`` of sorted keys by their leading bits."""
    top = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edge = np.flatnonzero(np.r_[True, top[1:] != top[:-1]][: len(top)])
    yield from zip(top[edge].tolist(), edge.tolist(), np.r_[edge[1:], len(top)].tolist())


# ---- the counts -----------------------------------------------------------------------------------------------------

RUN = "kind int, slice long, block long, keys binary, counts binary"
SLICES = "kind int, slice long, keys binary, counts binary, total long, types long"


class Model(NamedTuple):
    """Counts of n-grams by slices of their keys, in a staged table; ``total`` and ``types``: N and V."""

    table: DataFrame
    order: int
    strength: float
    key_bits: int
    slice_bits: int
    total: int
    types: int


def _merged(kind: int, slice_: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    real = keys != start_key() if kind == 0 else np.zeros(len(keys), bool)
    return {"kind": kind, "slice": slice_, "keys": pack_keys(keys), "counts": pack(counts), "total": int(counts[real].sum()), "types": int(real.sum())}


def _sum_by(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    return k[edge], np.add.reduceat(c[order], edge) if len(edge) else c[:0]


def count_grams(blocks: DataFrame, order: int, key_bits: int, slice_bits: int, merge_keys: int = MERGE_KEYS) -> DataFrame:
    """The counts of all n-grams of the learned texts, a row a slice."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {0: ([], []), 1: ([], [])}, 0

        def close() -> pd.DataFrame:
            nonlocal held, size
            out = []
            for kind, (keys, counts) in held.items():
                if keys:
                    k, c = _sum_by(keys, counts)
                    out += [(kind, s, 0, pack_keys(k[lo:hi]), pack(c[lo:hi])) for s, lo, hi in sliced(k, slice_bits)]
            held, size = {0: ([], []), 1: ([], [])}, 0
            return pd.DataFrame(out, columns=["kind", "slice", "block", "keys", "counts"])

        for b in batches:  # the blocks of a task are added up before they move
            for row in _records(b):
                grams = Grams(row, order, key_bits)
                for k in range(order):
                    n = grams.counts(k).astype(U)
                    held[min(k, 1)][0].append(grams.keys[k][n > 0])
                    held[min(k, 1)][1].append(n[n > 0])
                    size += int((n > 0).sum())
                if size > merge_keys:
                    yield close()
        yield close()
        release()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, keys, counts, size, merged = None, [], [], 0, 0
        for b in batches:
            for kind, s, k, c in zip(b["kind"], b["slice"], b["keys"], b["counts"]):
                if (kind, s) != at:
                    if at is not None:
                        yield pd.DataFrame([_merged(*at, *_sum_by(keys, counts))])
                    at, keys, counts, size, merged = (kind, s), [], [], 0, 0
                keys.append(unpack_keys(k))
                counts.append(unpack(c, U))
                size += len(keys[-1])
                if size > max(merge_keys, merged):
                    k, c = _sum_by(keys, counts)
                    keys, counts, size, merged = [k], [c], 0, len(k)
        if at is not None:
            yield pd.DataFrame([_merged(*at, *_sum_by(keys, counts))])
        release()

    dealt = blocks.mapInPandas(runs, RUN).repartition("kind", "slice").sortWithinPartitions("kind", "slice")
    return stage(dealt.select("kind", "slice", "keys", "counts").mapInPandas(merge, SLICES), "lm-model", pack=False)


# ---- the automaton --------------------------------------------------------------------------------------------------


class Automaton:
    """The states and arcs that the texts of a block can reach. ``counts``: those of its n-grams, by order.

    A state is a history seen, ``k`` tokens long; every token of the block stands beside the weights of the arcs that
    read it from the states before it (None where a state has none) and of those states' failure arcs."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], strength: float, total: int, types: int):
        self.order, at = len(counts), grams.which[0]
        p = [(counts[0] + 0.1) / (total + 0.1 * (types + 1))]
        self.known = counts[0][at] > 0
        self.base = np.log10(p[0])[at]
        self.seen, self.arcs, self.fails = self.known.tolist(), [self.base.tolist()], [[]]
        for k in range(1, self.order):
            end = grams.first[k]
            shorter, history = grams.which[k - 1][end], grams.which[k - 1][end - 1]
            p.append((counts[k] + strength * p[k - 1][shorter]) / (counts[k - 1][history] + strength))
            weight = np.log10(p[k]).astype(object)
            weight[counts[k] == 0] = None
            self.arcs.append(np.append(weight, None)[grams.which[k]].tolist())  # none where no n-gram ends
            failure = np.log10(strength / (counts[k - 1] + strength))
            self.fails.append(np.append(0.0, failure[grams.which[k - 1][:-1]]).tolist())

    def walk(self, lo: int, hi: int, k: int = 0) -> tuple[float, int]:
        """The log-probability of the tokens from ``lo`` up to ``hi``, from a state of ``k`` tokens on, and how many
        tokens the state has that they end in."""
        arcs, fails, seen, most, total = self.arcs, self.fails, self.seen, self.order - 1, 0.0
        for i in range(lo, hi):
            weight = arcs[k][i]
            while weight is None:
                total += fails[k][i]
                k -= 1
                weight = arcs[k][i]
            total += weight
            if k:
                k = k + 1 if k < most else most
            elif most and seen[i]:
                k = 1
        return total, k


PIECES = "owner long, doc_id long, no_id boolean, held_out boolean, n_tokens long, n_known long, base double, walked double"


def _piece_scores(row: dict, answers: dict[int, list[np.ndarray]], order: int, strength: float, bits: int, total: int, types: int) -> pd.DataFrame:
    grams, counts = Grams(row, order, bits), []
    for kind, keys, inverse in grams.questions():
        found = np.concatenate(answers[kind]).astype(np.int64)
        assert len(found) == len(keys), "an answer is missing"
        found = found[inverse]
        cuts = np.cumsum([len(x) for x in (grams.keys[:1] if kind == 0 else grams.keys[1:])])[:-1]
        counts += np.split(found, cuts)
    auto, at, out = Automaton(grams, counts, strength, total, types), 0, []
    for doc, null, held, owner, lead, length in zip(*(row[c] for c in ("doc_id", "no_id", "held", "owner", "lead", "length"))):
        _, state = auto.walk(at, at + lead)
        walked, _ = auto.walk(at + lead, at + length, state)
        mine = slice(at + lead, at + length)
        out.append((owner, doc, null, held, length - lead, int(auto.known[mine].sum()), float(auto.base[mine].sum()), walked))
        at += length
    return pd.DataFrame(out, columns=["owner", "doc_id", "no_id", "held_out", "n_tokens", "n_known", "base", "walked"])


def _records(b: pd.DataFrame) -> Iterator[dict]:
    """Rows of a frame, one at a time."""
    for row in zip(*(b[c] for c in b.columns)):
        yield dict(zip(b.columns, row))


def walk_texts(blocks: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Every piece of every text with the logarithms of its probabilities."""
    order, strength, bits, slice_bits, total, types = model.order, model.strength, model.key_bits, model.slice_bits, model.total, model.types

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in _records(b):
                out = []
                for kind, keys, _ in Grams(row, order, bits).questions():
                    out += [(kind, s, row["block"], pack_keys(keys[lo:hi]), None) for s, lo, hi in sliced(keys, slice_bits)]
                yield pd.DataFrame(out, columns=["kind", "slice", "block", "keys", "counts"])
        release()

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known, counts, out = None, None, None, []
        for b in batches:  # a slice's counts come before what is asked of it
            for kind, s, block, keys, c in zip(b["kind"], b["slice"], b["block"], b["keys"], b["counts"]):
                k = unpack_keys(keys)
                if c is not None:
                    at, known, counts = (kind, s), k, unpack(c, U)
                    continue
                found = np.zeros(len(k), U)
                if at == (kind, s):
                    spot = np.minimum(np.searchsorted(known, k), len(known) - 1)
                    hit = known[spot] == k
                    found[hit] = counts[spot[hit]]
                out.append((block, kind, s, pack(found)))
                if len(out) >= 256:
                    yield pd.DataFrame(out, columns=["block", "kind", "slice", "counts"])
                    out = []
        yield pd.DataFrame(out, columns=["block", "kind", "slice", "counts"])
        release()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in _records(b):
                answers: dict[int, list] = {0: [], 1: []}
                for kind, raw in zip(row["kinds"], row["answers"]):
                    answers[kind].append(unpack(raw, U))
                yield _piece_scores(row, answers, order, strength, bits, total, types)
        release()

    asked = blocks.mapInPandas(ask, RUN)
    held = model.table.select("kind", "slice", F.lit(-1).cast("long").alias("block"), "keys", "counts")
    both = held.unionByName(asked).repartition("kind", "slice").sortWithinPartitions("kind", "slice", "block")
    answers = both.mapInPandas(answer, "block long, kind int, slice long, counts binary")
    by = answers.repartition(buckets, "block").groupBy(F.col("block").alias("answered")).agg(F.array_sort(F.collect_list(F.struct("kind", "slice", "counts"))).alias("a"))
    by = by.select("answered", F.col("a.kind").alias("kinds"), F.col("a.counts").alias("answers"))
    return blocks.join(by.hint("shuffle_hash"), F.col("block") == F.col("answered")).drop("answered").mapInPandas(score, PIECES)


# ---- the operator ---------------------------------------------------------------------------------------------------


def train(blocks: DataFrame, order: int = ORDER, strength: float = STRENGTH, key_bits: int = KEY_BITS, slice_tokens: int = SLICE_TOKENS) -> Model:
    """The counts of the learned texts of ``blocks``. Slices and bits of keys follow from the number of all tokens."""
    tokens = blocks.agg(F.coalesce(F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).head()[0]
    bits = min(64, key_bits + ceil(log2(order * tokens + 2)))
    slice_bits = max(2, ceil(log2(tokens / slice_tokens + 1)))
    table = count_grams(blocks, order, bits, slice_bits)
    sums = table.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).head()
    return Model(table, order, strength, bits, slice_bits, sums[0], sums[1])


def score(docs: DataFrame, learn: Column, order: int = ORDER, strength: float = STRENGTH, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row; the texts where ``learn``
    holds are learned from."""
    buckets = min(MOST_BUCKETS, max(2 * docs.sparkSession.sparkContext.defaultParallelism, input_bytes(docs) // BUCKET_BYTES))
    blocks = token_blocks(docs, learn, order, block_tokens, id_col, text_col, buckets)
    model = train(blocks, order, strength, **options)
    pieces = walk_texts(blocks, model, buckets)
    whole = pieces.groupBy("owner").agg(F.min("doc_id").alias("id"), F.first("no_id").alias("no_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("walked").alias("score"))
    return whole.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
