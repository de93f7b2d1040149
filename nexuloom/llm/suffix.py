"""Exact removal of repeated byte strings by a distributed merge of front-coded sorted suffix runs.

Every string of ``length`` bytes holds one anchor: its leftmost ``GRAM``-byte gram of smallest hash. Equal strings have
their anchors at equal offsets, so only suffixes that start at anchors are sorted (a sparse suffix array), with what
lies before the anchor as the tail of the key. Anchors whose gram occurs once in the corpus are dropped unsorted.

Map tasks sort their anchor suffixes and front-code them: a run holds, for each suffix, the length of the prefix it
shares with the one before and the rest of its bytes. Runs are exchanged by gram. A loser tree merges the runs of a
task; each contender carries the prefix it is known to share with the last winner, and only bytes beyond that are
looked at. The shared prefixes of the merged order say, for each offset of the anchor in a string, which strings are
equal; all but the earliest of these are removed.

Grams that are frequent in a bounded sample of documents rank behind all others, so they are anchors only of strings
that hold no other gram: the inside of passages that many documents share, which are few *different* strings. Such
anchors skip the count, and equal suffixes of a map task are one entry of its run (all but the earliest are known to
repeat and go to their documents at once), so no task holds a frequent gram's occurrences. The sample decides the way
an anchor takes, never the result.

Any other gram meets its like in one task to be counted, but a map task sends at most two of its occurrences there per
200,000 anchors; two are enough for all others of that gram to be known as repeats, so the rest go on uncounted.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; texts of any length are cut into segments
that overlap by ``length`` less one; rows of one id are separate documents, ordered by a hash of the text, and null ids
come first; of equal strings that start at the same place of tied rows one stays; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import input_bytes, release, stage

GRAM = 24
BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 22
#: Bytes of input files for each part of the merge, so a part's runs do not grow with the input.
PART_BYTES = 16 << 20
#: Ends the part of a key that lies after the anchor; UTF-8 has no such byte.
STOP = b"\xff"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if cache.get("n", 0) < n:
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            cache["up"] = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
            cache["down"] = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])
        cache["n"] = n
    return cache["up"], cache["down"]


class Frequent:
    """A set of gram hashes; most others are told apart by one look into a table of bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.view(np.uint64))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.seen[(h >> np.uint64(42)).astype(np.int64)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            out[some] = self.hashes[at] == h[some]
        return out


def anchors(raw: bytes, length: int, frequent: Frequent | None = None) -> tuple[np.ndarray, ...]:
    """Hash and place of each anchor, the least and greatest offset of it in the strings it stands for, and whether its
    gram is frequent."""
    out = [_anchors(raw[a : a + SEGMENT + length - 1], length, a, frequent) for a in range(0, max(1, len(raw) - length + 1), SEGMENT)]
    return tuple(np.concatenate(x) for x in zip(*out))


def gram_hashes(raw: bytes) -> np.ndarray:
    """Hash of the gram at each place."""
    n = len(raw)
    up, down = _powers(max(n, 1 << 17))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _anchors(raw: bytes, length: int, shift: int, frequent: Frequent | None):
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 5
    h = gram_hashes(raw)
    # sliding minimum of (hash, place) over w grams, by running minima of blocks from both sides
    w, m = length - GRAM + 1, len(h)
    low = np.uint64((1 << 24) - 1)
    rank = h >> np.uint64(1)
    if frequent is not None and len(frequent.hashes):
        rank |= frequent(h).astype(np.uint64) << np.uint64(63)
    key = (rank & ~low) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // w)
    grid = np.full(blocks * w, ~np.uint64(0), np.uint64)
    grid[:m] = key
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    place = (least & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:], len(place)] - 1
    p = place[new]
    return h[p].view(np.int64), p + shift, p - last, p - new, (least[new] >> np.uint64(63)).astype(np.int64)


def _emit_anchors(length: int, hashes: np.ndarray):
    """Rows ``h, doc, at``; ``at`` packs place, offsets and, in its last bit, whether the anchor needs no count, because
    its gram is frequent or two others of it are among these rows. Such an anchor has a key of its own in place of ``h``."""

    def frame(parts: list) -> pd.DataFrame:
        h, p, lo, hi, hot, doc = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        third = np.zeros(len(h), bool)
        third[order[2:]] = h[order[2:]] == h[order[:-2]]
        hot = hot | third
        at = p << 15 | lo << 8 | hi << 1 | hot
        return pd.DataFrame({"h": np.where(hot == 1, (doc * 0x2545F491 + at) ^ h, h), "doc": doc, "at": at})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = Frequent(hashes)
        for b in batches:
            held, size = [], 0
            for d, text in zip(b["doc"], b["text"]):
                a = anchors(text.encode("utf-8"), length, frequent)
                held.append((*a, np.full(len(a[0]), d, np.int64)))
                size += len(a[0])
                if size > 200_000:
                    yield frame(held)
                    held, size = [], 0
            if size:
                yield frame(held)

    return run


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for text in b["text"]:
            raw = text.encode("utf-8")
            for lo in range(0, len(raw) - GRAM + 1, SEGMENT):
                h, n = np.unique(gram_hashes(raw[lo : lo + SEGMENT + GRAM - 1]), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})


def frequent_grams(rows: DataFrame, sample: int, share: float) -> np.ndarray:
    """Grams that occur at least ``share * sample`` times in a sample of ``sample`` documents."""
    chosen = rows.select("doc").orderBy(F.xxhash64("doc"), "doc").limit(sample).withColumnRenamed("doc", "pick")
    texts = rows.join(F.broadcast(chosen), F.col("doc") == F.col("pick"), "left_semi").filter(F.octet_length("text") >= GRAM)
    n = texts.mapInPandas(_count_grams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return n.filter(F.col("n") >= max(2.0, share * sample)).select("h").toPandas()["h"].to_numpy(np.int64)


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two different strings; the first ``known`` bytes are not looked at."""
    n = min(len(a), len(b))
    lo = known
    step = 16
    while lo < n and a[lo : lo + step] == b[lo : lo + step]:
        lo += step
    lo = min(lo, n)
    while lo < n and a[lo] == b[lo]:
        lo += 1
    return lo


def front_code(keys: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Sorted keys -> shared prefix with the one before, and the rest of each."""
    shared = np.zeros(len(keys), np.uint8)
    rest, before = [], b""
    for i, k in enumerate(keys):
        n = shared_prefix(before, k, 0) if i else 0
        shared[i] = n
        rest.append(k[n:])
        before = k
    return shared, rest


def pack_run(held: dict[bytes, tuple[int, int]]) -> bytes:
    """A front-coded run: keys in order, each with its earliest document and place."""
    keys = sorted(held)
    shared, rest = front_code(keys)
    at = np.array([held[k] for k in keys], np.int64).reshape(-1, 2)
    return np.array([len(keys)], "<u8").tobytes() + shared.tobytes() + np.array([len(r) for r in rest], np.uint8).tobytes() + at.astype("<i8").tobytes() + b"".join(rest)


def open_run(raw: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """Entries of a run: shared prefix with the entry before, key, document and place."""
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    shared, sizes = raw[8 : 8 + n], raw[8 + n : 8 + 2 * n]
    at = np.frombuffer(raw, "<i8", 2 * n, 8 + 2 * n).reshape(-1, 2).tolist()
    pos, key = 8 + 18 * n, b""
    for i in range(n):
        key = key[: shared[i]] + raw[pos : pos + sizes[i]]
        yield shared[i], key, *at[i]
        pos += sizes[i]


def merge_runs(runs: list[Iterator]) -> Iterator[tuple[int, bytes, int, int]]:
    """Entries of all runs in order, each with the prefix it shares with the entry before it in that order.

    A loser tree in which a contender's known prefix is the one it shares with the last winner. Of two contenders the
    one with the longer known prefix is the smaller; only equal ones are compared, from the known prefix on, and then
    the loser's known prefix is the one it shares with the new winner.
    """
    k = len(runs)
    now = [next(r, None) for r in runs]
    known = [0] * k  # shared with the last winner
    size = 1
    while size < k:
        size *= 2

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's known prefix to the one shared with the winner."""
        if b >= k or now[b] is None:
            return a, b
        if a >= k or now[a] is None:
            return b, a
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        s, t = now[a][1], now[b][1]
        n = len(s) if s == t else shared_prefix(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    tree = [0] * (2 * size)
    win = list(range(size))
    level = [*([0] * size), *win]
    for i in range(size - 1, 0, -1):
        level[i], tree[i] = duel(level[2 * i], level[2 * i + 1])
    winner = level[1] if size > 1 else 0
    while now[winner] is not None if winner < k else False:
        entry = now[winner]
        yield known[winner], entry[1], entry[2], entry[3]
        now[winner] = nxt = next(runs[winner], None)
        known[winner] = nxt[0] if nxt is not None else 0
        i = (winner + size) // 2
        while i:
            winner, tree[i] = duel(winner, tree[i])
            i //= 2


def repeats(entries: Iterator[tuple[int, bytes, int, int]], length: int, at_once: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Merged entries -> (documents, starts, ends) of removed bytes. Equal strings have equal grams, so what is held is
    gone through whenever a gram ends after ``at_once`` entries."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    for n, key, d, p in entries:
        shared, keys, where, rest = held
        if keys and n == len(key) == len(keys[-1]):  # the same key from another run: the earlier one stays
            rest.append((len(keys) - 1, *max((d, p), where[-1])))
            where[-1] = min((d, p), where[-1])
            continue
        if n < GRAM and len(keys) + len(rest) >= at_once:
            yield from _repeats(*held, length)
            held = shared, keys, where, rest = [], [], [], []
        shared.append(n)
        keys.append(key)
        where.append((d, p))
    yield from _repeats(*held, length)


def _repeats(shared: list[int], keys: list[bytes], where: list[tuple[int, int]], rest: list[tuple[int, int, int]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the entries of whole grams, in order, with what they share, and equal ones put aside in ``rest``."""
    if not keys:
        return
    right = np.array([k.index(STOP) for k in keys], np.int64)
    total = np.array([len(k) for k in keys], np.int64)
    low, high = length - right, total - right - 1  # offsets of the anchor in the strings of the key
    doc, place = np.array(where, np.int64).T
    if rest:
        which, d, p = np.array(rest, np.int64).T
        yield d, p - high[which], p - low[which] + length
    share = np.minimum(np.array(shared, np.int64), np.minimum(right, np.r_[0, right[:-1]]))
    left = [k[r + 1 :] for k, r in zip(keys, right.tolist())]
    by_left = sorted(range(len(left)), key=left.__getitem__)
    left_share = np.zeros(len(left), np.int64)
    for i in range(1, len(by_left)):
        a, b = left[by_left[i - 1]], left[by_left[i]]
        left_share[i] = len(a) if a == b else shared_prefix(a, b, 0)
    by_left = np.array(by_left)
    early = np.lexsort((place, doc))
    most, least = np.full(len(keys), -1), np.full(len(keys), length)
    lrank = np.empty(len(keys), np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        rrank = np.cumsum(share < length - o)
        lrank[by_left] = np.cumsum(left_share < o)
        some = early[(low[early] <= o) & (high[early] >= o)]
        if len(some) < 2:
            continue
        _, first = np.unique(rrank[some] * (len(keys) + 1) + lrank[some], return_index=True)
        twice = np.ones(len(some), bool)
        twice[first] = False
        again = some[twice]
        most[again] = np.maximum(most[again], o)
        least[again] = np.minimum(least[again], o)
    hit = np.flatnonzero(most >= 0)
    yield doc[hit], place[hit] - most[hit], place[hit] - least[hit] + length


def _build_runs(length: int, parts: int, at_once: int = 150_000):
    """Rows ``part, run, sure``: runs, and the spans of suffixes that are equal to an earlier one of the same task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        held: dict[int, dict[bytes, tuple[int, int]]] = {}
        sure: list[tuple[int, int]] = []
        size = 0

        def flush():
            rows = [(k, press(pack_run(x)), False) for k, x in held.items()]
            if sure:
                rows.append((zlib.crc32(b"%d" % sure[0][0]) % parts, press(np.array(sure, "<i8").tobytes()), True))
            return pd.DataFrame(rows, columns=["part", "run", "sure"])

        for b in batches:
            for d, z, cand in zip(b["doc"], b["z"], b["cand"]):
                raw = opened(z)
                for c in cand.tolist():
                    p, lo, hi = c >> 15, c >> 8 & 127, c >> 1 & 127
                    right = raw[p : p + length - lo]
                    key = right + STOP + raw[p - hi : p][::-1]
                    mine = held.setdefault(zlib.crc32(right[:GRAM]) % parts, {})
                    have = mine.get(key)
                    if have is None:
                        mine[key] = (d, p)
                    else:
                        mine[key], (e, q) = ((d, p), have) if (d, p) < have else (have, (d, p))
                        sure.append((e, (q - hi) << 32 | (q - lo + length)))
                size += len(cand)
            if size >= at_once:
                yield flush()
                held, sure, size = {}, [], 0
        if size:
            yield flush()
        release()

    return run


def _merge_parts(length: int):
    def close(runs: list[bytes]) -> Iterator[pd.DataFrame]:
        for d, a, z in repeats(merge_runs([open_run(r) for r in runs]), length):
            yield pd.DataFrame({"doc": d, "span": a << 32 | z})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, opened = None, [], zstandard.ZstdDecompressor().decompress
        for b in batches:
            for p, r, sure in zip(b["part"], map(opened, b["run"]), b["sure"]):
                if sure:
                    d, span = np.frombuffer(r, "<i8").reshape(-1, 2).T
                    yield pd.DataFrame({"doc": d, "span": span})
                    continue
                if held and p != part:
                    yield from close(held)
                    held = []
                part = p
                held.append(r)
        if held:
            yield from close(held)
        release()

    return run


def cut(raw: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs and the digest of what is left."""
    digest, at, removed, runs, end = hashlib.sha256(), 0, 0, 0, -1
    for s in np.sort(spans).tolist():
        a, z = s >> 32, s & 0xFFFFFFFF
        if a > end:
            digest.update(raw[max(at, 0) : a])
            runs += 1
            removed += z - a
            at = end = z
        elif z > end:
            removed += z - end
            at = end = z
    digest.update(raw[at:])
    return removed, runs, digest.hexdigest()


def _squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as compressed bytes: they are moved twice."""
    press = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pd.DataFrame({"doc": b["doc"], "z": [press(t.encode("utf-8")) for t in b["text"]]})


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none, opened = np.zeros(0, np.int64), zstandard.ZstdDecompressor().decompress
    for b in batches:
        rows = []
        for d, z, spans in zip(b["doc"], b["z"], b["spans"]):
            raw = opened(z)
            rows.append((d, len(raw), *cut(raw, none if spans is None else spans)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 100, sample: int = 2_000, share: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).head()
    unique = ids["n"] == ids["ids"]
    if unique:
        d = d.select(F.col("id").alias("doc"), "text")
    else:  # number the rows in order, so that every row is a document
        d = d.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
        d = stage(d.withColumn("doc", F.monotonically_increasing_id()), "suffix-numbered")
    parts = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // PART_BYTES)
    rows = d.select("doc", "text")
    frequent = frequent_grams(rows, sample, share)
    found = rows.filter(F.octet_length("text") >= length).mapInPandas(_emit_anchors(length, frequent), "h long, doc long, at long")
    again = found.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("h"))).filter("n > 1 OR (at & 1) = 1")
    cand = again.groupBy("doc").agg(F.collect_list("at").alias("cand")).withColumnRenamed("doc", "c_doc")
    small = rows.mapInPandas(_squeeze, "doc long, z binary")
    texts = small.join(cand.hint("merge"), F.col("doc") == F.col("c_doc")).select("doc", "z", "cand")
    runs = texts.mapInPandas(_build_runs(length, parts), "part int, run binary, sure boolean")
    spans = runs.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(_merge_parts(length), "doc long, span long")
    spans = spans.groupBy("doc").agg(F.collect_list("span").alias("spans")).withColumnRenamed("doc", "s_doc")
    out = small.join(spans.hint("merge"), F.col("doc") == F.col("s_doc"), "left").select("doc", "z", "spans").mapInPandas(_finish, RESULT)
    if unique:
        return out
    names = d.select(F.col("doc").alias("n_doc"), "id")
    return out.join(names, F.col("doc_id") == F.col("n_doc")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
