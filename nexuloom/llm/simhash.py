"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are 64 bits; two link if at most ``most`` bits differ. Equal fingerprints are one node from the start.
By the pigeonhole principle two linked fingerprints agree on one of ``most + 1`` blocks of bits (on two of ``most + 2``),
so each is dealt once a choice of blocks. How many blocks must agree follows from the number of fingerprints, so that a
bucket of evenly spread ones holds about a thousand at any size. Within a block's bucket the fingerprints are sorted by Gray rank; runs of eight are leaves, runs of eight
leaves their parents and so on. A node keeps the bits that all below it share. Pairs of nodes are opened from the top;
a pair whose shared bits already differ in more than ``most`` places is dropped whole, as is one whose members are
linked already, so a group of near copies costs its nodes, not its pairs. A bucket gives its spanning links only.

Defined cases: no word (null, empty, blank) gives fingerprint zero, which links like any other; a text shorter than
a shingle is one shingle; texts of any length are hashed whole; repeated rows are members each; a null id never becomes a component's id unless the component
has none other; where one document of a group stays and ids tie, the row that is first in the table's files does, and a
null id is the smallest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_HOT, beside, numbered, release, stage, unused
from .graph import components

FAN = 8
#: Lane j of entry b is bit j of b.
LANES = np.array([sum((b >> j & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of words; bytes.split and bytes.lower know ASCII white space and letters only."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    if len(w) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    length = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(length + 1) - 1
    h = xxhash.xxh64_intdigest
    n = len(w) - size + 1
    return np.fromiter((h(line[a:b], 42) for a, b in zip((ends - length)[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def fold_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint a list entry: bit set if it is set in over half the hashes; zero for none."""
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n, flat = counts[full], np.concatenate([hashes[i] for i in full])
    starts = np.cumsum(n) - n
    # blocks of at most 255 hashes: eight bit counts fit in the eight bytes of one word
    per = -(-n // 255)
    block = np.repeat(starts, per) + 255 * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    first = np.cumsum(per) - per
    raw = flat.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(full), 64), np.int64)
    for c in range(8):
        lanes = np.add.reduceat(LANES[raw[:, c]], block).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones[:, 8 * c : 8 * c + 8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    bits = (2 * ones > n[:, None]).astype(np.uint64)
    out[full] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``fp`` (a signed long) beside the columns in ``keep``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out, held, size = b["__text"], [], [], 0
            for t in texts:
                held.append(shingle_hashes(t, shingle))
                size += len(held[-1])
                if size > 400_000:
                    out.append(fold_bits(held))
                    held, size = [], 0
            out.append(fold_bits(held))
            yield b.drop(columns="__text").assign(fp=np.concatenate(out).view(np.int64))

    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return d.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in d.dtypes if n != "__text") + ", fp long")


def remixed(h: np.ndarray) -> np.ndarray:
    """The hashes through the finaliser of SplitMix64: their fingerprint is as good as one of another seed."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a 64-bit pattern in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; ``root`` stays flat, with the smallest member as the root."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _tree(fp: np.ndarray, group: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Shared bits and their masks by level, where each node's members begin, and the nodes of the top level."""
    # levels[0] are the fingerprints; a node of level k + 1 is a run of up to FAN nodes of level k within a group
    common, mask, own = [fp], [np.full(len(fp), ~np.uint64(0))], [group]
    first = []
    while True:
        g = own[-1]
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        if len(edge) == len(g) and first:
            break
        inside = np.arange(len(g)) - np.repeat(edge, np.diff(np.r_[edge, len(g)]))
        start = np.flatnonzero(inside % FAN == 0)
        both_and = np.bitwise_and.reduceat(common[-1], start)
        both_or = np.bitwise_or.reduceat(common[-1], start)
        m = np.bitwise_and.reduceat(mask[-1], start) & ~(both_and ^ both_or)
        first.append(np.r_[start, len(g)])
        common.append(both_and & m)
        mask.append(m)
        own.append(g[start])
    return common, mask, first, np.arange(len(own[-1]))


def linked(fp: np.ndarray, group: np.ndarray, most: int, pairs_at_once: int = 40_000) -> np.ndarray:
    """For fingerprints sorted by group and Gray rank: the place of each one's root among the links of its group."""
    root = np.arange(len(fp))
    common, mask, first, nodes = _tree(fp, group)
    top = len(first)
    grid_a, grid_b = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
    todo = [(top, nodes[i : i + pairs_at_once], nodes[i : i + pairs_at_once]) for i in range(0, len(nodes), pairs_at_once)]
    while todo:
        level, a, b = todo.pop()
        start = first[level - 1]
        i, j = start[a][:, None] + grid_a, start[b][:, None] + grid_b
        ok = (i < start[a + 1][:, None]) & (j < start[b + 1][:, None]) & ((i < j) if level == 1 else (i <= j))
        i, j = i[ok], j[ok]
        below = level - 1
        near = np.bitwise_count((common[below][i] ^ common[below][j]) & mask[below][i] & mask[below][j]) <= most
        i, j = i[near], j[near]
        if below == 0:
            unite(root, i, j)
            continue
        # nodes whose members are all in one set already, and in the same one, have nothing left to say
        low, high = _span(root, first, below)
        done = _one_set(low, high, i, j)
        i, j = i[~done], j[~done]
        same = i == j
        for x, y in ((i[~same], j[~same]), (i[same], j[same])):  # close kin are opened first
            todo += [(below, x[k : k + pairs_at_once], y[k : k + pairs_at_once]) for k in range(0, len(x), pairs_at_once)]
    return root


def near_pairs(fp: np.ndarray, second: np.ndarray, group: np.ndarray, label: np.ndarray, most: int, enough: int, reach: int, both: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, pairs_at_once: int = 4_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places of one group and two labels that differ in at most ``most`` bits, or in at most ``reach`` and, with
    the bits of the second fingerprints, ``both``; and the groups not gone through. What ``keep`` refuses is no pair.

    A member that has ``enough`` pairs takes no more of them; its group is then among the last, to be asked again with
    the labels that the pairs gave."""
    common, mask, first, nodes = _tree(fp, group)
    grid_a, grid_b = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
    spans = [_span(label, first, k) for k in range(len(first) + 1)]
    places = [np.arange(len(fp))]
    for f in first:
        places.append(places[-1][f[:-1]])
    count, unfinished, out = np.zeros(len(fp), np.int64), [np.zeros(0, group.dtype)], []
    todo = [(len(first), nodes[i : i + pairs_at_once], nodes[i : i + pairs_at_once]) for i in range(0, len(nodes), pairs_at_once)]
    while todo:
        level, a, b = todo.pop()
        least = count
        for f in first[:level]:
            least = np.minimum.reduceat(least, f[:-1])
        full = (least[a] >= enough) | (least[b] >= enough)
        unfinished.append(np.unique(group[places[level][a[full]]]))
        a, b = a[~full], b[~full]
        start, below = first[level - 1], level - 1
        i, j = start[a][:, None] + grid_a, start[b][:, None] + grid_b
        ok = (i < start[a + 1][:, None]) & (j < start[b + 1][:, None]) & ((i < j) if level == 1 else (i <= j))
        i, j = i[ok], j[ok]
        near = np.bitwise_count((common[below][i] ^ common[below][j]) & mask[below][i] & mask[below][j]) <= reach
        near &= ~_one_set(*spans[below], i, j)
        i, j = i[near], j[near]
        if below == 0:
            bits = np.bitwise_count(fp[i] ^ fp[j])
            near = (bits <= most) | (bits + np.bitwise_count(second[i] ^ second[j]) <= both)
            i, j = i[near], j[near]
            if keep is not None:
                near = keep(i, j)
                i, j = i[near], j[near]
            free = (count[i] + _nth(i) < enough) & (count[j] + _nth(j) < enough)
            unfinished.append(np.unique(group[i[~free]]))
            i, j = i[free], j[free]
            np.add.at(count, i, 1)
            np.add.at(count, j, 1)
            out.append((i, j))
            continue
        same = i == j
        for x, y in ((i[~same], j[~same]), (i[same], j[same])):  # close kin are opened first
            todo += [(below, x[k : k + pairs_at_once], y[k : k + pairs_at_once]) for k in range(0, len(x), pairs_at_once)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(y for _, y in out)]), np.unique(np.concatenate(unfinished))


def spanning_pairs(fp: np.ndarray, second: np.ndarray, group: np.ndarray, label: np.ndarray, most: int, reach: int, both: int, own: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, pairs_at_once: int = 4_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of ``near_pairs`` those that join what neither equal labels nor pairs before them join, as if each
    were a link: a group gives fewer than it has members. Groups that had others are the last, to be asked again with the
    labels that the pairs gave. A pair that is not its group's ``own`` joins like one, and its own group gives it."""
    common, mask, first, nodes = _tree(fp, group)
    grid_a, grid_b = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
    order = np.lexsort((label, group))
    edge = np.flatnonzero(np.r_[True, (label[order][1:] != label[order][:-1]) | (group[order][1:] != group[order][:-1])][: len(fp)])
    known = np.empty(len(fp), np.int64)
    known[order] = np.repeat(order[edge], np.diff(np.r_[edge, len(fp)]))
    root = known.copy()
    spans = [_span(known, first, k) for k in range(len(first) + 1)]
    places = [np.arange(len(fp))]
    for f in first:
        places.append(places[-1][f[:-1]])
    unfinished, out = [np.zeros(0, group.dtype)], []
    todo = [(len(first), nodes[i : i + pairs_at_once], nodes[i : i + pairs_at_once]) for i in range(0, len(nodes), pairs_at_once)]
    while todo:
        level, a, b = todo.pop()
        start, below = first[level - 1], level - 1
        i, j = start[a][:, None] + grid_a, start[b][:, None] + grid_b
        ok = (i < start[a + 1][:, None]) & (j < start[b + 1][:, None]) & ((i < j) if level == 1 else (i <= j))
        i, j = i[ok], j[ok]
        near = np.bitwise_count((common[below][i] ^ common[below][j]) & mask[below][i] & mask[below][j]) <= reach
        near &= ~_one_set(*spans[below], i, j)
        i, j = i[near], j[near]
        if below:
            done = _one_set(*_span(root, first, below), i, j)
            unfinished.append(np.unique(group[places[below][i[done]]]))
            i, j = i[~done], j[~done]
            same = i == j
            for x, y in ((i[~same], j[~same]), (i[same], j[same])):  # close kin are opened first
                todo += [(below, x[k : k + pairs_at_once], y[k : k + pairs_at_once]) for k in range(0, len(x), pairs_at_once)]
            continue
        bits = np.bitwise_count(fp[i] ^ fp[j])
        near = (bits <= most) | (bits + np.bitwise_count(second[i] ^ second[j]) <= both)
        i, j = i[near], j[near]
        mine = own(i, j)
        joined = root[i] == root[j]
        unfinished.append(np.unique(group[i[joined & mine]]))
        i, j, mine = i[~joined], j[~joined], mine[~joined]
        if keep is not None:
            near = keep(i, j)
            i, j, mine = i[near], j[near], mine[near]
        order = np.argsort(mine, kind="stable")  # what another group gives comes first
        i, j, mine = i[order], j[order], mine[order]
        while len(i):
            low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            _, at = np.unique(high, return_index=True)  # a set joins one with a smaller root, so no circle closes
            given = at[mine[at]]
            out.append((i[given], j[given]))
            root[high[at]] = low[at]
            while not ((up := root[root]) == root).all():
                root = up
            rest = np.ones(len(i), bool)
            rest[at] = False
            joined = root[i] == root[j]
            unfinished.append(np.unique(group[i[rest & joined & mine]]))
            i, j, mine = i[~joined], j[~joined], mine[~joined]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(y for _, y in out)]), np.unique(np.concatenate(unfinished))


def _one_set(low: np.ndarray, high: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the members of the nodes i and j are all in one set, given each node's least and largest root."""
    return (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])


def _nth(x: np.ndarray) -> np.ndarray:
    """How many equal entries stand before each."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(edge, np.diff(np.r_[edge, len(x)]))
    return out


def _span(root: np.ndarray, first: list[np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray]:
    low = high = root
    for k in range(level):
        low, high = np.minimum.reduceat(low, first[k][:-1]), np.maximum.reduceat(high, first[k][:-1])
    return low, high


def _grouped(held: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by bucket and Gray rank, their fingerprints and the numbers of their buckets."""
    d = pd.concat(held)
    fp = d["fp"].to_numpy().view(np.uint64)
    key = d["block"].to_numpy().astype(np.int64) << 56 ^ d["bucket"].to_numpy()
    _, group = np.unique(key, return_inverse=True)
    order = np.lexsort((gray_rank(fp), group))
    return d.iloc[order], fp[order], group[order]


def _bucket_links(most: int):
    def close(held: list[pd.DataFrame]) -> pd.DataFrame:
        _, fp, group = _grouped(held)
        root = linked(fp, group, most)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[moved].view(np.int64), "v": fp[root[moved]].view(np.int64)})

    return _by_bucket(close)


def _bucket_pairs(most: int, enough: int | None, reach: int, both: int, masks: list[int], least: float):
    """Each pair in the first of the buckets it shares; a bucket not gone through is a row without a pair. Rows with a
    ``sketch`` are paired only where those leave a similarity of ``least`` possible, and only such pairs are counted.
    Without ``enough`` only spanning pairs are given."""
    masks = np.array(masks, np.uint64)

    def close(held: list[pd.DataFrame]) -> pd.DataFrame:
        d, fp, group = _grouped(held)
        block, bucket, key = (d[c].to_numpy() for c in ("block", "bucket", "key"))

        def own(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.ones(len(i), bool)
            for k, m in enumerate(masks):
                out &= (block[i] % len(masks) <= k) | ((fp[i] ^ fp[j]) & m != 0)
            return out

        possible = _possible(d["sketch"], d["size"], least) if "sketch" in d else None

        def keep(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = own(i, j)
            if possible is not None:
                out[out] = possible(i[out], j[out])
            return out

        second, label = d["second"].to_numpy().view(np.uint64), d["label"].to_numpy()
        if enough is None:
            i, j, rest = spanning_pairs(fp, second, group, label, most, reach, both, own, possible)
        else:
            i, j, rest = near_pairs(fp, second, group, label, most, enough, reach, both, keep)
        at = np.searchsorted(group, rest)
        pairs = pd.DataFrame({"u": np.minimum(key[i], key[j]), "v": np.maximum(key[i], key[j]), "block": block[i], "bucket": bucket[i], "tested": True})
        return pd.concat([pairs, pd.DataFrame({"u": 0, "v": 0, "block": block[at], "bucket": bucket[at], "tested": False})])

    return _by_bucket(close)


#: Bits of a sketch an element of its set, and the most bits of one.
SKETCH_BITS, MOST_SKETCH_BITS = 16, 1 << 15


def sketch(elements: np.ndarray) -> bytes:
    """Bit c: the parity of the number of elements that are c modulo the number of bits. Two sketches differ in no more
    bits than their sets in elements, whatever these have in common."""
    bits = min(MOST_SKETCH_BITS, max(512, 1 << int(SKETCH_BITS * len(elements) - 1).bit_length()))
    odd = np.bincount((elements.astype(np.int64) & (bits - 1)), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"key": b["key"].to_numpy(), "sketch": [sketch(np.asarray(x)) for x in b["set"]], "size": [len(x) for x in b["set"]]})


def _possible(sketches: pd.Series, sizes: pd.Series, least: float, words_at_once: int = 1 << 21):
    """Whether the sets of places i and j may have a Jaccard similarity of ``least``. Their sketches and sizes give
    the fewest elements that only one of them has, so none that has it is refused; one without a sketch may be anything."""
    none = sketches.isna().to_numpy()
    held = [b"" if no else x for x, no in zip(sketches, none)]
    width = np.fromiter((len(x) // 8 for x in held), np.int64, len(held))
    start, flat = np.cumsum(width) - width, np.frombuffer(b"".join(held), "<u8")
    size = sizes.fillna(0).to_numpy().astype(np.int64)

    def folded(at: np.ndarray, w: int, to: int) -> np.ndarray:
        return np.bitwise_xor.reduce(flat[start[at][:, None] + np.arange(w)].reshape(len(at), w // to, to), axis=1)

    def run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total, apart = size[i] + size[j], np.abs(size[i] - size[j])
        fits = lambda x: (total - x) / 2 >= least * (total - (total - x) / 2)
        ok = none[i] | none[j] | fits(apart)
        ask = np.flatnonzero(ok & ~none[i] & ~none[j])
        kinds, kind = np.unique(np.stack([width[i[ask]], width[j[ask]]]), axis=1, return_inverse=True)
        for k, (a, b) in enumerate(kinds.T.tolist()):
            of, to = ask[kind.ravel() == k], min(a, b)
            step = max(1, words_at_once // max(a, b))
            for lo in range(0, len(of), step):
                part = of[lo : lo + step]
                bits = np.bitwise_count(folded(i[part], a, to) ^ folded(j[part], b, to)).sum(axis=1, dtype=np.int64)
                apart[part] = np.maximum(apart[part], bits)
        return none[i] | none[j] | fits(apart)

    return run


def _by_bucket(close, rows_at_once: int = 200_000):
    def rows(d: pd.DataFrame) -> int:  # a sketch weighs as much as so many rows
        return len(d) + (sum(map(len, d["sketch"].dropna())) // 128 if "sketch" in d else 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:  # sorted by bucket: whole buckets go together
            held.append(b)
            size += rows(b)
            if size >= rows_at_once:
                d = pd.concat(held)
                last = (d["block"] == d["block"].iloc[-1]) & (d["bucket"] == d["bucket"].iloc[-1])
                if not last.all():
                    yield close([d[~last]])
                    held = [d[last]]
                    size = rows(held[0])
                else:
                    held = [d]
        if size:
            yield close(held)

    return run


def needed(n: int, most: int, bucket: int = 1000) -> int:
    """How many blocks two linked fingerprints of ``n`` must agree on for buckets of about ``bucket`` evenly spread ones."""
    agree = 1 if most <= 3 else 2
    while 64 * agree / (most + agree) < log2(max(n, 1) / bucket):
        agree += 1
    return agree


def _dealt(rows: DataFrame, most: int, agree: int) -> tuple[DataFrame, list[int]]:
    """``rows`` once a choice of blocks, with ``block`` and ``bucket``, and the bits of each choice.

    The bits are cut into ``most + agree`` blocks; two linked fingerprints agree on ``agree`` of them, whichever, so
    each is dealt once for every choice of so many blocks (4 for three bits, 28 for six)."""
    blocks = most + agree
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = lambda i: F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    def key(chosen: tuple[int, ...]):
        out = F.lit(0).cast("long")
        for i in chosen:
            out = F.shiftleft(out, edges[i + 1] - edges[i]).bitwiseOR(part(i))
        return out

    choices = list(combinations(range(blocks), agree))
    dealt = rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), key(c).alias("bucket")) for k, c in enumerate(choices)])).alias("k")).select(*rows.columns, "k.block", "k.bucket")
    return dealt, [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in c) for c in choices]


def links(distinct: DataFrame, most: int = 3, agree: int | None = None) -> DataFrame:
    """Spanning links ``u, v`` between the distinct fingerprints ``fp``."""
    dealt, _ = _dealt(distinct, most, agree or needed(distinct.count(), most))
    return dealt.repartition("block", "bucket").sortWithinPartitions("block", "bucket").mapInPandas(_bucket_links(most), "u long, v long")


#: Pairs beyond the bits that are dealt for are candidates up to so many bits of the first and of both fingerprints: texts
#: that share 80 % of their five-word shingles differ in some 8 and 15 bits, evenly spread fingerprints of 5e10 others
#: hold one so near to 1 % of the texts.
REACH, BOTH = 12, 24


def sketches(agree: int) -> int:
    """How many fingerprints of a text are dealt: where buckets need keys of more than two blocks, fewer of the pairs beyond
    ``most`` bits share one, and the second fingerprint, which is as good as another seed's, finds those the first misses."""
    return 1 if agree <= 2 else 2


def similar_links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], most: int, least: float, enough: int = 16, reach: int = REACH, both: int = BOTH, agree: int | None = None) -> DataFrame:
    """``key, fp, second`` -> links ``u, v`` of keys that join what candidate pairs whose sets have a Jaccard
    similarity of ``least`` or more join. Candidates are all pairs within ``most`` bits, and those of a common bucket
    within ``reach`` bits of the first fingerprint and ``both`` of the two together. ``sets`` gives ``key, set`` for a table of keys; only keys of candidates are asked
    for, each once.

    Rounds: the first two ask of a bucket only for pairs that span its candidates, fewer than it has members. Members
    joined by then are not compared in the next round, which goes through the buckets that had more: from the third on
    each member with ``enough`` others of each of its buckets at most, then eight times as far, until none is left. Every
    member that has a candidate is in a pair of the first round, so from the second on it brings a sketch of its set, and
    pairs that these show to be less similar than ``least`` are left out in the bucket. So a group of near copies costs rows for its members and links, not for its
    pairs, also where many of its members are candidates of each other and yet not similar."""
    label, rest, found, have = nodes.select("key", "fp", "second", F.col("key").alias("label")), None, None, None
    agree = agree or needed(nodes.count(), most)
    rounds = 0
    while True:
        farther = None if rounds < 2 else enough * 8 ** (rounds - 2)
        dealt, masks = _dealt(label, most, agree)
        if sketches(agree) == 2:
            other, _ = _dealt(label.select("key", F.col("second").alias("fp"), F.col("fp").alias("second"), "label"), most, agree)
            dealt = dealt.unionByName(other.withColumn("block", F.col("block") + len(masks)))
        if rest is not None:
            dealt = dealt.join(rest, ["block", "bucket"], "left_semi").join(have.mapInPandas(_sketches, "key long, sketch binary, size int"), "key", "left")
        asked = dealt.repartition("block", "bucket").sortWithinPartitions("block", "bucket").mapInPandas(_bucket_pairs(most, farther, reach, both, masks, least), "u long, v long, block int, bucket long, tested boolean")
        asked = stage(asked, "simhash-asked")
        ends = asked.filter("tested").select(F.explode(F.array("u", "v")).alias("key")).distinct()
        new = stage(ends if have is None else ends.join(have.select("key"), "key", "left_anti"), "simhash-keys")
        if have is None or not new.isEmpty():
            fresh = stage(sets(new), "simhash-sets")
            have = fresh if have is None else have.unionByName(fresh)
        side = lambda n: have.select(F.col("key").alias(f"k{n}"), F.col("set").alias(f"set{n}"))  # noqa: B023, E731
        tested = asked.filter("tested").select("u", "v")
        couples = (tested.distinct() if sketches(agree) == 2 else tested).join(side(1), F.col("u") == F.col("k1")).join(side(2), F.col("v") == F.col("k2"))
        shared = couples.select("u", "v", F.size(F.array_intersect("set1", "set2")).alias("n"), (F.size("set1") + F.size("set2")).alias("m"))
        now = stage(shared.filter(F.col("n") >= least * (F.col("m") - F.col("n"))).filter("n > 0").select("u", "v"), "simhash-similar")
        found = now if found is None else found.unionByName(now)
        rest = asked.filter("NOT tested").select("block", "bucket").distinct()
        if rest.isEmpty():
            return found
        root = components(found)
        label = stage(nodes.select("key", "fp", "second").join(root, F.col("key") == F.col("node"), "left").select("key", "fp", "second", F.coalesce("root", "key").alias("label")), "simhash-labels")
        rounds += 1


def word_digests(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """``digest`` (128 bits of the words) and two fingerprints, ``fp`` and ``second``, beside ``keep``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                digest = [xxhash.xxh3_128_digest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())) for t in part["__text"]]
                hashes = [shingle_hashes(t, 3) for t in part["__text"]]
                two = {"fp": fold_bits(hashes).view(np.int64), "second": fold_bits([remixed(h) for h in hashes]).view(np.int64)}
                yield part.drop(columns="__text").assign(digest=digest, **two)
        release()

    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return d.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in d.dtypes if n != "__text") + ", digest binary, fp long, second long")


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "set": [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in part["text"]]})
        release()

    return run


#: Rows whose places are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def one_of_similar(docs: DataFrame, most: int, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", enough: int = 16, broadcast_rows: int = BROADCAST_ROWS, agree: int | None = None) -> DataFrame:
    """The document of the smallest id of each group that equal words and ``similar_links`` join, all columns kept; of
    identical rows one stays. Two fingerprints of three words a shingle find candidates only; sets of ``shingle``
    words are made of one row for each text that is a candidate."""
    keyed, row = numbered(docs)
    at = [F.col(f"{row}.file").alias("__file"), F.col(f"{row}.at").alias("__at")]
    rows = word_digests(keyed.select(F.col(id_col).alias("__id"), *at, F.col(text_col).alias("__whole")), ("__id", "__file", "__at"), "__whole")
    nodes = rows.groupBy("digest").agg(F.first("fp").alias("fp"), F.first("second").alias("second"), F.min(F.struct("__id", "__file", "__at")).alias("stays"))
    nodes = stage(nodes.withColumn("key", F.monotonically_increasing_id()).drop("digest"), "simhash-nodes")

    def sets(keys: DataFrame) -> DataFrame:
        places = nodes.join(keys, "key", "left_semi").select("key", F.col("stays.__file").alias("k_file"), F.col("stays.__at").alias("k_at"))
        if keys.count() <= broadcast_rows:
            places = F.broadcast(places)
        texts = keyed.select(*at, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(places, (F.col("__file") == F.col("k_file")) & (F.col("__at") == F.col("k_at")))
        return texts.select("key", "text").mapInPandas(_shingle_sets(shingle), "key long, set array<bigint>")

    root = components(similar_links(nodes, sets, most, least, enough, agree=agree))
    stays = nodes.select("key", "stays").join(root, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("stays").alias("s"))
    return _staying(docs, keyed, row, stays.select("s.__file", "s.__at"))


def _staying(docs: DataFrame, keyed: DataFrame, row: str, places: DataFrame) -> DataFrame:
    """The rows of ``docs`` at the ``places`` (file and place), all their columns and no more."""
    file, at = (unused(c, keyed) for c in ("__stays_file", "__stays_at"))
    named = places.select(F.col("__file").alias(file), F.col("__at").alias(at))
    return keyed.join(named, (F.col(f"{row}.file") == F.col(file)) & (F.col(f"{row}.at") == F.col(at)), "left_semi").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = 3, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", least_hot: int = LEAST_HOT) -> DataFrame:
    """``doc_id, root, fingerprint, component_id`` and the columns in ``keep``, one row a document; ``root`` is the
    component's smallest fingerprint."""
    named = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    prints = stage(fingerprints(named, shingle, ("doc_id", *keep)), "simhash-prints", pack=False)
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    root = components(links(distinct.select("fp"), most))
    classes = distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")).withColumnRenamed("root", "r")
    total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    named = beside(classes, names, "root", "r", "m", total[0], least_hot).select(F.col("fp").alias("cfp"), "component_id", "root", "n")
    # copies may be any share of all rows, and all texts without a word have one fingerprint
    every = beside(prints, named, "fp", "cfp", "n", total[1], least_hot)
    return every.select("doc_id", "root", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *keep)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The document of the smallest id of each component, all columns kept; of identical rows one stays."""
    keyed, row = numbered(docs)
    at = [F.col(f"{row}.file").alias("__file"), F.col(f"{row}.at").alias("__at")]
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    named = keyed.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *at)
    stays = near_duplicates(named, keep=("__file", "__at"), **options).groupBy("root").agg(F.min(F.struct("doc_id", "__file", "__at")).alias("s"))
    return _staying(docs, keyed, row, stays.select("s.__file", "s.__at"))
