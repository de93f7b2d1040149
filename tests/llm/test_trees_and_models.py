"""Hard negatives, language-model scores and Merkle proofs against plain Python, with nulls, ties, repeats and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nexuloom.llm import merkle, negatives, queries, scoring

from .test_ops import SCHEMA, by_id, make

CLASHES = ("row", "id", "slot", "looked", "at", "g", "node", "total", "block", "kind", "held", "owner", "mid", "pid", "key", "score", "place", "__row")


def clashing(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def rows():
    return make(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA))


# ---- 11 -------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, label int, vector array<bigint>"


def mined(vectors, asks, positives=5, negatives_=10, low=30, high=90):
    """Plain Python: lists of ``(anchor, positive, rank, negative, positive score, negative score)``."""
    ok = [(i, n, lab, v) for n, (i, lab, v) in enumerate(vectors) if lab is not None and v is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    last = lambda i: (i is None, i or 0)
    out = []
    for i, n, lab, v in ok:
        if i is None or not asks(i):
            continue
        others = [(dot(v, w), j, m) for j, k, m, w in ok if k != n and len(w) == len(v)]
        best = sorted((x for x in others if x[2] == lab), key=lambda x: (-x[0], last(x[1])))[:positives]
        for p, j, _ in best:
            fit = sorted((x for x in others if x[2] != lab and low * p <= 100 * x[0] <= high * p), key=lambda x: (-x[0], last(x[1])))
            out += [(i, j, r + 1, x[1], p, x[0]) for r, x in enumerate(fit[:negatives_])]
    return sorted(out, key=str)


def vectors(seed, n=260, width=6):
    r = random.Random(seed)
    middle = [[r.randint(-90, 90) for _ in range(width)] for _ in range(6)]
    out = [(i, r.randint(0, 4), [c + r.randint(-8, 8) for c in r.choice(middle)]) for i in range(n)]
    common = middle[0]
    out += [(n + i, i % 3, common) for i in range(90)]  # a vector of a quarter of the rows
    out += [(1, 2, common), (1, 2, common), (20, 1, out[20][2]), (None, 1, common), (None, None, common), (n + 200, None, common), (n + 201, 1, None), (n + 202, 1, [1, 2]), (n + 220, 2, [3, 4]), (n + 221, 2, [5, 1]), (n + 240, 1, [0] * width)]
    return out


@pytest.mark.parametrize("seed,block_bytes,partition_bytes", [(1, 16 << 20, 32 << 20), (2, 400, 2000)])
def test_negatives(spark, seed, block_bytes, partition_bytes):
    v = vectors(seed)
    df = clashing(spark.createDataFrame(v, VECTORS).repartition(3))
    got = negatives.mine(df, F.col("vec_id") % 20 == 0, block_bytes=block_bytes, partition_bytes=partition_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == mined(v, lambda i: i % 20 == 0)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.mine(none, F.col("vec_id") % 20 == 0).collect() == []
    v = [(20, 1, [1, 2]), (3, 2, [1, 2]), (None, 1, [4, 4]), (40, 3, [1, 1]), (60, 4, [-9, 1]), (61, 4, [1, 1])]
    got = negatives.mine(spark.createDataFrame(v, VECTORS), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == mined(v, lambda i: i % 20 == 0)


def test_large_components_are_exact(spark):
    big = 1 << 29
    v = [(20, 1, [big, big]), (1, 1, [big, big + 1]), (2, 2, [big // 2, big // 2 + 1]), (3, 2, [big // 2, big // 2]), (4, 2, [big, big])]
    got = negatives.mine(spark.createDataFrame(v, VECTORS), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == mined(v, lambda i: i % 20 == 0)


def test_trees_leave_out_most(spark):
    """Bounds from above and below: on clustered rows the negatives' search looks at a part of the scores."""
    r = np.random.default_rng(5)
    middle = r.integers(-200, 200, (40, 8))
    x = (middle[r.integers(0, 40, 6000)] + r.integers(-6, 7, (6000, 8))).astype(np.int64)
    tree = negatives.Ball(x, np.arange(6000), np.arange(6000))
    q = x[:50]
    low, high = np.full((50, 1), 60_000), np.full((50, 1), 120_000)
    best = negatives.Best(50, 10)
    looked = negatives.search(tree, q, np.arange(50), low, high, best, np.arange(50)[:, None])
    best.cut()
    score = q @ x.T
    np.fill_diagonal(score[:, :50], -1)
    for a in range(50):
        fit = sorted(((-s, i) for i, s in enumerate(score[a].tolist()) if 60_000 <= s <= 120_000))[:10]
        mine = best.held[0] == a
        assert list(zip((-best.held[1][mine]).tolist(), best.held[2][mine].tolist())) == fit
    assert looked < 0.3 * 50 * 6000


# ---- 12 -------------------------------------------------------------------------------------------------------------


def lm(rows, learned, order, strength):
    """Plain Python: ``doc_id -> n_tokens, n_known, N, base, score`` by the recursion, without an automaton."""
    texts = [(d, [*(t or "").encode().lower().split(), b"\n/"]) for d, t in rows]
    counts = [Counter() for _ in range(order)]
    opened = 0
    for d, w in texts:
        if not learned(d):
            continue
        opened += 1
        w = [b"\n", *w]
        for k in range(order):
            counts[k].update(tuple(w[i - k : i + 1]) for i in range(max(1, k), len(w)))
    n, v = sum(counts[0].values()), len(counts[0])
    c = lambda g: opened if g == (b"\n",) else counts[len(g) - 1][g]

    def p(g):
        if len(g) == 1:
            return (c(g) + 0.1) / (n + 0.1 * (v + 1))
        return (c(g) + strength * p(g[1:])) / (c(g[:-1]) + strength)

    out = {}
    for d, w in texts:
        whole = [b"\n", *w]
        score = sum(math.log10(p(tuple(whole[max(0, i - order + 1) : i + 1]))) for i in range(1, len(whole)))
        out[d] = (len(w), sum(c((x,)) > 0 for x in w), n, sum(math.log10(p((x,))) for x in w), score)
    return out


@pytest.mark.parametrize("order,block_tokens", [(1, 500_000), (2, 500_000), (2, 700), (3, 500_000), (3, 97), (4, 700)])
def test_scores(docs, rows, order, block_tokens):
    learned = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    learn = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    got = by_id(scoring.score(docs.repartition(3), learn, order, 3.0, block_tokens, key_bits=40, slice_tokens=1000))
    want = lm([(r[0], r[1]) for r in rows], learned, order, 3.0)
    assert set(got) == set(want)
    for d, (tokens, known, n, base, score) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learned(d), tokens, known, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_scores_of_nothing_and_of_nothing_learned(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert scoring.score(none, F.lit(True)).count() == 0
    got = scoring.score(docs, F.lit(None).cast("boolean")).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 == r["n_known"] and r["base_score"] == pytest.approx(0) and r["score"] == pytest.approx(0) for r in got)
    repeated = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (7, "a b"), (7, None)], "doc_id long, text string")
    got = scoring.score(repeated, F.col("doc_id") == 7).collect()
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"]) for r in got) == [(0, True, 3, 3)] * 2 + [(7, False, 1, 1)] + [(7, False, 3, 3)] * 2


def test_longer_histories_say_more_of_held_out_texts(spark):
    """On the test tables, two tokens are better than one on texts that were not learned from."""
    got = queries.op12_score(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert got[0] > got[1]


def test_what_the_slices_say(spark, rows):
    """Runs merged a few keys at a time, keys of few bits, many slices: the same counts."""
    x = [np.sort(np.unique(np.random.default_rng(s).integers(0, 1 << 63, 500).astype(np.uint64))) for s in range(4)]
    for k in x:
        assert (scoring.unpack_keys(scoring.pack_keys(k)) == k).all()
        parts = list(scoring.sliced(k, 3))
        assert [p[0] for p in parts] == sorted({v >> 61 for v in k.tolist()})
        assert sum(hi - lo for _, lo, hi in parts) == len(k)
    k, c = scoring._sum_by([x[0], x[1], x[0]], [np.full(len(x[0]), 2, np.uint64), np.ones(len(x[1]), np.uint64), np.ones(len(x[0]), np.uint64)])
    assert (k == np.union1d(x[0], x[1])).all() and c.sum() == 3 * len(x[0]) + len(x[1])


# ---- 13 -------------------------------------------------------------------------------------------------------------


def tree(nodes):
    """Plain Python: the root of the nodes and, for each, its siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            lo = a - a % 16
            paths[i].append((nodes[lo:a], nodes[a + 1 : lo + 16]))
            at[i] = a // 16
        nodes = [hashlib.sha256("".join(nodes[i : i + 16]).encode()).hexdigest() for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def proofs(rows, tamper):
    """``rows``: (doc_id, source, lang, n_chars, text) -> sorted results of the contract."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    h = lambda r: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for r in rows:
        other = h((*r[:4], r[4].translate(lower) if r[4] is not None else None)) if r[0] is not None and tamper(r[0]) else None
        by[r[1]].append((r[0], h(r), other))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        inner[s] = tree([r[1] for r in by[s]])
    root, over = tree([inner[s][0] for s in names]) if names else (None, [])
    out = []
    for k, s in enumerate(names):
        for (doc, leaf, other), path in zip(by[s], inner[s][1], strict=True):
            node = other or leaf
            for left, right in path + over[k]:
                node = sha("".join([*left, node, *right]))
            out.append((doc, leaf, inner[s][0], root, sha("".join("".join(a + b) for a, b in path + over[k])), node, node == root))
    return sorted(out, key=str)


def proved(spark, rows, top=merkle.TOP):
    df = clashing(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": lowered}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, top)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("fan_height,top", [(3, 1024), (1, 3), (1, 1)])
def test_proofs(spark, monkeypatch, fan_height, top):
    """With blocks of 16 and a top of a few nodes: several rounds of blocks, and more sources than the top holds."""
    monkeypatch.setattr(merkle, "HEIGHT", fan_height)
    monkeypatch.setattr(merkle, "BLOCK", 16**fan_height)
    r = random.Random(7)
    sources = [None, "", "é", "a", "Z", *(f"s{i}" for i in range(30))]
    rows = [(i, r.choice(sources), r.choice(["en", None]), r.choice([3, None]), r.choice(["Some Text ", "plain ", "É "]) * r.randint(0, 4)) for i in range(300)]
    rows += [(400 + i, "hot", "en", 1, "One Text") for i in range(700)]
    rows += [(None, "a", None, None, None), (None, "a", None, None, None), (5, "a", "en", 1, "again"), (5, "a", "en", 1, None), (900, "é", None, 0, "Long " * 50_000)]
    tamper = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    got = proved(spark, rows, top)
    assert got == proofs(rows, tamper)
    assert {r[6] for r in got} == {True, False}


def test_proof_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df, ["doc_id", "text"], "source", "doc_id").collect() == []
    one = proved(spark, [(3, None, None, None, "x")])
    assert one == proofs([(3, None, None, None, "x")], lambda d: False)
    assert one[0][1] == one[0][2] == one[0][3] and one[0][6]


@pytest.mark.parametrize("top,written", [(1024, ["leaves", "sorted", "blocks"]), (3, ["leaves", "sorted", "blocks", "blocks", "sorted", "blocks", "paths", "paths"])])
def test_nodes_of_a_level_are_not_written_beside_its_blocks(spark, monkeypatch, top, written):
    """A row of a table of blocks is a node of the next level: it is counted there."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    labels, whole = [], merkle.stage
    monkeypatch.setattr(merkle, "stage", lambda df, label, **options: labels.append(label) or whole(df, label, **options))
    rows = [(i, f"s{i % 16}", "en", 1, "Some Text") for i in range(400)]
    assert proved(spark, rows, top) == proofs(rows, lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    assert labels == [f"merkle-{x}" for x in written]
