"""Sources with a cache, workbooks, row groups, quantiles, containment joins, decisions."""

import json
import random
import re
from decimal import Decimal

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from nexuloom.functions import text
from nexuloom.operators import agent, build, context, package, paths, relational, retrieval
from nexuloom.plans import search
from nexuloom.sources import readers, writers
from nexuloom.staging import grow, input_bytes, packed


def test_document_behind_a_url(tmp_path):
    cache = str(tmp_path / "model.yaml")
    asked = []

    def fetch(url):
        asked.append(url)
        return "classes: {}"

    def gone(url):
        raise OSError("no network")

    with pytest.raises(RuntimeError, match="no copy at"):
        readers.document("https://host/model.yaml", cache, offline=True, fetch=fetch)
    with pytest.raises(RuntimeError, match="no copy at"):
        readers.document("https://host/model.yaml", cache, fetch=gone)
    assert asked == [] and readers.document("https://host/model.yaml", cache, fetch=fetch) == "classes: {}"
    assert readers.document("https://host/model.yaml", cache, fetch=gone) == "classes: {}" == readers.document("https://host/model.yaml", cache, offline=True)
    assert readers.document(cache, "") == "classes: {}" and asked == ["https://host/model.yaml"]


def test_plain_yaml():
    got = readers.yaml_subset("# c\na:\n  b: 'x: y'   \n  c: [p, \"q\"]\n  d:\n  - one\n  - two # last\ne: true\nf: |\n  l1\n  l2\ng: ~\n")
    assert got == {"a": {"b": "x: y", "c": ["p", "q"], "d": ["one", "two"]}, "e": True, "f": "l1\nl2", "g": None}
    assert readers.yaml_subset("") == {}
    with pytest.raises(ValueError, match="not in this subset"):
        readers.yaml_subset("a: &x 1")


def test_workbooks(spark):
    d = spark.createDataFrame([("a & <b>", 1.5, None), ("  c", None, "x"), (None, 2.0, "lost")], "name string, v double, n string")
    many = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(30)])
    book = writers.workbook({"one": d, "wide": many})
    assert [tuple(r) for r in readers.sheet(spark, book, "one").collect()] == [("a & <b>", "1.5", None), ("  c", None, "x")]
    wide = readers.sheet(spark, book, 1)
    assert wide.columns[26:28] == ["c26", "c27"] and wide.head()[29] == "29"
    with pytest.raises(ValueError, match="more than"):
        writers.workbook({"x": spark.range(11)}, most=10)


def test_row_groups(spark, tmp_path):
    writers.parquet(spark.range(0, 5000, 1, 1), f"{tmp_path}/t", 600, 2)
    files = [pq.ParquetFile(p).metadata for p in tmp_path.glob("t/*.parquet")]
    assert all(m.num_rows <= 1200 for m in files) and all(m.row_group(i).num_rows <= 600 for m in files for i in range(m.num_row_groups))


def test_packing(spark, tmp_path, monkeypatch):
    from nexuloom import staging

    spark.range(0, 200_000, 1, 40).write.parquet(f"{tmp_path}/t")
    d = spark.read.parquet(f"{tmp_path}/t").repartition(64)
    assert input_bytes(spark.createDataFrame([(1,)], "a int")) < 1000 < input_bytes(d)
    assert packed(d).rdd.getNumPartitions() == 16
    monkeypatch.setattr(staging, "PACK_BYTES", input_bytes(d) // 30)
    assert packed(d).rdd.getNumPartitions() >= 30
    with pytest.raises(RuntimeError, match="did not settle"):
        grow(spark.range(1), lambda d: d.select((F.col("id") + 1).alias("id")), ["id"], "endless", 3)


@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 0.99, 1.0])
def test_quantiles(spark, p):
    r = random.Random(3)
    rows = [(g, r.choice([0.0, -1.5, 1e-7, 0.25, r.random() * 10 ** r.randint(-6, 3)])) for g in "abc" for _ in range(r.randint(1, 60))] + [("one", 2.5), ("none", None)]
    got = {x["g"]: x["thr"] for x in context.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", p).collect()}
    want = {g: float(np.quantile([v for h, v in rows if h == g], p)) for g in ("a", "b", "c", "one")}
    assert got == pytest.approx(want)


def test_presence_counts_better_nodes(spark):
    s = spark.createDataFrame([(f"n{i}", "c" if i % 3 else "d", 1, float(i // 2)) for i in range(20)], "node string, category string, hop int, score double")
    ids = spark.createDataFrame([("n3",), ("n4",), ("n19",), ("n0",), ("x",)], "id string")
    rows = [r.asDict() for r in s.collect()]
    for r in context.presence(s, ids).collect():
        mine = [x for x in rows if x["node"] == r["id"]]
        assert r["reached"] == bool(mine)
        if mine:
            of = [x["score"] for x in rows if x["category"] == mine[0]["category"]]
            assert (r["rank"], r["of"]) == (1 + sum(v > mine[0]["score"] for v in of), len(of))


def test_containment_without_pairs(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 7))).strip() or "a"
    g, m = [(i, word()) for i in range(60)], [(i, word() + r.choice(["", " x", "b"])) for i in range(80)]
    got = relational.held_in(spark.createDataFrame(g, "gid int, g string"), spark.createDataFrame(m, "mid int, m string"), "g", "m").select("gid", "mid").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, x in g for j, y in m if x in y)


def test_private_types_and_arguments(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).head())
    assert one(text.is_private(F.lit("x"), F.array(F.lit("Cohort"))), text.is_private(F.lit("x"), F.array(F.lit("CASE"))), text.is_private(F.lit("x"), F.array(F.lit("gene")))) == (True, True, False)
    assert one(*[text.tool_argument(F.lit(x)) for x in ("TNF (human)", ' class_name = "treatment" ', "'a b'", "[x]", "")]) == ("TNF (human)", "treatment", "a b", "[x]", "")
    classes = spark.createDataFrame([("small molecule",)], "name string")
    calls = spark.createDataFrame([("get_class_hierarchy", "'Small_Molecule'"), ("get_class_hierarchy", "ship"), ("lookup_exact_term", "x" * 301), ("lookup_exact_term", None), ("fly", "x")], "tool string, argument string")
    got = {(r["tool"], r["argument"]): (r["ok"], r["clean"]) for r in text.checked_arguments(calls, classes).collect()}
    assert got[calls.collect()[0][0], "'Small_Molecule'"] == (True, "small molecule") and sum(ok for ok, _ in got.values()) == 1


def test_typed_passes(spark):
    t = spark.createDataFrame([("a", ["gene", "NONE", "", "biolink:Drug", "gene"]), ("b", [])], "term string, types array<string>")
    assert sorted(map(tuple, retrieval.typed_passes(t).collect())) == [("a", "biolink:Drug", 1), ("a", "biolink:Gene", 2)]


def test_one_decision_a_term(spark):
    asked = []

    def model(q):
        rows = q.collect()
        asked.extend(r["prompt"] for r in rows)
        return spark.createDataFrame([(r["key"], "maybe gene" if "dux4" in r["key"] else "FINAL_VERDICT: drug") for r in rows], "key string, reply string")

    classes = spark.createDataFrame([("gene",), ("drug",), ("gene family",)], "name string")
    t = spark.createDataFrame([(1, "DUX4", "s", ["gene", "drug"]), (2, "dux4", "s", ["gene"]), (3, "aspirin", "s", ["drug"]), (4, "thing", "s", ["gene"]), (5, "alone", "s", []), (6, "x" * 6000, "s", ["gene"])], "i int, term string, sentence string, candidates array<string>")
    got = {r["i"]: r["class_name"] for r in agent.decide(t, classes, model, "{term} {candidates}").collect()}
    assert got == {1: "gene", 2: "gene", 3: "drug", 4: None, 5: None, 6: None} and len(asked) == 3


def test_budget_loses_the_weakest(spark):
    r = random.Random(5)
    for budget in (9, 12, 20, 33):
        rows = [(f"n{i:02}", r.choice("aaaaabbc"), round(r.random(), 3), False, 1) for i in range(40)]
        d = spark.createDataFrame([*rows, ("s", "z", 0.0, True, 0)], "id string, cluster string, score double, is_seed boolean, hop int")
        members = {c: sorted((x for x in rows if x[1] == c), key=lambda x: (-x[2], x[0])) for c in "abc"}
        quota = {c: min(len(m), max(3, round(Decimal(budget * len(m)) / 40))) for c, m in members.items()}
        within = sorted((x for c, m in members.items() for x in m[: quota[c]]), key=lambda x: -x[2])[:budget]
        kept = {x["id"] for x in package.node_budget(d, budget + 1).collect()}
        assert len(kept) == budget + 1 and "s" in kept and {x[0] for x in within} <= kept
    assert json.loads("[]") == [] and package.node_budget(d, 0).count() == 1


def test_chains_of_one_round_a_link(spark):
    """Nothing limits the rounds: distances and the diameter of a chain; a node of its own has diameter 0."""
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(9)], "subject string, object string")
    d = paths.distances(chain, spark.createDataFrame([("000",)], "source string"))
    assert d.agg(F.max("dist"), F.count("*")).head() == (9, 10)
    members = chain.select(F.col("subject").alias("node")).union(chain.select("object")).distinct().withColumn("component", F.lit("000"))
    assert paths.diameter(members, chain).head()[0] == 9
    assert paths.diameter(spark.createDataFrame([("a", "a")], "node string, component string"), chain.limit(1)).head()[0] == 0
    assert paths.diameter(members.limit(0), chain).head()[0] is None


def test_searches_against_plain_ones(spark):
    """Bits of 70 sources, eccentricity bounds and two-sided ways against breadth-first search and relaxation."""
    r = random.Random(3)
    links = {(f"n{i:02}", f"n{r.randrange(90):02}"): round(r.random(), 3) for i in range(90) for _ in range(2)}
    links |= {("x1", "x2"): 0.5}
    around = {}
    for (a, b), w in links.items():
        for x, y in ((a, b), (b, a)):
            if x != y:
                around.setdefault(x, {})[y] = min(w, around.get(x, {}).get(y, 9))
    edges = spark.createDataFrame([(a, b) for a, b in links], "subject string, object string")

    def far(start, unit):
        best = dict.fromkeys(start, 0.0)
        todo = list(start)
        while todo:
            x = todo.pop(0)
            for y, w in around.get(x, {}).items():
                c = best[x] + (1 if unit else w)
                if c < best.get(y, 1e9) - 1e-12:
                    best[y] = c
                    todo.append(y)
        return best

    sources = sorted(around)[:70]
    want = {(s, n, int(d)) for s in sources for n, d in far([s], True).items()}
    got = paths.distances(edges, spark.createDataFrame([(s,) for s in sources], "source string"))
    assert {tuple(x) for x in got.collect()} == want
    nodes = spark.createDataFrame([(n,) for n in around], "node string")
    for at_once in (8,):
        members = nodes.withColumn("component", F.when(F.col("node").startswith("x"), "x").otherwise("n"))
        assert paths.diameter(members, edges, at_once).head()[0] == max(max(far([s], True).values()) for s in around if s[0] == "n")
    cost = spark.createDataFrame([(a, b, w) for a, near in around.items() for b, w in near.items() if a < b], "a string, b string, cost double")
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    for a, b in ((["n01", "n02"], ["n70", "n80"]), (["n05"], ["n05", "n06"]), (["n11"], ["x1"])):
        for unit in (False, True):
            found = paths.set_path(cost.withColumn("cost", F.lit(1.0)) if unit else cost, one(*a), one(*b))
            best = min((d for n, d in far(a, unit).items() if n in b), default=None)
            if best is None:
                assert found is None
                continue
            assert found[0] == pytest.approx(best) and found[1][0] in a and found[1][-1] in b
            assert sum(1 if unit else around[x][y] for x, y in zip(found[1], found[1][1:])) == pytest.approx(best)


def test_containment_against_every_pair(spark):
    """Parts of words, signs alone, tokens in another order, texts that many rows share; hot tokens split or not."""
    r = random.Random(8)
    words = ["gold", "golden", "old", "ring", "a", "x1", "x12", "supplier000001", "supplier000002", "é", "r"]
    make = lambda: {" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(60)} | {"--", "a-ring", "ring, a", "- -", "old r", "ld ri", "supplier00000"}
    left, right = sorted(make()), sorted(make())
    tokens = lambda t: set(re.findall(r"[A-Za-z0-9_]+", t))
    hit = lambda x, y: x in y or y in x or (tokens(x) and tokens(x) <= tokens(y)) or (tokens(y) and tokens(y) <= tokens(x))
    g = spark.createDataFrame([(i, t) for i, t in enumerate(left * 2)] + [(-1, "")], "gold_id long, g string")
    m = spark.createDataFrame([(i, t) for i, t in enumerate(right)] + [(-1, None)], "mention_id long, m string")
    want = {(x, y) for x in left for y in right if hit(x, y)}
    for split in (1, 100_000):
        got = relational.text_pairs(relational.texts_of(g, "g"), relational.texts_of(m, "m"), split).collect()
        assert {(p["x"], p["y"]) for p in got} == want and len(got) == len(want)
        assert all((p["status"] == "exact") == (p["x"] == p["y"]) for p in got)
    every = relational.theta_match(g, m, "g", "m").select("gold_id", "mention_id").collect()
    assert sorted(map(tuple, every)) == sorted((i, j) for i, x in enumerate(left * 2) for j, y in enumerate(right) if hit(x, y))


def test_candidates_grow_with_the_rows(spark):
    """Ten times the parts: some 19 times the pairs that are tested (names and brands fill up in between), a 140th of all."""
    n = []
    for sf in ("0.01", "0.1"):
        g, m = search._gold(spark, f"/root/testdata/sf{sf}")
        n.append(relational.candidate_pairs(relational.texts_of(g.select(F.lower("term").alias("t")), "t"), relational.texts_of(m.select(F.lower("text").alias("t")), "t")).count())
    assert 0 < n[1] <= 20 * n[0] and n[1] < 20_000**2 / 100, n


def test_neighbours_by_pivots(spark):
    """The same as every distance, for clusters, copies and few vectors; far fewer distances than pairs."""
    r = np.random.default_rng(2)
    middle = r.normal(0, 10, (30, 8))
    x = middle[r.integers(0, 30, 3000)] + r.normal(0, 0.5, (3000, 8))
    x[100:160] = x[100]
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)] + [(9999, None)], "id long, embedding array<double>")
    q = v.filter("id % 100 = 0").withColumnRenamed("id", "query")
    report = {}
    got = retrieval.nearest(v, q, 10, report=report).collect()
    want = []
    for i in range(0, 3000, 100):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), 6)
        want += [(i, int(j)) for j in np.lexsort((np.arange(3000), d))[:10]]
    assert sorted((p["query"], p["id"]) for p in got) == sorted(want)
    assert report["pairs"] < 0.3 * report["all_pairs"], report
    few = retrieval.nearest(v.limit(3), q, 10).groupBy("query").count().collect()
    assert len(few) == 30 and all(p["count"] == 3 for p in few)
    assert retrieval.nearest(v.limit(0), q, 10).count() == 0
    assert "NestedLoop" not in retrieval.nearest(v, q, 10)._jdf.queryExecution().toString()


def test_ranked_lookup_limits_each_key_once(spark):
    """Queries that share a key meet its first rows only; a query that stands twice is ranked over all its rows."""
    t = spark.createDataFrame([("a", f"c{i}", i % 7) for i in range(50)] + [("b", "z", 0), (None, "n", 0)], "surface string, class string, order int")
    q = spark.createDataFrame([(i, " A") for i in range(300)] + [(300, "b"), (300, "a"), (301, "none"), (302, None)], "query long, text string")
    found = retrieval.lexical(q, t, 5)
    got = sorted((r["query"], r["rank"], r["class"]) for r in found.collect())
    first = sorted((o, c) for s, c, o in [("a", f"c{i}", i % 7) for i in range(50)])
    want = [(i, k + 1, c) for i in range(300) for k, (_, c) in enumerate(first[:5])]
    want += [(300, k + 1, c) for k, (_, c) in enumerate(sorted([*first, (0, "z")])[:5])]
    assert got == sorted(want)
    keyed = retrieval.best_by_key(q.select("query", F.lower(F.trim("text")).alias("surface")), t, "surface", ["order", "class"], 5)
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(__best") < plan.index("Join Inner"), plan  # rows are multiplied behind the join, by k at most


def test_builds_move_neither_long_texts_nor_predicates(spark):
    from nexuloom.plans import building

    sf = "/root/testdata/sf0.001"
    t = building._built(spark, sf)
    plan = t.edges._jdf.queryExecution().executedPlan().toString()
    assert "Join [predicate" in plan and "SortMergeJoin [predicate" not in plan, plan  # two predicates would be two tasks
    d = building.extra_details(spark, sf)
    join = next(x for x in d._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftSemi" in x)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index(join) < plan.index("md5("), plan  # digests are made below the join
    n = spark.createDataFrame([("a", "x" * 3000, None, ["s"] * 40, None), ("b", None, "i", None, ["p"] * 120), ("c", "y", None, None, None)], "id string, description string, iri string, all_names array<string>, publications array<string>")
    e = spark.createDataFrame([], "subject string, object string, predicate string, publications array<string>")
    ids, predicates = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("p",)], "predicate string")
    got = {r["id"]: (len(r["description"]), r["iri"], len(r["synonyms"]), len(r["publications"])) for r in build.extras(n, e, ids, predicates)[0].collect()}
    assert got == {"a": (2000, "", 30, 0), "b": (0, "i", 0, 100)}
    some = build.extras(n, e, ids, predicates, [F.length("description").alias("n")])[0]
    assert {tuple(r) for r in some.collect()} == {("a", 2000), ("b", 0)}


def test_neighbours_in_pieces_and_chunks(spark, monkeypatch):
    """A cell cut into pieces, queries in chunks, many ties: the same as every distance; no pair is a row of a join."""
    monkeypatch.setattr(retrieval, "PIECE", 50)
    monkeypatch.setattr(retrieval, "CHUNK_BYTES", 16 * 8 * 10)
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (600, 16)).astype(np.float32)
    x[200:500] = x[7]
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id long, embedding array<float>")
    q = v.filter("id % 25 = 0").withColumnRenamed("id", "query")
    found = retrieval.nearest(v, q, 10, most_pivots=3)
    got = sorted((p["query"], p["rank"], p["id"], p["dist"]) for p in found.collect())
    want, z = [], x.astype(float)
    for i in range(0, 600, 25):
        d = np.round(((z - z[i]) ** 2).sum(axis=1), 6)
        want += [(i, n + 1, int(j), float(d[j])) for n, j in enumerate(np.lexsort((np.arange(600), d))[:10])]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "zip_with" not in plan, plan
    assert retrieval.rounded(np.array([0.0000005, 1.0000025, 2.1234564, 0.0])).tolist() == [0.000001, 1.000003, 2.123456, 0.0]


def test_bm25_scores_where_documents_are_read(spark):
    """The same by batches and by joins: copies that tie, rows without text, ids of several rows, more queries than ``k``."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice((1, 6, 40))))) for i in range(400)] + [(1000 - i, "w1 w2 w3") for i in range(60)] + [(2000, None), (2001, ""), (None, "w5 w6")]
    q = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=5))) for i in range(12)] + [(50, "w1 w2 w3"), (51, "absent"), (52, None)], "query long, text string")
    d = spark.createDataFrame(docs, "doc long, text string").repartition(3)
    key = lambda r: sorted((p["query"], p["rank"], p["doc"] or -1, round(p["score"], 6)) for p in r.collect())
    found = retrieval.bm25(d, q, 7)
    assert key(found) == key(retrieval.bm25(d, q, 7, most_asked=0))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    twice = d.unionByName(spark.createDataFrame([(3, "w1 w9"), (3, "w7")], "doc long, text string"))
    assert key(retrieval.bm25(twice, q, 7)) == key(retrieval.bm25(twice, q, 7, most_asked=0))
    assert retrieval.bm25(d, q.limit(0), 7).count() == 0 and retrieval.bm25(d.limit(0), q, 7).count() == 0
