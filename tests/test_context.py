"""Context graphs on two hand-made graphs with known results."""

import pytest

from nexuloom import staging
from nexuloom.operators import context, paths
from nexuloom.operators.context import Params
from nexuloom.operators.profile import Profile

IDS = {"A": "NCBIGene:1", "B": "NCBIGene:2", "P": "UniProtKB:1", "D": "MONDO:1", "H": "MONDO:2", "M": "CHEBI:1", "Q": "CHEBI:2", "X": "NCBITaxon:1", "Z": "NCBIGene:9"}
SHORT = {v: k for k, v in IDS.items()}
CATEGORY = {"A": "Gene", "B": "Gene", "P": "Protein", "D": "Disease", "H": "Disease", "M": "SmallMolecule", "Q": "SmallMolecule", "X": "OrganismTaxon"}
EDGES = [("A", "gac", "D", "a", "assertion"), ("A", "biolink:has_gene_product", "P", "a", "assertion"), ("M", "affects", "P", "b", "assertion"), ("M", "affects", "D", "a", "prediction"), ("B", "interacts_with", "A", "a", "assertion"), ("Q", "affects", "M", "a", "assertion"), ("D", "subclass_of", "H", "a", "assertion"), ("M", "subclass_of", "Q", "a", "assertion"), ("A", "in_taxon", "X", "a", "assertion"), ("D", "related_to", "Q", "a", "assertion")]
PROFILE = Profile(predicates={"gac": 0.5, "affects": 0.8, "interacts_with": 0.6, "subclass_of": 0.4, "in_taxon": 0.3}, sources={"b": 0.5}, levels={"prediction": 0.3}, categories={"OrganismTaxon": 0.0}, symmetric=("interacts_with",), restricted={"subclass_of": ("MONDO:",)})


@pytest.fixture(scope="module")
def g1(spark):
    nodes = spark.createDataFrame([(IDS[k], k, c) for k, c in CATEGORY.items()], "id string, name string, category string")
    edges = spark.createDataFrame([(IDS[s], p, IDS[o], a, b) for s, p, o, a, b in EDGES], "subject string, predicate string, object string, source string, level string")
    seeds = spark.createDataFrame([(IDS[k], 1.0) for k in "ABZ"], "seed string, seed_weight double")
    return seeds, nodes, edges


def short(rows, *cols):
    return {tuple(SHORT.get(r[c], round(r[c], 6) if isinstance(r[c], float) else r[c]) for c in cols) for r in rows}


def test_first_graph(g1, spark):
    seeds, nodes, edges = g1
    g = context.run(seeds, nodes, edges, PROFILE)
    assert short(g.edges.collect(), "subject", "object", "weight") == {("A", "D", 0.5), ("A", "P", 1.0), ("M", "P", 0.4), ("M", "D", 0.24), ("B", "A", 0.6), ("Q", "M", 0.8), ("D", "H", 0.4)}
    assert {SHORT[r["node"]]: r["degree"] for r in context.degrees(edges).collect()} == {"A": 4, "B": 1, "P": 2, "D": 4, "M": 4, "Q": 3, "H": 1, "X": 1}
    reach = short(g.reach.filter("hop > 0").collect(), "seed", "node", "hop")
    assert reach == {("A", "D", 1), ("A", "P", 1), ("A", "B", 1), ("B", "A", 1), ("B", "P", 1), ("A", "H", 2), ("A", "M", 2), ("B", "D", 2), ("B", "M", 2)}
    weights = {(SHORT[r["seed"]], SHORT[r["node"]]): round(r["path_w"], 6) for r in g.reach.collect()}
    assert weights["A", "H"] == 0.077371 and weights["A", "M"] == 0.1 and weights["B", "D"] == 0.116056 and weights["B", "M"] == 0.06 and weights["B", "P"] == 0.6
    assert short(g.scored.collect(), "node", "hop", "coverage", "score") == {("P", 1, 2, 1.131371), ("D", 1, 2, 0.383171), ("M", 2, 2, 0.099516), ("H", 2, 1, 0.061456)}
    assert {r["hop"]: round(r["thr"], 6) for r in g.floor.collect()} == {1: 0.757271, 2: 0.080486}
    assert {SHORT[r["node"]] for r in g.kept.collect()} == {"P", "M"}
    assert g.info == {"passes": 1, "converged": True, "nodes_removed": 0}
    assert short(g.induced.collect(), "subject", "object") == {("A", "P"), ("B", "A"), ("M", "P")}
    assert {SHORT[r["seed"]] for r in g.missing_seeds.collect()} == {"Z"}
    present = spark.createDataFrame([(IDS["A"],), (IDS["B"],)], "seed string")
    members = g.kept.select("node").union(present.withColumnRenamed("seed", "node"))
    comp = paths.components(g.induced, members)
    assert comp.select("component").distinct().count() == 1
    assert paths.seed_pairs(comp, present).head() == (1, 1)
    assert paths.diameter(comp, g.induced).head()[0] == 3
    assert paths.vocabulary_expansion(g.kept, present).head()[0] == 2.0


@pytest.mark.parametrize(("params", "kept"), [(Params(score_floor_percentile=0, inverse_factor=0.0), {"D", "H", "P"}), (Params(score_floor_percentile=0, directionality="off"), {"D", "H", "M", "P"})])
def test_directions(g1, params, kept):
    g = context.run(*g1, PROFILE, params)
    assert {SHORT[r["node"]] for r in g.kept.collect()} == kept
    if params.directionality:
        assert {SHORT[r["node"]]: round(r["score"], 6) for r in g.scored.collect()}["M"] == 0.199032


def second(spark, params):
    nodes = spark.createDataFrame([(n, n, c) for n, c in (("S", "c0"), ("K", "c1"), ("K2", "c1"), ("L", "c2"), ("L2", "c2"))], "id string, name string, category string")
    edges = spark.createDataFrame([(a, f"p{w}", b, "s", "l") for a, b, w in (("S", "K", 0.2), ("S", "K2", 0.4), ("K", "L", 1.0), ("K2", "L2", 0.1))], "subject string, predicate string, object string, source string, level string")
    seeds = spark.createDataFrame([("S", 1.0)], "seed string, seed_weight double")
    return context.run(seeds, nodes, edges, Profile(predicates={f"p{w}": w for w in (0.2, 0.4, 1.0, 0.1)}), params)


def test_refill(spark):
    g = second(spark, Params(per_category_cap=1, score_floor_percentile=0))
    assert {r["node"]: round(r["score"], 6) for r in g.scored.collect()} == {"K": 0.141421, "K2": 0.282843, "L": 0.079431, "L2": 0.015886}
    assert {r["node"] for r in g.kept.collect()} == {"K2", "L2"}
    assert g.info == {"passes": 2, "converged": True, "nodes_removed": 1}
    assert {(r["subject"], r["object"]) for r in g.induced.collect()} == {("K2", "L2"), ("S", "K2")}


def test_no_convergence(spark):
    assert second(spark, Params(per_category_cap=1, score_floor_percentile=0, max_connectivity_passes=1)).info["converged"] is False


def test_hub_is_reached_but_not_extended(spark):
    nodes = spark.createDataFrame([(n, n, "c") for n in ("S", "H", "T")], "id string, name string, category string")
    edges = spark.createDataFrame([("S", "p", "H", "s", "l"), ("H", "p", "T", "s", "l")], "subject string, predicate string, object string, source string, level string")
    seeds = spark.createDataFrame([("S", 1.0)], "seed string, seed_weight double")
    deg = spark.createDataFrame([("S", 900), ("H", 900), ("T", 1)], "node string, degree bigint")
    g = context.run(seeds, nodes, edges, Profile(predicates={"p": 1.0}), deg=deg)
    assert {r["node"] for r in g.reach.collect()} == {"S", "H"}


def test_weight_zero_forward_edges_stay(spark):
    nodes = spark.createDataFrame([(n, n, "c") for n in "ST"], "id string, name string, category string")
    edges = spark.createDataFrame([("S", "p", "T", "zero", "l")], "subject string, predicate string, object string, source string, level string")
    seeds = spark.createDataFrame([("S", 1.0)], "seed string, seed_weight double")
    g = context.run(seeds, nodes, edges, Profile(predicates={"p": 1.0}, sources={"zero": 0.0}))
    assert g.und.count() == 1 and g.reach.count() == 2


def test_unknown_ends_are_crossed_but_not_scored(spark):
    nodes = spark.createDataFrame([("S", "S", "c"), ("T", "T", "c")], "id string, name string, category string")
    edges = spark.createDataFrame([("S", "p", "?", "s", "l"), ("?", "p", "T", "s", "l")], "subject string, predicate string, object string, source string, level string")
    seeds = spark.createDataFrame([("S", 1.0)], "seed string, seed_weight double")
    g = context.run(seeds, nodes, edges, Profile(predicates={"p": 1.0}, categories={"c": 1.0}))
    assert {r["node"] for r in g.scored.collect()} == {"T"}


def test_closure_crosses_two_identifiers_in_one_hop(spark):
    ids = ["NCBIGene:1", "RefSeq:1", "UniProtKB:1"]
    nodes = spark.createDataFrame([("S", "S", "c"), *[(i, i, "c") for i in ids]], "id string, name string, category string")
    edges = spark.createDataFrame([("S", "p", ids[0], "s", "l"), (ids[0], "biolink:transcribed_to", ids[1], "s", "l"), (ids[1], "biolink:translates_to", ids[2], "s", "l")], "subject string, predicate string, object string, source string, level string")
    seeds = spark.createDataFrame([("S", 1.0)], "seed string, seed_weight double")
    for steps, want in ((2, {1}), (1, {1, 2})):
        g = context.run(seeds, nodes, edges, Profile(predicates={"p": 1.0}), Params(max_representation_steps=steps))
        assert {r["hop"] for r in g.reach.filter("hop > 0").collect()} == want


def test_paths(spark):
    e = spark.createDataFrame([("a", "b", 1.0, "p"), ("b", "a", 0.5, "q"), ("b", "c", 1.0, "p"), ("a", "c", 0.01, "p"), ("c", "c", 1.0, "p")], "subject string, object string, weight double, predicate string")
    simple = paths.simple_graph(e)
    assert {(r["a"], r["b"], r["predicate"]) for r in simple.collect()} == {("a", "b", "p"), ("b", "c", "p"), ("a", "c", "p")}
    deg = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "node string, degree bigint")
    best = {r["node"]: r["path"] for r in paths.cheapest_paths(paths.path_cost(simple, deg), spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert best["c"] == ["a", "b", "c"]
    p = spark.createDataFrame([(1, ["b", "a"])], "path_id int, path array<string>")
    assert paths.path_edges(p, simple).head()["forward"] is False


def test_a_graph_is_expanded_once_for_each_content(g1, spark, monkeypatch, tmp_path):
    seeds, nodes, edges = g1
    calls, folder, run = [], f"file://{tmp_path}/cache", context.run
    monkeypatch.setattr(context, "run", lambda *a: calls.append(a) or run(*a))
    ask = lambda e=edges, params=Params(): {r["node"] for r in context.cached_kept(seeds, nodes, e, PROFILE, params, folder=folder).collect()}
    first = ask()
    assert first == {IDS["P"], IDS["M"]} and len(calls) == 1
    assert ask() == first and ask(edges.repartition(3)) == first and len(calls) == 1  # read; the order of rows is no content
    ask(params=Params(per_category_cap=1))
    assert len(calls) == 2
    for unfinished in tmp_path.glob("cache/*/*/_SUCCESS"):
        unfinished.unlink()
    assert ask() == first and len(calls) == 3
    assert staging.evict(spark, 1, folder) == 1 and staging.evict(spark, 1, folder) == 0


def test_digests_of_contents(spark):
    make = lambda rows: staging.content_digest(spark.createDataFrame(rows, "a string, b string"))
    tables = [[], [("x", None)], [(None, "x")], [("x", None)] * 2, [("x", "y"), ("z", None)], [("x", None), ("z", "y")], [(None, None)], [("", None)]]
    assert len({make(t) for t in tables}) == len(tables)
    assert make([("x", "y"), ("z", None)]) == make([("z", None), ("x", "y")])


def test_only_what_is_reached_is_staged(spark, monkeypatch):
    """Edges far from the seeds are scanned, never written: what is staged follows the reach, not the graph."""
    far = [(f"f{i}", f"g{i % 700}") for i in range(3000)]
    close = [("S", "K"), ("S", "K2"), ("K", "L"), ("K2", "L2"), ("L", "f0")]
    nodes = spark.createDataFrame([(n, n, "c") for n in sorted({x for e in far + close for x in e})], "id string, name string, category string")
    edges = spark.createDataFrame([(a, "p", b, "s", "l") for a, b in far + close], "subject string, predicate string, object string, source string, level string")
    seeds = spark.createDataFrame([("S", 1.0), ("none", 1.0)], "seed string, seed_weight double")
    rows, own = {}, context.stage

    def counted(df, label, *more):
        out = own(df, label, *more)
        rows[label] = max(rows.get(label, 0), out.count())
        return out

    monkeypatch.setattr(context, "stage", counted)
    args = (seeds, nodes, edges, Profile(predicates={"p": 1.0}), Params(score_floor_percentile=0))
    g = context.run(*args)
    assert max(rows.values()) < 20, rows
    assert {(r["node"], r["hop"], r["degree"]) for r in g.kept.collect()} == {("K", 1, 2), ("K2", 1, 2), ("L", 2, 2), ("L2", 2, 1)}
    assert {r["seed"] for r in g.missing_seeds.collect()} == {"none"}
    stored = context.run(*args, deg=context.degrees(edges))  # a table of degrees gives the same
    assert sorted(g.scored.collect()) == sorted(stored.scored.collect()) and sorted(g.kept.collect()) == sorted(stored.kept.collect())
    some = spark.createDataFrame([("L",), ("L",), ("g1",), ("x",)], "node string")
    assert {tuple(r) for r in context.degrees(edges, some).collect()} == {("L", 2), ("g1", 5)}
