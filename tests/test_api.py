"""The user's calls over small stored tables."""

import json

import pytest
from pyspark.sql import functions as F

from nexuloom import api
from nexuloom.__main__ import main
from nexuloom.operators.context import Params
from nexuloom.operators.profile import Profile

from .test_context import CATEGORY, EDGES, IDS, PROFILE


@pytest.fixture(scope="module")
def kg(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("kg"))
    names = sorted({e[1] for e in EDGES} | {"annotated"})
    extra = [(f"NCBIGene:{i}", "annotated", f"GO:{t}", "a", "assertion") for i in range(100, 140) for t in range(3) if (i * 7 + t) % 4 < 2 or t == 0 and i < 110]
    rows = [(IDS[s], IDS[o], names.index(p), level, "x", source) for s, p, o, source, level in EDGES]
    spark.createDataFrame([(IDS[k], k, c, [c]) for k, c in CATEGORY.items()], "id string, name string, category string, all_categories array<string>").write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame(rows, "subject string, object string, predicate_code int, knowledge_level string, agent_type string, primary_knowledge_source string").write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame([(i, n, 1) for i, n in enumerate(names)], "predicate_code int, predicate string, n_edges_kept long").write.parquet(f"{d}/predicates.parquet")
    spark.createDataFrame([(s, o, p) for s, p, o, *_ in extra], "gene string, go string, predicate string").write.parquet(f"{d}/gene_go.parquet")
    return d


def test_context_graph_over_files(spark, kg, tmp_path):
    seeds = [api.Seed(IDS["A"], "A", (3, 1)), api.Seed(IDS["B"], "B", (1,)), api.Seed(IDS["Z"])]
    out = api.run_context_graph(spark, kg, seeds, PROFILE, Params(), str(tmp_path), [IDS["D"], "none:1"])
    assert out["n_seeds"] == 2 and out["missing_seeds"] == [IDS["Z"]] and out["n_kept"] == 2 and out["n_edges"] == 3
    assert out["connectivity"] == {"passes": 1, "converged": True, "nodes_removed": 0} and out["seed_pairs"] == "1/1" and out["diameter"] == 3 and out["vocabulary_expansion"] == 2.0
    assert out["presence"][IDS["D"]]["reached"] and not out["presence"]["none:1"]["reached"]
    assert json.loads((tmp_path / "summary.json").read_text())["n_kept"] == 2 and (tmp_path / "graph.graphml").exists()
    listed = spark.read.option("header", True).csv(f"{tmp_path}/nodes").toPandas()
    assert len(listed) == 4 and set(listed["slides"].dropna()) == {"1;3"}
    again = api.run_context_graph(spark, kg, seeds, PROFILE)  # with the stored degrees
    assert again["n_kept"] == 2
    with pytest.raises(ValueError, match="no seeds"):
        api.run_context_graph(spark, kg, [], PROFILE)


def test_enrichment_over_files(spark, kg):
    r = api.enrich(spark, kg, [f"NCBIGene:{i}" for i in range(100, 110)], fdr_max=1.0).collect()
    assert r[0]["term"] == "GO:0" and r[0]["overlap"] == 10 and all(0 <= x["p_value"] <= x["fdr"] <= 1 for x in r)


def test_derived_profile(spark):
    classes = spark.createDataFrame([("named thing", None), ("gene", "named thing"), ("disease", "named thing"), ("rare disease", "disease")], "name string, parent string")
    preds = spark.createDataFrame([("b:root", "root", None, None, None, False, False), ("b:l1", "l1", "root", None, None, False, False), ("b:treats", "treats", "l1", "gene", "disease", False, False), ("b:cures", "cures", "treats", "gene", "disease", True, False), ("b:eats", "eats", "l1", "disease", "gene", False, False)], "predicate string, name string, parent string, domain string, range string, symmetric boolean, kg_only boolean")
    model = api.OntologyTables(classes, preds, split=())
    p, table = api.derive_profile(Profile("x", branches={"gene": 1.0, "disease": 0.4}), model, {"b:treats": 5, "b:cures": 1, "b:eats": 0})
    assert p.categories["biolink:RareDisease"] == 0.5 and p.symmetric == ("b:cures",)
    assert p.predicates["b:treats"] + p.predicates["b:cures"] == pytest.approx(1.0, abs=1e-5)
    assert {r["predicate"]: r["note"] for r in table.collect()}["b:eats"] == "no edges"


def test_search(spark):
    classes = spark.createDataFrame([("gene", "unit of heredity", "locus", "BRCA1"), ("disease", "disorder of an organism", "illness", "flu; diabetes"), ("drug", "substance that treats", None, None)], "class string, description string, aliases string, examples string")
    vec = spark.createDataFrame([("gene", [1.0, 0.0]), ("disease", [0.0, 1.0]), ("drug", [0.7, 0.7])], "id string, embedding array<float>")
    ex = spark.createDataFrame([("disease", "influenza", "e1", [0.1, 1.0])], "class string, exemplar string, id string, embedding array<float>")
    q = spark.createDataFrame([("q", "illness", [0.0, 1.0])], "query string, text string, embedding array<float>")
    r = api.search(api.SearchIndex(classes, vec, ex), q, 3, lexical_weight=1.0).orderBy("place").collect()
    assert r[0]["class"] == "disease" and r[0]["score"] == pytest.approx(4 / 60, abs=1e-6)


def test_resolution(spark):
    nodes = spark.createDataFrame([("G:1", "DUX4"), ("G:2", "other")], "id string, name string")
    eq = spark.createDataFrame([("X:1", "G:1")], "curie string, canonical_id string")
    asked = []

    def service(terms):
        asked.extend(r["term"] for r in terms.collect())
        return terms.select("term", F.lit("X:1").alias("curie"), F.lit("dux").alias("label"), F.lit("svc").alias("source"), F.lit(0).alias("rank"))

    m = spark.createDataFrame([("dux4", ["gene"]), ("dux4", ["gene"]), ("me@home.org", ["gene"]), ("John", ["cohort"])], "term string, types array<string>")
    r = {(x["term"], x["curie"]): x["canonical_id"] for x in api.resolve_terms(m, [service], eq, nodes).collect()}
    assert asked == ["dux4"] and r == {("dux4", "G:1"): "G:1", ("dux4", "X:1"): "G:1"}


def test_command_line(spark, kg, tmp_path, capsys):
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "predicates": {"gac": 0.5, "affects": 0.8}}))
    main(["graph", "--kg", kg, "--profile", f"{tmp_path}/p.json", "--seeds", IDS["A"], "--hops", "1"])
    assert json.loads(capsys.readouterr().out)["n_seeds"] == 1
