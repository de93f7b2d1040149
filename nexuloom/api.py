"""The calls a user makes: context graphs over stored tables, derived profiles, hybrid search, linking, enrichment."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats, text
from .operators import context, ontology, package, paths, retrieval
from .operators import profile as profiles
from .operators.context import Params
from .operators.profile import Profile, Representation
from .sources import readers, writers
from .staging import stage


@dataclass(frozen=True)
class Seed:
    kg_id: str
    label: str = ""
    pages: tuple[int, ...] = ()
    mentions: tuple[str, ...] = ()
    weight: float = 1.0


def seed_table(spark: SparkSession, seeds: list[Seed]) -> DataFrame:
    if not seeds:
        raise ValueError("no seeds: nothing to expand")
    return readers.literal(spark, [(s.kg_id, float(s.weight), list(s.pages)) for s in seeds], "seed string, seed_weight double, pages array<int>")


def stored_edges(spark: SparkSession, kg_dir: str) -> DataFrame:
    """Edges with their predicates' names, in the shape ``context`` takes."""
    e, p = spark.read.parquet(f"{kg_dir}/edges.parquet"), spark.read.parquet(f"{kg_dir}/predicates.parquet")
    return context.decode(e, p).select("subject", "object", "predicate", F.col("primary_knowledge_source").alias("source"), F.col("knowledge_level").alias("level"))


def stored_degrees(spark: SparkSession, kg_dir: str, refresh: bool = False) -> DataFrame:
    """Degrees beside the data, made when first asked for."""
    path = f"{kg_dir}/degrees.parquet"
    if refresh or not readers.has_table(spark, path):
        context.degrees(spark.read.parquet(f"{kg_dir}/edges.parquet").select("subject", "object")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_context_graph(spark: SparkSession, kg_dir: str, seeds: list[Seed], profile: Profile, params: Params = Params(), out_dir: str | None = None, find_ids: list[str] | None = None, representation: Representation | None = None) -> dict:
    """Expand, prune, repair; write CSV, GraphML and a summary into ``out_dir``; return the summary.

    Only the kept graph (at most categories times the cap) reaches the driver."""
    s = seed_table(spark, seeds)
    nodes = spark.read.parquet(f"{kg_dir}/nodes.parquet").select("id", "name", "category")
    g = context.run(s.select("seed", "seed_weight"), nodes, stored_edges(spark, kg_dir), profile, params, representation, stored_degrees(spark, kg_dir))
    present, missing = context.seed_split(s, nodes)
    kept = stage(context.provenance(g.kept, s.select("seed", "pages")), "kept")
    edges = stage(g.induced, "induced")
    members = kept.select("node").unionByName(present.select(F.col("seed").alias("node"))).distinct()
    comp = paths.components(edges, members)
    pairs = paths.seed_pairs(comp, present).head()
    out = {
        "profile": profile.name,
        "params": asdict(params),
        "n_seeds": present.count(),
        "missing_seeds": sorted(r["seed"] for r in missing.collect()),  # as many as seeds given
        "n_kept": kept.count(),
        "n_edges": edges.count(),
        "per_hop": {r["hop"]: r["nodes_reached"] for r in context.per_hop(g.reach).collect()},
        "categories": {r["category"]: r["n"] for r in context.category_counts(kept).collect()},
        "connectivity": g.info,
        "components": comp.select("component").distinct().count(),
        "seed_pairs": f"{pairs['connected']}/{pairs['pairs']}",
        "diameter": paths.diameter(comp, edges).head()[0],
        "vocabulary_expansion": paths.vocabulary_expansion(kept, present).head()[0],
    }
    if find_ids:
        found = context.presence(g.scored, readers.literal(spark, [(i,) for i in find_ids], "id string"))
        out["presence"] = {r["id"]: {"reached": r["reached"], "rank": r["rank"], "of": r["of"], "hop": r["hop"]} for r in found.collect()}
    if out_dir:
        seed_rows = present.join(nodes, F.col("seed") == F.col("id")).select(F.col("id").alias("node"), "name", F.lit("seed").alias("category"), F.lit(0).alias("hop"))
        listed = kept.unionByName(seed_rows, allowMissingColumns=True).withColumn("is_seed", F.col("hop") == 0).orderBy("category", F.desc("score"), "node")
        writers.export_csv(listed, f"{out_dir}/nodes")
        writers.export_csv(edges, f"{out_dir}/edges")
        writers.graphml(members.select(F.col("node").alias("id")), edges.select(F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "weight"), f"{out_dir}/graph.graphml")
        writers.replace_json(out, f"{out_dir}/summary.json")
    return out


@dataclass
class OntologyTables:
    """``classes``: name, parent; ``mixin_members``: mixin, name (or None); ``predicates``: predicate, name, parent, domain,
    range, symmetric, kg_only."""

    classes: DataFrame
    predicates: DataFrame
    mixin_members: DataFrame | None = None
    root: str = "named thing"
    split: tuple[str, ...] = ("biological entity",)


def derive_profile(p: Profile, model: OntologyTables, edge_counts: dict[str, int] | None = None) -> tuple[Profile, DataFrame]:
    """A profile of branch weights -> the same with predicate and category weights, and the table of reasons.
    Ontologies have hundreds of names, so their weights fit a profile."""
    spark = model.classes.sparkSession
    closed = stage(ontology.closure(model.classes), "classes")
    branch = ontology.branches(model.classes, model.root, model.split)
    raw = readers.literal(spark, [(k, str(v)) for k, v in p.branches.items()] or [("", "0")], "name string, weight string")
    cw = stage(ontology.class_weights(model.classes, closed, branch, ontology.branch_weights(raw, branch), model.mixin_members), "class-weights")
    names = model.predicates.select(F.explode(F.array("domain", "range")).alias("name"))
    scope = ontology.scope_weights(names, model.classes, closed, cw, model.mixin_members)
    line = ontology.predicate_lineage(model.predicates.select("name", "parent"))
    counts = readers.literal(spark, list((edge_counts or {}).items()) or [("", 0)], "predicate string, n_edges long")
    preds = model.predicates.join(line, "name").join(counts, "predicate", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    table = stage(ontology.derive(preds.select("predicate", "branch", "depth", "domain", "range", "n_edges", "kg_only"), scope, p.alpha, p.min_weight, p.scope_rule, bool(edge_counts)), "derived")
    weights = {r["predicate"]: r["weight"] for r in table.filter("weight IS NOT NULL").collect()}
    symmetric = tuple(sorted(r["predicate"] for r in model.predicates.filter("symmetric").select("predicate").collect()))
    classes = cw.join(model.classes.select("name"), "name", "left_semi")
    categories = {r["category"]: r["weight"] for r in ontology.category_weights(classes).collect()}
    return replace(p, predicates=weights, categories=categories, symmetric=symmetric), table


@dataclass
class SearchIndex:
    """``classes``: class, description, aliases, examples; ``vectors``: id (class), embedding; ``exemplars``: class, exemplar,
    id, embedding; ``names``: name_lc, category, n. Each leg is used if its table is there."""

    classes: DataFrame
    vectors: DataFrame | None = None
    exemplars: DataFrame | None = None
    names: DataFrame | None = None


def search(index: SearchIndex, queries: DataFrame, k: int = 10, exemplar_weight: float = 1.0, lexical_weight: float = 0.0, name_weight: float = 0.0, sparse: bool = True) -> DataFrame:
    """``query, text[, embedding]`` -> fused classes; legs in the order dense, BM25, exemplars, surfaces, names."""
    legs = []

    def add(ranked: DataFrame, weight: float) -> None:
        legs.append(ranked.select("query", "class", F.lit(len(legs)).alias("leg"), (F.col("rank") - 1).alias("rank"), F.lit(weight).alias("weight")))

    if index.vectors is not None:
        add(retrieval.nearest(index.vectors, queries, k).withColumnRenamed("id", "class"), 1.0)
    if sparse:
        docs = index.classes.select(F.col("class").alias("doc"), text.class_document(F.col("class"), F.col("description"), F.col("aliases"), F.col("examples")).alias("text"))
        add(retrieval.bm25(docs, queries, k).withColumnRenamed("doc", "class"), 1.0)
    if index.exemplars is not None and exemplar_weight > 0 and index.vectors is not None:
        hits = retrieval.nearest(index.exemplars.select("id", "embedding"), queries, 6 * k).join(index.exemplars.select("id", "class"), "id")
        add(retrieval.classes_by_best(hits, k), exemplar_weight)
    if lexical_weight > 0:
        ex = index.exemplars.select("class", "exemplar") if index.exemplars is not None else None
        add(retrieval.lexical(queries, retrieval.surface_table(index.classes, ex), k), lexical_weight)
    if name_weight > 0 and index.names is not None:
        add(retrieval.by_name(queries, index.names), name_weight)
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    return retrieval.fuse(every, k)


def resolve_terms(mentions: DataFrame, services: list, equivalents: DataFrame, nodes: DataFrame, k: int = 10, typed=None) -> DataFrame:
    """Distinct terms are asked of each service once (private ones of none but the local tables), then, where
    ``typed`` is given, of that service once more for each type of the term; candidates are merged, ranked and
    canonicalised. A service maps ``term`` to ``term, curie, label, source, rank``; ``typed`` maps ``term, type`` to those
    and ``type``. Types are class names in the order of their ids; none, empty and NONE are no types."""
    terms = mentions.groupBy("term").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("types")).withColumn("private", text.is_private(F.col("term"), F.col("types")))
    terms = stage(terms, "terms")
    local = retrieval.local_lookup(terms.select("term"), nodes, k).select("term", F.col("id").alias("curie"), F.col("name").alias("label"), F.lit("local").alias("source"), F.lit(0).alias("list_no"), (F.col("rank") - 1).alias("rank"))
    every, public = local, terms.filter(~F.col("private"))
    for i, ask in enumerate(services):
        every = every.unionByName(ask(public.select("term")).select("term", "curie", "label", "source", F.lit(i + 1).alias("list_no"), "rank"))
    if typed is not None:
        of = retrieval.typed_passes(public)
        found = typed(of.select("term", "type")).join(of, ["term", "type"])
        every = every.unionByName(found.select("term", "curie", "label", "source", (F.lit(len(services)) + F.col("nth")).alias("list_no"), "rank"))
    merged = retrieval.merge_candidates(every).filter(F.col("rank") < k)
    return merged.join(retrieval.canonicalize(merged.select("curie"), equivalents, nodes), "curie", "left").select("term", "curie", "label", "source", "rank", "canonical_id")


def annotations(spark: SparkSession, kg_dir: str) -> DataFrame:
    """``gene, term`` from the gene-term table if it is there, else from the edges of genes to terms."""
    path = f"{kg_dir}/gene_go.parquet"
    if readers.has_table(spark, path):
        return spark.read.parquet(path).select("gene", F.col("go").alias("term"))
    e = stored_edges(spark, kg_dir).filter(F.col("object").startswith("GO:") & F.col("subject").startswith("NCBIGene:"))
    return e.select(F.col("subject").alias("gene"), F.col("object").alias("term"))


def enrich(spark: SparkSession, kg_dir: str, genes: list[str], **options) -> DataFrame:
    """E03, E04"""
    return stats.enrich(annotations(spark, kg_dir), readers.literal(spark, [(g,) for g in genes], "gene string"), **options)


def viewer_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = None, min_score: float = 0.0, hops: int | None = None) -> DataFrame:
    """The elements of a kept graph within a budget of nodes."""
    n = package.node_budget(nodes, max_nodes, min_score, hops) if max_nodes is not None else nodes
    n = stage(n, "viewer")
    return package.elements(n, edges)


def load_profile(spark: SparkSession, path: str) -> Profile:
    return profiles.from_json(json.dumps(readers.json_text(spark, path)))
