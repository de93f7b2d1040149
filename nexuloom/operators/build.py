"""Building the graph tables from dumps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import stage


def first_reason(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``reason`` is the name of the first rule that fails a row, null if none does."""
    reason = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        reason = F.when(fails, name).otherwise(reason)
    return rows.withColumn("reason", reason)


def reason_counts(flagged: DataFrame) -> DataFrame:
    """A09"""
    return flagged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def normal_predicate(c: Column) -> Column:
    """A doubled prefix is folded."""
    return F.regexp_replace(c, "^biolink:biolink_", "biolink:")


def concept_nodes(nodes: DataFrame, prefixes: list[str], categories: tuple[str, ...] = ("biolink:Gene", "biolink:Protein")) -> DataFrame:
    """P10: gene and protein nodes whose identifier is a concept's."""
    return nodes.filter(F.col("category").isin(*categories) & F.split_part("id", F.lit(":"), F.lit(1)).isin(*prefixes)).select("id")


def kept_nodes(nodes: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """Nodes with an edge left."""
    ends = kept_edges.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi")


@dataclass(frozen=True)
class BuildRules:
    slots: list[str]
    classes: list[str]
    excluded_predicates: tuple[str, ...] = ("biolink:same_as", "biolink:exact_match", "biolink:close_match", "biolink:broad_match", "biolink:narrow_match", "biolink:related_to")
    excluded_sources: tuple[str, ...] = ()
    excluded_levels: tuple[str, ...] = ()
    concept_prefixes: tuple[str, ...] = ("UMLS", "NCIT")
    notes: dict = field(default_factory=dict)


class Tables:
    """What a build gives. Kept edges are staged when a table made of them is first asked for, and read by all of them."""

    def __init__(self, flagged: DataFrame, kept: DataFrame, nodes: DataFrame):
        self._kept, self._nodes = kept, nodes
        self.reasons = reason_counts(flagged)
        self.by_source = flagged.groupBy("primary_knowledge_source", F.col("reason").isNull().alias("kept")).agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def kept(self) -> DataFrame:
        return stage(self._kept, "kept-edges")

    @cached_property
    def predicates(self) -> DataFrame:
        """Codes by name: joins are by code, so their order has no meaning; one row a predicate. Staged, so that Spark sees how
        small it is: few predicates hold all edges, and a shuffle by them would give a task a large share."""
        n = self.kept.groupBy("predicate").agg(F.count(F.lit(1)).alias("n_edges_kept")).withColumn("predicate_code", (F.row_number().over(W.orderBy("predicate")) - 1).cast("smallint"))
        return stage(n.select("predicate_code", "predicate", "n_edges_kept"), "predicates")

    @cached_property
    def edges(self) -> DataFrame:
        return self.kept.join(self.predicates.select("predicate", "predicate_code"), "predicate").select("subject", "object", "predicate_code", "knowledge_level", "agent_type", "primary_knowledge_source")  # a few hundred predicates

    @cached_property
    def _linked(self) -> DataFrame:
        return kept_nodes(self._nodes, self.kept)

    @property
    def nodes(self) -> DataFrame:
        return self._linked.drop("equivalent_curies")

    @property
    def equivalents(self) -> DataFrame:
        return self._linked.select(F.explode("equivalent_curies").alias("curie"), F.col("id").alias("canonical_id")).distinct()


def build(node_dump: DataFrame, edge_dump: DataFrame, rules: BuildRules) -> Tables:
    """The flagged edges feed the counters; those kept feed the edges, the nodes and the predicate codes.

    Kept edges pass the rules on their own columns before they move to be checked against the concepts."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    e = edge_dump.select(*[blank(c).alias(c) for c in ("subject", "object", "predicate", "primary_knowledge_source", "knowledge_level", "agent_type")]).withColumn("predicate", normal_predicate(F.col("predicate")))
    concepts = concept_nodes(node_dump.select("id", "category"), list(rules.concept_prefixes))
    own = [
        ("unknown predicate", ~F.col("predicate").isin(*rules.slots)),
        ("excluded predicate", F.col("predicate").isin(*rules.excluded_predicates)),
        ("excluded source", F.col("primary_knowledge_source").isin(*rules.excluded_sources) if rules.excluded_sources else F.lit(False)),
        ("excluded level", F.col("knowledge_level").isin(*rules.excluded_levels) if rules.excluded_levels else F.lit(False)),
    ]
    kept, flagged = e, e
    for _, fails in own:
        kept = kept.filter(~fails)
    for side in ("subject", "object"):
        ids = concepts.select(F.col("id").alias(side))
        kept = kept.join(ids, side, "left_anti")
        flagged = flagged.join(ids.withColumn(f"{side}_concept", F.lit(True)), side, "left")  # P10: flagged, not dropped, so that the reason is counted
    flagged = first_reason(flagged, [*own, ("concept node", F.col("subject_concept").isNotNull() | F.col("object_concept").isNotNull())])
    n = node_dump.filter(F.col("category").isin(*rules.classes))
    return Tables(flagged, kept, n.select("id", blank("name").alias("name"), "category", "all_categories", "equivalent_curies"))


def extras(node_dump: DataFrame, edge_dump: DataFrame, nodes: DataFrame, predicates: DataFrame, of_details: list[Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Details of kept nodes, publications of kept triples (predicates folded first) and gene terms.

    Texts and lists are cut before a node moves. ``of_details`` are columns made of the cut details, if not all of them are
    wanted: they are made where the node is read, so long texts stay there."""
    details = node_dump.select("id", F.substring(F.coalesce("description", F.lit("")), 1, 2000).alias("description"), F.coalesce("iri", F.lit("")).alias("iri"), F.slice(F.coalesce("all_names", F.array().cast("array<string>")), 1, 30).alias("synonyms"), F.slice(F.coalesce("publications", F.array().cast("array<string>")), 1, 100).alias("publications"))
    if of_details is not None:
        details = details.select("id", *of_details)
    details = details.join(nodes.select("id"), "id", "left_semi")
    e = edge_dump.withColumn("predicate", normal_predicate(F.col("predicate"))).join(predicates.select("predicate"), "predicate", "left_semi")
    ids = nodes.select("id")
    e = e.join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("id", "object"), "object", "left_semi")
    pubs = e.filter(F.size("publications") > 0).select("subject", "predicate", "object", F.slice("publications", 1, 100).alias("publications"))
    genes = e.filter(F.col("object").startswith("GO:") & F.col("subject").startswith("NCBIGene:")).select(F.col("subject").alias("gene"), F.col("object").alias("go"), "predicate")
    return details, pubs, genes


def triple_publications(triples: DataFrame, pubs: DataFrame) -> DataFrame:
    """Publications of each triple; lists of repeated triples are united."""
    lists = pubs.groupBy("subject", "predicate", "object").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("publications")))).alias("publications"))
    return triples.join(lists, ["subject", "predicate", "object"], "left")
