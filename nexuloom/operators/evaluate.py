"""Evaluation of readings, links and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fold
from ..functions.stats import rate, wald
from .ontology import distance
from .relational import text_pairs, texts_of


def included(status: Column) -> Column:
    """P19"""
    return ~F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("delete", "deleted", "drop", "dropped", "exclude", "excluded")


def row_kind(term: Column, note: Column) -> Column:
    """P20"""
    n = F.lower(F.coalesce(note, F.lit("")))
    return F.when(F.coalesce(term, F.lit("")) == "", "blank").when(n.startswith("adversarial"), "adversarial").when(n.startswith("creative"), "creative").otherwise("gold")


def gold_matches(gold: DataFrame, mentions: DataFrame) -> DataFrame:
    """``gold_id, status, mention_id``: exact beats partial beats missed; then the smallest mention. Texts are
    matched once each; the smallest mention of a text stands for it."""
    g = gold.select("gold_id", fold(F.col("term")).alias("g"))
    m = mentions.select("mention_id", fold(F.col("text")).alias("m"))
    first = m.groupBy("m").agg(F.min("mention_id").alias("mention_id"))
    pairs = text_pairs(texts_of(g, "g"), texts_of(first, "m")).join(first, F.col("y") == F.col("m"))
    best = pairs.groupBy("x").agg(F.min(F.struct(F.when(F.col("status") == "exact", 0).otherwise(1).alias("o"), "mention_id")).alias("b"))
    return g.join(best, F.col("g") == F.col("x"), "left").select("gold_id", F.when(F.col("b").isNull(), "missed").when(F.col("b.o") == 0, "exact").otherwise("partial").alias("status"), F.col("b.mention_id").alias("mention_id"))


def gold_scores(matches: DataFrame, gold: DataFrame, mentions: DataFrame, chains: DataFrame, canonical: DataFrame | None = None, cliques: DataFrame | None = None) -> DataFrame:
    """One row of recall, typing and linking rates. ``gold``: gold_id, class_name, curie, linkable; ``mentions``:
    mention_id, type, curie and, where known, kg_id; ``chains``: name, chain; ``canonical`` and ``cliques``: curie, id.

    Gold without a class counts for recall and linking only. A link is right by the curie itself, whatever its case, by the
    canonical id (the mention's own kg_id first) or by the clique; those rates are over what was found, and the
    linkable ones over found and linkable gold."""
    own = F.col("kg_id") if "kg_id" in mentions.columns else F.lit(None).cast("string")
    j = matches.join(gold, "gold_id").join(mentions.select("mention_id", F.col("type").alias("m_type"), F.col("curie").alias("m_curie"), own.alias("m_kg")), "mention_id", "left")
    c = lambda side: chains.select(F.col("name").alias(side), F.col("chain").alias(f"{side}_chain"))
    j = j.join(c("class_name"), "class_name", "left").join(c("m_type"), "m_type", "left").withColumn("dist", distance(F.col("class_name_chain"), F.col("m_type_chain")))
    for name, ids in (("canon", canonical), ("clique", cliques)):
        for curie in ("curie", "m_curie"):
            if ids is None:
                j = j.withColumn(f"{curie}_{name}", F.lit(None).cast("string"))
            else:
                one = ids.groupBy(F.col("curie").alias("c")).agg(F.min("id").alias(f"{curie}_{name}"))
                j = j.join(one, F.col(curie) == F.col("c"), "left").drop("c")
    found, linkable, typed = F.col("status") != "missed", F.coalesce(F.col("linkable"), F.lit(True)), F.coalesce("class_name", F.lit("")) != ""
    plain = lambda x: F.lower(F.trim(x))
    exact = F.coalesce((plain("curie") == plain("m_curie")) & (F.trim("curie") != ""), F.lit(False))
    canon = F.coalesce(F.col("curie_canon") == F.coalesce("m_kg", "m_curie_canon"), F.lit(False)) | exact
    clique = F.coalesce(F.col("curie_clique") == F.col("m_curie_clique"), F.lit(False)) | exact
    return j.agg(
        F.count(F.lit(1)).alias("n_gold"),
        rate(F.col("status") == "exact").alias("recall_exact"),
        rate(found).alias("recall_any"),
        F.count_if(found & typed).alias("n_typed"),
        rate(F.when(found & typed, F.coalesce(F.col("class_name") == F.col("m_type"), F.lit(False)))).alias("typing_accuracy"),
        F.avg(F.when(found & typed, F.col("dist"))).alias("mean_distance"),
        rate(F.when(found, exact)).alias("linking_found_exact"),
        rate(F.when(found, canon)).alias("linking_found_canonical"),
        rate(F.when(found, clique)).alias("linking_found_clique"),
        F.count_if(found & linkable).alias("n_found_linkable"),
        rate(F.when(found & linkable, exact)).alias("linking_exact"),
        rate(F.when(found & linkable, clique)).alias("linking_clique"),
    )


def gold_precision(mentions: DataFrame, gold: DataFrame) -> DataFrame:
    """How many mentions (``text, page``), and how many distinct ones, match some gold term."""
    m = mentions.select(fold(F.col("text")).alias("m"), "page")
    hit = text_pairs(texts_of(m, "m"), texts_of(gold.select(fold(F.col("term")).alias("g")), "g")).select(F.col("x").alias("m")).distinct().withColumn("hit", F.lit(True))
    each = m.join(hit, "m", "left").groupBy("m", "page").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.first("hit"), F.lit(False)).alias("hit"))
    return each.agg(F.sum("n").alias("n_mentions"), (F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("precision"), F.count(F.lit(1)).alias("n_distinct"), rate(F.col("hit")).alias("precision_distinct"))


def creativity(mentions: DataFrame, gold: DataFrame) -> DataFrame:
    """Mentions that match no gold term, each spelling once (the smallest id)."""
    m = mentions.select("mention_id", fold(F.col("text")).alias("m")).filter("m <> ''").groupBy("m").agg(F.min("mention_id").alias("mention_id"))
    hit = text_pairs(texts_of(m, "m"), texts_of(gold.select(fold(F.col("term")).alias("g")), "g")).select(F.col("x").alias("m")).distinct()
    return m.join(hit, "m", "left_anti")


def adversarial_rates(rows: DataFrame) -> DataFrame:
    """``typed, linked`` flags -> rates."""
    return rows.agg(F.count(F.lit(1)).alias("n"), rate(F.col("typed")).alias("typed_rate"), rate(F.col("linked")).alias("linked_rate"))


def confusion(rows: DataFrame, by: str, truth: str, verdict: str) -> DataFrame:
    """E08"""
    t, v = F.col(truth), F.col(verdict)
    return rows.groupBy(by).agg(F.count_if(t & v).alias("tp"), F.count_if(~t & v).alias("fp"), F.count_if(t & ~v).alias("fn"), F.count_if(~t & ~v).alias("tn"))


def deck_scores(terms: DataFrame) -> DataFrame:
    """Per-term flags ``read_exact, read_lenient, extracted`` and ``dist`` of the typed class -> rates."""
    return terms.agg(F.count(F.lit(1)).alias("n"), rate(F.col("read_exact")).alias("read_exact"), rate(F.col("read_lenient")).alias("read_lenient"), rate(F.col("extracted")).alias("extracted"), rate(F.when(F.col("extracted"), F.coalesce(F.col("dist") == 0, F.lit(False)))).alias("typed_exact"), rate(F.when(F.col("extracted"), F.coalesce(F.col("dist") <= 1, F.lit(False)))).alias("typed_near"))


def label_accuracy(rows: DataFrame, scope: str) -> DataFrame:
    """Accuracy by scope with a 95 % half-width; a verdict is right if it is among the labels (``;``-joined);
    ambiguous rows do not count."""
    ok = F.array_contains(F.transform(F.split("labels", ";"), lambda x: F.trim(x)), F.col("verdict"))
    return rows.filter(~F.coalesce(F.col("ambiguous"), F.lit(False))).groupBy(scope).agg(F.count(F.lit(1)).alias("n"), rate(ok).alias("accuracy")).withColumn("half_width", wald(F.col("accuracy"), F.col("n")))


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Share of equal values over the keys of both runs."""
    return a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).agg(F.count(F.lit(1)).alias("n"), rate(F.col("x").eqNullSafe(F.col("y"))).alias("agreement"))


def changes(rows: DataFrame, truth: str, before: str, after: str) -> DataFrame:
    """E17"""
    t, a, b = F.col(truth), F.col(before), F.col(after)
    return rows.agg(F.count_if(~a.eqNullSafe(b)).alias("changed"), F.count_if(~a.eqNullSafe(t) & b.eqNullSafe(t)).alias("became_right"), F.count_if(a.eqNullSafe(t) & ~b.eqNullSafe(t)).alias("became_wrong"))


def element_matrix(records: DataFrame, conditions: list[str]) -> DataFrame:
    """``element, condition, present`` -> a column a condition."""
    return records.groupBy("element").pivot("condition", conditions).agg(F.max(F.col("present").cast("int"))).fillna(0)


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work left after what was done already."""
    return work.join(done.select(*keys), keys, "left_anti")


def flatten(report: DataFrame) -> DataFrame:
    """Structs one level down as dotted names."""
    out = []
    for f in report.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{c.name}`").alias(f"{f.name}.{c.name}") for c in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    return report.select(*out)


def tabs(builders: dict) -> dict:
    """Every tab is built on its own; one that fails is a text, the others stand."""
    out = {}
    for name, make in builders.items():
        try:
            out[name] = make()
        except Exception as e:  # noqa: BLE001
            out[name] = f"{type(e).__name__}: {e}"
    return out


def category_shares(nodes: DataFrame, k: int = 4) -> DataFrame:
    """The most frequent categories of each cluster."""
    n = nodes.groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "category"))).filter(F.col("r") <= k)


def structure(distances: DataFrame, nodes: DataFrame, cap: int) -> DataFrame:
    """Mean and largest distance of seed pairs, share connected, categories at the cap, share at hop 1."""
    d = distances.agg(F.avg("dist").alias("mean_dist"), F.max("dist").alias("max_dist"), rate(F.col("dist").isNotNull()).alias("connected"))
    full = nodes.groupBy("category").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") >= cap).alias("saturated"))
    hop = nodes.agg(rate(F.col("hop") == 1).alias("hop1_share"))
    return d.join(full).join(hop)  # one row each


def stage_maxima(rows: DataFrame, order: DataFrame, name: str, values: list[str]) -> DataFrame:
    """The largest values of each stage, in the order of a list of stages, null where a stage has no rows."""
    top = rows.groupBy(name).agg(*[F.max(v).alias(v) for v in values])
    return order.join(top, name, "left")


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The most frequent values of a column."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column, and distinct rows over all of them."""
    return rows.agg(*[F.count_distinct(c).alias(c) for c in columns], F.count_distinct(F.struct(*columns)).alias("rows"))


def sizes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A17"""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def natural_order(rows: DataFrame, column: str) -> DataFrame:
    """Numbers kept as text, shorter first."""
    return rows.orderBy(F.length(column), column)


def mechanism_ranks(kept: DataFrame, ids: DataFrame) -> DataFrame:
    """Rank and size within the category, among kept nodes that are no seeds, of the wanted ids in each graph."""
    w = W.partitionBy("graph", "category")
    ranked = kept.filter(~F.col("is_seed")).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "node"))).withColumn("size", F.count(F.lit(1)).over(w))
    return ranked.join(ids.select(F.col("id").alias("node")), "node", "left_semi").select("graph", "node", "category", "rank", "size")
