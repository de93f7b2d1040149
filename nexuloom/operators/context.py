"""The context graph: weighted edges, first-hop-wins expansion, scoring, pruning and connectivity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import cached, grow, stage
from .profile import Profile, Representation, effective_direction, lookup


@dataclass(frozen=True)
class Params:
    hops: int = 2
    representation_hop_neutral: bool = True
    max_representation_steps: int = 2
    directionality: str = ""
    inverse_factor: float | None = None
    hub_cap: int = 500
    min_edge_weight: float = 0.0
    per_category_cap: int = 300
    score_floor_percentile: float = 0.5
    alpha: float = 0.5
    exclude_prediction_edges: bool = False
    max_connectivity_passes: int = 3
    #: Scores are rounded to so many digits before floors and ranks (None: not at all).
    score_digits: int | None = None


def degrees(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Undirected degree over all edges; one scan, a self-loop counts twice. With ``of`` (``node``, staged, so
    that Spark knows its size) only ends among those nodes are counted and move."""
    ends = edges.select(F.explode(F.array("subject", "object")).alias("node"))
    if of is not None:
        ends = ends.join(of.select("node").distinct(), "node", "left_semi")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


#: A table of degrees, or what gives the degrees of some nodes.
Degrees = DataFrame | Callable[[DataFrame], DataFrame]


def degrees_of(deg: Degrees, nodes: DataFrame) -> DataFrame:
    return deg if isinstance(deg, DataFrame) else deg(nodes)


def decode(edges: DataFrame, predicates: DataFrame) -> DataFrame:
    """Predicate codes to names; the vocabulary has a few hundred rows, so Spark broadcasts it by its size."""
    return edges.join(predicates.select("predicate_code", "predicate"), "predicate_code")


def edge_weight(is_representation: Column, predicate_w: Column, source_w: Column, level_w: Column) -> tuple[Column, Column]:
    """Predicate weight and full weight; a missing predicate is 0, a missing source or level 1."""
    w = F.when(is_representation, 1.0).otherwise(F.coalesce(predicate_w, F.lit(0.0)))
    return w, w * F.coalesce(source_w, F.lit(1.0)) * F.coalesce(level_w, F.lit(1.0))


def traversable(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, profile: Profile, params: Params = Params(), representation: Representation | None = None) -> DataFrame:
    """``subject, object, predicate, weight, source, level, is_repr`` of the edges the profile lets through.

    The predicate filter runs before the node joins, so edges without weight never shuffle. Nodes are joined by one
    narrow table (id, in scope, seed), once a side.
    """
    spark = edges.sparkSession
    representation = representation or Representation.of_identifiers()
    is_repr = representation.column(F.col("predicate"), F.col("subject"), F.col("object"))
    e = edges.select("subject", "object", "predicate", "source", "level", is_repr.alias("is_repr"))
    e = e.join(lookup(spark, profile.predicates, "predicate", "wp"), "predicate", "left").filter(F.col("is_repr") | (F.col("wp") > 0))
    e = e.join(lookup(spark, profile.sources, "source", "ws"), "source", "left").join(lookup(spark, profile.levels, "level", "wl"), "level", "left")
    w, weight = edge_weight(F.col("is_repr"), F.col("wp"), F.col("ws"), F.col("wl"))
    e = e.withColumn("w", w).withColumn("weight", weight).filter((F.col("w") > 0) & (F.col("weight") >= params.min_edge_weight))
    if params.exclude_prediction_edges:
        e = e.filter(F.col("level") != "prediction")
    e = e.filter(profile.allowed(F.col("predicate"), F.col("subject"), F.col("object")))
    if any(w <= 0 for w in profile.categories.values()):  # a category without a weight is in scope
        scope = nodes.join(lookup(spark, profile.categories, "category", "wc"), "category", "left").select("id", (F.coalesce("wc", F.lit(1.0)) > 0).alias("inside"))
        out = scope.filter(~F.col("inside")).select("id").join(seeds.select(F.col("seed").alias("id")), "id", "left_anti")  # P02: an end out of scope is let through only if it is a seed
        for side in ("subject", "object"):
            e = e.join(out.withColumnRenamed("id", side), side, "left_anti")
    return e.select("subject", "object", "predicate", "weight", "source", "level", "is_repr")


def traversal(e: DataFrame, profile: Profile, params: Params = Params()) -> DataFrame:
    """Every edge both ways, from one scan: ``a, b, weight`` (as it is walked), ``full`` (as it is stored),
    ``is_repr`` and ``walked``. Reverse edges take the factor unless symmetric and are not walked at weight 0; forward
    edges of weight 0 are. It is read hop by hop by few nodes, so it is not staged: that would write every edge twice."""
    mode, factor = effective_direction(profile, params.directionality, params.inverse_factor)
    back = F.col("weight") if mode == "off" else F.col("weight") * F.when(F.col("predicate").isin(*profile.symmetric) if profile.symmetric else F.lit(False), 1.0).otherwise(factor)
    leg = lambda a, b, w, forward: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), w.alias("weight"), F.col("weight").alias("full"), "is_repr", (F.lit(forward) | (w > 0)).alias("walked"))
    return e.select(F.explode(F.array(leg("subject", "object", F.col("weight"), True), leg("object", "subject", back, False))).alias("x")).select("x.*").filter("walked OR is_repr")


def walked(links: DataFrame) -> DataFrame:
    """``a, b, weight`` of a traversal."""
    return links.filter("walked").select("a", "b", "weight")


def identity(links: DataFrame) -> DataFrame:
    """Identity edges of a traversal, both ways at full weight."""
    return links.filter("is_repr").select("a", "b", F.col("full").alias("weight"))


def both_ways(e: DataFrame, profile: Profile, params: Params = Params()) -> DataFrame:
    """G05"""
    return walked(traversal(e, profile, params))


def seed_split(seeds: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds that are nodes, and those that are not. Nodes are filtered by the seeds before anything moves."""
    ids = stage(nodes.select(F.col("id").alias("seed")).join(seeds.select("seed"), "seed", "left_semi").distinct(), "known-seeds")
    return seeds.join(ids, "seed", "left_semi"), seeds.join(ids, "seed", "left_anti")


def expand(seeds: DataFrame, nodes: DataFrame, und: DataFrame, und_repr: DataFrame, deg: Degrees, params: Params = Params()) -> DataFrame:
    """``seed, node, hop, path_w``. A pair keeps the weight of the hop it first appears at; within that hop
    the best product counts. Only the rows of the hop before are extended; each hop and each frontier is staged, so links
    are filtered by a broadcast frontier where that is small, and move only where it is not."""
    present, _ = seed_split(seeds, nodes)
    reach = stage(present.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.col("seed_weight").cast("double").alias("path_w")), "reach")
    last = reach

    def step(rows: DataFrame, links: DataFrame, hop: int) -> DataFrame:
        """G10, G11"""
        best = rows.join(links, F.col("node") == F.col("a")).groupBy("seed", F.col("b").alias("to")).agg(F.max(F.col("path_w") * F.col("weight")).alias("path_w")).withColumnRenamed("to", "node")
        fresh = best.join(reach.select("seed", "node"), ["seed", "node"], "left_anti")
        return stage(fresh.select("seed", "node", F.lit(hop).alias("hop"), "path_w"), "reach")

    for hop in range(1, params.hops + 1):
        # Seeds are neither penalised nor capped; a node without a degree is not extended
        frontier = last.join(degrees_of(deg, last), "node")
        if hop > 1:
            frontier = frontier.filter(F.col("degree") <= params.hub_cap).withColumn("path_w", F.col("path_w") / F.log2(2 + F.col("degree")))
        last = step(stage(frontier.select("seed", "node", "path_w"), "frontier"), und, hop)
        reach = reach.unionByName(last)
        added = last
        for _ in range(params.max_representation_steps if params.representation_hop_neutral else 0):  # G12: same hop, no penalty
            added = step(last.select("seed", "node", "path_w"), und_repr, hop)
            if added.isEmpty():
                break
            last, reach = last.unionByName(added), reach.unionByName(added)
    return reach


def per_hop(reach: DataFrame) -> DataFrame:
    """A07, G13"""
    return reach.groupBy("hop").agg(F.countDistinct("node").alias("nodes_reached"))


def score(reach: DataFrame, nodes: DataFrame, deg: Degrees, seeds: DataFrame, params: Params = Params()) -> DataFrame:
    """``node, name, category, hop, coverage, score, degree, seeds``; seeds and unknown ids are left out."""
    hits = reach.filter("hop > 0").join(seeds.select(F.col("seed").alias("node")), "node", "left_anti")
    agg = hits.groupBy("node").agg(F.min("hop").alias("hop"), F.count(F.lit(1)).alias("coverage"), F.sum("path_w").alias("total"), F.array_sort(F.collect_list("seed")).alias("seeds"))
    agg = stage(agg, "hits")
    d = agg.join(nodes.select(F.col("id").alias("node"), "name", "category"), "node").join(degrees_of(deg, agg), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    s = F.col("total") / F.pow(F.log2(2 + F.col("degree")), F.lit(params.alpha))
    return d.select("node", "name", "category", "hop", "coverage", (s if params.score_digits is None else F.round(s, params.score_digits)).alias("score"), "degree", "seeds")


def quantiles(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """``by, thr``: exact continuous quantile of each group, without a group in one buffer.

    Equal values are one row with a count. Values are cut into cells of a 256th of a doubling; the counts of the cells
    say which one or two of a group hold the quantile, and only these are sorted."""
    cell = F.when(F.col(value) > 0, F.floor(F.log2(value) * 256)).when(F.col(value) == 0, F.lit(-(1 << 40))).otherwise(-(1 << 41) - F.floor(F.log2(-F.col(value)) * 256))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", cell)
    w = W.partitionBy(by)
    cells = counts.groupBy(by, "cell").agg(F.sum("n").alias("m")).withColumn("upto", F.sum("m").over(w.orderBy("cell"))).withColumn("at", (F.sum("m").over(w) - 1) * p)
    first = F.col("upto") - F.col("m")
    here = cells.filter((F.floor("at") < F.col("upto")) & (F.ceil("at") >= first)).select(F.col(by).alias("__by"), F.col("cell").alias("__cell"), first.alias("first"), "at")
    inside = counts.join(here, F.col(by).eqNullSafe(F.col("__by")) & (F.col("cell") == F.col("__cell"))).withColumn("upto", F.col("first") + F.sum("n").over(W.partitionBy(by, "cell").orderBy(value)))
    reach = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    ends = inside.groupBy(by).agg(reach(F.floor("at")).alias("a"), reach(F.ceil("at")).alias("b"), F.first("at").alias("at"))
    return ends.select(by, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("thr"))


def score_floor(scored: DataFrame, params: Params = Params()) -> DataFrame:
    """Exact percentile of the score of each hop."""
    return quantiles(scored, "hop", "score", min(1.0, max(0.0, params.score_floor_percentile)))


def by_rank() -> list[Column]:
    return [F.col("score").desc(), F.col("coverage").desc(), F.col("hop").asc(), F.col("node").asc()]


def keep(scored: DataFrame, floor: DataFrame, params: Params = Params()) -> DataFrame:
    """At most so many nodes a category, above the floor of their hop; ties by node."""
    over = scored.join(F.broadcast(floor), "hop").filter(F.col("score") >= F.col("thr")).drop("thr")  # one row a hop
    return over.withColumn("rk", F.row_number().over(W.partitionBy("category").orderBy(*by_rank()))).filter(F.col("rk") <= params.per_category_cap).drop("rk").select(*scored.columns)


def connected(kept_ids: DataFrame, seeds: DataFrame, und: DataFrame) -> DataFrame:
    """Kept ids that links among kept ids lead to from a seed; each round extends the newest ids only."""
    inside = stage(und.select("a", "b").join(kept_ids.select(F.col("id").alias("a")), "a", "left_semi").join(kept_ids.select(F.col("id").alias("b")), "b", "left_semi").distinct(), "inside")
    start = seeds.select(F.col("seed").alias("node")).join(kept_ids.select(F.col("id").alias("node")), "node", "left_semi").distinct()
    return grow(start, lambda d: d.join(inside, F.col("node") == F.col("a")).select(F.col("b").alias("node")), ["node"], "connected")


def among(und: DataFrame, reach: DataFrame) -> DataFrame:
    """Links between reached nodes, each once, staged: kept nodes and what may refill them are reached."""
    ids = reach.select("node").distinct()
    inside = und.select("a", "b").join(ids.withColumnRenamed("node", "a"), "a", "left_semi").join(ids.withColumnRenamed("node", "b"), "b", "left_semi")
    return stage(inside.distinct(), "among")


def repair(kept: DataFrame, scored: DataFrame, floor: DataFrame, seeds: DataFrame, nodes: DataFrame, und: DataFrame, params: Params = Params()) -> tuple[DataFrame, dict]:
    """Drop islands, refill the categories from linked candidates, at most so many times.

    A node dropped once never returns. ``converged`` only if a pass drops nothing; that pass counts."""
    present, _ = seed_split(seeds, nodes)
    kept, excluded = stage(kept, "kept"), None
    info = {"passes": 0, "converged": False, "nodes_removed": 0}
    while info["passes"] < params.max_connectivity_passes:
        info["passes"] += 1
        ids = kept.select(F.col("node").alias("id")).unionByName(present.select(F.col("seed").alias("id"))).distinct()
        conn = connected(ids, present, und)
        islands = stage(kept.select("node").join(conn, "node", "left_anti"), "islands")
        n = islands.count()
        if not n:
            info["converged"] = True
            break
        info["nodes_removed"] += n
        excluded = islands if excluded is None else excluded.unionByName(islands)
        kept = kept.join(islands, "node", "left_anti")
        have = kept.groupBy("category").agg(F.count(F.lit(1)).alias("have"))
        near = und.join(conn.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
        fresh = scored.join(F.broadcast(floor), "hop").filter("score >= thr").drop("thr").join(kept.select("node"), "node", "left_anti").join(excluded, "node", "left_anti").join(near, "node", "left_semi")
        fresh = fresh.withColumn("rk", F.row_number().over(W.partitionBy("category").orderBy(*by_rank()))).join(have, "category", "left").filter(F.col("rk") <= params.per_category_cap - F.coalesce("have", F.lit(0)))
        kept = stage(kept.unionByName(fresh.select(*kept.columns)), "kept")
    return kept, info


def induced(e: DataFrame, kept: DataFrame, present: DataFrame) -> DataFrame:
    """Edges among kept nodes and present seeds."""
    ids = kept.select("node").unionByName(present.select(F.col("seed").alias("node"))).distinct()
    return e.join(ids.withColumnRenamed("node", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("node", "object"), "object", "left_semi").select("subject", "predicate", "object", "weight", "source", "level")


def provenance(kept: DataFrame, seed_pages: DataFrame) -> DataFrame:
    """Pages of a node's seeds, sorted, and whether several seeds share it. ``seed_pages``: seed, pages."""
    pages = kept.select("node", F.explode("seeds").alias("seed")).join(seed_pages, "seed").groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("slides"))
    return kept.join(pages, "node", "left").withColumn("shared", F.when(F.col("coverage") > 1, "shared").otherwise("specific"))


def presence(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """Rank and size within the category over all scored nodes for the wanted ids, reached or not. Better
    nodes are counted for each wanted score; no category is sorted."""
    mine = ids.join(scored.select(F.col("node").alias("id"), "category", "hop", "score"), "id", "left")
    marks = mine.filter("score IS NOT NULL").select(F.col("category").alias("c"), F.col("score").alias("mark")).distinct()
    better = scored.select("category", "score").join(marks, F.col("category") == F.col("c"))
    better = better.groupBy("c", "mark").agg((F.count_if(F.col("score") > F.col("mark")) + 1).alias("rank"), F.count(F.lit(1)).alias("of"))
    return mine.join(better, (F.col("category") == F.col("c")) & (F.col("score") == F.col("mark")), "left").select("id", "category", "hop", "score", "rank", "of", F.col("rank").isNotNull().alias("reached"))


def category_counts(kept: DataFrame) -> DataFrame:
    """A06"""
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class ContextGraph:
    edges: DataFrame
    und: DataFrame
    reach: DataFrame
    scored: DataFrame
    floor: DataFrame
    kept: DataFrame
    induced: DataFrame
    missing_seeds: DataFrame
    info: dict


def run(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, profile: Profile, params: Params = Params(), representation: Representation | None = None, deg: Degrees | None = None) -> ContextGraph:
    """The whole query. ``seeds``: seed, seed_weight; ``edges``: subject, object, predicate, source, level.

    A hop scans the edges and keeps what its frontier touches; degrees are counted for reached nodes; the connectivity
    passes read the links among reached nodes, which are staged. No step moves or writes all edges."""
    deg = (lambda some: degrees(edges, some)) if deg is None else deg
    e = traversable(edges, nodes, seeds, profile, params, representation)
    und, links = both_ways(e, profile, params), identity(traversal(e.filter("is_repr"), profile, params))
    reach = expand(seeds, nodes, und, links, deg, params)
    scored = stage(score(reach, nodes, deg, seeds, params), "scored")
    floor = score_floor(scored, params)
    kept, info = repair(keep(scored, floor, params), scored, floor, seeds, nodes, among(und, reach), params)
    present, missing = seed_split(seeds, nodes)
    return ContextGraph(e, und, reach, scored, floor, kept, induced(e, kept, present), missing, info)


def cached_kept(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, profile: Profile, params: Params = Params(), representation: Representation | None = None, folder: str | None = None) -> DataFrame:
    """The kept nodes of ``run``, expanded once for each content of the tables, the profile and the parameters."""
    parts = [asdict(profile), asdict(params), asdict(representation) if representation else None]
    return cached(seeds.sparkSession, "kept", [seeds, nodes, edges], parts, lambda: run(seeds, nodes, edges, profile, params, representation).kept, folder)
