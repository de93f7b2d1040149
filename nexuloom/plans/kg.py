"""Knowledge-graph and context-graph queries over a graph made of the driver tables.

Nodes are customers, orders, parts, suppliers, nations and regions; edges are placed, contains (one a line item, so
parallel edges stay), supplied_by, located_in and part_of. part_of plays the hop-neutral identity predicate,
located_in the symmetric one. Seeds are the five customers of the smallest keys and one id that does not exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, context, paths
from ..operators.context import Params
from ..operators.profile import Profile, Representation

PROFILE = Profile("surrogate", {"placed": 0.8, "contains": 0.6, "supplied_by": 0.5, "located_in": 0.4}, {"1-URGENT": 0.9, "R": 0.7, "5-LOW": 0.6}, {"F": 0.9, "P": 0.5}, {"Region": 0.5, "Supplier": 1.0}, ("located_in",), {"located_in": ("C:", "S:", "N:")})
SAME = Representation({"part_of": (("N:",), ("R:",))})
PARAMS = Params(per_category_cap=40, score_digits=6)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    def leg(t: str, key: str, prefix: str, name: str, category: str) -> DataFrame:
        return table(spark, sf, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), (F.col(name) if name else F.concat(F.lit(f"{category} "), F.col(key).cast("string"))).alias("name"), F.lit(category).alias("category"))

    out = leg("customer", "c_custkey", "C:", "c_name", "Customer")
    for args in (("orders", "o_orderkey", "O:", "", "Order"), ("part", "p_partkey", "P:", "p_name", "Part"), ("supplier", "s_suppkey", "S:", "s_name", "Supplier"), ("nation", "n_nationkey", "N:", "n_name", "Nation"), ("region", "r_regionkey", "R:", "r_name", "Region")):
        out = out.unionByName(leg(*args))
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    def leg(t: str, a: str, pa: str, predicate: str, b: str, pb: str, source, level) -> DataFrame:
        c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        return table(spark, sf, t).select(c(pa, a).alias("subject"), F.lit(predicate).alias("predicate"), c(pb, b).alias("object"), source.alias("source"), level.alias("level"))

    none = F.lit("")
    return (
        leg("orders", "o_custkey", "C:", "placed", "o_orderkey", "O:", F.col("o_orderpriority"), F.col("o_orderstatus"))
        .unionByName(leg("lineitem", "l_orderkey", "O:", "contains", "l_partkey", "P:", F.col("l_returnflag"), F.col("l_linestatus")))
        .unionByName(leg("lineitem", "l_partkey", "P:", "supplied_by", "l_suppkey", "S:", none, none))
        .unionByName(leg("customer", "c_custkey", "C:", "located_in", "c_nationkey", "N:", none, none))
        .unionByName(leg("supplier", "s_suppkey", "S:", "located_in", "s_nationkey", "N:", none, none))
        .unionByName(leg("nation", "n_nationkey", "N:", "part_of", "n_regionkey", "R:", none, none))
    )


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    five = table(spark, sf, "customer").orderBy("c_custkey").limit(5).select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("seed"))
    return five.unionByName(spark.range(1).select(F.lit("C:absent").alias("seed"))).withColumn("seed_weight", F.lit(1.0))


def _run(spark: SparkSession, sf: str, params: Params = PARAMS) -> context.ContextGraph:
    return context.run(seeds(spark, sf), nodes(spark, sf), edges(spark, sf), PROFILE, params, SAME)


def _edges(spark, sf):
    return context.traversable(edges(spark, sf), nodes(spark, sf), seeds(spark, sf), PROFILE, PARAMS, SAME)


def _links(spark, sf):
    """Links as they are walked."""
    return context.both_ways(_edges(spark, sf), PROFILE, PARAMS)


def _degrees(spark, sf):
    return lambda some: context.degrees(edges(spark, sf), some)


def kg_degree(spark, sf):
    return context.degrees(edges(spark, sf))


def kg_degree_stats(spark, sf):
    """A05"""
    d = context.degrees(edges(spark, sf))
    return d.agg(F.count(F.lit(1)).alias("n"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.expr("percentile(degree, 0.5)").alias("p50"), F.round(F.expr("percentile(degree, 0.99)"), 6).alias("p99"), F.count_if(F.col("degree") == 1).alias("leaves"), F.count_if(F.col("degree") > 500).alias("hubs"))


def kg_top_hubs(spark, sf):
    """O02"""
    return context.degrees(edges(spark, sf)).orderBy(F.desc("degree"), "node").limit(20)


def kg_edge_weights(spark, sf):
    return _edges(spark, sf).groupBy("predicate", "source", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("weight"), 6).alias("weight"))


def kg_traversal_view(spark, sf):
    und = context.both_ways(_edges(spark, sf), PROFILE, PARAMS)
    return und.groupBy(F.substring("a", 1, 1).alias("from_kind"), F.substring("b", 1, 1).alias("to_kind"), F.round("weight", 6).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def kg_filter_reasons(spark, sf):
    """The first failing rule of each edge, counted."""
    return build.reason_counts(_flagged(spark, sf))


def _flagged(spark, sf):
    rules = [("no_weight", ~F.col("predicate").isin("placed", "contains", "located_in", "part_of")), ("low_source", F.col("source") == "5-LOW"), ("pending", F.col("level") == "P"), ("returned", F.col("source") == "R")]
    return build.first_reason(edges(spark, sf), rules)


def kg_filtered_edges(spark, sf):
    return _flagged(spark, sf).filter("reason IS NULL").groupBy("predicate", "source", "level").agg(F.count(F.lit(1)).alias("n"))


def kg_kept_nodes(spark, sf):
    """P11"""
    return build.kept_nodes(nodes(spark, sf), _flagged(spark, sf).filter("reason IS NULL")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def ctx_hop1(spark, sf):
    g = _reach(spark, sf, 1)
    return g.filter("hop > 0").select("seed", "node", "hop", F.round("path_w", 6).alias("path_w"))


def _reach(spark, sf, hops, neutral=True):
    same = context.identity(context.traversal(_edges(spark, sf).filter("is_repr"), PROFILE, PARAMS))
    p = Params(hops=hops, representation_hop_neutral=neutral)
    return context.expand(seeds(spark, sf), nodes(spark, sf), _links(spark, sf), same, _degrees(spark, sf), p)


def ctx_hop2_reach(spark, sf):
    return _reach(spark, sf, 2).select("seed", "node", "hop", F.round("path_w", 6).alias("path_w"))


def ctx_repr_closure(spark, sf):
    """What the hop-neutral closure adds at hop 1."""
    plain = _reach(spark, sf, 1, False).select("seed", "node")
    return _reach(spark, sf, 1).join(plain, ["seed", "node"], "left_anti").select("seed", "node", "hop", F.round("path_w", 6).alias("path_w"))


def ctx_hop_counts(spark, sf):
    return context.per_hop(_reach(spark, sf, 2))


def _cols(df):
    return df.select("node", "name", "category", "hop", "coverage", "score", "degree", F.array_join("seeds", ";").alias("seeds"))


def _scored(spark, sf):
    return context.score(_reach(spark, sf, 2), nodes(spark, sf), _degrees(spark, sf), seeds(spark, sf), PARAMS)


def ctx_scored(spark, sf):
    return _cols(_scored(spark, sf))


def ctx_score_floor(spark, sf):
    return context.score_floor(_scored(spark, sf), PARAMS).select("hop", F.round("thr", 6).alias("thr"))


def ctx_kept(spark, sf):
    """The flagship: expansion, scoring, floor, cap (before the connectivity passes)."""
    s = context.stage(_scored(spark, sf), "scored")
    return _cols(context.keep(s, context.score_floor(s, PARAMS), PARAMS))


def ctx_refilled(spark, sf):
    """G17-G20 with a small cap, to the end of the connectivity passes."""
    return _cols(_run(spark, sf).kept)


def ctx_cached(spark, sf):
    """The same, found by the digest of its inputs the second time."""
    args = (seeds(spark, sf), nodes(spark, sf), edges(spark, sf), PROFILE, PARAMS, SAME)
    context.cached_kept(*args)
    return _cols(context.cached_kept(*args))


def ctx_repair_info(spark, sf):
    i = _run(spark, sf).info
    return spark.range(1).select(F.lit(i["passes"]).alias("passes"), F.lit(i["converged"]).alias("converged"), F.lit(i["nodes_removed"]).alias("nodes_removed"))


def _kept_parts(spark, sf):
    s = context.stage(_scored(spark, sf), "scored")
    kept = context.stage(context.keep(s, context.score_floor(s, PARAMS), PARAMS), "kept")
    present, _ = context.seed_split(seeds(spark, sf), nodes(spark, sf))
    return s, kept, present


def ctx_connected(spark, sf):
    """G17 on the first kept set."""
    _, kept, present = _kept_parts(spark, sf)
    und = _links(spark, sf)
    ids = kept.select(F.col("node").alias("id")).unionByName(present.select(F.col("seed").alias("id"))).distinct()
    return context.connected(ids, present, und)


def ctx_induced_edges(spark, sf):
    _, kept, present = _kept_parts(spark, sf)
    e = _edges(spark, sf)
    return context.induced(e, kept, present).groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


def ctx_presence_ranks(spark, sf):
    s, _, _ = _kept_parts(spark, sf)
    ids = table(spark, sf, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("id"))
    found = context.presence(s, ids)
    none = F.lit(-1)  # of an id that was not reached
    return found.select("id", "reached", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("hop", none).alias("hop"), F.coalesce("score", none).alias("score"), F.coalesce("rank", none).cast("long").alias("rank"), F.coalesce("of", none).cast("long").alias("category_size"))


def ctx_provenance(spark, sf):
    """A seed's pages are its key and its key mod 3."""
    _, kept, present = _kept_parts(spark, sf)
    key = F.split_part("seed", F.lit(":"), F.lit(2)).try_cast("int")
    p = context.provenance(kept, present.select("seed", F.array(key, key % 3).alias("pages")))
    return p.select("node", "shared", F.array_join(F.transform("slides", lambda x: x.cast("string")), ";").alias("slides"))


def ctx_missing_seeds(spark, sf):
    """G07"""
    return context.seed_split(seeds(spark, sf), nodes(spark, sf))[1]


def ctx_category_counts(spark, sf):
    _, kept, _ = _kept_parts(spark, sf)
    return context.category_counts(kept)


def _small(spark, sf):
    """The kept graph of the first connectivity state, as subject-object pairs with the kept nodes."""
    _, kept, present = _kept_parts(spark, sf)
    e = _edges(spark, sf)
    ids = context.stage(kept.select("node").unionByName(present.select(F.col("seed").alias("node"))).distinct(), "ids")
    return context.stage(context.induced(e, kept, present), "induced"), ids, present


def graph_components(spark, sf):
    e, ids, _ = _small(spark, sf)
    return paths.components(e, ids)


def graph_seed_pairs(spark, sf):
    e, ids, present = _small(spark, sf)
    return paths.seed_pairs(paths.components(e, ids), present)


def graph_distances(spark, sf):
    """From every present seed over the kept graph."""
    e, _, present = _small(spark, sf)
    return paths.distances(e, present.select(F.col("seed").alias("source")))


def graph_simple_edges(spark, sf):
    """G28"""
    e, _, _ = _small(spark, sf)
    s = paths.simple_graph(e.withColumn("weight", F.round("weight", 6)))
    return s.select("a", "b", "weight", "predicate", "subject", "object")


def _costs(spark, sf):
    e, ids, present = _small(spark, sf)
    simple = context.stage(paths.simple_graph(e, "source", "level"), "simple")
    return simple, context.stage(paths.path_cost(simple, context.degrees(edges(spark, sf), ids)), "costs"), present


def graph_set_path(spark, sf):
    """From the first two seeds to the others: fewest steps, and the cheapest way's cost."""
    _, cost, present = _costs(spark, sf)
    ids = sorted(r["seed"] for r in present.collect())  # five at most
    a, b = (spark.createDataFrame([(x,) for x in part], "node string") for part in (ids[:2], ids[2:]))
    least, cheap = paths.set_path(cost.withColumn("cost", F.lit(1.0)), a, b), paths.set_path(cost, a, b)
    return spark.range(1).select(F.lit(int(least[0]) if least else None).cast("long").alias("distance"), F.round(F.lit(cheap[0] if cheap else None).cast("double"), 6).alias("cost"))


def graph_set_path_steps(spark, sf):
    """The cheapest way from the first two seeds to the others, with the edge of each step."""
    simple, cost, present = _costs(spark, sf)
    ids = sorted(r["seed"] for r in present.collect())
    a, b = (spark.createDataFrame([(x,) for x in part], "node string") for part in (ids[:2], ids[2:]))
    found = paths.set_path(cost, a, b)
    return paths.annotated(simple, found[1] if found else [])


def graph_shortest_path_cost(spark, sf):
    """Cheapest cost from the first seed to all it is connected with."""
    e, ids, present = _small(spark, sf)
    cost = context.stage(paths.path_cost(paths.simple_graph(e), context.degrees(edges(spark, sf), ids)), "costs")
    start = present.orderBy("seed").limit(1).select(F.col("seed").alias("node"))
    return paths.cheapest_paths(cost, start).select("node", F.round("dist", 6).alias("dist"))


# ---- the same in SQL ------------------------------------------------------------------------------------------------

_SEED = "SELECT 'C:' || c_custkey AS seed, 1.0::DOUBLE AS seed_weight FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5) UNION ALL SELECT 'C:absent', 1.0"
_STEP = """SELECT s.seed, s.node, {hop} AS hop, s.path_w FROM (SELECT f.seed, u.b AS node, max(f.path_w * u.weight) AS path_w FROM {frm} f JOIN {links} u ON u.a = f.node GROUP BY f.seed, u.b) s
WHERE NOT EXISTS (SELECT 1 FROM {seen} r WHERE r.seed = s.seed AND r.node = s.node)"""


def _step(hop, frm, links, seen):
    return _STEP.format(hop=hop, frm=frm, links=links, seen=seen)


CTES: list[tuple[str, str]] = [
    ("nodes", "SELECT 'C:' || c_custkey AS id, c_name AS name, 'Customer' AS category FROM customer UNION ALL SELECT 'O:' || o_orderkey, 'Order ' || o_orderkey, 'Order' FROM orders UNION ALL SELECT 'P:' || p_partkey, p_name, 'Part' FROM part UNION ALL SELECT 'S:' || s_suppkey, s_name, 'Supplier' FROM supplier UNION ALL SELECT 'N:' || n_nationkey, n_name, 'Nation' FROM nation UNION ALL SELECT 'R:' || r_regionkey, r_name, 'Region' FROM region"),
    ("edges", "SELECT 'C:' || o_custkey AS subject, 'placed' AS predicate, 'O:' || o_orderkey AS object, o_orderpriority AS source, o_orderstatus AS level FROM orders UNION ALL SELECT 'O:' || l_orderkey, 'contains', 'P:' || l_partkey, l_returnflag, l_linestatus FROM lineitem UNION ALL SELECT 'P:' || l_partkey, 'supplied_by', 'S:' || l_suppkey, '', '' FROM lineitem UNION ALL SELECT 'C:' || c_custkey, 'located_in', 'N:' || c_nationkey, '', '' FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'located_in', 'N:' || s_nationkey, '', '' FROM supplier UNION ALL SELECT 'N:' || n_nationkey, 'part_of', 'R:' || n_regionkey, '', '' FROM nation"),
    ("seeds", _SEED),
    ("deg", "SELECT node, count(*) AS degree FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) GROUP BY node"),
    ("e", "SELECT subject, object, predicate, source, level, w * CASE source WHEN '1-URGENT' THEN 0.9 WHEN 'R' THEN 0.7 WHEN '5-LOW' THEN 0.6 ELSE 1.0 END * CASE level WHEN 'F' THEN 0.9 WHEN 'P' THEN 0.5 ELSE 1.0 END AS weight FROM (SELECT *, CASE predicate WHEN 'placed' THEN 0.8::DOUBLE WHEN 'contains' THEN 0.6 WHEN 'supplied_by' THEN 0.5 WHEN 'located_in' THEN 0.4 WHEN 'part_of' THEN 1.0 ELSE 0 END AS w FROM edges) WHERE w > 0"),
    ("und", "SELECT subject AS a, object AS b, weight FROM e UNION ALL SELECT object, subject, weight * CASE WHEN predicate = 'located_in' THEN 1.0 ELSE 0.5 END FROM e"),
    ("und_repr", "SELECT subject AS a, object AS b, weight FROM e WHERE predicate = 'part_of' UNION ALL SELECT object, subject, weight FROM e WHERE predicate = 'part_of'"),
    ("r0", "SELECT seed, seed AS node, 0 AS hop, seed_weight AS path_w FROM seeds WHERE seed IN (SELECT id FROM nodes)"),
    ("f1", "SELECT r.seed, r.node, r.path_w FROM r0 r JOIN deg d ON d.node = r.node"),
    ("h1", _step(1, "f1", "und", "r0")),
    ("r1a", "SELECT * FROM r0 UNION ALL SELECT * FROM h1"),
    ("c1", _step(1, "h1", "und_repr", "r1a")),
    ("h1b", "SELECT * FROM h1 UNION ALL SELECT * FROM c1"),
    ("r1b", "SELECT * FROM r0 UNION ALL SELECT * FROM h1b"),
    ("c2", _step(1, "h1b", "und_repr", "r1b")),
    ("r1", "SELECT * FROM r1b UNION ALL SELECT * FROM c2"),
    ("f2", "SELECT r.seed, r.node, r.path_w / log2(2 + d.degree) AS path_w FROM r1 r JOIN deg d ON d.node = r.node WHERE r.hop = 1 AND d.degree <= 500"),
    ("h2", _step(2, "f2", "und", "r1")),
    ("r2a", "SELECT * FROM r1 UNION ALL SELECT * FROM h2"),
    ("d1", _step(2, "h2", "und_repr", "r2a")),
    ("h2b", "SELECT * FROM h2 UNION ALL SELECT * FROM d1"),
    ("r2b", "SELECT * FROM r1 UNION ALL SELECT * FROM h2b"),
    ("d2", _step(2, "h2b", "und_repr", "r2b")),
    ("r2", "SELECT * FROM r2b UNION ALL SELECT * FROM d2"),
    ("scored", "SELECT r.node, n.name, n.category, min(r.hop) AS hop, count(*) AS coverage, round(sum(r.path_w) / power(log2(2 + coalesce(d.degree, 0)), 0.5), 6) AS score, coalesce(d.degree, 0) AS degree, string_agg(r.seed, ';' ORDER BY r.seed) AS seeds FROM r2 r JOIN nodes n ON n.id = r.node LEFT JOIN deg d ON d.node = r.node WHERE r.hop > 0 AND r.node NOT IN (SELECT seed FROM seeds) GROUP BY r.node, n.name, n.category, d.degree"),
    ("floors", "SELECT hop, quantile_cont(score, 0.5) AS thr FROM scored GROUP BY hop"),
    ("kept", "SELECT node, name, category, hop, coverage, score, degree, seeds FROM (SELECT s.*, row_number() OVER (PARTITION BY category ORDER BY score DESC, coverage DESC, s.hop, node) AS rk FROM scored s JOIN floors f ON f.hop = s.hop WHERE s.score >= f.thr) WHERE rk <= 40"),
    ("present", "SELECT seed FROM seeds WHERE seed IN (SELECT id FROM nodes)"),
    ("kept_ids", "SELECT node AS id FROM kept UNION SELECT seed FROM present"),
    ("induced", "SELECT e.* FROM e WHERE subject IN (SELECT id FROM kept_ids) AND object IN (SELECT id FROM kept_ids)"),
    ("pairs", "SELECT DISTINCT * FROM (SELECT subject AS a, object AS b FROM induced UNION ALL SELECT object, subject FROM induced) WHERE a <> b"),
    ("inside", "SELECT DISTINCT a, b FROM und WHERE a IN (SELECT id FROM kept_ids) AND b IN (SELECT id FROM kept_ids)"),
    ("conn", "SELECT seed AS node FROM present UNION SELECT i.b FROM conn JOIN inside i ON i.a = conn.node"),
    ("islands", "SELECT node FROM kept WHERE node NOT IN (SELECT node FROM conn)"),
    ("kept1", "SELECT * FROM kept WHERE node NOT IN (SELECT node FROM islands)"),
    ("have", "SELECT category, count(*) AS have FROM kept1 GROUP BY category"),
    ("refill", "SELECT s.node, s.name, s.category, s.hop, s.coverage, s.score, s.degree, s.seeds, row_number() OVER (PARTITION BY s.category ORDER BY s.score DESC, s.coverage DESC, s.hop, s.node) AS rk FROM scored s JOIN floors f ON f.hop = s.hop WHERE (SELECT count(*) FROM islands) > 0 AND s.score >= f.thr AND s.node NOT IN (SELECT node FROM kept) AND s.node IN (SELECT u.b FROM und u JOIN conn c ON u.a = c.node)"),
    ("walk", "SELECT id AS node, id AS label FROM kept_ids UNION SELECT p.b, w.label FROM walk w JOIN pairs p ON p.a = w.node"),
    ("comp", "SELECT node, min(label) AS component FROM walk GROUP BY node"),
    ("bfs", "SELECT seed AS source, seed AS node, 0 AS dist FROM present UNION SELECT b.source, p.b, b.dist + 1 FROM bfs b JOIN pairs p ON p.a = b.node WHERE b.dist < 12"),
    ("simple", "SELECT a, b, weight, predicate, subject, object FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY weight DESC, predicate DESC, subject DESC, object DESC) AS rk FROM (SELECT least(subject, object) AS a, greatest(subject, object) AS b, round(weight, 6) AS weight, predicate, subject, object FROM induced WHERE subject <> object)) WHERE rk = 1"),
    ("simple_raw", "SELECT a, b, max(weight) AS weight FROM (SELECT least(subject, object) AS a, greatest(subject, object) AS b, weight FROM induced WHERE subject <> object) GROUP BY a, b"),
    ("costs", "SELECT s.a, s.b, -ln(greatest(s.weight, 1e-6)) + (ln(log2(2 + da.degree)) + ln(log2(2 + db.degree))) / 2 AS cost FROM simple_raw s JOIN deg da ON da.node = s.a JOIN deg db ON db.node = s.b"),
    ("cost2", "SELECT a, b, cost FROM costs UNION ALL SELECT b, a, cost FROM costs"),
    ("p0", "SELECT min(seed) AS node, 0.0::DOUBLE AS dist FROM present"),
]
#: Steps after which no cost falls any more on the test tables.
_STEPS = 10
for _i in range(1, _STEPS + 1):
    CTES.append((f"p{_i}", f"SELECT node, min(dist) AS dist FROM (SELECT node, dist FROM p{_i - 1} UNION ALL SELECT c.b, p.dist + c.cost FROM p{_i - 1} p JOIN cost2 c ON c.a = p.node) GROUP BY node"))
_ENDS = "(SELECT seed, row_number() OVER (ORDER BY seed) AS r FROM present)"
CTES.append(("sp0", f"SELECT seed AS node, 0.0::DOUBLE AS dist FROM {_ENDS} WHERE r <= 2"))
for _i in range(1, _STEPS + 1):
    CTES.append((f"sp{_i}", f"SELECT node, min(dist) AS dist FROM (SELECT node, dist FROM sp{_i - 1} UNION ALL SELECT c.b, p.dist + c.cost FROM sp{_i - 1} p JOIN cost2 c ON c.a = p.node) GROUP BY node"))
NAMES = [n for n, _ in CTES]


def sql(select: str, upto: str) -> str:
    """The common tables up to ``upto``, materialised where they are read often, and a select over them."""
    held = {"islands", "edges", "deg", "e", "und", "r1", "r2", "scored", "kept", "inside", "pairs", "induced"}
    parts = [f"{n} AS {'MATERIALIZED ' if n in held else ''}({q})" for n, q in CTES[: NAMES.index(upto) + 1]]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


_REACH = "SELECT seed, node, hop, round(path_w, 6) AS path_w FROM "
ORACLES = {
    "kg_degree": sql("SELECT node, degree FROM deg", "deg"),
    "kg_degree_stats": sql("SELECT count(*) AS n, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree, quantile_cont(degree, 0.5) AS p50, round(quantile_cont(degree, 0.99), 6) AS p99, count(*) FILTER (WHERE degree = 1) AS leaves, count(*) FILTER (WHERE degree > 500) AS hubs FROM deg", "deg"),
    "kg_top_hubs": sql("SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 20", "deg"),
    "kg_edge_weights": sql("SELECT predicate, source, level, count(*) AS n, round(min(weight), 6) AS weight FROM e GROUP BY predicate, source, level", "e"),
    "kg_traversal_view": sql("SELECT substr(a, 1, 1) AS from_kind, substr(b, 1, 1) AS to_kind, round(weight, 6) AS weight, count(*) AS n FROM und GROUP BY 1, 2, 3", "und"),
    "kg_filter_reasons": sql("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN predicate NOT IN ('placed', 'contains', 'located_in', 'part_of') THEN 'no_weight' WHEN source = '5-LOW' THEN 'low_source' WHEN level = 'P' THEN 'pending' WHEN source = 'R' THEN 'returned' ELSE 'kept' END AS reason FROM edges) GROUP BY reason", "edges"),
    "kg_filtered_edges": sql("SELECT predicate, source, level, count(*) AS n FROM edges WHERE predicate IN ('placed', 'contains', 'located_in', 'part_of') AND source NOT IN ('5-LOW', 'R') AND level <> 'P' GROUP BY predicate, source, level", "edges"),
    "kg_kept_nodes": sql("SELECT category, count(*) AS n FROM nodes WHERE id IN (SELECT unnest([subject, object]) FROM edges WHERE predicate IN ('placed', 'contains', 'located_in', 'part_of') AND source NOT IN ('5-LOW', 'R') AND level <> 'P') GROUP BY category", "edges"),
    "ctx_hop1": sql(f"{_REACH} r1 WHERE hop > 0", "r1"),
    "ctx_hop2_reach": sql(f"{_REACH} r2", "r2"),
    "ctx_repr_closure": sql(f"{_REACH} r1 WHERE (seed, node) NOT IN (SELECT (seed, node) FROM r1a)", "r1"),
    "ctx_hop_counts": sql("SELECT hop, count(DISTINCT node) AS nodes_reached FROM r2 GROUP BY hop", "r2"),
    "ctx_scored": sql("SELECT * FROM scored", "scored"),
    "ctx_score_floor": sql("SELECT hop, round(thr, 6) AS thr FROM floors", "floors"),
    "ctx_kept": sql("SELECT * FROM kept", "kept"),
    "ctx_connected": sql("SELECT node FROM conn", "conn"),
    "ctx_refilled": sql("SELECT * FROM kept1 UNION ALL SELECT node, name, r.category, hop, coverage, score, degree, seeds FROM refill r LEFT JOIN have h ON h.category = r.category WHERE rk <= 40 - coalesce(have, 0)", "refill"),
    "ctx_repair_info": sql("SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 2 END::INT AS passes, true AS converged, count(*)::INT AS nodes_removed FROM islands", "islands"),
    "ctx_induced_edges": sql("SELECT subject, predicate, object, count(*) AS n, round(max(weight), 6) AS weight FROM induced GROUP BY subject, predicate, object", "induced"),
    "ctx_presence_ranks": sql("SELECT 'N:' || n_nationkey AS id, s.rank IS NOT NULL AS reached, coalesce(s.category, '') AS category, coalesce(s.hop, -1) AS hop, coalesce(s.score, -1) AS score, coalesce(s.rank, -1) AS rank, coalesce(s.category_size, -1) AS category_size FROM nation LEFT JOIN (SELECT *, rank() OVER (PARTITION BY category ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY category) AS category_size FROM scored) s ON s.node = 'N:' || n_nationkey", "scored"),
    "ctx_provenance": sql("SELECT node, CASE WHEN coverage > 1 THEN 'shared' ELSE 'specific' END AS shared, (SELECT string_agg(p, ';' ORDER BY p::INT) FROM (SELECT DISTINCT unnest([k, (k::INT % 3)::VARCHAR]) AS p FROM (SELECT split_part(unnest(string_split(seeds, ';')), ':', 2) AS k))) AS slides FROM kept", "kept"),
    "ctx_missing_seeds": sql("SELECT seed, seed_weight FROM seeds WHERE seed NOT IN (SELECT id FROM nodes)", "seeds"),
    "ctx_category_counts": sql("SELECT category, count(*) AS n FROM kept GROUP BY category", "kept"),
    "graph_components": sql("SELECT node, component FROM comp", "comp"),
    "graph_seed_pairs": sql("SELECT (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM comp WHERE node IN (SELECT seed FROM present) GROUP BY component))::BIGINT AS connected, (SELECT count(*) * (count(*) - 1) // 2 FROM present)::BIGINT AS pairs", "comp"),
    "graph_distances": sql("SELECT source, node, min(dist) AS dist FROM bfs GROUP BY source, node", "bfs"),
    "graph_simple_edges": sql("SELECT a, b, weight, predicate, subject, object FROM simple", "simple"),
    "graph_shortest_path_cost": sql(f"SELECT node, round(dist, 6) AS dist FROM p{_STEPS}", f"p{_STEPS}"),
    "graph_set_path": sql(f"SELECT (SELECT min(b.dist) FROM bfs b JOIN {_ENDS} s ON s.seed = b.source AND s.r <= 2 JOIN {_ENDS} t ON t.seed = b.node AND t.r > 2)::BIGINT AS distance, (SELECT round(min(p.dist), 6) FROM sp{_STEPS} p JOIN {_ENDS} t ON t.seed = p.node AND t.r > 2) AS cost", f"sp{_STEPS}"),
}
QUERIES = {f.__name__: f for f in (kg_degree, kg_degree_stats, kg_top_hubs, kg_edge_weights, kg_traversal_view, kg_filter_reasons, kg_filtered_edges, kg_kept_nodes, ctx_hop1, ctx_hop2_reach, ctx_repr_closure, ctx_hop_counts, ctx_scored, ctx_score_floor, ctx_kept, ctx_connected, ctx_refilled, ctx_cached, ctx_repair_info, ctx_induced_edges, ctx_presence_ranks, ctx_provenance, ctx_missing_seeds, ctx_category_counts, graph_components, graph_seed_pairs, graph_distances, graph_simple_edges, graph_shortest_path_cost, graph_set_path, graph_set_path_steps)}
ORACLES["ctx_cached"] = ORACLES["ctx_refilled"]
