"""Hierarchy and weight queries: regions and nations are classes, parts are predicates of two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ontology as h
from ..operators import package
from .kg import table

SPLIT = "R:1"
RAW = [("R:0", "0.7"), ("R:2", "1"), ("R:3", "0.25"), ("R:9", "1"), ("R:4", "x"), ("N:1", "0.9"), ("N:6", "0.4")]


def tree(spark: SparkSession, sf: str) -> DataFrame:
    c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    root = spark.range(1).select(F.lit("thing").alias("name"), F.lit(None).cast("string").alias("parent"))
    r = table(spark, sf, "region").select(c("R:", "r_regionkey").alias("name"), F.lit("thing").alias("parent"))
    n = table(spark, sf, "nation").select(c("N:", "n_nationkey").alias("name"), c("R:", "n_regionkey").alias("parent"))
    s = table(spark, sf, "supplier").select(c("S:", "s_suppkey").alias("name"), c("N:", "s_nationkey").alias("parent"))
    return root.unionByName(r).unionByName(n).unionByName(s)


def hier_closure(spark, sf):
    """H01, H02"""
    return h.closure(tree(spark, sf))


def hier_depth(spark, sf):
    """H07"""
    return h.depths(h.closure(tree(spark, sf)))


def hier_chain(spark, sf):
    """H01, H19"""
    return h.chains(h.closure(tree(spark, sf))).select("name", F.array_join("chain", ">").alias("chain"))


def hier_neighbours(spark, sf):
    """H03 on nations and regions."""
    t = tree(spark, sf).filter("name NOT LIKE 'S:%'")
    return h.neighbours(t)


def hier_distance(spark, sf):
    """H27 between each supplier and the nations of those who ordered from it."""
    c = h.chains(h.closure(tree(spark, sf)))
    side = lambda n, k: c.select(F.col("name").alias(n), F.col("chain").alias(k))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("b"))
    pairs = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("a"), "b").distinct()
    return pairs.join(side("a", "ca"), "a").join(side("b", "cb"), "b").select("a", "b", h.distance(F.col("ca"), F.col("cb")).alias("dist"))


def _weights(spark, sf):
    t = tree(spark, sf)
    closed = h.closure(t)
    branch = h.branches(t, "thing", (SPLIT,))
    raw = spark.createDataFrame(RAW, "name string, weight string")
    return t, closed, branch, h.branch_weights(raw, branch)


def branch_list(spark, sf):
    """H15, H25"""
    t, closed, branch, _ = _weights(spark, sf)
    counts = table(spark, sf, "customer").groupBy(F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return h.branch_sizes(closed, branch, counts)


def branch_weights(spark, sf):
    """H16"""
    return _weights(spark, sf)[3]


def class_weights(spark, sf):
    """H17"""
    return h.class_weights(*_weights(spark, sf))


def scope_weights(spark, sf):
    """H18"""
    t, closed, branch, w = _weights(spark, sf)
    names = t.select("name").unionByName(spark.createDataFrame([("entity",), ("unheard of",)], "name string"))
    return h.scope_weights(names, t, closed, h.class_weights(t, closed, branch, w))


def predicate_weights(spark, sf):
    """Parts are predicates: the branch is the type, the depth the size mod 4, domain and range are nations."""
    t, closed, branch, w = _weights(spark, sf)
    cw = h.class_weights(t, closed, branch, w)
    scope = h.scope_weights(t.select("name"), t, closed, cw)
    edges = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, sf, "part").join(edges, F.col("p_partkey") == F.col("l_partkey"), "left")
    n = lambda k: F.concat(F.lit("N:"), F.expr(f"(p_partkey * {k}) % 25").cast("string"))
    preds = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("predicate"), F.col("p_type").alias("branch"), (F.col("p_size") % 4).alias("depth"), n(1).alias("domain"), n(7).alias("range"), F.coalesce("n", F.lit(0)).alias("n_edges"))
    return h.derive(preds, scope).select("predicate", "branch", "w_domain", "w_range", "priority", "weight", "note")


def inherited_value(spark, sf):
    """The nearest value up the chain; nations of even key and all regions have one."""
    t = tree(spark, sf)
    a = t.select("name", F.when(F.col("name").startswith("R:") | F.col("name").rlike("^N:[0-9]*[02468]$"), F.concat(F.lit("value of "), F.col("name"))).alias("value"))
    return h.inherited(h.closure(t), a, "value")


def cluster_assignment(spark, sf):
    """G34 with regions and two nations as anchors."""
    closed = h.closure(tree(spark, sf)).select("name", "ancestor")
    anchors = spark.createDataFrame([("first", 0, "N:3"), ("second", 1, "R:1"), ("second", 1, "R:3"), ("third", 2, "R:0")], "cluster string, priority int, anchor string")
    return package.assign_cluster(closed, anchors)


_TREE = "tree AS (SELECT 'thing' AS name, NULL::VARCHAR AS parent UNION ALL SELECT 'R:' || r_regionkey, 'thing' FROM region UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier)"
_CLOSED = f"{_TREE}, closed AS (SELECT name, name AS ancestor, 0 AS dist FROM tree UNION ALL SELECT c.name, t.parent, c.dist + 1 FROM closed c JOIN tree t ON t.name = c.ancestor WHERE t.parent IS NOT NULL)"
_BRANCH = f"{_CLOSED}, branch AS (SELECT name FROM tree WHERE parent = 'thing' AND name <> '{SPLIT}' UNION ALL SELECT name FROM tree WHERE parent = '{SPLIT}'), raw AS (SELECT * FROM (VALUES {', '.join(str(x) for x in RAW)}) v(name, weight)), bw AS (SELECT name, CASE WHEN w <= 0.25 THEN 0.0 WHEN w <= 0.75 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM (SELECT name, coalesce(try_cast(weight AS DOUBLE), 0.0) AS w FROM raw WHERE name IN (SELECT name FROM branch))), bo AS (SELECT c.name, arg_min(c.ancestor, c.dist) AS branch FROM closed c JOIN branch b ON b.name = c.ancestor GROUP BY c.name), cw AS (SELECT bo.name, coalesce(bw.weight, 0.0) AS weight FROM bo LEFT JOIN bw ON bw.name = bo.branch UNION ALL SELECT t.name, coalesce((SELECT max(bw.weight) FROM closed c JOIN bw ON bw.name = c.name WHERE c.ancestor = t.name), 0.0) FROM tree t WHERE t.name NOT IN (SELECT name FROM bo)), sw AS (SELECT ancestor AS name, max(weight) AS weight FROM closed JOIN cw USING (name) GROUP BY ancestor)"
ORACLES = {
    "hier_closure": f"WITH RECURSIVE {_CLOSED} SELECT name, ancestor, dist FROM closed",
    "hier_depth": f"WITH RECURSIVE {_CLOSED} SELECT name, max(dist) AS depth FROM closed GROUP BY name",
    "hier_chain": f"WITH RECURSIVE {_CLOSED} SELECT name, string_agg(ancestor, '>' ORDER BY dist DESC) AS chain FROM closed GROUP BY name",
    "hier_neighbours": f"WITH RECURSIVE {_TREE}, t AS (SELECT * FROM tree WHERE name NOT LIKE 'S:%') SELECT parent AS name, name AS other, 0 AS kind FROM t WHERE parent IS NOT NULL UNION ALL SELECT a.name, b.name, 1 FROM t a JOIN t b ON a.parent = b.parent AND a.name <> b.name UNION ALL SELECT name, parent, 2 FROM t WHERE parent IS NOT NULL",
    "hier_distance": "SELECT DISTINCT 'S:' || s_suppkey AS a, 'N:' || b.n_nationkey AS b, CASE WHEN s_nationkey = b.n_nationkey THEN 1 WHEN a.n_regionkey = b.n_regionkey THEN 3 ELSE 5 END AS dist FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON b.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = s_nationkey",
    "branch_list": f"WITH RECURSIVE {_BRANCH}, n AS (SELECT 'N:' || c_nationkey AS name, count(*) AS n FROM customer GROUP BY 1) SELECT branch, count(*) AS n_classes, sum(coalesce(n.n, 0))::BIGINT AS n_nodes FROM bo LEFT JOIN n USING (name) GROUP BY branch",
    "branch_weights": f"WITH RECURSIVE {_BRANCH} SELECT * FROM bw",
    "class_weights": f"WITH RECURSIVE {_BRANCH} SELECT name, weight FROM cw",
    "scope_weights": f"WITH RECURSIVE {_BRANCH} SELECT name, weight FROM sw UNION ALL SELECT 'entity', 1.0 UNION ALL SELECT 'unheard of', 1.0",
    "predicate_weights": f"""WITH RECURSIVE {_BRANCH}, ed AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), p AS (SELECT 'p' || p_partkey AS predicate, p_type AS branch, p_size % 4 AS depth, d.weight AS w_domain, r.weight AS w_range, coalesce(ed.n, 0) AS n_edges, CASE WHEN d.weight <= 0 OR r.weight <= 0 THEN 0.0 ELSE greatest(d.weight, r.weight) END AS priority FROM part LEFT JOIN ed ON ed.l_partkey = p_partkey JOIN sw d ON d.name = 'N:' || (p_partkey % 25) JOIN sw r ON r.name = 'N:' || ((p_partkey * 7) % 25)),
q AS (SELECT *, CASE WHEN depth < 2 THEN 'root' WHEN priority <= 0 THEN 'out of scope' WHEN n_edges = 0 THEN 'no edges' ELSE '' END AS note FROM p)
SELECT predicate, branch, w_domain, w_range, priority, CASE WHEN note = '' THEN round(max(CASE WHEN note = '' THEN priority END) OVER (PARTITION BY branch) * priority * exp(0.7 * depth) / sum(CASE WHEN note = '' THEN priority * exp(0.7 * depth) END) OVER (PARTITION BY branch), 6) END AS weight, note FROM q""",
    "inherited_value": f"WITH RECURSIVE {_CLOSED}, a AS (SELECT name AS ancestor, 'value of ' || name AS value FROM tree WHERE name LIKE 'R:%' OR regexp_matches(name, '^N:[0-9]*[02468]$')) SELECT t.name, (SELECT arg_min(value, dist) FROM closed c JOIN a USING (ancestor) WHERE c.name = t.name) AS value FROM tree t",
    "cluster_assignment": f"WITH RECURSIVE {_CLOSED}, an AS (SELECT * FROM (VALUES ('first', 0, 'N:3'), ('second', 1, 'R:1'), ('second', 1, 'R:3'), ('third', 2, 'R:0')) v(cluster, priority, anchor)) SELECT t.name, coalesce((SELECT arg_min(cluster, priority) FROM closed c JOIN an ON an.anchor = c.ancestor WHERE c.name = t.name), 'other') AS cluster FROM tree t",
}
QUERIES = {f.__name__: f for f in (hier_closure, hier_depth, hier_chain, hier_neighbours, hier_distance, branch_list, branch_weights, class_weights, scope_weights, predicate_weights, inherited_value, cluster_assignment)}
