"""Graph builds from dumps, views of kept graphs and lineage of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import build, context, evaluate, ontology, package, paths, profile, relational
from . import kg
from .kg import table
from .ontology import _CLOSED, _TREE, tree

RULES = build.BuildRules(["biolink:placed", "biolink:contains", "biolink:related_to"], ["biolink:Customer", "biolink:Order", "biolink:Gene", "biolink:Supplier"], ("biolink:related_to",), ("R",), ("P",), ("UMLS",))


# ---- builds ---------------------------------------------------------------------------------------------------------


def node_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, orders, parts (genes, some under the prefix of concepts), suppliers and nations as a node dump."""
    none = F.array().cast("array<string>")

    def leg(t: str, key: str, prefix, category: str, name, names=none, same=none):
        k = F.col(key).cast("string")
        return table(spark, sf, t).select(F.concat(prefix if not isinstance(prefix, str) else F.lit(prefix), k).alias("id"), name.alias("name"), F.lit(f"biolink:{category}").alias("category"), F.array(F.lit(f"biolink:{category}")).alias("all_categories"), same.alias("equivalent_curies"), F.repeat(F.concat(F.lit(f"{category} "), k, F.lit(" ")), 300).alias("description"), F.lit("").alias("iri"), names.alias("all_names"), F.transform(F.sequence(F.lit(1), F.col(key) % 150 + 1), lambda x: F.concat(F.lit("PMID:"), x.cast("string"))).alias("publications"))

    part = F.when(F.col("p_size") % 10 == 0, "UMLS:").otherwise("P:")
    c = leg("customer", "c_custkey", "C:", "Customer", F.col("c_name"), F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: F.concat(F.col("c_name"), x.cast("string"))), F.array(F.concat(F.lit("E:"), F.col("c_custkey").cast("string")), F.concat(F.lit("C:"), F.col("c_custkey").cast("string"))))
    return c.unionByName(leg("orders", "o_orderkey", "O:", "Order", F.lit(None).cast("string"))).unionByName(leg("part", "p_partkey", part, "Gene", F.col("p_name"))).unionByName(leg("supplier", "s_suppkey", "S:", "Supplier", F.col("s_name"))).unionByName(leg("nation", "n_nationkey", "N:", "Nation", F.col("n_name")))


def edge_dump(spark, sf):
    """Placed (some with a doubled prefix), contains, related_to (excluded) and odd (unknown) edges as an edge dump."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    cols = lambda a, b, p, source, level, pubs: [a.alias("subject"), b.alias("object"), p.alias("predicate"), source.alias("primary_knowledge_source"), level.alias("knowledge_level"), F.lit("x").alias("agent_type"), pubs.alias("publications")]
    none, blank = F.array().cast("array<string>"), F.lit(None).cast("string")
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 10 == 0, "UMLS:").otherwise("P:"), F.col("p_partkey").cast("string")).alias("part"))
    li = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    placed = table(spark, sf, "orders").select(*cols(s("C:", "o_custkey"), s("O:", "o_orderkey"), F.when(F.col("o_orderkey") % 2 == 1, "biolink:biolink_placed").otherwise("biolink:placed"), F.col("o_orderpriority"), F.col("o_orderstatus"), none))
    contains = li.select(*cols(s("O:", "l_orderkey"), F.col("part"), F.lit("biolink:contains"), F.col("l_returnflag"), F.col("l_linestatus"), F.array(s("S:", "l_suppkey"), F.col("l_returnflag"))))
    related = li.select(*cols(F.col("part"), s("S:", "l_suppkey"), F.lit("biolink:related_to"), blank, blank, none))
    odd = table(spark, sf, "customer").select(*cols(s("C:", "c_custkey"), s("N:", "c_nationkey"), F.lit("biolink:odd"), blank, blank, none))
    return placed.unionByName(contains).unionByName(related).unionByName(odd)


def _built(spark, sf):
    return build.build(node_dump(spark, sf), edge_dump(spark, sf), RULES)


def build_reasons(spark, sf):
    """What became of each edge of the dump."""
    return _built(spark, sf).reasons


def build_sources(spark, sf):
    """Edges kept and dropped by source."""
    return _built(spark, sf).by_source


def build_edges(spark, sf):
    """The coded edges, with their predicates read back from the codes."""
    t = _built(spark, sf)
    e = context.decode(t.edges, t.predicates)
    return e.groupBy("predicate", "primary_knowledge_source", "knowledge_level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject", "object").alias("pairs"))


def build_predicates(spark, sf):
    """G38"""
    return _built(spark, sf).predicates


def build_nodes(spark, sf):
    """G38, P08, P11, J16"""
    return _built(spark, sf).nodes.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") == "").alias("unnamed"))


def build_equivalents(spark, sf):
    return _built(spark, sf).equivalents


def _extras(spark, sf, of_details=None):
    t = _built(spark, sf)
    return build.extras(node_dump(spark, sf), edge_dump(spark, sf), context.stage(t.nodes, "nodes"), t.predicates, of_details)


def extra_details(spark, sf):
    """Long texts and lists are cut."""
    return _extras(spark, sf, [F.md5("description").alias("description"), F.length("description").alias("length"), F.size("synonyms").alias("synonyms"), F.size("publications").alias("publications")])[0]


def extra_publications(spark, sf):
    """Publications of each kept triple, united over repeated ones."""
    pubs = context.stage(_extras(spark, sf)[1], "publications")
    triples = pubs.select("subject", "predicate", "object").distinct()
    return build.triple_publications(triples, pubs).select("subject", "predicate", "object", F.array_join("publications", ";").alias("publications"))


# ---- kept graphs ----------------------------------------------------------------------------------------------------


def graph_diameter(spark, sf):
    """G26"""
    e, ids, _ = kg._small(spark, sf)
    return paths.diameter(paths.components(e, ids), e)


def graph_vocabulary(spark, sf):
    """G27"""
    _, kept, present = kg._kept_parts(spark, sf)
    return paths.vocabulary_expansion(kept, present)


def graph_path_edges(spark, sf):
    """Each link of the kept graph walked from its larger end, with the direction it is stored in."""
    e, _, _ = kg._small(spark, sf)
    s = context.stage(paths.simple_graph(e.withColumn("weight", F.round("weight", 6))), "simple")
    walked = s.select(F.concat_ws(">", "b", "a").alias("path_id"), F.array("b", "a", "b").alias("path"))
    return paths.path_edges(walked, s)


def graph_structure(spark, sf):
    """Of seed pairs the distances, of the kept nodes the full categories and the share at hop 1."""
    _, kept, present = kg._kept_parts(spark, sf)
    e = context.stage(context.induced(kg._edges(spark, sf), kept, present), "induced")
    d = paths.distances(e, present.select(F.col("seed").alias("source"))).join(present.select(F.col("seed").alias("node")), "node", "left_semi").filter("source < node")
    p = present.select(F.col("seed").alias("source"))
    pairs = p.join(p.withColumnRenamed("source", "node"), F.col("source") < F.col("node")).join(d, ["source", "node"], "left")  # seeds are few
    r = evaluate.structure(pairs, kept, kg.PARAMS.per_category_cap)
    return r.select(F.round("mean_dist", 6).alias("mean_dist"), "max_dist", F.round("connected", 6).alias("connected"), "saturated", F.round("hop1_share", 6).alias("hop1_share"))


def signature_recovery(spark, sf):
    """The best place of each pattern among the scored nodes."""
    s = kg._scored(spark, sf)
    ranked = paths.rank_within(s, "category", "score", "node").select("name", "rank", "size")
    patterns = spark.createDataFrame([("customer#",), ("=nation_3",), ("ring",), ("=ring",), ("NATION_1",), ("absent thing",)], "pattern string")
    r = paths.signature_recovery(context.stage(ranked, "ranked"), patterns)
    return r.select("pattern", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"), F.coalesce("size", F.lit(-1)).cast("long").alias("size"), F.coalesce(F.round("share", 9), F.lit(-1.0)).alias("share"))


def mechanism_ranks(spark, sf):
    """Places of the nations in two graphs."""
    _, kept, _ = kg._kept_parts(spark, sf)
    both = kept.withColumn("graph", F.lit("all")).unionByName(kept.filter("coverage > 1").withColumn("graph", F.lit("shared"))).withColumn("is_seed", F.lit(False))
    ids = table(spark, sf, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("id"))
    return evaluate.mechanism_ranks(both, ids).select("graph", "node", "category", F.col("rank").cast("long").alias("rank"), F.col("size").cast("long").alias("size"))


def kept_export(spark, sf):
    """The first rows of the export order."""
    return relational.export_order(kg._kept_parts(spark, sf)[1]).limit(60).select("category", "node", "score")


def wanted_attributes(spark, sf):
    """Names of the kept ids from the whole node table."""
    ids = kg._kept_parts(spark, sf)[1].select(F.col("node").alias("id"))
    return relational.wanted(ids, kg.nodes(spark, sf)).select("id", "name", "category")


def _viewed(spark, sf):
    """Kept nodes and seeds as the viewer has them, clusters by kind."""
    _, kept, present = kg._kept_parts(spark, sf)
    n = kept.select(F.col("node").alias("id"), F.col("name").alias("label"), "category", F.lower("category").alias("cluster"), F.lit(False).alias("is_seed"), "hop", "score", (F.col("category") != "Region").alias("in_scope"))
    s = present.join(kg.nodes(spark, sf).withColumnRenamed("id", "seed"), "seed").select(F.col("seed").alias("id"), F.col("name").alias("label"), "category", F.lower("category").alias("cluster"), F.lit(True).alias("is_seed"), F.lit(0).alias("hop"), F.lit(0.0).alias("score"), F.lit(False).alias("in_scope"))
    return context.stage(n.unionByName(s), "viewed")


def _links(spark, sf):
    return kg._edges(spark, sf).select(F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", F.round("weight", 6).alias("weight"))


def viewer_elements(spark, sf):
    """The elements of the kept graph; of all edges only those between shown nodes."""
    e = package.elements(_viewed(spark, sf), _links(spark, sf))
    j = lambda k: F.get_json_object("data", f"$.{k}")
    return e.select("kind", F.coalesce(j("id"), F.concat_ws(">", j("source"), j("target"))).alias("key"), F.coalesce(j("parent"), j("predicate"), F.lit("")).alias("of"), F.coalesce(j("n"), j("label"), F.lit("")).alias("value")).groupBy("kind", "key", "of", "value").agg(F.count(F.lit(1)).alias("n"))


def viewer_filter(spark, sf):
    """Without two categories, in scope, one hop; seeds stay."""
    return package.client_filter(_viewed(spark, sf), ["Order", "Customer"], True, 1).select("id", "category", "is_seed")


def viewer_find(spark, sf):
    """P23"""
    return package.find(_viewed(spark, sf), "CUSTOMER#00", 12).select("id", "label", "is_seed")


def viewer_subset(spark, sf):
    """The best nodes, the nearest of each seed and the seeds."""
    e = _links(spark, sf).groupBy("source", "target").agg(F.max("weight").alias("weight"))
    return package.subset(_viewed(spark, sf), e, 15, 3)


def viewer_scope(spark, sf):
    """G35"""
    n = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    return package.scope_group(_viewed(spark, sf), n("Part", "Nation"), n("Part", "Order")).groupBy("category", "scope_group").agg(F.count(F.lit(1)).alias("n"))


def ring_neighbours(spark, sf):
    """The shown nodes next to each seed, by which seeds are put around the ring."""
    v = _viewed(spark, sf)
    near = package.shown_neighbours(_links(spark, sf).select("source", "target"), v.filter("is_seed").select(F.col("id").alias("seed")), v.filter("NOT is_seed"))
    return near.select("seed", F.array_join("neighbours", ";").alias("neighbours"))


def cluster_anchors(spark, sf):
    """G34 with the whole table of anchors: nations are classes below them, in the order of the table."""
    a = package.anchor_table(spark)
    closed = a.select(F.concat(F.lit("kind of "), F.col("anchor")).alias("name"), F.col("anchor").alias("ancestor")).unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("ancestor")))
    both = closed.unionByName(a.select(F.concat(F.lit("kind of "), F.col("anchor")).alias("name"), F.lit("chemical entity or gene or gene product").alias("ancestor")))
    return package.assign_cluster(both, a)


# ---- classes --------------------------------------------------------------------------------------------------------


def _mixins(spark, sf):
    """Nations are mixed in with one of four groups, which are classes of their own."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("M:"), (F.col("n_nationkey") % 4).cast("string")).alias("mixin"))
    m = n.select(F.col("mixin").alias("name"), F.lit("M").alias("parent")).distinct().unionByName(spark.createDataFrame([("M", None)], "name string, parent string"))
    return n, m


def _members(spark, sf):
    closed = context.stage(ontology.closure(tree(spark, sf)), "closed")
    anchors = spark.createDataFrame([("s1", "R:0"), ("s2", "N:3"), ("s2", "N:7")], "stratum string, name string")
    angles = spark.createDataFrame([("s1", "thing", "wide"), ("s1", "R:2", "narrow"), ("s2", "R:3", "only")], "stratum string, name string, angle string")
    return closed, ontology.strata(closed, anchors, angles)


def hier_entities(spark, sf):
    """Below one region and not below two of the nations."""
    closed = ontology.closure(tree(spark, sf))
    inside = ontology.entity_classes(closed, "R:1", "N:1")
    return inside.join(ontology.entity_classes(closed, "R:1", "N:6"), "name", "left_semi")


def hier_mixins(spark, sf):
    """H08"""
    n, m = _mixins(spark, sf)
    return ontology.effective_mixins(ontology.closure(tree(spark, sf).unionByName(m)), n)


def hier_strata(spark, sf):
    """H09"""
    return _members(spark, sf)[1].select("name", "stratum", "status", F.coalesce("angle", F.lit("")).alias("angle"))


def stratum_summary(spark, sf):
    """H13"""
    return ontology.stratum_summary(_members(spark, sf)[1]).select("stratum", "n_core", "n_shared", F.array_join("core_names", ";").alias("core_names"))


def predicate_strata(spark, sf):
    """Parts are predicates from a nation to a group or a region."""
    closed, members = _members(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("predicate"), F.concat(F.lit("N:"), (F.col("p_partkey") % 25).cast("string")).alias("domain"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("M:"), (F.col("p_size") % 6).cast("string"))).otherwise(F.concat(F.lit("R:"), (F.col("p_size") % 5).cast("string"))).alias("range"))
    return ontology.in_stratum(p, members.filter("status = 'core'"), closed, _mixins(spark, sf)[0])


def predicates_unseen(spark, sf):
    """Event types among which two are known."""
    known = spark.createDataFrame([("click",), ("signup",)], "predicate string")
    o = table(spark, sf, "events").select(F.col("event_type").alias("predicate")).distinct()
    return ontology.unseen(o, known).select("predicate", F.coalesce("parent", F.lit("")).alias("parent"), "observed_only")


def uniform_profile(spark, sf):
    """H14"""
    p = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("predicate")).distinct()
    a, b = ontology.uniform_profile(p, ontology.branches(tree(spark, sf), "thing"))
    return a.withColumnRenamed("predicate", "name").unionByName(b)


def stratum_branches(spark, sf):
    """Default weights of the branches for a stratum: 1 with a core class in them, a half with a shared one."""
    closed, members = _members(spark, sf)
    return ontology.default_weights(closed, ontology.branches(tree(spark, sf), "thing"), members.filter("stratum = 's1'"), 0.5)


def hier_nested(spark, sf):
    """The nested document of regions and nations, read back to pairs of depth and name."""
    import json

    out, todo = [], [(0, x) for x in json.loads(ontology.nested(tree(spark, sf).filter("name NOT LIKE 'S:%'")))]
    while todo:
        depth, x = todo.pop()
        out.append((depth, x["name"], len(x["children"])))
        todo += [(depth + 1, c) for c in x["children"]]
    return spark.createDataFrame(out, "depth int, name string, n_children int")


def hier_orphans(spark, sf):
    """Roots, and names whose parent is missing once a region is taken out."""
    t = tree(spark, sf).filter("name <> 'R:2'")
    return ontology.roots(t).withColumn("kind", F.lit("root")).unionByName(ontology.orphans(t).withColumn("kind", F.lit("orphan")))


def class_lookups(spark, sf):
    """The answer of a lookup of each region and nation."""
    t = tree(spark, sf).filter("name NOT LIKE 'S:%'")
    return ontology.lookup_text(t, t.select("name", F.concat(F.lit("about "), F.col("name")).alias("description")))


def class_documents(spark, sf):
    """Documents of the parts that may be indexed."""
    p = table(spark, sf, "part").select("*", (F.col("p_size") > 45).alias("deprecated"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") < 5).alias("abstract"))
    d = ontology.indexable(p)
    return d.select("p_partkey", text.class_document(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")), F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.col("p_brand")), F.col("p_size").cast("string")).alias("document"))


def direction_forms(spark, sf):
    """Forms in which a direction is given, and fingerprints of the same parts in another order."""
    forms = [None, True, False, "off", "on", "undirected", {"mode": "on", "inverse_factor": 7}, {"mode": "off", "inverse_factor": 0.3}, {"inverse_factor": "x"}, {"inverse_factor": 0.125}]
    rows = [(i, *profile.directionality(f)) for i, f in enumerate(forms)]
    same = profile.fingerprint({"a": 1, "b": [2, 3]}) == profile.fingerprint({"b": [2, 3], "a": 1}) != profile.fingerprint({"a": 1, "b": [3, 2]})
    over = [(100, *profile.effective_direction(profile.Profile(mode="off"), "on", 0.75)), (101, *profile.effective_direction(profile.Profile(inverse_factor=0.2))), (102, "same" if same else "other", 0.0)]
    return spark.createDataFrame(rows + over, "form int, mode string, factor double")


# ---- the same in SQL ------------------------------------------------------------------------------------------------

_PART = "CASE WHEN p_size % 10 = 0 THEN 'UMLS:' ELSE 'P:' END || p_partkey"
_DUMP = f"""d AS MATERIALIZED (SELECT 'C:' || o_custkey AS s, 'O:' || o_orderkey AS o, 'biolink:placed' AS p, o_orderpriority AS src, o_orderstatus AS lvl, [] AS pubs FROM orders
UNION ALL SELECT 'O:' || l_orderkey, {_PART}, 'biolink:contains', l_returnflag, l_linestatus, ['S:' || l_suppkey, l_returnflag] FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT {_PART}, 'S:' || l_suppkey, 'biolink:related_to', '', '', [] FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'biolink:odd', '', '', [] FROM customer),
f AS MATERIALIZED (SELECT *, CASE WHEN p = 'biolink:odd' THEN 'unknown predicate' WHEN p = 'biolink:related_to' THEN 'excluded predicate' WHEN src = 'R' THEN 'excluded source' WHEN lvl = 'P' THEN 'excluded level' WHEN s LIKE 'UMLS:%' OR o LIKE 'UMLS:%' THEN 'concept node' END AS reason FROM d),
k AS MATERIALIZED (SELECT * FROM f WHERE reason IS NULL), ends AS MATERIALIZED (SELECT DISTINCT unnest([s, o]) AS id FROM k),
nd AS (SELECT 'C:' || c_custkey AS id, c_name AS name, 'biolink:Customer' AS category, c_custkey AS key, 40 AS names FROM customer UNION ALL SELECT 'O:' || o_orderkey, '', 'biolink:Order', o_orderkey, 0 FROM orders UNION ALL SELECT {_PART}, p_name, 'biolink:Gene', p_partkey, 0 FROM part UNION ALL SELECT 'S:' || s_suppkey, s_name, 'biolink:Supplier', s_suppkey, 0 FROM supplier),
n AS MATERIALIZED (SELECT * FROM nd WHERE id IN (SELECT id FROM ends))"""
_VIEW = "viewed AS MATERIALIZED (SELECT node AS id, name AS label, category, lower(category) AS cluster, false AS is_seed, hop, score FROM kept UNION ALL SELECT id, name, category, lower(category), true, 0, 0.0 FROM nodes WHERE id IN (SELECT seed FROM present)), links AS (SELECT subject AS source, object AS target, predicate, round(weight, 6) AS weight FROM e), shown AS (SELECT * FROM links WHERE source IN (SELECT id FROM viewed) AND target IN (SELECT id FROM viewed))"
_STRATA = f"{_CLOSED}, an(stratum, name) AS (VALUES ('s1', 'R:0'), ('s2', 'N:3'), ('s2', 'N:7')), ag(stratum, name, angle) AS (VALUES ('s1', 'thing', 'wide'), ('s1', 'R:2', 'narrow'), ('s2', 'R:3', 'only')), core AS (SELECT DISTINCT c.name, stratum FROM closed c JOIN an ON an.name = c.ancestor), near AS (SELECT c.name, stratum, arg_min(angle, dist) AS angle FROM closed c JOIN ag ON ag.name = c.ancestor GROUP BY 1, 2), st AS (SELECT coalesce(core.name, near.name) AS name, coalesce(core.stratum, near.stratum) AS stratum, CASE WHEN core.name IS NOT NULL THEN 'core' ELSE 'shared' END AS status, coalesce(angle, '') AS angle FROM core FULL JOIN near ON near.name = core.name AND near.stratum = core.stratum)"


def _in(base: str, more: str, select: str) -> str:
    """A select over the common tables of the context graph and more of its own."""
    return kg.sql(f"SELECT * FROM (WITH {more} {select})", base)


ORACLES = {
    "build_reasons": f"WITH {_DUMP} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM f GROUP BY 1",
    "build_sources": f"WITH {_DUMP} SELECT src AS primary_knowledge_source, reason IS NULL AS kept, count(*) AS n FROM f GROUP BY 1, 2",
    "build_edges": f"WITH {_DUMP} SELECT p AS predicate, src AS primary_knowledge_source, lvl AS knowledge_level, count(*) AS n, count(DISTINCT (s, o)) AS pairs FROM k GROUP BY 1, 2, 3",
    "build_predicates": f"WITH {_DUMP} SELECT (row_number() OVER (ORDER BY p) - 1)::SMALLINT AS predicate_code, p AS predicate, count(*) AS n_edges_kept FROM k GROUP BY p",
    "build_nodes": f"WITH {_DUMP} SELECT category, count(*) AS n, count(*) FILTER (WHERE name = '') AS unnamed FROM n GROUP BY 1",
    "build_equivalents": f"WITH {_DUMP} SELECT unnest(['E:' || key, id]) AS curie, id AS canonical_id FROM n WHERE category = 'biolink:Customer'",
    "extra_details": f"WITH {_DUMP} SELECT id, md5(substr(t, 1, 2000)) AS description, least(2000, length(t))::INT AS length, least(30, names)::INT AS synonyms, least(100, key % 150 + 1)::INT AS publications FROM (SELECT *, repeat(category[9:] || ' ' || key || ' ', 300) AS t FROM n)",
    "extra_publications": f"WITH {_DUMP} SELECT s AS subject, p AS predicate, o AS object, string_agg(DISTINCT x, ';' ORDER BY x) AS publications FROM (SELECT s, p, o, unnest(pubs) AS x FROM d WHERE p IN (SELECT p FROM k) AND s IN (SELECT id FROM n) AND o IN (SELECT id FROM n)) GROUP BY 1, 2, 3",
    "graph_diameter": kg.sql("SELECT max(dist) AS diameter FROM (WITH RECURSIVE big AS (SELECT node FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)), far AS (SELECT node AS source, node, 0 AS dist FROM big UNION SELECT f.source, p.b, f.dist + 1 FROM far f JOIN pairs p ON p.a = f.node WHERE f.dist < 10) SELECT source, node, min(dist) AS dist FROM far GROUP BY 1, 2)", "comp"),
    "graph_vocabulary": kg.sql("SELECT round(((SELECT count(*) FROM kept) + (SELECT count(*) FROM present)) / (SELECT greatest(count(*), 1) FROM present), 2) AS vocabulary_expansion", "present"),
    "graph_path_edges": kg.sql("SELECT b || '>' || a AS path_id, unnest([0, 1])::INT AS step, subject, object, predicate, unnest([b = subject, a = subject]) AS forward FROM simple", "simple"),
    "graph_structure": _in("bfs", "q AS (SELECT a.seed, b.seed AS other, (SELECT min(dist) FROM bfs WHERE source = a.seed AND node = b.seed) AS dist FROM present a JOIN present b ON a.seed < b.seed)", f"SELECT (SELECT round(avg(dist), 6) FROM q) AS mean_dist, (SELECT max(dist) FROM q) AS max_dist, (SELECT round(avg((dist IS NOT NULL)::INT), 6) FROM q) AS connected, (SELECT count(*) FROM (SELECT category FROM kept GROUP BY 1 HAVING count(*) >= {kg.PARAMS.per_category_cap})) AS saturated, (SELECT round(avg((hop = 1)::INT), 6) FROM kept) AS hop1_share"),
    "signature_recovery": kg.sql("SELECT pattern, coalesce(x[3], '') AS name, coalesce(x[4], -1)::BIGINT AS rank, coalesce(x[5], -1)::BIGINT AS size, coalesce(round(x[1], 9), -1) AS share FROM (SELECT pattern, min((r.rank / r.size, r.name, r.name, r.rank, r.size)) FILTER (WHERE r.name IS NOT NULL) AS x FROM (VALUES ('customer#'), ('=nation_3'), ('ring'), ('=ring'), ('NATION_1'), ('absent thing')) v(pattern) LEFT JOIN (SELECT name, row_number() OVER (PARTITION BY category ORDER BY score DESC, node) AS rank, count(*) OVER (PARTITION BY category) AS size FROM scored) r ON CASE WHEN pattern LIKE '=%' THEN lower(r.name) = lower(substr(pattern, 2)) ELSE contains(lower(r.name), lower(pattern)) END GROUP BY pattern)", "scored"),
    "mechanism_ranks": kg.sql("SELECT * FROM (SELECT graph, node, category, row_number() OVER (PARTITION BY graph, category ORDER BY score DESC, node) AS rank, count(*) OVER (PARTITION BY graph, category) AS size FROM (SELECT 'all' AS graph, * FROM kept UNION ALL SELECT 'shared', * FROM kept WHERE coverage > 1)) WHERE node LIKE 'N:%'", "kept"),
    "kept_export": kg.sql("SELECT category, node, score FROM kept ORDER BY category, score DESC, node LIMIT 60", "kept"),
    "wanted_attributes": kg.sql("SELECT id, name, category FROM nodes WHERE id IN (SELECT node FROM kept)", "kept"),
    "viewer_elements": _in("present", _VIEW, "SELECT 'cluster' AS kind, 'cluster:' || cluster AS key, '' AS \"of\", count(*)::VARCHAR AS value, 1::BIGINT AS n FROM viewed GROUP BY cluster UNION ALL SELECT 'node', id, 'cluster:' || cluster, label, 1 FROM viewed UNION ALL SELECT 'edge', source || '>' || target, predicate, '', count(*) FROM shown GROUP BY source, target, predicate"),
    "viewer_filter": _in("present", _VIEW, "SELECT id, category, is_seed FROM viewed WHERE is_seed OR (category NOT IN ('Order', 'Customer', 'Region') AND hop <= 1)"),
    "viewer_find": _in("present", _VIEW, "SELECT id, label, is_seed FROM viewed WHERE contains(lower(label), 'customer#00') ORDER BY is_seed DESC, label, id LIMIT 12"),
    "viewer_subset": _in("present", _VIEW, "SELECT id FROM viewed WHERE is_seed UNION SELECT id FROM (SELECT id FROM viewed WHERE NOT is_seed ORDER BY score DESC, id LIMIT 15) UNION SELECT b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM (SELECT a, b, w FROM (SELECT source AS a, target AS b, max(weight) AS w FROM links GROUP BY 1, 2 UNION ALL SELECT target, source, max(weight) FROM links GROUP BY 1, 2)) WHERE a IN (SELECT id FROM viewed WHERE is_seed)) WHERE r <= 3"),
    "viewer_scope": _in("present", _VIEW, "SELECT category, CASE WHEN category IN ('Part', 'Nation') THEN 'core' WHEN category = 'Order' THEN 'shared' ELSE 'other' END AS scope_group, count(*) AS n FROM viewed GROUP BY 1, 2"),
    "ring_neighbours": _in("present", _VIEW, "SELECT seed, coalesce(string_agg(DISTINCT b, ';' ORDER BY b), '') AS neighbours FROM present LEFT JOIN (SELECT source AS a, target AS b FROM shown UNION ALL SELECT target, source FROM shown) ON a = seed AND b IN (SELECT id FROM viewed WHERE NOT is_seed) GROUP BY seed"),
    "cluster_anchors": "WITH a(cluster, priority, anchor) AS (VALUES " + ", ".join(f"('{c}', {i}, '{x}')" for i, (c, xs) in enumerate(package.CLUSTERS.items()) for x in xs) + ") SELECT DISTINCT 'kind of ' || anchor AS name, (SELECT arg_min(cluster, priority) FROM a b WHERE b.anchor IN (a.anchor, 'chemical entity or gene or gene product')) AS cluster FROM a UNION ALL SELECT n_name, 'other' FROM nation",
    "hier_entities": f"WITH RECURSIVE {_CLOSED} SELECT name FROM closed WHERE ancestor = 'R:1' AND name NOT IN (SELECT name FROM closed WHERE ancestor IN ('N:1', 'N:6'))",
    "hier_mixins": f"WITH RECURSIVE {_CLOSED}, m AS (SELECT 'N:' || n_nationkey AS name, 'M:' || (n_nationkey % 4) AS mixin FROM nation) SELECT DISTINCT c.name, unnest([mixin, 'M']) AS mixin FROM closed c JOIN m ON m.name = c.ancestor",
    "hier_strata": f"WITH RECURSIVE {_STRATA} SELECT name, stratum, status, angle FROM st",
    "stratum_summary": f"WITH RECURSIVE {_STRATA} SELECT stratum, count(*) FILTER (WHERE status = 'core') AS n_core, count(*) FILTER (WHERE status = 'shared') AS n_shared, string_agg(CASE WHEN status = 'core' THEN name END, ';' ORDER BY name) AS core_names FROM st GROUP BY 1",
    "predicate_strata": f"WITH RECURSIVE {_STRATA}, sc AS (SELECT DISTINCT ancestor AS side, stratum FROM closed JOIN core USING (name) UNION SELECT 'M:' || (n_nationkey % 4), stratum FROM nation JOIN core ON core.name = 'N:' || n_nationkey), p AS (SELECT p_partkey AS predicate, 'N:' || (p_partkey % 25) AS d, CASE WHEN p_partkey % 3 = 0 THEN 'M:' || (p_size % 6) ELSE 'R:' || (p_size % 5) END AS r FROM part) SELECT predicate, a.stratum FROM p JOIN sc a ON a.side = d JOIN sc b ON b.side = r AND b.stratum = a.stratum",
    "predicates_unseen": "SELECT DISTINCT event_type AS predicate, '' AS parent, true AS observed_only FROM events WHERE event_type NOT IN ('click', 'signup')",
    "uniform_profile": "SELECT DISTINCT o_orderpriority AS name, 1.0 AS weight FROM orders UNION ALL SELECT 'R:' || r_regionkey, 1.0 FROM region",
    "stratum_branches": f"WITH RECURSIVE {_STRATA} SELECT 'R:' || r_regionkey AS name, CASE WHEN EXISTS (SELECT 1 FROM closed c JOIN st ON st.name = c.name WHERE c.ancestor = 'R:' || r_regionkey AND stratum = 's1' AND status = 'core') THEN 1.0 WHEN EXISTS (SELECT 1 FROM closed c JOIN st ON st.name = c.name WHERE c.ancestor = 'R:' || r_regionkey AND stratum = 's1') THEN 0.5 ELSE 0.0 END AS weight FROM region",
    "hier_nested": f"WITH {_TREE} SELECT CASE WHEN parent IS NULL THEN 0 WHEN parent = 'thing' THEN 1 ELSE 2 END::INT AS depth, name, (SELECT count(*) FROM tree c WHERE c.parent = t.name AND c.name NOT LIKE 'S:%')::INT AS n_children FROM tree t WHERE name NOT LIKE 'S:%'",
    "hier_orphans": f"WITH {_TREE} SELECT 'thing' AS name, 'root' AS kind UNION ALL SELECT name, 'orphan' FROM tree WHERE parent = 'R:2'",
    "class_lookups": f"WITH {_TREE}, t AS (SELECT * FROM tree WHERE name NOT LIKE 'S:%') SELECT name, name || ': about ' || name || coalesce(chr(10) || 'children: ' || (SELECT string_agg(c.name, ', ' ORDER BY c.name) FROM t c WHERE c.parent = t.name), '') || coalesce(chr(10) || 'siblings: ' || (SELECT string_agg(c.name, ', ' ORDER BY c.name) FROM t c WHERE c.parent = t.parent AND c.name <> t.name), '') || coalesce(chr(10) || 'parent: ' || parent, '') AS text FROM t",
    "class_documents": "SELECT p_partkey, concat_ws('. ', p_name, CASE WHEN p_partkey % 3 = 0 THEN 'Description: ' || p_type END, CASE WHEN p_partkey % 2 = 1 THEN 'Aliases: ' || p_brand END, 'Examples: ' || p_size) AS document FROM part WHERE p_size <= 45 AND NOT (p_size % 2 = 0 AND p_size < 5)",
    "direction_forms": "SELECT * FROM (VALUES (0, 'on', 0.5::DOUBLE), (1, 'on', 0.5), (2, 'off', 1.0), (3, 'off', 1.0), (4, 'on', 0.5), (5, 'off', 1.0), (6, 'on', 1.0), (7, 'off', 1.0), (8, 'on', 0.5), (9, 'on', 0.125), (100, 'on', 0.75), (101, 'on', 0.2), (102, 'same', 0.0)) v(form, mode, factor)",
}
QUERIES = {f.__name__: f for f in (build_reasons, build_sources, build_edges, build_predicates, build_nodes, build_equivalents, extra_details, extra_publications, graph_diameter, graph_vocabulary, graph_path_edges, graph_structure, signature_recovery, mechanism_ranks, kept_export, wanted_attributes, viewer_elements, viewer_filter, viewer_find, viewer_subset, viewer_scope, ring_neighbours, cluster_anchors, hier_entities, hier_mixins, hier_strata, stratum_summary, predicate_strata, predicates_unseen, uniform_profile, stratum_branches, hier_nested, hier_orphans, class_lookups, class_documents, direction_forms)}
