"""Relational, statistical and time-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import evaluate, package, relational
from ..operators import paths as graph
from .kg import table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ASSUMED = [(60.0, "FR", 32.0), (60.0, "IT", 242.0), (200.0, "FR", 32.0), (200.0, "IT", 242.0)]


def _bought(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (segment, part) of what customers bought."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("c_mktsegment").alias("set_name"), F.col("l_partkey").alias("item")).distinct()


def presence_matrix(spark, sf):
    """G33"""
    m = _bought(spark, sf).select(F.col("set_name").alias("graph"), F.col("item").alias("node"))
    return graph.presence_matrix(m, table(spark, sf, "part").select(F.col("p_partkey").alias("id")), SEGMENTS)


def venn_regions(spark, sf):
    """U03"""
    return relational.regions(_bought(spark, sf), SEGMENTS[:3])


def jaccard_matrix(spark, sf):
    """A20"""
    return relational.jaccard(_bought(spark, sf)).select("set_name", "other", F.col("both").alias("n_both"), F.round("jaccard", 6).alias("jaccard"))


def set_coverage(spark, sf):
    """Parts of one segment that another lacks."""
    b = _bought(spark, sf)
    a, c = b.filter("set_name = 'AUTOMOBILE'").select("item"), b.filter("set_name = 'BUILDING'").select("item")
    return a.join(c, "item", "left_anti")


def first_wins_dedup(spark, sf):
    """P13"""
    return relational.first_wins(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def ordered_collect(spark, sf):
    """Orders are mentions, customers their ids."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("kg_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("label"), (F.col("o_orderkey") % 5).alias("page"), F.col("o_orderstatus").alias("mention"))
    return relational.seeds_from_mentions(o).select("kg_id", "label", F.array_join(F.transform("pages", lambda x: x.cast("string")), ";").alias("pages"), F.array_join("mentions", ";").alias("mentions"))


def map_max_merge(spark, sf):
    """A12"""
    return relational.merge_maps(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice")


def top_orders(spark, sf):
    """The three dearest orders of a customer."""
    return relational.top_k(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, "rank").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def rank_within(spark, sf):
    """W04"""
    return graph.rank_within(table(spark, sf, "customer"), "c_nationkey", "c_acctbal", "c_custkey").select("c_custkey", "c_nationkey", F.col("rank").cast("long").alias("rank"), "size")


def numbered_names(spark, sf):
    """O14"""
    return relational.number_repeats(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "name")


def custom_order(spark, sf):
    """O08"""
    return relational.custom_order(table(spark, sf, "customer").select("c_mktsegment").distinct(), "c_mktsegment", ["MACHINERY", "BUILDING"])


def carried_over(spark, sf):
    """New rows of the nations that have rich suppliers, old rows for the others."""
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return relational.carry_over(s.filter("s_acctbal > 5000"), s, "s_nationkey")


def reconcile_cells(spark, sf):
    """Customers against a copy with changed and missing rows."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    d = c.filter("c_custkey % 97 <> 5").withColumn("c_nationkey", F.when(F.col("c_custkey") % 50 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 41 == 0, None).otherwise(F.col("c_mktsegment")))
    return relational.reconcile(c, d, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


def stage_windows(spark, sf):
    """Signups of a user end its stages."""
    e = table(spark, sf, "events")
    marks = e.filter("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("done")).join(e.groupBy("user_id").agg(F.min("ts").alias("start")), "user_id")
    return relational.stage_windows(marks, ["user_id"], "done", "done", "start").select("user_id", "event_id", "t0", "t1")


def stage_peaks(spark, sf):
    """J21, A21"""
    e = table(spark, sf, "events").filter("event_type <> 'signup'").select("user_id", "ts", "value")
    return relational.stage_peaks(e, stage_windows(spark, sf), "ts", "value", ["user_id"], "event_id")


def bucketed_intervals(spark, sf):
    """J21 by buckets: events within the first hour of each day of January 2024."""
    days = spark.range(30).select((F.lit(1704067200) + F.col("id") * 86400).cast("double").alias("lo"), (F.lit(1704067200) + F.col("id") * 86400 + 3600).cast("double").alias("hi"), "id")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return relational.interval_join(e, days, "t", "lo", "hi", width=7200.0).select("event_id", F.col("id").alias("day"))


def rolling_cost_model(spark, sf):
    """A14"""
    return stats.last_median(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "value").select("user_id", F.round("median", 6).alias("median"))


def energy_estimate(spark, sf):
    """An event's value is its seconds."""
    runs = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("seconds"))
    a = spark.createDataFrame(ASSUMED, "watts double, region string, g_per_kwh double")
    return stats.energy(runs, "seconds", a).select("event_type", "watts", "region", F.round("kwh", 6).alias("kwh"), F.round("g_co2", 4).alias("g_co2"))


def enrich_hypergeom(spark, sf):
    """Suppliers are genes, brands of what they sell are terms; the query are the first tenth."""
    return _enrich(spark, sf, 1.1, None).select("term", "term_size", "overlap", F.round("p_value", 9).alias("p_value"))


def _annotations(spark, sf):
    li, p = table(spark, sf, "lineitem").filter("l_quantity = 50"), table(spark, sf, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("gene"), F.concat_ws("/", "p_brand", "p_type").alias("term"))


def _enrich(spark, sf, fdr, top):
    g = table(spark, sf, "supplier").filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("gene"))
    return stats.enrich(_annotations(spark, sf), g, fdr_max=fdr, top=top)


def enrich_bh(spark, sf):
    """E02, W05"""
    return _enrich(spark, sf, 1.1, None).select("term", F.round("fdr", 9).alias("fdr"))


def label_accuracy_ci(spark, sf):
    """A verdict from the length of a text against the quality label, by source."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    r = d.select("source", F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("verdict"), F.concat_ws(";", F.col("quality").cast("string"), F.when(F.col("toxic") == 1, "0")).alias("labels"), (F.col("doc_id") % 11 == 0).alias("ambiguous"))
    return evaluate.label_accuracy(r, "source").select("source", "n", F.round("accuracy", 6).alias("accuracy"), F.round("half_width", 6).alias("half_width"))


def macro_accuracy(spark, sf):
    """A18"""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", ((F.col("n_chars") > 1000) == (F.col("quality") == 1)).alias("ok"))
    return stats.macro_average(d, "lang", "ok").select("lang", F.round("rate", 6).alias("rate"), "n")


def gate_confusion(spark, sf):
    """E08"""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 1000).alias("v"))
    return evaluate.confusion(d, "lang", "t", "v")


def verdict_changes(spark, sf):
    """E17"""
    d = table(spark, sf, "labels").select("quality", (F.col("doc_id") % 2).cast("int").alias("a"), (F.col("doc_id") % 3 > 0).cast("int").alias("b"))
    return evaluate.changes(d, "quality", "a", "b")


def run_agreement(spark, sf):
    """E11"""
    o = table(spark, sf, "orders")
    a = o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus")
    b = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    r = evaluate.agreement(a, b, "o_orderkey", "o_orderstatus")
    return r.select("n", F.round("agreement", 6).alias("agreement"))


def element_matrix(spark, sf):
    """E18"""
    r = table(spark, sf, "events").select(F.col("user_id").alias("element"), F.col("event_type").alias("condition"), (F.col("value") > 90).alias("present"))
    return evaluate.element_matrix(r, ["click", "error", "purchase"])


def not_done(spark, sf):
    """E18"""
    e = table(spark, sf, "events")
    return evaluate.not_done(e.select("user_id", "event_type").distinct(), e.filter("value > 50"), ["user_id", "event_type"])


def category_shares(spark, sf):
    """A24"""
    p = table(spark, sf, "part").select(F.col("p_type").alias("cluster"), F.col("p_brand").alias("category"))
    return evaluate.category_shares(p).select("cluster", "category", "n", F.col("r").cast("long").alias("r"))


def heat_matrix(spark, sf):
    """A25"""
    p = table(spark, sf, "part").select("p_brand", "p_type", F.lit(1).alias("n"))
    return relational.heat_matrix(p, "p_brand", "p_type", "n", ["ECONOMY", "LARGE", "PROMO"], 12)


def viewer_legend(spark, sf):
    """O12"""
    return package.legend(table(spark, sf, "part").select(F.col("p_brand").alias("category"))).select("category", "n", F.col("colour").cast("long").alias("colour"))


def _nodes(spark, sf):
    """Five suppliers are seeds, customers are nodes clustered by segment."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("cluster"), F.col("c_acctbal").alias("score"), F.lit(False).alias("is_seed"), F.lit(1).alias("hop"))
    s = table(spark, sf, "supplier").orderBy("s_suppkey").limit(5).select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("seed").alias("cluster"), F.lit(0.0).alias("score"), F.lit(True).alias("is_seed"), F.lit(0).alias("hop"))
    return c.unionByName(s)


def node_budget_quota(spark, sf):
    """O05"""
    return package.node_budget(_nodes(spark, sf), 100).select("id", "cluster", "is_seed")


def node_budget_small(spark, sf):
    """O05 with fewer places than three a cluster: the best scores."""
    return package.node_budget(_nodes(spark, sf), 15).select("id", "cluster", "is_seed")


def node_budget_rest(spark, sf):
    """O05 with a floor that leaves small clusters, so that what their quotas leave goes to the largest."""
    n = _nodes(spark, sf).withColumn("cluster", F.when(F.col("cluster").isin("MACHINERY", "HOUSEHOLD") & (F.col("score") < 9500), "BUILDING").otherwise(F.col("cluster")))
    return package.node_budget(n, 61, 0.0, 1).select("id", "cluster", "is_seed")


def hash_sample(spark, sf):
    """R20"""
    return relational.hash_sample(table(spark, sf, "part").select("p_partkey"), "p_partkey", 50)


def weighted_sample(spark, sf):
    """O13"""
    d = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return relational.weighted_order(d, "l_partkey", "n").orderBy(F.desc("draw"), "l_partkey").limit(50).select("l_partkey")


def stage_maxima(spark, sf):
    """A16"""
    order = spark.createDataFrame([("signup",), ("view",), ("never",)], "event_type string")
    r = evaluate.stage_maxima(table(spark, sf, "events"), order, "event_type", ["value"])
    return r.select("event_type", F.coalesce("value", F.lit(-1.0)).alias("value"))


def top_values(spark, sf):
    """A22"""
    return evaluate.top_values(table(spark, sf, "part"), "p_name", 10)


def distinct_counts(spark, sf):
    """A22"""
    return evaluate.distinct_counts(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


def group_sizes(spark, sf):
    """A17"""
    return evaluate.sizes(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


def column_union(spark, sf):
    """U05"""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal")
    u = c.unionByName(s, allowMissingColumns=True)
    return u.select("key", F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.coalesce("s_acctbal", F.lit(0.0)).alias("balance"))


_BOUGHT = "bought AS (SELECT DISTINCT c_mktsegment AS set_name, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
_STAGES = "stages AS (SELECT user_id, event_id, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts), start) AS t0, ts AS t1 FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS start FROM events) WHERE event_type = 'signup')"


def _hyper() -> str:
    ann = "ann AS (SELECT DISTINCT l_suppkey AS gene, concat_ws('/', p_brand, p_type) AS term FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50), q AS (SELECT DISTINCT gene FROM ann WHERE gene IN (SELECT s_suppkey FROM supplier) AND gene % 10 = 3), c AS (SELECT (SELECT count(DISTINCT gene) FROM ann) AS un, (SELECT count(*) FROM q) AS nd), t AS (SELECT term, count(*) AS term_size, count(*) FILTER (WHERE gene IN (SELECT gene FROM q)) AS overlap FROM ann GROUP BY term HAVING count(*) BETWEEN 3 AND 2000 AND count(*) FILTER (WHERE gene IN (SELECT gene FROM q)) >= 2)"
    lf = lambda x: f"lgamma(({x} + 1)::DOUBLE)"
    p = f"p AS (SELECT term, term_size, overlap, least(1.0, (SELECT sum(exp({lf('term_size')} - {lf('x')} - {lf('term_size - x')} + {lf('un - term_size')} - {lf('nd - x')} - {lf('un - term_size - nd + x')} - ({lf('un')} - {lf('nd')} - {lf('un - nd')}))) FROM (SELECT unnest(range(greatest(overlap, nd - (un - term_size)), least(term_size, nd) + 1)) AS x))) AS p FROM t, c)"
    return f"{ann}, {p}, r AS (SELECT *, row_number() OVER (ORDER BY p, term) AS r, count(*) OVER () AS m FROM p), f AS (SELECT *, least(1.0, min(p * m / r) OVER (ORDER BY r DESC)) AS fdr FROM r)"


def _sig(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round({x} * power(10.0, 2 - floor(log10(abs({x}))))) / power(10.0, 2 - floor(log10(abs({x})))) END"


def _budget(cluster: str, budget: int, floor: str = "true") -> str:
    """The same quotas, worked out cluster by cluster in the order of the rule."""
    return f"""WITH c AS (SELECT 'C:' || c_custkey AS id, {cluster} AS cluster, c_acctbal AS score FROM customer WHERE {floor}), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1), q AS (SELECT cluster, n, CASE WHEN (SELECT count(*) FROM n) * 3 <= {budget} THEN least(n, greatest(3, round_even({budget}.0::DOUBLE * n / (SELECT sum(n) FROM n), 0))) ELSE 0 END AS q FROM n),
r AS (SELECT c.*, n, q, row_number() OVER (PARTITION BY c.cluster ORDER BY score DESC, id) AS r FROM c JOIN q USING (cluster)), w AS (SELECT *, CASE WHEN r <= q THEN 0 ELSE 1 END AS late FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY late, CASE WHEN late = 1 AND q > 0 THEN n END DESC, CASE WHEN late = 1 AND q > 0 THEN cluster END, CASE WHEN late = 0 OR q = 0 THEN score END DESC, cluster DESC, r) AS k FROM w)
SELECT id, cluster, false AS is_seed FROM o WHERE k <= {budget} UNION ALL SELECT 'S:' || s_suppkey, 'seed', true FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5)"""


ORACLES = {
    "node_budget_quota": _budget("c_mktsegment", 95, "c_acctbal >= 0"),
    "node_budget_small": _budget("c_mktsegment", 10, "c_acctbal >= 0"),
    "node_budget_rest": _budget("CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') AND c_acctbal < 9500 THEN 'BUILDING' ELSE c_mktsegment END", 56, "c_acctbal >= 0"),
    "stage_maxima": "SELECT t AS event_type, coalesce((SELECT max(value) FROM events WHERE event_type = t), -1.0) AS value FROM (VALUES ('signup'), ('view'), ('never')) v(t)",
    "top_values": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10",
    "distinct_counts": "SELECT count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type, count(DISTINCT p_name) AS p_name, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part)) AS rows FROM part",
    "group_sizes": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
    "column_union": "SELECT c_custkey AS key, c_mktsegment AS segment, 0.0::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, '', s_acctbal FROM supplier",
    "hash_sample": "SELECT p_partkey FROM part ORDER BY md5(p_partkey || ':77'), p_partkey LIMIT 50",
    "weighted_sample": "SELECT l_partkey FROM (SELECT l_partkey, round(pow((('0x' || substr(md5(l_partkey || ':77'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE, 1.0::DOUBLE / (1 + count(*))), 12) AS draw FROM lineitem GROUP BY l_partkey) ORDER BY draw DESC, l_partkey LIMIT 50",
    "presence_matrix": f"WITH {_BOUGHT} SELECT p_partkey AS id, " + ", ".join(f"count(*) FILTER (WHERE set_name = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM part LEFT JOIN bought ON item = p_partkey GROUP BY p_partkey",
    "venn_regions": f"WITH {_BOUGHT} SELECT region, count(*) AS n FROM (SELECT item, string_agg(set_name, '&' ORDER BY set_name) AS region FROM bought WHERE set_name IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') GROUP BY item) GROUP BY region",
    "jaccard_matrix": f"WITH {_BOUGHT}, n AS (SELECT set_name, count(*) AS n FROM bought GROUP BY 1), b AS (SELECT a.set_name, b.set_name AS other, count(*) AS n_both FROM bought a JOIN bought b ON a.item = b.item AND a.set_name < b.set_name GROUP BY 1, 2) SELECT b.set_name, other, n_both, round(n_both / (x.n + y.n - n_both), 6) AS jaccard FROM b JOIN n x ON x.set_name = b.set_name JOIN n y ON y.set_name = b.other",
    "set_coverage": f"WITH {_BOUGHT} SELECT item FROM bought WHERE set_name = 'AUTOMOBILE' EXCEPT SELECT item FROM bought WHERE set_name = 'BUILDING'",
    "first_wins_dedup": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "ordered_collect": "WITH o AS (SELECT o_orderkey AS seq, 'C:' || o_custkey AS kg_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS label, o_orderkey % 5 AS page, o_orderstatus AS mention FROM orders), p AS (SELECT kg_id, page, min(seq) AS s FROM o GROUP BY 1, 2), m AS (SELECT kg_id, mention, min(seq) AS s FROM o GROUP BY 1, 2) SELECT kg_id, arg_min(label, seq) FILTER (WHERE label <> '') AS label, (SELECT string_agg(page::VARCHAR, ';' ORDER BY s) FROM p WHERE p.kg_id = o.kg_id) AS pages, (SELECT string_agg(mention, ';' ORDER BY s) FROM m WHERE m.kg_id = o.kg_id) AS mentions FROM o GROUP BY kg_id",
    "map_max_merge": "SELECT o_orderstatus, o_orderpriority, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2",
    "top_orders": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "rank_within": "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer",
    "numbered_names": "SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '_' || r END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)",
    "custom_order": "SELECT DISTINCT c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS place FROM customer",
    "carried_over": "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000 OR s_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "reconcile_cells": "WITH s AS (SELECT c_custkey, cell, v FROM (SELECT c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer) UNPIVOT INCLUDE NULLS (v FOR cell IN (c_name, c_nationkey, c_mktsegment))), d AS (SELECT c_custkey, cell, v FROM (SELECT c_custkey, c_name, (CASE WHEN c_custkey % 50 = 0 THEN c_nationkey + 1 ELSE c_nationkey END)::VARCHAR AS c_nationkey, CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 97 <> 5) UNPIVOT INCLUDE NULLS (v FOR cell IN (c_name, c_nationkey, c_mktsegment))) SELECT c_custkey, cell, s.v AS source, d.v AS derived FROM s FULL JOIN d USING (c_custkey, cell) WHERE s.v IS DISTINCT FROM d.v",
    "stage_windows": f"WITH {_STAGES} SELECT * FROM stages",
    "stage_peaks": f"WITH {_STAGES} SELECT e.user_id, s.event_id, max(e.value) AS peak, count(*) AS n FROM events e JOIN stages s ON s.user_id = e.user_id AND e.ts BETWEEN s.t0 AND s.t1 WHERE e.event_type <> 'signup' GROUP BY 1, 2",
    "bucketed_intervals": "SELECT event_id, d AS day FROM events, range(30) r(d) WHERE ts BETWEEN TIMESTAMP '2024-01-01' + d * INTERVAL 1 DAY AND TIMESTAMP '2024-01-01 01:00:00' + d * INTERVAL 1 DAY",
    "rolling_cost_model": "SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY user_id",
    "energy_estimate": f"SELECT event_type, watts::DOUBLE AS watts, region, round(sum(value) * watts / 3.6e6, 6) AS kwh, round(sum(value) * watts / 3.6e6 * g, 4) AS g_co2 FROM events, (VALUES {', '.join(str(x) for x in ASSUMED)}) a(watts, region, g) GROUP BY event_type, watts, region, g",
    "enrich_hypergeom": f"WITH {_hyper()} SELECT term, term_size, overlap, round({_sig('p')}, 9) AS p_value FROM f",
    "enrich_bh": f"WITH {_hyper()} SELECT term, round({_sig('fdr')}, 9) AS fdr FROM f",
    "label_accuracy_ci": "SELECT source, count(*) AS n, round(avg(ok::INT), 6) AS accuracy, round(1.96 * sqrt(avg(ok::INT) * (1 - avg(ok::INT)) / count(*)), 6) AS half_width FROM (SELECT source, CASE WHEN n_chars > 1000 THEN quality = 1 ELSE quality = 0 OR toxic = 1 END AS ok FROM documents JOIN labels USING (doc_id) WHERE doc_id % 11 <> 0) GROUP BY source",
    "macro_accuracy": "WITH r AS (SELECT lang, avg(((n_chars > 1000) = (quality = 1))::INT) AS rate, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, round(rate, 6) AS rate, n FROM r UNION ALL SELECT '(macro)', round(avg(rate), 6), sum(n)::BIGINT FROM r",
    "gate_confusion": "SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars > 1000) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars <= 1000) AS fn, count(*) FILTER (WHERE quality <> 1 AND n_chars <= 1000) AS tn FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "verdict_changes": "SELECT count(*) FILTER (WHERE a <> b) AS changed, count(*) FILTER (WHERE a <> quality AND b = quality) AS became_right, count(*) FILTER (WHERE a = quality AND b <> quality) AS became_wrong FROM (SELECT quality, doc_id % 2 AS a, (doc_id % 3 > 0)::INT AS b FROM labels)",
    "run_agreement": "SELECT count(*) AS n, round(avg((o_orderkey % 5 <> 0)::INT), 6) AS agreement FROM orders WHERE o_orderkey % 6 = 0",
    "element_matrix": "SELECT user_id AS element, " + ", ".join(f"coalesce(max((value > 90)::INT) FILTER (WHERE event_type = '{t}'), 0) AS {t}" for t in ("click", "error", "purchase")) + " FROM events GROUP BY user_id",
    "not_done": "SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING max(value) <= 50",
    "category_shares": "SELECT cluster, category, n, r FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) AS r FROM (SELECT p_type AS cluster, p_brand AS category, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r <= 4",
    "heat_matrix": "SELECT p_brand, e AS \"ECONOMY\", l AS \"LARGE\", p AS \"PROMO\", e + l + p AS total FROM (SELECT p_brand, count(*) FILTER (WHERE p_type = 'ECONOMY') AS e, count(*) FILTER (WHERE p_type = 'LARGE') AS l, count(*) FILTER (WHERE p_type = 'PROMO') AS p FROM part GROUP BY 1) WHERE e + l + p >= 25 AND NOT (e >= 12 AND l >= 12 AND p >= 12)",
    "viewer_legend": "SELECT category, n, (row_number() OVER (ORDER BY n DESC, category) - 1) % 34 AS colour FROM (SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1)",
}
QUERIES = {f.__name__: f for f in (presence_matrix, venn_regions, jaccard_matrix, set_coverage, first_wins_dedup, ordered_collect, map_max_merge, top_orders, rank_within, numbered_names, custom_order, carried_over, reconcile_cells, stage_windows, stage_peaks, bucketed_intervals, rolling_cost_model, energy_estimate, enrich_hypergeom, enrich_bh, label_accuracy_ci, macro_accuracy, gate_confusion, verdict_changes, run_agreement, element_matrix, not_done, category_shares, heat_matrix, viewer_legend, node_budget_quota, node_budget_small, node_budget_rest, hash_sample, weighted_sample, stage_maxima, top_values, distinct_counts, group_sizes, column_union)}
