"""Terms, tools, decisions and the scoring of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import resolve_terms
from ..functions import stats, text
from ..operators import agent, evaluate, relational, retrieval

from .kg import table
from .search import _docs


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


def piped_replies(spark, sf):
    """Replies that list terms between pipes."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" | "), F.col("o_orderstatus"), F.lit("||  "), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("|x y ")).otherwise("")).alias("reply"))
    return o.select("o_orderkey", F.array_join(text.piped_terms(F.col("reply")), ";").alias("terms"))


def fallback_terms(spark, sf):
    """N03 on whole documents."""
    return _docs(spark, sf).select("doc", F.size(text.fallback_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


def usable_candidates(spark, sf):
    """Candidates of which some are numbers, too short or spelt again."""
    c = F.array(F.col("p_name"), F.upper("p_name"), F.col("p_partkey").cast("string"), F.col("p_brand"), F.lit("x"), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), F.lit("12-3"), F.lower("p_type"))
    return _part(spark, sf).select("p_partkey", F.array_join(text.usable_terms(c), ";").alias("terms"))


def review_decisions(spark, sf):
    """Decisions of a reviewer on part names by brand; nobody decided on the rest."""
    m = _part(spark, sf).select(F.col("p_name").alias("text"), F.col("p_brand").alias("type"), "p_partkey")
    d = _part(spark, sf).groupBy(F.col("p_name").alias("text"), F.col("p_brand").alias("type")).agg(F.min("p_partkey").alias("k")).filter("k % 3 > 0").select("text", "type", F.when(F.col("k") % 3 == 1, " Drop").otherwise("LOCAL").alias("send"))
    return relational.review(m, d).select("p_partkey", "send")


def row_kinds(spark, sf):
    """Curation status and kind of rows."""
    note = F.when(F.col("p_size") % 5 == 0, "Adversarial: x").when(F.col("p_size") % 5 == 1, "creative").when(F.col("p_size") % 5 == 2, None).otherwise("seen")
    status = F.when(F.col("p_partkey") % 7 == 0, " Deleted ").when(F.col("p_partkey") % 7 == 1, "drop").when(F.col("p_partkey") % 7 == 2, None).otherwise("kept")
    return _part(spark, sf).select("p_partkey", evaluate.included(status).alias("included"), evaluate.row_kind(F.when(F.col("p_size") % 11 > 0, F.col("p_name")), note).alias("kind"))


def cognates(spark, sf):
    """Names of parts whose words are in a line of words, or begin as they do."""
    heard = F.split(F.concat_ws(" ", F.lower("p_type"), F.lit("widgeteers smalls ringing bolt gearbox"), F.lower("p_brand")), " ")
    return _part(spark, sf).select("p_partkey", relational.cognate_match(F.array(F.lower("p_name"), F.lower("p_type")), heard).alias("type_too"), relational.cognate_match(F.array(F.lower("p_name")), heard).alias("heard"))


def overlapping_boxes(spark, sf):
    """Boxes laid out by key that overlap their neighbours."""
    k = F.col("p_partkey")
    b = _part(spark, sf).select(k.alias("id"), ((k % 40) * 10.0).alias("x0"), ((k % 40) * 10.0 + F.col("p_size") / 4).alias("x1"), (F.floor(k / 40) * 10.0).alias("y0"), (F.floor(k / 40) * 10.0 + 10.25).alias("y1"))
    return relational.overlapping_boxes(b, 25.0)


def natural_pages(spark, sf):
    """Numbers kept as texts, the first ones in their natural order."""
    return evaluate.natural_order(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("page")), "page").limit(120)


def _nation_pairs(spark, sf):
    """Nations as candidates of a segment, most customers first."""
    n = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("term"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return retrieval.top_k(n, ["term"], [F.desc("n"), "name"], 6, "rank")


def gloss_menu(spark, sf):
    """A numbered menu of glosses."""
    k = F.regexp_extract("name", r"(\d+)", 1).cast("int")
    description = F.when(k % 4 == 0, "// a note").when(k % 4 == 1, F.repeat(F.concat(F.col("name"), F.lit(" ")), 40)).when(k % 4 == 2, F.lit("")).otherwise(F.concat(F.lit("the "), F.col("name")))
    rows = _nation_pairs(spark, sf).select("term", "rank", F.concat_ws(" - ", "name", text.gloss(description, F.array(*[F.concat(F.lit(x), k.cast("string")) for x in "abcde"]))).alias("line"))
    return text.numbered_menu(rows, "term", "rank", F.col("line")).select("term", F.col("menu"))


def parent_menu(spark, sf):
    """Nations stand under an earlier nation of their region, if that one is a candidate."""
    c = _nation_pairs(spark, sf)
    first = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    up = table(spark, sf, "nation").join(first, "n_regionkey").select(F.col("n_name").alias("name"), F.when(F.col("k") != F.col("n_nationkey"), F.concat(F.lit("NATION_"), F.col("k").cast("string"))).alias("parent"))
    return text.grouped_menu(c.join(up, "name").select("term", "name", "parent", "rank"))


def tool_calls(spark, sf):
    """Arguments in quotes, with names and brackets, too long or of no class."""
    k = F.col("p_partkey")
    call = F.when(k % 5 == 0, F.concat(F.lit(" class_name = 'nation_"), (k % 30).cast("string"), F.lit("' "))).when(k % 5 == 1, F.concat(F.lit("TNF ("), F.col("p_name"), F.lit(")"))).when(k % 5 == 2, F.repeat("p_name", 60)).when(k % 5 == 3, F.lit(" '' ")).otherwise(F.concat(F.lit('x="'), F.col("p_name"), F.lit('"')))
    tool = F.when(k % 5 == 0, "get_class_hierarchy").when(k % 2 == 0, "lookup_exact_term").when(k % 3 == 0, "no_tool").otherwise("semantic_context_search")
    c = text.checked_arguments(_part(spark, sf).select("p_partkey", tool.alias("tool"), call.alias("argument")), table(spark, sf, "nation").select(F.col("n_name").alias("name")))
    return c.select("p_partkey", "ok", F.md5("clean").alias("clean"), F.substring("message", 1, 7).alias("message"))


def unknown_terms(spark, sf):
    """Terms that a reply calls unknown, of those asked for."""
    reply = F.concat(F.lit("These: "), F.to_json(F.array(F.upper("p_name"), F.lit("never asked"), F.col("p_brand"))), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(" I think"))
    return _part(spark, sf).select("p_partkey", F.array_join(text.unknown_list(F.when(F.col("p_partkey") % 6 == 5, "no list").otherwise(reply), F.array(F.col("p_name"), F.col("p_type"))), ";").alias("unknown"))


def asked_once(spark, sf):
    """One question a distinct text and type, its answer on every mention."""
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mention"), F.col("o_orderstatus").alias("text"), F.col("o_orderpriority").alias("type"))
    seen = retrieval.once_per(m, ["text", "type"], lambda keys: keys.groupBy("text", "type").agg(F.count(F.lit(1)).alias("times")).withColumn("answer", F.concat_ws("/", F.lower("text"), "type")))
    return seen.groupBy("answer", "times").agg(F.count(F.lit(1)).alias("n"))


def prompts(spark, sf):
    """N14"""
    return _part(spark, sf).select("p_partkey", text.prompt("Is {term} a {type}? Size {size}. {none}", term=F.col("p_name"), type=F.col("p_type"), size=F.col("p_size"), none=F.lit(None).cast("string")).alias("prompt"))


def _classes(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"))


def _reply(k):
    """A model that knows the nations: it answers in one of five ways."""
    n = F.concat(F.lit("NATION_"), (k % 30).cast("string"))
    return F.when(k % 5 == 0, F.concat(F.lit("FINAL_VERDICT: nation "), (k % 30).cast("string"))).when(k % 5 == 1, F.concat(F.lit("I would say "), n, F.lit("."))).when(k % 5 == 2, "FINAL_VERDICT: none").when(k % 5 == 3, "FINAL_VERDICT: NATION_77").otherwise("no idea")


def decisions(spark, sf):
    """One decision a name of a customer among two to four nations."""
    k = F.col("c_custkey")
    at = lambda i: F.concat(F.lit("NATION_"), ((k + i) % 30).cast("string"))
    t = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 4 == 3, F.lower("c_name")).otherwise(F.col("c_name")).alias("term"), F.lit("a sentence").alias("sentence"), F.when(k % 13 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(at(0), at(1))).otherwise(F.array(at(5), at(0), at(2), at(1))).alias("candidates"))
    model = lambda q: q.select("key", _reply(F.regexp_extract("prompt", r"#(\d+)", 1).cast("long")).alias("reply"))
    return agent.decide(t, _classes(spark, sf), model, "{term} in {sentence}: {candidates}?").select("id", F.coalesce("class_name", F.lit("(no verdict)")).alias("class_name"))


def lookup_rounds(spark, sf):
    """Rounds of lookups: parts whose key is known after one, two or no lookups, or only when asked to close."""
    k = F.regexp_extract("prompt", r"(?i)term (\d+)", 1).cast("long")
    seen = F.regexp_count("prompt", F.lit("OBSERVATION"))
    closing = F.col("prompt").contains("Only the verdict now")
    say = F.concat(F.lit("FINAL_VERDICT: NATION_"), (k % 25).cast("string"))
    look = F.concat(F.lit("THOUGHT ACTION: lookup_exact_term('key "), (k % 7).cast("string"), F.lit("')"))
    model = lambda q: q.select("key", F.when(closing, F.when(k % 6 == 4, "none").otherwise(say)).when(k % 6 == 0, say).when(k % 6 == 1, F.when(F.col("prompt").contains("answer of"), say).otherwise(look)).when(k % 6 == 2, F.when(seen < 2, F.when(seen == 0, "FINAL_VERDICT: nothing known").otherwise(look)).otherwise(say)).when(k % 6 == 3, look).when(k % 6 == 4, "I give up").otherwise(F.when(seen == 0, "ACTION: fly(away)").otherwise("FINAL_VERDICT: none")).alias("reply"))
    t = _part(spark, sf).select(F.concat(F.lit("Term "), F.col("p_partkey").cast("string")).alias("term"), F.col("p_name").alias("sentence"))
    known = table(spark, sf, "region").select(F.concat(F.lit("key "), F.col("r_regionkey").cast("string")).alias("argument"), F.concat(F.lit("answer of "), F.col("r_name")).alias("answer")).unionByName(spark.createDataFrame([("key 5", "answer of 5"), ("key 6", "answer of 6")], "argument string, answer string"))
    return agent.episodes(t, _classes(spark, sf), model, {"lookup_exact_term": known}, "{term}? {sentence}", 3).select("term", F.coalesce("class_name", F.lit("(no verdict)")).alias("class_name"), F.col("steps").cast("long").alias("steps"), "hard")


def resolver(spark, sf):
    """Two services and a pass of the first for each type; private terms are local only."""
    p = _part(spark, sf)
    m = p.select(F.col("p_name").alias("term"), F.array(F.lower("p_type"), F.when(F.col("p_size") == 50, "NONE").when(F.col("p_size") == 49, "").otherwise("thing")).alias("types")).unionByName(spark.createDataFrame([("small ring 12.03.1999", ["gene"]), ("a cohort of rings", ["Cohort"])], "term string, types array<string>"))
    names = p.select(F.col("p_name").alias("term"), "p_brand", "p_type", "p_partkey").distinct()
    one = lambda t: t.join(names.groupBy("term").agg(F.min("p_brand").alias("b")), "term").select("term", F.concat(F.lit("B:"), F.col("b")).alias("curie"), F.col("b").alias("label"), F.lit("one").alias("source"), F.lit(0).alias("rank"))
    two = lambda t: t.join(names.groupBy("term").agg(F.max("p_brand").alias("b")), "term").select("term", F.concat(F.lit("B:"), F.col("b")).alias("curie"), F.col("b").alias("label"), F.lit("two").alias("source"), F.lit(1).alias("rank"))
    of_type = lambda t: t.join(names.groupBy("term", "p_type").agg(F.min("p_brand").alias("b")), "term").filter(F.col("type") == F.concat(F.lit("biolink:"), F.initcap("p_type"))).select("term", "type", F.concat(F.lit("B:"), F.col("b")).alias("curie"), F.col("b").alias("label"), F.lit("one").alias("source"), F.lit(2).alias("rank"))
    nodes = p.select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name")).filter("id LIKE 'P:1%'").unionByName(spark.createDataFrame([("P:x", "A COHORT of rings")], "id string, name string"))
    equal = p.select(F.concat(F.lit("B:"), F.col("p_brand")).alias("curie"), F.lit("P:1").alias("canonical_id")).distinct()
    return resolve_terms(m, [one, two], equal, nodes, 3, of_type).select("term", "curie", "label", "source", F.col("rank").cast("long").alias("rank"), F.coalesce("canonical_id", F.lit("")).alias("canonical_id"))


def adversarial_rates(spark, sf):
    """Rates over labelled documents: toxic ones typed by length, linked by source."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    r = evaluate.adversarial_rates(d.select((F.col("n_chars") > 1000).alias("typed"), ((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("linked")))
    return r.select("n", F.round("typed_rate", 6).alias("typed_rate"), F.round("linked_rate", 6).alias("linked_rate"))


def deck_scores(spark, sf):
    """Flags of terms and the distance of the class they were given."""
    k = F.col("p_partkey")
    t = _part(spark, sf).select((k % 2 == 0).alias("read_exact"), (k % 5 > 0).alias("read_lenient"), (k % 3 > 0).alias("extracted"), F.when(k % 7 > 0, k % 4).alias("dist"))
    r = evaluate.deck_scores(t)
    return r.select("n", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


def report_tabs(spark, sf):
    """Tabs of which one fails, and a nested report laid flat."""
    good = lambda name: (lambda: evaluate.sizes(_part(spark, sf), [name]).count())
    t = evaluate.tabs({"brands": good("p_brand"), "types": good("p_type"), "broken": good("no such column")})
    flat = evaluate.flatten(_part(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.struct(F.min("p_size").alias("low"), F.max("p_size").alias("high")).alias("size")))
    rows = [(k, v if isinstance(v, int) else -1) for k, v in t.items()]
    f = flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("long").alias("value")) for c in flat.columns])).alias("x")).select("x.*")
    return spark.createDataFrame(rows, "name string, value long").unionByName(f)


def cost_model(spark, sf):
    """An estimate for each order, and the seconds a page that its run gives."""
    pages, profiles, took = F.col("o_orderkey") % 9, F.col("o_custkey") % 4, F.col("o_totalprice") / 10
    return table(spark, sf, "orders").select("o_orderkey", stats.cost_estimate(pages, profiles).alias("estimate"), F.round(stats.page_cost(took, pages, profiles * 90.0), 6).alias("page"))


def annotation_sources(spark, sf):
    """Annotations from the table of terms where it is there, else from the edges."""
    from ..api import annotations
    from ..staging import new_path

    a, b = new_path(spark, "kg"), new_path(spark, "kg")
    p = table(spark, sf, "part")
    edges = p.select(F.concat(F.lit("NCBIGene:"), F.col("p_partkey").cast("string")).alias("subject"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("X:"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("GO:"), F.col("p_size").cast("string"))).alias("object"), (F.col("p_size") % 2).cast("int").alias("predicate_code"), F.lit("").alias("primary_knowledge_source"), F.lit("").alias("knowledge_level"))
    for root in (a, b):
        edges.write.parquet(f"{root}/edges.parquet")
        spark.createDataFrame([(0, "even"), (1, "odd")], "predicate_code int, predicate string").write.parquet(f"{root}/predicates.parquet")
    p.select(F.concat(F.lit("g"), F.col("p_size").cast("string")).alias("gene"), F.col("p_brand").alias("go"), F.lit("x").alias("predicate")).distinct().write.parquet(f"{a}/gene_go.parquet")
    return annotations(spark, a).withColumn("from", F.lit("table")).unionByName(annotations(spark, b).withColumn("from", F.lit("edges")))


_CAND = "c AS (SELECT term, name, rank FROM (SELECT c_mktsegment AS term, 'NATION_' || c_nationkey AS name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, 'NATION_' || c_nationkey) AS rank FROM customer GROUP BY c_mktsegment, c_nationkey) WHERE rank <= 6)"
_GLOSS = "substr(CASE WHEN k % 4 = 1 THEN repeat(name || ' ', 40) WHEN k % 4 = 3 THEN 'the ' || name ELSE 'a' || k || '; b' || k || '; c' || k || '; d' || k END, 1, 180)"
_WITHIN = "list_contains(h, w) OR (length(w) >= 5 AND len(list_filter(h, lambda t: length(t) >= 5 AND t[1:5] = w[1:5])) > 0)"
ORACLES = {
    "piped_replies": "SELECT o_orderkey, o_orderstatus || ';' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ';x y' ELSE '' END AS terms FROM orders",
    "fallback_terms": r"SELECT doc_id AS doc, len(list_filter(regexp_extract_all(coalesce(text, ''), '\p{L}[\p{L}\p{N}-]*'), lambda t: length(t) > 2)) AS n FROM documents",
    "usable_candidates": "SELECT p_partkey, concat_ws(';', p_name, p_brand, p_type) AS terms FROM part",
    "review_decisions": "WITH k AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS k FROM part) SELECT p_partkey, CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'local' END AS send FROM k WHERE k % 3 <> 1",
    "row_kinds": "SELECT p_partkey, p_partkey % 7 > 1 AS included, CASE WHEN p_size % 11 = 0 THEN 'blank' WHEN p_size % 5 = 0 THEN 'adversarial' WHEN p_size % 5 = 1 THEN 'creative' ELSE 'gold' END AS kind FROM part",
    "cognates": f"WITH p AS (SELECT p_partkey, lower(p_type) AS t, string_split(lower(p_name), ' ') AS n, string_split(lower(p_type) || ' widgeteers smalls ringing bolt gearbox ' || lower(p_brand), ' ') AS h FROM part) SELECT p_partkey, true AS type_too, len(list_filter(n, lambda w: NOT ({_WITHIN}))) = 0 AS heard FROM p",
    "overlapping_boxes": "WITH b AS (SELECT p_partkey AS id, (p_partkey % 40) * 10.0::DOUBLE AS x0, (p_partkey % 40) * 10.0::DOUBLE + p_size / 4 AS x1, (p_partkey // 40) * 10.0::DOUBLE AS y0 FROM part) SELECT a.id, b.id AS o_id FROM b a JOIN b ON a.id < b.id AND a.x0 + 0.5 < b.x1 AND b.x0 + 0.5 < a.x1 AND a.y0 + 0.5 < b.y0 + 10.25 AND b.y0 + 0.5 < a.y0 + 10.25",
    "natural_pages": "SELECT o_orderkey::VARCHAR AS page FROM orders ORDER BY o_orderkey LIMIT 120",
    "gloss_menu": f"WITH {_CAND} SELECT term, string_agg(rank || '. ' || name || ' - ' || {_GLOSS}, chr(10) ORDER BY rank) AS menu FROM (SELECT *, regexp_extract(name, '[0-9]+')::INT AS k FROM c) GROUP BY term",
    "parent_menu": f"WITH {_CAND}, u AS (SELECT n_name AS name, 'NATION_' || min(n_nationkey) OVER (PARTITION BY n_regionkey) AS parent FROM nation), j AS (SELECT c.term, c.name, c.rank, p.rank AS pr FROM c JOIN u ON u.name = c.name LEFT JOIN c p ON p.term = c.term AND p.name = u.parent AND u.parent <> c.name) SELECT term, string_agg(CASE WHEN pr IS NULL THEN '' ELSE '  ' END || name, chr(10) ORDER BY coalesce(pr, rank), pr IS NOT NULL, rank) AS menu FROM j GROUP BY term",
    "tool_calls": "WITH c AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'nation_' || (p_partkey % 30) WHEN 1 THEN 'TNF (' || p_name || ')' WHEN 2 THEN repeat(p_name, 60) WHEN 3 THEN '' ELSE p_name END AS a FROM part), m AS (SELECT *, CASE WHEN length(a) NOT BETWEEN 1 AND 300 THEN 'Empty o' WHEN k % 5 = 0 THEN CASE WHEN k % 30 < 25 THEN '' ELSE 'Unknown' END WHEN k % 2 = 0 THEN '' WHEN k % 3 = 0 THEN 'Unknown' ELSE '' END AS m FROM c) SELECT k AS p_partkey, m = '' AS ok, md5(CASE WHEN m = '' AND k % 5 = 0 THEN upper(a) ELSE a END) AS clean, m AS message FROM m",
    "unknown_terms": "SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN '' ELSE upper(p_name) END AS unknown FROM part",
    "asked_once": "SELECT lower(o_orderstatus) || '/' || o_orderpriority AS answer, 1::BIGINT AS times, count(*) AS n FROM orders GROUP BY 1",
    "prompts": "SELECT p_partkey, 'Is ' || p_name || ' a ' || p_type || '? Size ' || p_size || '. ' AS prompt FROM part",
    "decisions": "SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN '(no verdict)' WHEN c_custkey % 5 = 2 THEN 'NONE' WHEN c_custkey % 5 = 0 AND c_custkey % 30 < 25 THEN 'NATION_' || (c_custkey % 30) WHEN c_custkey % 5 = 1 THEN x ELSE '(no verdict)' END AS class_name FROM (SELECT c_custkey, (SELECT arg_min(name, (-length(name), i)) FROM (SELECT unnest(l) AS name, generate_subscripts(l, 1) AS i FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN ['NATION_' || (c_custkey % 30), 'NATION_' || ((c_custkey + 1) % 30)] ELSE ['NATION_' || ((c_custkey + 5) % 30), 'NATION_' || (c_custkey % 30), 'NATION_' || ((c_custkey + 2) % 30), 'NATION_' || ((c_custkey + 1) % 30)] END AS l)) WHERE contains('I would say NATION_' || (c_custkey % 30) || '.', name)) AS x FROM customer)",
    "lookup_rounds": "SELECT 'term ' || p_partkey AS term, CASE p_partkey % 6 WHEN 4 THEN '(no verdict)' WHEN 5 THEN 'NONE' ELSE 'NATION_' || (p_partkey % 25) END AS class_name, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 2 END::BIGINT AS steps, p_partkey % 6 IN (2, 3, 4) AS hard FROM part",
    "resolver": "WITH n AS (SELECT p_name AS term, min(p_brand) AS lo, max(p_brand) AS hi FROM part GROUP BY 1), t AS (SELECT p_name AS term, p_type, min(p_brand) AS b FROM part GROUP BY 1, 2), l AS (SELECT term, id AS curie, term AS label, 'local' AS source, 0 AS list_no, row_number() OVER (PARTITION BY term ORDER BY id) - 1 AS rank FROM (SELECT p_name AS term, 'P:' || p_partkey AS id FROM part WHERE ('P:' || p_partkey) LIKE 'P:1%')), a AS (SELECT term, curie, label, source, list_no, rank FROM l WHERE rank < 3 UNION ALL SELECT term, 'B:' || lo, lo, 'one', 1, 0 FROM n UNION ALL SELECT term, 'B:' || hi, hi, 'two', 2, 1 FROM n UNION ALL SELECT term, 'B:' || b, b, 'one', 2 + row_number() OVER (PARTITION BY term ORDER BY 'biolink:' || p_type), 2 FROM t UNION ALL SELECT 'a cohort of rings', 'P:x', 'A COHORT of rings', 'local', 0, 0), g AS (SELECT term, curie, arg_min(label, (list_no, rank)) AS label, arg_min(rank, (list_no, rank)) AS fr, list_distinct(list(source ORDER BY list_no, rank, source)) AS ss, (SELECT string_agg(s, '+' ORDER BY o) FROM (SELECT source AS s, min((list_no, rank, source)) AS o FROM a b WHERE b.term = a.term AND b.curie = a.curie GROUP BY source)) AS source FROM a GROUP BY term, curie), r AS (SELECT term, curie, label, source, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN contains(source, '+') THEN 0 ELSE 1 END, fr, curie) - 1 AS rank FROM g) SELECT term, curie, label, source, rank, CASE WHEN curie LIKE 'B:%' THEN 'P:1' ELSE curie END AS canonical_id FROM r WHERE rank < 3",
    "adversarial_rates": "SELECT count(*) AS n, round(avg((n_chars > 1000)::INT), 6) AS typed_rate, round(avg((toxic = 1 AND quality = 0)::INT), 6) AS linked_rate FROM documents JOIN labels USING (doc_id)",
    "deck_scores": "SELECT count(*) AS n, round(avg((k % 2 = 0)::INT), 6) AS read_exact, round(avg((k % 5 > 0)::INT), 6) AS read_lenient, round(avg((k % 3 > 0)::INT), 6) AS extracted, round(avg(CASE WHEN k % 3 > 0 THEN (k % 7 > 0 AND k % 4 = 0)::INT END), 6) AS typed_exact, round(avg(CASE WHEN k % 3 > 0 THEN (k % 7 > 0 AND k % 4 <= 1)::INT END), 6) AS typed_near FROM (SELECT p_partkey AS k FROM part)",
    "report_tabs": "SELECT 'brands' AS name, count(DISTINCT p_brand) AS value FROM part UNION ALL SELECT 'types', count(DISTINCT p_type) FROM part UNION ALL SELECT 'broken', -1 UNION ALL SELECT 'n', count(*) FROM part UNION ALL SELECT 'size.low', min(p_size) FROM part UNION ALL SELECT 'size.high', max(p_size) FROM part",
    "cost_model": "SELECT o_orderkey, 60.0::DOUBLE + p * 720.0::DOUBLE + q * 90.0::DOUBLE AS estimate, round(greatest(30.0::DOUBLE, (o_totalprice / 10 - q * 90.0::DOUBLE - 60) / greatest(p, 1)), 6) AS page FROM (SELECT *, o_orderkey % 9 AS p, o_custkey % 4 AS q FROM orders)",
    "annotation_sources": "SELECT DISTINCT 'g' || p_size AS gene, p_brand AS term, 'table' AS \"from\" FROM part UNION ALL SELECT 'NCBIGene:' || p_partkey, 'GO:' || p_size, 'edges' FROM part WHERE p_size % 3 <> 0",
}
QUERIES = {f.__name__: f for f in (piped_replies, fallback_terms, usable_candidates, review_decisions, row_kinds, cognates, overlapping_boxes, natural_pages, gloss_menu, parent_menu, tool_calls, unknown_terms, asked_once, prompts, decisions, lookup_rounds, resolver, adversarial_rates, deck_scores, report_tabs, cost_model, annotation_sources)}
