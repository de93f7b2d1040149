"""Reading and writing: every source and sink over files made of the driver tables in the shared folder."""

from __future__ import annotations

import json
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, services, writers
from ..staging import new_path
from .kg import table

LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def _text(df: DataFrame, label: str) -> str:
    """Lines of a one-column table as text files of the shared folder; returns the folder."""
    path = new_path(df.sparkSession, label)
    df.write.text(path)
    return path


def scan_all(spark: SparkSession, sf: str) -> DataFrame:
    """S01"""
    d = readers.parquet(spark, f"{sf}/lineitem.parquet", LINE)
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def scan_columns(spark, sf):
    """S02"""
    d = readers.parquet(spark, f"{sf}/lineitem.parquet", LINE, ["l_suppkey", "l_quantity"])
    return d.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"))


def jsonl_lines(spark, sf):
    """An object a line, blank lines between."""
    c = table(spark, sf, "customer").select(F.concat(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")), F.when(F.col("c_custkey") % 3 == 0, "\n\n").otherwise("")).alias("value"))
    return readers.jsonl(spark, _text(c, "jsonl"), "c_custkey long, c_name string, c_acctbal double")


def jsonl_broken(spark, sf):
    """Lines that are no objects are skipped."""
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 7 == 2, "{broken").otherwise(F.to_json(F.struct("c_custkey", "c_name"))).alias("value"))
    return readers.jsonl(spark, _text(c, "jsonl"), "c_custkey long, c_name string", "skip")


def json_documents(spark, sf):
    """One document of nested lists over several lines."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("nations")).agg(F.array_sort(F.collect_list(F.struct("r_name", "nations"))).alias("regions"))
    path = _text(one.select(F.replace(F.to_json(F.struct("regions")), F.lit(","), F.lit(",\n")).alias("value")), "document")
    d = readers.json_document(spark, path, "regions array<struct<r_name string, nations array<string>>>")
    return d.select(F.explode("regions").alias("r")).select("r.r_name", F.explode("r.nations").alias("n_name"))


def _model(spark, sf) -> str:
    """Regions and nations as the classes of an ontology, in the common form of YAML."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "n_nationkey").orderBy("n_nationkey").collect()  # 25 nations
    out = ["# classes", "classes:", "  thing:", "    description: >-", "      what there is,", "      in short"]
    out += [x for r in sorted({r["r_name"] for r in rows}) for x in (f"  {r}:", "    is_a: thing", "    abstract: true")]
    for r in rows:
        out += [f"  {r['n_name']}:", f"    is_a: {r['r_name']}", f"    description: \"nation {r['n_nationkey']}\"", "    mixins:", "      - place", f"      - group {r['n_nationkey'] % 3}"]
    return "\n".join([*out, "slots:", "  borders:", "    symmetric: true", "    domain: thing"])


def ontology_classes(spark, sf):
    """S06"""
    classes, slots = readers.ontology(spark, _model(spark, sf))
    s = slots.select("name", F.lit("").alias("parent"), F.lit("").alias("mixins"), F.lit(False).alias("abstract"), F.coalesce("domain", F.lit("")).alias("description"), "symmetric")
    return classes.select("name", F.coalesce("parent", F.lit("")).alias("parent"), F.array_join("mixins", "+").alias("mixins"), "abstract", "description", F.lit(False).alias("symmetric")).unionByName(s)


def csv_round_trip(spark, sf):
    """Written with rounding and joined lists, read as texts."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg((F.max("o_totalprice") + 0.001).alias("price"), F.array_sort(F.collect_set("o_orderstatus")).alias("states"), F.lit('a "b", c').alias("note"))
    path = new_path(spark, "csv")
    writers.export_csv(o, path, 2)
    d = readers.csv(spark, path, ["o_custkey", "price", "states", "note"])
    return d.select(F.col("o_custkey").cast("long").alias("o_custkey"), F.col("price").cast("double").alias("price"), "states", "note")


def workbook_sheets(spark, sf):
    """Two sheets of one workbook, with empty cells and rows without a first cell."""
    n = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 6 != 5, F.col("n_name")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).alias("region"))
    book = writers.workbook({"regions": table(spark, sf, "region").select("r_name", "r_regionkey"), "nations & more": n})
    a, b = readers.sheet(spark, book), readers.sheet(spark, book, "nations & more")
    return a.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")).unionByName(b).select("name", F.coalesce("region", F.lit("(empty)")).alias("region"))


def log_first_matches(spark, sf):
    """A log of one line an order state, in the order of the state; the first match of each marker counts."""
    o = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    path = _text(o.orderBy("o_orderstatus").coalesce(1).select(F.concat_ws(" ", F.lit("state"), "o_orderstatus", F.lit("took"), F.col("n").cast("string"), F.lit("rows, last"), F.col("last").cast("string")).alias("value")), "log")
    d = readers.log_metrics(spark, path, {"state": r"state (\w)", "n": r"took (\d+) rows", "p_last": r"state P .* last (\d+)", "missing": r"error (\d+)"})
    return d.select("state", "n", "p_last", F.coalesce("missing", F.lit("")).alias("missing"))


def discover_runs(spark, sf):
    """Result files below run folders, sorted by path; folders without one are no runs."""
    root = new_path(spark, "runs")
    table(spark, sf, "region").select("r_name", F.concat(F.lit("run of "), "r_name").alias("value")).write.partitionBy("r_name").text(root)
    d = readers.discover(spark, f"{root}/*/part-*")
    return d.select(F.regexp_extract("path", "r_name=([^/]+)/", 1).alias("run"), "length")


def file_digests(spark, sf):
    """Digests of the files of a result, for its manifest."""
    root = new_path(spark, "parts")
    table(spark, sf, "region").select("r_name", F.concat(F.lit("run of "), "r_name").alias("value")).write.partitionBy("r_name").text(root)
    return writers.digests(spark, f"{root}/*/part-*").select(F.regexp_extract("path", "r_name=([^/]+)/", 1).alias("run"), "length", "sha256")


def page_batches(spark, sf):
    """The pages of each host in batches of four."""
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id")
    b = readers.page_batches(p, "host", "page_id")
    return b.select("host", "batch", F.array_join(F.transform("pages", lambda x: x["page_id"].cast("string")), ",").alias("pages"))


def provider_answers(spark, sf):
    """What a service answers for each name; null where it does not."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("term")).distinct()
    replies = table(spark, sf, "part").filter("p_size > 30").groupBy(F.col("p_name").alias("term")).agg(F.min("p_brand").alias("answer"))
    return readers.with_provider(names, replies, ["term"]).select("term", F.coalesce("answer", F.lit("(none)")).alias("answer"))


def _spelt(question: str) -> str | None:
    """A service that cannot be reached for names from a to g and has no answer from h to m."""
    if question[:1] < "h":
        raise OSError(question)
    return question.upper() if question[:1] > "m" else None


def service_answers(spark, sf):
    """The name of every part, each name asked once, by calls from the tasks."""
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("prompt"))
    answers = services.Service(_spelt, new_path(spark, "replies"), wait=0.0)(names)
    return answers.select("key", F.coalesce("reply", F.lit("(none)")).alias("reply"))


def literal_list(spark, sf):
    """A list of parameters as a relation."""
    wanted = readers.literal(spark, [("1-URGENT", 2), ("5-LOW", 1), ("unheard of", 9)], "o_orderpriority string, weight int")
    return table(spark, sf, "orders").join(wanted, "o_orderpriority").groupBy("o_orderpriority", "weight").agg(F.count(F.lit(1)).alias("n"))


def _counts(spark, sf, stats: bool):
    root = new_path(spark, "counts")
    p = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("predicate")).agg(F.count(F.lit(1)).alias("n_edges_kept"))
    p.write.parquet(f"{root}/predicates.parquet")
    if stats:
        p.agg(F.map_from_entries(F.collect_list(F.struct("predicate", F.col("n_edges_kept") + 1000000))).alias("edges_by_predicate")).select(F.to_json(F.struct("edges_by_predicate")).alias("value")).write.text(f"{root}/stats.json")
    return spark.createDataFrame(sorted(readers.edge_counts(spark, root).items()) or [("", 0)], "predicate string, n long")


def edge_counts_stats(spark, sf):
    """Counts from the statistics file, where there is one."""
    return _counts(spark, sf, True)


def edge_counts_table(spark, sf):
    """Else from the table of predicates."""
    return _counts(spark, sf, False)


def parquet_round_trip(spark, sf):
    """Files and row groups of bounded length."""
    path = new_path(spark, "written")
    writers.parquet(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, 400, 2)
    d = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    per = d.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy(F.lit("all").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price")).join(per.agg((F.max("n") <= 800).alias("bounded")))


def json_export(spark, sf):
    """K05"""
    path = new_path(spark, "json")
    writers.export_json(table(spark, sf, "supplier"), path)
    return spark.read.schema("s_suppkey long, s_name string, s_nationkey int, s_acctbal double").json(path)


def graphml_export(spark, sf):
    """Nations and regions as a graph, read back from the file's text."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("N<"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")).unionByName(table(spark, sf, "region").select(F.concat(F.lit("R&"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name")))
    e = table(spark, sf, "nation").select(F.concat(F.lit("N<"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("R&"), F.col("n_regionkey").cast("string")).alias("target"), F.lit("part_of").alias("predicate"))
    tag = "{http://graphml.graphdrawing.org/xmlns}"
    root = ElementTree.fromstring(writers.graphml_text(n, e))  # noqa: S314
    rows = [("node", x.get("id"), x.find(f"{tag}data").text) for x in root.iter(f"{tag}node")] + [("edge", f"{x.get('source')}-{x.get('target')}", x.find(f"{tag}data").text) for x in root.iter(f"{tag}edge")]
    return spark.createDataFrame(rows, "kind string, id string, value string")


def report_tables(spark, sf):
    """A report in Markdown and its lines as HTML."""
    from ..functions import text

    report = writers.report("Regions", {"all": table(spark, sf, "region").orderBy("r_regionkey")})
    lines = [x for x in report.split("\n") if x]
    html = text.markdown_html(report.split("|")[0])
    return spark.createDataFrame([(i, x) for i, x in enumerate([*lines, *html.split("\n")])], "line int, value string")


def profile_layouts(spark, sf):
    """Three layouts of a profile, read from documents and merged."""
    from ..operators import profile

    n = {r["n_name"]: r["n_nationkey"] / 50 for r in table(spark, sf, "nation").collect()}  # 25 nations
    one = profile.from_json(json.dumps({"name": "map", "predicates": n, "directionality": {"mode": "on", "inverse_factor": 0.25}}))
    two = profile.from_json(json.dumps({k: 0.5 - v for k, v in n.items()} | {"name": "flat", "directionality": "off"}))
    three = profile.from_json(json.dumps({"name": "branches", "branch_weights": n, "sources": {"x": 1}}))
    both = profile.merge([one, two, three])
    rows = [("predicate", k, round(v, 6)) for k, v in both.predicates.items()] + [("branch", k, round(v, 6)) for k, v in both.branches.items()] + [("source", k, v) for k, v in both.sources.items()] + [("factor", both.mode, both.inverse_factor)]
    return spark.createDataFrame(rows, "kind string, name string, weight double")


_RUNS = "SELECT r_name AS run, length('run of ' || r_name) + 1 AS length{} FROM region"
_NATIONS = "SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey"
ORACLES = {
    "scan_all": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2",
    "scan_columns": "SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
    "jsonl_lines": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "jsonl_broken": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 2",
    "json_documents": "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "ontology_classes": f"SELECT n_name AS name, r_name AS parent, 'place+group ' || (n_nationkey % 3) AS mixins, false AS abstract, 'nation ' || n_nationkey AS description, false AS symmetric FROM ({_NATIONS}) UNION ALL SELECT DISTINCT r_name, 'thing', '', true, '', false FROM ({_NATIONS}) UNION ALL SELECT 'thing', '', '', false, 'what there is, in short', false UNION ALL SELECT 'borders', '', '', false, 'thing', true",
    "csv_round_trip": "SELECT o_custkey, max(o_totalprice) AS price, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS states, 'a \"b\", c' AS note FROM orders GROUP BY 1",
    "workbook_sheets": "SELECT r_name AS name, r_regionkey::VARCHAR AS region FROM region UNION ALL SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE '(empty)' END FROM nation WHERE n_nationkey % 6 <> 5",
    "log_first_matches": "SELECT min(o_orderstatus) AS state, (SELECT count(*)::VARCHAR FROM orders WHERE o_orderstatus = (SELECT min(o_orderstatus) FROM orders)) AS n, (SELECT max(o_orderkey)::VARCHAR FROM orders WHERE o_orderstatus = 'P') AS p_last, '' AS missing FROM orders",
    "discover_runs": _RUNS.format(""),
    "file_digests": _RUNS.format(", sha256('run of ' || r_name || chr(10)) AS sha256"),
    "page_batches": "SELECT host, (n // 4) AS batch, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS pages FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS n FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id FROM pages)) GROUP BY 1, 2",
    "service_answers": "SELECT p_partkey AS key, CASE WHEN substr(p_name, 1, 1) > 'm' THEN upper(p_name) ELSE '(none)' END AS reply FROM part",
    "provider_answers": "SELECT p_name AS term, coalesce(min(p_brand) FILTER (WHERE p_size > 30), '(none)') AS answer FROM part GROUP BY 1",
    "literal_list": "SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 2 ELSE 1 END AS weight, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1",
    "edge_counts_stats": "SELECT o_orderstatus AS predicate, count(*) + 1000000 AS n FROM orders GROUP BY 1",
    "edge_counts_table": "SELECT o_orderstatus AS predicate, count(*) AS n FROM orders GROUP BY 1",
    "parquet_round_trip": "SELECT 'all' AS what, count(*) AS n, round(sum(o_totalprice), 2) AS price, true AS bounded FROM orders",
    "json_export": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "graphml_export": "SELECT 'node' AS kind, 'N<' || n_nationkey AS id, n_name AS value FROM nation UNION ALL SELECT 'node', 'R&' || r_regionkey, r_name FROM region UNION ALL SELECT 'edge', 'N<' || n_nationkey || '-R&' || n_regionkey, 'part_of' FROM nation",
    "report_tables": "WITH l AS (SELECT 0 AS o, '# Regions' AS value UNION ALL SELECT 1, '## all' UNION ALL SELECT 2, '| r_regionkey | r_name |' UNION ALL SELECT 3, '|---|---|' UNION ALL SELECT 4 + r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region UNION ALL SELECT 1000, '<h1>Regions</h1>' UNION ALL SELECT 1001, '<h2>all</h2>') SELECT row_number() OVER (ORDER BY o) - 1 AS line, value FROM l",
    "profile_layouts": "SELECT 'predicate' AS kind, n_name AS name, round(greatest(n_nationkey / 50, 0.5::DOUBLE - n_nationkey / 50), 6) AS weight FROM nation UNION ALL SELECT 'branch', n_name, round(n_nationkey / 50, 6) FROM nation UNION ALL SELECT 'source', 'x', 1.0 UNION ALL SELECT 'factor', 'off', 1.0",
}
QUERIES = {f.__name__: f for f in (scan_all, scan_columns, jsonl_lines, jsonl_broken, json_documents, ontology_classes, csv_round_trip, workbook_sheets, log_first_matches, discover_runs, file_digests, page_batches, provider_answers, service_answers, literal_list, edge_counts_stats, edge_counts_table, parquet_round_trip, json_export, graphml_export, report_tables, profile_layouts)}
