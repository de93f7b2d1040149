"""Readers (S01-S15). Schemas are always stated; nothing is inferred."""

from __future__ import annotations

import io
import json
import os
import re
import urllib.request
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Only the named columns are read."""
    d = spark.read.schema(schema).parquet(path)
    return d.select(*columns) if columns else d


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, malformed: str = "raise", partitions: int | None = None) -> DataFrame:
    """A JSON object a line, plain or gzip; blank lines are skipped. Malformed lines raise or are skipped.
    A gzip file is one task, so its rows are dealt anew if ``partitions`` is given."""
    d = spark.read.schema(schema).option("mode", {"raise": "FAILFAST", "skip": "DROPMALFORMED"}[malformed]).json(path)
    return d.repartition(partitions) if partitions else d


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One document, over several lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_text(spark: SparkSession, path: str) -> dict:
    """A small document (a profile, a configuration) from any store Spark reads, on the driver."""
    return json.loads(spark.read.text(path, wholetext=True).head()[0])


def document(source: str, cache: str, offline: bool = False, fetch: Callable[[str], str] | None = None) -> str:
    """The text behind a URL, kept in the file ``cache``; offline, or when it cannot be fetched, that copy. Without
    one the error says what to do. Any other source is a path."""
    if not source.startswith(("http://", "https://")):
        return Path(source).read_text(encoding="utf-8")
    kept = Path(cache)
    if not offline:
        try:
            text = (fetch or _fetched)(source)
        except OSError:  # no network, or the server refuses
            pass
        else:
            part = kept.with_name(f"{kept.name}.{os.getpid()}.part")
            part.write_text(text, encoding="utf-8")
            os.replace(part, kept)
            return text
    if kept.exists():
        return kept.read_text(encoding="utf-8")
    raise RuntimeError(f"{source} cannot be reached and there is no copy at {cache}: fetch it once, or put the file there")


def _fetched(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
        return r.read().decode("utf-8")


def ontology(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes and slots of a YAML ontology: ``name, parent, mixins, abstract, deprecated, description`` each.
    JSON documents are read without a YAML library, and so is plain YAML of nested maps and lists (``yaml_subset``)."""
    try:
        doc = json.loads(text)
    except ValueError:
        try:
            import yaml

            doc = yaml.safe_load(text)
        except ImportError:
            doc = yaml_subset(text)

    def rows(kind: str) -> list[tuple]:
        return [(n, (v or {}).get("is_a"), list((v or {}).get("mixins") or []), bool((v or {}).get("abstract")), bool((v or {}).get("deprecated")), (v or {}).get("description") or "", (v or {}).get("domain"), (v or {}).get("range"), bool((v or {}).get("symmetric"))) for n, v in (doc.get(kind) or {}).items()]

    schema = "name string, parent string, mixins array<string>, abstract boolean, deprecated boolean, description string, domain string, range string, symmetric boolean"
    return spark.createDataFrame(rows("classes"), schema), spark.createDataFrame(rows("slots"), schema)


def yaml_subset(text: str) -> dict:
    """Maps and lists of plain or quoted scalars by indentation, folded (``>``) and literal (``|``) texts, ``[a, b]`` and
    comments. Anchors, tags and flow maps are errors."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n")]
    lines = [(n, x) for n, x in lines if x and not x.startswith("#") and x != "---"]

    def scalar(v: str):
        if v[:1] in ("&", "*", "!", "{"):
            raise ValueError(f"not in this subset of YAML: {v}")
        if v[:1] in "'\"" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        v = re.split(r"\s#", v)[0].strip()
        if v.startswith("["):
            return [scalar(x.strip()) for x in v[1:-1].split(",") if x.strip()]
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(v.lower(), v)

    def block(i: int, depth: int):
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out: list = []
            while i < len(lines) and lines[i][0] == depth and lines[i][1].startswith("-"):
                out.append(scalar(lines[i][1][1:].strip()))
                i += 1
            return out, i
        held: dict = {}
        while i < len(lines) and lines[i][0] == depth:
            key, _, rest = lines[i][1].partition(":")
            key, rest, i = key.strip().strip("'\""), rest.strip(), i + 1
            if rest[:1] in (">", "|"):
                words = []
                while i < len(lines) and lines[i][0] > depth:
                    words.append(lines[i][1])
                    i += 1
                held[key] = ("\n" if rest[0] == "|" else " ").join(words)
            elif rest and not rest.startswith("#"):
                held[key] = scalar(rest)
            elif i < len(lines) and (lines[i][0] > depth or (lines[i][0] == depth and lines[i][1].startswith("- "))):
                held[key], i = block(i, lines[i][0])
            else:
                held[key] = None
        if i < len(lines) and lines[i][0] > depth:
            raise ValueError(f"unexpected indentation: {lines[i][1]}")
        return held, i

    return block(0, lines[0][0])[0] if lines else {}


def csv(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """Header, every column a string."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)


def sheet(spark: SparkSession, content: bytes, name: str | int = 0) -> DataFrame:
    """A sheet of a workbook, by name or place: the first row names the columns, cells are texts as they stand, empty
    ones null, rows without a first cell are left out. A workbook is small by nature."""
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda path: ElementTree.fromstring(z.read(path))  # noqa: E731, S314
        words = lambda e: "".join(t.text or "" for t in e.iter(f"{main}t"))
        shared = [words(e) for e in tree("xl/sharedStrings.xml").iter(f"{main}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = [(e.get("name"), e.get(f"{rel}id")) for e in tree("xl/workbook.xml").iter(f"{main}sheet")]
        wanted = sheets[name][1] if isinstance(name, int) else dict(sheets)[name]
        target = next(e.get("Target") for e in tree("xl/_rels/workbook.xml.rels") if e.get("Id") == wanted)
        rows = []
        for r in tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(f"{main}row"):
            cells: dict[int, str | None] = {}
            for c in r.iter(f"{main}c"):
                at = 0
                for letter in re.match(r"[A-Z]+", c.get("r"))[0]:
                    at = at * 26 + ord(letter) - 64
                v = c.find(f"{main}v")
                text = words(c) if c.get("t") == "inlineStr" else shared[int(v.text)] if c.get("t") == "s" else v.text if v is not None else None
                cells[at - 1] = text or None
            rows.append(cells)
    if not rows:
        raise ValueError(f"sheet {name} is empty")
    columns = [str(rows[0].get(j) or f"column {j + 1}") for j in range(max(rows[0], default=-1) + 1)]
    body = [tuple(r.get(j) for j in range(len(columns))) for r in rows[1:] if r.get(0)]
    return spark.createDataFrame(body, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def log_metrics(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row a file: the first match of each pattern's group."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    hits = [F.min_by(F.regexp_extract("value", p, 1), F.when(F.col("value").rlike(p), F.struct("block", "n"))).alias(k) for k, p in patterns.items()]
    return lines.groupBy("file").agg(*hits)


def discover(spark: SparkSession, pattern: str) -> DataFrame:
    """Files of a glob, sorted by path; an empty table if there are none."""
    try:
        return spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime").orderBy("path")
    except AnalysisException:
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")


def pages(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files as bytes, for a provider that reads images."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "content")


def page_batches(pages: DataFrame, by: str, order: str, size: int = 4) -> DataFrame:
    """``by, batch, pages``: the pages of a document in order, at most ``size`` to a batch (a structure each)."""
    place = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    rest = F.struct(*[F.col(c) for c in [order, *[c for c in pages.columns if c not in (by, order)]]])
    return pages.withColumn("__n", place).groupBy(by, F.floor(F.col("__n") / size).alias("batch")).agg(F.array_sort(F.collect_list(rest)).alias("pages"))


def with_provider(rows: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Answers of an outside service, taken from a table of responses; null where it has none."""
    return rows.join(responses, keys, "left")


def literal(spark: SparkSession, rows: list[tuple], schema: str, most: int = 100_000) -> DataFrame:
    """A short list as a relation for semi-joins; its size is checked, so it may be broadcast."""
    if len(rows) > most:
        raise ValueError("a list of this size belongs in a table")
    return F.broadcast(spark.createDataFrame(rows, schema))


def edge_counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """Edges a predicate: from stats.json, else from the predicates table, else none."""
    try:
        return {k: int(v) for k, v in json_text(spark, f"{folder}/stats.json")["edges_by_predicate"].items()}
    except (AnalysisException, KeyError, ValueError, TypeError):
        pass
    try:
        return {r["predicate"]: r["n_edges_kept"] for r in spark.read.parquet(f"{folder}/predicates.parquet").collect()}
    except AnalysisException:
        return {}


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether a path can be read as Parquet, in any store Spark reads."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
