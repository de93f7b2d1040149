"""Writers (K01-K09)."""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a row group of the large tables: fixed values.
EDGE_ROWS, NODE_ROWS = 1_000_000, 500_000


def parquet(d: DataFrame, path: str, rows_a_group: int = EDGE_ROWS, groups_a_file: int = 8, mode: str = "overwrite") -> None:
    """Zstd, row groups and files of bounded length."""
    out = d.write.mode(mode).option("compression", "zstd").option("parquet.block.row.count.limit", rows_a_group)
    out.option("maxRecordsPerFile", rows_a_group * groups_a_file).parquet(path)


def export_csv(d: DataFrame, path: str, digits: int = 6) -> None:
    """Doubles rounded, lists joined with ``;``."""
    cols = []
    for name, kind in d.dtypes:
        c = F.col(f"`{name}`")
        cols.append((F.round(c, digits) if kind == "double" else F.concat_ws(";", c) if kind.startswith("array") else c).alias(name))
    d.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(d: DataFrame, path: str) -> None:
    d.write.mode("overwrite").json(path)


def replace_json(value: object, path: str) -> None:
    """A small document on the driver, replaced as a whole."""
    tmp = f"{path}.{os.getpid()}.part"
    Path(tmp).write_text(json.dumps(value, ensure_ascii=False, indent=1))
    os.replace(tmp, path)


def _bounded(d: DataFrame, most: int) -> list:
    rows = d.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: this export is for kept graphs")
    return rows


def graphml(nodes: DataFrame, edges: DataFrame, path: str, most: int = 200_000) -> None:
    """A kept graph as a GraphML file on the driver."""
    Path(path).write_text(graphml_text(nodes, edges, most))


def graphml_text(nodes: DataFrame, edges: DataFrame, most: int = 200_000) -> str:
    """A kept graph (its size is checked) as GraphML. ``nodes``: id, ...; ``edges``: source, target, ..."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for kind, d in (("node", nodes), ("edge", edges)):
        out += [f'<key id="{kind}_{n}" for="{kind}" attr.name="{escape(n)}" attr.type="string"/>' for n in d.columns if n not in ("id", "source", "target")]
    out.append('<graph edgedefault="directed">')
    q = lambda v: escape(str(v), {'"': "&quot;"})
    data = lambda kind, r, skip: "".join(f'<data key="{kind}_{k}">{q(v)}</data>' for k, v in r.asDict().items() if k not in skip and v is not None)
    out += [f'<node id="{q(r["id"])}">{data("node", r, ("id",))}</node>' for r in _bounded(nodes, most)]
    out += [f'<edge source="{q(r["source"])}" target="{q(r["target"])}">{data("edge", r, ("source", "target"))}</edge>' for r in _bounded(edges, most)]
    return "\n".join([*out, "</graph>", "</graphml>"])


def workbook(tabs: dict[str, DataFrame], most: int = 100_000) -> bytes:
    """A workbook of several sheets (each of a checked length), header first, every cell a text; null cells are left
    out. The bytes are the caller's to store."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head, kind = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "application/vnd.openxmlformats-officedocument.spreadsheetml"
    cell = lambda j, i, v: f'<c r="{column_name(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    line = lambda i, values: f'<row r="{i}">' + "".join(cell(j, i, v) for j, v in enumerate(values) if v is not None) + "</row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(tabs)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(names))) + "</Types>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = [tabs[n].columns, *_bounded(tabs[n], most)]
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>' + "".join(line(k + 1, r) for k, r in enumerate(rows)) + "</sheetData></worksheet>")
    return out.getvalue()


def column_name(j: int) -> str:
    """A, B, ... Z, AA, ..."""
    return (column_name(j // 26 - 1) if j >= 26 else "") + chr(65 + j % 26)


def report(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """Markdown tables of short results."""
    out = [f"# {title}"]
    for name, d in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(d.columns) + " |", "|" + "---|" * len(d.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in _bounded(d, most)]
    return "\n".join(out)


def archive(folder: str, path: str) -> dict[str, str]:
    """A ZIP of a folder with a manifest of SHA-256 digests, which is returned."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file())
    manifest = {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in files}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, p.relative_to(folder))
        z.writestr("manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    return manifest


def digests(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, length, sha256`` of the files of a glob, in any store, read where they lie."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))
