"""Merkle manifest of a table: a leaf a row, a subroot a group, one root, and a proof for every row.

Within a group (a source) leaves ascend by id; every ``FAN`` consecutive nodes become their digest until one is left, the
subroot; subroots in the order of their groups give the root likewise.

Executors reduce blocks of ``FAN ** HEIGHT`` nodes, each in one task, to a node a block, again and again until at most
``top`` nodes are left; where more groups than that are left, their subroots go on as the nodes of one last tree. The
driver builds the small top tree and broadcasts the end of the proof of each of its nodes; executors put the levels of
their blocks in front of it and fold every row. A block has a bounded number of rows and places come from a range sort
and the counts of its partitions, so no group is one task's work.

Defined cases: a null field is ``-``, an empty one ``0:``; the null group is the first one; a null id comes first; rows
of one id are ordered by their leaves, equal rows are leaves each; a text of any length is one field; an empty table
gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import input_bytes, stage

FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT
#: Nodes that the driver takes at most; bytes of input files for each partition of the range sort.
TOP, SORT_BYTES = 1024, 32 << 20


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def levels(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """The nodes and what every ``FAN`` consecutive ones become, level by level: ``most`` levels, or until one is left."""
    out = [nodes]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def block_levels(nodes: list[str], total: int) -> list[list[str]]:
    """The levels of a block: all of them, or as far as there is more than one node if it is its group's only block."""
    return levels(nodes, HEIGHT if total > BLOCK else None)


def siblings(tree: list[list[str]], at: int) -> list[str]:
    """What stands left and right of a node in its run, level by level."""
    out = []
    for nodes in tree[:-1]:
        lo = at - at % FAN
        out += ["".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + FAN])]
        at //= FAN
    return out


def fold(node: str, path: list[str]) -> str:
    """The root that a node and its siblings give."""
    for left, right in zip(path[::2], path[1::2]):
        node = digest(f"{left}{node}{right}")
    return node


def placed(rows: DataFrame, order: list[str], partitions: int) -> DataFrame:
    """``rows``, which have a group ``g``, with their place ``at`` in it by ``order`` and its size ``total``."""
    ranged = rows.repartitionByRange(partitions, "g", *order).sortWithinPartitions("g", *order)
    ranged = stage(ranged.withColumn("mid", F.monotonically_increasing_id()), "merkle-sorted", pack=False).withColumn("pid", F.shiftright("mid", 33))
    counts = ranged.groupBy("pid", "g").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    w = W.partitionBy("g").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select(F.col("pid").alias("cpid"), F.col("g").alias("cg"), (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("g")).alias("total"))
    j = ranged.join(offsets, (F.col("pid") == F.col("cpid")) & F.col("g").eqNullSafe(F.col("cg")))
    return j.withColumn("at", F.col("mid") + F.col("shift")).drop("mid", "pid", "cpid", "cg", "shift")


def blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """``g, at, total, node`` and carried strings -> a row a block: ``g, block, total`` and arrays in the order of ``at``."""
    columns = ["node", *carried]
    held = nodes.groupBy("g", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("at", *columns))).alias("m"))
    return held.select("g", "block", "total", *[F.col(f"m.{c}").alias(c) for c in columns])


REDUCED = pa.schema([("g", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("node", pa.string())])


def reduced(table: DataFrame) -> DataFrame:
    """A row a block -> its node in the next level, ``g, at, total, node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, at, total, nodes = b.to_pydict().values()
            yield pa.RecordBatch.from_pydict({"g": g, "at": at, "total": [-(-n // BLOCK) for n in total], "node": [block_levels(x, n)[-1][0] for x, n in zip(nodes, total)]}, REDUCED)

    return table.select("g", "block", "total", "node").mapInArrow(run, "g string, at long, total long, node string")


def top_tree(spark: SparkSession, found: list, whole: bool) -> tuple[DataFrame, str | None]:
    """The driver's part: the path above each of the nodes found, ``pg, pat, subroot, path``, and the root. ``whole``: the
    nodes are one tree, that of the subroots."""
    groups: dict[str | None, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["g"] is not None, (r["g"] or "").encode(), r["at"])):
        groups.setdefault(r["g"], []).append(r["node"])
    trees = {g: levels(nodes) for g, nodes in groups.items()}
    over = levels([t[-1][0] for t in trees.values()]) if trees else [[None]]
    rows = [(g, at, None if whole else t[-1][0], siblings(t, at) + siblings(over, k)) for k, (g, t) in enumerate(trees.items()) for at in range(len(t[0]))]
    return F.broadcast(spark.createDataFrame(rows, "pg string, pat long, subroot string, path array<string>")), over[-1][0]


def extended(table: DataFrame, paths: DataFrame, finish: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """What ``finish(g, place, member, subroot, path)`` makes of each member of the blocks, with its path up to the root."""
    carried = [c for c in table.columns if c not in ("g", "block", "total", "node")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                tree, out = block_levels(r["node"], r["total"]), []
                for k, member in enumerate(zip(r["node"], *[r[c] for c in carried])):
                    out.append(finish(r["g"], r["block"] * BLOCK + k, member, r["subroot"], siblings(tree, k) + r["path"]))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    joined = table.join(paths, F.col("g").eqNullSafe(F.col("pg")) & (F.col("block") == F.col("pat"))).drop("pg", "pat")
    return joined.mapInArrow(run, ddl)


PATHS = pa.schema([("pg", pa.string()), ("pat", pa.int64()), ("subroot", pa.string()), ("path", pa.list_(pa.string()))])


def prove(nodes: DataFrame, carried: list[str], finish: Callable, schema: pa.Schema, ddl: str, partitions: int, top: int = TOP) -> DataFrame:
    """``g, at, total, node`` and carried strings -> ``finish(root)(g, place, member, subroot, path)`` for every node."""
    spark, whole = nodes.sparkSession, False
    table = stage(blocks(nodes, carried), "merkle-blocks")
    tables = [(table, whole)]
    while table.count() > top:  # a row is a block, so a node of the next level
        up = reduced(table)
        if table.filter(F.col("total") > BLOCK).isEmpty():  # a subroot each: they are one tree from here on
            subroots = up.select(F.lit(None).cast("string").alias("g"), "node", F.col("g").alias("name"))
            whole, table = True, blocks(placed(subroots, ["name"], partitions), ["name"])
        else:
            table = blocks(up, [])
        table = stage(table, "merkle-blocks")
        tables.append((table, whole))
    paths, root = top_tree(spark, reduced(table).collect(), whole)  # at most ``top`` rows
    for table, of_subroots in reversed(tables[1:]):
        named = "name" in table.columns

        def one_up(g, at, member, subroot, path, named=named):
            return (member[1], 0, member[0], path) if named else (g, at, subroot, path)

        paths = stage(extended(table, paths, one_up, PATHS, "pg string, pat long, subroot string, path array<string>"), "merkle-paths")
    return extended(tables[0][0], paths, finish(root), schema, ddl)


PROOF = pa.schema([("doc_id", pa.string()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def _proved(root: str) -> Callable:
    def finish(g, at, member, subroot, path):
        node, key, tampered = member
        folded = fold(tampered or node, path)
        return key, node, subroot, root, digest("".join(path)), folded, folded == root

    return finish


def manifest(docs: DataFrame, fields: list[str], group: str, key: str, tampered: dict[str, Column] | None = None, when: Column | None = None, top: int = TOP) -> DataFrame:
    """``doc_id`` (the key), ``leaf, subroot, root, proof_sha256, folded_root, verified`` for every row. ``tampered`` gives
    other values of some fields for rows where ``when`` holds; what is folded is then the leaf of those."""
    other = leaf(*[(tampered or {}).get(c, F.col(c)) for c in fields])
    spoilt = F.when(F.coalesce(when, F.lit(False)), other) if when is not None else F.lit(None).cast("string")
    leaves = stage(docs.select(F.col(group).cast("string").alias("g"), F.col(key).cast("long").alias("id"), leaf(*map(F.col, fields)).alias("node"), spoilt.alias("tampered")), "merkle-leaves")
    partitions = max(2 * docs.sparkSession.sparkContext.defaultParallelism, input_bytes(leaves) // SORT_BYTES)
    nodes = placed(leaves, ["id", "node"], partitions).withColumn("key", F.col("id").cast("string"))
    proofs = prove(nodes, ["key", "tampered"], _proved, PROOF, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", partitions, top)
    return proofs.withColumn("doc_id", F.col("doc_id").cast("long"))
