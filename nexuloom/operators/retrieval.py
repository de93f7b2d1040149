"""Retrieval, rank fusion, candidates, canonical ids and sampling."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import camel
from ..functions.text import surface_form, tokens, usable_exemplar
from ..staging import stage
from .relational import draw_key, split_join, top_k


#: Query tokens that are sent to all tasks at most.
MOST_ASKED = 100_000


def _scored_batches(asked, k: int, k1: float, b: float, cells_at_once: int = 2_000_000):
    """Batches of ``doc, len, t`` -> ``query, doc, score``: the k best documents of a batch for each query, ties by doc.
    ``asked``: an Arrow table ``query, term, idf, avg_len``."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(asked):
            return
        coded = lambda c: pa.concat_arrays(asked[c].chunks).dictionary_encode("encode")
        query, term = coded("query"), coded("term")
        of, order = term.indices.to_numpy(), np.argsort(term.indices.to_numpy(), kind="stable")
        ptr = np.r_[0, np.cumsum(np.bincount(of, minlength=len(term.dictionary)))]
        to, idf, avg = query.indices.to_numpy()[order], asked["idf"].to_numpy()[order], asked["avg_len"][0].as_py()
        n = len(query.dictionary)
        for whole in batches:
            for lo in range(0, len(whole), max(1, cells_at_once // n)):
                batch = whole.slice(lo, max(1, cells_at_once // n))
                lists, doc = batch.column(2), batch.column(0)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                hit = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=term.dictionary), -1).to_numpy()
                at = np.repeat(np.arange(len(batch)), sizes)[hit >= 0]
                hit = hit[hit >= 0]
                many = ptr[hit + 1] - ptr[hit]
                each = np.repeat(ptr[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                at = np.repeat(at, many)
                length = pc.fill_null(batch.column(1), 0).to_numpy()[at]
                gain = idf[each] * (k1 + 1) / (1 + k1 * (1 - b + b * length / avg))
                score = np.bincount(at * n + to[each], weights=gain, minlength=len(batch) * n).reshape(-1, n)
                least = np.partition(score, len(batch) - k, axis=0)[len(batch) - k] if len(batch) > k else np.zeros(n)
                i, j = np.nonzero((score > 0) & (score >= least - 1e-8))
                value, place = rounded(score[i, j], 9), np.empty(len(batch), np.int64)
                place[pc.sort_indices(doc, null_placement="at_start").to_numpy()] = np.arange(len(batch))
                first = np.lexsort((place[i], -value, j))
                i, j, value = i[first], j[first], value[first]
                edge = np.flatnonzero(np.r_[True, j[1:] != j[:-1]][: len(j)])
                keep = np.arange(len(j)) - np.repeat(edge, np.diff(np.r_[edge, len(j)])) < k
                yield pa.RecordBatch.from_arrays([query.dictionary.take(pa.array(j[keep])), doc.take(pa.array(i[keep])), pa.array(value[keep])], names=["query", "doc", "score"])

    return run


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, most_asked: int = MOST_ASKED) -> DataFrame:
    """``doc, text`` and ``query, text`` -> ``query, doc, score, rank``; scores above 0, ties by doc.

    Tokens are sets, so a term's frequency is 1 wherever it occurs. A negative idf is replaced by epsilon times the
    mean idf. A list of up to ``MOST_ASKED`` query tokens goes to the documents: each batch of them is scored where it is
    read and sends on the k best of each query. A longer one, or ids that several rows have (their scores are added),
    meets postings by an equi-join; only matching postings are scored."""
    t = stage(docs.select("doc", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t")), "tokens", pack=False)  # read three times
    corpus = t.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    postings = t.select("doc", "len", F.explode("t").alias("term"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(corpus))  # one row
    idf = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("raw").alias("mean_idf"))
    idf = idf.join(F.broadcast(mean)).select("term", "avg_len", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    q = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).join(idf, "term")
    q = stage(q.select("query", "term", "idf", "avg_len"), "asked")
    if q.count() <= most_asked and t.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        asked, kinds = q.toArrow().combine_chunks(), {**dict(q.dtypes), **dict(t.dtypes)}
        best = t.select("doc", "len", "t").mapInArrow(_scored_batches(asked, k, k1, b), f"query {kinds['query']}, doc {kinds['doc']}, score double")
        return top_k(best, ["query"], [F.desc("score"), "doc"], k, "rank")
    tf = F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    s = q.join(postings, "term").groupBy("query", "doc").agg(F.sum(tf).alias("score")).filter("score > 0").withColumn("score", F.round("score", 9))
    return top_k(s, ["query"], [F.desc("score"), "doc"], k, "rank")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x)


#: Cells of the vectors at most: their centres go to every task. Vectors of a piece of a cell, and bytes of the queries of a
#: chunk, that one group takes.
MOST_PIVOTS, PIECE, CHUNK_BYTES = 256, 8192, 16 << 20


class Cells:
    """Vectors dealt to the nearest of some of them (pivots), and what that says about distances to a query."""

    def __init__(self, pivots: np.ndarray, stats: list):
        self.pivots, self.apart = pivots, np.sqrt(np.maximum(self.squares(pivots, pivots), 0))
        self.n, self.near, self.far = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
        for cell, n, near, far in stats:
            self.n[cell], self.near[cell], self.far[cell] = n, near, far

    @staticmethod
    def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T

    def to_all(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares(x, self.pivots), 0))

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """For each query the nearest cells that hold ``k`` vectors together (queries x cells)."""
        d = np.where(self.n > 0, d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        held = self.n[order]
        taken = np.zeros(d.shape, bool)
        np.put_along_axis(taken, order, (np.cumsum(held, axis=1) - held < k) & (held > 0), axis=1)
        return taken

    def within(self, d: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Cells that can hold a vector no further than ``reach``: by their shell around the pivot, and by the plane between
        the pivot and the one nearest to the query."""
        reach, own = reach[:, None], d.argmin(axis=1)
        shell = (d - self.far <= reach) & (self.near - d <= reach)
        between = self.apart[own]
        plane = np.divide(d**2 - d.min(axis=1)[:, None] ** 2, 2 * between, out=np.zeros_like(d), where=between > 0)
        return shell & (plane - 1e-6 <= reach) & (self.n > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, most_pivots: int = MOST_PIVOTS, report: dict | None = None) -> DataFrame:
    """Exact nearest neighbours: ``id, embedding`` and ``query, embedding`` -> ``query, id, dist, rank``. Ties by id.

    Vectors are dealt to the cells of pivots (the square root of their number). A query first meets the cells next to it
    that hold k vectors; its k-th distance so far then leaves out cells by the triangle inequality, and vectors in the
    others by their distance to the pivot. Queries meet cells by their number; a cell of very many vectors is cut into pieces,
    very many queries into chunks. A group's distances are bounded by one product of matrices, those that may be among the
    k least are computed exactly, and the k least of the group go on.
    ``report``, if given, gets the numbers of distances computed and of all pairs."""
    held = stage(vectors.select("id", "embedding").filter(F.col("embedding").isNotNull()), "vectors", pack=False)
    n = held.count()
    some = held.select("embedding").orderBy(F.xxhash64("embedding"), "id").limit(min(most_pivots, max(1, int(n**0.5)))).collect()
    width = len(some[0][0]) if some else 0
    pivots = np.unique(np.array([r[0] for r in some], np.float64).reshape(len(some), width), axis=0)
    bare = Cells(pivots, [])

    def assign(batches):
        for b in batches:
            x = np.stack(b["embedding"].to_list()).astype(np.float64)
            cell = bare.squares(x, bare.pivots).argmin(axis=1)
            yield b.assign(cell=cell.astype(np.int32), away=np.sqrt(((x - bare.pivots[cell]) ** 2).sum(axis=1)))

    named = dict(held.dtypes)
    dealt = stage(held.mapInPandas(assign, f"id {named['id']}, embedding {named['embedding']}, cell int, away double"), "vector-cells", pack=False)
    cells = Cells(pivots, [tuple(r) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)), F.min("away"), F.max("away")).collect()])  # a row a pivot
    asked = stage(queries.select("query", F.col("embedding").alias("q")).filter(F.col("q").isNotNull()), "queries")
    kinds = dict(asked.dtypes)

    def visits(second: bool):
        def run(batches):
            for b in batches:
                d = cells.to_all(np.stack(b["q"].to_list()).astype(np.float64))
                take = cells.first(d, k)
                reach = np.full(len(b), np.inf)
                if second:
                    reach = np.where(b["kth"].isna(), np.inf, np.sqrt(b["kth"].fillna(0) + 2e-6) + 1e-6)
                    take = cells.within(d, reach) & ~take
                i, j = np.nonzero(take)
                yield pd.DataFrame({"query": b["query"].to_numpy()[i], "q": b["q"].to_numpy()[i], "near": j.astype(np.int32), "to": d[i, j], "reach": reach[i]})

        return run

    ddl = f"query {kinds['query']}, q {kinds['q']}, near int, to double, reach double"

    pieces = F.element_at(F.array(*[F.lit(int(-(-m // PIECE)) or 1) for m in cells.n]), F.col("near") + 1) if n else F.lit(1)
    chunks = -(-(asked.count() * width * 8) // CHUNK_BYTES) or 1
    keys = ["near", "piece", "chunk"]

    def met(visited):
        own = dealt.withColumnRenamed("cell", "near")
        if report is not None:
            pairs = split_join(own, visited, "near").filter(F.abs(F.col("to") - F.col("away")) <= F.col("reach"))
            report["pairs"] = report.get("pairs", 0) + pairs.count()
        own = own.withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        asking = visited.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        return asking.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(_nearest_of(k), f"query {kinds['query']}, id {named['id']}, dist double")

    if not n:
        return asked.limit(0).select("query", F.lit(None).cast(named["id"]).alias("id"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    one = stage(top_k(met(asked.mapInPandas(visits(False), ddl)), ["query"], ["dist", "id"], k), "nearest")
    kth = one.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("kth")).select(F.col("query").alias("of"), F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    two = met(asked.join(kth, F.col("query") == F.col("of"), "left").drop("of").mapInPandas(visits(True), ddl))
    if report is not None:
        report["all_pairs"] = n * asked.count()
    return top_k(one.unionByName(two), ["query"], ["dist", "id"], k, "rank")


def rounded(v: np.ndarray, digits: int = 6) -> np.ndarray:
    """As Spark's ``round``: half up on the shortest decimal."""
    at = v * 10.0**digits
    out = np.rint(at) / 10.0**digits
    for i in np.flatnonzero((np.abs(at - np.floor(at) - 0.5) < 1e-3) | (v > 1e6)):
        out[i] = float(Decimal(repr(float(v[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _nearest_of(k: int, cells_at_once: int = 2_000_000, pairs_at_once: int = 100_000):
    """Of a group of queries and vectors: for each query its k nearest vectors within its reach, ties by id."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": asked["query"][:0], "id": held["id"][:0], "dist": np.zeros(0)})
        if not len(asked) or not len(held):
            return none
        x, away = np.stack(held["embedding"].to_list()).astype(np.float64), held["away"].to_numpy()
        place = np.unique(held["id"].to_numpy(), return_inverse=True)[1]
        xx, out, step = (x**2).sum(axis=1), [none], max(1, cells_at_once // len(x))
        for lo in range(0, len(asked), step):
            part = asked.iloc[lo : lo + step]
            q, reach = np.stack(part["q"].to_list()).astype(np.float64), part["reach"].to_numpy()
            qq = (q**2).sum(axis=1)
            d = qq[:, None] + xx - 2 * q @ x.T
            slack = 1e-9 * (qq + xx.max()) + 2e-6
            d[~(np.abs(part["to"].to_numpy()[:, None] - away) <= reach[:, None])] = np.inf
            most = np.partition(d, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
            i, j = np.nonzero((d <= np.minimum(most, reach**2)[:, None] + slack[:, None]) & (d < np.inf))
            exact = [np.cumsum((x[j[a : a + pairs_at_once]] - q[i[a : a + pairs_at_once]]) ** 2, axis=1)[:, -1] for a in range(0, len(i), pairs_at_once)]
            dist = rounded(np.concatenate([np.zeros(0), *exact]))
            order = np.lexsort((place[j], dist, i))
            i, j, dist = i[order], j[order], dist[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
            nth = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            keep = nth < k
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[i[keep]], "id": held["id"].to_numpy()[j[keep]], "dist": dist[keep]}))
        return pd.concat(out, ignore_index=True)

    return run


def classes_by_best(hits: DataFrame, k: int) -> DataFrame:
    """``query, class, rank`` of exemplars -> classes in the order of their best exemplar."""
    best = hits.groupBy("query", "class").agg(F.min("rank").alias("best"))
    return top_k(best, ["query"], ["best", "class"], k, "rank").select("query", "class", "rank")


def surface_table(classes: DataFrame, exemplars: DataFrame | None = None) -> DataFrame:
    """``surface, class, order``: names, aliases (``;`` or ``,``), examples (``;``) and exemplars, first entry of a pair wins."""
    pieces = lambda c, p: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), p), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    s = classes.select("class", F.explode(F.concat(F.transform(F.array(F.lower("class")), lambda x: F.struct(x.alias("s"), F.lit(0).alias("o"))), F.transform(pieces(F.col("aliases"), "[;,]"), lambda x: F.struct(x.alias("s"), F.lit(1).alias("o"))), F.transform(pieces(F.col("examples"), ";"), lambda x: F.struct(x.alias("s"), F.lit(2).alias("o"))))).alias("x")).select(F.col("x.s").alias("surface"), "class", F.col("x.o").alias("order"))
    if exemplars is not None:
        s = s.unionByName(exemplars.select(F.lower(F.trim("exemplar")).alias("surface"), "class", F.lit(3).alias("order")))
    return s.groupBy("surface", "class").agg(F.min("order").alias("order"))


def best_by_key(queries: DataFrame, table: DataFrame, key: str, order: list[Column | str], k: int) -> DataFrame:
    """``query`` and ``key`` against the rows of ``table`` with that key -> the first ``k`` in ``order`` of each query, with ``rank``.

    Only a key's first k rows can be among those of a query, so they are found once a key, however many queries have it.
    Queries of one key are dealt to several tasks and put in order where all rows of a query are."""
    rest = [c for c in table.columns if c != key]
    best = stage(top_k(table, [key], order, k).groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("__best")), "best")
    j = split_join(queries.select("query", key), best, key).select("query", "__best").repartition("query")
    return top_k(j.select("query", F.explode("__best").alias("__b")).select("query", "__b.*"), ["query"], order, k, "rank")


def lexical(queries: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Ranked classes of an exact surface match."""
    q = queries.select("query", F.lower(F.trim("text")).alias("surface"))
    return best_by_key(q, table, "surface", ["order", "class"], k).select("query", "class", "rank")


def name_counts(nodes: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """``name_lc, category, n`` over names and synonyms."""
    names = nodes.select(F.lower("name").alias("name_lc"), "category")
    if details is not None:
        names = names.unionByName(details.select("id", F.explode("synonyms").alias("s")).join(nodes.select("id", "category"), "id").select(F.lower("s").alias("name_lc"), "category"))
    return names.filter("name_lc <> ''").groupBy("name_lc", "category").agg(F.count(F.lit(1)).alias("n"))


def by_name(queries: DataFrame, counts: DataFrame, k: int = 5) -> DataFrame:
    """Categories of the nodes of that name, most frequent first."""
    q = queries.select("query", F.lower("text").alias("name_lc"))
    return best_by_key(q, counts, "name_lc", [F.desc("n"), "category"], k).select("query", F.col("category").alias("class"), "n", "rank")


def fuse(legs: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``query, class, leg, rank`` (from 0), ``weight``; ties by leg, rank, class."""
    s = legs.groupBy("query", "class").agg(F.round(F.sum(F.col("weight") / (constant + F.col("rank"))), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return top_k(s, ["query"], [F.desc("score"), "first", "class"], k, "place").select("query", "class", "score", "place")


def decide_candidates(ranked: DataFrame, around: DataFrame, top: int, of_first: int, cap: int) -> DataFrame:
    """``query, class, rank`` (from 1) and ``name, other, kind`` -> the top classes, then the neighbours of the
    first ones in order, each once, at most ``cap``."""
    head = ranked.filter(F.col("rank") <= top).select("query", "class", F.struct(F.lit(0).alias("a"), "rank", F.lit(0).alias("kind"), F.col("class").alias("o")).alias("place"))
    near = ranked.filter(F.col("rank") <= of_first).join(around, F.col("class") == F.col("name")).select("query", F.col("other").alias("class"), F.struct(F.lit(1).alias("a"), "rank", "kind", F.col("other").alias("o")).alias("place"))
    best = head.unionByName(near).groupBy("query", "class").agg(F.min("place").alias("place"))
    return top_k(best, ["query"], ["place"], cap, "rank").select("query", "class", "rank")


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """``term, curie, label, source, list_no, rank`` -> one row a curie; curies of several sources first,
    then by the rank they were first seen at, then by curie."""
    g = candidates.groupBy("term", "curie").agg(F.min_by(F.struct("label", "rank"), F.struct("list_no", "rank")).alias("m"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("list_no", "rank", "source"))), lambda x: x["source"])), "+").alias("source"))
    r = F.row_number().over(W.partitionBy("term").orderBy(F.when(F.col("source").contains("+"), 0).otherwise(1), F.col("m.rank"), "curie")) - 1
    return g.select("term", "curie", F.col("m.label").alias("label"), "source", r.alias("rank"))


def canonicalize(curies: DataFrame, equivalents: DataFrame, nodes: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """``curie`` -> ``canonical_id`` (through its equivalents, else its preferred id's, else itself if a
    node) and the node's name; null if unknown."""
    eq = equivalents.groupBy("curie").agg(F.min("canonical_id").alias("canonical_id"))
    d = curies.select("curie").distinct().join(eq, "curie", "left")
    if preferred is not None:
        p = preferred.groupBy("curie").agg(F.min("preferred").alias("preferred"))
        second = p.join(eq.select(F.col("curie").alias("preferred"), F.col("canonical_id").alias("second")), "preferred", "left").select("curie", "second")
        d = d.join(second, "curie", "left").withColumn("canonical_id", F.coalesce("canonical_id", "second")).drop("second")
    own = nodes.select(F.col("id").alias("curie"), F.lit(True).alias("is_node"))
    d = d.join(own, "curie", "left").withColumn("canonical_id", F.coalesce("canonical_id", F.when(F.col("is_node"), F.col("curie")))).drop("is_node")
    return d.join(nodes.select(F.col("id").alias("canonical_id"), "name"), "canonical_id", "left").select("curie", "canonical_id", "name")


def local_lookup(terms: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Nodes of exactly that name, case blind, the k smallest ids."""
    return top_k(terms.select("term", F.lower("term").alias("key")).join(nodes.withColumn("key", F.lower("name")), "key"), ["term"], ["id"], k, "rank").select("term", "id", "name", "rank")


def typed_passes(terms: DataFrame) -> DataFrame:
    """``term, types`` -> ``term, type, nth``: the class ids of a term's types in order, each once, from 1; empty types
    and NONE are left out."""
    t = terms.select("term", F.explode("types").alias("t")).filter((F.trim("t") != "") & (F.upper(F.trim("t")) != "NONE"))
    t = t.select("term", F.when(F.col("t").startswith("biolink:"), F.col("t")).otherwise(camel(F.col("t"))).alias("type")).distinct()
    return t.withColumn("nth", F.row_number().over(W.partitionBy("term").orderBy("type")))


def once_per(mentions: DataFrame, keys: list[str], provider) -> DataFrame:
    """The provider (a function of a table of distinct keys) is asked once a key; its answer goes to
    every mention."""
    return mentions.join(provider(mentions.select(*keys).distinct()), keys, "left")


def sample_exemplars(nodes: DataFrame, details: DataFrame, target: int, synonyms_a_node: int = 2, seed: int = 7) -> DataFrame:
    """Per class at most ``target`` exemplars: usable names in the order of a seeded digest, then synonyms of the nodes sampled;
    each spelling once. Columns ``class, exemplar, form, id``."""
    h = draw_key("id", seed)
    names = nodes.filter(usable_exemplar(F.col("name"))).select("class", F.col("name").alias("exemplar"), "id", F.lit(0).alias("leg"), h.alias("h"))
    names = names.withColumn("r", F.row_number().over(W.partitionBy("class", F.lower("exemplar")).orderBy("h", "id"))).filter("r = 1").drop("r")
    picked = top_k(names, ["class"], ["h", "id"], target)
    syn = details.select("id", F.explode(F.slice("synonyms", 1, synonyms_a_node)).alias("exemplar")).filter(usable_exemplar(F.col("exemplar"))).join(picked.select("id", "class", "h"), "id").select("class", "exemplar", "id", F.lit(1).alias("leg"), "h")
    both = picked.unionByName(syn).withColumn("r", F.row_number().over(W.partitionBy("class", F.lower("exemplar")).orderBy("leg", "h", "id"))).filter("r = 1").drop("r")
    return top_k(both, ["class"], ["leg", "h", "exemplar"], target).select("class", "exemplar", F.when(F.col("leg") == 1, "variant").otherwise(surface_form(F.col("exemplar"), F.lit(False))).alias("form"), "id")


def gate(terms: DataFrame, verdicts: DataFrame, mode: str, offline: bool = False) -> DataFrame:
    """Which terms exist. ``verdicts``: key, resolver, model (booleans, null if not asked). Offline, the
    resolver is never used: ``nameres`` lets all through and ``union`` becomes ``llm``."""
    if offline:
        mode = {"nameres": "off", "union": "llm"}.get(mode, mode)
    j = terms.withColumn("key", F.lower("term")).join(verdicts, "key", "left")
    by = {"off": F.lit(True), "nameres": F.coalesce("resolver", F.lit(False)), "llm": F.coalesce("model", F.lit(True)), "union": F.coalesce("resolver", F.lit(False)) | F.coalesce("model", F.lit(True))}[mode]
    return j.select("term", by.alias("keep"))
