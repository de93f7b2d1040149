"""Graph metrics and paths on kept graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import stage


def components(edges: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """``node, component`` (the smallest node id reached), by minimum labels with pointer jumping.

    Per round every node takes the least label around it and then the label of its label, so the rounds grow with the
    logarithm of the diameter."""
    pairs = stage(edges.select(F.explode(F.array(F.struct(F.col("subject").alias("a"), F.col("object").alias("b")), F.struct(F.col("object").alias("a"), F.col("subject").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct(), "pairs")
    label = stage(nodes.select("node", F.col("node").alias("component")).distinct(), "label")
    for _ in range(most):
        around = pairs.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        low = label.join(around, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("low"))
        up = label.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = stage(low.join(up, F.col("low") == F.col("n2"), "left").select("node", "old", F.least("low", F.coalesce("c2", "low")).alias("component")), "label")
        moved = new.filter("component <> old").limit(1).count()
        label = new.select("node", "component")
        if not moved:
            return label
    raise RuntimeError(f"components did not settle in {most} rounds")


def seed_pairs(component: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs of seeds connected, of all pairs, in closed form (no pair is made)."""
    n = component.join(seeds.select(F.col("seed").alias("node")), "node", "left_semi").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    t = n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("connected"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    return t.select("connected", F.expr("all * (all - 1) div 2").alias("pairs"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``a, b``: every edge in either direction once, without self-loops, staged."""
    return stage(edges.select(F.explode(F.array(F.struct(F.col("subject").alias("a"), F.col("object").alias("b")), F.struct(F.col("object").alias("a"), F.col("subject").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct(), "pairs")


def distances(edges: DataFrame, sources: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``source, node, dist`` by breadth first from all sources at once over undirected edges.

    A long holds 64 sources as bits: a round joins the nodes reached last with their neighbours and takes one OR a node
    and long, whatever the number of sources that reach it. Rounds end when no bit is new."""
    pairs = both_ways(edges) if pairs is None else pairs
    numbered = stage(sources.select("source").distinct().withColumn("n", F.monotonically_increasing_id()), "sources").select("source", F.shiftright("n", 6).alias("word"), F.col("n").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    one = F.expr("shiftleft(1L, bit)")
    last = seen = stage(numbered.groupBy(F.col("source").alias("node"), "word").agg(F.bit_or(one).alias("bits")), "reached")
    rounds = [last.withColumn("dist", F.lit(0))]
    while True:
        step = last.join(pairs, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        before = seen.select(F.col("node").alias("n"), F.col("word").alias("w"), F.col("bits").alias("old"))
        joined = step.join(before, (F.col("node") == F.col("n")) & (F.col("word") == F.col("w")), "left")
        last = stage(joined.select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0"), "reached")
        if last.isEmpty():
            break
        rounds.append(last.withColumn("dist", F.lit(len(rounds))))
        seen = stage(seen.unionByName(last).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "seen")
    found = reduce(DataFrame.unionByName, rounds)
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    each = found.select("node", F.col("word").alias("w"), "dist", F.explode(set_bits).alias("i"))
    return each.join(numbered, (F.col("w") == F.col("word")) & (F.col("i") == F.col("bit"))).select("source", "node", "dist")


def diameter(component: DataFrame, edges: DataFrame, at_once: int = 64) -> DataFrame:
    """Longest shortest path of the largest component (smallest label on ties).

    A search from v bounds the eccentricity of every node u: at least max(d, ecc(v) - d) and at most ecc(v) + d. Nodes
    whose upper bound is no more than the longest distance seen so far go; 64 of the others, those of the highest upper
    and the lowest lower bounds, are searched from at once, until none is left. So a few searches do, on any size."""
    spark = component.sparkSession
    big = component.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    pairs, longest = both_ways(edges), None
    members = stage(component.join(big, "component", "left_semi").select("node", F.lit(0).alias("low"), F.lit((1 << 31) - 1).alias("up")).distinct(), "members")
    while not members.isEmpty():
        picked = members.orderBy(F.desc("up"), "node").limit(at_once // 2).unionByName(members.orderBy("low", F.desc("node")).limit(at_once // 2)).select(F.col("node").alias("source")).distinct()
        d = stage(distances(edges, stage(picked, "picked"), pairs), "distances")
        ecc = d.groupBy("source").agg(F.max("dist").alias("ecc"))
        longest = max(longest or 0, ecc.agg(F.max("ecc")).head()[0])
        bounds = d.join(F.broadcast(ecc), "source").groupBy("node").agg(F.max(F.greatest("dist", F.col("ecc") - F.col("dist"))).alias("l"), F.min(F.col("ecc") + F.col("dist")).alias("u"))
        members = stage(members.join(bounds, "node").select("node", F.greatest("low", "l").alias("low"), F.least("up", "u").alias("up")).filter(F.col("up") > longest), "members")
    return spark.createDataFrame([(longest,)], "diameter int")


def vocabulary_expansion(kept: DataFrame, seeds: DataFrame) -> DataFrame:
    """G27"""
    k, s = kept.agg(F.count(F.lit(1)).alias("k")), seeds.agg(F.count(F.lit(1)).alias("s"))
    return k.join(s).select(F.round((F.col("k") + F.col("s")) / F.greatest("s", F.lit(1)), 2).alias("vocabulary_expansion"))


def simple_graph(edges: DataFrame, *more: str) -> DataFrame:
    """The heaviest of parallel edges in either direction, without self-loops; ties by predicate, direction and the
    other columns named in ``more``, which are kept."""
    e = edges.filter("subject <> object").withColumn("a", F.least("subject", "object")).withColumn("b", F.greatest("subject", "object"))
    kept = ["weight", "predicate", "subject", "object", *more]
    best = e.groupBy("a", "b").agg(F.max(F.struct(*kept)).alias("m"))
    return best.select("a", "b", *[f"m.{c}" for c in kept])


def path_cost(simple: DataFrame, degree: DataFrame) -> DataFrame:
    """-ln(weight), at least 1e-6, plus half the penalty ln(log2(2 + degree)) of either end."""
    d = degree.select("node", F.log(F.log2(2 + F.col("degree"))).alias("pen"))
    j = simple.join(d.select(F.col("node").alias("a"), F.col("pen").alias("pa")), "a", "left").join(d.select(F.col("node").alias("b"), F.col("pen").alias("pb")), "b", "left")
    return j.withColumn("cost", -F.log(F.greatest("weight", F.lit(1e-6))) + (F.coalesce("pa", F.lit(0.0)) + F.coalesce("pb", F.lit(0.0))) / 2).drop("pa", "pb")


def cheapest_paths(cost: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """``node, dist, path`` of the cheapest way from any source (ties by path), within so many hops or, without a
    limit, until nothing gets cheaper; relaxation of the rows improved last, each round staged."""
    pairs = stage(arcs(cost), "cost")
    best = last = stage(sources.select("node", F.lit(0.0).alias("dist"), F.array("node").alias("path")), "best")
    done = 0
    while hops is None or done < hops:
        step = last.join(pairs, F.col("node") == F.col("from")).select(F.col("to").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.concat("path", F.array("to")).alias("path"))
        both = best.withColumn("old", F.lit(0)).unionByName(step.withColumn("old", F.lit(1)))
        merged = stage(both.groupBy("node").agg(F.min(F.struct("dist", "old", "path")).alias("m")).select("node", "m.*"), "best")
        last = merged.filter("old = 1").drop("old")
        best = merged.drop("old")
        done += 1
        if last.isEmpty():
            break
    return best


def arcs(cost: DataFrame) -> DataFrame:
    """``from, to, cost``: each edge of ``a, b, cost`` in either direction."""
    return cost.select(F.explode(F.array(F.struct(F.col("a").alias("from"), F.col("b").alias("to"), "cost"), F.struct(F.col("b").alias("from"), F.col("a").alias("to"), "cost"))).alias("x")).select("x.*")


def set_path(cost: DataFrame, sources: DataFrame, targets: DataFrame) -> tuple[float, list[str]] | None:
    """Cost and nodes of the cheapest way from one set of nodes to another over ``a, b, cost`` (no cost is negative);
    None if there is none. With a cost of 1 it is the way of fewest steps.

    Both sets send out labels (a node, its cost and the node it was reached from). Half the best cost so far is as
    far as either side has to go: on the best way the two sides have met by then. Ways are rebuilt from the
    meeting node by the parents; they are not carried along. Ties go to the smaller meeting node and parent."""
    links = stage(arcs(cost), "arcs")
    start = lambda d: stage(d.select("node").distinct().select("node", F.lit(0.0).alias("dist"), F.lit(None).cast("string").alias("parent")), "labels")
    labels = [start(sources), start(targets)]
    fresh, best = list(labels), None

    def meet():
        other = labels[1].select(F.col("node").alias("n"), F.col("dist").alias("d"))
        return labels[0].join(other, F.col("node") == F.col("n")).agg(F.min(F.struct((F.col("dist") + F.col("d")).alias("cost"), "node"))).head()[0]

    while True:
        best, moved = meet(), False
        for side in (0, 1):
            near = fresh[side] if best is None else fresh[side].filter(F.col("dist") <= best["cost"] / 2)
            step = near.join(links, F.col("node") == F.col("from")).groupBy(F.col("to").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("cost")).alias("dist"), F.col("from").alias("parent"))).alias("m")).select("node", "m.*")
            old = labels[side].select(F.col("node").alias("n"), F.col("dist").alias("d"))
            fresh[side] = stage(step.join(old, F.col("node") == F.col("n"), "left").filter(F.col("d").isNull() | (F.col("dist") < F.col("d"))).select("node", "dist", "parent"), "labels-new")
            if not fresh[side].isEmpty():
                moved = True
                labels[side] = stage(labels[side].join(fresh[side].select("node"), "node", "left_anti").unionByName(fresh[side]), "labels")
        if not moved:
            break
    if best is None:
        return None
    ways = []
    for side in (0, 1):
        way, at = [], best["node"]
        while at is not None:  # a step of one way a lookup
            way.append(at)
            at = labels[side].filter(F.col("node") == at).head()["parent"]
        ways.append(way)
    return best["cost"], ways[0][::-1] + ways[1][1:]


def annotated(simple: DataFrame, way: list[str]) -> DataFrame:
    """``step, node`` of a way and, from the second node on, the edge that leads there: ``predicate, source, level,
    weight`` and whether it is stored in that direction (``forward``)."""
    spark = simple.sparkSession
    steps = spark.createDataFrame([(k, n, way[k - 1] if k else None) for k, n in enumerate(way)], "step int, node string, before string")
    j = F.broadcast(steps).join(simple, (F.least("before", "node") == F.col("a")) & (F.greatest("before", "node") == F.col("b")) & F.col("before").isNotNull(), "left")
    return j.select("step", "node", "predicate", "source", "level", F.round("weight", 4).alias("weight"), (F.col("subject") == F.col("before")).alias("forward"))


def path_edges(paths: DataFrame, simple: DataFrame) -> DataFrame:
    """``path_id, step, subject, object, predicate, forward``: a path's steps with the direction they are stored in."""
    steps = paths.select("path_id", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS x, path[i] AS y))")).alias("step", "s")).select("path_id", "step", "s.x", "s.y")
    j = steps.join(simple, (F.least("x", "y") == F.col("a")) & (F.greatest("x", "y") == F.col("b")))
    return j.select("path_id", "step", "subject", "object", "predicate", (F.col("x") == F.col("subject")).alias("forward"))


def presence_matrix(members: DataFrame, ids: DataFrame, graphs: list[str]) -> DataFrame:
    """``id`` by graph, 1 where the graph holds it. ``members``: graph, node."""
    return ids.join(members, F.col("id") == F.col("node"), "left").groupBy("id").pivot("graph", graphs).agg(F.count("node")).fillna(0)


def rank_within(nodes: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Rank and size within a group."""
    return nodes.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.col(order).desc(), F.col(key)))).withColumn("size", F.count(F.lit(1)).over(W.partitionBy(group)))


def signature_recovery(ranked: DataFrame, patterns: DataFrame) -> DataFrame:
    """Best place of each pattern (a substring, or ``=name`` exactly); patterns are a short list."""
    hit = F.when(F.col("pattern").startswith("="), F.lower("name") == F.lower(F.expr("substring(pattern, 2)"))).otherwise(F.lower("name").contains(F.lower("pattern")))
    if patterns.count() > 1000:
        raise ValueError("patterns are a short list: each is looked for in every name")
    found = ranked.join(F.broadcast(patterns), hit).select("pattern", "name", "rank", "size")
    j = patterns.select("pattern").distinct().join(found, "pattern", "left")
    return j.groupBy("pattern").agg(F.min_by(F.struct("name", "rank", "size"), F.struct(F.col("rank") / F.col("size"), F.col("name"))).alias("m")).select("pattern", "m.*", (F.col("m.rank") / F.col("m.size")).alias("share"))
