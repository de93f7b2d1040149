"""Class and predicate hierarchies and the weights derived from them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import camel
from ..staging import grow
from .profile import REPRESENTATION

#: Classes that constrain nothing, and predicates of mere equivalence: fixed values.
GENERIC = ("named thing", "entity", "thing with taxon", "physical essence or occurrent", "physical essence", "occurrent")
EQUIVALENCE = ("biolink:same_as", "biolink:exact_match", "biolink:close_match", "biolink:broad_match", "biolink:narrow_match")
ROOT_DEPTH = 2


def closure(tree: DataFrame) -> DataFrame:
    """``name, parent`` -> ``name, ancestor, dist`` (itself at 0); the first of a cycle wins, so it ends."""
    up = tree.filter(F.col("parent").isNotNull()).select(F.col("name").alias("c"), F.col("parent").alias("p"))
    return grow(tree.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("dist")), lambda d: d.join(up, F.col("ancestor") == F.col("c")).select("name", F.col("p").alias("ancestor"), (F.col("dist") + 1).alias("dist")), ["name", "ancestor"], "closure")


def chains(closed: DataFrame) -> DataFrame:
    """The path from the root to each name."""
    return closed.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "ancestor"))), lambda x: x["ancestor"]).alias("chain"))


def depths(closed: DataFrame) -> DataFrame:
    """H07"""
    return closed.groupBy("name").agg(F.max("dist").alias("depth"))


def roots(tree: DataFrame) -> DataFrame:
    """H07"""
    return tree.filter(F.col("parent").isNull()).select("name")


def orphans(tree: DataFrame) -> DataFrame:
    """Names whose parent is not a name."""
    return tree.filter(F.col("parent").isNotNull()).join(tree.select(F.col("name").alias("parent")), "parent", "left_anti").select("name")


def neighbours(tree: DataFrame) -> DataFrame:
    """Children, siblings and the parent of each name: ``name, other, kind``, nearest kind first."""
    kids = tree.filter("parent IS NOT NULL").select(F.col("parent").alias("name"), F.col("name").alias("other"), F.lit(0).alias("kind"))
    sib = tree.alias("a").join(tree.select(F.col("name").alias("other"), F.col("parent").alias("pp")), F.col("a.parent") == F.col("pp")).filter("name <> other").select("name", "other", F.lit(1).alias("kind"))
    par = tree.filter("parent IS NOT NULL").select("name", F.col("parent").alias("other"), F.lit(2).alias("kind"))
    return kids.unionByName(sib).unionByName(par)


def entity_classes(closed: DataFrame, inside: str = "entity", outside: str = "association") -> DataFrame:
    """Below one root and not below another."""
    of = lambda x: closed.filter(F.col("ancestor") == x).select("name").distinct()
    return of(inside).join(of(outside), "name", "left_anti")


def effective_mixins(closed: DataFrame, mixins: DataFrame) -> DataFrame:
    """Mixins of a class and of its ancestors, and what those mixins descend from. ``mixins``: name, mixin."""
    direct = closed.join(mixins.select(F.col("name").alias("ancestor"), "mixin"), "ancestor").select("name", "mixin")
    above = direct.join(closed.select(F.col("name").alias("mixin"), F.col("ancestor").alias("up")), "mixin").select("name", F.col("up").alias("mixin"))
    return direct.unionByName(above).distinct()


def inherited(closed: DataFrame, attributes: DataFrame, value: str) -> DataFrame:
    """The first value that is not null up the chain. ``attributes``: name, value."""
    v = attributes.filter(F.col(value).isNotNull()).select(F.col("name").alias("ancestor"), value)
    return closed.select("name").distinct().join(closed.join(v, "ancestor").groupBy("name").agg(F.min_by(value, "dist").alias(value)), "name", "left")


def strata(closed: DataFrame, anchors: DataFrame, angles: DataFrame) -> DataFrame:
    """``name, stratum, status, angle``: core below an anchor, else shared below an angled class (nearest counts).
    ``anchors``: stratum, name; ``angles``: stratum, name, angle."""
    core = closed.join(anchors.select("stratum", F.col("name").alias("ancestor")), "ancestor").select("name", "stratum").distinct().withColumn("core", F.lit(True))
    near = closed.join(angles.select("stratum", F.col("name").alias("ancestor"), "angle"), "ancestor").groupBy("name", "stratum").agg(F.min_by("angle", "dist").alias("angle"))
    j = core.join(near, ["name", "stratum"], "full")
    return j.select("name", "stratum", F.when(F.col("core"), "core").otherwise("shared").alias("status"), "angle")


def stratum_summary(members: DataFrame) -> DataFrame:
    """H13"""
    return members.groupBy("stratum").agg(F.count_if(F.col("status") == "core").alias("n_core"), F.count_if(F.col("status") == "shared").alias("n_shared"), F.array_sort(F.collect_set(F.when(F.col("status") == "core", F.col("name")))).alias("core_names"))


def unseen(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Observed predicates without lineage."""
    return observed.join(known.select("predicate"), "predicate", "left_anti").select("predicate", F.lit(None).cast("string").alias("parent"), F.lit(True).alias("observed_only"))


def in_stratum(predicates: DataFrame, members: DataFrame, closed: DataFrame, mixin_members: DataFrame) -> DataFrame:
    """``predicate, stratum`` where domain and range are each in scope: itself, below it, or a mixin's member."""
    core = members.select("name", "stratum").distinct()
    below = closed.join(core, "name").select(F.col("ancestor").alias("side"), "stratum")
    mixed = mixin_members.join(core, "name").select(F.col("mixin").alias("side"), "stratum")
    scope = core.select(F.col("name").alias("side"), "stratum").unionByName(below).unionByName(mixed).distinct()
    d = predicates.join(scope.select(F.col("side").alias("domain"), "stratum"), "domain").select("predicate", "range", "stratum")
    return d.join(scope.withColumnRenamed("side", "range"), ["range", "stratum"]).select("predicate", "stratum").distinct()


def branches(tree: DataFrame, root: str, split: tuple[str, ...] = ()) -> DataFrame:
    """Children of the root; split ones are replaced by their children."""
    kids = tree.filter(F.col("parent") == root)
    return kids.filter(~F.col("name").isin(*split) if split else F.lit(True)).select("name").unionByName(tree.filter(F.col("parent").isin(*split) if split else F.lit(False)).select("name"))


def branch_of(closed: DataFrame, branch: DataFrame) -> DataFrame:
    """The nearest ancestor that is a branch."""
    return closed.join(branch.select(F.col("name").alias("ancestor")), "ancestor").groupBy("name").agg(F.min_by("ancestor", "dist").alias("branch"))


def snap(w: Column) -> Column:
    """To 0, 0.5 or 1; the midpoints go down."""
    return F.when(w <= 0.25, 0.0).when(w <= 0.75, 0.5).otherwise(1.0)


def branch_weights(raw: DataFrame, branch: DataFrame) -> DataFrame:
    """``name, weight`` (strings allowed) of known branches, snapped; what is no number is 0."""
    return raw.join(branch, "name", "left_semi").select("name", snap(F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0))).alias("weight"))


def default_weights(closed: DataFrame, branch: DataFrame, members: DataFrame, angle_weight: float = 1.0) -> DataFrame:
    """``name, weight`` of each branch for a stratum: 1 with a core class of the stratum in it, ``angle_weight`` if its
    classes only enter the stratum under an angle, else 0. ``members``: name, status."""
    inside = closed.join(members.select("name", (F.col("status") == "core").alias("core")), "name").groupBy(F.col("ancestor").alias("name")).agg(F.max("core").alias("core"))
    weight = F.when(F.col("core"), 1.0).when(F.col("core").isNotNull(), angle_weight).otherwise(0.0)
    return branch.select("name").distinct().join(inside, "name", "left").select("name", weight.alias("weight"))


def class_weights(tree: DataFrame, closed: DataFrame, branch: DataFrame, weights: DataFrame, mixin_members: DataFrame | None = None) -> DataFrame:
    """A class has its branch's weight; above the branches the largest below; a mixin the largest of its members."""
    own = branch_of(closed, branch).join(weights.select(F.col("name").alias("branch"), "weight"), "branch", "left").select("name", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    over = tree.select("name").join(own.select("name"), "name", "left_anti")
    below = closed.select(F.col("ancestor").alias("name"), F.col("name").alias("d")).join(weights.select(F.col("name").alias("d"), "weight"), "d").groupBy("name").agg(F.max("weight").alias("weight"))
    out = own.unionByName(over.join(below, "name", "left").select("name", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    if mixin_members is None:
        return out
    mixed = mixin_members.join(out, "name", "left").groupBy(F.col("mixin").alias("name")).agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    return out.join(mixed.select("name"), "name", "left_anti").unionByName(mixed)


def scope_weights(names: DataFrame, tree: DataFrame, closed: DataFrame, cw: DataFrame, mixin_members: DataFrame | None = None) -> DataFrame:
    """Weight of a domain or range ``name``: generic, missing or unknown is 1, a class the largest of it and below."""
    per = closed.join(cw, "name").groupBy(F.col("ancestor").alias("k")).agg(F.max("weight").alias("cls"))
    j = names.select("name").distinct().join(per.join(tree.select(F.col("name").alias("k")), "k", "left_semi"), F.col("name") == F.col("k"), "left").drop("k")
    if mixin_members is not None:
        m = mixin_members.join(cw, "name", "left").groupBy(F.col("mixin").alias("mk")).agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("mix"))
        j = j.join(m, F.col("name") == F.col("mk"), "left").drop("mk")
    else:
        j = j.withColumn("mix", F.lit(None).cast("double"))
    free = F.col("name").isNull() | F.col("name").isin(*GENERIC)
    return j.select("name", F.when(free, 1.0).otherwise(F.coalesce("cls", "mix", F.lit(1.0))).alias("weight"))


def priority(domain_w: Column, range_w: Column, rule: str = "max") -> Column:
    """H20"""
    return F.when((domain_w <= 0) | (range_w <= 0), 0.0).otherwise(F.least(domain_w, range_w) if rule == "min" else F.greatest(domain_w, range_w))


def predicate_lineage(tree: DataFrame) -> DataFrame:
    """``name, depth, branch`` (the third name of the chain from the root, or the last)."""
    return chains(closure(tree)).select("name", (F.size("chain") - 1).alias("depth"), F.coalesce(F.try_element_at("chain", F.lit(3)), F.element_at("chain", -1)).alias("branch"))


def derive(predicates: DataFrame, scope: DataFrame, alpha: float = 0.7, min_weight: float = 0.0, rule: str = "max", counted: bool = True) -> DataFrame:
    """``predicate, branch, depth, domain, range, n_edges[, kg_only]`` and scope weights -> weights with the reason of each
    exclusion. Within a branch a weight is W * e * exp(alpha * depth) / sum, with W the largest e, so they sum to W."""
    s = scope
    p = predicates.join(s.select(F.col("name").alias("domain"), F.col("weight").alias("w_domain")), "domain", "left").join(s.select(F.col("name").alias("range"), F.col("weight").alias("w_range")), "range", "left")
    p = p.withColumn("w_domain", F.coalesce("w_domain", F.lit(1.0))).withColumn("w_range", F.coalesce("w_range", F.lit(1.0))).withColumn("priority", priority(F.col("w_domain"), F.col("w_range"), rule))
    kg_only = F.coalesce(F.col("kg_only"), F.lit(False)) if "kg_only" in predicates.columns else F.lit(False)
    note = (
        F.when(F.col("predicate").isin(*REPRESENTATION), "representation")
        .when(F.col("predicate").isin(*EQUIVALENCE), "equivalence")
        .when(~kg_only & (F.col("depth") < ROOT_DEPTH), "root")
        .when(F.col("priority") <= 0, "out of scope")
        .when(F.lit(counted) & (F.col("n_edges") == 0), "no edges")
        .otherwise("")
    )
    p = p.withColumn("note", note)
    raw = F.when(F.col("note") == "", F.col("priority") * F.exp(alpha * F.col("depth")))
    per = p.filter("note = ''").groupBy("branch").agg(F.sum(raw).alias("total"), F.max("priority").alias("w_branch"))
    p = p.join(per, "branch", "left")
    w = F.when(F.col("note") == "representation", 1.0).when(F.col("note") == "", F.col("w_branch") * raw / F.col("total"))
    p = p.withColumn("weight", F.when(w >= min_weight, F.round(w, 6)))
    return p.withColumn("note", F.when((F.col("note") == "") & F.col("weight").isNull(), "below minimum").otherwise(F.col("note"))).select("predicate", "branch", "depth", "domain", "range", "w_domain", "w_range", "priority", "n_edges", "weight", "note")


def category_weights(cw: DataFrame) -> DataFrame:
    return cw.select(camel(F.col("name")).alias("category"), "weight")


def uniform_profile(predicates: DataFrame, branch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every predicate and every branch at weight 1."""
    return predicates.select("predicate", F.lit(1.0).alias("weight")), branch.select("name", F.lit(1.0).alias("weight"))


def branch_sizes(closed: DataFrame, branch: DataFrame, node_counts: DataFrame) -> DataFrame:
    """Classes and nodes of each branch. ``node_counts``: name, n."""
    m = branch_of(closed, branch).join(node_counts, "name", "left")
    return m.groupBy("branch").agg(F.count(F.lit(1)).alias("n_classes"), F.sum(F.coalesce("n", F.lit(0))).alias("n_nodes"))


def distance(a: Column, b: Column) -> Column:
    """Steps between two names over their last common ancestor, from root-first chains; null if one is unknown."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    lcp = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, ok: F.struct((s["n"] + F.when(s["go"] & ok, 1).otherwise(0)).alias("n"), (s["go"] & ok).alias("go")), lambda s: s["n"])
    return F.when(a.isNotNull() & b.isNotNull(), F.size(a) + F.size(b) - 2 * lcp)


def indexable(classes: DataFrame) -> DataFrame:
    """Classes that are neither deprecated nor abstract."""
    return classes.filter(~F.coalesce("deprecated", F.lit(False)) & ~F.coalesce("abstract", F.lit(False)))


def nested(tree: DataFrame, most: int = 20_000) -> str:
    """The hierarchy as nested JSON; an ontology is small, its size is checked. Names of a cycle are left out."""
    rows = tree.select("name", "parent").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many classes for one document")
    kids: dict = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r["name"])

    def below(name: str) -> dict:
        return {"name": name, "children": [below(k) for k in sorted(kids.get(name, []))]}

    return json.dumps([below(n) for n in sorted(kids.get(None, []))])


def lookup_text(tree: DataFrame, descriptions: DataFrame) -> DataFrame:
    """What a lookup of a class answers: its description, parent, children and siblings, one text a class."""
    kinds = {0: "children", 1: "siblings", 2: "parent"}
    near = neighbours(tree).groupBy("name", "kind").agg(F.array_join(F.array_sort(F.collect_set("other")), ", ").alias("names"))
    kind = F.element_at(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    lines = near.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", F.concat(kind, F.lit(": "), F.col("names")).alias("t")))), lambda x: x["t"]), "\n").alias("around"))
    return descriptions.join(lines, "name", "left").select("name", F.concat_ws("\n", F.concat(F.col("name"), F.lit(": "), F.coalesce("description", F.lit(""))), "around").alias("text"))
