"""Quality classifier: a sparse rule ensemble compiled into column expressions.

Statistics of the whole text (counts by regular expressions, ratios to words) are columns. A bounded sample of labelled
rows (``max_rows``, chosen by a hash of the id) is fitted on the driver: boosted trees on those statistics give paths,
every path and every part of a path is a conjunctive rule, and a logistic regression with an L1 penalty keeps few of
them. The kept rules and their weights are then one expression, so scoring stays inside the scan's stage.

Defined cases: a null text is scored as the empty text; texts of any length are counted whole; with no labelled rows, or
one label only, every document gets that share of ones (1 if there are none); several labels of one document are
averaged (a tie is a 1), null labels and labels of null ids are ignored; a document with a null id is scored, never
learned from; a statistic equal to a rule's threshold is on its left; repeated rows are scored each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, goes left, threshold): left is <=


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def statistics(text: Column, held: Column | None = None) -> tuple[dict[str, Column], dict[str, Column]]:
    """Raw counts of a text, and the statistics made of them (of columns, or of the fields of ``held``)."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    raw = {
        "chars": F.length(text).cast("double"),
        "words": count(WORD),
        "symbols": count(r"[#$%&*|<>~^=_{}\[\]\\]"),
        "bangs": count(r"[!?]{2}"),
        "upper": count(r"\p{Lu}{2,}"),
        "digits": count(r"[0-9]+"),
        "stops": count(r"[.!?](?=\s|$)"),
        "commas": count(r"[,;:]"),
        "breaks": count("\n"),
        "links": count(r"://|www\.|@"),
        "long": count(r"[^\s]{16,}"),
        "vocabulary": F.size(F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+"))).cast("double"),
        "lines": F.size(F.array_distinct(F.split(text, "\n"))).cast("double"),
    }
    raw = {f"__r_{n}": c for n, c in raw.items()}
    col = lambda n: F.col(f"__r_{n}") if held is None else held[f"__r_{n}"]
    w = F.greatest(col("words"), F.lit(1.0))
    per_word = {f"{c}_per_word": col(c) / w for c in ("symbols", "bangs", "upper", "digits", "stops", "commas", "breaks", "links", "long", "vocabulary", "chars")}
    return raw, {"words": col("words"), **per_word, "repeated_lines": 1 - col("lines") / (col("breaks") + 1)}


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> tuple[DataFrame, list[str]]:
    raw, stats = statistics(F.col("__text"))
    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    d = d.select(*keep, *[c.alias(n) for n, c in raw.items()])
    return d.select(*keep, *[c.alias(f"__s_{n}") for n, c in stats.items()]), [f"__s_{n}" for n in stats]


@dataclass
class Rules:
    """``sigmoid(bias + sum of the weights of the rules that hold)``."""

    bias: float
    rules: list[tuple[float, Rule]]

    def column(self, of=F.col) -> Column:
        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [(of(s) <= F.lit(t)) if left else (of(s) > F.lit(t)) for s, left, t in rule])

        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(0.0) for w, r in self.rules], F.lit(self.bias))
        return 1 / (1 + F.exp(-total))


def _splits(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def _tree(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list, np.ndarray]:
    """Paths of one regression tree on gradients, and its step for every row."""
    paths, step = [], np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple) -> None:
        best = (1e-6, None)
        g, h = grad[rows].sum(), hess[rows].sum()
        if len(path) < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                code = codes[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(code, weights=v, minlength=len(c) + 1))[:-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if path:
            paths.append(path)
        if best[1] is None:
            step[rows] = -g / (h + 1)
            return
        j, k = best[1]
        left = codes[rows, j] <= k
        grow(rows[left], (*path, (j, True, float(cuts[j][k]))))
        grow(rows[~left], (*path, (j, False, float(cuts[j][k]))))

    grow(np.arange(len(x)), ())
    return paths, step


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, bins: int = 32, penalty: float = 0.002, rounds: int = 300) -> Rules:
    """Boosted trees -> rules -> L1 logistic regression by accelerated proximal gradient."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
        return Rules(float(np.log(share / (1 - share))), [])
    cuts = _splits(x, bins)
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    f, rules = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        paths, step = _tree(x, codes, cuts, p - y, p * (1 - p), depth, max(5, len(y) // 400))
        f += 0.3 * step
        for path in paths:
            rules.setdefault(tuple(sorted(path)), None)
    held = [np.logical_and.reduce([(x[:, j] <= t) if left else (x[:, j] > t) for j, left, t in r]) for r in rules]
    m = np.array(held, np.float64).T
    scale = np.maximum(m.std(axis=0), 0.05)
    mean = m.mean(axis=0)
    z = (m - mean) / scale
    w, b, v, vb, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
    norm = np.ones(z.shape[1])
    for _ in range(20):
        norm = z.T @ (z @ norm)
        norm /= np.linalg.norm(norm) or 1
    rate = 1 / (0.25 * max(np.linalg.norm(z @ norm) ** 2 / len(y), 1.0) + 0.25)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v + vb)))
        new = v - rate * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb, nt = vb - rate * (p - y).mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    w = w / scale
    chosen = np.flatnonzero(np.abs(w) > 1e-4)
    every = list(rules)
    return Rules(float(b - (w * mean).sum()), [(float(w[i]), tuple((names[j], left, th) for j, left, th in every[i])) for i in chosen])


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Rules:
    """Fit on at most ``max_rows`` labelled documents for which ``learn`` (over ``doc_id``) holds."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col)).alias("y"))
    chosen = known.filter(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "l_id")
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # max_rows ids at most
    stats, names = with_statistics(sample, ["doc_id", "y"])
    rows = stats.orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(2 * max_rows).toPandas()
    return fit(rows[names].to_numpy(np.float64), (rows["y"].to_numpy(np.float64) >= 0.5).astype(np.float64), names)


def score(docs: DataFrame, model: Rules, keep: list[str], text_col: str = "text", least: float = 0.7) -> DataFrame:
    """``score`` and ``predicted`` beside the columns in ``keep``."""
    stats, _ = with_statistics(docs, keep, text_col)
    return stats.select(*keep, model.column().alias("score")).withColumn("predicted", (F.col("score") >= least).cast("int"))


def accepted(docs: DataFrame, model: Rules, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The documents whose score is at least ``least``, all columns kept.

    A filter moves below the projections, so here the statistics are bound inside the condition: as columns they would
    be repeated in every rule that names them."""
    raw, _ = statistics(F.coalesce(F.col(text_col), F.lit("")))
    stats = lambda r: F.struct(*[c.alias(f"__s_{n}") for n, c in statistics(F.lit(""), r)[1].items()])
    score = bind(F.struct(*[c.alias(n) for n, c in raw.items()]), lambda r: bind(stats(r), lambda s: model.column(lambda n: s[n])))
    return docs.filter(score >= least)
