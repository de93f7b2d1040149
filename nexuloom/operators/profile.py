"""Profiles: weights of predicates, sources, levels and categories, resolved at query time."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Predicates between identifiers of one object, and the namespaces of such identifiers: fixed values.
REPRESENTATION = ("biolink:gene_product_of", "biolink:has_gene_product", "biolink:transcribed_to", "biolink:transcribed_from", "biolink:translates_to", "biolink:translation_of")
IDENTITY_PREFIXES = ("NCBIGene:", "ENSEMBL:", "UniProtKB:", "PR:", "CHEMBL.TARGET:", "HGNC:", "RefSeq:", "NCBITranscript:", "MIRBASE:")
GENE_PREFIXES = ("NCBIGene:", "UniProtKB:", "ENSEMBL:", "PR:")
TARGET_PREFIXES = ("CHEMBL.TARGET:",)


@dataclass(frozen=True)
class Representation:
    """Which edges only change an object's identifier: ``rules`` maps a predicate to (subject, object) prefixes."""

    rules: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]

    @classmethod
    def of_identifiers(cls) -> Representation:
        both = {p: (IDENTITY_PREFIXES, IDENTITY_PREFIXES) for p in REPRESENTATION}
        return cls(both | {"biolink:has_part": (GENE_PREFIXES, TARGET_PREFIXES), "biolink:part_of": (TARGET_PREFIXES, GENE_PREFIXES)})

    def column(self, predicate: Column, subject: Column, object_: Column) -> Column:
        """P06"""
        hit = F.lit(False)
        for name, (left, right) in self.rules.items():
            hit = hit | ((predicate == name) & starts_with_any(subject, left) & starts_with_any(object_, right))
        return F.coalesce(hit, F.lit(False))


def starts_with_any(c: Column, prefixes: Iterable[str]) -> Column:
    """Literal prefixes, never patterns."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | c.startswith(p)
    return hit


@dataclass(frozen=True)
class Profile:
    name: str = ""
    predicates: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    levels: dict[str, float] = field(default_factory=dict)
    categories: dict[str, float] = field(default_factory=dict)
    symmetric: tuple[str, ...] = ()
    restricted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    branches: dict[str, float] = field(default_factory=dict)
    mode: str = "on"
    inverse_factor: float = 0.5
    alpha: float = 0.7
    scope_rule: str = "max"
    min_weight: float = 0.0

    def allowed(self, predicate: Column, subject: Column, object_: Column) -> Column:
        """A restricted predicate needs both ends in its namespaces; other predicates are free."""
        ok = F.lit(True)
        for name, prefixes in self.restricted.items():
            if prefixes:
                ok = ok & ((predicate != name) | (starts_with_any(subject, prefixes) & starts_with_any(object_, prefixes)))
        return ok


def directionality(raw: object, default_factor: float = 0.5) -> tuple[str, float]:
    """``None``, a boolean, "on"/"off" or ``{mode, inverse_factor}`` -> (mode, factor within 0..1)."""
    mode, factor = "on", default_factor
    if isinstance(raw, dict):
        mode, factor = str(raw.get("mode", "on")).lower(), raw.get("inverse_factor", default_factor)
    elif isinstance(raw, bool):
        mode = "on" if raw else "off"
    elif isinstance(raw, str):
        mode = raw.lower()
    try:
        factor = min(1.0, max(0.0, float(factor)))
    except (TypeError, ValueError):
        factor = default_factor
    return ("off", 1.0) if mode in ("off", "false", "undirected") else ("on", factor)


def effective_direction(profile: Profile, mode: str = "", factor: float | None = None) -> tuple[str, float]:
    """An override, else the profile's; the factor counts only while directed."""
    mode = mode or profile.mode
    return ("off", 1.0) if mode == "off" else ("on", min(1.0, max(0.0, float(profile.inverse_factor if factor is None else factor))))


def from_json(text: str) -> Profile:
    """Branch weights, an explicit ``predicates`` map or a flat map of predicates."""
    d = json.loads(text)
    known = {"name", "description", "stratum", "branch_weights", "predicates", "sources", "knowledge_levels", "prefix_restricted_predicates", "directionality", "weighting", "entity_scope", "reading_focus", "categories"}
    flat = {k: float(v) for k, v in d.items() if k not in known and isinstance(v, int | float)}
    mode, factor = directionality(d.get("directionality"))
    w = d.get("weighting") or {}
    number = lambda m: {k: float(v) for k, v in (m or {}).items()}
    return Profile(d.get("name", ""), number(d.get("predicates")) or flat, number(d.get("sources")), number(d.get("knowledge_levels")), number(d.get("categories")), (), {k: tuple(v) for k, v in (d.get("prefix_restricted_predicates") or {}).items()}, number(d.get("branch_weights")), mode, factor, float(w.get("alpha", 0.7)), str(w.get("scope_rule", "max")), float(w.get("min_weight", 0.0)))


def merge(profiles: Sequence[Profile]) -> Profile:
    """A12 for profiles in memory: each map keeps its largest weight, lists are joined in order."""
    def top(maps):
        out: dict[str, float] = {}
        for m in maps:
            for k, v in m.items():
                out[k] = max(v, out.get(k, v))
        return out

    restricted: dict[str, tuple[str, ...]] = {}
    for p in profiles:
        for k, v in p.restricted.items():
            restricted[k] = tuple(dict.fromkeys((*restricted.get(k, ()), *v)))
    return Profile("+".join(p.name for p in profiles), top(p.predicates for p in profiles), top(p.sources for p in profiles), top(p.levels for p in profiles), top(p.categories for p in profiles), tuple(dict.fromkeys(s for p in profiles for s in p.symmetric)), restricted, top(p.branches for p in profiles), "off" if any(p.mode == "off" for p in profiles) else "on", max((p.inverse_factor for p in profiles), default=0.5))


def fingerprint(*parts: object) -> str:
    """16 hex digits of the SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def lookup(spark: SparkSession, weights: dict[str, float], key: str, value: str) -> DataFrame:
    """A profile's map as a table. A profile is written by hand, so its size is bounded and checked."""
    if len(weights) > 10_000:
        raise ValueError("a profile of this size is not broadcast")
    return F.broadcast(spark.createDataFrame(list(weights.items()) or [("", 0.0)], f"{key} string, {value} double").filter(F.lit(bool(weights))))
