"""Scalar expressions: names, prefixes, rounding, accents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def camel(name: Column) -> Column:
    """``small molecule`` -> ``biolink:SmallMolecule``; only first letters change, so ``RNA product`` keeps its capitals."""
    return F.concat(F.lit("biolink:"), F.array_join(F.transform(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), ""))


def plain_name(c: Column) -> Column:
    """A predicate's or class's plain name."""
    return F.trim(F.replace(F.replace(F.replace(c, F.lit("biolink:"), F.lit("")), F.lit("biolink_"), F.lit("")), F.lit("_"), F.lit(" ")))


def type_key(c: Column) -> Column:
    """Spelling-blind key of a class name: no prefix, white space, underscore, hyphen or case."""
    return F.lower(F.regexp_replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("biolink:"), F.lit("")), r"[\s_\-]", ""))


def prefix(c: Column) -> Column:
    return F.split_part(c, F.lit(":"), F.lit(1))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def significant(x: Column, digits: int = 3) -> Column:
    """Rounded to significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into a base letter and marks, and their bases."""
    pairs = [(chr(i), "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))) for i in range(0xC0, 0x250)]
    one = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in one), "".join(b for _, b in one)


def fold_accents(c: Column) -> Column:
    """Accents off Latin letters (the reference folds all scripts; others are left as they are here)."""
    return F.translate(c, *_accents())


def fold(c: Column) -> Column:
    """Lower case without accents, white space folded."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), r"\s+", " "))
