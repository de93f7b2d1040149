"""Sanitising, tokenising and reply parsing."""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import type_key

#: Phrases and keywords that are taken out of texts, and forms of identifiers that are private: fixed values.
INJECTION = (r"ignore (all|previous|prior) instructions", r"system override", r"forget your tools", r"new instructions", r"disregard (all|previous|prior)")
KEYWORDS = ("ACTION:", "FINAL_VERDICT:", "OBSERVATION:")
IDENTIFIERS = (r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", r"\b(?:\+?\d[\d\s().-]{7,}\d)\b", r"\b(?:MRN|NHS|SSN|patient|pt|id)\s*[:#]?\s*\d{3,}\b")
PERSONAL_TYPES = ("case", "individual organism", "cohort", "study population", "population of individual organisms", "agent")
NONE_WORDS = ("none", "null", "n/a", "not applicable")
MAX_INPUT, MAX_ARGUMENT = 5000, 300
#: Marks of a verdict, of what must not stand in one and of a choice: fixed values, as replies are written that way.
VERDICT_MARK = r"(?i)FINAL[_ ]VERDICT\**\s*[:\-]?\s*\**\s*([^\n]+)"
SCRIPT_MARK = r"(?i)<script>|\$\{|\{\{|\$\("
CHOICE_MARK = r"""(?i)"?choice"?\s*[:=]\s*(-?\d+)"""
#: Tools that look terms up, and the one that takes a class: fixed values.
TERM_TOOLS, CLASS_TOOL = ("lookup_exact_term", "semantic_context_search"), "get_class_hierarchy"


def sentences(c: Column) -> Column:
    """Split after sentence marks; blank pieces are dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def piped_terms(c: Column) -> Column:
    """N02"""
    return F.filter(F.transform(F.split(c, r"\|"), lambda s: F.trim(s)), lambda s: s != "")


def fallback_tokens(c: Column) -> Column:
    """Words of letters longer than two."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"(\p{L}[\p{L}\p{N}-]*)"), F.lit(1)), lambda t: F.length(t) > 2)


def usable_terms(c: Column) -> Column:
    """Two characters or more, not a number, a letter somewhere; the first of each spelling stays."""
    ok = F.filter(F.transform(c, lambda t: F.trim(t)), lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d+$") & t.rlike("[a-zA-Z]"))
    empty = F.array().cast("array<string>")
    return F.aggregate(ok, empty, lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))


def neutral(c: Column) -> Column:
    """Control characters out, control keywords and injection phrases neutralised."""
    c = F.trim(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    for k in KEYWORDS:
        c = F.regexp_replace(c, f"(?i){k}", f"{k[:-1]} -")
    for p in INJECTION:
        c = F.regexp_replace(c, f"(?i){p}", "[redacted]")
    return c


def sanitize(term: Column, sentence: Column) -> Column:
    """Struct ``ok, term, sentence``; too long or empty terms are refused."""
    t, s = neutral(term), neutral(sentence)
    ok = (F.length(term) <= MAX_INPUT) & (F.length(sentence) <= MAX_INPUT) & (t != "")
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, t).otherwise("").alias("term"), F.when(ok, s).otherwise("").alias("sentence"))


def is_private(term: Column, types: Column | None = None) -> Column:
    """A personal type, in any case, or the look of an identifier."""
    hit = F.lit(False)
    for p in IDENTIFIERS:
        hit = hit | term.rlike(f"(?i){p}")
    if types is not None:
        hit = hit | F.coalesce(F.exists(types, lambda t: F.lower(t).isin(*PERSONAL_TYPES)), F.lit(False))
    return hit


def usable_exemplar(c: Column) -> Column:
    """At most 60 characters and one to six words."""
    t = F.trim(c)
    return (F.length(t) <= 60) & (t != "") & F.size(F.split(t, r"\s+")).between(1, 6)


def surface_form(text: Column, compound: Column) -> Column:
    """Compound, abbreviation (short, no blank, mostly capitals), else canonical."""
    return F.when(compound, "compound").when((F.length(text) <= 6) & ~text.contains(" ") & (F.length(F.regexp_replace(text, "[^A-Z]", "")) >= 2), "abbreviation").otherwise("canonical")


def tokens(c: Column) -> Column:
    """Words of letters, digits and underscores in lower case, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)))


def verdict(reply: Column) -> Column:
    """The text after the last verdict mark, stripped; null without one."""
    every = F.regexp_extract_all(reply, F.lit(VERDICT_MARK), F.lit(1))
    return F.regexp_replace(F.try_element_at(every, F.lit(-1)), r"""^['"`*.:;,()\[\] \t]+|['"`*.:;,()\[\] \t]+$""", "")


def parse_verdicts(replies: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``ok`` and ``class_name`` (NONE for a refusal); unknown names and suspicious lines are not ok."""
    r = replies.withColumn("__raw", verdict(F.col("reply")))
    bad = F.col("__raw").rlike(SCRIPT_MARK)
    none = F.lower("__raw").isin(*NONE_WORDS)
    names = classes.select(F.col("name").alias("__name"), type_key(F.col("name")).alias("__key")).dropDuplicates(["__key"])
    j = r.withColumn("__key", type_key(F.col("__raw"))).join(names, "__key", "left")
    cls = F.when(bad | F.col("__raw").isNull(), None).when(none, "NONE").otherwise(F.col("__name"))
    return j.withColumn("class_name", cls).withColumn("ok", F.col("class_name").isNotNull()).drop("__raw", "__key", "__name")


def recover(reply: Column, candidates: Column) -> Column:
    """The longest candidate named in the reply (the first of the longest)."""
    named = F.filter(candidates, lambda c: F.lower(reply).contains(F.lower(c)))
    longest = F.array_max(F.transform(named, lambda c: F.length(c)))
    return F.try_element_at(F.filter(named, lambda c: F.length(c) == longest), F.lit(1))


def choice(reply: Column) -> Column:
    """The JSON object's choice, else a field named choice, else the last integer, else null."""
    block = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    from_json = F.get_json_object(block, "$.choice").try_cast("int")
    field = F.nullif(F.regexp_extract(reply, CHOICE_MARK, 1), F.lit("")).try_cast("int")
    last = F.try_element_at(F.regexp_extract_all(reply, F.lit(r"(-?\d+)"), F.lit(1)), F.lit(-1)).try_cast("int")
    return F.coalesce(from_json, field, last)


def unknown_list(reply: Column, batch: Column) -> Column:
    """Terms of a JSON list that were asked for."""
    return F.filter(F.coalesce(F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<string>"), F.array().cast("array<string>")), lambda t: F.array_contains(F.transform(batch, lambda b: F.lower(b)), F.lower(t)))


def tool_argument(c: Column) -> Column:
    """An argument out of quotes and ``name=``; brackets are part of it."""
    c = F.regexp_replace(F.regexp_replace(c, r"^\s*\w+\s*=\s*", ""), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(c, r"""^['"]+|['"]+$""", ""), r"^\s+|\s+$", "")


def checked_arguments(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """``tool, argument`` -> adds ``ok``, ``clean`` (for the class tool the class's own spelling) and ``message``.
    ``classes``: name."""
    c = calls.withColumn("clean", tool_argument(F.coalesce(F.col("argument"), F.lit(""))))
    names = classes.select(F.col("name").alias("__name"), type_key(F.col("name")).alias("__key")).dropDuplicates(["__key"])
    j = c.withColumn("__key", type_key(F.col("clean"))).join(names, "__key", "left")
    short, of_class = F.length("clean").between(1, MAX_ARGUMENT), F.col("tool") == CLASS_TOOL
    message = (
        F.when(~short, "Empty or oversized argument.")
        .when(F.col("tool").isin(*TERM_TOOLS), "")
        .when(of_class & F.col("__name").isNull(), F.concat(F.lit("Unknown class '"), F.col("clean"), F.lit("': search for candidate classes first.")))
        .when(of_class, "")
        .otherwise(F.concat(F.lit("Unknown tool: "), F.coalesce("tool", F.lit(""))))
    )
    j = j.withColumn("message", message).withColumn("ok", F.col("message") == "")
    return j.withColumn("clean", F.when(F.col("ok") & of_class, F.col("__name")).otherwise(F.col("clean"))).drop("__key", "__name")


def gloss(description: Column, synonyms: Column, most: int = 180) -> Column:
    """The description unless it is a comment, else four synonyms, cut."""
    text = F.when((F.coalesce(description, F.lit("")) != "") & ~description.startswith("//"), description).otherwise(F.array_join(F.slice(F.coalesce(synonyms, F.array().cast("array<string>")), 1, 4), "; "))
    return F.substring(text, 1, most)


def class_document(name: Column, description: Column, aliases: Column, examples: Column) -> Column:
    """R01, H05"""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws(". ", name, part("Description", description), part("Aliases", aliases), part("Examples", examples))


def numbered_menu(rows: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """One text a key, its lines numbered in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n").alias("menu"))


def grouped_menu(rows: DataFrame, key: str = "term") -> DataFrame:
    """``key, name, parent, rank`` -> children indented under a parent that is a candidate too."""
    p = rows.select(F.col(key).alias("pk"), F.col("name").alias("pn"), F.col("rank").alias("pr"))
    j = rows.join(p, (F.col(key) == F.col("pk")) & (F.col("parent") == F.col("pn")), "left")
    line = F.when(F.col("pr").isNull(), F.col("name")).otherwise(F.concat(F.lit("  "), F.col("name")))
    items = F.array_sort(F.collect_list(F.struct(F.coalesce("pr", "rank").alias("a"), F.col("pr").isNotNull().alias("b"), F.col("rank").alias("c"), line.alias("t"))))
    return j.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("menu"))


def text_counts(c: Column, pattern: str) -> list[Column]:
    """E16"""
    return [F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")).alias("n_words"), F.regexp_count(c, F.lit(r"(?m)^\s*(?:[-*]|\d+\.)\s+")).alias("n_list_items"), F.regexp_count(c, F.lit(pattern)).alias("n_hits")]


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, white space folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))


def prompt(template: str, **fields: Column) -> Column:
    """A text with ``{name}`` fields filled from columns; null fields are empty. What is asked of a model (N13) goes
    through ``retrieval.once_per``."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(fields[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def markdown_html(text: str) -> str:
    """Headings, lists, bold, code and paragraphs of a short report."""
    out, listing = [], False
    for block in text.split("\n"):
        line = _html.escape(block.strip(), quote=False)
        line = re.sub(r"`([^`]+)`", r"<code>\1</code>", re.sub(r"\*\*([^*]+)\*\*", r"<b>\1</b>", line))
        item, head = re.match(r"[-*] (.*)", line), re.match(r"(#{1,4}) (.*)", line)
        if listing and not item:
            out.append("</ul>")
        if item:
            out += ["<ul>"] * (not listing) + [f"<li>{item[1]}</li>"]
        elif head:
            out.append(f"<h{len(head[1])}>{head[2]}</h{len(head[1])}>")
        elif line:
            out.append(f"<p>{line}</p>")
        listing = bool(item)
    return "\n".join(out + ["</ul>"] * listing)
