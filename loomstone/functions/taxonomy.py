"""Category, tag and keyword normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CATEGORIES = ["programming", "writing", "research", "design", "devops", "data", "general"]
ALIASES = {
    "technical": "programming",
    "tooling": "programming",
    "best-practice": "programming",
    "bestpractice": "programming",
    "performance": "programming",
    "security": "programming",
    "architectural": "design",
    "architecture": "design",
    "decision": "design",
    "infra": "devops",
    "infrastructure": "devops",
    "operations": "devops",
    "analytics": "data",
    "database": "data",
    "databases": "data",
    "uncategorized": "general",
    "other": "general",
}


def normalize_category(category: Column) -> Column:
    """One of CATEGORIES; unknown, blank and null become general."""
    known = F.create_map(*[F.lit(x) for k, v in [*ALIASES.items(), *[(c, c) for c in CATEGORIES]] for x in (k, v)])
    raw = F.lower(F.trim(category))
    return F.coalesce(F.try_element_at(known, raw), F.try_element_at(known, F.regexp_replace(raw, r"\s+", "-")), F.lit("general"))


def normalize_tag(tag: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(F.trim(tag)), r"[^\w\s/-]", " ")
    dashed = F.regexp_replace(F.regexp_replace(cleaned, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def normalize_tags(tags: Column) -> Column:
    """Normalised tags without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(tags, normalize_tag), lambda t: t != ""))


def normalize_keywords(keywords: Column) -> Column:
    """Trimmed keywords of over two characters; of spellings that differ in case the first stays."""
    kept = F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: F.length(k) > 2)
    lower = F.transform(kept, F.lower)
    return F.filter(kept, lambda k, i: F.array_position(lower, F.lower(k)) == i + 1)
