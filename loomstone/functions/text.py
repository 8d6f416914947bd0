"""Text rules of the atomiser, the snippet builder and the page cleaner as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.taxonomy import normalize_tags

# Fixed word lists.
QUESTION_STARTS = ["how", "what", "why", "when"]
CODE_MARKS = ["```", "function", "class ", "const "]
DECISION_MARKS = ["decide", "choose", "recommend", "should we"]
REFERENCE_MARKS = ["see ", "refer to", "docs", "documentation"]
LANGUAGES = ["typescript", "javascript", "python", "rust", "go", "java", "sql"]
TECHNOLOGIES = ["react", "node", "express", "oauth", "api", "database", "auth"]
EXTRA_TAGS = {
    "security": ["security", "auth"],
    "performance": ["performance", "optimize"],
    "bugfix": ["bug", "fix"],
    "feature": ["feature", "implement"],
}
CATEGORY_MARKS = {
    "programming": ["code", "function", "class"],
    "writing": ["write", "article", "essay"],
    "research": ["research", "study", "analyze"],
    "design": ["design", "ui", "ux"],
}
VISUAL_TERMS = [
    "image", "images", "photo", "photos", "picture", "pictures", "diagram", "diagrams", "screenshot", "screenshots",
    "visual", "ui", "ux", "mockup", "wireframe", "chart", "graph", "figure",
]


def contains_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def infer_type(role: Column, text: Column) -> Column:
    """question, code, decision, reference or insight: the first rule that fits."""
    t = F.lower(text)
    asks = reduce(lambda a, b: a | b, [t.contains("?"), *[t.startswith(s) for s in QUESTION_STARTS]])
    return (
        F.when((role == "user") & asks, "question")
        .when(contains_any(t, CODE_MARKS), "code")
        .when(contains_any(t, DECISION_MARKS), "decision")
        .when(contains_any(t, REFERENCE_MARKS), "reference")
        .otherwise("insight")
    )


def categorize(text: Column) -> Column:
    t = F.lower(text)
    out = F
    for category, marks in CATEGORY_MARKS.items():
        out = out.when(contains_any(t, marks), category)
    return out.otherwise("general")


def auto_tag(text: Column, kind: Column) -> Column:
    t = F.lower(text)
    found = [F.when(t.contains(m), m) for m in LANGUAGES + TECHNOLOGIES]
    found += [F.when(contains_any(t, marks), tag) for tag, marks in EXTRA_TAGS.items()]
    return normalize_tags(F.array_compact(F.array(kind, *found)))


def title_of(text: Column) -> Column:
    """The first line that is not blank, cut to 80 characters; Untitled without one."""
    line = F.coalesce(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit("Untitled"))
    return F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 77), F.lit("..."))).otherwise(line)


def keyword_words(text: Column) -> Column:
    """Words of over four characters after lower-casing and dropping what is not a word character."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) > 4)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, query: str, radius: int = 90, plain: int = 200) -> Column:
    """Characters around the first match, with ellipses; the beginning where nothing matches."""
    t, q = squeeze(text), query.strip().lower()
    at = F.instr(F.lower(t), q) - 1
    start = F.greatest(F.lit(0), at - radius)
    end = F.least(F.length(t), at + len(q) + radius)
    cut = F.concat(
        F.when(start > 0, "...").otherwise(""), t.substr(start + 1, end - start), F.when(end < F.length(t), "...").otherwise("")
    )
    return F.when(F.lit(q == "") | (at < 0), F.substring(t, 1, plain)).otherwise(cut)


def strip_tags(html: Column) -> Column:
    return squeeze(F.regexp_replace(html, r"<[^>]+>", " "))


def _texts_of(html: Column, element: str, mark: str) -> Column:
    """html with each element replaced by a line of its mark and its text without markup; by an empty line if there is no text."""
    parts = F.split(F.regexp_replace(html, element, "\x01$1\x01"), "\x01", -1)
    line = lambda inner: F.when(strip_tags(inner) == "", "\n").otherwise(F.concat(F.lit("\n" + mark), strip_tags(inner), F.lit("\n")))
    return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, line(part)).otherwise(part)), "")


def clean_html(html: Column) -> Column:
    """Scripts, styles, navigation, footers and frames dropped; h1-h4 become # headings and li becomes - items, without the markup in them.
    U+0001, which no page shows, is dropped."""
    out = F.translate(html, "\x01", "")
    for tag in ("script", "style", "nav", "footer", "iframe"):
        out = F.regexp_replace(out, rf"(?is)<{tag}.*?</{tag}>", " ")
    for level in range(1, 5):
        out = _texts_of(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "#" * level + " ")
    out = F.regexp_replace(out, r"(?i)</?(ul|ol)[^>]*>", "\n")
    return _texts_of(out, r"(?is)<li[^>]*>(.*?)</li>", "- ")


def markdown_images(text: Column) -> Column:
    """(alt, src) of ![alt](src) images."""
    pattern = F.lit(r"!\[([^\]]*)\]\(([^)]+)\)")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("alt"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("src"))


def html_images(text: Column) -> Column:
    """src of <img> tags."""
    return F.regexp_extract_all(text, F.lit(r"""(?i)<img\s+[^>]*src=["']([^"']+)["'][^>]*>"""), F.lit(1))


def code_blocks(text: Column) -> Column:
    """(language, code) of fenced blocks."""
    pattern = F.lit(r"```(\w+)?\n([\s\S]*?)```")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("language"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("code"))


def slug(text: Column, size: int = 50) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-|-$", "")
    return F.substring(dashed, 1, size)


def normalize_query(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def title_from_path(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), "[-_]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts after trimming and lower-casing, 0 if one is empty, else one minus the edit distance over the longer length."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longer = F.greatest(F.length(x), F.length(y))
    near = (longer - F.levenshtein(x, y)) / longer
    return F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(near)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
