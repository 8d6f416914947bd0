"""Filter trees compiled to Column predicates, so that Catalyst pushes them to the scan.

A leaf is {field, operator, value, negate?}; a group is {operator: AND | OR, filters: [...], negate?}; a list is an AND group.
An empty IN list and a BETWEEN without two bounds are left out before negation; groups without filters vanish.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "IN", "CONTAINS", "REGEX", "BETWEEN")
# Filterable fields of a unit.
UNIT_FIELDS = [
    "id", "type", "timestamp", "title", "content", "context", "category", "conversationId", "tags", "keywords", "created",
    "embedding_status",
]
FIELD_ALIASES = {"conversationId": "conversation_id"}
ARRAY_FIELDS = ("tags", "keywords")
#: Operators that a vector store's filter lacks.
NOT_IN_VECTOR_FILTERS = ("CONTAINS", "REGEX", "BETWEEN")


def validate(tree, fields: list[str]) -> list[str]:
    """What is wrong with a tree: unknown fields, operators and group kinds."""
    if isinstance(tree, list):
        return [e for f in tree for e in validate(f, fields)]
    if "filters" in tree:
        kind = [] if tree.get("operator") in ("AND", "OR") else [f"group operator {tree.get('operator')!r}"]
        return kind + [e for f in tree["filters"] for e in validate(f, fields)]
    wrong = [] if tree.get("field") in fields else [f"field {tree.get('field')!r}"]
    return wrong + ([] if tree.get("operator") in OPERATORS else [f"operator {tree.get('operator')!r}"])


def _array_leaf(column: Column, operator: str, value) -> Column | None:
    """Leaves over tags and keywords: an element equals, contains, or is one of the values."""
    if operator == "IN":
        return F.arrays_overlap(column, F.array(*[F.lit(v) for v in value])) if isinstance(value, (list, tuple)) and value else None
    if operator == "=":
        return F.array_contains(column, value)
    if operator == "CONTAINS":
        return F.exists(column, lambda x: x.ilike("%" + str(value).replace("\\", "\\\\") + "%"))
    raise ValueError(f"operator {operator!r} on an array")


def _leaf(leaf: dict) -> Column | None:
    field, operator, value = FIELD_ALIASES.get(leaf["field"], leaf["field"]), leaf["operator"], leaf.get("value")
    column = F.col(field)
    if field in ARRAY_FIELDS:
        return _array_leaf(column, operator, value)
    simple = {"=": column.__eq__, "!=": column.__ne__, ">": column.__gt__, "<": column.__lt__, ">=": column.__ge__, "<=": column.__le__}
    if operator in simple:
        return simple[operator](value)
    if operator == "IN":
        return column.isin(list(value)) if isinstance(value, (list, tuple)) and value else None
    if operator == "BETWEEN":
        return column.between(*value) if isinstance(value, (list, tuple)) and len(value) == 2 else None
    if operator == "CONTAINS":  # LIKE with the user's wildcards
        return column.ilike("%" + str(value).replace("\\", "\\\\") + "%")
    if operator == "REGEX":
        return column.rlike(value)
    raise ValueError(f"operator {operator!r}")


def compile_filter(tree) -> Column | None:
    """The predicate of a tree; None if nothing is left of it."""
    if isinstance(tree, list):
        tree = {"operator": "AND", "filters": tree}
    if "filters" in tree:
        parts = [p for p in map(compile_filter, tree["filters"]) if p is not None]
        if not parts:
            return None
        out = reduce((lambda a, b: a & b) if tree["operator"] == "AND" else (lambda a, b: a | b), parts)
    else:
        out = _leaf(tree)
    return ~out if out is not None and tree.get("negate") else out


def apply_filter(df: DataFrame, tree) -> DataFrame:
    predicate = compile_filter(tree)
    return df if predicate is None else df.filter(predicate)


def page(df: DataFrame, order: list[Column], number: int, size: int, max_window: int = 2000) -> DataFrame:
    """Page `number` (from 1) of the ordered rows."""
    if number < 1 or not 1 <= size <= 100 or number * size > max_window:
        raise ValueError("page out of range")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def parse_relative_date(text: str, now: datetime) -> tuple[datetime, datetime] | None:
    """`last N days|weeks|months|years`, `A to B`, or one ISO date; None if it is none of these."""
    text = text.strip()
    if m := re.fullmatch(r"last\s+(\d+)\s+(day|week|month|year)s?", text, re.I):
        n, unit = int(m[1]), m[2].lower()
        if unit in ("day", "week"):
            return now - timedelta(days=n * (7 if unit == "week" else 1)), now
        months = now.year * 12 + now.month - 1 - n * (12 if unit == "year" else 1)
        first = now.replace(year=months // 12, month=months % 12 + 1, day=1)
        return first + timedelta(days=now.day - 1), now
    if " to " in text:
        a, b = text.split(" to ", 1)
        return datetime.fromisoformat(a.strip()), datetime.fromisoformat(b.strip())
    try:
        day = datetime.fromisoformat(text)
    except ValueError:
        return None
    return day, day


def for_vector_store(tree):
    """The tree without the operators that a vector store's filter lacks; groups that lose everything vanish."""
    if isinstance(tree, list):
        tree = {"operator": "AND", "filters": tree}
    if "filters" in tree:
        kept = [t for t in map(for_vector_store, tree["filters"]) if t is not None]
        return {**tree, "filters": kept} if kept else None
    return None if tree["operator"] in NOT_IN_VECTOR_FILTERS else tree


def preset(name: str, now: datetime) -> list[dict]:
    """A preset's filters with relative dates resolved to epoch seconds before `now`."""

    def resolved(leaf: dict) -> dict:
        if leaf.get("field") != "created":
            return leaf
        start, _ = parse_relative_date(leaf["value"], now)
        return {**leaf, "value": int(start.timestamp())}

    return [resolved(f) for f in PRESETS[name]]


# The built-in presets.
PRESETS = {
    "recent-code": [
        {"field": "category", "operator": "=", "value": "programming"},
        {"field": "type", "operator": "=", "value": "insight"},
        {"field": "created", "operator": ">", "value": "last 30 days"},
    ],
    "unanswered-questions": [{"field": "type", "operator": "=", "value": "question"}],
    "all-decisions": [{"field": "type", "operator": "=", "value": "decision"}],
    "recent-design": [
        {"field": "category", "operator": "=", "value": "design"},
        {"field": "created", "operator": ">", "value": "last 60 days"},
    ],
    "typescript-only": [{"field": "tags", "operator": "CONTAINS", "value": "typescript"}],
    "exclude-incomplete": [{"field": "tags", "operator": "IN", "value": ["draft", "incomplete", "todo"], "negate": True}],
    "react-ecosystem": [
        {"operator": "OR", "filters": [{"field": "tags", "operator": "CONTAINS", "value": tag} for tag in ("react", "typescript", "web")]},
    ],
}
