"""The full-text index and its query language against plain versions."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import fulltext
from loomstone.operators.fulltext import Leaf, QueryError, parse

WORDS = "the general public license gnu licensed licence a b ab é naïve".split()


def texts():
    rng = np.random.default_rng(2)
    made = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 25))), str(rng.choice(["src0", "src1 b"]))) for i in range(120)]
    return [*made, (200, None, None), (201, "", "src0"), (202, "General-Public, LICENSE! general public", None), (203, "the " * 3000 + "end", "src1")]


def cut(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def count(leaf, fields):
    n = 0
    for name, words in fields.items():
        if leaf.field in (None, name):
            for i in range(len(words) - len(leaf.words) + 1):
                here = words[i : i + len(leaf.words)]
                n += tuple(here[:-1]) == leaf.words[:-1] and (here[-1].startswith(leaf.words[-1]) if leaf.prefix else here[-1] == leaf.words[-1])
    return n


def plain(query):
    tree = parse(query)
    asked = fulltext.leaves(tree)
    rows = {i: {"text": cut(t), "source": cut(s)} for i, t, s in texts()}
    size = {i: sum(map(len, f.values())) for i, f in rows.items()}
    mean = sum(size.values()) / len(size)
    tf = {i: [count(leaf, f) for leaf in asked] for i, f in rows.items()}
    df = [sum(t[k] > 0 for t in tf.values()) for k in range(len(asked))]

    def fits(q, t):
        if isinstance(q, Leaf):
            return t[asked.index(q)] > 0
        a, b = fits(q[1], t), fits(q[2], t)
        return {"AND": a and b, "OR": a or b, "NOT": a and not b}[q[0]]

    def score(i):
        return sum(math.log(1 + (len(rows) - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / mean)) for f, d in zip(tf[i], df, strict=True))

    return {i: round(score(i), 9) for i in rows if fits(tree, tf[i])}


@pytest.fixture(scope="module", params=[50_000, 7])
def index(spark, request, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fulltext, "FOLDER_ROWS", request.param)  # few folders, or many with spread terms
        rows = spark.createDataFrame(texts(), "id long, text string, source string").repartition(3)
        fulltext.build(rows, "id", {"text": F.col("text"), "source": F.col("source")}, path)
    return path


@pytest.mark.parametrize(
    "query",
    [
        "license", "the license", "License AND gnu", "gnu OR licence", "license NOT gnu", '"general public"', '"general public license"', '"the the"', "licen*", "l*",
        '"public lic" *', "source:src0", "source:b", "text:b license", "(gnu OR licence) a NOT ab", 'gnu OR "a b" OR source:src1', "missing", "missing OR gnu", "é naïve", "gnu gnu",
    ],
)
def test_queries_are_the_plain_ones(spark, index, query):
    got = {r["key"]: round(r["score"], 9) for r in fulltext.matches(spark, index, query).collect()}
    assert got == plain(query)


def test_only_the_terms_folders_are_read(spark, index):
    plan = fulltext.matches(spark, index, 'gnu OR "public license"')._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" not in plan and "EqualTo(term,gnu)" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan)
    folders = fulltext.postings_of(spark, index, [Leaf(("gnu",))], spark.read.parquet(f"{index}/stats").first()["folders"]).select("folder").distinct().count()
    assert folders == 1


@pytest.mark.parametrize("text", ["", "a AND", "AND a", "(a", "a)", '"open', "what?", "a-b", "x:", '""', "a OR", "NOT a", "* a", "a ** b", "field:AND"])
def test_what_is_no_query(text):
    with pytest.raises(QueryError):
        parse(text)


def test_unknown_fields_are_no_query(spark, index):
    with pytest.raises(QueryError):
        fulltext.matches(spark, index, "title:gnu")


def test_precedence():
    a, b, c, d = (Leaf((x,)) for x in "abcd")
    assert parse("a OR b c NOT d") == ("OR", a, ("AND", b, ("NOT", c, d)))
    assert parse("(a OR b) AND c") == ("AND", ("OR", a, b), c)
    assert parse('t:"A b"*') == Leaf(("a", "b"), "t", True)


def test_an_index_of_nothing(spark, tmp_path):
    fulltext.build(spark.createDataFrame([], "id long, text string"), "id", {"text": F.col("text")}, str(tmp_path))
    assert fulltext.matches(spark, str(tmp_path), "a OR b*").collect() == []


def test_building_holds_pieces_of_bounded_length(spark, tmp_path, monkeypatch):
    rows = [(7, "a b a " * 700, "s a"), (8, "a " * 128, None), (9, None, "b"), (7, "b", "s"), (10, "", "")]
    seen = []
    kept = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, *a, **k: seen.append(self) or kept(self, *a, **k))
    table = spark.createDataFrame(rows, "id long, text string, source string").coalesce(1)
    fulltext.build(table, "id", {"text": F.col("text"), "source": F.col("source")}, str(tmp_path))
    assert max(seen[0].agg(F.max(F.size("words"))).first()) == fulltext.SLICE
    found = fulltext._postings(spark, str(tmp_path)).collect()
    want = []
    for i, text, source in rows:
        words = {"text": (text or "").split(), "source": (source or "").split()}
        for f, held in words.items():
            want += [(i, w, f, [k for k, x in enumerate(held) if x == w], sum(map(len, words.values()))) for w in set(held)]
    assert sorted((r["key"], r["term"], r["field"], r["places"], r["len"]) for r in found) == sorted(want)
