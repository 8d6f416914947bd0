"""Paths and corrections without bounds on their length."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import graph
from loomstone.operators.spelling import near_distance, osa_distance
from loomstone.queries import search
from loomstone.queries.search import correct


def test_a_long_path_is_found(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(22)] + [("n000", "x"), ("x", "n002"), ("n005", "n003"), ("z", "n000")]
    edges = spark.createDataFrame(chain, "src string, dst string").coalesce(1)
    got = sorted(tuple(r) for r in graph.shortest_path(edges, "n000", "n022").collect())
    assert got == [(i, f"n{i:03}") for i in range(23)]
    assert graph.shortest_path(edges, "n003", "z").collect() == []
    assert [tuple(r) for r in graph.shortest_path(edges, "x", "x").collect()] == [(0, "x")]
    assert graph.shortest_path(edges, "nowhere", "x").collect() == []


def edited(rng, word, edits):
    letters = list(word)
    for _ in range(edits):
        at = int(rng.integers(0, max(len(letters) - 1, 1)))
        kind = rng.integers(4)
        if kind == 0 and len(letters) > 1:
            del letters[at]
        elif kind == 1:
            letters.insert(at, "q")
        elif kind == 2:
            letters[at] = "z"
        else:
            letters[at : at + 2] = letters[at : at + 2][::-1]
    return "".join(letters)


def test_near_distance_is_the_distance_up_to_a_limit():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        a = "".join(rng.choice(list("abc"), rng.integers(0, 9)))
        b = "".join(rng.choice(list("abc"), rng.integers(0, 9))) if rng.random() < 0.4 or len(a) < 6 else edited(rng, a, int(rng.integers(0, 4)))
        for limit in (1, 2, 3):
            assert near_distance(a, b, limit) == min(osa_distance(a, b), limit + 1)


def test_corrections_of_short_and_long_words(spark):
    rng = np.random.default_rng(4)
    terms = ["".join(rng.choice(list("abcde"), n)) for n in (3, 8, 20, 21, 22, 23, 24, 25, 26, 27, 40, 200, 2_000) for _ in range(3)]
    words = sorted({edited(rng, t, k) for t in terms for k in (1, 2, 2, 3)} | {"", "a"})
    frame = spark.createDataFrame([(t, i + 1) for i, t in enumerate(dict.fromkeys(terms))], "term string, frequency long")
    got = {r["word"]: (r["term"], r["distance"]) for r in correct(spark.createDataFrame([(w,) for w in words], "word string"), frame).collect()}
    near = {w: {t: osa_distance(w, t) for t in terms if abs(len(t) - len(w)) <= 2} for w in words if len(w) < 300}
    for w, found in near.items():
        within = {t: d for t, d in found.items() if d <= 2}
        assert (w in got) == bool(within)
        assert not within or (got[w][0] in within and got[w][1] == within[got[w][0]])
    assert all(len(got[w][0]) == 2_000 for w in words if len(w) > 1_900 and w in got) and sum(len(w) > 1_900 for w in got) >= 6


def test_focus_view_stops_at_its_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "f"), ("b", "c"), ("b", "b"), (None, "a"), ("a", "b")], "src string, dst string")

    def view(*args):
        nodes, kept = graph.focus(edges, *args)
        return sorted((r["node"], r["hop"]) for r in nodes.collect()), sorted((r["src"], r["dst"], r["src_hop"], r["dst_hop"]) for r in kept.collect())

    one = [("a", "b", 0, 1), ("a", "b", 0, 1), ("b", "b", 1, 1), ("b", "c", 1, 1), ("c", "a", 1, 0)]
    assert view("a", 1) == ([("a", 0), ("b", 1), ("c", 1)], one)
    assert view("a", 9)[0] == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]  # three hops at most
    assert view("a", 3, 2) == ([("a", 0), ("b", 1)], [("a", "b", 0, 1), ("a", "b", 0, 1), ("b", "b", 1, 1)])
    assert view("a", 3, 1) == ([("a", 0)], [])
    assert view("alone", 2) == ([("alone", 0)], [])
    with pytest.raises(ValueError, match="limit"):
        graph.focus(edges, "a", 1, 0)


def test_links_between_keyword_sets_come_once_for_each_set(spark):
    """Units of equal keywords, queries among them, add no rows, and sets that share several rare words meet once."""
    rng = np.random.default_rng(6)
    sets = [sorted(set(rng.choice(list("abcdefgh"), rng.integers(0, 6)))) for _ in range(60)]
    units = spark.createDataFrame([(i, [*s, *s[:1]]) for i, s in enumerate(sets)], "id int, k array<string>")
    for threshold in (0.3, 0.8):
        got = sorted((tuple(r["k"]), r["n"], round(r["similarity"], 9)) for r in graph.keyword_links(units.filter("id % 2 = 0"), units, "k", threshold).collect())
        want = []
        for a in {tuple(s) for s in sets[::2] if s}:
            near = [s for s in {tuple(s) for s in sets if s} if len({*a} & {*s}) / len({*a} | {*s}) >= threshold - 1e-9]
            want += [(a, sum(tuple(x) == s for x in sets), round(len({*a} & {*s}) / len({*a} | {*s}), 9)) for s in near]
        assert got == sorted(want)


def test_steps_through_edges_that_repeat(spark):
    """Edges need not be distinct, and every step leaves a table, so none is computed again by the next."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        reads.add(1)
        return x

    raw = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "c")], "src string, dst string").coalesce(1)
    edges = raw.select("src", counted("dst").alias("dst"))
    start = spark.createDataFrame([("a",)], "node string")
    got = sorted((r["node"], r["hop"]) for r in graph.neighborhood(edges, start, 3).collect())
    assert got == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("x", 1)] and reads.value <= 3 * 7
    assert sorted(tuple(r) for r in graph.shortest_path(edges, "a", "d").collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_only_pairs_that_may_hold_a_swap_are_compared_in_python(spark, monkeypatch):
    def refuse(a, b, limit):
        raise AssertionError(f"{a} and {b} hold no swap")

    monkeypatch.setattr(search, "near_distance", refuse)
    words = spark.createDataFrame([("abcdefgh",), ("mnopq",)], "word string")
    terms = spark.createDataFrame([("xbcdefgy", 1), ("xycdefwz", 1), ("mnopqrs", 2)], "term string, frequency long")
    assert sorted((r["word"], r["term"], r["distance"]) for r in correct(words, terms).collect()) == [("abcdefgh", "xbcdefgy", 2), ("mnopq", "mnopqrs", 2)]
