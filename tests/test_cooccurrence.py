"""Shared terms in tiles against plain sets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import loomstone.queries  # noqa: F401  registers the queries
from loomstone import registry
from loomstone.operators import cooccurrence


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    found = {i: {*rng.sample(common, 12), *(f"r{rng.randrange(400)}" for _ in range(25))} for i in range(0, 1500, 3)}
    return found | {1500: {f"x{i}" for i in range(1800)} | set(common), 1530: {f"x{i}" for i in range(0, 1800, 2)}, -50: {"c1"}, 1600: {"alone"}}


@pytest.fixture(scope="module")
def terms(spark, sets):
    rows = [(i, t) for i, held in sets.items() for t in sorted(held)]
    table = spark.createDataFrame([*rows, *rows[:50], (None, "c1"), (None, "c2")], "id long, word string")
    return table.select("id", cooccurrence.named(table, "word").alias("term"))


@pytest.fixture(scope="module")
def plain(sets):
    shared = ((a, b, len(sets[a] & sets[b])) for a in sets if a % 50 == 0 for b in sets if a != b)
    return [p for p in shared if p[2]]


@pytest.mark.parametrize("asked, part", [(2048, 32_768), (4, 60)])
def test_pairs_and_the_heaviest_are_the_plain_ones(monkeypatch, terms, plain, asked, part):
    monkeypatch.setattr(cooccurrence, "ASKED", asked)
    monkeypatch.setattr(cooccurrence, "PART", part)
    queries = F.col("id") % 50 == 0
    got = [tuple(r) for r in cooccurrence.pairs(terms, queries).collect()]
    assert sorted(got) == sorted(plain)
    assert [tuple(r) for r in cooccurrence.heaviest(terms, queries, 40, least=3).collect()] == sorted((p for p in plain if p[2] >= 3), key=lambda p: (-p[2], p[0], p[1]))[:40]
    want = set()
    for src in {p[0] for p in plain}:
        best = sorted((p for p in plain if p[0] == src), key=lambda p: (-p[2], p[1]))[:7]
        want |= {(*p, r) for r, p in enumerate(best, 1)}
    got = cooccurrence.heaviest_each(terms, queries, 7).select("src", "dst", "weight", "r").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pairs_are_not_shuffled(terms):
    plan = cooccurrence.pairs(terms, F.col("id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("MapInArrow", 1)[0].count("Exchange") == 0


def test_nothing_asked_or_there(spark, terms):
    assert cooccurrence.pairs(terms, F.col("id") == 7).count() == 0
    empty = spark.createDataFrame([], "id long, term long")
    assert cooccurrence.heaviest(empty, F.col("id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("name", ["gr_cooccur_network", "join_cooccur", "win_cooccur_top100"])
def test_every_thread_is_asked(spark, tmp_path, name):
    rng = random.Random(8)
    turns = [(1 + i % 40, i // 40, "user", " ".join(f"w{rng.randrange(25)}" for _ in range(6))) for i in range(80)]
    turns += [(7, 0, "user", "w1 w2"), (7, 0, "user", "w1 w2"), (None, 1, "user", "w1 w2 w3"), (-50, 1, "user", "w1 w2 W3"), (99, 1, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    held: dict[int, set[str]] = {}
    for thread, _, _, text in turns:
        if thread is not None and text:
            held.setdefault(thread, set()).update(text.lower().split())
    plain = [(a, b, len(held[a] & held[b])) for a in held for b in held if a != b and held[a] & held[b]]
    ranked = [(a, b, r) for a in held for r, (_, _, b) in enumerate(sorted((-w, src, dst) for src, dst, w in plain if src == a), 1) if r <= 100]
    want = {"join_cooccur": plain, "win_cooccur_top100": ranked, "gr_cooccur_network": sorted((p for p in plain if p[2] >= 2), key=lambda p: (-p[2], p[0], p[1]))[:200]}[name]
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 150 and any(p[0] % 50 for p in want)
