"""The clustered vector index against plain numpy: exact searches lose nothing, and a few probes reach the stated recall."""

from __future__ import annotations

import numpy as np
import pytest

import loomstone.queries  # noqa: F401  registers the queries
from loomstone import registry
from loomstone.operators import vector_index


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 8))
    rows = np.concatenate([middles[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 8)), np.repeat(middles[:1], 300, axis=0)])
    return np.round(rows, 3)


@pytest.fixture(scope="module")
def table(spark, points):
    odd = [(5000, None), (5001, [1.0]), (5002, [None] * 8), (5003, [float("nan")] * 8)]
    return spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(points)], *odd], "id long, v array<double>")


@pytest.fixture(scope="module", params=[50_000, 40])
def index(request, table):
    kept, vector_index.PART_ROWS = vector_index.PART_ROWS, request.param
    yield vector_index.build(table, "id", "v")
    vector_index.PART_ROWS = kept


def distances(points):
    return ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)


def test_every_usable_vector_is_indexed_once(index, points):
    assert sorted(r["key"] for r in index.vectors.select("key").collect()) == list(range(len(points)))


def test_within_and_exact_top_k_equal_brute_force(index, table, points):
    d, asked = distances(points), table.filter("id % 60 = 0 or id >= 5000")
    got = {(r["query"], r["key"]) for r in vector_index.within(index, asked, "id", "v", 0.5).collect()}
    assert got == {(q, k) for q in range(0, len(points), 60) for k in np.flatnonzero(d[q] < 0.5).tolist()}
    found = vector_index.nearest(index, asked, "id", "v", 5, probes=1).collect()
    assert {(r["query"], r["place"]): r["key"] for r in found} == {(q, n + 1): int(k) for q in range(0, len(points), 60) for n, k in enumerate(np.lexsort((np.arange(len(points)), np.round(d[q], 9)))[:5])}


def test_probes_reach_the_recall(index, table, points):
    d, asked = distances(points), table.filter("id % 60 = 0")
    far = {q: np.sort(d[q])[9] + 1e-9 for q in range(0, len(points), 60)}
    found = vector_index.nearest(index, asked, "id", "v", 10, exact=False).collect()
    assert sum(r["distance"] <= far[r["query"]] for r in found) / (10 * len(far)) >= 0.9


def test_no_vectors(spark, table):
    empty = vector_index.build(table.filter("id < 0"), "id", "v")
    assert vector_index.nearest(empty, table, "id", "v", 3).count() == 0
    assert vector_index.within(vector_index.build(table, "id", "v"), table.filter("id < 0"), "id", "v", 1.0).count() == 0


def test_vectors_meet_queries_in_blocks(spark):
    rng = np.random.default_rng(8)
    rows = np.concatenate([np.repeat(rng.normal(size=(1, 5)), 1500, axis=0), rng.normal(size=(700, 5))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>")
    index, asked = vector_index.build(table, "id", "v", cells=6), table.filter("id % 100 = 0")
    found = vector_index.within(index, asked, "id", "v", 0.8)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each pair that is compared
    d = distances(rows)
    assert {(r["query"], r["key"]) for r in found.collect()} == {(q, int(k)) for q in range(0, len(rows), 100) for k in np.flatnonzero(d[q] < 0.8)}
    got = {(r["query"], r["place"]): r["key"] for r in vector_index.nearest(index, asked, "id", "v", 4, probes=2).collect()}
    assert got == {(q, n + 1): int(k) for q in range(0, len(rows), 100) for n, k in enumerate(np.lexsort((np.arange(len(rows)), np.round(d[q], 12)))[:4])}


def test_every_vector_is_asked(spark, tmp_path):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(60, 8)).repeat(3, axis=0) + rng.normal(size=(180, 8)) * 0.1
    rows = [(i + 1, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)] + [(7, [0.0] * 8, 0), (8, None, 0), (None, [0.0] * 8, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    usable = [(a, np.array(v)) for a, v, _ in rows if a is not None and v]
    want = sorted((a, b, float(((v - w) ** 2).sum())) for a, v in usable for b, w in usable if a != b and ((v - w) ** 2).sum() < 1.0)
    got = sorted(tuple(r) for r in registry.QUERIES["join_pairwise_sim"](spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and any(b % 50 for _, b, _ in want)
    assert all(g[2] == pytest.approx(w[2], abs=2e-6) for g, w in zip(got, want, strict=True))
