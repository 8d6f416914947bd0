"""A clustered vector index: vectors lie in cells around centres, and a search reads only cells that can hold an answer.

Centres are fitted by k-means on a bounded sample; every vector is then assigned to its nearest centre in one scan and written,
a folder for each cell. A cell knows its number of vectors and its radius, the distance of its farthest vector from the centre. By the
triangle inequality no vector of a cell is nearer to a query than distance(query, centre) - radius, so `within` and exact `nearest` skip
cells and still lose nothing; `nearest` with exact=False reads the cells of the nearest `probes` centres only. Cells with many vectors
are split into parts of about PART_ROWS, so one with a third of all vectors does not meet a query in one task.

Vectors that are null, hold nulls or have another number of dimensions than most of the sample have no distance to the others: they are not
indexed, and such queries find nothing. Repeated keys each count. Ties at the last place of a top k go to the smaller key. An empty
table gives an index without cells, in which nothing is found.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.search import squared_distance
from loomstone.scratch import shared_folder, staged

#: Bound of the sample that centres are fitted on, drawn by a hash of the vectors, and of the number of centres.
SAMPLE_ROWS, MAX_CELLS = 16_384, 256
ROUNDS = 10
PART_ROWS = 50_000
#: Allowance for rounding where a bound skips a cell.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """vectors (key, vector, cell, part), cells (cell, n, radius, parts) and the centres, a row for each cell."""

    vectors: DataFrame
    cells: DataFrame
    centres: np.ndarray


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of k-means, started on evenly spaced rows of the distinct sample; a centre without rows stays where it is."""
    rows = np.unique(sample, axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _distances(sample, centres).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _usable(vectors: DataFrame, vector: str, dims: int) -> DataFrame:
    return vectors.filter((F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))


def build(vectors: DataFrame, key: str, vector: str, cells: int | None = None) -> VectorIndex:
    """The index of a table. `cells`: the number of centres, by default the root of the sample's rows, at most MAX_CELLS."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    drawn = plain.filter(F.col("vector").isNotNull()).orderBy(F.xxhash64("vector", "key")).limit(SAMPLE_ROWS)
    sample = [r["vector"] for r in drawn.select("vector").collect()]  # at most SAMPLE_ROWS
    sizes = Counter(len(v) for v in sample if v)
    dims = min(sizes, key=lambda d: (-sizes[d], d)) if sizes else 1
    fit = np.array([v for v in sample if len(v) == dims and all(x is not None and x == x for x in v)], dtype=np.float64).reshape(-1, dims)
    centres = _fit(fit, min(MAX_CELLS, cells or max(1, int(len(fit) ** 0.5)))) if len(fit) else np.zeros((1, dims))

    def assign(batches):
        for batch in batches:
            away = _distances(_matrix(batch.column("vector"), dims), centres)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], ["key", "vector", "cell", "away"])

    kind = plain.schema["key"].dataType.simpleString()
    assigned = staged(_usable(plain, "vector", dims).mapInArrow(assign, f"key {kind}, vector array<double>, cell int, away double"), "vector-cells")
    known = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    known = staged(known.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")), "vector-radii")
    # No more than MAX_CELLS rows of numbers are broadcast.
    split = assigned.join(F.broadcast(known.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    path = f"{shared_folder(spark)}/vector-index-{assigned.inputFiles()[0].rsplit('vector-cells-', 1)[1].split('/')[0]}" if not assigned.isEmpty() else None
    held = split.select("key", "vector", "part", "cell")
    if path:
        held.repartition("cell", "part").write.partitionBy("cell").parquet(path)
        held = spark.read.schema(held.schema).parquet(path)
    return VectorIndex(held, known, centres)


def _visits(index: VectorIndex, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """(query, target, cell, gap, rank): every query with each cell, the distance of its centre and the cell's place by that distance.

    A row for each query and centre, so no more than MAX_CELLS a query; the vectors themselves are not touched."""
    dims, centres = index.centres.shape[1], index.centres
    asked = _usable(queries.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("target")), "target", dims)

    def near(batches):
        for batch in batches:
            gaps = _distances(_matrix(batch.column("target"), dims), centres)
            order = np.argsort(gaps, axis=1, kind="stable")
            lists = [pa.array(list(m)) for m in (order.astype(np.int32), np.take_along_axis(gaps, order, axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("target"), *lists], ["query", "target", "cells", "gaps"])

    kind = asked.schema["query"].dataType.simpleString()
    found = asked.mapInArrow(near, f"query {kind}, target array<double>, cells array<int>, gaps array<double>")
    met = found.select("query", "target", F.posexplode(F.arrays_zip("cells", "gaps")).alias("rank", "at")).select("query", "target", F.col("at.cells").alias("cell"), F.col("at.gaps").alias("gap"), "rank")
    return met.join(F.broadcast(index.cells), "cell")


#: Targets that a row of a cell's visits holds, and vectors that they meet at once.
TARGETS, BLOCK = 256, 1024


def _compared(index: VectorIndex, visits: DataFrame, keep: float | int) -> DataFrame:
    """(query, key, distance): squared distances of the visits' queries from the vectors of their cells that can matter.

    keep: a float, distances below it; an int k, the k smallest of a query in each task, ties by key. The visits of a cell are packed,
    TARGETS in a row, and meet its vectors, BLOCK in a row, so a matrix product finds what is near; whatever it leaves within its rounding is
    computed again in the order of the dimensions.
    """
    dims = index.centres.shape[1]
    deal = F.pmod(F.xxhash64("query"), F.ceil(F.col("n") / TARGETS))
    sizes = visits.groupBy("cell").agg(F.count("*").alias("n"))
    # No more than MAX_CELLS rows of numbers are broadcast.
    asked = visits.drop("n").join(F.broadcast(sizes), "cell").withColumn("pack", deal)
    asked = asked.groupBy("cell", "pack", "parts").agg(F.collect_list(F.struct("query", "target")).alias("asked"))
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("asked.query").alias("queries"), F.flatten("asked.target").alias("targets"))
    blocks = index.cells.select("cell", F.ceil(F.col("n") / F.col("parts") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit("block"), "key"), F.col("blocks")).alias("block")
    held = index.vectors.join(F.broadcast(blocks), "cell").groupBy("cell", "part", block).agg(F.collect_list(F.struct("key", "vector")).alias("held"))
    held = held.select("cell", "part", F.col("held.key").alias("keys"), F.flatten("held.vector").alias("vectors"))
    met = held.join(asked, ["cell", "part"]).select("keys", "vectors", "queries", "targets")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, queries = (batch.column(c)[i].values for c in ("keys", "queries"))
                rows, targets = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dims) for c in ("vectors", "targets"))
                near = (targets**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :] - 2 * targets @ rows.T
                slack = 1e-9 * (1 + (targets**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1).max())
                if isinstance(keep, int):
                    limit = np.partition(near, min(keep, len(keys)) - 1, axis=1)[:, min(keep, len(keys)) - 1 :][:, :1] + slack
                else:
                    limit = keep + slack
                q, r = np.nonzero(near <= limit)
                apart = np.zeros(len(q))
                for d in range(dims):
                    apart += (rows[r, d] - targets[q, d]) ** 2
                if isinstance(keep, int) and len(q):  # of copies no more than k stay
                    rank = np.empty(len(keys), np.int64)
                    rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                    order = np.lexsort((rank[r], apart, q))
                    q, r, apart = q[order], r[order], apart[order]
                    first = np.searchsorted(q, q)
                    stay = np.arange(len(q)) - first < keep
                    q, r, apart = q[stay], r[stay], apart[stay]
                for j in range(0, len(q), 1 << 16):
                    at = slice(j, j + (1 << 16))
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(q[at])), keys.take(pa.array(r[at])), pa.array(apart[at])], ["query", "key", "distance"])

    kinds = {c: met.schema[c].dataType.elementType.simpleString() for c in ("queries", "keys")}
    # A row holds up to BLOCK vectors and TARGETS targets, so few of them go to Python at once.
    return met.mapInArrow(compare, f"query {kinds['queries']}, key {kinds['keys']}, distance double")


def within(index: VectorIndex, queries: DataFrame, key: str, vector: str, below: float) -> DataFrame:
    """(query, key, distance): all vectors at a squared distance of less than `below` from a query. Exact."""
    visits = _visits(index, queries, key, vector).filter(F.col("gap") - F.col("radius") <= below**0.5 + SLACK)
    return _compared(index, visits, float(below)).filter(F.col("distance") < below)


def nearest(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """(query, key, distance, place): the k nearest vectors of each query, places from 1.

    The first pass reads the cells of the nearest `probes` centres. If exact, a second one reads all other cells that can hold a vector
    as near as the k-th found so far; all cells, where the first pass found fewer than k. Query keys must identify a query.
    """
    order = Window.partitionBy("query").orderBy("distance", "key")

    def top(df: DataFrame) -> DataFrame:
        return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)

    visits = _visits(index, queries, key, vector)
    first = top(_compared(index, visits.filter(F.col("rank") < probes), k))
    if not exact:
        return first
    first, visits = staged(first, "vector-first"), staged(visits.filter(F.col("rank") >= probes), "vector-visits")
    limit = first.filter(F.col("place") == k).select("query", F.sqrt("distance").alias("limit"))
    rest = visits.join(limit, "query", "left").filter(F.col("limit").isNull() | (F.col("gap") - F.col("radius") <= F.col("limit") + SLACK))
    return top(first.drop("place").unionByName(_compared(index, rest, k)))
