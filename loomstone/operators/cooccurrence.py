"""How many terms two sets share, for a query set of sets against all of them: counted in tiles, so no pair is shuffled to be counted.

Sets come as rows (id, term), terms as 64-bit names that no two terms share (named()). The queries are dealt to parts of about ASKED sets, all
sets to parts of their own; a pair of parts is a cell. A task holds the queries of a cell and lets the other sets pass by in the order of their ids, STEP
at a time, so its memory does not grow with the tables. Shared terms are counted for STEP sets at once: terms that many of the queries hold by a
product of 0/1 matrices, all others by adding up the places where both have the term. A pair is complete within its cell.

The work is that of all pairs, so it grows with the product of both sides; rows grow with what is asked for: all pairs (pairs()),
the heaviest of each query (heaviest_each()) or of all (heaviest()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.scratch import staged

ASKED = 2048
#: Sets of a part at most, and cells that a small table is cut into, as long as a part has STEP sets.
PART, CELLS = 32_768, 48
STEP = 1024
#: Terms of a row that a set is cut into, of a matrix, and places added up at once.
ROW, WIDE, ADD = 512, 1024, 1 << 22
#: A term that one in OFTEN of the queries holds is counted by matrix.
OFTEN = 20
_OUT = "src long, dst long, weight long"


def named(tokens: DataFrame, term: str) -> Column:
    """A 64-bit name of the column `term`, by a seed for which no two terms of `tokens` have the same one."""
    seed = 0
    while True:
        name = F.xxhash64(F.lit(seed), F.col(term))
        low, high = F.min(term).alias("low"), F.max(term).alias("high")
        if tokens.groupBy(name.alias("name")).agg(low, high).filter("low <> high").isEmpty():
            return name
        seed += 1


class _Queries:
    """The queries of a cell and the places of their terms."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> None:
        self.ids = ids
        order = np.argsort(terms, kind="stable")
        self.rows = rows[order]
        self.terms, self.starts, self.held = np.unique(terms[order], return_index=True, return_counts=True)
        self.often = np.flatnonzero(self.held * OFTEN > len(ids))

    def _places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms `at`: which of them, and the queries that hold it, one entry for each."""
        held = self.held[at]
        which = np.repeat(np.arange(len(at)), held)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(held) - held, held)
        return which, self.rows[self.starts[at][which] + inner]

    def shared(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Terms that each query (down) shares with each of the sets `ids` (across); none with itself."""
        n = len(ids)
        counts = np.zeros((len(self.ids), n), np.float32)  # whole numbers below 2**24
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            known = self.terms[at] == terms
            at, rows = at[known], rows[known]
            many = self.held[at] * OFTEN > len(self.ids)
            for i in range(0, len(self.often), WIDE):
                block = self.often[i : i + WIDE]
                which, query = self._places(block)
                left = np.zeros((len(self.ids), len(block)), np.float32)
                left[query, which] = 1
                here = many & (at >= block[0]) & (at <= block[-1])
                right = np.zeros((len(block), n), np.float32)
                right[np.searchsorted(block, at[here]), rows[here]] = 1
                counts += left @ right
            at, rows = at[~many], rows[~many]
            ends = np.cumsum(self.held[at])
            flat, start = counts.reshape(-1), 0
            while start < len(at):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + ADD, "right")))
                which, query = self._places(at[start:stop])
                flat += np.bincount(query * n + rows[start:stop][which], minlength=flat.size).astype(np.float32)
                start = stop
        same, q, s = np.intersect1d(self.ids, ids, return_indices=True)
        counts[q, s] = 0
        return counts


def _batch(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (src, dst, weight)], names=["src", "dst", "weight"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, asked, ids, rows, terms) of whole sets: the queries of a cell at once, the others about STEP at a time."""
    held: list[tuple[int, np.ndarray]] = []
    state: tuple[int, bool] | None = None
    sets = size = 0

    def out():
        ids = np.array([i for i, _ in held], np.int64)
        distinct, rows = np.unique(ids, return_inverse=True)
        return (*state, distinct, np.repeat(rows, [len(t) for _, t in held]), np.concatenate([t for _, t in held]))

    for batch in batches:
        lists = batch.column("terms")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        for k, (cell, other, key) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("cell", "other", "id")], strict=True)):
            new = not held or held[-1][0] != key
            if held and (state != (cell, not other) or (new and other and (sets >= STEP or size >= ADD))):
                yield out()
                held, sets, size, new = [], 0, 0, True
            state = (cell, not other)
            held.append((key, values[offsets[k] : offsets[k + 1]].copy()))
            sets, size = sets + new, size + len(held[-1][1])
    if held:
        yield out()


def _tiles(terms: DataFrame, asked: Column, kept: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """(src, dst, weight) that `kept` leaves of the pairs that share a term."""
    rows = terms.filter(F.col("id").isNotNull()).distinct()
    piece = F.pmod(F.xxhash64("term"), F.ceil(F.count("*").over(Window.partitionBy("id")) / ROW))
    packed = staged(rows.withColumn("piece", piece).groupBy("id", "piece").agg(F.collect_list("term").alias("terms")).select("id", "terms"), "cooccur-sets")
    n, queries = packed.select(F.count_distinct("id"), F.count_distinct(F.when(asked, F.col("id")))).first()
    down = max(1, -(-queries // ASKED))
    across = max(1, -(-n // PART), min(-(-n // STEP), -(-CELLS // down)))

    def part(of: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(of), "id"), F.lit(parts))

    first = part("src", down) * across
    for_queries = F.explode(F.sequence(first, first + across - 1))
    for_others = F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda x: x * across + part("dst", across)))
    one = packed.filter(asked).select(for_queries.alias("cell"), F.lit(False).alias("other"), "id", "terms")
    two = packed.select(for_others.alias("cell"), F.lit(True).alias("other"), "id", "terms")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, add, rest = None, None, None, None
        for at, of_query, ids, rows, values in _grouped(batches):
            if at != cell:
                if rest:
                    yield from rest()
                cell, queries, rest = at, None, None
            if of_query:
                queries = _Queries(ids, rows, values)
                add, rest = kept(queries.ids)
            elif queries:
                yield from add(ids, queries.shared(ids, rows, values))
        if rest:
            yield from rest()

    dealt = one.unionByName(two).repartition(down * across, "cell").sortWithinPartitions("cell", "other", "id")
    return dealt.mapInArrow(count, _OUT)


def pairs(terms: DataFrame, asked: Column) -> DataFrame:
    """(src, dst, weight) of all pairs that share a term. terms: id, term (a 64-bit name); asked: which ids are queries (src)."""

    def kept(src: np.ndarray):
        def add(ids, counts):
            for i in range(0, len(src), 64):
                q, s = np.nonzero(counts[i : i + 64])
                yield _batch(src[q + i], ids[s], counts[q + i, s])

        return add, lambda: ()

    return _tiles(terms, asked, kept)


def heaviest_each(terms: DataFrame, asked: Column, k: int) -> DataFrame:
    """(src, dst, weight, r) of the k heaviest pairs of every query, r from 1; ties go to the smaller dst."""

    def kept(src: np.ndarray):
        best = np.zeros((len(src), k), np.int64)
        who = np.zeros((len(src), k), np.int64)

        def add(ids, counts):  # ids ascend, so an equal weight that comes later loses
            up = np.flatnonzero(counts.max(axis=1, initial=0) > best[:, -1])
            for i in range(0, len(up), 256):
                at = up[i : i + 256]
                weights = np.concatenate((best[at], counts[at].astype(np.int64)), axis=1)
                names = np.concatenate((who[at], np.broadcast_to(ids, (len(at), len(ids)))), axis=1)
                m = weights.shape[1]
                order = weights * m + np.arange(m - 1, -1, -1)
                top = np.argpartition(-order, k - 1, axis=1)[:, :k]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(order, top, axis=1), axis=1), axis=1)
                best[at], who[at] = np.take_along_axis(weights, top, axis=1), np.take_along_axis(names, top, axis=1)
            return ()

        def rest():
            q, s = np.nonzero(best)
            for i in range(0, len(q), 1 << 16):
                x, y = q[i : i + (1 << 16)], s[i : i + (1 << 16)]
                yield _batch(src[x], who[x, y], best[x, y])

        return add, rest

    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return _tiles(terms, asked, kept).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def heaviest(terms: DataFrame, asked: Column, k: int, least: int = 1) -> DataFrame:
    """(src, dst, weight) of the k heaviest pairs of all that share `least` terms or more; ties by src, then dst."""

    def kept(src: np.ndarray):
        best = np.zeros((0, 3), np.int64)

        def add(ids, counts):
            nonlocal best
            low = max(least, best[-1, 0] if len(best) == k else 0)
            if counts.size > k:
                low = max(low, float(np.partition(counts.reshape(-1), counts.size - k)[counts.size - k]))
            q, s = np.nonzero(counts >= low)
            new = np.stack((counts[q, s].astype(np.int64), src[q], ids[s]), axis=1)
            both = np.concatenate((best, new))
            best = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))][:k]
            return ()

        def rest():
            yield _batch(best[:, 1], best[:, 2], best[:, 0])

        return add, rest

    return _tiles(terms, asked, kept).orderBy(F.desc("weight"), "src", "dst").limit(k)
