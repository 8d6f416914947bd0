"""SimHash near-duplicate detection by tiled exact comparison.

1. Every document gets a 64-bit SimHash of its 3-word shingles (XXH64, seed 42), computed in Arrow batches.
2. Equal fingerprints collapse to one row that keeps the smallest doc_id, so a group of copies of any size is
   one row from here on; only distinct fingerprints are compared.
3. Two fingerprints within `radius` bits agree in full on at least one of radius + 1 bit segments. Fingerprints
   that share a segment meet in a block; a block is cut into tiles of at most TILE fingerprints, ordered by
   population count. Tile pairs whose population counts differ by more than `radius` are skipped, since
   |popcount(a) - popcount(b)| <= hamming(a, b); the others are compared in full with numpy exclusive-or and bit
   counts. No pair within the radius is lost. A block with many tiles becomes many tasks, one for each tile pair.
4. Each tile pair returns a spanning forest of its links, never all pairs, and components follow from
   alternating large-star and small-star rounds over those edges, staged in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import join_split, plain, staged
from loomstone.llm.components import components, keep_representatives

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints in a tile: a pair of tiles compares 2**24 fingerprints, CHUNK rows at a time.
TILE = 4096
CHUNK = 256


def _shingle_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()  # bytes.lower() and bytes.split() know ASCII only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - SHINGLE] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes: bit b is 1 if it is set in over half of them; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None) -> int:
    """SimHash of a text's shingles; 0 for no words."""
    return majority(_shingle_hashes(text or b""))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            texts = part.column(2).cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values)], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) of every row: th is a hash of the text that tells rows of one doc_id apart, fp holds the 64 bits
    as a signed long."""
    bare, own = plain(docs)
    text = F.col(own["text"]).cast("string")
    source = bare.select(F.col(own["doc_id"]).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return source.mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def _segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 segments that cover 64 bits."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """A spanning forest (n x 2) of the links between two tiles, or within `left` if `right` is None.

    Both tiles are ordered by population count, and CHUNK rows of one meet only the slice of the other whose counts lie
    within the radius. Each row's neighbours are merged by label, so the links of a tile of copies are never listed.
    """
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    if right is None:
        right, offset, nodes = left, 0, left
    else:
        right = right[np.argsort(np.bitwise_count(right), kind="stable")]
        offset, nodes = len(left), np.concatenate((left, right))
    labels, found = np.arange(len(nodes)), []
    pops = np.bitwise_count(right).astype(np.int64)
    for i in range(0, len(left), CHUNK):
        rows = left[i : i + CHUNK]
        own = np.bitwise_count(rows).astype(np.int64)
        lo, hi = np.searchsorted(pops, own[0] - radius, "left"), np.searchsorted(pops, own[-1] + radius, "right")
        near = np.bitwise_count(rows[:, None] ^ right[None, lo:hi]) <= radius
        for k in np.nonzero(near.sum(axis=1) > (offset == 0))[0]:
            nb = np.nonzero(near[k])[0] + lo + offset
            groups, at = np.unique(labels[nb], return_index=True)
            new = groups != labels[i + k]
            if new.any():
                found += [(nodes[i + k], nodes[nb[j]]) for j in at[new]]
                labels[np.isin(labels, groups)] = labels[i + k]
    return np.array(found, np.uint64).reshape(-1, 2)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst) edges that join every pair of distinct fingerprints within `radius` bits, directly or through others.

    distinct: one column fp, without repeats.
    """
    segments = F.array(
        *[
            F.struct(F.lit(k).alias("segment"), F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1).alias("value"))
            for k, (shift, width) in enumerate(_segments(radius))
        ]
    )
    members = distinct.select("fp", F.inline(segments)).withColumn("pop", F.bit_count("fp"))
    # A block's tiles: its members by population count, TILE of them each. Counts by (block, pop) are few rows, and
    # the place within one population count comes from a hash, so that no window spans a whole block.
    block = ["segment", "value"]
    counts = members.groupBy(*block, "pop").count()
    counts = counts.withColumn("parts", F.ceil(F.col("count") * 1.25 / TILE).cast("int"))
    sums = counts.withColumn("members", F.sum("count").over(Window.partitionBy(*block)))
    small, large = sums.filter((F.col("members") <= TILE) & (F.col("members") > 1)), sums.filter(F.col("members") > TILE)
    one = (
        members.join(small.select(*block).distinct(), block, "left_semi")
        .select(F.concat_ws("_", "segment", "value").alias("pair"), F.lit(True).alias("first"), F.lit(True).alias("second"), "fp")
    )
    # Large blocks: a tile is (block, pop, part); each is sent to every tile pair that it belongs to.
    tiles = large.select(*block, "pop", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = tiles.select(*block, F.col("pop").alias("pop2"), F.col("part").alias("part2"))
    pairs = tiles.join(other, block).filter(
        F.col("pop2").between(F.col("pop"), F.col("pop") + radius) & ((F.col("pop2") > F.col("pop")) | (F.col("part2") >= F.col("part")))
    )
    pair = F.concat_ws("_", *block, "pop", "part", "pop2", "part2")
    same = (F.col("pop") == F.col("pop2")) & (F.col("part") == F.col("part2"))
    yes, no = F.lit(True), F.lit(False)
    sides = (
        pairs.select(*block, "pop", "part", pair.alias("pair"), yes.alias("first"), same.alias("second"))
        .unionByName(
            pairs.filter(~same).select(
                *block, F.col("pop2").alias("pop"), F.col("part2").alias("part"), pair.alias("pair"), no.alias("first"), yes.alias("second")
            )
        )
    )
    placed = members.join(large.select(*block, "pop", "parts"), [*block, "pop"]).withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    )
    many = placed.join(sides, [*block, "pop", "part"]).select("pair", "first", "second", "fp")

    def compare(tile: pa.Table) -> pa.Table:
        fp = tile.column("fp").to_numpy().view(np.uint64)
        first, second = (tile.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second"))
        ends = _compare(fp[first], None if (first & second).all() else fp[second], radius).view(np.int64)
        return pa.table({"src": pa.array(ends[:, 0]), "dst": pa.array(ends[:, 1])})

    # A number of partitions of its own: these rows are few bytes and much work, and would be gathered into one task.
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = one.unionByName(many).repartition(n, "pair")
    return tiles.groupBy("pair").applyInArrow(compare, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: doc_id, th, fp, component_id (the smallest doc_id of its component), and
    representative, true for the (doc_id, th) that stands for the component.

    Null and blank texts have fingerprint 0 and link like any other. Rows with equal doc_id each keep a row. A null
    doc_id keeps its row and never names a component: component_id is null where no other doc_id is reachable. The
    representative is the row with the smallest doc_id, nulls last, then the smallest text hash; rows equal in both are
    all marked. Texts of any length are hashed whole. No rows in: no rows out. Other columns, whatever their names, are ignored.
    """
    hashed = staged(fingerprints(docs), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("low")
    distinct = staged(hashed.groupBy("fp").agg(first, F.count("*").alias("n")), "simhash-distinct")
    roots = staged(components(links(distinct.select("fp"), radius)), "simhash-roots")
    members = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "low")
    lows = members.groupBy("root").agg(F.min("low").alias("low"))
    named = members.select("fp", "root").join(lows, "root").select("fp", F.col("low").alias("joined"))
    label = staged(distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("joined", "low").alias("low")), "simhash-labels")
    return join_split(hashed, label, ["fp"], "n").select(
        "doc_id",
        "th",
        "fp",
        F.col("low.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("th") == F.col("low.th"))).alias("representative"),
    )


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, jaccard: bool = False) -> DataFrame:
    """docs without near-duplicates: the representative of every component stays, with all columns of docs.

    With jaccard, documents are linked whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more (near_copies: SimHash
    by the same tile comparison and a check of the whole sets, then wider fingerprints for the pairs that it does not join). Of rows that repeat the
    representative's doc_id and text one stays, the one with the smallest hash of the whole row. The cases of near_duplicates() hold.
    """
    from loomstone.llm import near_copies  # which builds on this module

    return keep_representatives(docs, near_copies.near_duplicates(docs) if jaccard else near_duplicates(docs, radius))
