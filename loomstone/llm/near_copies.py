"""Near copies by exact Jaccard similarity of 5-word shingles: every pair of 0.8 or more is found.

The similarity mode of the SimHash operator. Documents meet on rare shingles instead of segments of their fingerprints, since two texts at a
similarity of 0.8 differ in about 10 of 64 bits, give or take 3; SimHash then links what lies within RADIUS bits, and an exact
check follows. Pairs that its links do not join are found by wider fingerprints, of which a bound is proven.

1. Every text becomes its set of shingle hashes (64 bits), their SimHash and a wider fingerprint: bit b is the parity of the hashes that
   fall on b. Equal sets collapse to one key, so copies are one row from there on.
2. Two sets with similarity of 0.8 or more share at least `spare` of the `prefix` smallest hashes of each. Only those hashes are
   dealt out, once; of a document whose prefix shares too few with any other nothing is left, and of the others the rarest
   hashes are kept that a partner cannot all miss (prefix filter, by count and then by document frequency).
3. Sets that share a kept hash meet in tiles; long lists of one hash are cut into several. Their SimHashes are compared by the operator's
   tile comparison (exclusive-or, bit counts, a spanning forest of each tile pair), and every link is checked on the whole sets.
   For the rest, the wider fingerprints are compared by exclusive-or and bit counts within the radius (|A| + |B|) / 9, beyond which the
   similarity is below 0.8; pairs whose sizes or population counts differ beyond it are skipped. What passes is checked likewise.
4. These further links come in rounds. A round checks a share of each list's pairs (by a hash of the pair, about GROW times as many as the round
   before) of documents that no link joins yet; the last round takes all of them. So a group of n near copies costs rows in
   proportion to n, and no pair that could change a component is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import join_split, plain, staged
from loomstone.llm.components import components
from loomstone.llm.simhash import _compare, majority

SHINGLE = 5
SEED = 42
BITS = 512
#: SimHashes within this many bits are linked: texts at a similarity of 0.8 differ in about 10, unrelated ones in about 32.
RADIUS = 20
#: Documents of a list that meet in one task, and how many of them are compared at once.
TILE = 4096
CHUNK = 256
#: Pairs of a list that the first round checks, for each of its documents, and how many times as many each further round checks.
FIRST = 2
GROW = 8
WORDS = 1 << 19


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of SHINGLE words; a shorter text is one shingle, one without words none."""
    words = (text or b"").lower().split()  # bytes.lower() and bytes.split() know ASCII only
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    if not size:
        return hashes
    found = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - size + 1 + k])
    return np.unique(found)


def _least(n: int) -> int:
    """The smallest size of a set that is 0.8 similar to one of n."""
    return (4 * n + 4) // 5


def _spare(n: int) -> int:
    return max(1, (n - _least(n) + 1) // 4)


def prefix(n: int) -> int:
    """How many of a set's n hashes are dealt out: it shares at least spare(n) of them with any partner."""
    return min(n, n - _least(n) + _spare(n))


def spare(n: int) -> int:
    """How many hashes the prefixes of a set of n and of any partner share at least."""
    return _spare(_least(n))


def _key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)) if len(found) else 0


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield part, [shingles(t) for t in part.column(column).cast(pa.binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _texts(batches, 2):
        parity = [np.packbits((np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes() for s in sets]
        fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        columns = [pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array(parity, pa.binary())]
        columns.append(pa.array([s[: prefix(len(s))].tobytes() for s in sets], pa.binary()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "th", "key", "n", "fp", "bits", "prefix"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _texts(batches, 1):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "hashes"])


def _dealt(buckets: int):
    """Prefix hashes by bucket, packed: a row holds those of many sets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keys, size = part.column(0).to_numpy(), part.column(1).to_numpy()
                parts = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                token = np.concatenate(parts)
                who = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p) for p in parts])
                bucket = (_mix(token) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                token, who = token[order], who[order]
                ids, at = np.unique(bucket[order], return_index=True)
                rows = []
                for a, b in zip(at, [*at[1:], len(token)], strict=True):
                    some, inner = np.unique(who[a:b], return_inverse=True)
                    rows.append((token[a:b].tobytes(), inner.astype(np.uint16).tobytes(), keys[some].tobytes(), size[some].tobytes()))
                columns = [pa.array(ids, pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "tokens", "who", "keys", "sizes"])

    return deal


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, token, df) of the hashes that at least two sets hold; df counts sets."""
    tokens, keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for token, who, key, size in zip(*[batch.column(k).to_pylist() for k in range(1, 5)], strict=True):
            at = np.frombuffer(who, np.uint16)
            tokens.append(np.frombuffer(token, np.int64))
            keys.append(np.frombuffer(key, np.int64)[at])
            sizes.append(np.frombuffer(size, np.int64)[at])
    token, key, size = (np.concatenate(x) for x in (tokens, keys, sizes))
    order = np.lexsort((key, token))
    token, key, size = token[order], key[order], size[order]
    new = np.r_[True, token[1:] != token[:-1]][: len(token)]
    group = np.cumsum(new) - 1
    df = np.bincount(group)[group] if len(token) else token
    first = new | np.r_[True, key[1:] != key[:-1]][: len(token)]
    several = np.bincount(group[first])[group] > 1 if len(token) else new
    take = np.nonzero(first & several)[0]
    for i in range(0, len(take), 1 << 16):
        at = take[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()) for x in (key, size, token, df)], names=["key", "n", "token", "df"])


def _tile_pairs(token: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and where in it each tile pair begins and the last one ends."""
    order = np.lexsort((two, one, token))
    new = (np.diff(token[order]) != 0) | (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    return order, np.r_[0, np.nonzero(new)[0] + 1, len(order)]


def _distinct(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), brought down to distinct ones in pieces."""
    pairs, held = [], 0
    for p in found:
        pairs.append(p)
        held += len(p)
        if held > 1 << 18:
            pairs = [np.unique(np.concatenate(pairs), axis=0)]
            held = len(pairs[0])
            if held > 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0][:, 0]), pa.array(pairs[0][:, 1])], names=["a", "b"])
                pairs, held = [], 0
    if pairs:
        p = np.unique(np.concatenate(pairs), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])


def _forest(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None) -> Iterator[np.ndarray]:
    """Keys of a spanning forest of the SimHashes within RADIUS bits, of two tiles (key, fp) or within one."""
    sides = []
    for key, fp in (left, right or left):
        fps, first, at = np.unique(fp, return_index=True, return_inverse=True)
        sides.append((fps, key[first]))
        if right or len(sides) == 1:
            yield np.stack((key[first][at], key), axis=1)
    (fa, ka), (fb, kb) = sides
    ends = _compare(fa, fb if right else None, RADIUS)
    yield np.stack((ka[np.searchsorted(fa, ends[:, 0])], kb[np.searchsorted(fb, ends[:, 1])]), axis=1)


def _simhash_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that join within each list what lies within RADIUS bits."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    token, one, two, part, key = (t.column(c).to_numpy() for c in ("token", "one", "two", "part", "key"))
    fp = t.column("fp").to_numpy().view(np.uint64)
    order, cuts = _tile_pairs(token, one, two)

    def found() -> Iterator[np.ndarray]:
        size = np.diff(cuts)
        at = cuts[:-1][size == 2]  # most lists
        x, y = order[at], order[at + 1]
        near = np.bitwise_count(fp[x] ^ fp[y]) <= RADIUS
        yield np.stack((key[x[near]], key[y[near]]), axis=1)
        for a, b in zip(cuts[:-1][size > 2], cuts[1:][size > 2], strict=True):
            at = order[a:b]
            if one[at[0]] == two[at[0]]:
                yield from _forest((key[at], fp[at]), None)
                continue
            left, right = at[part[at] == one[at[0]]], at[part[at] == two[at[0]]]
            if len(left) and len(right):
                yield from _forest((key[left], fp[left]), (key[right], fp[right]))

    yield from _distinct(np.sort(p[p[:, 0] != p[:, 1]], axis=1) for p in found())


def _candidates(low: int, high: int):
    """Pairs (a, b) within a list that size and bitmap allow, of different components, whose share of the list is due in this round:
    hash(pair) in [low / df, high / df) of its range."""

    def compare(left, right, df: int, within: bool) -> Iterator[np.ndarray]:
        (ka, na, ra, ba), (kb, nb, rb, bb) = left, right
        order = np.argsort(nb, kind="stable")
        kb, nb, rb, bb = kb[order], nb[order], rb[order], bb[order]
        pops_a, pops_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (ba, bb))
        a_order = np.argsort(na, kind="stable")
        for i in range(0, len(ka), CHUNK):
            at = a_order[i : i + CHUNK]
            lo, hi = np.searchsorted(nb, _least(int(na[at[0]])), "left"), np.searchsorted(nb, 5 * int(na[at[-1]]) // 4, "right")
            if lo >= hi:
                continue
            s = slice(lo, hi)
            small, large = np.minimum(na[at][:, None], nb[None, s]), np.maximum(na[at][:, None], nb[None, s])
            near = (ra[at][:, None] != rb[None, s]) & (5 * small >= 4 * large)
            near &= 9 * np.abs(pops_a[at][:, None] - pops_b[None, s]) <= small + large
            if within:
                near &= ka[at][:, None] < kb[None, s]
            if low or high < df:
                share = (_mix(ka[at][:, None].view(np.uint64) ^ kb[None, s].view(np.uint64)) >> np.uint64(11)).astype(np.float64) * (df / 2.0**53)
                near &= (share >= low) & (share < high)
            x, y = np.nonzero(near)
            x, y = at[x], y + lo
            for j in range(0, len(x), 1 << 16):
                p, q = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
                apart = np.bitwise_count(ba[p] ^ bb[q]).sum(axis=1, dtype=np.int64)
                ok = 9 * apart <= na[p] + nb[q]
                if ok.any():
                    yield np.stack((np.minimum(ka[p[ok]], kb[q[ok]]), np.maximum(ka[p[ok]], kb[q[ok]])), axis=1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        token, one, two, part, df, key, n, root = (t.column(c).to_numpy() for c in ("token", "one", "two", "part", "df", "key", "n", "root"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        order, cuts = _tile_pairs(token, one, two)

        def pairs() -> Iterator[np.ndarray]:
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[a:b]
                if b - a < 2 or (root[at] == root[at[0]]).all():
                    continue
                within = one[at[0]] == two[at[0]]
                sides = [at, at] if within else [at[part[at] == one[at[0]]], at[part[at] == two[at[0]]]]
                left, right = ((key[s], n[s], root[s], bits[s]) for s in sides)
                yield from compare(left, right, int(df[at[0]]), within)

        yield from _distinct(pairs())

    return found


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            left, right = ([np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] for c in (2, 3))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
            yes = pa.array([9 * o >= 4 * (len(x) + len(y)) for o, x, y in zip(both, left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["src", "dst"]).filter(yes)


def _source(docs: DataFrame) -> DataFrame:
    bare, own = plain(docs)
    text = F.col(own["text"]).cast("string")
    return bare.select(F.col(own["doc_id"]).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, th (text hash), and representative, true for the (doc_id, th) that stands for its
    component: the smallest doc_id, nulls last, then the smallest text hash.

    Null, empty and blank texts have no shingles and are copies of each other; a text of fewer than five words is one shingle. Texts
    of any length count whole. Rows equal in doc_id and text are all marked alike. No rows in: no rows out. Other columns, whatever
    their names, are ignored.
    """
    spark = docs.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = _source(docs)
    sketched = staged(source.mapInArrow(_sketch, "doc_id long, th long, key long, n long, fp long, bits binary, prefix binary"), "near-sketch")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("low")
    same = [F.first(c).alias(c) for c in ("n", "fp", "bits", "prefix")]
    distinct = staged(sketched.groupBy("key").agg(head, F.count("*").alias("rows"), *same), "near-distinct")
    sketched = staged(sketched.select("doc_id", "th", "key"), "near-keys", sketched)  # the prefixes are in distinct

    dealt = distinct.select("key", "n", "prefix").mapInArrow(_dealt(2 * deal), "bucket long, tokens binary, who binary, keys binary, sizes binary")
    shared = dealt.repartition(deal, "bucket").mapInArrow(_shared, "key long, n long, token long, df long")
    rows = shared.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    least = F.floor((4 * F.col("n") + 4) / 5)
    need = F.greatest(F.lit(1), F.floor((least - F.floor((4 * least + 4) / 5) + 1) / 4)).cast("int")
    kept = rows.withColumn("need", need).filter(F.size("tokens") >= F.col("need"))
    live = staged(kept.select("key", "n", F.expr("slice(tokens, 1, size(tokens) - need + 1)").alias("tokens")).join(distinct.select("key", "fp", "bits", "low"), "key"), "near-live")
    distinct = staged(distinct.select("key", "rows", "low"), "near-heads", distinct)
    longest = live.agg(F.max(F.expr("array_max(tokens).df"))).first()[0] or 0

    ids = live.select(F.col("key").alias("_key"), F.col("low.doc_id").alias("_id"), F.col("low.th").alias("_th"))
    held = source.join(ids, source["doc_id"].eqNullSafe(ids["_id"]) & (source["th"] == ids["_th"])).select(F.col("_key").alias("key"), "text")
    sets = staged(held.mapInArrow(_sets, "key long, hashes binary").dropDuplicates(["key"]), "near-sets") if longest else None

    roots, edges, low = None, None, 0

    def checked(pairs: DataFrame) -> None:
        """Links of the pairs whose whole sets are similar, and the components with them."""
        nonlocal roots, edges
        left, right = sets.select(F.col("key").alias("a"), F.col("hashes").alias("of_a")), sets.select(F.col("key").alias("b"), F.col("hashes").alias("of_b"))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
        new = staged(met.mapInArrow(_similar, "src long, dst long"), "near-links")
        if not new.isEmpty():
            edges = new if edges is None else edges.unionByName(new)
            roots = staged(components(edges).select(F.col("node").alias("key"), "root"), "near-roots", roots)

    def tiles(listed: DataFrame, *columns: str) -> DataFrame:
        """The rows of every list, once for each pair of tiles that they belong to."""
        parts = F.ceil(F.col("df") / TILE)
        placed = listed.withColumn("part", F.pmod(F.xxhash64("key"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        placed = placed.select("token", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "key", *columns)
        return placed.repartition(deal, "token", "one", "two")

    if longest:
        checked(tiles(live.select("key", "fp", F.inline("tokens")), "fp").mapInArrow(_simhash_links, "a long, b long").distinct())
    while longest > low:
        high = max(FIRST, low * GROW)
        now = live.filter(F.expr(f"array_max(tokens).df > {low}"))
        now = now.withColumn("root", F.col("key")) if roots is None else now.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        listed = now.select("key", "n", "bits", "root", F.inline(F.filter("tokens", lambda t: t["df"] > low)))
        checked(tiles(listed, "df", "n", "root", "bits").mapInArrow(_candidates(low, high), "a long, b long").distinct())
        low = high

    if roots is None:
        label = distinct.select("key", "rows", "low")
    else:
        members = roots.join(distinct.select("key", "low"), "key")
        lows = members.groupBy("root").agg(F.min("low").alias("low"))
        named = roots.join(lows, "root").select("key", F.col("low").alias("joined"))
        label = staged(distinct.select("key", "rows", "low").join(named, "key", "left").select("key", "rows", F.coalesce("joined", "low").alias("low")), "near-labels")
    best = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("th") == F.col("low.th"))
    return join_split(sketched.select("doc_id", "th", "key"), label, ["key"], "rows").select("doc_id", "th", best.alias("representative"))
