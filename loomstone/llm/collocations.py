"""Phrase collocation mining by SETM: set-oriented relations of occurrences that grow by one word a pass.

R1 is the relation of word occurrences, sorted by place, with a gap after each piece (the text between two of `.,;:!?` or line
ends). A pass from length k to k + 1

* counts the groups of R_k exactly and keeps those with `least` occurrences (group-count);
* semi-joins R_k with the frequent groups;
* merge-joins what is left with itself on adjacent places: the phrases at places p and p + 1 overlap in all but their ends, so they
  give the phrase of k + 1 words at p. A phrase is as rare as its rarest part, so no frequent phrase is lost.

Relations are persisted by chunks (documents of one language, CHUNK words or a few more): the occurrences of a chunk as an array sorted by
place, and its distinct phrases with their counts. So a chunk adds one row for each of its phrases to a
group-count, however often they occur; of a phrase's rows none is more than one in the number of phrases of a chunk, whatever its share of all
words. Frequent phrases come back to their chunks by the chunk's number. A phrase is named by its first dictionary place, so names are exact.

Both arrays are cut into rows of a bounded length that lie in small row groups, and frequent phrases are packed and sorted to their chunks, so
no task of the JVM holds a chunk's phrases as objects or more than a few rows of arrays, however many phrases are frequent.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import column_or_null, plain, release, staged

#: Words after which a chunk is closed, at the next end of a piece.
CHUNK = 1 << 19
#: Phrases, and occurrences, in a row of a relation, rows that Python returns at once, and MB of a row group of a relation's table.
PHRASES, OCCURRENCES, ROWS, GROUP_MB = 1 << 13, 1 << 16, 16, 4
#: Frequent phrases of all chunks that are packed by chunk at a time.
PACK = 1 << 20
#: Languages whose chunks a task keeps open, and bytes of a text that are split into words at a time.
OPEN = 64
SLICE = 1 << 20
LONGEST = 3
LEAST = 10
#: A phrase goes if a longer one that holds it has this many hundredths of its occurrences.
INSIDE = 50
TOP = 2000
#: Parts in which a language's phrases are ranked before the best of each part are ranked together.
RANK_PARTS = 256

_TO_PIECES = bytes(10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of occurrences have ids, rows of phrases counts and the arrays that name them; at is the place of the row's first one in its chunk.
_RELATION = "chunk long, at int, ids array<int>, counts array<int>"


class _Numbers(dict):
    """Numbers words as they come; 0 and 1 are the empty word and the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Chunk:
    def __init__(self) -> None:
        self.numbers, self.parts, self.size = _Numbers({b"": 0, b"\n": 1}), [], 0

    def add(self, text: bytes) -> None:
        parts = text.replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.numbers.__getitem__, parts), np.int32, len(parts)) - 2
        found = found[found > -2]
        self.parts.append(found)
        self.size += len(found)

    def rows(self, number: int, lang: str) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids[ids >= 0], minlength=len(self.numbers) - 2).astype(np.int32)
        words = pa.array(list(self.numbers)[2:], pa.binary()).cast(pa.string())
        n = int(counts.sum())
        for batch in _relation_rows(number, ids, counts, words=words):
            at = batch.column("at").to_numpy()
            sizes = pa.array([n if i == 0 and v else None for i, v in zip(at, batch.column("ids").is_valid().to_pylist(), strict=True)], pa.int64())
            yield batch.append_column("lang", pa.array([lang] * len(at), pa.string())).append_column("n", sizes)


def _lists(values: np.ndarray | pa.Array, size: int) -> pa.ListArray:
    """values in lists of `size`."""
    ends = np.minimum(np.arange(-(-len(values) // size) + 1) * size, len(values))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _relation_rows(number: int, ids: np.ndarray, counts: np.ndarray, **keys: np.ndarray | pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk's occurrences, then those of its phrases."""
    held = {"ids": _lists(ids, OCCURRENCES), **{name: _lists(values, PHRASES) for name, values in {"counts": counts, **keys}.items()}}
    for size, own in ((OCCURRENCES, ["ids"]), (PHRASES, ["counts", *keys])):
        for start in range(0, len(held[own[0]]), ROWS):
            n = len(held[own[0]][start : start + ROWS])
            lists = [values[start : start + n] if name in own else pa.nulls(n, values.type) for name, values in held.items()]
            columns = [pa.array([number] * n, pa.int64()), pa.array((np.arange(n) + start) * size, pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "at", *held])


def _slices(text: bytes) -> Iterator[bytes]:
    """The translated text in slices that end after a blank or the end of a piece."""
    at = 0
    while at + SLICE < len(text):
        ends = [e for e in (text.find(b"\n", at + SLICE), text.find(b" ", at + SLICE)) if e >= 0]
        if not ends:
            break
        yield text[at : min(ends) + 1]
        at = min(ends) + 1
    yield text[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to chunks. Chunk numbers lie so far apart that number + place in the chunk's dictionary is unique."""
    number = TaskContext.get().partitionId() << 40
    opened: dict[str, _Chunk] = {}

    def closed(langs: list[str]) -> Iterator[pa.RecordBatch]:
        nonlocal number
        for lang in langs:
            chunk = opened.pop(lang)
            yield from chunk.rows(number, lang)
            number += chunk.size

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for part in _slices((text.as_py() or b"").translate(_TO_PIECES) + b"\n"):
                chunk = opened.setdefault(lang, _Chunk())
                chunk.add(part)
                if chunk.size >= CHUNK and part.endswith(b"\n"):
                    yield from closed([lang])
            if len(opened) > OPEN or sum(c.size for c in opened.values()) > 4 * CHUNK:
                yield from closed(list(opened))
    yield from closed(list(opened))


def _written(df: DataFrame, name: str, group_mb: int | None = None) -> DataFrame:
    """staged(); the shuffle files behind it, as large as the input, go now and not when the driver happens to collect its garbage."""
    out = staged(df, name, group_mb=group_mb)
    spark = df.sparkSession
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # events hold the plan
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """R1: the chunks' words and their counts, with lang, and in the first row of each chunk n, its number of words."""
    bare, own = plain(docs)
    lang = F.coalesce(column_or_null(bare, own, "lang", "string"), F.lit("und"))
    rows = bare.select(lang.alias("lang"), F.col(own["text"]).cast("string").alias("text"))
    return staged(rows.mapInArrow(_chunks, f"{_RELATION}, words array<string>, lang string, n long"), "setm-words", group_mb=GROUP_MB)


def frequent(relation: DataFrame, keys: list[str], arrays: list[str], least: int) -> DataFrame:
    """The dictionary entries of relation whose key has `least` occurrences over all chunks: chunk, place, name, and, in the one
    entry of each key whose place gives it its name, keys and a (the occurrences)."""
    lang = ["lang"] if "lang" in keys else []
    zipped = F.arrays_zip(*arrays, "counts")
    each = relation.filter("counts is not null").select("chunk", "at", *lang, F.posexplode(zipped).alias("place", "entry"))
    each = each.select("chunk", (F.col("at") + F.col("place")).alias("place"), *lang, *[F.col(f"entry.{c}").alias(c) for c in arrays], F.col("entry.counts").alias("n"))
    one = Window.partitionBy(*keys)
    each = each.select("chunk", "place", *keys, F.sum("n").over(one).alias("a"), F.min(F.col("chunk") + F.col("place")).over(one).alias("name"))
    first = F.col("chunk") + F.col("place") == F.col("name")
    found = each.filter(F.col("a") >= least).select("chunk", "place", "name", *[F.when(first, F.col(c)).alias(c) for c in (*keys, "a")])
    return _written(found, "setm-frequent")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, place, name) to rows of many places of one chunk."""
    held: list[list[np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        chunks, places, names = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(chunks, kind="stable")
        chunks, places, names = chunks[order], places[order], names[order]
        starts = np.flatnonzero(np.diff(chunks, prepend=chunks[0] - 1))
        for i in range(0, len(starts), ROWS):
            at = [*starts[i : i + ROWS], *starts[i + ROWS : i + ROWS + 1], *[len(chunks)] * (i + ROWS >= len(starts))]
            ends = pa.array(np.array(at) - at[0], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[at[0] : at[-1]])) for x in (places, names)]
            yield pa.RecordBatch.from_arrays([pa.array(chunks[at[:-1]]), *lists], names=["chunk", "places", "names"])

    size = 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("chunk", "place", "name")])
        size += batch.num_rows
        if size >= PACK:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def _grown(number: int, ids: np.ndarray, places: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A chunk of R_k semi-joined with its frequent phrases, then merge-joined with itself on adjacent places."""
    named = np.full(max(int(ids.max(initial=0)), int(places.max(initial=0))) + 1, -1, np.int64)
    named[places] = names
    kept = (ids >= 0) & (named[ids] >= 0)
    met = np.flatnonzero(kept[:-1] & kept[1:])
    pairs, which, counts = np.unique(ids[met].astype(np.int64) * len(named) + ids[met + 1], return_inverse=True, return_counts=True)
    if len(pairs):
        grown = np.full(len(ids), -1, np.int32)
        grown[met] = which
        yield from _relation_rows(number, grown, counts.astype(np.int32), first=named[pairs // len(named)], rest=named[pairs % len(named)])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk by chunk from rows sorted by chunk: those with ids by their place, then those with the frequent phrases."""
    chunk, held = None, {"ids": [], "places": [], "names": []}

    def out() -> Iterator[pa.RecordBatch]:
        if held["places"]:
            yield from _grown(chunk, *map(np.concatenate, held.values()))
        for parts in held.values():
            parts.clear()

    for batch in batches:
        for row, number in enumerate(batch.column("chunk").to_pylist()):
            if number != chunk:
                yield from out()
                chunk = number
            for name, parts in held.items():
                if (value := batch.column(name)[row]).is_valid:
                    parts.append(value.values.to_numpy().copy())  # or else the batch would stay
    yield from out()


def extended(relation: DataFrame, found: DataFrame) -> DataFrame:
    """R_{k+1} from R_k and its frequent entries."""
    entries = found.select("chunk", "place", "name").mapInArrow(_packed, "chunk long, places array<int>, names array<long>")
    none = F.lit(None)
    rows = relation.filter("ids is not null").select("chunk", "at", "ids", none.cast("array<int>").alias("places"), none.cast("array<long>").alias("names"))
    rows = rows.unionByName(entries.select("chunk", none.cast("int").alias("at"), none.cast("array<int>").alias("ids"), "places", "names"))
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("at"))
    return _written(dealt.mapInArrow(_extend, f"{_RELATION}, first array<long>, rest array<long>"), "setm-phrases", GROUP_MB)


def mined(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of every language, and for each length the frequent phrases: name, lang, phrase, last (word), a, heads and tails (the
    occurrences of its first and of its last 1, 2, ... words), and for two words or more first and rest (names of the parts that it overlaps in)."""
    relation = occurrences(docs)
    sizes = staged(relation.groupBy("lang").agg(F.sum("n").alias("n")), "setm-sizes")
    found = frequent(relation, ["lang", "words"], ["words"], least)
    one = F.array("a")
    word = F.col("words")
    first = found.filter("a is not null").select("name", "lang", word.alias("phrase"), word.alias("last"), "a", one.alias("heads"), one.alias("tails"))
    levels = [_written(first, "setm-level")]  # by now the last step's jobs are let go, too
    for _ in range(longest - 1):
        before, relation = relation, extended(relation, found)
        release(before)
        release(found)
        found = frequent(relation, ["first", "rest"], ["first", "rest"], least)
        shorter = levels[-1]
        left = shorter.select(F.col("name").alias("first"), "lang", "phrase", "heads")
        right = shorter.select(F.col("name").alias("rest"), "last", "tails")
        joined = found.filter("a is not null").select("name", "a", "first", "rest").join(left, "first").join(right, "rest")
        levels.append(
            _written(
                joined.select(
                    "name", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a",
                    F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"), "first", "rest",
                ),
                "setm-level",
            )
        )
    release(relation)
    release(found)
    return sizes, levels


def _scored(level: DataFrame, words: int) -> DataFrame:
    """a, and l, r and score of the cut that scores lowest (of equal ones the first)."""
    cuts = []
    for k in range(1, words):
        head, tail = F.col("heads")[k - 1], F.col("tails")[words - k - 1]
        a, product = (F.col("a").cast("decimal(19,0)"), (head.cast("decimal(19,0)") * tail.cast("decimal(19,0)")).cast("decimal(38,0)"))
        million = ((a * a).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
        # x - x % y is a multiple of y, so the division below leaves nothing to round
        score = ((million - million % product) / product).cast("long")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), head.alias("l"), tail.alias("r")))
    best = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return level.select("name", "lang", "phrase", "a", best.alias("cut")).select("name", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` best phrases of 2 to `longest` words.

    A phrase is a candidate with `least` occurrences; it goes if a candidate of one word more that holds it has `inside` hundredths of its occurrences
    (a still longer one has no more). Ranked by score, then occurrences, then phrase in byte order, so there are no ties. Null texts are
    empty, a null lang is `und`; blank texts have no words; texts of any length are read whole; a text that is one piece is never cut; repeated
    rows each count. Other columns, whatever their names, are ignored. No rows in: no rows out.
    """
    sizes, levels = mined(docs, longest, least)
    candidates = []
    for k, level in enumerate(levels[1:], start=2):
        scored = _scored(level, k)
        if k < longest:
            longer = levels[k].select(F.explode(F.array_distinct(F.array("first", "rest"))).alias("name"), F.col("a").alias("most"))
            longer = longer.groupBy("name").agg(F.max("most").alias("most"))
            scored = scored.join(longer, "name", "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
        candidates.append(scored.select("lang", "phrase", "a", "l", "r", "score"))
    every = candidates[0]
    for more in candidates[1:]:
        every = every.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
    near = every.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
