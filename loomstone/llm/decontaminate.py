"""Benchmark decontamination by an FM-index over each shard of the training text.

The benchmark's 13-word windows are the test phrases. Every shard (a slice of an Arrow batch with at most SHARD_WORDS
words) is turned into symbols: a word of the benchmark has its rank in the benchmark's vocabulary, any other word is a
separator, since no phrase can reach across it. Runs of words between separators that are shorter than the shortest
phrase can hold no occurrence and are left out of the index; this loses nothing. Over what remains the shard builds

* a suffix array by prefix doubling in numpy, and from it the Burrows-Wheeler transform;
* a wavelet matrix over the transform, whose bit ranks give rank(symbol, position) in one step a level;
* sampled suffix positions (every SAMPLE-th symbol, and the first symbol of every run).

All phrases are searched at once: backward search narrows every phrase's range of suffixes symbol by symbol, and rows
of the ranges that end up non-empty are located by walking the transform back to a sampled position. The occurrences
of a document are merged into removal spans.

The benchmark is the query set: it is read in blocks of at most BLOCK_BYTES of text. Each block is sent to the tasks, searched in all
rows and dropped before the next one is read, so neither the driver nor a task ever holds more than one. Equal texts are one, and a text
longer than half a block is cut into parts that overlap by a window less one word. Each of several blocks leaves a table of the rows that
it hits; their spans meet by row at the end. In a shard only those phrases are searched whose words all
occur in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import packed, plain, replaced, staged, staged_rows

WINDOW = 13
#: Words of a shard, before words outside the benchmark are left out.
SHARD_WORDS = 1 << 20
SAMPLE = 16
#: Text bytes of the benchmark that one pass sends to the tasks (as phrases about a hundred times as much memory).
BLOCK_BYTES = 1 << 20
#: Text bytes and rows that a task takes apart at once.
PART_BYTES = 16 << 20
PART_ROWS = 4096
#: A document is contaminated when hits make up at least 1 / SHARE of its words.
SHARE = 20

#: ASCII letters and digits lower-cased, other ASCII a blank, bytes of longer characters as they are.
_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class WaveletMatrix:
    """rank(symbol, position) over an array of small integers, by one bit vector a level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        self.begin: dict[int, int] = {}

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before position[i]."""
        start, end = np.zeros(len(symbol), np.int64), position.astype(np.int64)
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            s, e = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + s, start - s)
            end = np.where(one, self.zeros[k] + e, end - e)
        return end - start

    def access(self, position: np.ndarray) -> np.ndarray:
        at, value = position.astype(np.int64), np.zeros(len(position), np.int64)
        for k in range(self.bits):
            here = self.ones[k][at]
            one = self.ones[k][at + 1] > here
            value = (value << 1) | one
            at = np.where(one, self.zeros[k] + here, at - here)
        return value


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order; zeros are separators, told apart by their place, so that no comparison crosses one."""
    n = len(text)
    order = np.lexsort((np.where(text == 0, np.arange(n), 0), text))
    sorted_text = text[order]
    new = np.concatenate(([True], (sorted_text[1:] != sorted_text[:-1]) | (sorted_text[1:] == 0)))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    step = 1
    while rank.max() < n - 1:
        after = np.concatenate((rank[step:] + 1, np.zeros(min(step, n), np.int64)))[:n]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Backward search and locate over symbols; 0 separates runs and ends the text."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_array(text)
        bwt = text[order - 1]  # the text ends in 0, which stands before its first symbol
        self.bits = max(1, int(sigma).bit_length())
        self.tree = WaveletMatrix(bwt, self.bits)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled, self.sample_rank = sampled, np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (rows of symbols, aligned right)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1]):
            live = np.nonzero((k < lengths) & (lo < hi))[0]
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - k]
            base = self.first[symbol]
            lo[live], hi[live] = base + self.tree.rank(symbol, lo[live]), base + self.tree.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(todo := np.nonzero(~self.sampled[at])[0]):
            symbol = self.tree.access(at[todo])
            at[todo] = self.first[symbol] + self.tree.rank(symbol, at[todo])
            steps[todo] += 1
        return self.samples[self.sample_rank[at]] + steps


class Phrases:
    """The windows of one benchmark block: symbols, lengths and the items that each window belongs to."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(symbols) - window + 1) if symbols else 0):
                owners.setdefault(tuple(symbols[i : i + window]), set()).add(item)
        found = sorted(owners)
        self.owners = [sorted(owners[p]) for p in found]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for row, p in zip(self.symbols, found, strict=True):
            row[window - len(p) :] = p
        self.shortest = int(self.lengths.min()) if found else 0

    def occurrences(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """(start, end, phrase) of every phrase in every document of a shard."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        if not self.shortest or not docs:
            return found
        lengths = np.array([len(d) + 1 for d in docs])
        begins = np.concatenate(([0], np.cumsum(lengths)))
        whole = np.zeros(begins[-1], np.int64)
        for d, b in zip(docs, begins[:-1].tolist(), strict=True):
            whole[b : b + len(d)] = d
        # Runs of known words, and of them those as long as the shortest phrase.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (whole > 0).astype(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= self.shortest
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return found
        sizes = ends - starts + 1  # with the separator behind each
        shift = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        places = np.arange(int(sizes.sum())) - np.repeat(shift - starts, sizes)
        text = whole[places]  # the place behind a run is a separator
        index = FMIndex(text, len(self.vocabulary))
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[text] = True  # 0, a separator here, stands for "no word" in the phrases
        tried = np.nonzero(there[self.symbols].all(axis=1))[0]
        lo, hi = np.zeros((2, len(self.lengths)), np.int64)
        lo[tried], hi[tried] = index.search(self.symbols[tried], self.lengths[tried])
        hit = np.nonzero(lo < hi)[0]
        if not len(hit):
            return found
        counts = (hi - lo)[hit]
        rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - lo[hit], counts)
        phrase = np.repeat(hit, counts)
        at = places[index.locate(rows)]
        doc = np.searchsorted(begins, at, side="right") - 1
        for d, p, s in zip(doc.tolist(), phrase.tolist(), (at - begins[doc]).tolist(), strict=True):
            found[d].append((s, s + int(self.lengths[p]), p))
        return found


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching [start, end) spans joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _shards(texts: list[bytes | None], vocabulary: dict[bytes, int], size: int) -> Iterator[list[np.ndarray]]:
    """Documents as symbols, gathered into shards of about `size` words; a longer document is a shard of its own."""
    docs: list[np.ndarray] = []
    total, get = 0, vocabulary.get
    for t in texts:
        words = words_of(t)
        if docs and total + len(words) > size:
            yield docs
            docs, total = [], 0
        docs.append(np.array([get(w, 0) for w in words], np.int64))
        total += len(words)
    if docs:
        yield docs


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    kept, last = [], 0
    for s, e in spans:
        kept.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most PART_ROWS rows and about PART_BYTES bytes of `_text`; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy()
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and (i - start >= PART_ROWS or total + size > PART_BYTES):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _hits(part: pa.RecordBatch, known: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Words, merged spans and items of every row."""
    n_words, spans, items = [], [], []
    for docs in _shards(part.column("_text").cast(pa.binary()).to_pylist(), known.vocabulary, SHARD_WORDS):
        n_words += [len(d) for d in docs]
        for hits in known.occurrences(docs):
            spans.append(merge_spans((s, e) for s, e, _ in hits) if hits else [])
            items.append(sorted({x for _, _, p in hits for x in known.owners[p] if x is not None}) if hits else [])
    return n_words, spans, items


def _dicts(spans: list[list[tuple[int, int]]]) -> list[list[dict[str, int]]]:
    return [[{"start": a, "end": b} for a, b in s] for s in spans]


def _cut(part: pa.RecordBatch, n_words: list[int], spans: list[list[tuple[int, int]]]) -> pa.Array:
    """The texts without their spans; contaminated ones stay as they are."""
    texts = part.column("_text")
    if any(spans):
        texts = texts.to_pylist()
        for i, found in enumerate(spans):
            if found and not contaminated(sum(e - s for s, e in found), n_words[i]):
                texts[i] = cut_words(texts[i], found)
    return texts if isinstance(texts, pa.Array) else pa.array(texts, part.schema.field("_text").type)


_SPANS = "array<struct<start:int,end:int>>"


def _blocks(items: DataFrame, total: int, window: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(tid, item) for the distinct texts with words, and (block, tid, text): their parts, of which a block has at most block_bytes (or
    one part of `window` longer words)."""
    half = max(block_bytes // 2, 1)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words, start = words_of(text.as_py()), 0
                while start < len(words):
                    end, size = start, 0
                    while end < len(words) and (end - start < window or size + len(words[end]) < half):
                        size += len(words[end]) + 1
                        end += 1
                    part = b" ".join(words[start:end])
                    yield pa.RecordBatch.from_arrays([pa.array([tid], pa.int64()), pa.array([start], pa.int64()), pa.array([part], pa.binary()).cast(pa.string())], names=["tid", "start", "text"])
                    start = end if end == len(words) else end - window + 1

    once = items.filter(F.col("text").isNotNull()).select("text").distinct().withColumn("tid", F.monotonically_increasing_id())
    once = staged(once, "decontaminate-texts")
    cut = once.select("tid", "text").mapInArrow(parts, "tid long, start long, text string")
    # Texts are dealt to groups of about 16 blocks by their hash, and within a group to blocks by running sums.
    group = F.pmod(F.xxhash64("tid", "start"), F.lit(-(-total // (16 * block_bytes))))
    size = F.octet_length("text")
    before = F.sum(size).over(Window.partitionBy("group").orderBy("tid", "start").rowsBetween(Window.unboundedPreceding, -1))
    dealt = cut.withColumn("group", group).withColumn("block", F.concat_ws("-", "group", F.floor(F.coalesce(before, F.lit(0)) / half).cast("string")))
    return once.join(items, "text").select("tid", "item"), staged(dealt.select("block", "tid", "text"), "decontaminate-blocks")


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """For every row of docs: `_row` (its columns but text, as a struct), `_n_words`, `_spans` (merged [start, end) spans of
    hit words) and `_items` (ids of the benchmark items that occur). With keep_text also `_text`, from which the spans
    are cut out unless the document is contaminated.

    Null and blank texts have no words. Nulls and blank texts in the benchmark give no windows. An item shorter than
    `window` is one window. item_ids are compared and sorted as strings; rows of the benchmark that share one are one
    item; a null item_id still hits and is left out of the items. An empty benchmark hits nothing. Overlapping and touching spans
    are one. Texts of any length and with any number of hits are searched whole. Repeated rows of docs each keep a row. Other
    columns keep their values, whatever their names. No rows in: no rows out.
    """
    spark = docs.sparkSession
    bare, at = plain(benchmark)
    items = bare.select(F.col(at["item_id"]).cast("string").alias("item"), F.col(at["text"]).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bare, own, row = packed(docs, without="text")
    source = bare.select(F.col(own["text"]).cast("string").alias("_text"), row.alias("_row"))
    new = [("_n_words", "long"), ("_spans", _SPANS), ("_items", "array<string>"), *([("_text", "string")] if keep_text else [])]
    schema = source.select("_row", *[F.lit(None).cast(kind).alias(name) for name, kind in new]).schema

    def sent(block: DataFrame):
        rows = ((r["item"], None if r["text"] is None else r["text"].encode()) for r in block.toLocalIterator())
        return spark.sparkContext.broadcast(Phrases(rows, window))

    def batch(part: pa.RecordBatch, n_words: list[int], spans: list[list[tuple[int, int]]], items: list[list[str]]) -> pa.RecordBatch:
        columns = [part.column("_row"), pa.array(n_words, pa.int64()), pa.array(_dicts(spans), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *([_cut(part, n_words, spans)] if keep_text else [])], names=["_row", *[n for n, _ in new]])

    if total <= block_bytes:
        phrases = sent(items)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                yield batch(part, *_hits(part, phrases.value))

        return source.mapInArrow(search, schema)

    source = staged_rows(source.withColumn("_uid", F.monotonically_increasing_id()), "decontaminate-rows")  # from here on _uid is fixed
    texts, blocks = _blocks(items, total, window, block_bytes)
    hits = []
    for block in [r["block"] for r in blocks.select("block").distinct().orderBy("block").toLocalIterator()]:
        phrases = sent(blocks.filter(F.col("block") == block).select(F.col("tid").cast("string").alias("item"), "text"))

        def among(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                _, spans, found = _hits(part, phrases.value)
                some = [i for i, s in enumerate(spans) if s]
                columns = [part.column("_uid").take(pa.array(some, pa.int64())), pa.array(_dicts([spans[i] for i in some]), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([found[i] for i in some], pa.list_(pa.string()))], names=["_uid", "_spans", "_tids"])

        hits.append(staged(source.select("_uid", "_text").mapInArrow(among, f"_uid long, _spans {_SPANS}, _tids array<string>"), "decontaminate-hits"))
        phrases.destroy()
    hit = reduce(DataFrame.unionByName, hits, spark.createDataFrame([], f"_uid long, _spans {_SPANS}, _tids array<string>"))
    named = hit.select("_uid", F.explode("_tids").alias("tid")).withColumn("tid", F.col("tid").cast("long")).distinct().join(texts, "tid").groupBy("_uid").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    per = hit.groupBy("_uid").agg(F.flatten(F.collect_list("_spans")).alias("_spans")).join(named, "_uid", "left")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            n_words = [len(words_of(t)) for t in part.column("_text").cast(pa.binary()).to_pylist()]
            spans = [merge_spans((x["start"], x["end"]) for x in s or []) for s in part.column("_spans").to_pylist()]
            yield batch(part, n_words, spans, [x or [] for x in part.column("_items").to_pylist()])

    return source.join(per, "_uid", "left").drop("_uid").mapInArrow(merge, schema)


def n_hit(spans: str = "_spans"):
    """Words in the merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long"))


def is_contaminated(hits, words):
    return (hits > 0) & (SHARE * hits >= words)


def remove_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents; from the others the spans of benchmark words are cut out of the text. The cases of
    find_spans() hold."""
    found = find_spans(docs, benchmark, keep_text=True).filter(~is_contaminated(n_hit(), F.col("_n_words")))
    return replaced(found, docs.columns, "text", "_text")
