"""An inverted index with positions, and the query language over it.

build() writes one row for each (term, field, row of the table): its positions, and the length of the row. Files lie in folders by the
hash of a term's first LEAD characters and are sorted by term inside, so a query reads the folders of its terms only, and of their files the row
groups whose statistics hold them; a prefix of LEAD characters or more is one folder too. There is a folder for every FOLDER_ROWS rows (4 at least,
MOST_FOLDERS at most), and a term that many rows hold is spread over as many files of its folder, up to SPREAD. Statistics of the whole
collection are written beside the postings.

A query is words, which all must be there; AND, OR, NOT and parentheses; "phrases"; prefix*; field:word. Operators are upper-case;
NOT binds closest, then AND, then OR. What is none of it is a QueryError, on which callers search for the text as a substring.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.search import K1, B, terms

#: Of the files; an index with another one is built anew.
LAYOUT = 2
LEAD = 2
FOLDER_ROWS = 50_000
MOST_FOLDERS = 4096
SPREAD = 64
#: Words of a row that goes to Python, and places after which what was found leaves it: both bound its memory.
SLICE = 128
OUT_PLACES = 1 << 17
_POSTINGS = "term string, field string, places array<int>, len int"


class QueryError(ValueError):
    """Text that is no query."""


class Leaf(NamedTuple):
    """Words that must stand in a row, one behind the other; field: where, or None; prefix: the last word is one."""

    words: tuple[str, ...]
    field: str | None = None
    prefix: bool = False


#: A parsed query: a Leaf or (operator, left, right).
Query = Leaf | tuple
_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|(\w+)|([():*]))')
_WORD = re.compile(r"[^\W_]+")


def parse(text: str) -> Query:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"no query: {text!r}")
        found.append(("phrase", m[1].replace('""', '"')) if m[1] is not None else ("word", m[2]) if m[2] else ("mark", m[3]))
        at = m.end()

    def peek(k: int = 0) -> tuple[str, str]:
        return found[k] if k < len(found) else ("end", "")

    def leaf() -> Query:
        kind, value = peek()
        if (kind, value) == ("mark", "("):
            found.pop(0)
            inner = either()
            if peek() != ("mark", ")"):
                raise QueryError("an open parenthesis")
            found.pop(0)
            return inner
        field = None
        if kind == "word" and peek(1) == ("mark", ":"):
            field = value
            del found[:2]
            kind, value = peek()
        if kind not in ("word", "phrase") or (kind == "word" and value in ("AND", "OR", "NOT")):
            raise QueryError(f"no word at {value!r}")
        found.pop(0)
        prefix = peek() == ("mark", "*")
        if prefix:
            found.pop(0)
        words = tuple(_WORD.findall(value.lower()))
        if not words:
            raise QueryError(f"no word in {value!r}")
        return Leaf(words, field, prefix)

    def but() -> Query:
        out = leaf()
        while peek() == ("word", "NOT"):
            found.pop(0)
            out = ("NOT", out, leaf())
        return out

    def both() -> Query:
        out = but()
        while peek()[0] in ("word", "phrase") and peek()[1] != "OR" or peek() == ("mark", "("):
            if peek() == ("word", "AND"):
                found.pop(0)
            out = ("AND", out, but())
        return out

    def either() -> Query:
        out = both()
        while peek() == ("word", "OR"):
            found.pop(0)
            out = ("OR", out, both())
        return out

    out = either()
    if found:
        raise QueryError(f"nothing expected at {found[0][1]!r}")
    return out


def leaves(query: Query) -> list[Leaf]:
    """The leaves from left to right, each once."""
    return [query] if isinstance(query, Leaf) else list(dict.fromkeys([*leaves(query[1]), *leaves(query[2])]))


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, LEAD)), F.lit(folders)).cast("int")


def build(rows: DataFrame, key: str, fields: dict[str, Column], path: str) -> None:
    """Write the index of rows to path. key identifies a row; null fields have no words."""
    spark = rows.sparkSession
    share = math.ceil(rows.count() / FOLDER_ROWS)
    folders = min(max(share, 4), MOST_FOLDERS)
    if share < SPREAD:  # a small table may lie in one row group
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    none = F.array().cast("array<string>")
    cut = rows.select(F.col(key).alias("key"), *[F.coalesce(terms(c.cast("string")), none).alias(f) for f, c in fields.items()])
    cut = cut.withColumn("len", reduce(lambda a, b: a + b, [F.size(f) for f in fields]))

    # Rows of SLICE words of one field; those of a row of the table follow each other, whatever its length.
    def pieces(f: str) -> Column:
        starts = F.when(F.size(f) > 0, F.sequence(F.lit(0), F.size(f) - 1, F.lit(SLICE))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.struct(F.lit(f).alias("field"), at.alias("at"), F.slice(F.col(f), at + 1, F.lit(SLICE)).alias("words")))

    pieces_of_all = F.explode(F.concat(*[pieces(f) for f in fields]))
    sliced = cut.select("key", "len", pieces_of_all.alias("p")).select("key", "len", "p.field", "p.at", "p.words")

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        who, size, where = None, 0, ""  # of what is held
        out: list[list] = [[], [], [], [], [0], []]

        def close() -> None:
            keys, words, fields_, places, ends, sizes = out
            keys += [who] * len(held)
            words += held
            fields_ += [where] * len(held)
            sizes += [size] * len(held)
            for found in held.values():
                places += found
                ends.append(len(places))
            held.clear()

        def record() -> pa.RecordBatch:
            keys, words, fields_, places, ends, sizes = out
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            columns = [pa.array(keys, batch.schema.field("key").type), pa.array(words, pa.string()), pa.array(fields_, pa.string()), listed, pa.array(sizes, pa.int32())]
            for column in out:
                column.clear()
            ends.append(0)
            return pa.RecordBatch.from_arrays(columns, names=["key", "term", "field", "places", "len"])

        for batch in batches:
            words = batch.column("words")
            for k, (row, n, field, at) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("key", "len", "field", "at")], strict=True)):
                if at == 0:
                    close()
                    who, size, where = row, n, field
                    if len(out[3]) > OUT_PLACES:
                        yield record()
                for i, w in enumerate(words[k].as_py(), start=at):
                    held.setdefault(w, []).append(i)
        close()
        if out[0]:
            yield record()

    kind = cut.schema["key"].dataType.simpleString()
    found = sliced.mapInArrow(postings, f"key {kind}, {_POSTINGS}").withColumn("folder", _folder(F.col("term"), folders))
    spread = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder", F.pmod(F.xxhash64("key"), F.lit(min(max(share, 8), SPREAD))))
    spread.sortWithinPartitions("folder", "term", "key").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    stats = cut.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    stats.withColumns({"fields": F.array(*[F.lit(f) for f in fields]), "folders": F.lit(folders), "key": F.lit(None).cast(kind)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/stats").schema["key"].dataType.simpleString()
    return spark.read.schema(f"key {kind}, {_POSTINGS}, folder int").parquet(f"{path}/postings")


def postings_of(spark: SparkSession, path: str, asked: list[Leaf], folders: int) -> DataFrame:
    """The postings that the leaves need: their folders only, their terms by statistics."""
    wanted, leads = [], []
    for leaf in asked:
        for k, word in enumerate(leaf.words):
            starts = leaf.prefix and k == len(leaf.words) - 1
            wanted.append(F.col("term").startswith(word) if starts else F.col("term") == word)
            leads.append(None if starts and len(word) < LEAD else word)
    found = _postings(spark, path).filter(reduce(lambda a, b: a | b, wanted))
    # The folders' numbers are constants when the plan is made, so others are not listed among its files.
    return found if None in leads else found.filter(reduce(lambda a, b: a | b, [F.col("folder") == _folder(F.lit(w), folders) for w in leads]))


def matches(spark: SparkSession, path: str, query: str | Query) -> DataFrame:
    """key and score (BM25, higher is better) of the rows that fit the query. A phrase or prefix scores like a term of its own."""
    tree = parse(query) if isinstance(query, str) else query
    asked = leaves(tree)
    stats = spark.read.parquet(f"{path}/stats")
    fields, folders = stats.select("fields", "folders").first()
    for leaf in asked:
        if leaf.field is not None and leaf.field not in fields:
            raise QueryError(f"no field {leaf.field!r}")
    found = postings_of(spark, path, asked, folders)
    sums, counts = [], []

    def is_(word: str, starts: bool) -> Column:
        return F.col("term").startswith(word) if starts else F.col("term") == word

    def less(k: int):
        return lambda place: place - k

    for i, leaf in enumerate(asked):
        here = F.lit(True) if leaf.field is None else F.col("field") == leaf.field
        if len(leaf.words) == 1:
            sums.append(F.sum(F.when(here & is_(leaf.words[0], leaf.prefix), F.size("places")).otherwise(0)).alias(f"tf{i}"))
            counts.append(F.col(f"tf{i}"))
            continue
        each = []
        for f in fields if leaf.field is None else [leaf.field]:
            starts = []
            for k, word in enumerate(leaf.words):
                last = leaf.prefix and k == len(leaf.words) - 1
                name = f"at{i}_{k}_{f}"
                sums.append(F.flatten(F.collect_list(F.when((F.col("field") == f) & is_(word, last), F.transform("places", less(k))))).alias(name))
                starts.append(F.col(f"`{name}`"))
            each.append(F.size(reduce(F.array_intersect, starts)))
        counts.append(reduce(lambda a, b: a + b, each))
    grouped = found.groupBy("key").agg(F.first("len").alias("len"), *sums)
    tf = grouped.select("key", "len", *[c.alias(f"tf{i}") for i, c in enumerate(counts)])
    seen = tf.agg(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(asked))])

    def fits(q: Query) -> Column:
        if isinstance(q, Leaf):
            return F.col(f"tf{asked.index(q)}") > 0
        left, right = fits(q[1]), fits(q[2])
        return left & right if q[0] == "AND" else left | right if q[0] == "OR" else left & ~right

    parts = []
    for i in range(len(asked)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        parts.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    one = stats.select("n", "mean").join(seen)  # one row each
    return tf.filter(fits(tree)).join(F.broadcast(one)).select("key", reduce(lambda a, b: a + b, parts).alias("score"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """term, rows (that hold it) and occurrences."""
    held = _postings(spark, path).groupBy("term", "key").agg(F.sum(F.size("places")).alias("n"))
    return held.groupBy("term").agg(F.count("*").alias("rows"), F.sum("n").alias("occurrences"))
