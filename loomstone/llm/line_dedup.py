"""Line dedup by distinct-site spread, in DataFrame functions only.

1. Every line with a word is hashed to 128 bits and staged with its document, place and site.
2. For each hash a HyperLogLog sketch gathers the sites; partial sketches merge by aggregation, so the most common line of
   the corpus arrives as one small row from each task. The same pass finds the line's first and last place.
3. Estimates well above or below the threshold decide at once; lines near it get exact distinct counts of sites.
4. Lines on MIN_SITES or more sites are boilerplate, and so are passages (lines of over PASSAGE words) that stand in two or more
   documents, on however many sites: their first and last documents differ. They are removed wherever they occur but at the
   first place (the smallest doc_id, then text hash, then place), so that one copy of every passage stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import SPACE, column_or_null, join_split, let, packed, plain, replaced, staged

MIN_SITES = 3
#: Lines of more words are passages: repeating in another document is enough.
PASSAGE = 50
#: log2 of the sketch's registers; its relative standard error is about 1.04 / sqrt(2**12).
LOG_REGISTERS = 12
#: Estimates within so many standard errors of the threshold, or within 1 of it, are counted exactly.
ERRORS = 5


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """id, th (text hash), pos, h1, h2 (line hash), long (a passage) and site of every line with a word."""
    bare, own = plain(docs)
    text = F.col(own["text"]).cast("string")
    texts = bare.select(F.col(own["doc_id"]).cast("long").alias("id"), F.xxhash64(text).alias("th"), column_or_null(bare, own, site, "string").alias("site"), F.split(text, "\n").alias("lines"))
    rows = texts.select("id", "th", "site", F.posexplode("lines").alias("pos", "line"))  # the text itself stays behind
    rows = rows.withColumn("n", let(F.split("line", SPACE), lambda w: F.size(w) - (w[0] == "").cast("int") - (F.element_at(w, -1) == "").cast("int"))).filter("n > 0")
    return rows.select("id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), (F.col("n") > PASSAGE).alias("long"), "site")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, n (places) and first (none, id, th, pos) of every line on at least min_sites sites, and of every repeated passage.

    Null sites are no sites: lines that stand only there are not boilerplate unless they are passages.
    """
    at = F.struct(F.col("id").isNull().alias("none"), "id", "th", "pos")
    sketches = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), F.first("long").alias("long")
    )
    two = F.col("long") & ~(F.col("first.id").eqNullSafe(F.col("last.id")) & (F.col("first.th") == F.col("last.th")))
    spread = sketches.select("h1", "h2", "n", "first", F.hll_sketch_estimate("sketch").alias("sites"), two.alias("passage"))
    band = max(1.0, ERRORS * 1.04 / 2 ** (LOG_REGISTERS / 2) * min_sites)
    spread = staged(spread.filter((F.col("sites") >= min_sites - band) | F.col("passage")), "lines-spread")
    near = spread.filter(F.col("sites").between(min_sites - band, min_sites + band) & ~F.col("passage"))
    # Lines are brought down to distinct (line, site) pairs, in their tasks first, before they meet the near ones.
    pairs = lines.filter(F.col("site").isNotNull()).select("h1", "h2", "site").distinct()
    exact = pairs.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    exact = exact.filter(F.col("exact") >= min_sites)
    out = ["h1", "h2", "n", "first"]
    sure = spread.filter((F.col("sites") > min_sites + band) | F.col("passage")).select(*out)
    return sure.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"]).select(*out))


def removals(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """id, th and gone (sorted places of the lines to remove) of every document that loses a line."""
    lines = staged(_lines(docs, site), "lines")
    found = staged(boilerplate(lines, min_sites), "lines-boilerplate")
    at = F.struct(F.col("id").isNull().alias("none"), "id", "th", "pos")
    hits = join_split(lines, found, ["h1", "h2"], "n").filter(at != F.col("first"))
    return hits.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def mark(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One row for each row of docs: `_row` (its columns but text as a struct), `_text` (the text without removed lines), `_lines` and
    `_gone` (places of the removed lines, from 0).

    A null text stays null and has no lines. Lines are compared exactly; lines without a word stay. Rows that repeat doc_id and text are
    one document: their lines are removed or stay alike. Null doc_ids come last in the order that picks the copy that stays, and
    of equal doc_ids the smaller text hash. Texts may have any number of lines. Other columns keep their values, whatever
    their names. No rows in: no rows out.
    """
    gone = removals(docs, site, min_sites)
    bare, own, row = packed(docs, without="text")
    text = F.col(own["text"]).cast("string")
    rows = bare.select(F.col(own["doc_id"]).cast("long").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"), row.alias("_row"))
    met = rows.join(gone.hint("shuffle_hash"), rows["_id"].eqNullSafe(gone["id"]) & (rows["_th"] == gone["th"]), "left")
    none = F.array().cast("array<int>")

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: lines[i]), "\n")

    clean = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(let(F.split("_text", "\n"), kept))
    n_lines = F.coalesce(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return met.select("_row", clean.alias("_text"), n_lines.cast("long").alias("_lines"), F.coalesce("gone", none).alias("_gone"))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines removed, as mark() defines it; documents that had words and have none left go."""
    found = mark(docs, site, min_sites)
    blank = F.trim(F.translate("_text", "\t\n\x0b\x0c\r", "     ")) == ""
    left = found.filter((F.size("_gone") == 0) | ~blank)
    return replaced(left, docs.columns, "text", "_text")
