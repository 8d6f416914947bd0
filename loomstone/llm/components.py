"""Connected components, and one row for each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import packed, staged, unpacked


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its connected component.

    Alternates large-star and small-star steps until every node points at its root; each round is staged.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        if small:
            both = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        lowest = both.groupBy("src").agg(F.min(F.least("dst", "src")).alias("low"))
        met = both.join(lowest, "src")
        out = met.filter(F.col("dst") > F.col("src")) if not small else met
        moved = out.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        if small:
            moved = moved.unionByName(lowest.select("src", F.col("low").alias("dst")))
        return moved.filter(F.col("src") != F.col("dst")).distinct()

    now = staged(edges.select("src", "dst").filter(F.col("src") != F.col("dst")), "components-edges")
    before = None
    while True:
        now = staged(star(star(now, small=False), small=True), "components-stars", now)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    )


def keep_representatives(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of docs that marked (doc_id, th, representative) names, one for each doc_id and th: of rows that repeat both, the one
    with the smallest hash of its values. All columns stay as they are."""
    found = marked.filter("representative").groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    heads = staged(found, "components-heads")
    bare, own, row = packed(docs)
    rows = bare.select(F.col(own["doc_id"]).cast("long").alias("_id"), F.xxhash64(F.col(own["text"]).cast("string")).alias("_th"), row.alias("_row"), F.xxhash64(*bare.columns).alias("_hash"))

    def at(keys: DataFrame) -> DataFrame:
        return rows.join(keys, rows["_id"].eqNullSafe(keys["doc_id"]) & (rows["_th"] == keys["th"]), "left_semi")

    single = at(heads.filter("n = 1")).select("_row")
    repeated = heads.filter("n > 1")
    if not repeated.isEmpty():
        single = single.unionByName(at(repeated).groupBy("_id", "_th").agg(F.min_by("_row", "_hash").alias("_row")).select("_row"))
    return unpacked(single, docs.columns)
