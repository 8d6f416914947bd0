"""Full-text, vector and fused ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import VISUAL_TERMS

# BM25 parameters and rank-fusion constants.
K1, B = 1.2, 0.75
RRF_K = 60
CHUNK_BOOST, IMAGE_BOOST = 0.05, 0.02


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _count_of(word: str) -> Column:
    return F.size(F.filter("t", lambda x: x == word))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], limit: int | None = None) -> DataFrame:
    """key and score (higher is better) of the rows that hold every query term.

    Statistics come from the same scan: only the counts of the query's terms leave a row, never its postings.
    """
    words = [w.lower() for w in query]
    t = docs.select(key, terms(F.col(text)).alias("t"))
    counts = [_count_of(w).alias(f"tf{i}") for i, w in enumerate(words)]
    tf = t.select(key, F.size("t").alias("len"), *counts)
    stats = tf.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(words))])
    met = tf.filter(reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(words))])).join(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(words)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        parts.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    scored = met.select(key, reduce(lambda a, b: a + b, parts).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), key).limit(limit)


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, key: str, vector: str, target: list[float], limit: int, where: Column | None = None) -> DataFrame:
    """key and score (1 - squared distance) of the nearest rows; the filter comes before the top-k."""
    rows = vectors if where is None else vectors.filter(where)
    t = F.array(*[F.lit(float(x)) for x in target])
    return rows.select(key, (1 - squared_distance(F.col(vector), t)).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def reciprocal_rank_fusion(left: DataFrame, right: DataFrame, key: str, weights: tuple[float, float]) -> DataFrame:
    """key and fused score of two top-k lists (key, score); the windows run over those short lists."""
    w = Window.orderBy(F.desc("score"), key)

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, (F.row_number().over(w) - 1).alias(name))

    both = ranked(left, "r1").join(ranked(right, "r2"), key, "full")

    def part(weight: float, rank: str) -> Column:
        return F.coalesce(weight / (RRF_K + F.col(rank) + 1), F.lit(0.0))

    return both.select(key, (part(weights[0], "r1") + part(weights[1], "r2")).alias("score"), F.col("r1").isNotNull().alias("in_first"), F.col("r2").isNotNull().alias("in_second"))


def visual_intent(query: str) -> bool:
    return any(t in query.lower() for t in VISUAL_TERMS)


def boosted(score: Column, tags: Column, query: str) -> Column:
    """Boosts of chunked units, and of units with images where the query asks for something visual."""
    chunk = F.when(F.exists(tags, lambda t: t.startswith("chunk-strategy-")), CHUNK_BOOST).otherwise(0.0)
    image = F.when(F.lit(visual_intent(query)) & F.array_contains(tags, "has-image"), IMAGE_BOOST).otherwise(0.0)
    return score + chunk + image
