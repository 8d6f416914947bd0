"""Keyed upserts and change capture as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose key new lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def delete_by_key(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def capture_changes(old: DataFrame, new: DataFrame, keys: list[str], hash_column: str, full: bool) -> DataFrame:
    """keys with action: insert, update, skip (equal hashes), and delete for missing keys of a full scan (keep otherwise)."""
    a = old.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col(hash_column).alias("a_hash"), F.lit(True).alias("a"))
    b = new.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(hash_column).alias("b_hash"), F.lit(True).alias("b"))
    same = reduce(lambda x, y: x & y, [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys])
    action = (
        F.when(F.col("a").isNull(), "insert")
        .when(F.col("b").isNull(), "delete" if full else "keep")
        .when(F.col("a_hash").eqNullSafe(F.col("b_hash")), "skip")
        .otherwise("update")
    )
    return a.join(b, same, "full").select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], action.alias("action"))


def scan_summary(changes: DataFrame, by: list[str]) -> DataFrame:
    """Counters of scan runs from captured changes: scanned, indexed, skipped and deleted rows of each `by`."""

    def n(*actions: str):
        return F.count(F.when(F.col("action").isin(*actions), 1))

    return changes.groupBy(*by).agg(n("insert", "update", "skip").alias("scanned"), n("insert", "update").alias("indexed"), n("skip").alias("skipped"), n("delete").alias("deleted"))
