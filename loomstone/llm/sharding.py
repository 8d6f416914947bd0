"""Sharding by extendible hashing, in DataFrame functions only.

Rows hash to BITS bits. A directory indexed by hash prefixes starts at a depth at which buckets hold a few limits' worth on
average; only buckets over the byte limit split on another bit, until every shard fits. Sizes come from one grouped sum
over prefixes a few bits longer (combined before the shuffle), and each short prefix's handful of longer ones is settled
in one row. Prefixes still over the limit go another round with more bits; nothing else is read again.

Rows that share their whole hash cannot be told apart by its bits. As in a hash file they get overflow pages: rows of
one hash are numbered within their input partitions and packed into pages of at most the limit, so a key that holds a
third of all rows is neither one shard nor one task. A single row over the limit is a page of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from loomstone.llm.common import join_split, packed, plain, staged, staged_rows

#: Bits of the hash, taken from the front of an MD5 sum.
BITS = 60
#: Bits that one round looks ahead of the directory's depth.
STEP = 5


def hash60(*keys: Column) -> Column:
    """60 bits of the MD5 sum of the keys as text; nulls count as the text U+0000."""
    parts = [F.coalesce(k.cast("string"), F.lit("\0")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, BITS // 4), 16, 10).cast("long")


def _prefix(hashed: Column | str, depth: int | Column) -> Column:
    value = F.col(hashed) if isinstance(hashed, str) else hashed
    if isinstance(depth, int):
        return F.shiftright(value, BITS - depth)
    return F.floor(value / F.pow(F.lit(2.0), F.lit(BITS) - depth)).cast("long")


def _settle(leaves: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """leaves (leaf: prefix of `high` bits, bytes, n, alike) with depth and shard_bytes of the shard that each belongs to; depth is
    null where even the leaf is over the limit."""
    pack = F.collect_list(F.struct("leaf", "bytes", "n", "alike")).alias("all")
    by_bucket = leaves.groupBy(F.shiftright("leaf", high - low).alias("bucket")).agg(pack)

    def sized(one: Column, every: Column) -> Column:
        def at(depth: Column) -> Column:
            def under(x: Column) -> Column:
                shift = F.pow(F.lit(2), F.lit(high) - depth).cast("long")
                return F.floor(x["leaf"] / shift) == F.floor(one["leaf"] / shift)

            total = F.aggregate(F.filter(every, under), F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
            return F.struct(depth.alias("depth"), total.alias("shard_bytes"))

        fitting = F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), at), lambda s: s["shard_bytes"] <= limit)
        return F.get(fitting, F.lit(0))

    settled = F.transform("all", lambda x: F.struct(x["leaf"].alias("leaf"), x["bytes"].alias("bytes"), x["n"].alias("n"), x["alike"].alias("alike"), sized(x, F.col("all")).alias("s")))
    out = by_bucket.select(F.inline(settled))
    return out.select("leaf", "bytes", "n", "alike", F.col("s.depth").alias("depth"), F.col("s.shard_bytes").alias("shard_bytes"))


def assign(rows: DataFrame, keys: list[str], size: str, limit: int, carry: list[str] | None = None) -> DataFrame:
    """`keys` of every row with bytes, shard, depth and shard_bytes (bytes of the whole shard).

    size: a column of bytes if it is a number, else a column whose own bytes count. shard is the hash prefix in
    binary digits ("" if one shard holds everything), with ".page" behind it for overflow pages. Null keys hash alike, null sizes
    and texts count 0, texts of any length count whole, repeated rows each keep a row (ties on a hash share its shard or pages). No
    rows in: no rows out. carry: columns to return beside the keys; others, whatever their names, are ignored.
    """
    bare, own = plain(rows)
    shown = [*keys, *(carry or [])]
    number = isinstance(bare.schema[own[size]].dataType, NumericType)
    counted = F.col(own[size]) if number else F.octet_length(F.col(own[size]).cast("string"))
    key = [F.col(own[k]) for k in keys]
    hashed = bare.select(*[F.col(own[c]).alias(f"k_{i}") for i, c in enumerate(shown)], hash60(*key).alias("h"), F.coalesce(counted, F.lit(0)).cast("long").alias("bytes"), F.spark_partition_id().alias("part"))
    pending = hashed = staged(hashed, "shards-rows")
    total = hashed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    low = max(0, math.ceil(math.log2(max(1, total / limit))) - 2)
    found = []
    while True:
        high = min(BITS, low + STEP)
        leaves = pending.groupBy(_prefix("h", high).alias("leaf")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n"), (F.min("h") == F.max("h")).alias("alike")
        )
        settled = staged(_settle(leaves, low, high, limit), "shards-leaves")
        placed = pending.withColumn("leaf", _prefix("h", high))
        names = [c for c in hashed.columns]
        fits = join_split(placed, settled.filter("depth is not null").select("leaf", "depth", "shard_bytes", "n"), ["leaf"], "n")
        found.append(fits.select(*names, "depth", "shard_bytes", F.lit(None).cast("string").alias("page")))
        over = settled.filter("depth is null")
        if over.isEmpty():
            break
        alike = over.filter("alike") if high < BITS else over
        found.append(_overflow(join_split(placed, alike.select("leaf", "n"), ["leaf"], "n").select(*names), limit, high))
        rest = over.filter("not alike")
        if high == BITS or rest.isEmpty():
            break
        pending = staged(join_split(placed, rest.select("leaf", "n"), ["leaf"], "n").select(*names), "shards-rows")
        low = high + 1
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    digits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(_prefix("h", F.col("depth"))), F.col("depth"), F.lit("0")))
    named = [F.col(f"k_{i}").alias(k) for i, k in enumerate(shown)]
    return out.select(*named, "bytes", F.concat(digits, F.coalesce(F.concat(F.lit("."), "page"), F.lit(""))).alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes")


def _overflow(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """Pages for rows of buckets that no further bit splits, filled within the input's partitions (part).

    A row of at most half the limit goes to the half-limit window in which its running sum starts, so a page never exceeds
    the limit; a larger row is a page of its own.
    """
    large = F.col("bytes") * 2 > limit
    order = Window.partitionBy("h", "part", large).orderBy("bytes")
    before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    slot = F.when(large, F.row_number().over(order) - 1).otherwise(F.floor(F.coalesce(before, F.lit(0)) / max(1, limit // 2)))
    page = F.concat_ws("-", F.when(large, "l").otherwise("s"), "part", slot.cast("string"))
    paged = rows.withColumn("page", page)
    sizes = paged.groupBy("h", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return paged.join(sizes, ["h", "page"]).select(*rows.columns, F.lit(depth).alias("depth"), "shard_bytes", "page")


def write_shards(rows: DataFrame, keys: list[str], size: str, limit: int, path: str) -> DataFrame:
    """Write rows as one Parquet folder for each shard under `path` and return the directory: shard, rows and bytes.

    The folders are shard=s<bits>; where rows has a column shard, its name gets underscores until it is free. Rows are numbered and
    staged first, so rows that repeat, also in their keys, are each written once.
    """
    name = "shard"
    while name in rows.columns:
        name += "_"
    bare, at, whole = packed(rows)
    numbered = bare.select(whole.alias("_row"), *[F.col(at[k]).alias(f"of_{i}") for i, k in enumerate(keys)], F.col(at[size]).alias("size"))
    numbered = staged_rows(numbered.withColumn("number", F.monotonically_increasing_id()), "shards-numbered")
    shards = staged(assign(numbered, [f"of_{i}" for i in range(len(keys))], "size", limit, carry=["number"]), "shards")
    folders = shards.select("number", F.concat(F.lit("s"), "shard").alias("_folder"))
    met = numbered.select("_row", "number").join(folders, "number").repartition("_folder")
    met.select("_row.*", F.col("_folder").alias(name)).write.partitionBy(name).parquet(path)
    return shards.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
