"""A trie of conversation prefixes, aggregated by ROLLUP over positional turn ids.

Each conversation is cut into blocks of WIDTH turns: a row with its conversation, its block number, the turn ids t0, t1, ... (two longs and the
text's bytes) and the node that the block before ends in. `GROUP BY block, node, ROLLUP (t0, t1, ...)` groups every prefix of every block at once;
grouping_id tells the depth. A node is named by the exclusive-or of the hashes of its blocks (each with its number), so all
blocks of all conversations find the node that they continue at once, by carried sums, not block after block.

A conversation may hold any share of all rows. Its turns are numbered in two levels (within the partitions of a sort by range, which may fall
inside a conversation, and over those partitions), and what blocks carry is summed in groups of FAN blocks, then over groups.

Sums over subtrees need no walk along the tree either: every node belongs to its smallest member, whose path leads through it. So
each conversation carries, from its end to its start, the sums of what its own nodes add, and the same ROLLUP over all members of a node
gives the node's subtree. The member lists' digests are taken in order over pieces of ID_RANGE ids, a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import join_split, plain, release, staged

WIDTH = 8
FAN = 1024
ID_RANGE = 4096
#: Fixed rules of the contract: conversations of five share their first one's start, of fewer than nine turns.
FAMILY = 5
SHARED = 9


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("int")


def _numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, x, y, size) whose `at` ascends along each conversation, and (conv_id, part, first, n) of the parts."""
    bare, own = plain(conversations)
    text = [F.coalesce(F.col(own[c]).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = bare.select(F.col(own["conv_id"]).cast("long").alias("conv_id"), F.col(own["turn"]).alias("turn"), *text).filter("conv_id is not null")
    order = ["conv_id", "turn", "role", "text", "row"]  # the last deals equal rows to several tasks
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    id_ = (F.xxhash64("role", "text").alias("x"), F.xxhash64(F.md5("text"), "role").alias("y"))
    turns = staged(ranged.select("conv_id", at.alias("at"), *id_, F.octet_length("text").cast("long").alias("size")), "trie-turns")
    turns = turns.withColumn("part", F.shiftright("at", 33))
    return turns, turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, headed) and (conv_id, pos, x, y, size, last): the turns of the rebuilt conversations. last marks a conversation's last
    turn where it is one of its own; headed says that none is."""
    turns, parts = _numbered(conversations)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-parts")
    known = parts.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    donors = known.select(F.col("conv_id").alias("donor"), F.col("turns").alias("given"))
    wanted = shared_turns(F.col("conv_id"))
    convs = known.withColumn("donor", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).join(donors, "donor", "left")
    convs = convs.select("conv_id", "turns", F.least(wanted, F.coalesce("given", F.lit(0))).alias("taken"), (F.col("turns") <= wanted).alias("headed"))
    convs = staged(convs, "trie-conversations")
    places = parts.join(convs, "conv_id").select("conv_id", "part", (F.col("before") - F.col("first")).alias("shift"), "taken", "turns")
    placed = turns.join(places, ["conv_id", "part"]).withColumn("place", F.col("at") + F.col("shift"))
    last = (F.col("place") == F.col("turns") - 1).alias("last")
    to = [F.when(F.col("place") >= wanted, F.struct("conv_id", (F.col("place") - wanted + F.col("taken")).alias("pos"), last))]
    for k in range(FAMILY):
        other = F.try_add("conv_id", F.lit(k))
        given = (F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("place") < shared_turns(other))
        to.append(F.when(given, F.struct(other.alias("conv_id"), F.col("place").alias("pos"), F.lit(False).alias("last"))))
    moved = placed.select(F.explode(F.array_compact(F.array(*to))).alias("to"), "x", "y", "size")
    return convs.select("conv_id", "headed"), moved.select("to.*", "x", "y", "size")


def carried(rows: DataFrame, key: str, at: str, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with, for each `out: (column, function)` of sums, the function (bit_xor or sum) of the column over the key's rows with a
    smaller `at`, null for the first: within groups of FAN places, then over groups."""

    def level(rows: DataFrame, top: int) -> DataFrame:
        group = F.shiftright(at, FAN.bit_length() - 1)
        span = Window.partitionBy(key, group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        out = rows.withColumns({o: F.expr(f"{f}({c})").over(span) for o, (c, f) in sums.items()})
        if top < FAN:
            return out
        totals = rows.groupBy(key, group.alias("_group")).agg(*[F.expr(f"{f}({c})").alias(c) for c, f in sums.values()])
        far = level(totals.withColumnRenamed("_group", at), top // FAN).select(key, F.col(at).alias("_group"), *[F.col(o).alias(f"_{o}") for o in sums])
        both = {o: F.col(o).bitwiseXOR(F.col(f"_{o}")) if f == "bit_xor" else F.col(o) + F.col(f"_{o}") for o, (_, f) in sums.items()}
        met = out.withColumn("_group", group).join(far, [key, "_group"])
        return met.withColumns({o: F.coalesce(x, o, f"_{o}") for o, x in both.items()}).drop("_group", *[f"_{o}" for o in sums])

    return level(rows, rows.agg(F.max(at)).first()[0] or 0)


def _hashes(x: list[Column], y: list[Column]) -> tuple[Column, Column]:
    """128 bits of a block's turns; nulls, which stand for no turn, add nothing."""
    return F.xxhash64("block", *x), F.xxhash64(F.lit("block"), *y[::-1], *x, "block")


def _cells(name: str) -> list[Column]:
    return [F.col(f"{name}{i}") for i in range(WIDTH)]


def blocks_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, block, p, q, x0, y0, size0, ..., filled, last): p and q name the node that the block continues (0 for the root)."""
    none = F.lit(None).cast("long")
    marks = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), *[none.alias(c) for c in ("x", "y", "size")], F.col("headed").alias("last"), F.lit(True).alias("real"))
    every = turns.withColumn("real", F.lit(False)).unionByName(marks)
    i = F.col("pos") % WIDTH
    cells = [F.max(F.when(i == k, F.col(c))).alias(f"{c}{k}") for k in range(WIDTH) for c in ("x", "y", "size")]
    block = F.shiftright("pos", WIDTH.bit_length() - 1).alias("block")
    found = every.groupBy("conv_id", block).agg(*cells, F.max("real").alias("real"), F.max("last").alias("last"), F.count("x").cast("int").alias("filled"))
    # Only turns given to a conversation that does not exist lack a mark; they are in block 0.
    p, q = _hashes(_cells("x"), _cells("y"))
    found = staged(found.filter("block > 0 or real").drop("real").select("*", p.alias("own_p"), q.alias("own_q")), "trie-cells")
    out = carried(found, "conv_id", "block", {"p": ("own_p", "bit_xor"), "q": ("own_q", "bit_xor")})
    return staged(out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("p", "q")}), "trie-blocks", found)


def _rolled(blocks: DataFrame, measures: str) -> DataFrame:
    """measures of every prefix of every block: depth, block, level (turns of the block in it), p, q (the node), up_p, up_q (the node
    above), size (bytes of the last text)."""
    columns = ", ".join(f"x{i}, y{i}, size{i}" for i in range(WIDTH))
    rollup = ", ".join(f"(x{i}, y{i}, size{i})" for i in range(WIDTH))
    found = blocks.sparkSession.sql(
        f"SELECT block, p AS p0, q AS q0, {columns}, CAST({WIDTH} - bit_count(grouping_id()) DIV 3 AS INT) AS level, {measures} FROM {{blocks}} GROUP BY block, p, q, ROLLUP ({rollup})",
        blocks=blocks,
    )
    level = F.col("level")
    at = F.greatest(level, F.lit(1))
    # A group of shorter conversations is no prefix; level 0 is the node that the block continues, which the block before has, but for the root.
    real = ((level == 0) & (F.col("block") == 0)) | ((level > 0) & F.element_at(F.array(*[x.isNotNull() for x in _cells("x")]), at))
    p, q = _hashes(_cells("x"), _cells("y"))
    up_p, up_q = _hashes(*[[F.when(level > i + 1, cell) for i, cell in enumerate(_cells(c))] for c in ("x", "y")])

    def node(old: str, own: Column, least: int) -> Column:
        return F.when(level < least, F.col(old)).otherwise(F.col(old).bitwiseXOR(own))

    size = F.when(level > 0, F.element_at(F.array(*_cells("size")), at)).otherwise(F.lit(0)).alias("size")
    kept = [c for c in found.columns if c not in {"p0", "q0", *[f"{c}{i}" for c in ("x", "y", "size") for i in range(WIDTH)]}]
    depth = (F.col("block") * WIDTH + level).alias("depth")
    return found.filter(real).select(depth, *kept, node("p0", p, 1).alias("p"), node("q0", q, 1).alias("q"), node("p0", up_p, 2).alias("up_p"), node("q0", up_q, 2).alias("up_q"), size)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, p, q, text) in order to (depth, p, q, sha256 of a node's texts, comma-joined)."""
    node, sha = None, hashlib.sha256()
    names = ["depth", "p", "q", "ends_sha256"]

    def batch_of(nodes: list[tuple], digests: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([n[i] for n in nodes], pa.int64()) for i in range(3)], pa.array(digests, pa.string())], names=names)

    for batch in batches:
        nodes, digests = [], []
        for *here, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if here == node:
                sha.update(b",")
            else:
                if node is not None:
                    nodes.append(node)
                    digests.append(sha.hexdigest())
                node, sha = here, hashlib.sha256()
            sha.update(text.encode())
        yield batch_of(nodes, digests)
    if node is not None:
        yield batch_of([node], [sha.hexdigest()])


def ends(blocks: DataFrame) -> DataFrame:
    """(depth, p, q, ends_sha256) of the nodes where conversations end."""
    p, q = _hashes(_cells("x"), _cells("y"))
    own = [F.when(F.col("filled") == 0, F.col(old)).otherwise(F.col(old).bitwiseXOR(new)).alias(old) for old, new in (("p", p), ("q", q))]
    found = blocks.filter("last").select((F.col("block") * WIDTH + F.col("filled")).alias("depth"), *own, "conv_id")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = found.groupBy("depth", "p", "q", F.floor(F.col("conv_id") / ID_RANGE).alias("piece")).agg(F.array_join(ids, ",").alias("text"))
    sorted_ = pieces.repartition("depth", "p", "q").sortWithinPartitions("depth", "p", "q", "piece").select("depth", "p", "q", "text")
    return sorted_.mapInArrow(_digest, "depth long, p long, q long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; null turns come first; rows that tie on the turn are taken by role, then text; equal rows each
    are a turn; rows without a conv_id are left out. Texts and conversations of any length are taken whole. Of a negative id c,
    c % 5 is taken as non-negative. Other columns, whatever their names, are ignored. No rows in: no rows out, not even a root.
    """
    blocks = blocks_of(*rebuilt(conversations))
    key = ["depth", "p", "q"]
    nodes = staged(_rolled(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id"), "trie-prefixes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, key, "left").fillna(0, ["n_children"]), "trie-nodes", nodes)

    # What a conversation's own nodes add, by block and level, and what its later blocks add.
    value, level = (F.col("n_convs") - 1) * F.col("size"), F.col("level")
    added = [F.sum(F.when(level == i, value)).alias(f"v{i}") for i in range(1, WIDTH + 1)]
    owned = nodes.groupBy("conv_id", "block").agg(*added, F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    adds = [f"v{i}" for i in range(1, WIDTH + 1)]
    valued = blocks.join(owned, ["conv_id", "block"], "left").fillna(0, [*adds, "leaves"])
    top = blocks.agg(F.max("block")).first()[0] or 0
    total = sum((F.col(c) for c in adds[1:]), F.col(adds[0]))
    valued = staged(valued.withColumns({"whole": total, "back": F.lit(top) - F.col("block")}), "trie-values")
    sums = carried(valued, "conv_id", "back", {"later": ("whole", "sum"), "later_leaves": ("leaves", "sum")}).fillna(0, ["later", "later_leaves"])
    from_here = {f"w{i}": sum((F.col(c) for c in adds[max(i, 1) - 1 :]), F.col("later")) for i in range(WIDTH + 1)}
    sums = sums.withColumns(from_here | {"leaf": F.col("leaves") + F.col("later_leaves")})
    rolled = _rolled(sums, ", ".join(f"sum(w{i}) AS w{i}" for i in range(WIDTH + 1)) + ", sum(leaf) AS n_leaves")
    below = rolled.select(*key, F.element_at(F.array(*[F.col(f"w{i}") for i in range(WIDTH + 1)]), level + 1).alias("saved_tokens"), "n_leaves")

    nothing = hashlib.sha256().hexdigest()
    full = nodes.join(below, key).join(ends(blocks), key, "left").fillna(nothing, ["ends_sha256"])
    full = staged(full.select(*key, "up_p", "up_q", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie-full", valued)
    above = full.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    with_parent = join_split(full.filter("depth > 0"), above, ["depth", "up_p", "up_q"], "siblings").drop("siblings")
    every = with_parent.unionByName(full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    for table in (nodes, blocks):
        release(table)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
