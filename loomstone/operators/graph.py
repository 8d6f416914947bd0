"""Graph operators as frontier joins: one join with the edges a step, the frontier and what was visited staged on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.scratch import staged


def neighborhood(edges: DataFrame, start: DataFrame, hops: int, directed: bool = True) -> DataFrame:
    """(node, hop) of all nodes within `hops` of the start nodes (node), with the smallest hop.

    Each step reads the edges once, as they are, and only what it reaches is brought down to distinct nodes.
    """
    both = edges.select("src", "dst")
    if not directed:
        both = both.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = staged(start.select("node", F.lit(0).alias("hop")), "graph-frontier")
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = staged(step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "graph-frontier")
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    kept = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return kept.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


#: Most hops of a focus view, and most nodes that it may ask for (they are broadcast).
MAX_FOCUS_HOPS, MAX_FOCUS_NODES = 3, 10_000


def focus(edges: DataFrame, start: str, hops: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The view around a node: (node, hop) of the nodes within `hops` (1 to MAX_FOCUS_HOPS) of it along edges of either direction, and
    the edges among them, with all their columns and src_hop and dst_hop.

    No more than `limit` nodes are shown, nearer ones first and within a hop by name; hops end once there are as many. The start is
    always among them, whether it has edges or not. Null ends are no nodes.
    """
    if not 1 <= limit <= MAX_FOCUS_NODES:
        raise ValueError(f"limit must lie between 1 and {MAX_FOCUS_NODES}")
    seen, count = edges.sparkSession.createDataFrame([(start, 0)], "node string, hop int"), 1
    frontier = seen
    for hop in range(1, min(max(hops, 1), MAX_FOCUS_HOPS) + 1):
        last = F.broadcast(frontier.select(F.col("node").alias("_at")))
        out = edges.join(last, F.col("src") == F.col("_at"), "left_semi").select(F.col("dst").alias("node"))
        back = edges.join(last, F.col("dst") == F.col("_at"), "left_semi").select(F.col("src").alias("node"))
        met = out.unionByName(back).filter("node is not null").distinct().join(F.broadcast(seen.select("node")), "node", "left_anti")
        frontier = staged(met.orderBy("node").limit(limit - count).withColumn("hop", F.lit(hop)), "graph-focus")
        reached = frontier.count()
        seen, count = seen.unionByName(frontier), count + reached
        if not reached or count >= limit:
            break
    ends = [F.broadcast(seen.select(F.col("node").alias(end), F.col("hop").alias(f"{end}_hop"))) for end in ("src", "dst")]
    return seen, edges.join(ends[0], "src").join(ends[1], "dst")


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(position, node) of a shortest directed path, however long; no rows if there is none. Among equal parents the smallest wins.

    Each step joins the nodes reached last with the edges; the search ends at the target or where nothing new is reached. Every step reads
    the edges once, as they are, so edges that are dear to compute should be staged; repeated ones do no harm.
    """
    spark = edges.sparkSession
    pairs = edges.select("src", "dst")
    visited = staged(spark.createDataFrame([(source, None, 0)], "node string, parent string, hop int"), "graph-frontier")
    frontier, hop = visited, 0
    while frontier.filter(F.col("node") == target).isEmpty():
        hop += 1
        step = frontier.join(pairs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = staged(step.join(visited.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "graph-frontier")
        if frontier.isEmpty():
            return spark.createDataFrame([], "position int, node string")
        visited = visited.unionByName(frontier)
    return _path_to(visited, target, hop)


def _path_to(visited: DataFrame, target: str, hops: int) -> DataFrame:
    """(position, node) of target and all its ancestors. Jumps to the 2nd, 4th, 8th, ... ancestor come from joining the jumps before with
    themselves, so the path takes as many joins as its length has binary digits."""
    on = visited.sparkSession.createDataFrame([(target,)], "node string")
    jumps = [visited.filter("parent is not null").select("node", "parent")]
    while 2 ** len(jumps) <= hops:
        far = jumps[-1].select(F.col("node").alias("parent"), F.col("parent").alias("far"))
        jumps.append(staged(jumps[-1].join(far, "parent").select("node", F.col("far").alias("parent")), "graph-jumps"))
    for jump in reversed(jumps):
        on = on.unionByName(on.join(jump, "node").select(F.col("parent").alias("node"))).distinct()
    return visited.join(on, "node", "left_semi").select(F.col("hop").alias("position"), "node")


def branches(edges: DataFrame, root: DataFrame, depth: int = 3, per_node: int = 12) -> DataFrame:
    """(layer, src, dst, relationship_type, back): layers of out-edges from the root nodes (node), the best `per_node` of each parent;
    back marks edges to nodes that an earlier layer holds."""
    order = Window.partitionBy("src").orderBy(F.desc_nulls_last("confidence"), "relationship_type", "dst")
    best = edges.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_node).drop("_r")
    seen, frontier, out = root.select("node"), root.select("node"), None
    for layer in range(1, depth + 1):
        reached = best.join(frontier, F.col("src") == F.col("node"), "left_semi")
        known = seen.select(F.col("node").alias("dst"), F.lit(True).alias("back"))
        marked = reached.join(known, "dst", "left").select(F.lit(layer).alias("layer"), "src", "dst", "relationship_type", F.coalesce("back", F.lit(False)).alias("back"))
        out = marked if out is None else out.unionByName(marked)
        frontier = marked.filter("not back").select(F.col("dst").alias("node")).distinct()
        seen = seen.unionByName(frontier)
    return out


def keyword_pairs(units: DataFrame, key: str, keywords: str, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs a < b whose keyword sets have a Jaccard similarity of at least threshold.

    Pairs meet on shared keywords, which is exact for thresholds over 0. A prefix filter bounds the work: with keywords ordered
    by rarity, similar sets share one among the first size - ceil(threshold * size) + 1, so common keywords hardly ever join.
    """
    sets = units.select(F.col(key).alias("id"), F.array_distinct(keywords).alias("k")).filter(F.size("k") > 0)
    each = sets.select("id", F.explode("k").alias("w"))
    rarity = each.groupBy("w").agg(F.count("*").alias("df"))
    ranked = each.join(rarity, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("o"))
    ranked = ranked.select("id", F.transform("o", lambda x: x["w"]).alias("k"))
    size = F.size("k")
    prefix = ranked.select("id", "k", F.explode(F.slice("k", F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)).alias("w"))
    left = prefix.select(F.col("id").alias("a"), F.col("k").alias("ka"), "w")
    right = prefix.select(F.col("id").alias("b"), F.col("k").alias("kb"), "w")
    fits = (F.size("ka") >= threshold * F.size("kb")) & (F.size("kb") >= threshold * F.size("ka"))
    met = left.join(right, "w").filter((F.col("a") < F.col("b")) & fits)
    shared = F.size(F.array_intersect("ka", "kb"))
    scored = met.select("a", "b", (shared / (F.size("ka") + F.size("kb") - shared)).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold).distinct()


def keyword_links(queries: DataFrame, units: DataFrame, keywords: str, threshold: float) -> DataFrame:
    """(k, n, similarity): for every distinct sorted set of keywords of the queries the sets with a Jaccard similarity of at least threshold,
    its own among them, and how many units have each set.

    Both sides are brought down to distinct sets first. Sets meet on keywords by the same prefix filter as in keyword_pairs(); two that share
    several words of their prefixes count at the first of them only, so no pair is shuffled or held to be told from its repeats.
    """
    sets = units.select(keyword_set(keywords).alias("k")).filter(F.size("k") > 0).groupBy("k").agg(F.count("*").alias("n"))
    rarity = sets.select("n", F.explode("k").alias("w")).groupBy("w").agg(F.sum("n").alias("df"))

    def prefix(of: DataFrame, name: str) -> DataFrame:
        each = of.withColumn("w", F.explode("k")).join(rarity, "w").groupBy(*of.columns).agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("o"))
        size = F.size("k")
        first = F.slice(F.transform("o", lambda x: x["w"]), F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
        return each.select(*of.columns, first.alias(name)).withColumn("w", F.explode(name))

    left = prefix(queries.select(keyword_set(keywords).alias("k")).distinct(), "pa").withColumnRenamed("k", "ka")
    met = left.join(prefix(sets, "pb").withColumnRenamed("k", "kb"), "w").filter(F.col("w") == F.array_intersect("pa", "pb")[0])
    shared = F.size(F.array_intersect("ka", "kb"))
    scored = met.select(F.col("ka").alias("k"), "n", (shared / (F.size("ka") + F.size("kb") - shared)).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold - 1e-9)


def keyword_set(keywords: str) -> Column:
    """Keywords as a sorted set."""
    return F.array_sort(F.array_distinct(keywords))
