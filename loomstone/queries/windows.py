"""Ranking and window operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.registry import query
from loomstone.sources.tables import SQL_EDGES, edges, read


@query("win_prev_message", "SELECT conv_id, turn, coalesce(lag(substr(text, 1, 200)) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations")
def win_prev_message(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lag(F.substring("text", 1, 200)).over(w), F.lit("")).alias("context"))


@query(
    "win_pair_turns",
    """WITH t AS (SELECT conv_id, role, row_number() OVER w - 1 AS idx, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WHERE trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, idx, role, CASE WHEN role = 'user' AND after = 'assistant' THEN idx + 1 WHEN role = 'assistant' AND before = 'user' THEN idx - 1 END AS pair FROM t""",
)
def win_pair_turns(spark, sf_dir):
    """Turns without blanks, renumbered; a user turn and the assistant turn behind it point at each other."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, sf_dir, "conversations").filter(F.trim("text") != "")
    t = t.select("conv_id", "role", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))
    pair = F.when((F.col("role") == "user") & (F.col("after") == "assistant"), F.col("idx") + 1).when((F.col("role") == "assistant") & (F.col("before") == "user"), F.col("idx") - 1)
    return t.select("conv_id", "idx", "role", pair.alias("pair"))


@query("win_topk_per_parent", f"WITH {SQL_EDGES} SELECT src, dst, relationship_type, r FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, relationship_type, dst) AS r FROM edges) WHERE r <= 12")
def win_topk_per_parent(spark, sf_dir):
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), "relationship_type", "dst")
    return edges(spark, sf_dir).select("src", "dst", "relationship_type", F.row_number().over(w).cast("long").alias("r")).filter("r <= 12")


@query("win_rank_lists", "SELECT p_partkey, r FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS r FROM part) WHERE r < 20")
def win_rank_lists(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", (F.row_number().over(w) - 1).cast("long").alias("r")).filter("r < 20")


@query(
    "win_token_windows",
    r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 500 THEN 1 ELSE CAST(ceil((len(w) - 500) / 450.0) AS BIGINT) + 1 END)) AS i FROM d WHERE len(w) > 0)
    SELECT doc_id, i AS chunk, i * 450 AS token_start, least(len(w), i * 450 + 500) AS token_end, md5(array_to_string(w[i * 450 + 1:i * 450 + 500], ' ')) AS content_md5 FROM s""",
)
def win_token_windows(spark, sf_dir):
    """Windows of 500 tokens every 450, the last one ending at the last token."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.array_remove(F.split("text", r"\s+"), "").alias("w")).filter(F.size("w") > 0)
    last = F.when(F.size("w") <= 500, 0).otherwise(F.ceil((F.size("w") - 500) / 450.0)).cast("int")
    s = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    start = F.col("i") * 450
    return s.select(
        "doc_id", F.col("i").cast("long").alias("chunk"), start.cast("long").alias("token_start"), F.least(F.size("w"), start + 500).cast("long").alias("token_end"),
        F.md5(F.array_join(F.slice("w", start + 1, F.lit(500)), " ")).alias("content_md5"),
    )


@query("win_line_context", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) SELECT doc_id, pos, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS around FROM l")
def win_line_context(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-2, 2)
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sum(F.length("line")).over(w).alias("around"))
