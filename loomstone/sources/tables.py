"""The library's relations, derived in Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import text as T

#: Epoch second at which conversation 0 starts; conversations start an hour apart, turns a minute.
EPOCH = 1_704_067_200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atomic units: a message of at least 20 characters, with type, title, tags, category and the message before it as context."""
    turns = read(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    with_context = turns.withColumn("context", F.coalesce(F.lag(F.substring("text", 1, 200)).over(order), F.lit("")))
    kind = T.infer_type(F.col("role"), F.col("text"))
    return with_context.filter(F.length("text") >= 20).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("conv_id").alias("conversation_id"),
        "turn",
        "role",
        kind.alias("type"),
        (F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created"),
        T.title_of(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        "context",
        T.auto_tag(F.col("text"), kind).alias("tags"),
        T.categorize(F.col("text")).alias("category"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge documents: text, title, a format and a JSON metadata string that names the source."""
    formats = F.array(*[F.lit(x) for x in ("markdown", "txt", "pdf", "html")])
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        T.title_of(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        "lang",
        F.element_at(formats, (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("format"),
        F.when(F.pmod("doc_id", F.lit(10)) < 9, F.to_json(F.struct(F.col("source").alias("sourceId")))).otherwise("{}").alias("metadata"),
    )


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph units of documents: lines of over 50 characters, numbered within their document."""
    lines = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    kept = lines.filter(F.length("content") > 50)
    return kept.select("doc_id", "lang", "source", F.col("pos").cast("long").alias("pos"), "content")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term occurrences of the chat turns: term as written, normalised term, place among the turn's terms (from 0)."""
    words = F.filter(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_'-]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("turn_index"), "role", F.posexplode(words).alias("position", "term"))
    return turns.select("thread_id", "turn_index", "role", F.col("position").cast("long").alias("position"), "term", F.lower("term").alias("normalized"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed relationships: each order relates its customer to the order's clerk group, each nation to its region, and parts to the
    suppliers that ship them. src and dst are strings."""
    items = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    kinds = {"A": "references", "N": "builds_on", "R": "contradicts"}
    kind = F.coalesce(*[F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in kinds.items()], F.lit("related"))
    grouped = items.groupBy(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), kind.alias("relationship_type"))
    return grouped.agg(F.max("l_quantity").alias("quantity")).select("src", "dst", "relationship_type", (F.col("quantity") / 50).alias("confidence"))


def edge_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src and dst of the relationships, as often as the items repeat them: for steps that do not ask for more, without grouping."""
    return read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"))


# The same relations in DuckDB SQL, as common table expressions.
_T = "lower(text)"


def _any(marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({_T}, '{m}')" for m in marks) + ")"


_TYPE = f"""CASE WHEN role = 'user' AND (contains({_T}, '?') OR {" OR ".join(f"starts_with({_T}, '{s}')" for s in T.QUESTION_STARTS)}) THEN 'question'
  WHEN {_any(T.CODE_MARKS)} THEN 'code' WHEN {_any(T.DECISION_MARKS)} THEN 'decision' WHEN {_any(T.REFERENCE_MARKS)} THEN 'reference' ELSE 'insight' END"""
_CATEGORY = "CASE " + " ".join(f"WHEN {_any(m)} THEN '{c}'" for c, m in T.CATEGORY_MARKS.items()) + " ELSE 'general' END"
_FOUND = [f"CASE WHEN {_any([m])} THEN '{m}' END" for m in T.LANGUAGES + T.TECHNOLOGIES] + [f"CASE WHEN {_any(m)} THEN '{t}' END" for t, m in T.EXTRA_TAGS.items()]


def sql_title(text: str) -> str:
    line = f"coalesce(list_filter(string_split({text}, chr(10)), lambda x: trim(x) <> '')[1], 'Untitled')"
    return f"CASE WHEN length({line}) > 80 THEN substr({line}, 1, 77) || '...' ELSE {line} END"


SQL_UNITS = f"""units AS (
  SELECT conv_id || '-' || turn AS id, conv_id AS conversation_id, turn, role, {_TYPE} AS type, CAST({EPOCH} + conv_id * 3600 + turn * 60 AS BIGINT) AS created,
    {sql_title("text")} AS title, text AS content, context, list_filter([{_TYPE}, {", ".join(_FOUND)}], lambda x: x IS NOT NULL) AS tags, {_CATEGORY} AS category
  FROM (SELECT *, coalesce(lag(substr(text, 1, 200)) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations) WHERE length(text) >= 20
)"""
SQL_DOCUMENTS = f"""docs AS (
  SELECT doc_id AS id, {sql_title("text")} AS title, text AS content, lang, ['markdown', 'txt', 'pdf', 'html'][doc_id % 4 + 1] AS format,
    CASE WHEN doc_id % 10 < 9 THEN '{{"sourceId":"' || source || '"}}' ELSE '{{}}' END AS metadata FROM documents
)"""
SQL_DOCUMENT_UNITS = """doc_units AS (
  SELECT doc_id, lang, source, pos, content FROM (
    SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents
  ) WHERE length(content) > 50
)"""
SQL_TOKENS = """tokens AS (
  SELECT thread_id, turn_index, role, position, term, lower(term) AS normalized FROM (
    SELECT conv_id AS thread_id, turn AS turn_index, role, unnest(w) AS term, unnest(range(0, len(w))) AS position
    FROM (SELECT *, list_filter(regexp_extract_all(text, '[A-Za-z0-9_''-]+'), lambda x: length(x) >= 2) AS w FROM conversations)
  )
)"""
SQL_EDGES = """edges AS (
  SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst,
    CASE l_returnflag WHEN 'A' THEN 'references' WHEN 'N' THEN 'builds_on' WHEN 'R' THEN 'contradicts' ELSE 'related' END AS relationship_type,
    max(l_quantity) / 50 AS confidence FROM lineitem GROUP BY 1, 2, 3
)"""
