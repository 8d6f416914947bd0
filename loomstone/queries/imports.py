"""Chat exports: the conversations written as each provider writes them, and read back as turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import chunking
from loomstone.registry import query
from loomstone.sources import chats
from loomstone.sources.tables import SQL_DOCUMENT_UNITS, SQL_DOCUMENTS, SQL_TOKENS, document_units, documents, read, tokens


def _threads(spark, sf_dir, one):
    """Conversations with an array of what `one` makes of each turn, in order."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.struct("turn", "role", "text").alias("m"))
    grouped = t.groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return grouped.select("id", F.transform("m", one).alias("m"))


_TURNS = "SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS turn_index, role, md5(text) AS content_md5 FROM conversations"


def _digest(turns):
    return turns.select("thread_id", F.col("turn_index").cast("int").alias("turn_index"), "role", F.md5("content").alias("content_md5"))


@query("imp_claude", _TURNS)
def imp_claude(spark, sf_dir):
    messages = _threads(spark, sf_dir, lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise(m["role"]).alias("sender"), m["text"].alias("text")))
    raw = messages.select(F.to_json(F.struct(F.col("id").alias("uuid"), F.col("m").alias("chat_messages"))).alias("raw"))
    return _digest(chats.claude_turns(chats.parsed_json(raw, "raw", chats.CLAUDE)))


@query("imp_chatgpt", f"SELECT thread_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY turn_index) - 1 AS INT) AS turn_index, role, content_md5 FROM ({_TURNS}) WHERE role IN ('user', 'assistant')")
def imp_chatgpt(spark, sf_dir):
    def node(m):
        content = F.struct(F.array(m["text"]).alias("parts"))
        message = F.struct(F.struct(m["role"].alias("role")).alias("author"), m["turn"].cast("double").alias("create_time"), content.alias("content"))
        return F.struct(F.concat(F.lit("n"), m["turn"]).alias("key"), F.struct(message.alias("message")).alias("value"))

    nodes = _threads(spark, sf_dir, node)
    raw = nodes.select(F.to_json(F.struct("id", F.map_from_entries("m").alias("mapping"))).alias("raw"))
    return _digest(chats.chatgpt_turns(chats.parsed_json(raw, "raw", chats.CHATGPT)))


def _messages(spark, sf_dir, name: str, bot: str):
    threads = _threads(spark, sf_dir, lambda m: F.struct(F.when(m["role"] == "assistant", bot).otherwise(m["role"]).alias("role"), m["text"].alias("content")))
    raw = threads.select(F.to_json(F.struct("id", F.col("m").alias(name))).alias("raw"))
    return _digest(chats.message_turns(chats.parsed_json(raw, "raw", chats.MESSAGES)))


@query("imp_gemini", _TURNS)
def imp_gemini(spark, sf_dir):
    return _messages(spark, sf_dir, "messages", "model")


@query("imp_grok", _TURNS)
def imp_grok(spark, sf_dir):
    return _messages(spark, sf_dir, "turns", "bot")


@query("imp_copilot", "SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(2 * (dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1) + k AS INT) AS turn_index, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END AS role, md5(CASE k WHEN 0 THEN role ELSE text END) AS content_md5 FROM conversations, (SELECT unnest([0, 1]) AS k)")
def imp_copilot(spark, sf_dir):
    """Exchanges: a prompt (here the role's name) and its response make the turns 2i and 2i + 1."""
    threads = _threads(spark, sf_dir, lambda m: F.struct(m["role"].alias("prompt"), m["text"].alias("response")))
    raw = threads.select(F.to_json(F.struct("id", F.col("m").alias("exchanges"))).alias("raw"))
    return _digest(chats.message_turns(chats.parsed_json(raw, "raw", chats.MESSAGES)))


@query("imp_transcript", r"SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS turn_index, role, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content_md5 FROM conversations WHERE trim(text) <> ''")
def imp_transcript(spark, sf_dir):
    """Conversations written as role-tagged text and parsed again."""
    lines = _threads(spark, sf_dir, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["text"]))
    text = lines.select(F.col("id").alias("path"), F.array_join("m", "\n").alias("value"))
    return _digest(chats.parse_transcripts(text))


@query("txt_atomize_doc", f"WITH {SQL_DOCUMENTS}, {SQL_DOCUMENT_UNITS} SELECT u.doc_id, u.pos, d.format, 'chunk-strategy-' || CASE d.format WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'single' ELSE 'markdown' END AS tag, md5(u.content) AS content_md5 FROM doc_units u JOIN docs d ON u.doc_id = d.id")
def txt_atomize_doc(spark, sf_dir):
    """Paragraph units with the chunking strategy of their document's format as a tag."""
    kind = F.when(F.col("format") == "pdf", "pdf").when(F.col("format") == "txt", "single").otherwise("markdown")
    met = document_units(spark, sf_dir).join(documents(spark, sf_dir).select("id", "format"), F.col("doc_id") == F.col("id"))
    return met.select("doc_id", "pos", "format", F.concat(F.lit("chunk-strategy-"), kind).alias("tag"), F.md5("content").alias("content_md5"))


@query("txt_reindex", f"WITH {SQL_TOKENS} SELECT thread_id, count(*) AS occurrences, count(DISTINCT normalized) AS terms FROM tokens GROUP BY thread_id")
def txt_reindex(spark, sf_dir):
    """Occurrences and distinct terms of every thread after a rebuild of the index."""
    counted = tokens(spark, sf_dir).groupBy("thread_id", "normalized").agg(F.count("*").alias("n"))
    return counted.groupBy("thread_id").agg(F.sum("n").alias("occurrences"), F.count("*").cast("long").alias("terms"))


@query("win_header_stack")
def win_header_stack(spark, sf_dir):
    """The nearest heading above every section of the cleaned pages."""
    from loomstone.functions.text import clean_html

    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), clean_html(F.col("html")).alias("text"))
    return chunking.sections(pages, "id", "text").select("id", "start_line", "type", "level", "parent")


@query("txt_chunk_helpers", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_tokens, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed_md5 FROM documents")
def txt_chunk_helpers(spark, sf_dir):
    from loomstone.functions.text import squeeze

    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.array_remove(F.split("text", r"\s+"), "")).cast("long").alias("n_tokens"), F.md5(squeeze(F.col("text"))).alias("squeezed_md5"))


@query("emb_update_pending", "SELECT d.doc_id, coalesce(l.quality = 1, false) AS already FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def emb_update_pending(spark, sf_dir):
    """Documents with whether their embedding exists already, as an incremental run sees them."""
    done = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    met = read(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left")
    return met.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("already"))


@query("sink_collections", "SELECT c_nationkey AS collection, count(*) AS members FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1")
def sink_collections(spark, sf_dir):
    """Collections after members have been removed by key."""
    from loomstone.operators.changes import delete_by_key

    gone = read(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    left = delete_by_key(read(spark, sf_dir, "customer"), gone, ["c_custkey"])
    return left.groupBy(F.col("c_nationkey").alias("collection")).agg(F.count("*").cast("long").alias("members"))


@query("sink_conv_doc_upsert", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'replaced' ELSE source END AS source FROM documents")
def sink_conv_doc_upsert(spark, sf_dir):
    from loomstone.operators.changes import upsert

    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return upsert(docs, docs.filter("doc_id % 5 = 0").withColumn("source", F.lit("replaced")), ["doc_id"])


@query("sink_ingest_run", "SELECT event_type AS run, count(*) AS items, count(*) FILTER (value IS NULL) AS failed, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM events GROUP BY 1")
def sink_ingest_run(spark, sf_dir):
    """Book-keeping of runs: items, failures and start."""
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(
        F.count("*").cast("long").alias("items"), F.count(F.when(F.col("value").isNull(), 1)).alias("failed"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("started")
    )


@query("list_providers", "SELECT role AS provider, count(*) AS turns, count(DISTINCT conv_id) AS threads FROM conversations GROUP BY role ORDER BY turns DESC, provider")
def list_providers(spark, sf_dir):
    per = read(spark, sf_dir, "conversations").groupBy("role", "conv_id").agg(F.count("*").alias("n"))
    return per.groupBy(F.col("role").alias("provider")).agg(F.sum("n").alias("turns"), F.count("*").cast("long").alias("threads")).orderBy(F.desc("turns"), "provider")
