"""Exports, catalog rows and stream-shaped queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import export
from loomstone.plans.filters import apply_filter
from loomstone.registry import query
from loomstone.sources.tables import SQL_DOCUMENTS, SQL_UNITS, documents, read, units
from loomstone.streaming.quotas import recent_events

_XML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def _cell(c: str) -> str:
    return f"""CASE WHEN contains({c}, '"') OR contains({c}, ',') OR contains({c}, chr(10)) THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


@query("sink_csv", f"WITH {SQL_UNITS} SELECT id, {_cell('id')} || ',' || {_cell('title')} || ',' || {_cell('category')} AS line FROM units")
def sink_csv(spark, sf_dir):
    return units(spark, sf_dir).select("id", export.csv_line([F.col("id"), F.col("title"), F.col("category")]).alias("line"))


@query("sink_json", f"WITH {SQL_UNITS} SELECT id, CAST(to_json({{'id': id, 'type': type, 'category': category, 'created': created}}) AS VARCHAR) AS line FROM units")
def sink_json(spark, sf_dir):
    return units(spark, sf_dir).select("id", F.to_json(F.struct("id", "type", "category", "created")).alias("line"))


@query("sink_jsonld", f"""WITH {SQL_UNITS} SELECT id, CAST(to_json({{'@type': 'CreativeWork', 'identifier': id, 'name': title, 'keywords': array_to_string(tags, ','), 'about': category}}) AS VARCHAR) AS node FROM units""")
def sink_jsonld(spark, sf_dir):
    u = units(spark, sf_dir)
    return u.select("id", export.json_ld(u).alias("node"))


@query("sink_markdown", f"WITH {SQL_UNITS} SELECT id, '## ' || title || chr(10) || chr(10) || '**Type:** ' || type || chr(10) || '**Category:** ' || category || chr(10) || '**Tags:** ' || array_to_string(tags, ', ') || chr(10) AS md FROM units")
def sink_markdown(spark, sf_dir):
    return units(spark, sf_dir).select("id", export.markdown_unit().alias("md"))


@query("sink_rss", f"WITH {SQL_UNITS} SELECT '<item><title>' || {_XML.format('title')} || '</title><guid>' || {_XML.format('id')} || '</guid><category>' || {_XML.format('category')} || '</category></item>' AS item FROM units WHERE category = 'general' ORDER BY created DESC, id LIMIT 50")
def sink_rss(spark, sf_dir):
    return units(spark, sf_dir).filter("category = 'general'").orderBy(F.desc("created"), "id").limit(50).select(export.rss_item().alias("item"))


@query("sink_html", f"WITH {SQL_UNITS} SELECT id, md5('<article><h2>' || {_XML.format('title')} || '</h2><p>' || {_XML.format('content')} || '</p></article>') AS html_md5 FROM units")
def sink_html(spark, sf_dir):
    return units(spark, sf_dir).select("id", F.md5(export.html_unit()).alias("html_md5"))


@query("sink_batches", f"WITH {SQL_UNITS} SELECT CAST(hash_bucket AS INT) AS batch, count(*) AS n FROM (SELECT conversation_id % 8 AS hash_bucket FROM units) GROUP BY 1")
def sink_batches(spark, sf_dir):
    """Units by export batch; batches go by conversation, so none needs a global numbering."""
    return units(spark, sf_dir).groupBy(F.pmod("conversation_id", F.lit(8)).cast("int").alias("batch")).agg(F.count("*").cast("long").alias("n"))


@query("sink_obsidian", f"WITH {SQL_UNITS} SELECT tag, type AS folder, count(*) AS notes, min(id) AS first FROM (SELECT id, type, unnest(tags) AS tag FROM units) GROUP BY tag, type")
def sink_obsidian(spark, sf_dir):
    """The tag index of a vault: notes by tag and folder."""
    each = units(spark, sf_dir).select("id", "type", F.explode("tags").alias("tag"))
    return each.groupBy("tag", F.col("type").alias("folder")).agg(F.count("*").cast("long").alias("notes"), F.min("id").alias("first"))


@query("sink_pkb", f"WITH {SQL_DOCUMENTS} SELECT id, title, format, '- [' || title || '](' || id || '.md)' AS line FROM docs")
def sink_pkb(spark, sf_dir):
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("id").cast("string"), F.lit(".md)"))
    return documents(spark, sf_dir).select("id", "title", "format", line.alias("line"))


@query("sink_reprocess_docs", "SELECT lang, count(*) AS documents, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS before, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 50))) AS BIGINT) AS after FROM documents GROUP BY lang")
def sink_reprocess_docs(spark, sf_dir):
    """Dry run of a reprocessing: units before and after, by language."""
    lines = F.split("text", "\n")
    return read(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").cast("long").alias("documents"), F.sum(F.size(lines).cast("long")).alias("before"), F.sum(F.size(F.filter(lines, lambda x: F.length(x) > 50)).cast("long")).alias("after")
    )


@query("st_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def st_events(spark, sf_dir):
    return recent_events(read(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "event_type")


@query("st_watch", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def st_watch(spark, sf_dir):
    """The newest change of every key, as a debounced watch keeps it."""
    newest = F.max(F.struct("ts", "event_id", "event_type")).alias("m")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(newest).select("user_id", "m.event_id", "m.event_type")


@query("cat_saved_crud", "WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS name, o_totalprice AS runs FROM orders WHERE o_orderkey % 3 = 0), u AS (SELECT o_orderkey AS id, 'renamed' AS name, 0.0 AS runs FROM orders WHERE o_orderkey % 30 = 0) SELECT id, name, runs FROM u UNION ALL SELECT id, name, runs FROM s WHERE id NOT IN (SELECT id FROM u) AND name <> '5-LOW'")
def cat_saved_crud(spark, sf_dir):
    """Saved searches updated by key, then one kind deleted."""
    from loomstone.operators.changes import upsert

    orders = read(spark, sf_dir, "orders")
    saved = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("runs"))
    new = orders.filter("o_orderkey % 30 = 0").select(F.col("o_orderkey").alias("id"), F.lit("renamed").alias("name"), F.lit(0.0).alias("runs"))
    return upsert(saved, new, ["id"]).filter("name <> '5-LOW'")


@query("list_saved", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 0 AND o_orderpriority ILIKE '%urgent%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def list_saved(spark, sf_dir):
    tree = [{"field": "o_totalprice", "operator": ">", "value": 0}, {"field": "o_orderpriority", "operator": "CONTAINS", "value": "urgent"}]
    return apply_filter(read(spark, sf_dir, "orders"), tree).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query("list_fed", "SELECT source, count(*) AS documents, min(doc_id) AS first FROM documents GROUP BY source ORDER BY documents DESC, source LIMIT 100")
def list_fed(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("long").alias("documents"), F.min("doc_id").alias("first")).orderBy(F.desc("documents"), "source").limit(100)


@query("cat_fed_crud", "SELECT user_id AS source_id, max_by(event_type, event_id) AS status, count(*) AS transitions FROM events GROUP BY user_id")
def cat_fed_crud(spark, sf_dir):
    """The state of every job: its latest transition."""
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.max_by("event_type", "event_id").alias("status"), F.count("*").cast("long").alias("transitions"))


@query("emb_reset", "SELECT label, count(*) AS reset FROM embeddings WHERE label <> 0 GROUP BY label")
def emb_reset(spark, sf_dir):
    cleared = read(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("label") == 0, F.col("embedding")))
    return cleared.filter("embedding is null").groupBy("label").agg(F.count("*").cast("long").alias("reset"))


@query("red_scan_file", r"SELECT doc_id, len(regexp_extract_all(text, '\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}')) AS cards FROM documents")
def red_scan_file(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}")).cast("long").alias("cards"))


@query("pages_validate", "SELECT page_id FROM pages WHERE url IS NULL OR NOT regexp_matches(url, '^https?://[^/]+') OR page_id IN (SELECT page_id FROM pages GROUP BY 1 HAVING count(*) > 1)")
def pages_validate(spark, sf_dir):
    """Rows that break the index's rules: a bad URL or a repeated id."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    twice = p.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").select("page_id", F.lit(True).alias("twice"))
    met = p.join(twice, "page_id", "left")
    return met.filter(F.col("url").isNull() | ~F.col("url").rlike("^https?://[^/]+") | F.col("twice").isNotNull()).select("page_id")


@query("uni_row_mappers", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'unknown' END AS provider FROM documents")
def uni_row_mappers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang").isin("en", "fr"), F.col("lang")).otherwise("unknown").alias("provider"))


@query("exp_state_stats", "WITH old AS (SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id % 7 <> 0) SELECT lang, count(*) AS items, count(*) FILTER (o.hash IS NULL) AS exported, count(*) FILTER (o.hash = md5(text)) AS skipped FROM documents d LEFT JOIN old o ON d.doc_id = o.doc_id GROUP BY lang")
def exp_state_stats(spark, sf_dir):
    """Counters of an export session: items seen, exported (no state yet) and skipped (state with the same hash)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("hash"))
    state = docs.filter("doc_id % 7 <> 0").select("doc_id", F.col("hash").alias("known"))
    met = docs.join(state, "doc_id", "left")
    return met.groupBy("lang").agg(F.count("*").cast("long").alias("items"), F.count(F.when(F.col("known").isNull(), 1)).alias("exported"), F.count(F.when(F.col("known") == F.col("hash"), 1)).alias("skipped"))


@query("cat_saved_mem", "SELECT p_partkey, array_to_string(list_filter(['heavy', 'small-brand'], lambda t: CASE t WHEN 'heavy' THEN p_size >= 40 ELSE p_brand IN ('Brand#1', 'Brand#2') AND p_retailprice < 1500 END), ',') AS collections FROM part")
def cat_saved_mem(spark, sf_dir):
    """Smart collections: each is a stored filter tree, and a unit is in all whose tree it meets."""
    trees = {
        "heavy": [{"field": "p_size", "operator": ">=", "value": 40}],
        "small-brand": [{"field": "p_brand", "operator": "IN", "value": ["Brand#1", "Brand#2"]}, {"field": "p_retailprice", "operator": "<", "value": 1500}],
    }
    part = read(spark, sf_dir, "part")
    for name, tree in trees.items():
        members = apply_filter(read(spark, sf_dir, "part"), tree).select("p_partkey", F.lit(name).alias(name))
        part = part.join(members, "p_partkey", "left")
    return part.select("p_partkey", F.concat_ws(",", *[F.col(f"`{n}`") for n in trees]).alias("collections"))
