"""Filters, projections, sorting and paging."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import intake
from loomstone.plans.filters import apply_filter, for_vector_store, page, parse_relative_date, preset
from loomstone.registry import query
from loomstone.sources.tables import SQL_DOCUMENT_UNITS, SQL_DOCUMENTS, SQL_UNITS, document_units, documents, read, units

_LEAVES = {
    "flt_eq": ({"field": "o_orderstatus", "operator": "=", "value": "F"}, "o_orderstatus = 'F'"),
    "flt_ne": ({"field": "o_orderstatus", "operator": "!=", "value": "F"}, "o_orderstatus <> 'F'"),
    "flt_gt": ({"field": "o_totalprice", "operator": ">", "value": 200000}, "o_totalprice > 200000"),
    "flt_lt": ({"field": "o_totalprice", "operator": "<", "value": 5000}, "o_totalprice < 5000"),
    "flt_ge": ({"field": "o_custkey", "operator": ">=", "value": 900}, "o_custkey >= 900"),
    "flt_le": ({"field": "o_custkey", "operator": "<=", "value": 100}, "o_custkey <= 100"),
    "flt_in": ({"field": "o_orderpriority", "operator": "IN", "value": ["1-URGENT", "2-HIGH"]}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "flt_contains": ({"field": "o_orderpriority", "operator": "CONTAINS", "value": "h%g"}, "o_orderpriority ILIKE '%h%g%'"),
    "flt_regex": ({"field": "o_orderpriority", "operator": "REGEX", "value": "^[1-3]-[A-Z]+$"}, "regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$')"),
    "flt_between": ({"field": "o_totalprice", "operator": "BETWEEN", "value": [100000, 150000]}, "o_totalprice BETWEEN 100000 AND 150000"),
    "flt_negate": ({"field": "o_orderpriority", "operator": "CONTAINS", "value": "low", "negate": True}, "NOT (o_orderpriority ILIKE '%low%')"),
}
for _name, (_leaf, _where) in _LEAVES.items():

    @query(_name, f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE {_where}")
    def _filtered(spark, sf_dir, leaf=_leaf):
        rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
        return apply_filter(rows, leaf)


@query(
    "flt_group",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    WHERE (l_quantity > 45 OR (l_returnflag = 'R' AND l_discount BETWEEN 0.02 AND 0.04)) AND NOT (l_linenumber IN (2, 5) OR l_tax >= 0.06)""",
)
def flt_group(spark, sf_dir):
    tree = [
        {"operator": "OR", "filters": [
            {"field": "l_quantity", "operator": ">", "value": 45},
            {"operator": "AND", "filters": [
                {"field": "l_returnflag", "operator": "=", "value": "R"},
                {"field": "l_discount", "operator": "BETWEEN", "value": [0.02, 0.04]},
                {"field": "l_linenumber", "operator": "IN", "value": [], "negate": True},
            ]},
        ]},
        {"operator": "OR", "negate": True, "filters": [
            {"field": "l_linenumber", "operator": "IN", "value": [2, 5]},
            {"field": "l_tax", "operator": ">=", "value": 0.06},
        ]},
    ]
    return apply_filter(read(spark, sf_dir, "lineitem"), tree).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("flt_mem", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'e') AND p_size > 20")
def flt_mem(spark, sf_dir):
    """The in-memory engine's contains is case-sensitive and knows no wildcards."""
    return read(spark, sf_dir, "part").filter(F.col("p_name").contains("e") & (F.col("p_size") > 20)).select("p_partkey", "p_name")


@query("flt_presets", f"WITH {SQL_UNITS} SELECT id, category FROM units WHERE NOT list_has_any(tags, ['draft', 'incomplete', 'todo']) AND category = 'design' AND created > 1704067200 + 3 * 86400")
def flt_presets(spark, sf_dir):
    """Two presets at once: recent design work (60 days before a given day) without incomplete items."""
    now = datetime(2024, 3, 4, tzinfo=UTC)
    return apply_filter(units(spark, sf_dir), preset("exclude-incomplete", now) + preset("recent-design", now)).select("id", "category")


@query("flt_vector_where", "SELECT vec_id, label FROM embeddings WHERE label >= 1 AND NOT (label = 3)")
def flt_vector_where(spark, sf_dir):
    tree = [
        {"field": "label", "operator": ">=", "value": 1},
        {"field": "label", "operator": "BETWEEN", "value": [0, 1]},
        {"operator": "AND", "negate": True, "filters": [{"field": "label", "operator": "=", "value": 3}]},
    ]
    return apply_filter(read(spark, sf_dir, "embeddings").select("vec_id", "label"), for_vector_store(tree))


@query("flt_date_parse", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-17'")
def flt_date_parse(spark, sf_dir):
    start, end = parse_relative_date("2024-01-10 to 2024-01-17", datetime(2024, 2, 1))
    return read(spark, sf_dir, "events").filter(F.col("ts").between(start.isoformat(" "), end.isoformat(" "))).select("event_id")


@query(
    "flt_units_list",
    f"""WITH {SQL_UNITS} SELECT id, type, title, created, CAST((SELECT count(*) FROM units WHERE title ILIKE '%the%' OR content ILIKE '%the%') AS BIGINT) AS total FROM units
    WHERE title ILIKE '%the%' OR content ILIKE '%the%' ORDER BY created DESC, id LIMIT 20 OFFSET 20""",
)
def flt_units_list(spark, sf_dir):
    found = units(spark, sf_dir).filter(F.col("title").ilike("%the%") | F.col("content").ilike("%the%"))
    total = found.agg(F.count("*").alias("total"))
    listed = page(found, [F.desc("created"), F.asc("id")], 2, 20)
    return listed.crossJoin(total).select("id", "type", "title", "created", "total")  # one row on the right


@query("flt_with_filters", f"WITH {SQL_UNITS} SELECT id, type, created FROM units WHERE type <> 'insight' AND created >= 1704070800 ORDER BY created DESC, id LIMIT 50")
def flt_with_filters(spark, sf_dir):
    tree = [{"field": "type", "operator": "!=", "value": "insight"}, {"field": "created", "operator": ">=", "value": 1704070800}]
    return apply_filter(units(spark, sf_dir), tree).orderBy(F.desc("created"), "id").limit(50).select("id", "type", "created")


@query("flt_by_tag", f"WITH {SQL_UNITS} SELECT id, array_to_string(tags, ',') AS tags FROM units WHERE list_contains(tags, 'go')")
def flt_by_tag(spark, sf_dir):
    return units(spark, sf_dir).filter(F.array_contains("tags", "go")).select("id", F.array_join("tags", ",").alias("tags"))


@query("flt_by_category", f"WITH {SQL_UNITS} SELECT id, category FROM units WHERE category = 'general' ORDER BY created DESC, id LIMIT 20")
def flt_by_category(spark, sf_dir):
    return page(units(spark, sf_dir).filter("category = 'general'"), [F.desc("created"), F.asc("id")], 1, 20).select("id", "category")


@query("flt_by_id", f"WITH {SQL_UNITS} SELECT id, type, title FROM units WHERE id = '1-1'")
def flt_by_id(spark, sf_dir):
    return units(spark, sf_dir).filter("id = '1-1'").select("id", "type", "title")


@query("flt_ids", f"WITH {SQL_UNITS} SELECT id, type, title FROM units WHERE id IN ('1-1', '2-1', '3-0', 'none') AND category = 'general'")
def flt_ids(spark, sf_dir):
    return units(spark, sf_dir).filter(F.col("id").isin("1-1", "2-1", "3-0", "none") & (F.col("category") == "general")).select("id", "type", "title")


@query("flt_insights", f"WITH {SQL_UNITS} SELECT id, type FROM units WHERE type IN ('insight', 'decision') ORDER BY created DESC, id LIMIT 100")
def flt_insights(spark, sf_dir):
    return units(spark, sf_dir).filter(F.col("type").isin("insight", "decision")).orderBy(F.desc("created"), "id").limit(100).select("id", "type")


@query("flt_reprocess_docs", f"WITH {SQL_DOCUMENTS} SELECT id, format, metadata FROM docs WHERE format IN ('markdown', 'html') AND json_extract_string(metadata, '$.sourceId') IN ('src1', 'src2', 'src3', 'src4')")
def flt_reprocess_docs(spark, sf_dir):
    source = F.get_json_object("metadata", "$.sourceId")
    return documents(spark, sf_dir).filter(F.col("format").isin("markdown", "html") & source.isin("src1", "src2", "src3", "src4")).select("id", "format", "metadata")


@query(
    "flt_backfill_units",
    f"""WITH {SQL_DOCUMENTS}, {SQL_DOCUMENT_UNITS} SELECT u.doc_id, u.pos, d.format FROM doc_units u LEFT JOIN docs d ON u.doc_id = d.id
    WHERE length(u.content) >= 400 AND d.format IN ('txt', 'pdf') AND json_extract_string(d.metadata, '$.sourceId') IS NOT NULL""",
)
def flt_backfill_units(spark, sf_dir):
    met = document_units(spark, sf_dir).join(documents(spark, sf_dir).select("id", "format", "metadata"), F.col("doc_id") == F.col("id"), "left")
    kept = (F.length("content") >= 400) & F.col("format").isin("txt", "pdf") & F.get_json_object("metadata", "$.sourceId").isNotNull()
    return met.filter(kept).select("doc_id", "pos", "format")


@query("flt_pending_embed", "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, min(CASE WHEN quality = 1 THEN 'generated' ELSE 'pending' END) AS status FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id WHERE l.status IS NULL OR l.status = 'pending'")
def flt_pending_embed(spark, sf_dir):
    status = F.when(F.col("quality") == 1, "generated").otherwise("pending")
    known = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(status).alias("status"))
    return read(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").filter("status is null or status = 'pending'").select("doc_id")


@query("flt_saved_post", f"WITH {SQL_UNITS} SELECT id, type, category FROM units WHERE category = 'general' AND type = 'insight' AND list_has_any(tags, ['go', 'node', 'insight']) AND created >= 1704074400")
def flt_saved_post(spark, sf_dir):
    wanted = F.arrays_overlap("tags", F.array(F.lit("go"), F.lit("node"), F.lit("insight")))
    return units(spark, sf_dir).filter((F.col("category") == "general") & (F.col("type") == "insight") & wanted & (F.col("created") >= 1704074400)).select("id", "type", "category")


@query(
    "pred_line_grep",
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
    near AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM lines)
    SELECT doc_id, pos, md5(around) AS around FROM near WHERE regexp_matches(line, '(?i)licensed|reserved')""",
)
def pred_line_grep(spark, sf_dir):
    """Lines that match a pattern, with a line of context on both sides."""
    from pyspark.sql import Window

    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-1, 1)
    near = lines.withColumn("around", F.array_join(F.collect_list("line").over(frame), "\n"))
    return near.filter(F.col("line").rlike("(?i)licensed|reserved")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("around").alias("around"))


@query("prj_format_unit", f"WITH {SQL_UNITS} SELECT id, type, title, category, created, array_to_string(tags, ',') AS tags FROM units")
def prj_format_unit(spark, sf_dir):
    return units(spark, sf_dir).select("id", "type", "title", "category", "created", F.array_join("tags", ",").alias("tags"))


@query(
    "prj_snippet",
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    a AS (SELECT doc_id, t, instr(lower(t), 'licensed') - 1 AS p FROM n),
    b AS (SELECT *, greatest(0, p - 90) AS s, least(length(t), p + 98) AS e FROM a)
    SELECT doc_id, CASE WHEN p < 0 THEN substr(t, 1, 200)
      ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || substr(t, s + 1, e - s) || (CASE WHEN e < length(t) THEN '...' ELSE '' END) END AS snippet FROM b""",
)
def prj_snippet(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), "licensed").alias("snippet"))


@query(
    "prj_hydrate",
    f"""WITH {SQL_UNITS}, tag_rows AS (SELECT id, unnest(tags) AS tag FROM units), t AS (SELECT id, string_agg(tag, ',' ORDER BY tag) AS tag_list FROM tag_rows GROUP BY id)
    SELECT u.id, u.category, coalesce(t.tag_list, '') AS tags FROM units u LEFT JOIN t ON u.id = t.id""",
)
def prj_hydrate(spark, sf_dir):
    """Units joined with their tags from the bridge table."""
    u = units(spark, sf_dir)
    bridge = u.select("id", F.explode("tags").alias("tag"))
    lists = bridge.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))
    return u.select("id", "category").join(lists, "id", "left").select("id", "category", F.coalesce("tags", F.lit("")).alias("tags"))


@query("flt_policy", r"""SELECT page_id, array_to_string(list_filter([CASE WHEN octet_length(encode(html)) > 4000 THEN 'size' END, CASE WHEN regexp_matches(lower(url), 'casino|bets') THEN 'path' END,
    CASE WHEN regexp_extract(lower(url), '[^/](\.[^./]*)$', 1) IN ('.pem', '.key', '.p12', '.pfx', '.der', '.crt', '.cer') THEN 'extension' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pages""")
def flt_policy(spark, sf_dir):
    """Intake policy by size, path and extension: why each page is quarantined (empty: it is not)."""
    why = intake.reasons(F.col("url"), F.octet_length("html"), blocked_paths=["casino", "bets"], max_bytes=4000)
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(why, ",").alias("reasons"))


@query("page_offset", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders ORDER BY orders.o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_offset(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 20).select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"))


@query("sort_multi", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem ORDER BY l_discount DESC NULLS LAST, l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100")
def sort_multi(spark, sf_dir):
    order = [F.desc_nulls_last("l_discount"), F.desc_nulls_last("l_shipdate"), "l_orderkey", "l_linenumber"]
    return read(spark, sf_dir, "lineitem").orderBy(*order).limit(100).select("l_orderkey", "l_linenumber", "l_discount")


@query("sort_coalesce", "SELECT o_orderkey, o_custkey FROM orders ORDER BY coalesce(NULLIF(o_orderdate, DATE '1995-01-01'), DATE '1992-01-01') DESC, o_orderkey LIMIT 50")
def sort_coalesce(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    key = F.coalesce(F.nullif(day, F.lit("1995-01-01").cast("date")), F.lit("1992-01-01").cast("date"))
    return read(spark, sf_dir, "orders").orderBy(key.desc(), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("topk_graph_units", f"WITH {SQL_UNITS} SELECT id, type, created FROM units WHERE type = 'question' ORDER BY created DESC, id LIMIT 200")
def topk_graph_units(spark, sf_dir):
    return units(spark, sf_dir).filter("type = 'question'").orderBy(F.desc("created"), "id").limit(200).select("id", "type", "created")


@query("list_conversations", f"WITH {SQL_UNITS} SELECT conversation_id, min(created) AS created, max(created) AS updated FROM units GROUP BY conversation_id ORDER BY 2 DESC, 1 LIMIT 50")
def list_conversations(spark, sf_dir):
    grouped = units(spark, sf_dir).groupBy("conversation_id").agg(F.min("created").alias("created"), F.max("created").alias("updated"))
    return grouped.orderBy(F.desc("created"), "conversation_id").limit(50)


@query("list_turns", "SELECT conv_id AS thread_id, turn AS turn_index, role, md5(text) AS text_md5 FROM conversations WHERE conv_id = 3 ORDER BY turn")
def list_turns(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").filter("conv_id = 3").orderBy("turn")
    return rows.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("turn_index"), "role", F.md5("text").alias("text_md5"))


@query("fts_empty_query", f"WITH {SQL_UNITS} SELECT id, title FROM units ORDER BY created DESC, id LIMIT 20")
def fts_empty_query(spark, sf_dir):
    return units(spark, sf_dir).orderBy(F.desc("created"), "id").limit(20).select("id", "title")


@query("like_search", f"WITH {SQL_UNITS} SELECT id, title FROM units WHERE title ILIKE '%that%' OR content ILIKE '%that%' ORDER BY created DESC, id LIMIT 50")
def like_search(spark, sf_dir):
    return units(spark, sf_dir).filter(F.col("title").ilike("%that%") | F.col("content").ilike("%that%")).orderBy(F.desc("created"), "id").limit(50).select("id", "title")
