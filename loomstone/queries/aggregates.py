"""Facets, statistics and usage analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import taxonomy
from loomstone.functions import text as T
from loomstone.registry import query
from loomstone.sources.tables import (
    SQL_DOCUMENT_UNITS, SQL_DOCUMENTS, SQL_EDGES, SQL_TOKENS, SQL_UNITS, document_units, documents, edges, read, tokens, units,
)


def _long(name: str):
    return F.count("*").cast("long").alias(name)


@query("agg_facet_category", f"WITH {SQL_UNITS} SELECT category, count(*) AS n FROM units GROUP BY category")
def agg_facet_category(spark, sf_dir):
    return units(spark, sf_dir).groupBy("category").agg(_long("n"))


@query("agg_facet_type", f"WITH {SQL_UNITS} SELECT type, count(*) AS n FROM units WHERE category <> 'design' GROUP BY type")
def agg_facet_type(spark, sf_dir):
    return units(spark, sf_dir).filter("category <> 'design'").groupBy("type").agg(_long("n"))


@query("agg_facet_tags", f"WITH {SQL_UNITS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM units) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def agg_facet_tags(spark, sf_dir):
    return units(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(_long("n")).orderBy(F.desc("n"), "tag").limit(20)


@query("agg_facet_date", "SELECT strftime(ts, '%Y-%m') AS bucket, count(*) AS n, CAST(min(ts) AS VARCHAR)[:19] AS first, CAST(max(ts) AS VARCHAR)[:19] AS last FROM events GROUP BY 1")
def agg_facet_date(spark, sf_dir):
    stamp = "yyyy-MM-dd HH:mm:ss"
    return read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("bucket")).agg(
        _long("n"), F.date_format(F.min("ts"), stamp).alias("first"), F.date_format(F.max("ts"), stamp).alias("last")
    )


@query(
    "agg_facets_all",
    f"""WITH {SQL_UNITS}, hits AS (SELECT * FROM units WHERE content ILIKE '%on%')
    SELECT 'category' AS facet, category AS value, count(*) AS n FROM hits GROUP BY category UNION ALL SELECT 'type', type, count(*) FROM hits GROUP BY type
    UNION ALL SELECT 'role', role, count(*) FROM hits GROUP BY role UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(tags) AS tag FROM hits) GROUP BY tag""",
)
def agg_facets_all(spark, sf_dir):
    """All facets of a search in one pass: every hit becomes its (facet, value) pairs, counted once."""
    hits = units(spark, sf_dir).filter(F.col("content").ilike("%on%"))
    fixed = [F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("category", "type", "role")]
    pairs = F.concat(F.array(*fixed), F.transform("tags", lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))))
    return hits.select(F.inline(pairs)).groupBy("facet", "value").agg(_long("n"))


@query("agg_facet_mem", "SELECT p_brand AS value, count(*) AS n FROM part WHERE p_size > 10 AND p_brand IS NOT NULL GROUP BY p_brand ORDER BY n DESC, value LIMIT 10")
def agg_facet_mem(spark, sf_dir):
    hits = read(spark, sf_dir, "part").filter("p_size > 10 and p_brand is not null")
    return hits.groupBy(F.col("p_brand").alias("value")).agg(_long("n")).orderBy(F.desc("n"), "value").limit(10)


@query(
    "agg_stats",
    f"WITH {SQL_UNITS} SELECT count(*) AS total_units, count(DISTINCT conversation_id) AS conversations, count(*) FILTER (type = 'question') AS questions, count(*) FILTER (type = 'code') AS code, count(*) FILTER (type = 'insight') AS insights FROM units",
)
def agg_stats(spark, sf_dir):
    def of(kind: str):
        return F.count(F.when(F.col("type") == kind, 1))

    return units(spark, sf_dir).agg(
        _long("total_units"), F.count_distinct("conversation_id").alias("conversations"), of("question").alias("questions"), of("code").alias("code"), of("insight").alias("insights")
    )


@query("agg_stats_api", f"WITH {SQL_DOCUMENTS} SELECT json_extract_string(metadata, '$.sourceId') AS source_id, count(*) AS n FROM docs GROUP BY 1")
def agg_stats_api(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.get_json_object("metadata", "$.sourceId").alias("source_id")).agg(_long("n"))


@query("agg_categories", f"WITH {SQL_UNITS} SELECT category, count(*) AS n FROM units WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category")
def agg_categories(spark, sf_dir):
    return units(spark, sf_dir).filter("category is not null").groupBy("category").agg(_long("n")).orderBy(F.desc("n"), "category")


_PER_DOC = f"{SQL_DOCUMENTS}, {SQL_DOCUMENT_UNITS}, per_doc AS (SELECT doc_id, count(*) AS n FROM doc_units GROUP BY doc_id)"


def _per_doc(spark, sf_dir):
    return document_units(spark, sf_dir).groupBy("doc_id").agg(_long("n"))


@query(
    "agg_chunk_totals",
    f"WITH {_PER_DOC} SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS units, count(*) FILTER (n > 1) AS chunked, round(100.0 * count(*) FILTER (n > 1) / count(*), 6) AS pct, round(avg(n), 6) AS mean, max(n) AS largest FROM per_doc",
)
def agg_chunk_totals(spark, sf_dir):
    many = F.count(F.when(F.col("n") > 1, 1))
    return _per_doc(spark, sf_dir).agg(
        _long("documents"), F.sum("n").alias("units"), many.alias("chunked"), F.round(F.lit(100.0) * many / F.count("*"), 6).alias("pct"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("largest")
    )


@query("agg_chunk_tags", f"WITH {SQL_DOCUMENT_UNITS} SELECT lang AS tag, count(DISTINCT doc_id) AS documents, count(*) AS units FROM doc_units GROUP BY lang")
def agg_chunk_tags(spark, sf_dir):
    by_doc = document_units(spark, sf_dir).groupBy("lang", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy(F.col("lang").alias("tag")).agg(_long("documents"), F.sum("n").alias("units"))


@query(
    "agg_chunk_formats",
    f"WITH {_PER_DOC} SELECT format, count(*) AS documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS units, count(*) FILTER (n > 1) AS chunked, round(avg(coalesce(n, 0)), 6) AS mean FROM docs LEFT JOIN per_doc ON id = doc_id GROUP BY format",
)
def agg_chunk_formats(spark, sf_dir):
    met = documents(spark, sf_dir).select("id", "format").join(_per_doc(spark, sf_dir), F.col("id") == F.col("doc_id"), "left")
    n = F.coalesce("n", F.lit(0))
    return met.groupBy("format").agg(_long("documents"), F.sum(n).alias("units"), F.count(F.when(F.col("n") > 1, 1)).alias("chunked"), F.round(F.avg(n), 6).alias("mean"))


@query(
    "agg_chunk_sources",
    f"WITH {_PER_DOC} SELECT coalesce(json_extract_string(metadata, '$.sourceId'), '(unknown)') AS source_id, count(*) AS documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS units FROM docs LEFT JOIN per_doc ON id = doc_id GROUP BY 1",
)
def agg_chunk_sources(spark, sf_dir):
    met = documents(spark, sf_dir).select("id", "metadata").join(_per_doc(spark, sf_dir), F.col("id") == F.col("doc_id"), "left")
    source = F.coalesce(F.get_json_object("metadata", "$.sourceId"), F.lit("(unknown)")).alias("source_id")
    return met.groupBy(source).agg(_long("documents"), F.sum(F.coalesce("n", F.lit(0))).alias("units"))


@query("agg_chunk_topdocs", f"WITH {_PER_DOC} SELECT doc_id, n FROM per_doc ORDER BY n DESC, doc_id LIMIT 25")
def agg_chunk_topdocs(spark, sf_dir):
    return _per_doc(spark, sf_dir).orderBy(F.desc("n"), "doc_id").limit(25)


@query("agg_units_per_doc", f"WITH {SQL_DOCUMENT_UNITS} SELECT count(*) AS n FROM doc_units WHERE doc_id = 7")
def agg_units_per_doc(spark, sf_dir):
    return document_units(spark, sf_dir).filter("doc_id = 7").agg(_long("n"))


_LOG = "log AS (SELECT event_id, ts, user_id, event_type || ' ' || CAST(user_id % 50 AS VARCHAR) AS query, event_type AS search_type, value AS latency, props FROM events)"


def query_log(spark, sf_dir):
    """The search log: the event stream read as queries with a type, a session and a latency."""
    text = F.concat_ws(" ", "event_type", F.pmod("user_id", F.lit(50)).cast("string"))
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", T.normalize_query(text).alias("query"), F.col("event_type").alias("search_type"), F.col("value").alias("latency"), "props")


def trailing(log, days: int):
    """Rows of the last `days` days before the newest row."""
    newest = log.agg(F.max("ts").alias("newest"))  # one row
    return log.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr(f"interval {days} days")).drop("newest")


_RECENT = f"{_LOG}, recent AS (SELECT * FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 7 DAY)"


@query("agg_popular_queries", f"WITH {_RECENT} SELECT query, count(*) AS n, round(avg(latency), 6) AS mean_latency FROM recent GROUP BY query ORDER BY n DESC, query LIMIT 20")
def agg_popular_queries(spark, sf_dir):
    found = trailing(query_log(spark, sf_dir), 7).groupBy("query").agg(_long("n"), F.round(F.avg("latency"), 6).alias("mean_latency"))
    return found.orderBy(F.desc("n"), "query").limit(20)


@query("agg_search_stats", f"WITH {_RECENT} SELECT search_type, count(*) AS total, count(DISTINCT query) AS distinct_queries, round(avg(latency), 6) AS mean_latency FROM recent GROUP BY search_type")
def agg_search_stats(spark, sf_dir):
    return trailing(query_log(spark, sf_dir), 7).groupBy("search_type").agg(_long("total"), F.count_distinct("query").alias("distinct_queries"), F.round(F.avg("latency"), 6).alias("mean_latency"))


@query("agg_query_metrics", f"WITH {_LOG} SELECT coalesce(search_type, 'all') AS search_type, count(*) AS total, round(avg(latency), 6) AS mean_latency, round(max(latency), 6) AS slowest FROM log GROUP BY ROLLUP (search_type)")
def agg_query_metrics(spark, sf_dir):
    """Metrics of all queries and of each search type."""
    grouped = query_log(spark, sf_dir).rollup("search_type").agg(_long("total"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.round(F.max("latency"), 6).alias("slowest"))
    return grouped.withColumn("search_type", F.coalesce("search_type", F.lit("all")))


@query(
    "agg_search_analytics_api",
    f"""WITH {_LOG}, p AS (SELECT unnest([1, 7, 30]) AS days), newest AS (SELECT max(ts) AS t FROM log)
    SELECT CAST(days AS INT) AS days, count(*) AS total, count(DISTINCT user_id) AS sessions FROM log, p, newest WHERE ts >= t - to_days(days) GROUP BY days""",
)
def agg_search_analytics_api(spark, sf_dir):
    log = query_log(spark, sf_dir)
    newest = F.broadcast(log.agg(F.max("ts").alias("newest")))  # one row
    age = log.join(newest).withColumn("days", F.explode(F.array(F.lit(1), F.lit(7), F.lit(30))))
    return age.filter(F.col("ts") >= F.col("newest") - F.make_dt_interval("days")).groupBy("days").agg(_long("total"), F.count_distinct("user_id").alias("sessions"))


@query("st_trailing_window", f"WITH {_RECENT} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM recent GROUP BY 1")
def st_trailing_window(spark, sf_dir):
    return trailing(query_log(spark, sf_dir), 7).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(_long("n"))


@query("st_tumbling_quota", "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS used, count(*) > 3 AS over FROM events GROUP BY 1, 2")
def st_tumbling_quota(spark, sf_dir):
    """Requests of every user in clock-aligned hours, against a quota of three."""
    grouped = read(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(_long("used"))
    return grouped.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "used", (F.col("used") > 3).alias("over"))


@query(
    "quota_status",
    """WITH used AS (SELECT user_id, count(*) AS used FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY user_id)
    SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'pro' ELSE 'free' END AS tier, used, greatest(0, CASE WHEN user_id % 10 = 0 THEN 50 ELSE 5 END - used) AS remaining FROM used""",
)
def quota_status(spark, sf_dir):
    used = trailing(read(spark, sf_dir, "events"), 1).groupBy("user_id").agg(_long("used"))
    pro = F.pmod("user_id", F.lit(10)) == 0
    return used.select("user_id", F.when(pro, "pro").otherwise("free").alias("tier"), "used", F.greatest(F.lit(0).cast("long"), F.when(pro, 50).otherwise(5) - F.col("used")).alias("remaining"))


@query(
    "agg_wordcloud",
    f"""WITH {SQL_UNITS}, {SQL_TOKENS}, tags AS (SELECT tag AS term, count(*) AS v FROM (SELECT unnest(tags) AS tag FROM units) GROUP BY tag ORDER BY v DESC, term LIMIT 30),
    words AS (SELECT normalized AS term, count(*) AS v FROM tokens WHERE length(normalized) > 4 GROUP BY 1 ORDER BY v DESC, term LIMIT 30),
    merged AS (SELECT term, 'tag' AS source, v FROM tags UNION ALL SELECT term, 'keyword', v FROM words)
    SELECT term, source, v, CAST(round(100.0 * v / greatest(1, (SELECT max(v) FROM merged))) AS BIGINT) AS normalized FROM merged ORDER BY v DESC, term, source LIMIT 30""",
)
def agg_wordcloud(spark, sf_dir):
    """Tags and keywords, the top of each merged and scaled to the largest; the scale runs over at most 60 rows."""
    tags = units(spark, sf_dir).select(F.explode("tags").alias("term")).groupBy("term").agg(_long("v")).orderBy(F.desc("v"), "term").limit(30)
    words = tokens(spark, sf_dir).filter(F.length("normalized") > 4).groupBy(F.col("normalized").alias("term")).agg(_long("v")).orderBy(F.desc("v"), "term").limit(30)
    merged = tags.withColumn("source", F.lit("tag")).unionByName(words.withColumn("source", F.lit("keyword")))
    most = F.greatest(F.lit(1), F.max("v").over(Window.partitionBy(F.lit(1))))
    return merged.select("term", "source", "v", F.round(F.lit(100.0) * F.col("v") / most).cast("long").alias("normalized")).orderBy(F.desc("v"), "term", "source").limit(30)


@query("agg_tags_all", f"WITH {SQL_UNITS}, known AS (SELECT unnest(['go', 'java', 'sql', 'insight', 'question', 'unused']) AS tag), used AS (SELECT unnest(tags) AS tag FROM units) SELECT k.tag, count(u.tag) AS n FROM known k LEFT JOIN used u ON k.tag = u.tag GROUP BY k.tag")
def agg_tags_all(spark, sf_dir):
    """Tags of a list with their counts, unused ones too; counts are grouped before the join."""
    used = units(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(_long("n"))
    known = spark.createDataFrame([(t,) for t in ("go", "java", "sql", "insight", "question", "unused")], "tag string")
    return known.join(used, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("agg_tags_summary", f"WITH {SQL_UNITS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM units) GROUP BY tag ORDER BY n DESC, tag LIMIT 5")
def agg_tags_summary(spark, sf_dir):
    return units(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(_long("n")).orderBy(F.desc("n"), "tag").limit(5)


@query("agg_tags_array", f"""WITH {SQL_UNITS} SELECT id, '["' || array_to_string(list_sort(tags), '","') || '"]' AS tags_json FROM units""")
def agg_tags_array(spark, sf_dir):
    bridge = units(spark, sf_dir).select("id", F.explode("tags").alias("tag"))
    return bridge.groupBy("id").agg(F.to_json(F.sort_array(F.collect_list("tag"))).alias("tags_json"))


@query("agg_rel_types", f"WITH {SQL_EDGES} SELECT relationship_type, count(*) AS n FROM edges WHERE src = 'p7' OR dst = 's7' GROUP BY relationship_type")
def agg_rel_types(spark, sf_dir):
    return edges(spark, sf_dir).filter("src = 'p7' or dst = 's7'").groupBy("relationship_type").agg(_long("n"))


@query(
    "agg_collection_stats",
    "WITH per AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT count(DISTINCT n_nationkey) AS collections, CAST(sum(coalesce(n, 0)) AS BIGINT) AS members, round(avg(n), 6) AS mean_of_nonempty, max(coalesce(n, 0)) AS largest FROM nation LEFT JOIN per ON n_nationkey = k",
)
def agg_collection_stats(spark, sf_dir):
    per = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(_long("n"))
    met = read(spark, sf_dir, "nation").join(per, F.col("n_nationkey") == F.col("k"), "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return met.agg(F.count_distinct("n_nationkey").alias("collections"), F.sum(n).alias("members"), F.round(F.avg("n"), 6).alias("mean_of_nonempty"), F.max(n).alias("largest"))


@query("agg_embed_status", "SELECT count(*) FILTER (quality = 1) AS generated, count(*) FILTER (quality = 0) AS pending, count(*) AS total FROM labels")
def agg_embed_status(spark, sf_dir):
    return read(spark, sf_dir, "labels").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("generated"), F.count(F.when(F.col("quality") == 0, 1)).alias("pending"), _long("total"))


@query(
    "agg_universe_summary",
    f"WITH {SQL_TOKENS} SELECT count(DISTINCT role) AS providers, count(DISTINCT thread_id) AS threads, count(DISTINCT (thread_id, turn_index)) AS turns, count(DISTINCT normalized) AS terms, count(*) AS occurrences FROM tokens",
)
def agg_universe_summary(spark, sf_dir):
    """Counts of providers, threads, turns, terms and occurrences; each distinct count is a grouped step of its own."""
    t = tokens(spark, sf_dir)
    parts = [
        t.select("role").distinct().agg(_long("providers")),
        t.select("thread_id").distinct().agg(_long("threads")),
        t.select("thread_id", "turn_index").distinct().agg(_long("turns")),
        t.select("normalized").distinct().agg(_long("terms")),
        t.agg(_long("occurrences")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


@query("agg_doc_freq", f"WITH {SQL_TOKENS} SELECT normalized, count(DISTINCT thread_id) AS doc_freq FROM tokens GROUP BY normalized")
def agg_doc_freq(spark, sf_dir):
    return tokens(spark, sf_dir).select("normalized", "thread_id").distinct().groupBy("normalized").agg(_long("doc_freq"))


@query("agg_thread_turncount", "SELECT conv_id AS thread_id, count(*) AS turns FROM conversations GROUP BY conv_id")
def agg_thread_turncount(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(_long("turns"))


@query(
    "agg_taxonomy_audit",
    "WITH t AS (SELECT p_type AS raw FROM part) SELECT count(*) AS total, count(*) FILTER (lower(raw) NOT IN ('programming', 'writing', 'research', 'design', 'devops', 'data', 'general')) AS unknown, count(*) FILTER (raw <> lower(raw)) AS malformed FROM t",
)
def agg_taxonomy_audit(spark, sf_dir):
    raw = F.col("p_type")
    known = F.lower(raw).isin(taxonomy.CATEGORIES)
    return read(spark, sf_dir, "part").agg(_long("total"), F.count(F.when(~known, 1)).alias("unknown"), F.count(F.when(raw != F.lower(raw), 1)).alias("malformed"))


@query(
    "agg_graph_stats",
    f"""WITH {SQL_EDGES}, nodes AS (SELECT DISTINCT unnest([src, dst]) AS node FROM edges), o AS (SELECT src AS node, count(DISTINCT dst) AS o FROM edges GROUP BY 1), i AS (SELECT dst AS node, count(*) AS i FROM edges GROUP BY 1),
    d AS (SELECT n.node, coalesce(o, 0) + coalesce(i, 0) AS degree FROM nodes n LEFT JOIN o ON n.node = o.node LEFT JOIN i ON n.node = i.node)
    SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree, round((SELECT count(*) FROM edges) / (count(*) * (count(*) - 1.0)), 9) AS density, CAST(1 AS INT) AS components FROM d""",
)
def agg_graph_stats(spark, sf_dir):
    """Degree is distinct out-neighbours plus incoming edges; components is always 1."""
    e = edges(spark, sf_dir)
    out = e.select(F.col("src").alias("node"), "dst").distinct().groupBy("node").agg(F.count("*").alias("d"))
    degree = out.unionByName(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("d"))).groupBy("node").agg(F.sum("d").alias("degree"))
    n = F.count("*")
    total = degree.agg(n.alias("nodes"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))
    all_edges = e.agg(F.count("*").alias("edges"))
    density = F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0)), 9)
    return total.join(all_edges).select("nodes", "edges", "mean_degree", "max_degree", density.alias("density"), F.lit(1).alias("components"))


@query("agg_cost", f"WITH {SQL_UNITS} SELECT role, CAST(sum(CAST(ceil(length(content) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, round(sum(CAST(ceil(length(content) / 4.0) AS BIGINT)) * 3.0 / 1000000, 9) AS cost FROM units GROUP BY role")
def agg_cost(spark, sf_dir):
    """Estimated tokens (a quarter of the characters, rounded up) and their price at 3 per million."""
    n = F.sum(F.ceil(F.length("content") / 4.0))
    return units(spark, sf_dir).groupBy("role").agg(n.alias("tokens"), F.round(n * 3.0 / 1000000, 9).alias("cost"))


@query("cost_message", f"WITH {SQL_UNITS} SELECT id, round((ceil(length(content) / 4.0) * 3.0 + ceil(length(context) / 4.0) * 0.3) / 1000000, 12) AS cost FROM units")
def cost_message(spark, sf_dir):
    cost = (F.ceil(F.length("content") / 4.0) * 3.0 + F.ceil(F.length("context") / 4.0) * 0.3) / 1000000
    return units(spark, sf_dir).select("id", F.round(cost, 12).alias("cost"))


@query("agg_dup_files", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS keeper, CAST((count(*) - 1) * min(octet_length(encode(text))) AS BIGINT) AS wasted FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg_dup_files(spark, sf_dir):
    """Files of equal content and the bytes that copies waste; only files whose size repeats are hashed."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").alias("size"))
    sizes = docs.groupBy("size").agg(F.count("*").alias("n")).filter("n > 1").select("size")
    grouped = docs.join(sizes, "size", "left_semi").groupBy(F.sha2("text", 256).alias("hash")).agg(_long("copies"), F.min("doc_id").alias("keeper"), F.min("size").alias("size"))
    return grouped.filter("copies > 1").select("hash", "copies", "keeper", ((F.col("copies") - 1) * F.col("size")).alias("wasted"))


@query("agg_container_richness", r"SELECT regexp_extract(url, '://([^/?#]*)', 1) AS container, count(*) AS files FROM pages GROUP BY 1")
def agg_container_richness(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("container")).agg(_long("files"))


@query("distinct", f"WITH {SQL_UNITS} SELECT DISTINCT category, type FROM units")
def distinct(spark, sf_dir):
    return units(spark, sf_dir).select("category", "type").distinct()


_TAGS = "tagged AS (SELECT p_name AS tag, count(*) AS n FROM part GROUP BY 1)"


@query("agg_tag_case_variants", "SELECT lower(p_type) AS folded, count(DISTINCT p_type) AS variants, count(*) AS uses FROM (SELECT p_type FROM part UNION ALL SELECT upper(p_type) FROM part WHERE p_size > 25) GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def agg_tag_case_variants(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    both = part.select("p_type").unionByName(part.filter("p_size > 25").select(F.upper("p_type").alias("p_type")))
    by_form = both.groupBy(F.lower("p_type").alias("folded"), "p_type").agg(F.count("*").alias("n"))
    return by_form.groupBy("folded").agg(_long("variants"), F.sum("n").alias("uses")).filter("variants > 1")


_PATHS = """paths AS (SELECT host || '/' || path AS tag FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) AS path FROM pages)),
nodes AS (SELECT array_to_string(p[:i], '/') AS node, i AS depth, len(p) = i AS leaf FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split(tag, '/') AS p FROM paths)))"""


def tag_nodes(spark, sf_dir):
    """Prefixes of /-separated tags: node, depth (from 1) and whether the tag ends there."""
    host, path = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*/([^/?#]*)", 1)
    p = read(spark, sf_dir, "pages").select(F.split(F.concat_ws("/", host, path), "/").alias("p"))
    each = p.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    return each.select(F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("node"), F.col("depth").cast("long").alias("depth"), (F.size("p") == F.col("depth")).alias("leaf"))


@query("agg_tag_levels", f"WITH {_PATHS} SELECT depth, count(DISTINCT node) AS nodes FROM nodes GROUP BY depth")
def agg_tag_levels(spark, sf_dir):
    return tag_nodes(spark, sf_dir).select("depth", "node").distinct().groupBy("depth").agg(_long("nodes"))


@query("agg_tag_tree_stats", f"WITH {_PATHS}, n AS (SELECT node, max(depth) AS depth, bool_and(leaf) AS leaf FROM nodes GROUP BY node) SELECT count(*) AS nodes, max(depth) AS depth, count(*) FILTER (leaf) AS leaves, count(*) FILTER (NOT leaf) AS branches FROM n")
def agg_tag_tree_stats(spark, sf_dir):
    n = tag_nodes(spark, sf_dir).groupBy("node").agg(F.max("depth").alias("depth"), F.bool_and("leaf").alias("leaf"))
    return n.agg(_long("nodes"), F.max("depth").alias("depth"), F.count(F.when(F.col("leaf"), 1)).alias("leaves"), F.count(F.when(~F.col("leaf"), 1)).alias("branches"))


@query("gr_tag_tree", f"WITH {_PATHS} SELECT node, max(depth) AS depth, count(*) AS uses, count(*) FILTER (leaf) AS ends FROM nodes GROUP BY node")
def gr_tag_tree(spark, sf_dir):
    return tag_nodes(spark, sf_dir).groupBy("node").agg(F.max("depth").alias("depth"), _long("uses"), F.count(F.when(F.col("leaf"), 1)).alias("ends"))


@query(
    "agg_insight_stats",
    f"WITH {SQL_UNITS} SELECT category, count(*) AS n, round(avg(length(content)), 6) AS mean_length, max(length(content)) AS longest FROM units WHERE type IN ('insight', 'decision') GROUP BY category",
)
def agg_insight_stats(spark, sf_dir):
    size = F.length("content").cast("long")
    return units(spark, sf_dir).filter(F.col("type").isin("insight", "decision")).groupBy("category").agg(_long("n"), F.round(F.avg(size), 6).alias("mean_length"), F.max(size).alias("longest"))


@query("agg_pages_telemetry", r"SELECT count(*) AS pages, count(*) FILTER (html ILIKE '%<article%') AS built, count(*) FILTER (html IS NULL OR html = '') AS errored, count(DISTINCT regexp_extract(url, '://([^/?#]*)', 1)) AS hosts FROM pages")
def agg_pages_telemetry(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return read(spark, sf_dir, "pages").agg(_long("pages"), F.count(F.when(F.col("html").ilike("%<article%"), 1)).alias("built"), F.count(F.when(F.col("html").isNull() | (F.col("html") == ""), 1)).alias("errored"), F.count_distinct(host).alias("hosts"))
