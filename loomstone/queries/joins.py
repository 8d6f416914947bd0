"""Joins, set operations and change capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import cooccurrence
from loomstone.operators.changes import capture_changes, scan_summary, upsert
from loomstone.registry import query
from loomstone.sources.tables import SQL_DOCUMENT_UNITS, SQL_EDGES, SQL_TOKENS, SQL_UNITS, document_units, edges, read, tokens, units


def _n():
    return F.count("*").cast("long").alias("n")


@query("join_unit_tags", f"WITH {SQL_UNITS}, bridge AS (SELECT id, unnest(tags) AS tag FROM units) SELECT u.id, u.type, b.tag FROM units u JOIN bridge b ON u.id = b.id WHERE b.tag <> u.type")
def join_unit_tags(spark, sf_dir):
    u = units(spark, sf_dir)
    bridge = u.select("id", F.explode("tags").alias("tag"))
    return u.select("id", "type").join(bridge, "id").filter("tag <> type")


@query("join_tags_left", "SELECT p.p_brand AS tag, count(l.l_partkey) AS n FROM part p LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) l ON p.p_partkey = l.l_partkey GROUP BY p.p_brand")
def join_tags_left(spark, sf_dir):
    uses = read(spark, sf_dir, "lineitem").filter("l_quantity > 49").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    met = read(spark, sf_dir, "part").join(uses, F.col("p_partkey") == F.col("l_partkey"), "left")
    return met.groupBy(F.col("p_brand").alias("tag")).agg(F.coalesce(F.sum("uses"), F.lit(0)).cast("long").alias("n"))


@query("join_docs_counts", f"WITH {SQL_DOCUMENT_UNITS}, c AS (SELECT doc_id, count(*) AS n FROM doc_units GROUP BY doc_id) SELECT d.doc_id, d.lang, coalesce(c.n, 0) AS n FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id")
def join_docs_counts(spark, sf_dir):
    counts = document_units(spark, sf_dir).groupBy("doc_id").agg(_n())
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(counts, "doc_id", "left").select("doc_id", "lang", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("join_fts", f"WITH {SQL_UNITS}, {SQL_TOKENS}, postings AS (SELECT thread_id || '-' || turn_index AS id, count(*) AS tf FROM tokens WHERE normalized = 'the' GROUP BY 1) SELECT u.id, u.type, p.tf FROM units u JOIN postings p ON u.id = p.id")
def join_fts(spark, sf_dir):
    postings = tokens(spark, sf_dir).filter("normalized = 'the'").groupBy(F.concat_ws("-", "thread_id", "turn_index").alias("id")).agg(F.count("*").cast("long").alias("tf"))
    return units(spark, sf_dir).select("id", "type").join(postings, "id")


@query(
    "join_occurrences",
    f"WITH {SQL_TOKENS}, lexicon AS (SELECT normalized, count(*) AS uses FROM tokens GROUP BY 1), turns AS (SELECT conv_id, turn, length(text) AS size FROM conversations) SELECT t.thread_id, t.turn_index, t.position, l.uses, u.size FROM tokens t JOIN lexicon l ON t.normalized = l.normalized JOIN turns u ON t.thread_id = u.conv_id AND t.turn_index = u.turn WHERE l.uses <= 2",
)
def join_occurrences(spark, sf_dir):
    t = tokens(spark, sf_dir)
    lexicon = t.groupBy("normalized").agg(F.count("*").cast("long").alias("uses")).filter("uses <= 2")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("turn_index"), F.length("text").cast("long").alias("size"))
    return t.join(lexicon, "normalized").join(turns, ["thread_id", "turn_index"]).select("thread_id", "turn_index", "position", "uses", "size")


_PAIRS = """terms AS (SELECT DISTINCT thread_id, normalized FROM tokens),
weights AS (SELECT a.thread_id AS src, b.thread_id AS dst, count(*) AS weight FROM terms a JOIN terms b ON a.normalized = b.normalized AND a.thread_id % 50 = 0 AND a.thread_id <> b.thread_id GROUP BY 1, 2)"""

_ALL_PAIRS = """terms AS (SELECT DISTINCT thread_id, normalized FROM tokens),
weights AS (SELECT a.thread_id AS src, b.thread_id AS dst, count(*) AS weight FROM terms a JOIN terms b ON a.normalized = b.normalized AND a.thread_id <> b.thread_id GROUP BY 1, 2)"""


def _all_terms(spark, sf_dir):
    """id and term of the threads' terms, terms by name, and which ids are queries: all threads."""
    t = tokens(spark, sf_dir)
    return t.select(F.col("thread_id").cast("long").alias("id"), cooccurrence.named(t, "normalized").alias("term")), F.lit(True)


def _thread_terms(spark, sf_dir):
    """_all_terms(), but with a query set: threads whose id is divisible by 50."""
    return _all_terms(spark, sf_dir)[0], F.col("id") % 50 == 0


@query("join_cooccur", f"WITH {SQL_TOKENS}, {_ALL_PAIRS} SELECT src, dst, weight FROM weights")
def join_cooccur(spark, sf_dir):
    """Weights of all thread pairs, in both directions: how many terms they share, whatever the term's frequency."""
    return cooccurrence.pairs(*_all_terms(spark, sf_dir))


@query("agg_cooccur", f"WITH {SQL_TOKENS}, {_PAIRS} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM weights) WHERE r <= 100")
def agg_cooccur(spark, sf_dir):
    """Full rebuild: the heaviest 100 links of every thread of the query set."""
    return cooccurrence.heaviest_each(*_thread_terms(spark, sf_dir), 100).drop("r")


@query("win_cooccur_top100", f"WITH {SQL_TOKENS}, {_ALL_PAIRS} SELECT src, dst, r FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM weights) WHERE r <= 100")
def win_cooccur_top100(spark, sf_dir):
    """The heaviest 100 links of every thread."""
    return cooccurrence.heaviest_each(*_all_terms(spark, sf_dir), 100).select("src", "dst", F.col("r").cast("long").alias("r"))


@query("gr_cooccur_network", f"WITH {SQL_TOKENS}, {_ALL_PAIRS} SELECT src, dst, weight FROM weights WHERE weight >= 2 ORDER BY weight DESC, src, dst LIMIT 200")
def gr_cooccur_network(spark, sf_dir):
    """The 200 heaviest links of all threads, in both directions."""
    return cooccurrence.heaviest(*_all_terms(spark, sf_dir), 200, least=2)


@query("join_threads_turncounts", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS thread, n_name AS provider, coalesce(n, 0) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN c ON c_custkey = o_custkey")
def join_threads_turncounts(spark, sf_dir):
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(_n())
    met = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    met = met.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.select(F.col("c_custkey").alias("thread"), F.col("n_name").alias("provider"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("join_conv_provider", "SELECT c_custkey, coalesce(n.n_name, r.r_name, 'unknown') AS provider FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON c.c_nationkey = r.r_regionkey")
def join_conv_provider(spark, sf_dir):
    n = read(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0")
    met = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(read(spark, sf_dir, "region"), F.col("c_nationkey") == F.col("r_regionkey"), "left")
    return met.select("c_custkey", F.coalesce("n_name", "r_name", F.lit("unknown")).alias("provider"))


@query("join_related", f"WITH {SQL_EDGES} SELECT e.dst, p.p_name FROM edges e JOIN part p ON e.src = 'p' || p.p_partkey WHERE e.relationship_type = 'builds_on' AND e.confidence = 1")
def join_related(spark, sf_dir):
    e = edges(spark, sf_dir).filter("relationship_type = 'builds_on' and confidence = 1")
    return e.join(read(spark, sf_dir, "part").withColumn("src", F.concat(F.lit("p"), "p_partkey")), "src").select("dst", "p_name")


@query("join_fed_source", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_fed_source(spark, sf_dir):
    met = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return met.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("join_collection_units", "SELECT n_name AS collection, c_custkey AS unit FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 5000")
def join_collection_units(spark, sf_dir):
    members = read(spark, sf_dir, "customer").filter("c_acctbal > 5000")
    return read(spark, sf_dir, "nation").join(members, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("collection"), F.col("c_custkey").alias("unit"))


@query("join_favorites", "SELECT d.doc_id, d.source FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) f ON d.doc_id = f.doc_id")
def join_favorites(spark, sf_dir):
    favourites = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(favourites, "doc_id")


@query("join_parity_semi", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def join_parity_semi(spark, sf_dir):
    stored = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return read(spark, sf_dir, "embeddings").select("vec_id", "label").join(stored, "vec_id", "left_semi")


@query("join_edges_induced", f"WITH {SQL_EDGES}, keep AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size <= 10 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) SELECT src, dst, relationship_type FROM edges WHERE src IN (SELECT node FROM keep) AND dst IN (SELECT node FROM keep)")
def join_edges_induced(spark, sf_dir):
    parts = read(spark, sf_dir, "part").filter("p_size <= 10").select(F.concat(F.lit("p"), "p_partkey").alias("src"))
    suppliers = read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return edges(spark, sf_dir).join(parts, "src", "left_semi").join(suppliers, "dst", "left_semi").select("src", "dst", "relationship_type")


@query("join_new_only", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_new_only(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("join_fed_missing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1996-01-01')")
def join_fed_missing(spark, sf_dir):
    seen = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("date")).select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti")


@query("set_diff_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 0")
def set_diff_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").subtract(read(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id"))


@query("set_union_ranked", f"WITH {SQL_UNITS} SELECT tag AS term, 'tag' AS source FROM (SELECT unnest(tags) AS tag FROM units) UNION ALL SELECT role, 'keyword' FROM units")
def set_union_ranked(spark, sf_dir):
    u = units(spark, sf_dir)
    tags = u.select(F.explode("tags").alias("term"), F.lit("tag").alias("source"))
    return tags.unionByName(u.select(F.col("role").alias("term"), F.lit("keyword").alias("source")))


@query("set_union_sources", "SELECT 'documents' AS source, doc_id AS item FROM documents UNION ALL SELECT 'pages', page_id FROM pages UNION ALL SELECT 'benchmark', item_id FROM benchmark")
def set_union_sources(spark, sf_dir):
    parts = [("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id")]
    frames = [read(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(k).alias("item")) for t, k in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("intersect", "SELECT doc_id, len(list_intersect(w, v)) AS shared, len(list_distinct(list_concat(w, v))) AS together FROM (SELECT doc_id, list_distinct(string_split(lower(substr(text, 1, length(text) // 2)), ' ')) AS w, list_distinct(string_split(lower(substr(text, length(text) // 2 + 1)), ' ')) AS v FROM documents)")
def intersect(spark, sf_dir):
    """Shared and joint words of a document's two halves (arrays as sets)."""
    half = F.floor(F.length("text") / 2).cast("int")
    w, v = (F.split(F.lower(x), " ") for x in (F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(w).alias("w"), F.array_distinct(v).alias("v"))
    return docs.select("doc_id", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"), F.size(F.array_union("w", "v")).cast("long").alias("together"))


_VERSIONS = """old AS (SELECT doc_id AS id, md5(text) AS hash FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)"""


def _versions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    changed = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    return old, docs.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), F.md5(changed).alias("hash"))


@query("sink_fed_upsert", f"WITH {_VERSIONS} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN o.hash = n.hash THEN 'skip' ELSE 'update' END AS action FROM old o FULL JOIN new n ON o.id = n.id")
def sink_fed_upsert(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return capture_changes(old, new, ["id"], "hash", full=True).select("id", "action")


@query("sink_units_upsert", f"WITH {_VERSIONS} SELECT id, hash FROM new UNION ALL SELECT id, hash FROM old WHERE id NOT IN (SELECT id FROM new)")
def sink_units_upsert(spark, sf_dir):
    return upsert(*_versions(spark, sf_dir), ["id"])


@query("sink_export_state", f"WITH {_VERSIONS} SELECT n.id, o.id IS NULL AS is_new FROM new n LEFT JOIN old o ON n.id = o.id")
def sink_export_state(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    seen = old.select("id", F.lit(True).alias("seen"))
    return new.join(seen, "id", "left").select("id", F.col("seen").isNull().alias("is_new"))


@query("sink_delete_doc_units", f"WITH {SQL_DOCUMENT_UNITS} SELECT doc_id, count(*) AS n FROM doc_units WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id")
def sink_delete_doc_units(spark, sf_dir):
    gone = read(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return document_units(spark, sf_dir).join(gone, "doc_id", "left_anti").groupBy("doc_id").agg(_n())


@query("sink_rel_upsert", f"WITH {SQL_EDGES} SELECT src, dst, relationship_type, CASE WHEN confidence > 0.9 THEN 0.95 ELSE confidence END AS confidence FROM edges WHERE relationship_type <> 'contradicts'")
def sink_rel_upsert(spark, sf_dir):
    """Edges upserted by (src, dst, type), then one type deleted."""
    e = edges(spark, sf_dir)
    new = e.filter("confidence > 0.9").withColumn("confidence", F.lit(0.95))
    return upsert(e, new, ["src", "dst", "relationship_type"]).filter("relationship_type <> 'contradicts'")


@query("sink_universe_upsert", "SELECT conv_id AS thread_id, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY 1")
def sink_universe_upsert(spark, sf_dir):
    """Threads replaced by key: the row with the most turns stays."""
    return read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(F.count("*").cast("long").alias("turns"), F.max("turn").alias("last_turn"))


@query("sink_md_files", f"WITH {SQL_UNITS} SELECT strftime(make_timestamp(created * 1000000), '%Y-%m') AS year_month, type, category, count(*) AS n FROM units GROUP BY 1, 2, 3")
def sink_md_files(spark, sf_dir):
    """The monthly index of exported units."""
    month = F.date_format(F.timestamp_seconds("created"), "yyyy-MM").alias("year_month")
    return units(spark, sf_dir).groupBy(month, "type", "category").agg(_n())


@query("pages_curation", r"SELECT page_id, lower(regexp_extract(url, '://([^?#]*)', 1)) AS full_name, coalesce(c.rank, 0) AS rank FROM pages LEFT JOIN (SELECT 'example.org' AS suffix, 1 AS rank UNION ALL SELECT 'example.net', 2) c ON regexp_extract(url, '([^./]+\.[a-z]+)/', 1) = c.suffix")
def pages_curation(spark, sf_dir):
    curated = spark.createDataFrame([("example.org", 1), ("example.net", 2)], "suffix string, rank int")
    p = read(spark, sf_dir, "pages").withColumn("suffix", F.regexp_extract("url", r"([^./]+\.[a-z]+)/", 1))
    return p.join(F.broadcast(curated), "suffix", "left").select("page_id", F.lower(F.regexp_extract("url", "://([^?#]*)", 1)).alias("full_name"), F.coalesce("rank", F.lit(0)).alias("rank"))


@query("join_collections_for_unit", "SELECT o_custkey AS unit, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS collections FROM orders GROUP BY 1")
def join_collections_for_unit(spark, sf_dir):
    """The collections that hold each unit."""
    members = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), "o_orderpriority").distinct()
    return members.groupBy("unit").agg(F.array_join(F.sort_array(F.collect_list("o_orderpriority")), ",").alias("collections"))


@query("list_chat_network", f"WITH {SQL_TOKENS}, {_PAIRS}, e AS (SELECT * FROM weights WHERE weight >= 2 ORDER BY weight DESC, src, dst LIMIT 200), n AS (SELECT src AS thread FROM e UNION SELECT dst FROM e) SELECT conv_id AS thread, count(*) AS turns, max(length(text)) AS longest FROM conversations WHERE conv_id IN (SELECT thread FROM n) GROUP BY 1")
def list_chat_network(spark, sf_dir):
    """The nodes of the chat network: threads at the ends of its heaviest 200 links."""
    e = cooccurrence.heaviest(*_thread_terms(spark, sf_dir), 200, least=2)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("conv_id")).distinct()
    turns = read(spark, sf_dir, "conversations").join(nodes, "conv_id", "left_semi")
    return turns.groupBy(F.col("conv_id").alias("thread")).agg(F.count("*").cast("long").alias("turns"), F.max(F.length("text")).cast("long").alias("longest"))


@query("fed_scan_run", """WITH old AS (SELECT source, doc_id AS id, md5(text) AS hash FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT source, doc_id AS id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.source, n.source) AS source, count(n.id) AS scanned, count(*) FILTER (n.id IS NOT NULL AND n.hash IS DISTINCT FROM o.hash) AS indexed, count(*) FILTER (n.hash = o.hash) AS skipped, count(*) FILTER (n.id IS NULL) AS deleted, 'completed' AS status
FROM old o FULL JOIN new n ON o.source = n.source AND o.id = n.id GROUP BY 1""")
def fed_scan_run(spark, sf_dir):
    """A full scan of every source against what is indexed: the run's counters and state."""
    docs = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), "text")
    changed = F.when(F.pmod("id", F.lit(5)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.filter("id % 7 <> 0").select("source", "id", F.md5("text").alias("hash"))
    new = docs.filter("id % 11 <> 0").select("source", "id", F.md5(changed).alias("hash"))
    return scan_summary(capture_changes(old, new, ["source", "id"], "hash", full=True), ["source"]).withColumn("status", F.lit("completed"))
