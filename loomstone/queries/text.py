"""Text dataflow: units from messages and documents, chunks, terms, redaction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import taxonomy
from loomstone.functions import text as T
from loomstone.operators import chunking, intake, redaction
from loomstone.registry import query
from loomstone.sources.tables import SQL_DOCUMENT_UNITS, SQL_TOKENS, SQL_UNITS, document_units, documents, read, sql_title, tokens, units


@query("txt_atomize_messages", f"WITH {SQL_UNITS} SELECT id, type, title, category, array_to_string(tags, ',') AS tags, md5(context) AS context_md5 FROM units")
def txt_atomize_messages(spark, sf_dir):
    return units(spark, sf_dir).select("id", "type", "title", "category", F.array_join("tags", ",").alias("tags"), F.md5("context").alias("context_md5"))


@query("txt_infer_type", f"WITH {SQL_UNITS} SELECT role, type, count(*) AS n FROM units GROUP BY role, type")
def txt_infer_type(spark, sf_dir):
    return units(spark, sf_dir).groupBy("role", "type").agg(F.count("*").cast("long").alias("n"))


@query("txt_title", f"SELECT doc_id, {sql_title('text')} AS title FROM documents")
def txt_title(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.title_of(F.col("text")).alias("title"))


@query("txt_categorize", f"WITH {SQL_UNITS} SELECT id, category FROM units WHERE category <> 'general'")
def txt_categorize(spark, sf_dir):
    return units(spark, sf_dir).filter("category <> 'general'").select("id", "category")


@query("txt_auto_tag", f"WITH {SQL_UNITS} SELECT tag, count(*) AS n, count(DISTINCT conversation_id) AS conversations FROM (SELECT conversation_id, unnest(tags) AS tag FROM units) GROUP BY tag")
def txt_auto_tag(spark, sf_dir):
    each = units(spark, sf_dir).select("conversation_id", F.explode("tags").alias("tag"))
    return each.groupBy("tag").agg(F.count("*").cast("long").alias("n"), F.count_distinct("conversation_id").alias("conversations"))


@query(
    "txt_keywords",
    r"""WITH w AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 4) AS w FROM documents)),
    c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c)
    SELECT doc_id, string_agg(word, ',' ORDER BY r) AS keywords FROM r WHERE r <= 10 GROUP BY doc_id""",
)
def txt_keywords(spark, sf_dir):
    """The ten most frequent long words of a document, the earlier first among equals."""
    each = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.keyword_words(F.col("text"))).alias("pos", "word"))
    counted = each.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    top = counted.withColumn("r", F.row_number().over(w)).filter("r <= 10")
    lists = top.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("k"))
    return lists.select("doc_id", F.array_join(F.transform("k", lambda x: x["word"]), ",").alias("keywords"))


@query("txt_extract_code", r"SELECT count(*) AS blocks FROM (SELECT unnest(regexp_extract_all(text, '```(\w+)?\n([\s\S]*?)```', 2)) FROM conversations)")
def txt_extract_code(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.explode(T.code_blocks(F.col("text")))).agg(F.count("*").cast("long").alias("blocks"))


@query("txt_enrich", f"WITH {SQL_DOCUMENT_UNITS} SELECT doc_id, pos, lang || ',chunk-strategy-paragraph' || CASE WHEN length(content) > 400 THEN ',large-document' ELSE '' END AS tags FROM doc_units")
def txt_enrich(spark, sf_dir):
    large = F.when(F.length("content") > 400, F.lit("large-document"))
    tags = F.array_compact(F.array(F.col("lang"), F.lit("chunk-strategy-paragraph"), large))
    return document_units(spark, sf_dir).select("doc_id", "pos", F.array_join(tags, ",").alias("tags"))


@query("txt_paragraph_fallback", f"WITH {SQL_DOCUMENT_UNITS} SELECT doc_id, pos, md5(content) AS content_md5 FROM doc_units")
def txt_paragraph_fallback(spark, sf_dir):
    return document_units(spark, sf_dir).select("doc_id", "pos", F.md5("content").alias("content_md5"))


@query("txt_sections")
def txt_sections(spark, sf_dir):
    """Sections of the cleaned pages: type, level, parent heading and lines."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.clean_html(F.col("html")).alias("text"))
    return chunking.sections(pages, "id", "text")


@query("txt_hierarchy")
def txt_hierarchy(spark, sf_dir):
    return txt_sections(spark, sf_dir).groupBy("type", "level").agg(F.count("*").cast("long").alias("n"), F.count("parent").alias("with_parent"))


@query("txt_section_unit")
def txt_section_unit(spark, sf_dir):
    s = txt_sections(spark, sf_dir)
    kind = F.when(F.col("type") == "code", "code").when(F.col("type").isin("list", "table"), "reference").otherwise("insight")
    return s.select("id", "start_line", kind.alias("type"), T.title_of(F.col("content")).alias("title"), T.categorize(F.col("content")).alias("category"))


@query("txt_chunk_semantic")
def txt_chunk_semantic(spark, sf_dir):
    return chunking.semantic_chunks(read(spark, sf_dir, "documents"), "doc_id", "text")


_WIN = r"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, unnest(range(0, CASE WHEN len(w) < 800 THEN 1 ELSE CAST(ceil((len(w) - 500) / 450.0) AS BIGINT) + 1 END)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT doc_id, n, i, CASE WHEN n < 800 THEN 0 ELSE i * 450 END AS a, CASE WHEN n < 800 THEN n ELSE least(n, i * 450 + 500) END AS b FROM c)"""


@query("txt_chunk_strategy_pdf", f"WITH {_WIN} SELECT doc_id, i AS chunk, a AS token_start, b AS token_end FROM s")
def txt_chunk_strategy_pdf(spark, sf_dir):
    return chunking.token_windows(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk", "token_start", "token_end")


@query("txt_page_range", f"WITH {_WIN} SELECT doc_id, i AS chunk, least(10, CAST(floor(a * 10.0 / n) AS BIGINT) + 1) AS page_start, least(10, CAST(floor((b - 1) * 10.0 / n) AS BIGINT) + 1) AS page_end FROM s")
def txt_page_range(spark, sf_dir):
    """Pages of a chunk, as if every document had ten."""
    s = chunking.token_windows(read(spark, sf_dir, "documents"), "doc_id", "text")

    def page(token):
        return F.least(F.lit(10).cast("long"), F.floor(token * 10.0 / F.col("n_tokens")) + 1)

    return s.select("doc_id", "chunk", page(F.col("token_start")).alias("page_start"), page(F.col("token_end") - 1).alias("page_end"))


@query("txt_chunk_guardrails", f"WITH {_WIN}, big AS (SELECT *, b - a >= 160 AS big, bool_or(b - a >= 160) OVER (PARTITION BY doc_id) AS any_big FROM s), k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS m FROM big WHERE big OR NOT any_big), g AS (SELECT doc_id, CASE WHEN m > 40 THEN r // CAST(ceil(m / 40.0) AS BIGINT) ELSE r END AS grp FROM k) SELECT doc_id, grp AS chunk, count(*) AS merged FROM g GROUP BY 1, 2")
def txt_chunk_guardrails(spark, sf_dir):
    s = chunking.token_windows(read(spark, sf_dir, "documents"), "doc_id", "text")
    return chunking.guardrails(s, "doc_id")


@query("txt_chunk_fallback", "SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN 'pdf' WHEN 1 THEN 'single' ELSE 'markdown' END AS strategy FROM documents")
def txt_chunk_fallback(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(4)) == 2, "pdf").when(F.pmod("doc_id", F.lit(4)) == 1, "single").otherwise("markdown").alias("strategy"))


@query("txt_chunk_strategy_md")
def txt_chunk_strategy_md(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", T.clean_html(F.col("html")).alias("text"))
    return chunking.semantic_chunks(pages, "page_id", "text")


def _sql_texts_of(html: str, element: str, mark: str) -> str:
    bare = r"trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
    line = f"CASE WHEN i % 2 = 1 THEN x WHEN {bare} = '' THEN chr(10) ELSE chr(10) || '{mark}' || {bare} || chr(10) END"
    return f"array_to_string(list_transform(string_split(regexp_replace({html}, '(?is){element}', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x, i: {line}), '')"


_CLEAN = "html"
for _tag in ("script", "style", "nav", "footer", "iframe"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_tag}.*?</{_tag}>', ' ', 'g')"
for _level in range(1, 5):
    _CLEAN = _sql_texts_of(_CLEAN, f"<h{_level}[^>]*>(.*?)</h{_level}>", "#" * _level + " ")
_CLEAN = f"regexp_replace({_CLEAN}, '(?i)</?(ul|ol)[^>]*>', chr(10), 'g')"
_CLEAN = _sql_texts_of(_CLEAN, "<li[^>]*>(.*?)</li>", "- ")


@query("txt_html_clean", f"SELECT page_id, md5(c) AS clean_md5, CAST(length(c) AS BIGINT) AS size FROM (SELECT page_id, {_CLEAN} AS c FROM pages)")
def txt_html_clean(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", T.clean_html(F.col("html")).alias("c"))
    return p.select("page_id", F.md5("c").alias("clean_md5"), F.length("c").cast("long").alias("size"))


@query("src_web_clip", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def src_web_clip(spark, sf_dir):
    """The article of a page without its markup."""
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1))).alias("text_md5"))


@query("txt_images", r"""SELECT page_id, len(regexp_extract_all(html, '!\[([^\]]*)\]\(([^)]+)\)')) AS markdown, len(regexp_extract_all(html, '(?i)<img\s+[^>]*src=["'']([^"'']+)["''][^>]*>')) AS html FROM pages""")
def txt_images(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.size(T.markdown_images(F.col("html"))).cast("long").alias("markdown"), F.size(T.html_images(F.col("html"))).cast("long").alias("html"))


@query("txt_token_index", f"WITH {SQL_TOKENS} SELECT thread_id, turn_index, count(*) AS n, max(position) AS last, md5(string_agg(normalized, ' ' ORDER BY position)) AS terms_md5 FROM tokens GROUP BY 1, 2")
def txt_token_index(spark, sf_dir):
    grouped = tokens(spark, sf_dir).groupBy("thread_id", "turn_index").agg(F.count("*").cast("long").alias("n"), F.max("position").alias("last"), F.sort_array(F.collect_list(F.struct("position", "normalized"))).alias("t"))
    return grouped.select("thread_id", "turn_index", "n", "last", F.md5(F.array_join(F.transform("t", lambda x: x["normalized"]), " ")).alias("terms_md5"))


@query("txt_lexicon", f"WITH {SQL_TOKENS} SELECT normalized, min(term) AS surface, count(*) AS n FROM tokens GROUP BY normalized")
def txt_lexicon(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("normalized").agg(F.min("term").alias("surface"), F.count("*").cast("long").alias("n"))


@query("txt_redact_detect")
def txt_redact_detect(spark, sf_dir):
    """Detections in every document: type, place, confidence and whether a rule calls it a false positive."""
    return redaction.detect(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("txt_redact_apply")
def txt_redact_apply(spark, sf_dir):
    return redaction.redact(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.md5("redacted").alias("redacted_md5"), "n_redacted")


@query("txt_redact_flags")
def txt_redact_flags(spark, sf_dir):
    found = redaction.detect(read(spark, sf_dir, "documents"), "doc_id", "text").filter(~F.col("false_positive") & (F.col("confidence") >= redaction.THRESHOLD))
    return found.groupBy("doc_id").agg(F.bool_or(F.col("kind") == "secret").alias("has_secrets"), F.bool_or(F.col("kind") == "pii").alias("has_pii"), F.count("*").cast("long").alias("n"))


@query("agg_redaction_report")
def agg_redaction_report(spark, sf_dir):
    found = redaction.detect(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("type").agg(F.count("*").cast("long").alias("found"), F.count(F.when(F.col("false_positive"), 1)).alias("false_positives"), F.count_distinct("doc_id").alias("documents"))


_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


@query("red_emails", rf"SELECT doc_id, len(regexp_extract_all(text, '\b{_EMAIL}\b')) AS emails FROM documents WHERE regexp_matches(text, '\b{_EMAIL}\b')")
def red_emails(spark, sf_dir):
    """Rows that hold an e-mail address, and how many."""
    pattern = rf"\b{_EMAIL}\b"
    return read(spark, sf_dir, "documents").filter(F.col("text").rlike(pattern)).select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("long").alias("emails"))


@query("txt_entropy", "WITH c AS (SELECT p_partkey, ch, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_partkey) AS total FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY 1, 2) SELECT p_partkey, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM c GROUP BY 1")
def txt_entropy(spark, sf_dir):
    """Shannon entropy of a value, in bits a character."""
    return read(spark, sf_dir, "part").select("p_partkey", F.round(redaction.entropy(F.col("p_name")), 6).alias("entropy"))


@query("txt_embed_prepare", "SELECT doc_id, md5(substr(text, 1, 400)) AS prepared_md5 FROM documents")
def txt_embed_prepare(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring("text", 1, 400)).alias("prepared_md5"))


@query("txt_embed_mock")
def txt_embed_mock(spark, sf_dir):
    return chunking.mock_embeddings(read(spark, sf_dir, "documents"), "doc_id", "text", dims=8)


@query("txt_backfill_diff", f"WITH {SQL_UNITS} SELECT id, array_to_string(list_filter(['go', 'new', 'insight'], lambda t: NOT list_contains(tags, t)), ',') AS missing, category <> 'design' AS category_changed FROM units")
def txt_backfill_diff(spark, sf_dir):
    wanted = F.array(F.lit("go"), F.lit("new"), F.lit("insight"))
    return units(spark, sf_dir).select("id", F.array_join(F.array_except(wanted, "tags"), ",").alias("missing"), (F.col("category") != "design").alias("category_changed"))


@query("txt_slug", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 50) AS slug FROM part")
def txt_slug(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("txt_title_from_path", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '[-_]+', ' ', 'g')) AS title FROM pages")
def txt_title_from_path(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.title_from_path(F.col("url")).alias("title"))


_TAG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type)), '[^\w\s/-]', ' ', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query("tax_normalize", f"SELECT p_partkey, {_TAG} AS tag, CASE WHEN p_size < 10 THEN 'programming' WHEN p_size < 20 THEN 'devops' WHEN p_size < 30 THEN 'programming' ELSE 'general' END AS category FROM part")
def tax_normalize(spark, sf_dir):
    raw = F.when(F.col("p_size") < 10, " Technical").when(F.col("p_size") < 20, "infra").when(F.col("p_size") < 30, "Best Practice").otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", taxonomy.normalize_tag(F.col("p_type")).alias("tag"), taxonomy.normalize_category(raw).alias("category"))


@query("tax_repair", f"WITH t AS (SELECT p_partkey, p_type AS raw, {_TAG} AS tag FROM part) SELECT tag, count(DISTINCT raw) AS merged, count(*) AS uses FROM t WHERE tag <> raw GROUP BY tag")
def tax_repair(spark, sf_dir):
    t = read(spark, sf_dir, "part").select(F.col("p_type").alias("raw"), taxonomy.normalize_tag(F.col("p_type")).alias("tag")).filter("tag <> raw")
    return t.groupBy("tag").agg(F.count_distinct("raw").alias("merged"), F.count("*").cast("long").alias("uses"))


@query("imp_helpers", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'user' WHEN event_type IN ('view', 'purchase') THEN 'assistant' ELSE 'system' END AS role FROM events")
def imp_helpers(spark, sf_dir):
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type").isin("view", "purchase"), "assistant").otherwise("system")
    return read(spark, sf_dir, "events").select("event_id", role.alias("role"))


@query("src_detect_provider", r"SELECT page_id, CASE WHEN contains(lower(url), 'chatgpt') THEN 'chatgpt' WHEN contains(lower(url), 'claude') THEN 'claude' WHEN contains(lower(url), 'gemini') THEN 'gemini' WHEN contains(lower(url), 'grok') OR contains(lower(url), 'xai') THEN 'grok' WHEN contains(lower(url), 'copilot') OR contains(lower(url), 'github') THEN 'copilot' ELSE 'unknown' END AS provider FROM pages")
def src_detect_provider(spark, sf_dir):
    from loomstone.sources.chats import provider_of

    return read(spark, sf_dir, "pages").select("page_id", provider_of(F.col("url")).alias("provider"))


@query("red_extract_json_text", "SELECT event_id, CASE WHEN event_type = 'view' THEN concat_ws(chr(10), event_type, props) WHEN event_type = 'click' THEN props ELSE event_type END AS text FROM events")
def red_extract_json_text(spark, sf_dir):
    """Text of JSON: title and content of a unit joined by newlines, other JSON as it is written, what is no JSON unchanged."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    unit = F.to_json(F.struct(F.col("event_type").alias("title"), F.col("props").alias("content")))
    raw = F.when(F.col("event_type") == "view", unit).when(F.col("event_type") == "click", F.col("props")).otherwise(F.col("event_type"))
    return events.select("event_id", redaction.json_text(raw).alias("text"))


@query("sink_redacted_files")
def sink_redacted_files(spark, sf_dir):
    """What a redaction run writes: every text that changes, redacted, with the backup's hash beside it."""
    docs = read(spark, sf_dir, "documents").select(F.struct("doc_id", F.md5("text").alias("backup_md5")).alias("file"), "text")
    found = redaction.redact(docs, "file", "text").filter("n_redacted > 0")
    return found.select("file.doc_id", F.md5("redacted").alias("redacted_md5"), "file.backup_md5", "n_redacted")


@query(
    "txt_table_list_titles",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    c AS (SELECT doc_id, len(list_filter(string_split(max(line), ' '), lambda x: x <> '')) AS cols, count(*) AS items, count(*) FILTER (regexp_matches(line, '^\s*\d+\.')) AS numbered FROM l GROUP BY 1)
    SELECT doc_id, 'Table (' || cols || ' columns)' AS table_title, CASE WHEN numbered > 0 THEN 'Ordered' ELSE 'Unordered' END || ' List (' || items || ' items)' AS list_title FROM c""",
)
def txt_table_list_titles(spark, sf_dir):
    """Titles of tables and lists: columns of a row, items of a list and whether they are numbered."""
    lines = F.split("text", "\n")
    row = F.array_max(lines)
    kind = F.when(F.exists(lines, lambda x: x.rlike(r"^\s*\d+\.")), "Ordered").otherwise("Unordered")
    titles = [F.format_string("Table (%d columns)", F.size(F.filter(F.split(row, " "), lambda x: x != ""))).alias("table_title"), F.concat(kind, F.format_string(" List (%d items)", F.size(lines))).alias("list_title")]
    return read(spark, sf_dir, "documents").select("doc_id", *titles)


@query("txt_entry", f"WITH {SQL_UNITS}, {SQL_DOCUMENT_UNITS} SELECT 'conversation' AS origin, id FROM units UNION ALL SELECT 'document', doc_id || ':' || pos FROM doc_units")
def txt_entry(spark, sf_dir):
    """Units of conversations and of documents through one entry."""
    chat = units(spark, sf_dir).select(F.lit("conversation").alias("origin"), "id")
    return chat.unionByName(document_units(spark, sf_dir).select(F.lit("document").alias("origin"), F.concat_ws(":", "doc_id", "pos").alias("id")))


@query("txt_policy_ingest")
def txt_policy_ingest(spark, sf_dir):
    """Documents through the intake policy: why one stays out, and what the others bring in (redacted text, its paragraphs)."""
    path = F.concat_ws("/", "lang", F.concat_ws(".", "id", "format"))
    found = intake.evaluate(documents(spark, sf_dir).withColumn("path", path), "id", "path", "content")
    paragraphs = F.size(F.filter(F.split("redacted", "\n"), lambda x: F.length(x) > 50)).cast("long")
    return found.select(F.col("id").alias("doc_id"), F.array_join("reasons", ",").alias("reasons"), "allowed", F.md5("redacted").alias("redacted_md5"), "n_redacted", F.when(F.col("allowed"), paragraphs).otherwise(0).alias("units"))
