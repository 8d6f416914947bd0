"""Search, suggestions and spelling."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import fulltext, search
from loomstone.operators.spelling import near_distance
from loomstone.queries.aggregates import query_log, trailing
from loomstone.registry import query
from loomstone.scratch import exists, shared_folder
from loomstone.sources.tables import SQL_TOKENS, SQL_UNITS, read, tokens, units

_SQL_TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _sql_fts(leaves: list[str], fits: str, name: str = "bm") -> str:
    """Common table expressions: `name` has doc_id and the BM25 score of the documents for which `fits` holds over the leaves' counts tf0, tf1, ...
    of the words t of text and s of source."""
    n = range(len(leaves))
    parts = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in n)
    return f"""t AS (SELECT doc_id, {_SQL_TERMS.format("text")} AS t, {_SQL_TERMS.format("source")} AS s FROM documents),
tf AS (SELECT doc_id, len(t) + len(s) AS len, {", ".join(f"{x} AS tf{i}" for i, x in enumerate(leaves))} FROM t),
st AS (SELECT count(*) AS n, avg(len) AS mean, {", ".join(f"count(*) FILTER (tf{i} > 0) AS d{i}" for i in n)} FROM tf),
{name} AS (SELECT doc_id, {parts} AS score FROM tf, st WHERE {fits})"""


def _sql_term(test: str, field: str | None = None) -> str:
    """How many words x of a field (of all by default) pass a test."""
    return " + ".join(f"len(list_filter({f}, lambda x: {test}))" for f in ([field] if field else ["t", "s"]))


def _sql_phrase(*words: str) -> str:
    here = " AND ".join(f"{{0}}[i + {k}] = '{w}'" for k, w in enumerate(words))
    return " + ".join(f"len(list_filter(range(1, len({f}) + 1), lambda i: {here.format(f)}))" for f in ("t", "s"))


_BM25 = _sql_fts([_sql_term("x = 'licensed'"), _sql_term("x = 'license'")], "tf0 > 0 AND tf1 > 0")


def index_of(spark, sf_dir):
    """Path of the documents' full-text index, which is built where the shared folder has none for just these files."""
    docs = read(spark, sf_dir, "documents")
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = [path_of(f) for f in sorted(docs.inputFiles())]
    states = [(f.toString(), s.getLen(), s.getModificationTime()) for f in files for s in [f.getFileSystem(conf).getFileStatus(f)]]
    path = f"{shared_folder(spark)}/fulltext-{hashlib.sha256(repr((fulltext.LAYOUT, states)).encode()).hexdigest()[:24]}"
    if not exists(spark, f"{path}/stats/_SUCCESS"):  # the statistics are written last
        fulltext.build(docs, "doc_id", {"text": F.col("text"), "source": F.col("source")}, path)
    return path


def matched(spark, sf_dir, text):
    """doc_id and score of the documents that fit a query; those that hold it as a substring, with score 0, where it is no query."""
    try:
        return fulltext.matches(spark, index_of(spark, sf_dir), text).withColumnRenamed("key", "doc_id")
    except fulltext.QueryError:
        held = F.contains(F.lower("text"), F.lower(F.lit(text)))
        return read(spark, sf_dir, "documents").filter(held).select("doc_id", F.lit(0.0).alias("score"))


def _best(found, limit=50):
    return found.orderBy(F.desc("score"), "doc_id").limit(limit).select("doc_id", F.round("score", 6).alias("score"))


def _bm25(spark, sf_dir, limit=None):
    found = matched(spark, sf_dir, "licensed license")
    return found if limit is None else found.orderBy(F.desc("score"), "doc_id").limit(limit)


@query("fts_index", rf"""WITH t AS (SELECT doc_id, unnest(list_concat({_SQL_TERMS.format("text")}, {_SQL_TERMS.format("source")})) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS rows, count(*) AS occurrences FROM t GROUP BY term""")
def fts_index(spark, sf_dir):
    """The index's dictionary; builds the index if there is none."""
    return fulltext.dictionary(spark, index_of(spark, sf_dir))


_TOP = "SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 50"


@query("fts_match", f"WITH {_BM25} {_TOP}")
def fts_match(spark, sf_dir):
    return _best(matched(spark, sf_dir, "licensed license"))


@query("fts_phrase", f"WITH {_sql_fts([_sql_phrase('general', 'public', 'license')], 'tf0 > 0')} {_TOP}")
def fts_phrase(spark, sf_dir):
    return _best(matched(spark, sf_dir, '"General Public License"'))


@query("fts_or", f"""WITH {_sql_fts([_sql_term("x = 'reserved'"), _sql_phrase("public", "license")], "tf0 > 0 OR tf1 > 0")} {_TOP}""")
def fts_or(spark, sf_dir):
    return _best(matched(spark, sf_dir, 'reserved OR "public license"'))


@query("fts_prefix", f"""WITH {_sql_fts([_sql_term("starts_with(x, 'licen')"), _sql_term("x = 'gnu'")], "tf0 > 0 AND NOT tf1 > 0")} {_TOP}""")
def fts_prefix(spark, sf_dir):
    return _best(matched(spark, sf_dir, "licen* NOT gnu"))


@query("fts_column", f"""WITH {_sql_fts([_sql_term("x = 'src0'", "s"), _sql_term("x = 'license'"), _sql_term("x = 'reserved'", "t")], "tf0 > 0 AND (tf1 > 0 OR tf2 > 0)")} {_TOP}""")
def fts_column(spark, sf_dir):
    return _best(matched(spark, sf_dir, "source:src0 AND (license OR text:reserved)"))


@query("fts_fallback", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'license, version') ORDER BY doc_id LIMIT 50")
def fts_fallback(spark, sf_dir):
    """What is no query is looked for as it stands."""
    return _best(matched(spark, sf_dir, "License, version"))


@query("fts_paginated", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score, (SELECT count(*) FROM bm) AS total FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10 OFFSET 10")
def fts_paginated(spark, sf_dir):
    """A page of hits with the total."""
    hits = _bm25(spark, sf_dir)
    total = hits.agg(F.count("*").cast("long").alias("total"))
    return hits.orderBy(F.desc("score"), "doc_id").offset(10).limit(10).join(total).select("doc_id", F.round("score", 6).alias("score"), "total")


@query("fts_cli_filter", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE source IN ('src0', 'src1', 'src2') ORDER BY bm.score DESC, doc_id LIMIT 50")
def fts_cli_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter(F.col("source").isin("src0", "src1", "src2")).select("doc_id")
    return _best(_bm25(spark, sf_dir).join(docs, "doc_id", "left_semi"))


_DIST = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _target(spark, sf_dir):
    """The query vector: one row of the collection."""
    return read(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


@query("vec_topk", f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - {_DIST}, 6) AS score FROM embeddings e, q WHERE label <> 1 ORDER BY 1 - {_DIST} DESC, vec_id LIMIT 20")
def vec_topk(spark, sf_dir):
    found = search.nearest(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _target(spark, sf_dir), 20, F.col("label") != 1)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("vec_stats", "SELECT label, count(*) AS n, CAST(min(len(embedding)) AS BIGINT) AS dims FROM embeddings GROUP BY label")
def vec_stats(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").cast("long").alias("n"), F.min(F.size("embedding")).cast("long").alias("dims"))


_HYBRID = f"""{_BM25}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 30)),
v AS (SELECT vec_id AS doc_id, 1 - {_DIST} AS score FROM embeddings e, q ORDER BY 2 DESC, 1 LIMIT 30),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM v WHERE doc_id IN (SELECT doc_id FROM documents))"""


def _hybrid(spark, sf_dir, weights):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    near = search.nearest(read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _target(spark, sf_dir), 30)
    return search.reciprocal_rank_fusion(_bm25(spark, sf_dir, 30), near.join(docs, "doc_id", "left_semi"), "doc_id", weights)


def _sql_rrf(w1: float, w2: float) -> str:
    return f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce({w1} / (61 + a.r), 0) + coalesce({w2} / (61 + b.r), 0) AS s FROM a FULL JOIN b ON a.doc_id = b.doc_id"


_BOOSTED = "SELECT f.doc_id, round(s + CASE WHEN length(text) > 4000 THEN 0.05 ELSE 0 END, 9) AS score FROM f JOIN documents USING (doc_id) ORDER BY s + CASE WHEN length(text) > 4000 THEN 0.05 ELSE 0 END DESC, f.doc_id LIMIT 30"


def _ranked(spark, sf_dir, weights):
    tag = F.when(F.length("text") > 4000, F.array(F.lit("chunk-strategy-md"))).otherwise(F.array().cast("array<string>"))
    tagged = read(spark, sf_dir, "documents").select("doc_id", tag.alias("tags"))
    met = _hybrid(spark, sf_dir, weights).join(tagged, "doc_id")
    return met.select("doc_id", search.boosted(F.col("score"), F.col("tags"), "license text").alias("s")).orderBy(F.desc("s"), "doc_id").limit(30).select("doc_id", F.round("s", 9).alias("score"))


@query("hybrid_rrf", f"WITH {_HYBRID}, f AS ({_sql_rrf(0.6, 0.4)}) {_BOOSTED}")
def hybrid_rrf(spark, sf_dir):
    return _ranked(spark, sf_dir, (0.6, 0.4))


@query("hybrid_api", f"WITH {_HYBRID}, f AS ({_sql_rrf(0.4, 0.6)}) {_BOOSTED}")
def hybrid_api(spark, sf_dir):
    return _ranked(spark, sf_dir, (0.4, 0.6))


@query("semantic_api", f"WITH {_HYBRID}, f AS ({_sql_rrf(0.2, 0.8)}) {_BOOSTED}")
def semantic_api(spark, sf_dir):
    return _ranked(spark, sf_dir, (0.2, 0.8))


@query("join_rrf_full", f"WITH {_HYBRID}, f AS ({_sql_rrf(0.6, 0.4)}) SELECT doc_id, round(s, 9) AS score FROM f")
def join_rrf_full(spark, sf_dir):
    return _hybrid(spark, sf_dir, (0.6, 0.4)).select("doc_id", F.round("score", 9).alias("score"))


def _count(field: str, term: str) -> str:
    return f"len(regexp_extract_all(lower({field}), '{term}'))"


@query("search_adv", f"WITH {SQL_UNITS} SELECT id, CAST(2 * ({_count('title', 'the')} + {_count('title', 'on.')}) + {_count('content', 'the')} + {_count('content', 'on.')} AS BIGINT) AS score FROM units WHERE 2 * ({_count('title', 'the')} + {_count('title', 'on.')}) + {_count('content', 'the')} + {_count('content', 'on.')} > 0 ORDER BY score DESC, id LIMIT 20")
def search_adv(spark, sf_dir):
    """Term counts, the terms read as patterns, the first field twice."""
    def n(field: str):
        return sum((F.regexp_count(F.lower(field), F.lit(t)) for t in ("the", "on.")), F.lit(0))

    return units(spark, sf_dir).select("id", (2 * n("title") + n("content")).cast("long").alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(20)


@query(
    "search_federated",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '://[^/]*(.*)$', 1) AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html FROM pages),
    s AS (SELECT page_id, (CASE WHEN title ILIKE 'the%' THEN 4 ELSE 0 END) + (CASE WHEN path ILIKE 'the%' THEN 3 ELSE 0 END) + (CASE WHEN title ILIKE '%the%' THEN 2 ELSE 0 END) + (CASE WHEN path ILIKE '%the%' THEN 1 ELSE 0 END) + (CASE WHEN html ILIKE '%the%' THEN 1 ELSE 0 END) AS score FROM p)
    SELECT page_id, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, page_id LIMIT 100""",
)
def search_federated(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*(.*)$", 1).alias("path"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "html")
    rules = [("title", "the%", 4), ("path", "the%", 3), ("title", "%the%", 2), ("path", "%the%", 1), ("html", "%the%", 1)]
    score = sum((F.when(F.col(c).ilike(pattern), points).otherwise(0) for c, pattern, points in rules), F.lit(0))
    return p.select("page_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "page_id").limit(100)


@query(
    "find_terms",
    f"WITH {SQL_TOKENS} SELECT thread_id, turn_index, position, term FROM tokens WHERE normalized = 'the' ORDER BY thread_id, turn_index, position LIMIT 200",
)
def find_terms(spark, sf_dir):
    return tokens(spark, sf_dir).filter("normalized = 'the'").orderBy("thread_id", "turn_index", "position").limit(200).select("thread_id", "turn_index", "position", "term")


_SUGGEST = """all_terms AS (SELECT p_name AS s, 0 AS priority FROM part WHERE p_name ILIKE 'm%' UNION ALL SELECT p_type, 1 FROM part WHERE p_type ILIKE 'm%' UNION ALL SELECT s_name, 2 FROM supplier WHERE s_name ILIKE 'm%')"""


def _suggestions(spark, sf_dir):
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    parts = [(part, "p_name"), (part, "p_type"), (supplier, "s_name")]
    frames = [df.filter(F.col(c).ilike("m%")).select(F.col(c).alias("s"), F.lit(i).alias("priority")) for i, (df, c) in enumerate(parts)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("suggest_prefix", f"WITH {_SUGGEST} SELECT s, min(priority) AS priority FROM all_terms GROUP BY s ORDER BY priority, s LIMIT 10")
def suggest_prefix(spark, sf_dir):
    return _suggestions(spark, sf_dir).groupBy("s").agg(F.min("priority").alias("priority")).orderBy("priority", "s").limit(10)


@query("set_union_suggest", f"WITH {_SUGGEST} SELECT lower(s) AS s, min(priority) AS priority, count(*) AS n FROM all_terms GROUP BY lower(s)")
def set_union_suggest(spark, sf_dir):
    return _suggestions(spark, sf_dir).groupBy(F.lower("s").alias("s")).agg(F.min("priority").alias("priority"), F.count("*").cast("long").alias("n"))


_QUERIES = """log AS (SELECT event_type || ' ' || CAST(user_id % 50 AS VARCHAR) AS query, ts FROM events), freq AS (SELECT query, count(*) AS f FROM log GROUP BY 1)"""


@query(
    "suggest_multi",
    f"""WITH {_QUERIES}, {SQL_UNITS}, c AS (
      SELECT * FROM (SELECT query AS s, 0 AS p, 0.4 * (1 + ln(1 + f) / 10) AS score FROM freq WHERE starts_with(query, 'c') ORDER BY f DESC, query LIMIT 10)
      UNION ALL SELECT * FROM (SELECT DISTINCT tag, 1, 0.3 FROM (SELECT unnest(tags) AS tag FROM units) WHERE starts_with(tag, 'c') ORDER BY tag LIMIT 10)
      UNION ALL SELECT * FROM (SELECT DISTINCT category, 2, 0.2 FROM units WHERE starts_with(category, 'c') ORDER BY category LIMIT 10)
      UNION ALL SELECT * FROM (SELECT DISTINCT lower(title) AS title, 3, 0.1 FROM units WHERE starts_with(lower(title), 'c') ORDER BY title LIMIT 10))
    SELECT s, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lower(s) ORDER BY p) AS r FROM c) WHERE r = 1 ORDER BY score DESC, s LIMIT 10""",
)
def suggest_multi(spark, sf_dir):
    """Suggestions of four sources, at most ten each; of equal ones the first source wins."""
    u = units(spark, sf_dir)
    freq = query_log(spark, sf_dir).groupBy(F.col("query").alias("s")).agg(F.count("*").alias("f"))

    def top(df, order):
        return df.filter(F.col("s").startswith("c")).orderBy(*order).limit(10)

    first = top(freq, [F.desc("f"), "s"]).select("s", F.lit(0).alias("p"), (0.4 * (1 + F.ln(1 + F.col("f")) / 10)).alias("score"))
    rest = [u.select(F.explode("tags").alias("s")), u.select(F.col("category").alias("s")), u.select(F.lower("title").alias("s"))]
    out = first
    for i, (df, score) in enumerate(zip(rest, (0.3, 0.2, 0.1), strict=True), 1):
        out = out.unionByName(top(df.distinct(), ["s"]).select("s", F.lit(i).alias("p"), F.lit(score).alias("score")))
    w = Window.partitionBy(F.lower("s")).orderBy("p")
    return out.withColumn("r", F.row_number().over(w)).filter("r = 1").select("s", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "s").limit(10)


@query("suggest_related", f"WITH {_QUERIES} SELECT query, f FROM freq WHERE starts_with(query, 'click') AND query <> 'click 1' ORDER BY f DESC, query LIMIT 10")
def suggest_related(spark, sf_dir):
    freq = query_log(spark, sf_dir).groupBy("query").agg(F.count("*").cast("long").alias("f"))
    return freq.filter(F.col("query").startswith("click") & (F.col("query") != "click 1")).orderBy(F.desc("f"), "query").limit(10)


@query("suggest_from_analytics", f"WITH {_QUERIES} SELECT query, count(*) AS frequency FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 7 DAY GROUP BY query ORDER BY frequency DESC, query LIMIT 100")
def suggest_from_analytics(spark, sf_dir):
    return trailing(query_log(spark, sf_dir), 7).groupBy("query").agg(F.count("*").cast("long").alias("frequency")).orderBy(F.desc("frequency"), "query").limit(100)


@query("cleanup_queries", f"WITH {_QUERIES} SELECT query, f FROM freq WHERE f >= 2")
def cleanup_queries(spark, sf_dir):
    return query_log(spark, sf_dir).groupBy("query").agg(F.count("*").cast("long").alias("f")).filter("f >= 2")


@query("log_query", "SELECT event_id, event_type || ' ' || CAST(user_id % 50 AS VARCHAR) AS query, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def log_query(spark, sf_dir):
    return query_log(spark, sf_dir).select("event_id", "query", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("log_click", "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) AS total FROM events GROUP BY user_id")
def log_click(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"), F.count("*").cast("long").alias("total"))


@query("spell_check")
def spell_check(spark, sf_dir):
    """The best correction of every misspelt word (each of the corpus's words without its first character): optimal string alignment
    distance of at most 2 to a dictionary of the corpus.

    Words and dictionary meet on deletion neighbourhoods (each word and the words with one or two letters less) or, where they are
    long, on fifths of the term, so only candidates within reach are compared.
    """
    dictionary = tokens(spark, sf_dir).groupBy(F.col("normalized").alias("term")).agg(F.count("*").cast("long").alias("frequency"))
    return correct(dictionary.select(F.expr("substring(term, 2)").alias("word")).distinct(), dictionary)


def _deletions(word):
    """A word and what is left of it without one or two of its characters."""
    def less(w):
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), w.substr(i + 1, F.length(w))))

    one = F.when(F.length(word) > 0, less(word)).otherwise(F.array().cast("array<string>"))
    two = F.flatten(F.transform(one, lambda w: F.when(F.length(w) > 0, less(w)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(word), one, two))


SHORT = 22
PARTS = 5


def _part(word, size, i, shift):
    """The i-th fifth of a term of `size` characters, looked for in word `shift` characters further on; null outside of the word."""
    start = F.floor(size * i / PARTS) + shift
    stop = F.floor(size * (i + 1) / PARTS) + shift
    text = F.concat_ws(":", size, i, word.substr((start + 1).cast("int"), (stop - start).cast("int")))
    return F.when((start >= 0) & (stop <= F.length(word)), text)


def _fifths(term):
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: _part(term, F.length(term), i, F.lit(0)))


def _probes(word):
    """Where the fifths of terms within distance 2 can stand in a word. An edit touches two fifths at most (a swap at a border), so of five one is
    whole, and it has moved by two places at most."""
    reach = F.sequence(F.lit(-2), F.lit(2))
    each = F.transform(reach, lambda d: F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.transform(reach, lambda s: _part(word, F.length(word) + d, i, s))))
    return F.array_distinct(F.array_compact(F.flatten(F.flatten(each))))


def correct(words, dictionary):
    """word, term, distance and confidence; words without a candidate within distance 2 are left out."""
    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near_distance(x, y, 2) for x, y in zip(a, b, strict=True)], dtype="int32")

    # Words of up to SHORT + 2 characters meet on deletions, words from SHORT on by parts; two within reach are both the one or both the other.
    short, long = F.length("w") <= SHORT + 2, F.length("w") >= SHORT

    def keyed(rows, name, columns, longer):
        w = rows.withColumn("w", F.col(name))
        by_letters = w.filter(short).select(*columns, F.explode(_deletions(F.col("w"))).alias("part"))
        return by_letters.unionByName(w.filter(long).select(*columns, F.explode(longer(F.col("w"))).alias("part")))

    left = keyed(words, "word", ["word"], _probes)
    right = keyed(dictionary, "term", ["term", "frequency"], _fifths)
    pairs = left.join(right, "part").filter(F.abs(F.length("word") - F.length("term")) <= 2).select("word", "term", "frequency").distinct()
    # Two edits with swaps are at most four without; only what two to four plain edits separate may hold a swap. A swap keeps the letters, so
    # two plain edits that are one swap, or four that are two, leave them equal, and three that are a swap and an edit change one letter.
    plain = pairs.withColumn("edits", F.levenshtein("word", "term", 4)).filter("edits >= 0")
    letters = [F.array_join(F.array_sort(F.split(c, "")), "") for c in ("word", "term")]
    swap = F.when(F.col("edits") == 3, F.levenshtein(*letters, 2) >= 0).otherwise((F.length("word") == F.length("term")) & (letters[0] == letters[1]))
    plain = plain.withColumn("swap", (F.col("edits") >= 2) & swap).filter("edits <= 2 or swap")
    few, more = plain.filter("not swap").withColumn("distance", F.col("edits")), plain.filter("swap").withColumn("distance", distance("word", "term"))
    few, more = few.drop("swap"), more.drop("swap")
    scored = few.unionByName(more).drop("edits").filter("distance <= 2")
    confidence = (1 - F.col("distance") / 2) * (0.7 + 0.3 * F.ln(F.col("frequency") + 1) / 10)
    scored = scored.withColumn("confidence", F.round(confidence, 9))
    w = Window.partitionBy("word").orderBy(F.desc("confidence"), "term")
    return scored.withColumn("r", F.row_number().over(w)).filter("r = 1").select("word", "term", "distance", "confidence")


@query(
    "join_dictionary",
    "WITH w AS (SELECT DISTINCT lower(p_name) AS w FROM part), d AS (SELECT DISTINCT lower(p_type) AS d FROM part) SELECT w, count(*) AS n FROM w JOIN d ON length(d) BETWEEN length(w) - 2 AND length(w) + 2 GROUP BY w",
)
def join_dictionary(spark, sf_dir):
    """How many dictionary entries lie within two characters of a word's length: a band join on the length as equi-joins."""
    part = read(spark, sf_dir, "part")
    sizes = part.select(F.lower("p_type").alias("d")).distinct().groupBy(F.length("d").alias("size")).agg(F.count("*").alias("entries"))
    w = part.select(F.lower("p_name").alias("w")).distinct()
    near = w.select("w", F.explode(F.sequence(F.length("w") - 2, F.length("w") + 2)).alias("size"))
    return near.join(sizes, "size").groupBy("w").agg(F.sum("entries").alias("n"))


_UNIQ = "(len(tags) / greatest(len(tags), 1) + len(list_filter(tags, lambda t: length(t) > 10)) / greatest(len(tags), 1)) / 2"
_RECENCY = "greatest(0, 1 - ((SELECT max(created) FROM units) - created) / 86400.0 / 90)"
_RELEVANCE = "((CASE WHEN contains(lower(title || ' ' || content), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(title || ' ' || content), 'zebra') THEN 1 ELSE 0 END)) / 2.0"


@query(
    "rank_insights",
    f"""WITH {SQL_UNITS} SELECT id, round(0.4 * (CASE WHEN list_contains(tags, 'importance-high') THEN 1.0 ELSE 0.5 END) + 0.2 * {_RECENCY} + 0.25 * {_RELEVANCE} + 0.15 * {_UNIQ}, 6) AS combined,
    CASE WHEN regexp_matches(lower(title || ' ' || content), 'code|implementation|algorithm|syntax|function|method') THEN 'technical' WHEN regexp_matches(lower(title || ' ' || content), 'architecture|design|system|scale|infrastructure|pattern') THEN 'architectural' ELSE 'other' END AS topic
    FROM units WHERE type IN ('insight', 'decision')""",
)
def rank_insights(spark, sf_dir):
    """Weighted importance, recency over 90 days before the newest unit, relevance to `the zebra`, and uniqueness."""
    u = units(spark, sf_dir)
    newest = u.agg(F.max("created").alias("newest"))  # one row
    body = F.lower(F.concat_ws(" ", "title", "content"))
    n = F.greatest(F.size("tags"), F.lit(1))
    unique = (F.size("tags") / n + F.size(F.filter("tags", lambda t: F.length(t) > 10)) / n) / 2
    recency = F.greatest(F.lit(0.0), 1 - (F.col("newest") - F.col("created")) / 86400.0 / 90)
    relevance = sum((F.when(body.contains(t), 1).otherwise(0) for t in ("the", "zebra")), F.lit(0)) / 2.0
    importance = F.when(F.array_contains("tags", "importance-high"), 1.0).otherwise(0.5)
    topic = F.when(body.rlike("code|implementation|algorithm|syntax|function|method"), "technical").when(body.rlike("architecture|design|system|scale|infrastructure|pattern"), "architectural").otherwise("other")
    rows = u.filter(F.col("type").isin("insight", "decision")).join(F.broadcast(newest))
    return rows.select("id", F.round(0.4 * importance + 0.2 * recency + 0.25 * relevance + 0.15 * unique, 6).alias("combined"), topic.alias("topic"))


@query("search_saved", f"WITH {SQL_UNITS}, hits AS (SELECT * FROM units WHERE content ILIKE '%er%'), page AS (SELECT * FROM hits ORDER BY created DESC, id LIMIT 40) SELECT id, type, (SELECT count(*) FROM hits) AS total_prefilter FROM page WHERE type = 'question'")
def search_saved(spark, sf_dir):
    """A saved search: its filters apply to the page, and the total counts all hits before page and filters."""
    hits = units(spark, sf_dir).filter(F.col("content").ilike("%er%")).select("id", "type", "created")
    total = hits.agg(F.count("*").cast("long").alias("total_prefilter"))
    page = hits.orderBy(F.desc("created"), "id").limit(40)
    return page.filter("type = 'question'").join(total).select("id", "type", "total_prefilter")


@query("cache_embed", "SELECT md5(text) AS key, min(doc_id) AS first_doc, count(*) AS uses FROM documents GROUP BY 1")
def cache_embed(spark, sf_dir):
    """Keys of the embedding cache: one for each distinct text."""
    return read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").cast("long").alias("uses"))


@query("vec_scope", "SELECT p_partkey, substr(sha256(p_name), 1, 12) AS scope FROM part")
def vec_scope(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha2("p_name", 256), 1, 12).alias("scope"))


@query("list_popular_saved", "SELECT event_type || ' ' || CAST(user_id AS VARCHAR) AS search, count(*) AS runs FROM events GROUP BY 1 ORDER BY runs DESC, search LIMIT 20")
def list_popular_saved(spark, sf_dir):
    """Saved searches that ran, the most often run first."""
    runs = read(spark, sf_dir, "events").groupBy(F.concat_ws(" ", "event_type", "user_id").alias("search")).agg(F.count("*").cast("long").alias("runs"))
    return runs.orderBy(F.desc("runs"), "search").limit(20)


@query("list_recent_saved", "SELECT event_type || ' ' || CAST(user_id AS VARCHAR) AS search, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run FROM events GROUP BY 1 ORDER BY max(ts) DESC, search LIMIT 20")
def list_recent_saved(spark, sf_dir):
    """Saved searches by their last run, newest first."""
    runs = read(spark, sf_dir, "events").groupBy(F.concat_ws(" ", "event_type", "user_id").alias("search")).agg(F.max("ts").alias("ts"))
    return runs.orderBy(F.desc("ts"), "search").limit(20).select("search", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query("suggest_record", f"WITH {_QUERIES} SELECT trim(lower(query)) AS normalized, count(*) AS frequency, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created FROM log GROUP BY 1")
def suggest_record(spark, sf_dir):
    """The suggestion table after the log has been recorded: an upsert that counts uses and keeps the first and the last time."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    return query_log(spark, sf_dir).groupBy(F.trim(F.lower("query")).alias("normalized")).agg(
        F.count("*").cast("long").alias("frequency"), F.date_format(F.max("ts"), stamp).alias("last_used"), F.date_format(F.min("ts"), stamp).alias("created")
    )


@query("suggest_expand", f"WITH {SQL_TOKENS}, d AS (SELECT DISTINCT thread_id, turn_index, normalized FROM tokens), h AS (SELECT thread_id, turn_index FROM d WHERE normalized = 'the') SELECT normalized AS term, count(*) AS n FROM d JOIN h USING (thread_id, turn_index) WHERE normalized <> 'the' GROUP BY 1 ORDER BY n DESC, term LIMIT 10")
def suggest_expand(spark, sf_dir):
    """Terms that widen a query: those that stand most often beside its term."""
    d = tokens(spark, sf_dir).select("thread_id", "turn_index", "normalized").distinct()
    hits = d.filter("normalized = 'the'").select("thread_id", "turn_index")
    met = d.filter("normalized <> 'the'").join(hits, ["thread_id", "turn_index"], "left_semi")
    return met.groupBy(F.col("normalized").alias("term")).agg(F.count("*").cast("long").alias("n")).orderBy(F.desc("n"), "term").limit(10)


@query("cache_search", "WITH r AS (SELECT sha256(event_type || ':' || CAST(user_id % 50 AS VARCHAR)) AS key, ts, event_id, lag(ts) OVER (PARTITION BY event_type, user_id % 50 ORDER BY ts, event_id) AS before FROM events) SELECT key, count(*) AS requests, count(*) FILTER (before IS NOT NULL AND ts - before <= INTERVAL 5 MINUTE) AS hits FROM r GROUP BY key")
def cache_search(spark, sf_dir):
    """Requests by cache key, and how many of them a cache with a life of five minutes after each request would have answered."""
    key = F.sha2(F.concat_ws(":", "event_type", (F.col("user_id") % 50).cast("string")), 256)
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select(key.alias("key"), "ts", "event_id").withColumn("before", F.lag("ts").over(order))
    return rows.groupBy("key").agg(F.count("*").cast("long").alias("requests"), F.count(F.when(F.col("ts") <= F.col("before") + F.expr("INTERVAL 5 MINUTES"), 1)).alias("hits"))


_COLLECTION = """old AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 3 <> 0),
new AS (SELECT vec_id, label + 100 AS label, embedding FROM embeddings WHERE vec_id % 4 = 0), gone AS (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 1)"""


@query("vec_write", f"WITH {_COLLECTION}, u AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE vec_id NOT IN (SELECT vec_id FROM new)) SELECT vec_id, label, len(embedding) AS dims FROM u WHERE vec_id NOT IN (SELECT vec_id FROM gone)")
def vec_write(spark, sf_dir):
    """A vector collection after a batch: additions and updates by id, then deletions; vectors of another size than the collection's go out."""
    from loomstone.operators.changes import delete_by_key, upsert

    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    dims = v.agg(F.max(F.size("embedding")).alias("dims"))  # one row
    new = v.filter("vec_id % 4 = 0").withColumn("label", F.col("label") + 100)
    left = delete_by_key(upsert(v.filter("vec_id % 3 <> 0"), new, ["vec_id"]), v.filter("vec_id % 10 = 1").select("vec_id"), ["vec_id"])
    return left.withColumn("size", F.size("embedding")).join(dims).filter("size = dims").select("vec_id", "label", F.col("size").cast("long").alias("dims"))


@query("vec_verify", "SELECT label, count(*) AS stored, count(*) FILTER (len(embedding) = (SELECT max(len(embedding)) FROM embeddings)) AS right_size, count(*) FILTER (vec_id IN (SELECT doc_id FROM documents)) AS with_unit FROM embeddings GROUP BY label")
def vec_verify(spark, sf_dir):
    """Parity of a collection with its units: vectors stored, of the right size, and with a unit behind them."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("size"))
    dims = v.agg(F.max("size").alias("dims"))  # one row
    known = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("known")).distinct()
    met = v.join(known, "vec_id", "left").join(dims)
    return met.groupBy("label").agg(F.count("*").cast("long").alias("stored"), F.count(F.when(F.col("size") == F.col("dims"), 1)).alias("right_size"), F.count("known").alias("with_unit"))


_RUNS = "runs AS (SELECT event_type || ' ' || CAST(user_id % 50 AS VARCHAR) AS query, event_type AS search_type, count(*) AS executions, max(ts) AS last FROM events GROUP BY 1, 2)"


@query("list_popular_recent_saved", f"""WITH {_RUNS}, r AS (SELECT *, row_number() OVER (ORDER BY executions DESC, query) AS p, row_number() OVER (ORDER BY last DESC, query) AS l FROM runs)
SELECT 'popular' AS list, CAST(p AS INT) AS place, query, search_type, executions FROM r WHERE p <= 10 UNION ALL SELECT 'recent', CAST(l AS INT), query, search_type, executions FROM r WHERE l <= 10""")
def list_popular_recent_saved(spark, sf_dir):
    """The ten saved searches that ran most often and the ten that ran last; windows number ten rows each."""
    runs = query_log(spark, sf_dir).groupBy("query", "search_type").agg(F.count("*").cast("long").alias("executions"), F.max("ts").alias("last"))

    def top(name: str, column: str):
        place = F.row_number().over(Window.orderBy(F.desc(column), "query"))
        return runs.orderBy(F.desc(column), "query").limit(10).select(F.lit(name).alias("list"), place.alias("place"), "query", "search_type", "executions")

    return top("popular", "executions").unionByName(top("recent", "last"))
