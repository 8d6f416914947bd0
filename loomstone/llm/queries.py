"""Queries over the test tables for every operator of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import (
    collocations,
    decontaminate,
    language_id,
    licenses,
    line_dedup,
    prefix_trie,
    quality,
    secrets,
    sentencepiece_codec,
    sharding,
    simhash,
    toxicity,
    url_filter,
)
from loomstone.llm.common import table


#: Bytes of text in a shard: small, so that small tables split too.
SHARD_BYTES = 1 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), ["doc_id"], "text", SHARD_BYTES)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["rank"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        secrets.digest(F.col("base")).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: decoded_md5 is that of the text that the ids give back."""
    found = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    found = sentencepiece_codec.decode(found.select("_row.doc_id", F.col("_ids").alias("ids"), "_exact", "_parity"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.coalesce(F.size("_row.ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("_row.ids").alias("ids_xxhash64"),
        F.md5("_text").alias("decoded_md5"),
        F.col("_row._exact").alias("exact"),
        F.col("_row._parity").alias("parity"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.mark(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_lines").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"),
        F.array_join(F.transform("_gone", lambda x: x.cast("string")), ",").alias("removed"),
        F.md5("_text").alias("text_md5"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.judge(docs, keep=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(F.col("_row.doc_id").alias("doc_id"), *counts, F.round("distance", 6).alias("distance"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_spans(docs, table(spark, sf_dir, "benchmark"))
    found = found.select(F.col("_row.doc_id").alias("doc_id"), F.col("_n_words").alias("n_words"), decontaminate.n_hit().alias("n_hit"), "_items")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_secrets": op2_secrets,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_language_id": op13_language_id,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SHARDING = f"""
WITH rows AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents
),
low AS (SELECT greatest(0, CAST(ceil(log2(greatest(1, sum(bytes) / {SHARD_BYTES}.0))) AS INT) - 2) AS low FROM rows),
depths AS (SELECT unnest(range(0, 41)) AS depth),
buckets AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) AS shard_bytes
  FROM rows, depths, low WHERE depth >= low GROUP BY ALL HAVING sum(bytes) <= {SHARD_BYTES}
),
fits AS (
  SELECT doc_id, bytes, h, min(struct_pack(depth := b.depth, shard_bytes := b.shard_bytes)) AS s
  FROM rows r JOIN buckets b ON b.prefix = r.h >> (60 - b.depth) GROUP BY doc_id, bytes, h
)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes,
  CASE WHEN s.depth = 0 THEN '' ELSE right(bin(h + (1::BIGINT << 60)), 60)[:s.depth] END AS shard,
  CAST(s.depth AS INT) AS depth, CAST(s.shard_bytes AS BIGINT) AS shard_bytes
FROM fits
"""


def _sql_spans(pattern: str, rank: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, owner, repository, {rank} AS rank, m[i] AS match,
    CAST(list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, owner, repository, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM docs
    ) WHERE len(m) > 0
  )"""


_RANDOM = f"len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT} AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')"
_SQL_ASSIGN = secrets.ASSIGN.replace("'", "''")
_SECRETS = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents
),
raw AS ({" UNION ALL ".join(_sql_spans(p, k) for k, p in enumerate((secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.GENERIC)))}),
found AS (
  SELECT *, start + length(match) AS stop, ['assign', 'access', 'hex', 'generic'][rank + 1] AS kind,
    CASE WHEN rank = 0 THEN regexp_extract(match, '{_SQL_ASSIGN}', 2) ELSE match END AS value FROM raw
),
good AS (
  SELECT * FROM found WHERE (rank = 0 AND length(value) >= {secrets.MIN_VALUE}) OR rank IN (1, 2) OR (rank = 3 AND {_RANDOM})
),
owners AS (
  SELECT value, count(DISTINCT owner) <= {secrets.MAX_LIVE} AND count(DISTINCT owner || chr(9) || repository) <= {secrets.MAX_REPOSITORIES} AS few FROM good GROUP BY value
),
judged AS (SELECT g.*, few, few AND {_RANDOM.replace("value", "g.value")} AS live FROM good g JOIN owners o ON g.value = o.value),
docwise AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT few) AS n_copied
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN docwise USING (doc_id)
"""

_LINES = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents
),
long_lines AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines WHERE words > 0),
boiler AS (
  SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM long_lines GROUP BY line
  HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES} OR (max(words) > {line_dedup.PASSAGE} AND count(DISTINCT doc_id) > 1)
),
gone AS (SELECT l.doc_id, l.pos FROM long_lines l JOIN boiler b ON l.line = b.line AND struct_pack(doc_id := l.doc_id, pos := l.pos) <> b.first)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
  coalesce(string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY g.pos) FILTER (g.pos IS NOT NULL), '') AS removed,
  md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS text_md5
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DECONTAMINATE = f"""
WITH bench AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
phrases AS (
  SELECT item, unnest(list_transform(range(1, greatest(2, len(w) - {decontaminate.WINDOW - 2})), lambda i: w[i:i + {decontaminate.WINDOW - 1}])) AS phrase FROM bench WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT len(phrase) AS n FROM phrases),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM places),
hits AS (SELECT doc_id, item, w.i, w.n FROM windows w JOIN (SELECT DISTINCT item, array_to_string(phrase, ' ') AS phrase FROM phrases) p USING (phrase)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1)"


def _sql_rule(of: str) -> str:
    """CASE over the rules, the longest first: the rule or the verdict."""
    arms = []
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        host, slash, path = rule.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"
        arms.append(f"WHEN {fits} THEN '{rule if of == 'rule' else verdict}'")
    return "CASE " + " ".join(arms) + " END"


_LINK = url_filter.LINK.replace("'", "''")
_URLS = f"""
WITH RECURSIVE parsed AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, html FROM pages),
judged AS (SELECT *, {_sql_rule("rule")} AS rule, {_sql_rule("verdict")} AS ruled FROM parsed),
seeds AS (SELECT DISTINCT host, ruled FROM judged WHERE host <> '' AND ruled IS NOT NULL),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{_LINK}', 2)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM parsed),
edges AS (SELECT DISTINCT src, dst FROM links WHERE src <> '' AND src <> dst),
shares AS (
  SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree
  FROM (SELECT 'allow' AS kind, src, dst FROM edges UNION ALL SELECT 'block', dst, src FROM edges)
),
steps AS (
  SELECT ruled AS kind, host, CAST({1 - url_filter.DAMPING!r} AS DOUBLE) AS score FROM seeds
  UNION ALL
  SELECT s.kind, s.dst, sum(CAST({url_filter.DAMPING} AS DOUBLE) * score / degree) AS arrived
  FROM shares s JOIN steps p ON p.kind = s.kind AND p.host = s.src GROUP BY s.kind, s.dst HAVING sum(CAST({url_filter.DAMPING} AS DOUBLE) * score / degree) > {url_filter.TOLERANCE}
),
scores AS (
  SELECT host, coalesce(sum(score) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'block'), 0) AS distrust FROM steps GROUP BY host
)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN distrust > {url_filter.BLOCK_RATIO} * trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores USING (host)
"""

#: crc32 of a decimal number, byte by byte and bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, zero: xor(c >> 1, (c & 1) * 3988292384))))"""
_TRIE = f"""
WITH originals AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
shared AS (SELECT *, CAST({_CRC32} % {prefix_trie.SHARED} AS INT) AS h FROM originals),
paths AS (
  SELECT a.conv_id, list_concat(coalesce(b.own, [])[:a.h], a.own[a.h + 1:]) AS path
  FROM shared a LEFT JOIN originals b ON b.conv_id = a.conv_id - a.conv_id % {prefix_trie.FAMILY}
),
prefixes AS (SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth, path FROM paths),
nodes AS (
  SELECT depth, path[:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, path[:depth]
),
children AS (SELECT node[:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY node[:depth - 1]),
valued AS (
  SELECT nodes.*, coalesce(c.n, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(nodes.node[depth].t)) ELSE 0 END AS value
  FROM nodes LEFT JOIN children c ON c.node = nodes.node
),
above AS (SELECT node[:k] AS node, value, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM valued)),
below AS (SELECT node, sum(value) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY node)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN below b ON b.node = v.node LEFT JOIN valued p ON v.depth > 0 AND p.node = v.node[:v.depth - 1]
"""

_PHRASES = f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS text FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs)
),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS words
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS k) WHERE len(w) >= k)
),
counted AS (SELECT lang, k, phrase, any_value(words) AS words, count(*) AS a FROM grams GROUP BY lang, k, phrase),
candidates AS (SELECT * FROM counted WHERE k > 1 AND a >= {collocations.LEAST}),
sizes AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
cuts AS (SELECT *, array_to_string(words[:j], ' ') AS head, array_to_string(words[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)),
scored AS (
  SELECT c.*, h.a AS l, t.a AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.k = c.j AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.k = c.k - c.j AND t.phrase = c.tail
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, a AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
),
kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= {collocations.INSIDE} * b.a)
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN sizes USING (lang) WHERE rank <= {collocations.TOP}
"""

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": _SHARDING,
    "op2_secrets": _SECRETS,
    "op5_line_dedup": _LINES,
    "op9_decontaminate": _DECONTAMINATE,
    "op10_url_filter": _URLS,
    "op11_prefix_trie": _TRIE,
    "op12_collocations": _PHRASES,
}
