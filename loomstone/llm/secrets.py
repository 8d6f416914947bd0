"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates come from four patterns: the three base kinds and `generic`, a long token of mixed letters and digits. A text's matches
(regexp_extract_all) and the texts between them (split) become rows of a length each, and running sums over a text's rows give the
places, so a text with very many matches costs time in proportion to them.

Values leave the scan as SHA-256 hashes only. Every hash is counted across the corpus: in how many repositories and by how many
owners it occurs, by grouped counts that are combined step by step (hash, owner, repository; hash, owner; hash), so a value that holds
a third of all candidates is a few rows when it is shuffled. Values of many owners or many repositories are copied examples; values
of few that look random are live. Base spans stay whatever the verdict; generic spans are added where the value is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import column_or_null, join_split, let, plain, staged

#: Fixed patterns of the contract, and what a match must have.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
#: The method's own kind.
GENERIC = r"[A-Za-z0-9+/_-]{32,}"
KINDS = ["assign", "access", "hex", "generic"]
#: A value of at most MAX_LIVE owners and MAX_REPOSITORIES repositories, and of at least MIN_DISTINCT different characters, letters and
#: digits among them, looks live.
MAX_LIVE = 2
MAX_REPOSITORIES = 4
MIN_DISTINCT = 8


def _looks_random(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT) & value.rlike("[A-Za-z]") & value.rlike("[0-9]")


def _found(text: Column, rank: int, pattern: str) -> Column:
    """Every leftmost non-overlapping match: rank, order, gap (code points behind the match before), size, value (hash), random, and
    whether the match counts."""

    def one(match: Column, order: Column, between: Column) -> Column:
        value = F.regexp_extract(match, ASSIGN, 2) if rank == 0 else match
        counts = F.length(value) >= MIN_VALUE if rank == 0 else _looks_random(value) if rank == 3 else F.lit(True)
        return F.struct(
            F.lit(rank).alias("rank"), order.alias("order"), F.length(between[order]).cast("long").alias("gap"), F.length(match).cast("long").alias("size"),
            F.sha2(value, 256).alias("value"), _looks_random(value).alias("random"), counts.alias("counts"),
        )

    none = F.array().cast("array<struct<rank:int,order:int,gap:bigint,size:bigint,value:string,random:boolean,counts:boolean>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda b: F.transform(m, lambda x, i: one(x, i, b)))))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """doc_id, owner, repository and `found`: an array of the matches of every pattern, base kinds first."""
    bare, own = plain(docs)
    text = F.coalesce(F.col(own["text"]).cast("string"), F.lit(""))
    by = column_or_null(bare, own, owner, "string")
    return bare.select(
        F.col(own["doc_id"]).cast("long").alias("doc_id"),
        F.coalesce(by, F.lit("")).alias("owner"),
        F.concat_ws("/", F.coalesce(by, F.lit("")), F.coalesce(column_or_null(bare, own, repository, "string"), F.lit(""))).alias("repository"),
        F.concat(*[_found(text, k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, GENERIC))]).alias("found"),
    )


def placed(scanned: DataFrame) -> DataFrame:
    """uid, owner, repository, rank, start, end (code points, end exclusive), value and random of every match that counts."""
    each = scanned.filter(F.size("found") > 0).select("uid", "owner", "repository", F.inline("found"))
    order = Window.partitionBy("uid", "rank").orderBy("order")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    return each.withColumn("end", end).filter("counts").select("uid", "owner", "repository", "rank", (F.col("end") - F.col("size")).alias("start"), "end", "value", "random")


def ownership(spans: DataFrame) -> DataFrame:
    """value (hash), n_spans, n_repositories, n_owners, live and copied for every candidate value of placed()."""
    by_repository = spans.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"), F.first("random").alias("random"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"), F.first("random").alias("random"))
    total = by_owner.groupBy("value").agg(
        F.sum("n").alias("n_spans"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"), F.first("random").alias("random")
    )
    few = (F.col("n_owners") <= MAX_LIVE) & (F.col("n_repositories") <= MAX_REPOSITORIES)
    return total.select("value", "n_spans", "n_repositories", "n_owners", (few & F.col("random")).alias("live"), (~few).alias("copied"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, base (array of start, rank, end, in that order), spans (the live generic ones too), n_live
    and n_copied (candidate spans whose value is live, or occurs with more than MAX_LIVE owners or MAX_REPOSITORIES repositories).

    A null text counts as empty; null owners and repositories count as one, named "". Repeated rows each keep a row and count as
    spans, not as owners. Spans that start at one place come in the order of KINDS, then of their ends. Texts of any length and with any
    number of matches are scanned whole. No rows in: no rows out. Other columns, whatever their names, are ignored.
    """
    found = candidates(docs, owner, repository).withColumn("uid", F.monotonically_increasing_id())
    scanned = staged(found, "secrets-found")  # from here on uid is fixed
    spans = staged(placed(scanned), "secrets-spans")
    verdicts = staged(ownership(spans).select("value", "n_spans", "live", "copied"), "secrets-values")
    judged = join_split(spans, verdicts, ["value"], "n_spans")
    one = F.struct("start", "rank", "end")
    per = judged.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.when(F.col("rank") < 3, one))).alias("base"),
        F.sort_array(F.collect_list(F.when((F.col("rank") < 3) | F.col("live"), one))).alias("spans"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    met = scanned.select("uid", "doc_id").join(per, "uid", "left")
    zero = F.lit(0).cast("long")
    return met.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def joined(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: Column) -> Column:
    return F.sha2(joined(found), 256)
