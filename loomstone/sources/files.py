"""Local and federated files as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import title_from_path

# Extensions that a federated scan takes, its size limit, and formats by extension.
EXTENSIONS = ["md", "markdown", "txt", "text", "html", "htm", "json", "jsonl", "csv", "tsv", "yaml", "yml", "xml", "rst", "org", "log", "ts", "js", "py", "sql"]
MAX_BYTES = 1 << 20
FORMATS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "pdf": "pdf"}


def read_local_files(spark: SparkSession, path: str, glob: str = "*", modified_after: str | None = None) -> DataFrame:
    """id (md5 of the path), path, title, content, format and modified of text files, newer ones only if modified_after is given."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return reader.load(path).select(
        F.md5("path").alias("id"), "path", title_from_path(F.col("path")).alias("title"), F.decode("content", "UTF-8").alias("content"),
        F.coalesce(F.try_element_at(known, extension), F.lit("txt")).alias("format"), F.col("modificationTime").alias("modified"),
    )


def scan_federated(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Files of allowed extensions and size, without empty and binary ones: source_id, external_id, title, content, hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    allowed = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(EXTENSIONS) & (F.col("length") > 0) & (F.col("length") <= MAX_BYTES)
    text = files.filter(allowed).select("path", F.decode("content", "UTF-8").alias("content")).filter(~F.col("content").contains("\0"))
    return text.select(F.lit(source_id).alias("source_id"), F.col("path").alias("external_id"), title_from_path(F.col("path")).alias("title"), "content", F.sha2("content", 256).alias("hash"))


def read_embedding_cache(spark: SparkSession, path: str, newer_than: str | None = None) -> DataFrame:
    """key, embedding and created of a JSON-lines cache; the newest row of each key."""
    rows = spark.read.schema("key string, embedding array<float>, created timestamp").json(path)
    rows = rows.filter(F.col("created") >= newer_than) if newer_than else rows
    return rows.groupBy("key").agg(F.max_by("embedding", "created").alias("embedding"), F.max("created").alias("created"))


def ingest_all(sources: list[DataFrame]) -> DataFrame:
    """All sources' items, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
