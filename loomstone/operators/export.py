"""Exports: units as CSV, JSON, JSON-LD, Markdown, RSS and HTML text, as expressions, and writers around Spark's sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_line(columns: list[Column], delimiter: str = ",") -> Column:
    """One CSV line; null and empty become nothing, and values with quotes, delimiters or line breaks are quoted."""

    def cell(c: Column) -> Column:
        v = F.coalesce(c.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(v.contains('"') | v.contains(delimiter) | v.contains("\n"), quoted).otherwise(v)

    return F.concat_ws(delimiter, *[cell(c) for c in columns])


def json_ld(units: DataFrame) -> Column:
    """A schema.org article of a unit."""
    return F.to_json(
        F.struct(
            F.lit("CreativeWork").alias("@type"), F.col("id").alias("identifier"), F.col("title").alias("name"),
            F.array_join("tags", ",").alias("keywords"), F.col("category").alias("about"),
        )
    )


def markdown_unit() -> Column:
    return F.concat(F.lit("## "), F.col("title"), F.lit("\n\n**Type:** "), F.col("type"), F.lit("\n**Category:** "), F.col("category"), F.lit("\n**Tags:** "), F.array_join("tags", ", "), F.lit("\n"))


def xml_text(c: Column) -> Column:
    out = c
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def rss_item() -> Column:
    return F.concat(F.lit("<item><title>"), xml_text(F.col("title")), F.lit("</title><guid>"), xml_text(F.col("id")), F.lit("</guid><category>"), xml_text(F.col("category")), F.lit("</category></item>"))


def html_unit() -> Column:
    return F.concat(F.lit("<article><h2>"), xml_text(F.col("title")), F.lit("</h2><p>"), xml_text(F.col("content")), F.lit("</p></article>"))


def front_matter() -> Column:
    """The head of a unit's Markdown file."""
    return F.concat(F.lit("---\nid: "), F.col("id"), F.lit("\ntype: "), F.col("type"), F.lit("\ncategory: "), F.col("category"), F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n"))


def write_export(units: DataFrame, path: str, kind: str, per_file: int = 1000) -> None:
    """Write units as csv, ndjson, parquet, or md (one text row a unit, in folders by month), at most per_file rows a file."""
    flat = units.withColumn("tags", F.array_join("tags", ","))
    writer = flat.write.mode("overwrite").option("maxRecordsPerFile", per_file)
    if kind == "csv":
        writer.csv(path, header=True, escape='"')
    elif kind == "ndjson":
        writer.json(path)
    elif kind == "parquet":
        units.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)
    elif kind == "md":
        rows = units.select(F.concat(front_matter(), markdown_unit(), F.col("content")).alias("value"), F.date_format(F.timestamp_seconds("created"), "yyyy-MM").alias("year_month"))
        rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy("year_month").text(path)
    else:
        raise ValueError(f"no exporter for {kind!r}")


def dispatch(kind: str) -> tuple[str, str]:
    """MIME type and extension of an export format."""
    known = {"csv": ("text/csv", "csv"), "json": ("application/json", "json"), "ndjson": ("application/x-ndjson", "ndjson"), "jsonld": ("application/ld+json", "jsonld"), "markdown": ("text/markdown", "md"), "rss": ("application/rss+xml", "xml"), "html": ("text/html", "html")}
    return known[kind]
