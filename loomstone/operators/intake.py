"""Intake policy: which files may enter, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.redaction import redact

# Paths and extensions that stay out, the largest file, the confidence from which a detection is masked and from
# which it keeps a file out.
BLOCKED_PATHS = [r"(^|/)\.git(/|$)", r"(^|/)node_modules(/|$)", r"(^|/)artifacts/secrets(/|$)", r"(^|/)\.env(\.|$)", r"(^|/)\.ssh(/|$)"]
BLOCKED_EXTENSIONS = [".pem", ".key", ".p12", ".pfx", ".der", ".crt", ".cer"]
MAX_BYTES = 25 * 1024 * 1024
MASK_FROM, CRITICAL_FROM = 0.55, 0.9


def reasons(path: Column, size: Column, blocked_paths: list[str] = BLOCKED_PATHS, blocked_extensions: list[str] = BLOCKED_EXTENSIONS, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is quarantined, as far as its path and size tell: size, path and extension, in this order; empty if nothing does."""
    low = F.lower(path)
    extension = F.regexp_extract(low, r"[^/](\.[^./]*)$", 1)
    found = [
        F.when(size > max_bytes, F.lit("size")),
        F.when(low.rlike("|".join(blocked_paths)), F.lit("path")),
        F.when(extension.isin(blocked_extensions), F.lit("extension")),
    ]
    return F.array_compact(F.array(*found))


def evaluate(docs: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """key, reasons, allowed, redacted and n_redacted of every row, also where keys repeat. Beside path and size, a detection of high
    confidence quarantines. Whole texts are scanned, however long."""
    told = docs.select(F.struct(F.col(key), reasons(F.col(path), F.octet_length(text)).alias("told")).alias("row"), F.col(text).alias("text"))
    every = F.when(F.col("top_confidence") >= CRITICAL_FROM, F.array_append("row.told", F.lit("detection"))).otherwise(F.col("row.told"))
    judged = redact(told, "row", "text", MASK_FROM).withColumn("reasons", every)
    return judged.select(F.col("row")[key].alias(key), "reasons", (F.size("reasons") == 0).alias("allowed"), "redacted", "n_redacted")
