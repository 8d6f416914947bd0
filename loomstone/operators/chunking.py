"""Chunks and sections of documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the sliding windows and of the guard rails.
WINDOW, OVERLAP, SINGLE_BELOW = 500, 50, 800
MIN_TOKENS, MAX_CHUNKS = 160, 40


def token_windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk, token_start, token_end, n_tokens and content: one chunk below SINGLE_BELOW tokens, else overlapping windows."""
    d = docs.select(key, F.array_remove(F.split(text, r"\s+"), "").alias("w")).filter(F.size("w") > 0)
    n, step = F.size("w"), WINDOW - OVERLAP
    last = F.when(n < SINGLE_BELOW, 0).otherwise(F.ceil((n - WINDOW) / float(step))).cast("int")
    s = d.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    start = F.when(n < SINGLE_BELOW, 0).otherwise(F.col("i") * step)
    end = F.when(n < SINGLE_BELOW, n).otherwise(F.least(n, F.col("i") * step + WINDOW))
    return s.select(
        key, F.col("i").cast("long").alias("chunk"), start.cast("long").alias("token_start"), end.cast("long").alias("token_end"), n.cast("long").alias("n_tokens"),
        F.array_join(F.slice("w", start + 1, end - start), " ").alias("content"),
    )


def guardrails(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks below MIN_TOKENS dropped unless all are; more than MAX_CHUNKS merged in equal groups. Returns key, chunk and merged."""
    by = Window.partitionBy(key)
    big = F.col("token_end") - F.col("token_start") >= MIN_TOKENS
    kept = chunks.drop("content").withColumn("any_big", F.max(big).over(by)).filter(big | ~F.col("any_big"))
    kept = kept.select(key, (F.row_number().over(by.orderBy("chunk")) - 1).alias("r"), F.count("*").over(by).alias("m"))
    group = F.when(F.col("m") > MAX_CHUNKS, F.floor(F.col("r") / F.ceil(F.col("m") / float(MAX_CHUNKS)))).otherwise(F.col("r"))
    return kept.groupBy(key, group.cast("long").alias("chunk")).agg(F.count("*").cast("long").alias("merged"))


_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def section_rows(text: str) -> list[tuple[str, int, int, int, str]]:
    """(type, level, first line, last line, content) of code, tables, lists, headings, quotes and paragraphs, in line order."""
    lines, found, i = text.split("\n"), [], 0

    def run(test) -> int:
        j = i
        while j < len(lines) and test(lines[j]):
            j += 1
        return j

    while i < len(lines):
        line = lines[i]
        if line.startswith("```"):
            j = next((k for k in range(i + 1, len(lines)) if lines[k].startswith("```")), len(lines) - 1) + 1
            kind, level = "code", 0
        elif m := _HEADING.match(line):
            j, kind, level = i + 1, "heading", len(m[1])
        elif line.lstrip().startswith("|"):
            j, kind, level = run(lambda x: x.lstrip().startswith("|")), "table", 0
        elif _LIST.match(line):
            j, kind, level = run(_LIST.match), "list", 0
        elif line.startswith(">"):
            j, kind, level = run(lambda x: x.startswith(">")), "blockquote", 0
        elif line.strip():
            j = run(lambda x: x.strip() and not (_HEADING.match(x) or _LIST.match(x) or x.startswith((">", "```")) or x.lstrip().startswith("|")))
            kind, level = "paragraph", 0
        else:
            i += 1
            continue
        content = "\n".join(lines[i:j])
        if kind != "paragraph" or len(content) > 50:
            found.append((kind, level, i, j - 1, content))
        i = j
    return found


def _with_parents(rows: list[tuple[str, int, int, int, str]]) -> list[tuple]:
    stack: list[tuple[int, int]] = []
    out = []
    for kind, level, a, b, content in rows:
        if kind == "heading":
            while stack and stack[-1][0] >= level:
                stack.pop()
        out.append((kind, len(stack), a, b, stack[-1][1] if stack else None, content))
        if kind == "heading":
            stack.append((level, a))
    return out


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, type, level (open headings above), start_line, end_line, parent (line of the nearest heading) and content."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *r) for k, t in zip(f[key], f[text], strict=True) for r in _with_parents(section_rows(t or ""))]
            out = pd.DataFrame(rows, columns=[key, "type", "level", "start_line", "end_line", "parent", "content"])
            yield out.astype({"parent": "Int32"})

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, type string, level int, start_line int, end_line int, parent int, content string")


def semantic_pieces(text: str, least: int = 200, most: int = 1200) -> list[str]:
    """Paragraphs gathered until the next would pass `most` characters; a last piece below `least` joins the one before."""
    pieces: list[str] = []
    now = ""
    for part in re.split(r"\n\s*\n|\n", text):
        if not part.strip():
            continue
        if now and len(now) + 1 + len(part) > most:
            pieces.append(now)
            now = part
        else:
            now = f"{now}\n{part}" if now else part
    if now and pieces and len(now) < least:
        pieces[-1] += "\n" + now
    elif now:
        pieces.append(now)
    return pieces


def top_words(text: str, n: int = 5) -> list[str]:
    counts = Counter(w for w in re.findall(r"[a-z0-9_]+", text.lower()) if len(w) > 4)
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]]


def semantic_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk, n_chars, keywords, and related: the document's earlier chunk that shares at least two keywords, or null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text], strict=True):
                seen: list[set[str]] = []
                for i, piece in enumerate(semantic_pieces(t or "")):
                    words = top_words(piece)
                    related = next((j for j, w in enumerate(seen) if len(w & set(words)) >= 2), None)
                    rows.append((k, i, len(piece), ",".join(words), related))
                    seen.append(set(words))
            yield pd.DataFrame(rows, columns=[key, "chunk", "n_chars", "keywords", "related"]).astype({"related": "Int32"})

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk int, n_chars int, keywords string, related int")


def mock_vector(text: str, dims: int) -> list[float]:
    """A reproducible vector: a 32-bit FNV-1a hash of the UTF-16 units seeds a linear congruential generator."""
    seed = 2166136261
    for unit in np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist():
        seed = ((seed ^ unit) * 16777619) & 0xFFFFFFFF
    out = []
    for _ in range(dims):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(seed / 0xFFFFFFFF * 2 - 1)
    return out


def mock_embeddings(docs: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mock_vector(t or "", dims))

    return docs.select(key, embed(text).alias("embedding"))
