"""Chat exports read as turns (thread_id, title, turn_index, role, content)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

# What roles and providers are called.
ROLES = {"human": "user", "prompt": "user", "user": "user", "assistant": "assistant", "model": "assistant", "bot": "assistant", "response": "assistant", "system": "system", "tool": "tool"}
PROVIDERS = [("chatgpt", ["chatgpt"]), ("claude", ["claude"]), ("gemini", ["gemini"]), ("grok", ["grok", "xai"]), ("copilot", ["copilot", "github"])]


def map_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(role)), F.lit("unknown"))


def provider_of(path: Column) -> Column:
    """The provider that a path names; the first listed wins."""
    p, out = F.lower(path), F
    for name, marks in PROVIDERS:
        hit = p.contains(marks[0])
        for m in marks[1:]:
            hit = hit | p.contains(m)
        out = out.when(hit, name)
    return out.otherwise("unknown")


def instant(value: Column) -> Column:
    """Epoch seconds, or milliseconds for values over 1e12, as a timestamp."""
    return F.timestamp_seconds(F.when(value > 1e12, value / 1000).otherwise(value))


# The exports' fields.
CLAUDE = "struct<uuid: string, name: string, chat_messages: array<struct<sender: string, text: string, created_at: string>>>"
CHATGPT = "struct<id: string, title: string, mapping: map<string, struct<message: struct<id: string, author: struct<role: string>, create_time: double, content: struct<parts: array<string>>>>>>"
_TURN = "array<struct<role: string, content: string>>"
MESSAGES = f"struct<id: string, title: string, messages: {_TURN}, turns: {_TURN}, exchanges: array<struct<prompt: string, response: string>>>"


def claude_turns(threads: DataFrame) -> DataFrame:
    """Turns of threads with chat_messages (columns of CLAUDE)."""
    rows = threads.select("uuid", "name", F.posexplode("chat_messages").alias("i", "m"))
    return rows.select(F.col("uuid").alias("thread_id"), F.col("name").alias("title"), F.col("i").alias("turn_index"), map_role(F.col("m.sender")).alias("role"), F.col("m.text").alias("content"))


def chatgpt_turns(threads: DataFrame) -> DataFrame:
    """Turns of threads whose mapping is a message tree (columns of CHATGPT): user and assistant messages by their time."""
    rows = threads.select("id", "title", F.explode(F.map_values("mapping")).alias("n"))
    m = rows.select("id", "title", F.col("n.message.author.role").alias("role"), F.col("n.message.create_time").alias("create_time"), F.array_join("n.message.content.parts", "\n").alias("content"))
    kept = m.filter(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    w = Window.partitionBy("id").orderBy("create_time", "content")
    return kept.select(F.col("id").alias("thread_id"), "title", (F.row_number().over(w) - 1).alias("turn_index"), "role", "content")


def message_turns(threads: DataFrame) -> DataFrame:
    """Turns of threads with messages, turns or exchanges (columns of MESSAGES); an exchange becomes two turns."""
    pairs = F.flatten(F.transform("exchanges", lambda e: F.array(F.struct(F.lit("user").alias("role"), e["prompt"].alias("content")), F.struct(F.lit("assistant").alias("role"), e["response"].alias("content")))))
    each = threads.select("id", "title", F.posexplode(F.coalesce("messages", "turns", pairs)).alias("i", "m")).filter(F.trim("m.content") != "")
    return each.select(F.col("id").alias("thread_id"), "title", F.col("i").alias("turn_index"), map_role(F.col("m.role")).alias("role"), F.col("m.content").alias("content"))


def parsed_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The columns of a JSON text; texts that do not parse give nulls."""
    return rows.select(F.from_json(column, schema).alias("j")).select("j.*")


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The threads of export files, each an array of threads or one thread."""
    return spark.read.schema(t.StructType.fromDDL(schema.removeprefix("struct<").removesuffix(">"))).json(path, multiLine=True)


def read_claude_export(spark: SparkSession, path: str) -> DataFrame:
    return claude_turns(read_export(spark, path, CLAUDE))


def read_chatgpt_export(spark: SparkSession, path: str) -> DataFrame:
    return chatgpt_turns(read_export(spark, path, CHATGPT))


def read_messages_export(spark: SparkSession, path: str) -> DataFrame:
    return message_turns(read_export(spark, path, MESSAGES))


_NAMES = "|".join(ROLES)
_TAGGED = re.compile(rf"^[\s#>*-]*({_NAMES})\s*[:-]\s*(.*)$", re.I)
_HEADED = re.compile(rf"^\s*#{{1,6}}\s*({_NAMES})\s*$", re.I)


def transcript_turns(raw: str) -> list[tuple[str, str]]:
    """(role, content) of a transcript whose turns open with `User:` or `## Assistant`."""
    turns: list[tuple[str, list[str]]] = []
    for line in re.split(r"\r\n?|\n", raw):
        if m := _TAGGED.match(line) or _HEADED.match(line):
            first = m[2] if m.re is _TAGGED else ""
            turns.append((ROLES[m[1].lower()], [first] if first else []))
        elif turns:
            turns[-1][1].append(line)
    joined = [(role, "\n".join(lines).strip()) for role, lines in turns]
    return [(role, content) for role, content in joined if content]


def parse_transcripts(files: DataFrame, key: str = "path", text: str = "value") -> DataFrame:
    """Turns of whole-text transcripts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, role, content) for k, raw in zip(f[key], f[text], strict=True) for i, (role, content) in enumerate(transcript_turns(raw or ""))]
            yield pd.DataFrame(rows, columns=["thread_id", "turn_index", "role", "content"])

    return files.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, "thread_id string, turn_index int, role string, content string")


def read_bookmarks(spark: SparkSession, path: str, depth: int = 12) -> DataFrame:
    """name, url and added of a browser's bookmark file: folders to `depth` levels, times in microseconds since 1601."""
    node = "name string, url string, date_added string"
    for _ in range(depth):
        node = f"name string, url string, date_added string, children array<struct<{node}>>"
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", f"roots map<string, struct<{node}>>").alias("r")).select(F.explode(F.map_values("r.roots")).alias("n"))
    found, level = None, parsed
    for _ in range(depth + 1):
        here = level.filter(F.col("n.url").isNotNull()).select("n.name", "n.url", "n.date_added")
        found = here if found is None else found.unionByName(here)
        if "children" not in level.schema["n"].dataType.names:
            break
        level = level.select(F.explode("n.children").alias("n"))
    return found.select("name", "url", F.timestamp_micros(F.col("date_added").cast("long") - 11644473600000000).alias("added"))
