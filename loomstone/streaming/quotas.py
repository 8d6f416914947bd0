"""Streaming: file watching, request quotas and token buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch_files(spark: SparkSession, path: str, schema: str, file_format: str = "json") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(file_format).schema(schema).load(path)


def upsert_stream(stream: DataFrame, key: str, order: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row of every key in the Parquet folder `target`, one versioned subfolder a batch.

    Within a batch the last row of a key wins, which debounces bursts of changes. A batch that runs again after a failure
    writes the same folder again from the version before it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        out = newest
        if number > 0:
            old = batch.sparkSession.read.parquet(f"{target}/v{number - 1}")
            both = old.unionByName(newest)
            out = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.col(order)).alias("r")).select("r.*")
        out.write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_quota(events: DataFrame, user: str, ts: str, window: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Requests by user and clock-aligned window with the verdict over the quota; state is dropped `late` after a window."""
    grouped = events.withWatermark(ts, late).groupBy(F.col(user), F.window(ts, window).alias("w")).agg(F.count("*").alias("used"))
    return grouped.select(user, F.col("w.start").alias("window_start"), "used", (F.col("used") > limit).alias("over"))


def anchored_quota(events: DataFrame, user: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Fixed windows that open with a user's first request: user, ts and allowed for every request, in order of time.

    State is one (window start, used) pair a user.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(ts)
        verdicts = []
        for t in rows[ts].astype("int64") // 10**9 if str(rows[ts].dtype).endswith("ns]") else rows[ts].astype("datetime64[s]").astype("int64"):
            if start is None or t - start >= seconds:
                start, used = int(t), 0
            used += 1
            verdicts.append(used <= limit)
        state.update((start, used))
        yield pd.DataFrame({user: rows[user], ts: rows[ts], "allowed": verdicts})

    kind = events.schema[user].dataType.simpleString()
    return events.groupBy(user).applyInPandasWithState(step, f"{user} {kind}, {ts} timestamp, allowed boolean", "start long, used int", "append", GroupStateTimeout.NoTimeout)


def token_bucket(events: DataFrame, user: str, ts: str, rate: float, burst: float) -> DataFrame:
    """Which requests a token bucket lets pass: user, ts and allowed for every request. A user's bucket starts full, holds `burst`
    tokens at most and gains `rate` a second; a request takes one.

    State is one (tokens, newest time) pair a user; a late request finds the bucket as it is.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values(ts)
        verdicts = []
        for t in rows[ts].astype("datetime64[us]").astype("int64") / 1e6:
            last = t if last is None else last
            tokens, last = min(burst, tokens + max(0.0, t - last) * rate), max(t, last)
            verdicts.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({user: rows[user], ts: rows[ts], "allowed": verdicts})

    kind = events.schema[user].dataType.simpleString()
    return events.groupBy(user).applyInPandasWithState(step, f"{user} {kind}, {ts} timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def recent_events(events: DataFrame, ts: str, key: str, n: int = 1000) -> DataFrame:
    """The newest n events, as a bounded queue would hold them."""
    return events.orderBy(F.desc(ts), F.desc(key)).limit(n)
