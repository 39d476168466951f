"""Streams of events: counts, cooldowns, transitions, deduplication, gated merging. Every function takes a streaming DataFrame
with event_id, user_id, event_type, ts (timestamp) and gives one; start() runs it until what is there has been read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..adapters import PRIORITY


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, so many at a time: what is appended later is read later."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_counts(events: DataFrame, limit: int = 5, late: str = "1 day") -> DataFrame:
    """user_id, event_type, day, n, limited: actions of a user by day, closed once no later event of the day is taken."""
    day = F.window("ts", "1 day")
    n = events.withWatermark("ts", late).groupBy(day.alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", F.to_date("w.start").alias("day"), "n", (F.col("n") > limit).alias("limited"))


def weekly_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """start, n: events of each seven days, one day apart."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), "n")


def once_only(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each id; ids are forgotten once nothing so late is taken."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, n: runs of a user's events with no longer pause between them."""
    n = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").alias("start"), "n")


def _by_time(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows that a micro-batch has for a key, oldest first."""
    return pd.concat(list(frames)).sort_values(["ts", "event_id"])


def transitions(events: DataFrame) -> DataFrame:
    """event_id, user_id, before, now: events that raise a user's state, which is kept from batch to batch."""
    schema = "event_id bigint, user_id bigint, before int, now int"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (0,)
        out = []
        for r in _by_time(frames).itertuples():
            now = PRIORITY.get(r.event_type, 0)
            if now > last:
                out.append((r.event_id, key[0], last, now))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "before", "now"])

    return events.groupBy("user_id").applyInPandasWithState(step, schema, "last int", "append", GroupStateTimeout.NoTimeout)


def cooldown(events: DataFrame, seconds: int) -> DataFrame:
    """event_id, blocked: an event is blocked while one that was sent by its user and type is at most that long ago."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, blocked = _by_time(frames), []
        for now in rows["ts"].astype("datetime64[us]").astype("int64"):
            wait = last is not None and now - last <= seconds * 1_000_000
            blocked.append(wait)
            last = last if wait else now
        state.update((int(last),))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "blocked": blocked})

    return events.groupBy("user_id", "event_type").applyInPandasWithState(step, "event_id bigint, blocked boolean", "last bigint", "append", GroupStateTimeout.NoTimeout)


def gated(check: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: merges a batch if the check finds nothing in it, else leaves it out whole. Merging the same
    batch twice, as after a failure, must change nothing."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        if not check(kept).take(1):
            merge(kept)
        kept.unpersist()

    return run


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over what is there now, its rows to Parquet files; the next call goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def start_batches(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
