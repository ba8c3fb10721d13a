"""Streaming twins over an event table: deduplication, windows, sessions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.storage import is_folder, work_folder


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table as a stream; the table is one file or a folder of files."""
    own = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return own.parquet(path)
    # a stream reads folders only: a single file is picked out of its own
    folder, _, name = path.rpartition("/")
    return own.option("pathGlobFilter", name).parquet(folder)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    return table_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append", partition: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return the rows of its sink, a table in the shared folder."""
    spark = stream.sparkSession
    out = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.partitionBy(partition) if partition else stream.writeStream
    query = writer.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: How long an event is remembered.
REMEMBERED = "24 hours"


def deduplicated(events: DataFrame, keys: list[str], remembered: str = REMEMBERED) -> DataFrame:
    """The first event of each key; what was seen longer ago than ``remembered`` is forgotten, so the state has a bound."""
    return events.withWatermark("ts", remembered).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Counts of closed windows by type."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, slide: str) -> DataFrame:
    """Counts of closed overlapping windows by type."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Events of each user without a pause of ``gap``: start and count of closed sessions."""
    return events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def dated(events: DataFrame) -> DataFrame:
    return events.withColumn("log_date", F.date_format("ts", "yyyyMMdd"))


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Rows of a key in one micro-batch; the source's trigger options bound them."""
    return pd.concat(list(parts)).sort_values(["t", "event_id"], kind="stable")


def limited(events: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Sliding-window limiter over a stream(key, t, event_id); the state of a key is its open window.

    Within a micro-batch events count in order of time; the batch twin is ``records.admitted``.
    """
    kind = events.schema["key"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = json.loads(state.get[0]) if state.exists else []
        own, verdicts = _in_order(parts), []
        for t in own["t"]:
            live = [x for x in live if t - x <= window_seconds]
            verdicts.append(len(live) < limit)
            if verdicts[-1]:
                live.append(t)
        state.update((json.dumps(live),))
        yield pd.DataFrame({"key": key[0], "event_id": own["event_id"], "admitted": verdicts})

    return events.groupBy("key").applyInPandasWithState(step, f"key {kind}, event_id long, admitted boolean", "live string", "append", GroupStateTimeout.NoTimeout)


def preferences(events: DataFrame) -> DataFrame:
    """Preference and pending question of each key over a stream(key, t, event_id, op, value).

    ``set`` keeps a preference and leaves the question, ``ask`` keeps a question,
    ``pop`` gives it back once. Returns key, event_id, preference, popped.
    """
    kind = events.schema["key"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        preference, pending = state.get if state.exists else (None, None)
        rows = []
        for event, op, value in _in_order(parts)[["event_id", "op", "value"]].itertuples(index=False):
            popped = pending if op == "pop" else None
            preference = value if op == "set" else preference
            pending = value if op == "ask" else None if op == "pop" else pending
            rows.append((key[0], event, preference, popped))
        state.update((preference, pending))
        yield pd.DataFrame(rows, columns=["key", "event_id", "preference", "popped"])

    return events.groupBy("key").applyInPandasWithState(step, f"key {kind}, event_id long, preference string, popped string", "preference string, pending string", "append", GroupStateTimeout.NoTimeout)


#: Turns of a conversation that its state holds.
HISTORY = 5


def conversations(messages: DataFrame, most: int = HISTORY) -> DataFrame:
    """Memory of conversations over a stream(key, t, event_id, op, role, content): the state of a key is its last ``most`` turns.

    ``add`` appends a turn, ``clear`` forgets all, other operations only read.
    Returns key, event_id and history (array of role and content, oldest first) after each.
    """
    kind = messages.schema["key"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        rows = []
        for event, op, role, content in _in_order(parts)[["event_id", "op", "role", "content"]].itertuples(index=False):
            held = [] if op == "clear" else ([*held, {"role": role, "content": content}] if op == "add" else held)[-most:]
            rows.append((key[0], event, list(held)))
        state.update((json.dumps(held),))
        yield pd.DataFrame(rows, columns=["key", "event_id", "history"])

    return messages.groupBy("key").applyInPandasWithState(step, f"key {kind}, event_id long, history array<struct<role: string, content: string>>", "held string", "append", GroupStateTimeout.NoTimeout)


def dispatched(stream: DataFrame, handle: Callable[[DataFrame, int], None], at_once: int = 2, state: str | None = None, drain: bool = False) -> StreamingQuery:
    """Hand a stream's micro-batches to ``handle(batch, number)``, in ``at_once`` partitions, so that no more events are worked on at a time.

    The source's trigger options (files or rows a batch) bound a batch; with
    ``state`` a restart goes on after the last batch that was handled.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(lambda batch, number: handle(batch.coalesce(at_once), number))
    writer = writer.option("checkpointLocation", state or f"{work_folder(spark)}/dispatch-{uuid.uuid4().hex}")
    return (writer.trigger(availableNow=True) if drain else writer).start()


def stopped(query: StreamingQuery, seconds: float | None = None) -> bool:
    """Let a query finish what has arrived, then stop it; whether it ended without a failure."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination(None if seconds is None else int(seconds))
    return query.exception() is None


def log_entries(answers: DataFrame) -> DataFrame:
    """Entries of a query log of answers(ts, query, model_type, answer, sources, validation, status): with timestamp, query_hash and the day that they are filed under."""
    own = answers.withColumns({"timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "query_hash": F.substring(F.sha2("query", 256), 1, 16), "log_date": F.date_format("ts", "yyyyMMdd")})
    return own.drop("ts")
