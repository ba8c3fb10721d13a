"""Deduplication, order-sensitive windows, manifests, evaluation."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from corvane.functions import text as X
from corvane.operators import ordered


def best_of_group(chunks: DataFrame) -> DataFrame:
    """One chunk a key (first 2000 lower-case characters and type): the best by quality, the first on a tie.

    chunks(chunk_id, content, chunk_type, source, page, facet, heading, ord); the
    winner gains the distinct places of the others (``also_from``).
    """
    keyed = chunks.withColumn("dedup_key", X.short_hash(F.concat(F.substring(F.lower("content"), 1, 2000), F.lit("|"), F.col("chunk_type")))).withColumn("quality", X.quality(F.col("content"), F.col("page"), F.col("facet"), F.col("heading")))
    place = F.struct("source", "page")
    best = keyed.groupBy("dedup_key").agg(
        F.min_by(F.struct("chunk_id", "source", "page", "quality"), F.struct((-F.col("quality")).alias("q"), "ord")).alias("w"), F.min("ord").alias("first_ord"), F.count("*").alias("copies"), F.array_sort(F.collect_set(place)).alias("places"))
    return best.select("dedup_key", "w.chunk_id", "w.quality", "first_ord", "copies", F.filter("places", lambda p: ~((p["source"] == F.col("w.source")) & (p["page"] == F.col("w.page")))).alias("also_from"))


def sequence_in_source(chunks: DataFrame) -> DataFrame:
    """``seq`` of each chunk in its source, from 0 in the order of ``ord``."""
    return ordered.running_sum(chunks, F.lit(1), "source", "ord", "seq").withColumn("seq", F.col("seq") - 1)


def forward_fill(rows: DataFrame, value: str, partition: str, order: str, default) -> DataFrame:
    """Last non-null value up to each row."""
    out = ordered.last_known(rows, F.col(value), partition, order, f"{value}_filled")
    return out.withColumn(f"{value}_filled", F.coalesce(f"{value}_filled", F.lit(default)))


#: Least confidence of a weak detection before the first strong one.
WEAK_ENOUGH = 0.6


def sticky(pages: DataFrame, strong: str, weak: str, confidence: str, partition: str, order: str, default=None, known: tuple[str, ...] | None = None) -> DataFrame:
    """Facet of each page: the last strong signal; before the first one ``default`` if it is known, else the page's own weak detection if it is sure enough, else unknown."""
    out = ordered.last_known(pages, F.col(strong), partition, order, "strong_so_far")
    start = F.lit(None).cast("string") if default is None else default
    start = F.when(start.isin(*known), start) if known else F.nullif(start, F.lit("unknown"))
    own = F.when(F.col(confidence) >= WEAK_ENOUGH, F.nullif(F.col(weak), F.lit("unknown")))
    return out.withColumn("facet", F.coalesce("strong_so_far", start, own, F.lit("unknown"))).drop("strong_so_far")


def segments(rows: DataFrame, partition: str, order: str, scope: list[str]) -> DataFrame:
    """Running number of stretches with one scope."""
    own = ordered.with_previous(rows, F.struct(*scope), partition, order, "scope_before")
    change = F.when(F.col("scope_before.value").eqNullSafe(F.struct(*scope)), 0).otherwise(1)
    return ordered.running_sum(own, change, partition, order, "segment").drop("scope_before")


#: Turns of a user's history that are remembered.
HISTORY = 5


def history(messages: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last turns of messages(user_id, t, turn, role, content) of each user, oldest first: with ``nth`` from 1. Equal times keep the order of their turns."""
    latest = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("t"), F.desc("turn")))
    own = messages.withColumn("back", latest).where(F.col("back") <= most)
    return own.withColumn("nth", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("back")))).drop("back")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status of each key of two manifests(key, sha): removed, changed, new, same."""
    o, n = old.select("key", F.col("sha").alias("old_sha")), new.select("key", F.col("sha").alias("new_sha"))
    status = F.when(F.col("new_sha").isNull(), "removed").when(F.col("old_sha").isNull(), "new").when(F.col("old_sha") != F.col("new_sha"), "changed").otherwise("same")
    return o.join(n, "key", "full_outer").select("key", status.alias("status"))


def ingest_plan(old: DataFrame, new: DataFrame, incremental: bool = True) -> DataFrame:
    """What an ingest does with each file of two manifests(key, sha): key, status, action (read, keep, drop).

    A changed or removed file means a rebuild, which reads all that is there;
    else new files are read. Without an old manifest, or not incremental, all are read.
    """
    if not incremental:
        return new.select("key", F.lit("new").alias("status"), F.lit("read").alias("action"))
    own = manifest_diff(old, new)
    rebuild = F.broadcast(own.agg(F.coalesce(F.bool_or(F.col("status").isin("removed", "changed")), F.lit(False)).alias("rebuild")))  # one row
    action = F.when(F.col("status") == "removed", "drop").when(F.col("rebuild") | (F.col("status") == "new"), "read").otherwise("keep")
    return own.crossJoin(rebuild).select("key", "status", action.alias("action"))


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def token_f1(pairs: DataFrame, answer: str, reference: str) -> DataFrame:
    """F1 of the lower-case word sets without punctuation, three decimals; 0 if either is empty."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    words = lambda c: F.array_distinct(F.filter(F.split(plain(c), r"\s+"), lambda w: w != ""))
    a, r = words(answer), words(reference)
    both = F.size(F.array_intersect(a, r))
    p, q = both / F.nullif(F.size(a), F.lit(0)), both / F.nullif(F.size(r), F.lit(0))
    return pairs.withColumn("token_f1", F.coalesce(F.round(F.when(both > 0, 2 * p * q / (p + q)), 3), F.lit(0.0)))


def admitted(events: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Sliding-window limiter over events(key, t, event_id): only admitted events count, one exactly a window old still does.

    Events of a key are read in order and only its open window is kept, so a
    worker's memory does not follow the size of a key. A null key is a key of its own.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    own = events.select("key", "t", "event_id", F.to_json(F.struct("key")).alias("same"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, live = None, deque()
        for batch in batches:
            verdicts = []
            for same, t in zip(batch["same"], batch["t"]):
                if same != current:
                    current, live = same, deque()
                while live and t - live[0] > window_seconds:
                    live.popleft()
                verdicts.append(len(live) < limit)
                if verdicts[-1]:
                    live.append(t)
            yield batch[["key", "event_id"]].assign(admitted=verdicts)

    ordered = own.repartition("same").sortWithinPartitions("same", "t", "event_id")
    return ordered.mapInPandas(run, f"key {kinds['key']}, event_id {kinds['event_id']}, admitted boolean")


def admitted_two_level(events: DataFrame, per_key: int, overall: int, window_seconds: int, scope: str | None = None) -> DataFrame:
    """Overall limit first, then each key's: an event that its key rejects has still used an overall slot.

    The overall limit is one sequence by definition; ``scope`` names a column that
    has a limit of its own for each value. Returns key, event_id, verdict
    (admitted, overall, key).
    """
    first = admitted(events.select((F.col(scope) if scope else F.lit(0)).alias("key"), "t", "event_id"), overall, window_seconds).select("event_id", F.col("admitted").alias("passed"))
    own = events.select("key", "t", "event_id").join(first, "event_id")
    second = admitted(own.where("passed").select("key", "t", "event_id"), per_key, window_seconds).select("event_id", "admitted")
    verdict = F.when(~F.col("passed"), "overall").when(F.col("admitted"), "admitted").otherwise("key")
    return own.join(second, "event_id", "left").select("key", "event_id", verdict.alias("verdict"))
