"""Around the search: caches, quarantine, hydration, prompts, enrichment, messages."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.functions import elements as E
from corvane.storage import settle
from corvane.operators.retrieval import cosine, two_legs  # noqa: F401

#: Likeness of a cache hit, candidates, days and hits of a stale entry.
THRESHOLD, CANDIDATES, STALE_DAYS, STALE_HITS = 0.92, 1000, 30, 1


def query_key(query: Column) -> Column:
    return F.md5(F.lower(F.regexp_replace(query, r"^\s+|\s+$", "")))


def event_key(event_id: Column, *parts: Column) -> Column:
    """The event's own id, else a digest of its parts."""
    return F.coalesce(F.nullif(event_id, F.lit("")), F.sha2(F.concat_ws(":", *parts), 256))


def cache_candidates(cache: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The entries that are compared: most hits first, then the newest. The limit is the feature."""
    return cache.orderBy(F.desc("hit_count"), F.desc("created_at"), "query_hash").limit(most)


def cache_lookup(queries: DataFrame, cache: DataFrame, threshold: float = THRESHOLD, most: int = CANDIDATES) -> DataFrame:
    """Nearest entry of cache(query_hash, embedding, hit_count, created_at, facet, …) for each query(query_id, query_embedding, facet), if it is near enough.

    An entry serves its own facet only. The candidates are at most ``most`` rows, so they are broadcast.
    """
    own = cache_candidates(cache, most).withColumnRenamed("facet", "entry_facet")
    pairs = queries.join(F.broadcast(own), F.col("facet").eqNullSafe(F.col("entry_facet")))
    near = pairs.select("query_id", "query_hash", F.round(cosine(F.col("embedding"), F.col("query_embedding")), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    return near.groupBy("query_id").agg(F.max_by(F.struct("query_hash", "similarity"), F.struct("similarity", "query_hash")).alias("hit")).select("query_id", "hit.query_hash", "hit.similarity")


def cache_with_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """The cache after its hits have been counted."""
    n = hits.groupBy("query_hash").agg(F.count("*").alias("n"))
    return cache.join(n, "query_hash", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("n", F.lit(0))).drop("n")


def cache_set(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache after answers(query, embedding, answer, sources, facet, created_at) were put in: each takes the place of its query's entry, with no hits.

    Of several answers to one query the newest stays.
    """
    own = answers.withColumn("query_hash", query_key(F.col("query"))).withColumn("hit_count", F.lit(0).cast(cache.schema["hit_count"].dataType))
    newest = own.groupBy("query_hash").agg(F.max_by(F.struct(*[c for c in cache.columns if c != "query_hash"]), "created_at").alias("e")).select("query_hash", "e.*").select(*cache.columns)
    return cache.join(newest.select("query_hash"), "query_hash", "left_anti").unionByName(newest)


#: Characters that a hypothetical answer must exceed to be kept.
LEAST_REPLY = 20


def hypothetical(queries: DataFrame, cache: DataFrame, generate: Callable[[Column], Column], wording: str = "Ответь кратко как эксперт:\n{query}") -> tuple[DataFrame, DataFrame]:
    """Queries(query_id, query) with a hypothetical answer to search by, and the cache(query_hash, hypothetical) with the new ones.

    Only queries that the cache does not know are asked, each text once; replies
    of 20 characters or fewer are neither used nor kept.
    """
    own = queries.withColumn("query_hash", query_key(F.col("query")))
    before, _, behind = wording.partition("{query}")
    missing = own.join(cache, "query_hash", "left_anti").groupBy("query_hash").agg(F.min("query").alias("query"))
    reply = generate(F.concat(F.lit(before), F.col("query"), F.lit(behind)))
    new = settle(missing.select("query_hash", reply.alias("hypothetical")).where(F.length("hypothetical") > LEAST_REPLY), "replies")
    full = cache.select("query_hash", "hypothetical").unionByName(new)
    return own.join(full, "query_hash", "left").drop("query_hash"), full


def cache_kept(cache: DataFrame, now: Column, days: int = STALE_DAYS, hits: int = STALE_HITS) -> DataFrame:
    """Without the stale entries: older than ``days`` (fractions count) with at most ``hits`` hits."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("created_at"))) / F.lit(86_400e6)
    return cache.where(~((age > days) & (F.col("hit_count") <= hits)))


def quarantined(store: DataFrame, added: DataFrame) -> DataFrame:
    """Store after adding rows(chunk_id, reason, source, quarantined_at): one added again is unreviewed again."""
    return store.join(added.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(added.withColumn("reviewed", F.lit(0)))


def approved(store: DataFrame, ids: DataFrame) -> DataFrame:
    seen = ids.select("chunk_id").distinct().withColumn("seen", F.lit(1))
    return store.join(seen, "chunk_id", "left").withColumn("reviewed", F.coalesce("seen", "reviewed")).drop("seen")


def hydrated(results: DataFrame, store: DataFrame) -> DataFrame:
    """Content of the results from store(chunk_id, content, chunk_type): text replaces it, other types fill full_content."""
    own = store.select("chunk_id", F.col("content").alias("stored"), "chunk_type")
    kept = F.col("content") if "content" in results.columns else F.lit(None).cast("string")
    out = results.join(own, "chunk_id", "left").withColumn("content", F.when(F.coalesce(F.col("chunk_type"), F.lit("text")) == "text", F.coalesce("stored", kept)).otherwise(kept))
    return out.withColumn("full_content", F.when(F.col("chunk_type") != "text", F.col("stored"))).drop("stored")


def facet_filtered(leg: DataFrame, wanted: str) -> DataFrame:
    """Rows of one leg whose facet is wanted or unknown, ranked anew; it comes after the leg's own limit."""
    own = leg.where(F.col("facet").isin(wanted, "unknown"))
    return own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("long"))


def prompts(results: DataFrame, numbered: bool = False) -> DataFrame:
    """Context of each query: the context strings of its results in order; ``numbered``: each under a line with its number and source. A query's results are few (top k)."""
    head = F.concat(F.lit("--- Фрагмент "), F.col("rank").cast("string"), F.lit(" (источник: "), F.col("source"), F.lit(", стр. "), F.col("page").cast("string"), F.lit(") ---\n")) if numbered else F.lit("")
    own = results.select("query_id", "rank", F.concat(head, F.lit("")).alias("head"), E.context_string(F.col("source"), F.col("page"), F.col("heading"), F.col("chunk_type"), F.col("content")).alias("shown"))
    return own.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "head", "shown"))), lambda s: F.concat(s["head"], s["shown"])), "\n\n").alias("context"))


def sources_of(results: DataFrame, most: int = 3) -> DataFrame:
    """First distinct sources of each query's results, in order."""
    first = results.groupBy("query_id", "source").agg(F.min("rank").alias("at"))
    own = first.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("at", "source"))).where(F.col("n") <= most)
    return own.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "source"))), lambda s: s["source"]), "; ").alias("sources"))


def figures_with_context(figures: DataFrame, texts: DataFrame, most: int = 320) -> DataFrame:
    """figures(chunk_id, source, page, heading, caption) with the longest text of their page: heading, caption and its start, once each."""
    longest = texts.groupBy("source", "page").agg(F.max_by(F.substring("content", 1, most), F.struct(F.length("content"), F.col("content"))).alias("near"))
    parts = F.array_distinct(F.filter(F.transform(F.array("heading", "caption", "near"), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    return figures.join(longest, ["source", "page"], "left").withColumn("content", F.array_join(parts, " — ")).drop("near")


def split_message(text: str | None, limit: int = 3900) -> list[str]:
    """Parts of a message: cut at a blank line, else a line end, else a sentence, if that is past half of the limit, else hard."""
    rest, limit, out = (text or "").strip(), max(100, limit), []
    while len(rest) > limit:
        for mark, extra in (("\n\n", 0), ("\n", 0), (". ", 1), (None, 0)):
            at = limit if mark is None else rest.rfind(mark, 0, limit)
            at += extra if at >= 0 else 0
            if at >= limit / 2:
                break
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [p for p in [*out, rest] if p] or [""]


def messages(texts: DataFrame, key: str, text: str, limit: int = 3900) -> DataFrame:
    """(key, part, content): parts of every text, from 1. A null text is one empty part."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, n, p) for k, t in zip(batch[key], batch[text]) for n, p in enumerate(split_message(t, limit), 1)], columns=[key, "part", "content"])

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, part long, content string")


EVENT = "type string, group_id string, event_id string, secret string, object struct<message: struct<id: bigint, from_id: bigint, peer_id: bigint, text: string, payload: string, date: bigint, conversation_message_id: bigint>>"


#: Peers from this number on are chats of several people.
GROUP_PEER = 2_000_000_000


def _valid(event: Column, secret: str | None, group: str | None) -> Column:
    """Whether a callback carries the secret and the group that are expected; what is not set is not checked."""
    tests = [event["secret"] == secret] if secret else []
    tests += [event["group_id"].try_cast("long") == int(group)] if group else []
    return F.coalesce(functools.reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def replies(raw: DataFrame, code: str, value: str = "value", secret: str | None = None, group: str | None = None) -> DataFrame:
    """What a webhook answers to each of its lines: the code to a valid confirmation, else ok; ``process``: whether the line goes on to :func:`incoming`.

    Lines that are no JSON object, or have another secret or group, are answered and dropped.
    """
    e = F.from_json(value, EVENT)
    own = raw.withColumn("valid", F.coalesce(F.try_parse_json(value).isNotNull() & _valid(e, secret, group), F.lit(False))).withColumn("kind", F.coalesce(e["type"], F.lit("")))
    return own.withColumn("reply", F.when(F.col("valid") & (F.col("kind") == "confirmation"), F.lit(code)).otherwise("ok")).withColumn("process", F.col("valid") & (F.col("kind") == "message_new")).drop("valid", "kind")


def to_process(messages: DataFrame, seen: DataFrame, groups: bool) -> DataFrame:
    """Messages(event_key, peer_id, t) with ``reason``: ok, group_chat_disabled (tested first, leaves no trace) or duplicate of one in seen(event_key) or of an earlier message."""
    chat = F.lit(not groups) & (F.col("peer_id") >= GROUP_PEER)
    own = messages.withColumn("chat", chat).join(seen.select("event_key").distinct().withColumn("known", F.lit(True)), "event_key", "left")
    nth = F.row_number().over(W.partitionBy("event_key", "chat").orderBy("t"))
    reason = F.when(F.col("chat"), "group_chat_disabled").when(F.col("known") | (nth > 1), "duplicate").otherwise("ok")
    return own.withColumn("reason", F.coalesce(reason, F.lit("ok"))).drop("chat", "known")


def incoming(raw: DataFrame, value: str = "value", secret: str | None = None, groups: bool = True, group: str | None = None) -> DataFrame:
    """Messages of webhook lines: only new messages of people that hold a text or a payload; a wrong secret or group and, if told so, group chats go."""
    own = raw.withColumn("e", F.from_json(value, EVENT)).where("e.type = 'message_new'")
    own = own.where(_valid(F.col("e"), secret, group))
    m = F.col("e.object.message")
    text, payload = F.trim(F.coalesce(m["text"], F.lit(""))), F.trim(F.coalesce(m["payload"], F.lit("")))
    peer = F.coalesce(F.nullif(m["peer_id"], F.lit(0)), m["from_id"])
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    key = event_key(F.col("e.event_id"), F.coalesce("e.group_id", F.lit("")), F.col("e.type"), m["from_id"].cast("string"), peer.cast("string"), number(m["id"]), number(m["conversation_message_id"]), number(m["date"]), F.substring(text, 1, 200))
    out = own.where(F.coalesce(m["from_id"] > 0, F.lit(False)) & ((text != "") | (payload != "")))
    out = out if groups else out.where(peer < GROUP_PEER)
    return out.select(key.alias("event_key"), m["from_id"].alias("user_id"), peer.alias("peer_id"), text.alias("text"), payload.alias("payload"), *(F.get_json_object(payload, f"$.{c}").alias(c) for c in ("cmd", "to", "id", "model")))


#: Limits of a request: characters of the query, results.
QUERY_CHARS, MOST_RESULTS, DEFAULT_RESULTS = 3000, 10, 4


def requests(raw: DataFrame) -> DataFrame:
    """Requests(query, user_id, top_k, model_filter, use_memory, validate) with their defaults, and ``error``: query or top_k out of their limits, else null."""
    query = F.coalesce("query", F.lit(""))
    k = F.coalesce(F.col("top_k").cast("int"), F.lit(DEFAULT_RESULTS))
    error = F.when(~F.length(query).between(1, QUERY_CHARS), "query").when(~k.between(1, MOST_RESULTS), "top_k")
    return raw.withColumns({"query": query, "top_k": k, "error": error, "user_id": F.coalesce("user_id", F.lit("api")), "model_filter": F.coalesce("model_filter", F.lit("")), "use_memory": F.coalesce("use_memory", F.lit(False)), "validate": F.coalesce("validate", F.lit(True))})


def deliveries(parts: DataFrame, keyboard: str | None = None, attachment: str = "attachment") -> DataFrame:
    """What is sent of messages(key, part, content[, attachment]): keyboard and attachment go with the last part of a message only."""
    last = F.col("part") == F.max("part").over(W.partitionBy("key"))
    own = parts.withColumn("keyboard", F.when(last, F.lit(keyboard)))
    return own.withColumn(attachment, F.when(last, F.col(attachment))) if attachment in parts.columns else own


#: Codes of a failed sending that is tried once more, and pauses in seconds before that and between parts.
TRANSIENT, RETRY_PAUSE, PART_PAUSE = frozenset((6, 9, 10)), 0.7, 0.2


def sent(rows: DataFrame, connect: Callable[[], Callable[[dict], int | None]], pause: Callable[[float], None] | None = None) -> DataFrame:
    """Send rows(key, part, content, …) part by part; (key, part, ok, tries).

    ``connect`` runs once a task and gives a function that sends a row and
    returns None or an error code; a transient code or an exception is tried once more.
    """
    import time

    wait = pause or time.sleep
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = connect()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for tries in (1, 2):
                    try:
                        code = send(row)
                        again = code in TRANSIENT
                    except Exception:  # a sender may fail in any way; the row says so
                        code, again = -1, True
                    if code is None or not again or tries == 2:
                        break
                    wait(RETRY_PAUSE)
                out.append((row["key"], row["part"], code is None, tries))
                wait(PART_PAUSE)
            yield pd.DataFrame(out, columns=["key", "part", "ok", "tries"])

    return rows.repartition("key").sortWithinPartitions("key", "part").mapInPandas(run, f"key {kinds['key']}, part {kinds['part']}, ok boolean, tries int")


def attachments(figures: DataFrame, upload: Callable[[Column], Column], most: int = 2) -> DataFrame:
    """One attachment string a query of figures(query_id, rank, image_path): the first ``most`` distinct pictures, those whose upload gives a name."""
    first = figures.where(F.coalesce("image_path", F.lit("")) != "").groupBy("query_id", "image_path").agg(F.min("rank").alias("at"))
    own = first.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("at", "image_path"))).where(F.col("n") <= most)
    named = own.withColumn("name", upload(F.col("image_path"))).where(F.coalesce("name", F.lit("")) != "")
    return named.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda s: s["name"]), ",").alias("attachment"))


def facet_for_user(asked: Column, stored: Column) -> Column:
    """Struct(facet, ask): what the text names, else what the user prefers; without both the user is asked."""
    found = F.coalesce(F.nullif(asked, F.lit("unknown")), F.nullif(stored, F.lit("unknown")))
    return F.struct(found.alias("facet"), found.isNull().alias("ask"))
