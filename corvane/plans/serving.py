"""Queries over search results, caches, evaluation, chat, indexes, and plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from corvane.operators import evaluate, indexes, records, retrieval as R, serving as V
from corvane.plans.base import query, table

_NOW = "TIMESTAMP '2024-02-15 12:00:00'"
_CACHE = "cache AS (SELECT e.vec_id AS query_hash, e.embedding, e.label AS facet, e.vec_id % 4 AS hit_count, v.ts AS created_at FROM embeddings e JOIN events v ON v.event_id = e.vec_id)"


def _cache(spark, d) -> DataFrame:
    when = table(spark, d, "events").select(F.col("event_id").alias("query_hash"), F.col("ts").cast("timestamp").alias("created_at"))
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_hash"), "embedding", F.col("label").alias("facet"), (F.col("vec_id") % 4).alias("hit_count"))
    return own.join(when, "query_hash")


@query(f"WITH {_CACHE} SELECT query_hash, hit_count FROM cache ORDER BY hit_count DESC, created_at DESC, query_hash LIMIT 1000")
def cache_candidates(spark, d):
    return V.cache_candidates(_cache(spark, d)).select("query_hash", "hit_count")


@query(f"WITH {_CACHE} SELECT query_hash FROM cache WHERE NOT ((epoch_us({_NOW}) - epoch_us(created_at)) / 86400e6 > 30 AND hit_count <= 1)")
def cache_purge(spark, d):
    return V.cache_kept(_cache(spark, d), F.expr("TIMESTAMP '2024-02-15 12:00:00 UTC'")).select("query_hash")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COS = f"round({_DOT.format('c.embedding', 'q.embedding')} / (sqrt({_DOT.format('c.embedding', 'c.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})), 6)"


@query(f"""WITH {_CACHE}, c AS (SELECT * FROM cache ORDER BY hit_count DESC, created_at DESC, query_hash LIMIT 1000), q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE + 0.1::DOUBLE) AS embedding, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, query_hash, {_COS} AS similarity FROM q JOIN c ON q.label = c.facet)
SELECT query_id, query_hash, similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, query_hash DESC) = 1""")
def semantic_cache_lookup(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double") + 0.1).alias("query_embedding"), F.col("label").alias("facet"))
    return V.cache_lookup(asked, _cache(spark, d), threshold=0.3)


_RANKED = "r AS (SELECT l_orderkey AS query_id, l_partkey AS chunk_id, l_returnflag AS facet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem)"


def _ranked(spark, d) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_returnflag").alias("facet"), F.row_number().over(w).cast("long").alias("rank"))


@query("""WITH r AS (SELECT l_orderkey AS query_id, l_partkey AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem),
s AS (SELECT p_partkey AS chunk_id, CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE p_brand END AS facet FROM part), q AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 > 0 THEN 'Brand#' || (o_orderkey % 5 + 1) || '1' END AS wanted FROM orders)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r JOIN s USING (chunk_id) JOIN q USING (query_id) WHERE wanted IS NULL OR facet IN ('unknown', wanted)""")
def facet_postfilter(spark, d):
    store = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.when(F.col("p_size") % 4 == 0, "unknown").otherwise(F.col("p_brand")).alias("facet"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit("1"))).alias("wanted"))
    return R.facet_filtered(_ranked(spark, d).withColumn("score", F.lit(0.0)), store, asked).select("query_id", "chunk_id", "rank")


@query("""WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, l_quantity AS score, l_orderkey % 7 AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
SELECT query_id, rank AS before, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN c > 3 THEN -(score * n) END NULLS LAST, rank) AS rank FROM r""")
def rerank(spark, d):
    """A scorer over texts: the number in the text, times the number in the query; three results or fewer keep their order."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_linenumber").alias("before"), F.col("l_quantity").cast("string").alias("content"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 7).cast("string").alias("query"))
    return R.reranked(own, asked, lambda q, t: q.cast("double") * t.cast("double"), 3).select("query_id", "before", "rank")


@query(f"""WITH {_RANKED}, a AS (SELECT query_id, chunk_id, rank, CASE WHEN facet = 'N' THEN 0 ELSE 1 END AS leg FROM r), f AS (SELECT query_id, chunk_id, leg, rank FROM a QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY leg, rank) = 1)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY leg, rank, chunk_id) AS rank FROM f""")
def two_leg_vector(spark, d):
    own = _ranked(spark, d)
    return R.two_legs(own.where("facet = 'N'"), own.where("facet <> 'N'"))


_SHOWN = "s AS (SELECT query_id, rank, '[Документ: ' || p_brand || ', стр. ' || p_size || ']' || chr(10) || 'Раздел: ' || p_type || chr(10) || CASE WHEN chunk_id % 3 = 0 THEN 'ФОРМУЛА: ' WHEN chunk_id % 3 = 1 THEN 'РИСУНОК: ' ELSE '' END || p_name AS shown, p_brand, p_brand AS source, p_size AS page FROM r JOIN part ON p_partkey = chunk_id)"


def _shown(spark, d) -> DataFrame:
    store = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("source"), F.col("p_size").alias("page"), F.col("p_type").alias("heading"), F.when(F.col("p_partkey") % 3 == 0, "formula").when(F.col("p_partkey") % 3 == 1, "figure").otherwise("text").alias("chunk_type"), F.col("p_name").alias("content"))
    return _ranked(spark, d).join(store, "chunk_id")


@query(f"WITH {_RANKED}, {_SHOWN} SELECT query_id, string_agg(shown, chr(10) || chr(10) ORDER BY rank) AS context FROM s GROUP BY query_id")
def prompt_build(spark, d):
    return V.prompts(_shown(spark, d))


@query(f"WITH {_RANKED}, {_SHOWN} SELECT query_id, string_agg('--- Фрагмент ' || rank || ' (источник: ' || source || ', стр. ' || page || ') ---' || chr(10) || shown, chr(10) || chr(10) ORDER BY rank) AS context FROM s GROUP BY query_id")
def prompt_numbered(spark, d):
    return V.prompts(_shown(spark, d), numbered=True)


@query(f"""WITH {_RANKED}, {_SHOWN}, f AS (SELECT query_id, p_brand, min(rank) AS place FROM s GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, p_brand) AS n FROM f QUALIFY n <= 3)
SELECT query_id, string_agg(p_brand, '; ' ORDER BY n) AS sources FROM n GROUP BY query_id""")
def sources_top3(spark, d):
    return V.sources_of(_shown(spark, d))


@query(f"WITH {_RANKED} SELECT query_id, rank, CASE WHEN chunk_id % 2 = 0 THEN coalesce(p_name, 'own') ELSE 'own' END AS content, CASE WHEN chunk_id % 2 = 1 THEN p_name END AS full_content FROM r LEFT JOIN part ON p_partkey = chunk_id")
def hydrate(spark, d):
    store = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content"), F.when(F.col("p_partkey") % 2 == 0, "text").otherwise("table").alias("chunk_type"))
    return V.hydrated(_ranked(spark, d).withColumn("content", F.lit("own")), store).select("query_id", "rank", "content", "full_content")


@query("""WITH t AS (SELECT p_brand, p_size, p_type AS near FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY length(p_type) DESC, p_type DESC) = 1)
SELECT s_suppkey, CASE WHEN near IS NULL THEN s_name || ' — cap' ELSE s_name || ' — cap — ' || substr(near, 1, 320) END AS content FROM supplier LEFT JOIN t ON p_brand = 'Brand#' || (s_suppkey % 5 + 1) || '1' AND p_size = s_nationkey""")
def figure_context(spark, d):
    texts = table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_size").alias("page"), F.col("p_type").alias("content"))
    figures = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), F.lit("1")).alias("source"), F.col("s_nationkey").alias("page"), F.col("s_name").alias("heading"), F.lit("cap").alias("caption"))
    return V.figures_with_context(figures, texts).select("s_suppkey", "content")


@query("SELECT doc_id AS chunk_id, CASE WHEN quality = 0 THEN 0 ELSE 1 END AS reviewed FROM labels")
def quarantine_upsert(spark, d):
    own = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.lit("x").alias("reason"), F.lit("y").alias("source"), F.lit(0).alias("quarantined_at"), "quality")
    store = V.approved(V.quarantined(own.drop("quality").limit(0).withColumn("reviewed", F.lit(0)), own.drop("quality")), own)
    return V.quarantined(store, own.where("quality = 0").drop("quality")).select("chunk_id", "reviewed")


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN n_regionkey < 3 THEN n_name END) AS facet, NOT c_acctbal > 5000 AND n_regionkey >= 3 AS ask FROM customer JOIN nation ON n_nationkey = c_nationkey")
def model_resolution(spark, d):
    """What the text names, else what the user prefers, else a question."""
    own = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    asked, stored = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("unknown"), F.when(F.col("n_regionkey") < 3, F.col("n_name"))
    return own.select("c_custkey", V.facet_for_user(asked, stored).alias("f")).select("c_custkey", "f.facet", "f.ask")


def _message():
    return F.to_json(F.struct(
        F.when(F.col("event_id") % 7 == 0, "message_edit").otherwise("message_new").alias("type"), F.lit("g").alias("group_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("event_id"),
        F.struct(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(F.col("user_id")).alias("from_id"), F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.col("event_type")).alias("text"), F.when(F.col("event_id") % 6 == 0, '{"cmd":"nav"}').otherwise("").alias("payload")).alias("message")).alias("object")))


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE sha256('g:message_new:' || user_id || ':' || user_id || ':' || event_id || ':0:0:' || t) END AS event_key, user_id, t AS text, CASE WHEN event_id % 6 = 0 THEN 'nav' END AS cmd
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS t FROM events) WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND user_id > 0 AND (t <> '' OR event_id % 6 = 0)""")
def parse_message(spark, d):
    return V.incoming(table(spark, d, "events").select(_message().alias("value"))).select("event_key", "user_id", "text", "cmd")


_LAST = "length(h) - strpos(reverse(h), reverse({0})) - length({0}) + 1"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _rfind(mark: str) -> str:
    """Place (from 0) of the last mark in h, -1 without one."""
    return f"CASE WHEN strpos(h, {mark}) = 0 THEN -1 ELSE {_LAST.format(mark)} END"


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, 0 AS part, NULL::VARCHAR AS content, {_STRIP.format("coalesce(text, '')")} AS rest FROM documents UNION ALL
SELECT doc_id, part + 1, {_STRIP.format("substr(rest, 1, at_)")}, {_STRIP.format("substr(rest, at_ + 1)")} FROM (SELECT *, CASE WHEN length(rest) <= 3900 THEN length(rest) WHEN a >= 1950 THEN a WHEN b >= 1950 THEN b WHEN c >= 1950 THEN c ELSE 3900 END AS at_
  FROM (SELECT *, {_rfind("chr(10) || chr(10)")} AS a, {_rfind("chr(10)")} AS b, CASE WHEN strpos(h, '. ') = 0 THEN -1 ELSE {_LAST.format("'. '")} + 1 END AS c FROM (SELECT *, substr(rest, 1, 3900) AS h FROM r WHERE rest <> '' OR part = 0))))
SELECT doc_id, part::BIGINT AS part, content FROM r WHERE part > 0""")
def message_parts(spark, d):
    return V.messages(table(spark, d, "documents"), "doc_id", "text")


_METRICS = "l_linenumber % 4 / 4::DOUBLE AS a, l_quantity / 53 AS b, l_discount AS c, l_tax AS d"
_SCORE = "CASE WHEN (a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT = 0 THEN 0.0::DOUBLE ELSE round((greatest(a, 0) + greatest(b, 0) + greatest(c, 0) + greatest(d, 0)) / ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT), 3) END"


def _judged(spark, d) -> DataFrame:
    own = table(spark, d, "lineitem")
    return own.select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_linenumber") % 4 / 4).alias("faithfulness"), (F.col("l_quantity") / 53).alias("answer_relevancy"), F.col("l_discount").alias("context_precision"), F.col("l_tax").alias("context_recall"), (F.col("l_discount") * 3).alias("token_f1"), F.when(F.col("l_linestatus") == "F", "e").alias("error"))


@query(f"WITH m AS (SELECT l_orderkey, l_linenumber, {_METRICS} FROM lineitem) SELECT l_orderkey, l_linenumber, {_SCORE} AS score FROM m")
def eval_rag_score(spark, d):
    return _judged(spark, d).select("l_orderkey", "l_linenumber", evaluate.rag_score(*map(F.col, evaluate.METRICS)).alias("score"))


_MEANS = ", ".join(f"round(avg({x}) FILTER (l_linestatus <> 'F'), 3) AS {n}" for n, x in (("faithfulness", "a"), ("answer_relevancy", "b"), ("context_precision", "c"), ("context_recall", "d"), ("token_f1", "c * 3"), ("rag_score", "score")))


@query(f"WITH m AS (SELECT l_returnflag, l_linestatus, {_METRICS} FROM lineitem), s AS (SELECT *, {_SCORE} AS score FROM m) SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS n_errors, {_MEANS} FROM s GROUP BY l_returnflag")
def eval_report(spark, d):
    return evaluate.report(_judged(spark, d), ["l_returnflag"])


_REPLY = "p_name || ': ' || p_size || '.' || p_partkey % 10 || ' из ' || p_partkey || ' (' || p_size % 12 || ')'"


@query(rf"WITH n AS (SELECT p_partkey, list_filter(list_transform(regexp_extract_all({_REPLY}, '\b(\d+(?:\.\d+)?)\b', 1), lambda x: x::DOUBLE), lambda x: x <= 10) AS ns FROM part) SELECT p_partkey, coalesce(round(ns[1] / 10, 3), 0.0::DOUBLE) AS score FROM n".replace("\\\\", "\\"))
def score_parse(spark, d):
    """Replies with several numbers, of which the first within 0 to 10 counts."""
    key, size = F.col("p_partkey"), F.col("p_size")
    reply = F.concat("p_name", F.lit(": "), size.cast("string"), F.lit("."), (key % 10).cast("string"), F.lit(" из "), key.cast("string"), F.lit(" ("), (size % 12).cast("string"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", evaluate.score_of(reply).alias("score"))


_ANSWER = "substr(text, 1, 20 + (conv_id % 5 * 20)::INT) || CASE WHEN turn % 3 > 0 THEN ' [Документ: ' || CASE conv_id % 3 WHEN 0 THEN 'Guide' WHEN 1 THEN 'docs.PDF' ELSE 'other' END || ', стр. ' || turn || ']' ELSE '' END || CASE WHEN turn % 4 = 3 THEN ' [документ: guide.pdf, страница 1]' ELSE '' END"
_CITE = r"(?i)\[Документ:\s*([^,\]]+?),\s*стр(?:аница)?\.?\s*(\d+)\]"


@query(f"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS answer, CASE WHEN conv_id % 6 = 5 THEN [] ELSE [{{'s': 'x/guide.pdf', 'p': 1::BIGINT}}, {{'s': 'docs', 'p': turn}}] END AS sources, CASE WHEN conv_id % 11 = 3 THEN false END AS factual FROM conversations),
c AS (SELECT *, list_zip(regexp_extract_all(answer, '{_CITE}', 1), list_transform(regexp_extract_all(answer, '{_CITE}', 2), lambda x: x::BIGINT)) AS cited FROM a),
f AS (SELECT *, CASE WHEN len(sources) = 0 THEN [] ELSE list_filter(cited, lambda c: len(list_filter(sources, lambda s: s.p = c[2] AND (contains(lower(list_last(string_split(s.s, '/'))), lower(c[1])) OR contains(lower(c[1]), lower(list_last(string_split(s.s, '/'))))))) = 0) END AS fake FROM c)
SELECT conv_id, turn, CASE WHEN length(trim(answer, ' ')) < 50 THEN 'approved' WHEN factual = false THEN 'rejected' WHEN len(cited) = 0 OR len(fake) > 0 THEN 'review' ELSE 'approved' END AS status, len(cited)::INT AS n_citations, len(fake)::INT AS n_fake FROM f""")
def validate_answers(spark, d):
    """Answers of the conversations with citations of two documents, some right, some of another page or document."""
    conv, turn = F.col("conv_id"), F.col("turn")
    name = F.when(conv % 3 == 0, "Guide").when(conv % 3 == 1, "docs.PDF").otherwise("other")
    answer = F.concat(F.col("text").substr(F.lit(1), (20 + conv % 5 * 20).cast("int")), F.when(turn % 3 > 0, F.concat(F.lit(" [Документ: "), name, F.lit(", стр. "), turn.cast("string"), F.lit("]"))).otherwise(""), F.when(turn % 4 == 3, " [документ: guide.pdf, страница 1]").otherwise(""))
    place = lambda s, p: F.struct(F.lit(s).alias("source"), p.alias("page"))
    sources = F.when(conv % 6 == 5, F.expr("cast(array() as array<struct<source: string, page: bigint>>)")).otherwise(F.array(place("x/guide.pdf", F.lit(1).cast("long")), place("docs", turn)))
    own = table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer"), sources.alias("sources"), F.when(conv % 11 == 3, False).alias("factual"))
    return evaluate.validated(own).select("conv_id", "turn", "status", "n_citations", F.size("fake").alias("n_fake"))


def _store(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")).alias("content"), F.col("lang").alias("chunk_type"))


@query("SELECT lang AS chunk_type, count(*) AS n, count(*) FILTER (doc_id % 10 = 0 OR trim(coalesce(text, ''), ' ') = '') AS n_empty FROM documents GROUP BY lang")
def index_counts(spark, d):
    return indexes.chunk_counts(_store(spark, d)).select("chunk_type", "n", "n_empty")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 100 <> 7) AS l, count(*) FILTER (trim(coalesce(text, ''), ' ') = '') AS e FROM documents), v AS (SELECT count(*) AS v FROM embeddings)
SELECT CAST(n AS BIGINT) AS n_store, CAST(e AS BIGINT) AS n_empty, l AS n_lexical, v AS n_vectors, CASE WHEN n = 0 OR e > 0 OR abs(n - l) > greatest(5.0, 0.02 * n) THEN 'fail' WHEN abs(n - v) > greatest(5.0, 0.05 * n) THEN 'warn' ELSE 'ok' END AS status FROM c, v""")
def index_verify(spark, d):
    """The documents as a store, with a lexical index that lacks some of them and the vectors of another table."""
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.col("lang").alias("chunk_type"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return indexes.verified(own, own.where("chunk_id % 100 <> 7"), vectors).select("n_store", "n_empty", "n_lexical", "n_vectors", "status")


@query("""SELECT coalesce(CASE WHEN event_id % 4 > 0 THEN 'id' || event_id END, CASE WHEN event_id % 3 > 0 AND event_id % 8 = 4 THEN 'm' || event_id END, 'rec_' || substr(sha256(coalesce(c, '')), 1, 16)) AS chunk_id, c AS content, CASE WHEN event_id % 3 > 0 THEN user_id ELSE 0 END AS page, event_id % 3 = 0 OR (event_id % 4 = 0 AND event_id % 8 <> 4) AS backfilled
FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 2 THEN event_type || ' p' WHEN 3 THEN 'text ' || user_id END AS c FROM events) WHERE trim(coalesce(c, ''), ' ') <> '' OR event_id % 3 > 0""")
def record_coerce(spark, d):
    """Ids in three places or none; content under three names, empty (which hides the others) or absent; with and without metadata."""
    k = F.col("event_id")
    name = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    meta = F.when(k % 3 > 0, F.struct(F.col("user_id").cast("string").alias("page"), F.when(k % 8 == 4, name("m")).alias("chunk_id")))
    line = F.to_json(F.struct(
        F.when(k % 4 > 0, name("id")).alias("id"), F.when(k % 5 == 0, F.col("event_type")).when(k % 5 == 1, "").alias("content"), F.when(k % 5 == 2, F.concat("event_type", F.lit(" p"))).when(k % 5 == 1, "hidden").alias("page_content"),
        F.when(k % 5 == 3, F.concat(F.lit("text "), F.col("user_id").cast("string"))).when(k % 5 == 2, "hidden").alias("text"), meta.alias("metadata")))
    return indexes.coerced(table(spark, d, "events").select(line.alias("value"))).select("chunk_id", "content", "page", "backfilled")


@query("SELECT source, lang, text IS NOT NULL AS has_text, min(doc_id) AS first_doc FROM documents GROUP BY source, lang, text")
def dedup_first(spark, d):
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "source", F.lit(1).cast("long").alias("page"), F.col("lang").alias("chunk_type"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"), F.col("text").isNotNull().alias("has_text"), "doc_id")
    return indexes.first_of_group(own, F.col("doc_id")).select("source", F.col("chunk_type").alias("lang"), "has_text", F.col("doc_id").alias("first_doc"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq FROM documents")
def seq_backfill(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("chunk_id"), "source", F.col("doc_id").alias("ord"))
    adjacency = records.sequence_in_source(own).select("chunk_id", F.col("seq").cast("long").alias("seq"))
    return indexes.with_seq(own.withColumn("seq", F.lit(None).cast("long")), adjacency).select("doc_id", "seq")
