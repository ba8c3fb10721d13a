"""Queries over the driver's tables and the same results in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions import text as X
from corvane.operators import postings as P, records, retrieval as R
from corvane.plans import documents, exchange, serving  # noqa: F401  they register their queries
from corvane.plans.base import QUERIES, SQL, Query, query as _query, table as _t
from corvane.sources import jsonl
from corvane.streaming import events as S

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_PLAIN = r"regexp_replace(coalesce(text, ''), '(?i)^(?:\s*(?:passage|query):){1,3}\s*', '')"
_TOKENS = f"list_filter(regexp_extract_all(lower({_PLAIN}), '{X.TOKEN}'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
_LETTERS = r"length(regexp_replace({0}, '[^\p{{L}}]', '', 'g'))"


@_query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_terms FROM documents")
def tokenize_bm25(spark, d):
    own = _t(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@_query(f"WITH p AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(*) AS df FROM p GROUP BY term")
def token_stats(spark, d):
    return P.postings(_t(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))


@_query(f"WITH t AS (SELECT item_id, {_TOKENS} AS ts FROM (SELECT item_id, 'query: ' || text || ' ' || text AS text FROM benchmark)) SELECT DISTINCT item_id, unnest(ts[1:20]) AS term FROM t")
def query_terms(spark, d):
    own = _t(spark, d, "benchmark").select("item_id", F.concat(F.lit("query: "), "text", F.lit(" "), "text").alias("text"))
    return P.query_terms(own, "item_id", "text")


@_query(f"SELECT doc_id, array_to_string(list_transform({_TOKENS}, lambda t: CASE t WHEN 'the' THEN 'a' WHEN 'les' THEN 'le' WHEN 'der' THEN 'die' ELSE t END), ' ') AS terms FROM documents")
def lemmas(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(X.tokens(F.col("text"), {"the": "a", "les": "le", "der": "die"}), " ").alias("terms"))


@_query("SELECT doc_id, CAST(CASE WHEN text IS NULL OR length(text) = 0 THEN 0 ELSE greatest(1, length(text) * 2 // 5) END AS BIGINT) AS n_est, substr(sha256(text), 1, 16) AS hash_id FROM documents")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("n_est"), X.short_hash(F.col("text")).alias("hash_id"))


@_query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^<>\n]{1,80}>', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ') AS plain FROM pages")
def strip_tags(spark, d):
    return _t(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("plain"))


@_query("SELECT item_id, repeat('pAssage:  ', greatest(0, (item_id % 5 - 3))::INT) || CASE WHEN item_id % 5 IN (0, 4) THEN ' ' ELSE '' END || ltrim(substr(text, 1, 40)) AS plain FROM benchmark")
def strip_prefix(spark, d):
    """None to four prefixes before each text: a fourth stays."""
    led = F.concat(F.repeat(F.lit("pAssage:  "), (F.col("item_id") % 5).cast("int")), F.lit(" "), F.ltrim(F.substring("text", 1, 40)))
    return _t(spark, d, "benchmark").select("item_id", X.strip_service_prefix(led).alias("plain"))


@_query(r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), '[^\p{L}\p{N}_\p{Z}\s+=*/()\[\]{}$<>,.;:!?%&|^~`"\\@#№°±≥≤≈×÷→←↑↓∈∑∫∂∇∞≠√∏∝∧∨¬⊂⊃⊆⊇∅∩∪\x{0400}-\x{04FF}\x27-]', '', 'g'), chr(10)), lambda x: trim(x, ' ')), chr(10)), '^\n+', ''), '\n+$', '') AS cleaned FROM documents""")
def clean_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


_L = _LETTERS.format("t")


@_query(f"WITH x AS (SELECT doc_id, trim(CASE doc_id % 5 WHEN 0 THEN substr(text, 1, 2) || ' = ' || doc_id WHEN 1 THEN substr(text, 1, doc_id::INT % 9) || '-' WHEN 2 THEN '-- ' || doc_id || ' --' WHEN 3 THEN substr(text, 1, 2) || ' ' || doc_id ELSE coalesce(text, '') END, ' ') AS t FROM documents) SELECT doc_id, (t = '') OR (length(t) <= 20 AND {_L} = 0) OR ({_L} < 3 AND NOT regexp_matches(t, '{X.MATH}')) OR (length(t) <= 8 AND ends_with(t, '-') AND {_L} <= 6) AS noise FROM x")
def noise_filter(spark, d):
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    text = F.when(k % 5 == 0, F.concat(F.substring("text", 1, 2), F.lit(" = "), n)).when(k % 5 == 1, F.concat(F.col("text").substr(F.lit(1), (k % 9).cast("int")), F.lit("-"))).when(k % 5 == 2, F.concat(F.lit("-- "), n, F.lit(" --"))).when(k % 5 == 3, F.concat(F.substring("text", 1, 2), F.lit(" "), n)).otherwise(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", X.is_noise(text).alias("noise"))


@_query(rf"""
WITH lines AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '\s+'), lambda x: {_LETTERS.format('x')} > 0) AS ws FROM lines),
m AS (SELECT doc_id, t, len(ws) AS n, len(list_filter(ws, lambda x: length(x) <= 2)) / nullif(len(ws), 0)::DOUBLE AS short, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) / nullif(len(ws), 0)::DOUBLE AS av,
  length(regexp_replace(lower(t), '[^аеёиоуыэюяaeiouy]', '', 'g')) / nullif({_LETTERS.format('t')}, 0)::DOUBLE AS vow, {_LETTERS.format('t')} AS l FROM w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT starts_with(t, '|') AND l >= 12 AND n >= 6 AND coalesce((short >= 0.55 AND av <= 3.2) OR (av <= 2.6 AND vow < 0.30), false)) AS n_garbage FROM m GROUP BY doc_id""")
def garbage_lines(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(X.is_garbage_line(F.col("line"))).alias("n_garbage"))


def _chunks(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit("text").alias("chunk_type"), "source", (F.col("doc_id") + 1).alias("page"), F.col("lang").alias("facet"), F.lit("").alias("heading"), F.col("doc_id").alias("ord"))


@_query("""
WITH k AS (SELECT doc_id, source, doc_id + 1 AS page, substr(sha256(substr(lower(text), 1, 2000) || '|text'), 1, 16) AS dedup_key, length(text) + 500 + 300 AS quality FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY quality DESC, doc_id) AS rn, min(doc_id) OVER (PARTITION BY dedup_key) AS first_ord, count(*) OVER (PARTITION BY dedup_key) AS copies FROM k)
SELECT dedup_key, doc_id AS chunk_id, CAST(quality AS BIGINT) AS quality, first_ord, copies, CAST(copies - 1 AS BIGINT) AS n_also FROM r WHERE rn = 1""")
def dedup_best(spark, d):
    return records.best_of_group(_chunks(spark, d)).select("dedup_key", "chunk_id", F.col("quality").cast("long").alias("quality"), "first_ord", "copies", F.size("also_from").cast("long").alias("n_also"))


@_query("SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS seq FROM documents")
def chunk_seq(spark, d):
    return records.sequence_in_source(_chunks(spark, d)).select(F.col("chunk_id").alias("doc_id"), "source", F.col("seq").cast("long").alias("seq"))


@_query("SELECT event_id, user_id, coalesce(last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'unknown') AS facet FROM events")
def sticky_facet(spark, d):
    own = _t(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") > 50, F.col("event_type")).alias("facet"))
    return records.forward_fill(own, "facet", "user_id", "event_id", "unknown").select("event_id", "user_id", F.col("facet_filled").alias("facet"))


@_query("WITH c AS (SELECT event_id, user_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS ch FROM events) SELECT event_id, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM c")
def scope_segments(spark, d):
    return records.segments(_t(spark, d, "events"), "user_id", "event_id", ["event_type"]).select("event_id", F.col("segment").cast("long").alias("segment"))


def _queries_of(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_BM25 = f"""
q AS (SELECT DISTINCT item_id AS query_id, unnest(({_TOKENS})[1:20]) AS term FROM benchmark),
s AS (SELECT doc_id AS chunk_id, {_TOKENS} AS ts FROM documents), l AS (SELECT chunk_id, len(ts) AS dl, ts FROM s WHERE len(ts) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, dl, unnest(ts) AS term FROM l) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT query_id, chunk_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY query_id, chunk_id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10)"""


def _lexical(spark, d) -> P.LexicalIndex:
    """Index of the documents: written once a session, searched by several queries."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return P.index_of(spark, docs, f"{d}/documents.parquet")


@_query(f"WITH {_BM25} SELECT term, df FROM f")
def index_build(spark, d):
    """The stored index: its terms."""
    return _lexical(spark, d).table("terms")


@_query(f"WITH {_BM25} SELECT query_id, chunk_id, rank FROM lex")
def bm25_topk(spark, d):
    return _lexical(spark, d).search(_queries_of(spark, d)).select("query_id", "chunk_id", "rank")


_SQ = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6)"
_VEC = f"vec AS (SELECT q.vec_id // 50 AS query_id, e.vec_id AS chunk_id, {_SQ} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SQ}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 18)"


def _vector_leg(spark, d, metric="l2") -> DataFrame:
    own = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return R.vector_topk(own, own.where("chunk_id % 50 = 0").select(F.expr("chunk_id DIV 50").alias("query_id"), F.col("embedding").alias("query_embedding")), metric=metric)


@_query(f"WITH {_VEC} SELECT query_id, chunk_id, rank FROM vec")
def vector_topk_l2(spark, d):
    return _vector_leg(spark, d).select("query_id", "chunk_id", "rank")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COS = f"round({_DOT.format('e.embedding', 'q.embedding')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})), 6)"


@_query(f"SELECT vec_id // 50 AS query_id, chunk_id, rank FROM (SELECT q.vec_id, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SQ}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= vec_id // 50 % 7")
def vector_topk_sized(spark, d):
    """Each query wants a number of results of its own, some none."""
    own = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = own.where("chunk_id % 50 = 0").select(F.expr("chunk_id DIV 50").alias("query_id"), F.col("embedding").alias("query_embedding"), F.expr("chunk_id DIV 50 % 7").alias("k"))
    return R.vector_topk(own, asked).select("query_id", "chunk_id", "rank")


@_query(f"SELECT q.vec_id // 50 AS query_id, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 18")
def vector_topk_cosine(spark, d):
    return _vector_leg(spark, d, "cosine").select("query_id", "chunk_id", "rank")


_FUSED = f"""{_BM25}, {_VEC},
parts2 AS (SELECT query_id, chunk_id, rank AS vr, NULL AS lr, 0.6::DOUBLE / (60 + rank) AS part FROM vec UNION ALL SELECT query_id, chunk_id, NULL, rank, (1 - 0.6::DOUBLE) / (60 + rank) FROM lex),
fused AS (SELECT query_id, chunk_id, round(sum(part), 9) AS score, min(vr) AS vr, min(lr) AS lr FROM parts2 GROUP BY query_id, chunk_id)"""


def _fused(spark, d) -> DataFrame:
    return R.fuse(_vector_leg(spark, d), _lexical(spark, d).search(_queries_of(spark, d)))


@_query(f"WITH {_FUSED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, lr NULLS LAST, chunk_id) AS rank FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", "rank")


@_query(f"""WITH {_FUSED}, ok AS (SELECT * FROM fused WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT query_id, chunk_id, rank, source, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, lr NULLS LAST, chunk_id) AS rank FROM ok QUALIFY rank <= 6) r LEFT JOIN documents ON doc_id = chunk_id""")
def hybrid_search(spark, d):
    bad = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    left = R.without_quarantined(_fused(spark, d), bad).withColumnRenamed("rank", "place")
    top = R.ranked(left, [F.col("place")], R.FINAL_K)
    store = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.length("text").cast("long").alias("n_chars"))
    return top.join(store, "chunk_id", "left").select("query_id", "chunk_id", "rank", "source", "n_chars")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def quarantine_filter(spark, d):
    return R.without_quarantined(_chunks(spark, d), _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))).select(F.col("chunk_id").alias("doc_id"))


@_query("""WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, CASE WHEN l_returnflag = 'A' THEN 'unknown' ELSE l_returnflag END AS facet, CASE WHEN l_linestatus = 'O' THEN 'legal' ELSE 'manual' END AS category FROM lineitem),
b AS (SELECT *, CASE WHEN facet = 'N' THEN 0 WHEN category IN ('legal', 'procedure') THEN 1 WHEN facet = 'unknown' THEN 2 END AS bucket FROM r), e AS (SELECT *, count(*) FILTER (bucket = 0) OVER (PARTITION BY query_id) AS exact FROM b WHERE bucket IS NOT NULL)
SELECT query_id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bucket, rank) AS INT) AS position FROM e WHERE NOT (bucket = 2 AND exact >= 2)""")
def facet_policy_strict(spark, d):
    own = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.when(F.col("l_returnflag") == "A", "unknown").otherwise(F.col("l_returnflag")).alias("facet"), F.lit("N").alias("wanted"), F.when(F.col("l_linestatus") == "O", "legal").otherwise("manual").alias("category"))
    return R.facet_policy(own).select("query_id", "rank", "position")


def _near_sql(window: int, longest: int) -> str:
    """Texts with those beside them in their source, by joins on the running number."""
    sides = [k for k in range(-window, window + 1) if k]
    joins = " ".join(f"LEFT JOIN c t{n} ON c.kind = 'text' AND t{n}.kind = 'text' AND t{n}.source = c.source AND t{n}.seq = c.seq + ({k})" for n, k in enumerate(sides))
    order = [f"t{n}.text" if k else "c.text" for n, k in [*enumerate(sides[:window]), (None, 0), *((n + window, k) for n, k in enumerate(sides[window:]))]]
    return f"""WITH c AS (SELECT doc_id, source, text, CASE WHEN doc_id % 7 = 0 THEN 'table' ELSE 'text' END AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq FROM documents),
j AS (SELECT c.doc_id, c.text, coalesce({', '.join(f't{n}.text' for n in range(len(sides)))}) IS NOT NULL AS met, trim(array_to_string(list_filter([{', '.join(order)}], lambda x: x IS NOT NULL), chr(10)), ' ') AS s FROM c {joins})
SELECT doc_id, met AND s <> text AS context_expanded, sha256(CASE WHEN met AND s <> text THEN CASE WHEN length(s) > {longest} THEN regexp_replace(substr(s, 1, {longest}), ' [^ ]*$', '') || '…' ELSE s END ELSE text END) AS digest FROM j"""


def _near(spark, d, window: int, longest: int) -> DataFrame:
    own = records.sequence_in_source(_chunks(spark, d)).withColumn("chunk_type", F.when(F.col("chunk_id") % 7 == 0, "table").otherwise("text"))
    return R.neighbours(own, own, window, longest).select(F.col("chunk_id").alias("doc_id"), "context_expanded", F.sha2("content", 256).alias("digest"))


@_query(_near_sql(1, 2400))
def neighbors(spark, d):
    return _near(spark, d, 1, 2400)


@_query(_near_sql(2, 900))
def expand_context(spark, d):
    return _near(spark, d, 2, 900)


@_query(f"WITH {_VEC}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM vec) SELECT query_id, chunk_id, CAST(CASE WHEN n <= 2 THEN rank WHEN rank <= ceil(n / 2.0) THEN 2 * rank - 1 ELSE 2 * (n - rank + 1) END AS BIGINT) AS position FROM n")
def u_shape(spark, d):
    return R.u_shape(_vector_leg(spark, d)).select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))


_MANIFESTS = """o AS (SELECT c_custkey AS key, sha256(c_name || c_mktsegment) AS sha FROM customer WHERE c_nationkey <> 3), n AS (SELECT c_custkey AS key, sha256(c_name || CASE WHEN c_acctbal < 0 THEN 'x' ELSE c_mktsegment END) AS sha FROM customer WHERE c_nationkey <> 7),
m AS (SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'removed' WHEN o.key IS NULL THEN 'new' WHEN o.sha <> n.sha THEN 'changed' ELSE 'same' END AS status FROM o FULL JOIN n ON o.key = n.key)"""


def _manifests(spark, d):
    own = _t(spark, d, "customer")
    old = own.where("c_nationkey <> 3").select(F.col("c_custkey").alias("key"), F.sha2(F.concat("c_name", "c_mktsegment"), 256).alias("sha"))
    new = own.where("c_nationkey <> 7").select(F.col("c_custkey").alias("key"), F.sha2(F.concat("c_name", F.when(F.col("c_acctbal") < 0, "x").otherwise(F.col("c_mktsegment"))), 256).alias("sha"))
    return old, new


@_query(f"WITH {_MANIFESTS} SELECT key, status FROM m")
def manifest_diff(spark, d):
    return records.manifest_diff(*_manifests(spark, d))


@_query(f"WITH {_MANIFESTS} SELECT key, status, CASE WHEN status = 'removed' THEN 'drop' WHEN status = 'new' OR (SELECT count(*) FROM m WHERE status IN ('removed', 'changed')) > 0 THEN 'read' ELSE 'keep' END AS action FROM m")
def ingest_plan(spark, d):
    return records.ingest_plan(*_manifests(spark, d))


@_query(r"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(a.text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(u.text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')) AS y
  FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'), s AS (SELECT *, len(list_intersect(x, y)) AS both_n FROM p)
SELECT conv_id, turn, CASE WHEN both_n > 0 THEN round(2 * (both_n / len(x)::DOUBLE) * (both_n / len(y)::DOUBLE) / (both_n / len(x)::DOUBLE + both_n / len(y)::DOUBLE), 3) ELSE 0.0 END AS token_f1 FROM s""")
def eval_token_f1(spark, d):
    own = _t(spark, d, "conversations")
    a, u = own.where("role = 'assistant'"), own.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return records.token_f1(a.join(u, ["conv_id", "turn"]), "text", "reference").select("conv_id", "turn", "token_f1")


@_query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2 DESC, turn DESC) AS back FROM conversations QUALIFY back <= 5) SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY back DESC) AS nth FROM r")
def history_last5(spark, d):
    """Two turns share a time; their order decides."""
    own = _t(spark, d, "conversations").select(F.col("conv_id").alias("user_id"), F.expr("turn DIV 2").alias("t"), "turn", "role", F.col("text").alias("content"))
    return records.history(own).select(F.col("user_id").alias("conv_id"), "turn", "role", F.col("nth").cast("long").alias("nth"))


@_query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS event_id FROM events GROUP BY ALL")
def event_dedup_batch(spark, d):
    return _t(spark, d, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("event_id").alias("event_id"))


def _timed(spark, d):
    own = _t(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), "event_id")
    return own.select("key", "event_id", (F.col("us") / 1e6).alias("t"))


def _admitted_sql(name: str, rows: str, limit: int, window: int) -> str:
    """Limiter as a recursion over the running number of each key's events: the state is the list of admitted times."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS n FROM {rows}),
{name} AS (SELECT key, event_id, t, n, true AS admitted, [t] AS live FROM {name}_n WHERE n = 1 UNION ALL
  SELECT x.key, x.event_id, x.t, x.n, len(list_filter(p.live, lambda v: x.t - v <= {window})) < {limit}, CASE WHEN len(list_filter(p.live, lambda v: x.t - v <= {window})) < {limit} THEN list_append(list_filter(p.live, lambda v: x.t - v <= {window}), x.t) ELSE list_filter(p.live, lambda v: x.t - v <= {window}) END
  FROM {name} p JOIN {name}_n x ON x.key = p.key AND x.n = p.n + 1)"""


_EVENTS = "e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6::DOUBLE AS t FROM events)"
_BY_USER = f"WITH RECURSIVE {_EVENTS}, {_admitted_sql('a', 'e', 3, 86400)} SELECT key, event_id, admitted FROM a"


@_query(_BY_USER)
def rate_limit_user(spark, d):
    return records.admitted(_timed(spark, d), 3, 86400)


@_query(f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT 0 AS key, event_id, t FROM e), {_admitted_sql('f', 'o', 20, 86400)}, p AS (SELECT e.* FROM e JOIN f USING (event_id) WHERE f.admitted), {_admitted_sql('g', 'p', 2, 86400)}
SELECT e.key, e.event_id, CASE WHEN NOT f.admitted THEN 'overall' WHEN g.admitted THEN 'admitted' ELSE 'key' END AS verdict FROM e JOIN f USING (event_id) LEFT JOIN g ON g.event_id = e.event_id""")
def rate_limit_two_level(spark, d):
    return records.admitted_two_level(_timed(spark, d), 2, 20, 86400)


@_query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return S.drained(S.deduplicated(S.stream_of(spark, f"{d}/events.parquet"), ["user_id", "event_type"]).select("user_id", "event_type"))


@_query("""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER w AS n, array_to_string(list(role || ':' || length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' ') AS held FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, least(n, 5) AS n_held, held FROM m""")
def stream_memory(spark, d):
    own = S.table_stream(spark, f"{d}/conversations.parquet")
    told = own.select(F.col("conv_id").alias("key"), F.col("turn").cast("double").alias("t"), F.col("turn").alias("event_id"), F.lit("add").alias("op"), "role", F.col("text").alias("content"))
    out = S.drained(S.conversations(told))
    shown = F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), F.length(h["content"]).cast("string")))
    return out.select(F.col("key").alias("conv_id"), F.col("event_id").alias("turn"), F.size("history").cast("long").alias("n_held"), F.array_join(shown, " ").alias("held"))


@_query("SELECT event_id, substr(sha256(event_type || ' ' || user_id), 1, 16) AS query_hash, strftime(ts, '%Y%m%d') AS log_date, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM events")
def query_log(spark, d):
    own = S.stream_of(spark, f"{d}/events.parquet").select("event_id", "ts", F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("query"))
    return S.drained(S.log_entries(own), partition="log_date").select("event_id", "query_hash", "log_date", "timestamp")


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@_query(f"WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 1 DAY <= {_CLOSED}")
def stream_tumbling(spark, d):
    return S.drained(S.tumbling(S.stream_of(spark, f"{d}/events.parquet"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@_query(f"WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP - to_hours(12 * k) + to_hours(CASE WHEN hour(ts) >= 12 THEN 12 ELSE 0 END) AS start, event_type FROM events, (VALUES (0), (1)) v(k)) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 1 DAY <= {_CLOSED}")
def stream_sliding(spark, d):
    return S.drained(S.sliding(S.stream_of(spark, f"{d}/events.parquet"), "1 day", "12 hours")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@_query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}""")
def stream_session(spark, d):
    return S.drained(S.sessions(S.stream_of(spark, f"{d}/events.parquet"), "6 hours")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@_query(_BY_USER)
def stream_rate_limit(spark, d):
    own = S.stream_of(spark, f"{d}/events.parquet").select(F.col("user_id").alias("key"), (F.unix_micros("ts") / F.lit(1e6)).alias("t"), "event_id")
    return S.drained(S.limited(own, 3, 86400))


@_query("""WITH o AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'set' WHEN 1 THEN 'ask' ELSE 'pop' END AS op FROM events)
SELECT user_id AS key, event_id, last_value(CASE WHEN op = 'set' THEN event_type END IGNORE NULLS) OVER w AS preference,
CASE WHEN op = 'pop' THEN nullif(last_value(CASE op WHEN 'ask' THEN event_type WHEN 'pop' THEN '' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS popped
FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def stream_prefs(spark, d):
    own = S.stream_of(spark, f"{d}/events.parquet")
    op = F.when(F.col("event_id") % 3 == 0, "set").when(F.col("event_id") % 3 == 1, "ask").otherwise("pop")
    return S.drained(S.preferences(own.select(F.col("user_id").alias("key"), (F.unix_micros("ts") / F.lit(1e6)).alias("t"), "event_id", op.alias("op"), F.col("event_type").alias("value"))))


@_query("SELECT strftime(ts, '%Y%m%d') AS log_date, count(*) AS n FROM events GROUP BY ALL")
def log_rotation(spark, d):
    return S.drained(S.dated(S.stream_of(spark, f"{d}/events.parquet")), partition="log_date").groupBy("log_date").agg(F.count("*").alias("n"))


@_query("SELECT event_id, json_valid(props) AS valid FROM events")
def jsonl_validate(spark, d):
    return jsonl.valid_lines(_t(spark, d, "events").select("event_id", F.col("props").alias("value"))).select("event_id", "valid")


@_query("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS line_no, '{"turn":' || turn || ',"role":"' || role || '"}' AS j FROM conversations),
x AS (SELECT *, turn % 5 AS k, unnest(CASE WHEN turn % 5 = 3 THEN [j, j] ELSE [j] END) AS v FROM p)
SELECT CAST(conv_id AS VARCHAR) AS path, line_no, CASE k WHEN 0 THEN 'ok' WHEN 3 THEN 'split' WHEN 4 THEN 'unrecoverable' ELSE 'repaired' END AS status, CASE WHEN k = 4 THEN 'no object' ELSE v END AS value FROM x""")
def jsonl_repair(spark, d):
    """Lines that are whole, with junk in front, without their opening brace, with two objects, with none."""
    line, k = F.to_json(F.struct("turn", "role")), F.col("turn") % 5
    torn = F.when(k == 1, F.concat(F.lit("junk "), line)).when(k == 2, F.concat(F.lit("?"), F.substring(line, 2, 10_000))).when(k == 3, F.concat(line, line)).when(k == 4, "no object").otherwise(line)
    files = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", torn.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return jsonl.repaired(files.select(F.col("conv_id").cast("string").alias("path"), "text"))


@_query("""WITH l AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN substr(props, 2) WHEN 2 THEN '[' || event_id || ']' ELSE '' END AS value FROM events),
f AS (SELECT *, CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE false END AS valid FROM l WHERE trim(value, ' ') <> ''), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, valid ORDER BY event_id) AS n FROM f)
SELECT user_id, count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, coalesce(string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) FILTER (NOT valid AND n <= 50), '') AS invalid_lines FROM b GROUP BY user_id""")
def jsonl_report(spark, d):
    k = F.col("event_id") % 4
    value = F.when(k == 0, F.col("props")).when(k == 1, F.substring("props", 2, 10_000)).when(k == 2, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).otherwise("")
    own = _t(spark, d, "events").select("user_id", F.col("event_id").alias("line_no"), value.alias("value"))
    return jsonl.validation(own, ["user_id"]).withColumn("invalid_lines", F.array_join(F.col("invalid_lines").cast("array<string>"), " "))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
