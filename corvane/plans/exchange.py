"""Queries over stores, records, messages, models and paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from corvane.functions import chat, paths, rules as L, text as X
from corvane.operators import answering, bundle, chunking, indexes, rebuild, records, serving as V
from corvane.operators.postings import LexicalIndex
from corvane.plans.base import query, table
from corvane.sources import files, jsonl, pages
from corvane.storage import settle, work_folder


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# stores

_NAMES = "CASE p_partkey % 7 WHEN 0 THEN 'chunks_' || p_size || '.TXT' WHEN 1 THEN 'Chunks_export_new' || p_size || '.jsonl' WHEN 2 THEN 'docstore.' || p_size || '.jsonl' WHEN 3 THEN 'bm25' || p_size || '.txt' WHEN 4 THEN 'chunks' || p_size || '.csv' WHEN 5 THEN 'my_chunks.txt' ELSE p_name END"


@query(f"""WITH n AS (SELECT p_partkey, {_NAMES} AS n FROM part), k AS (SELECT p_partkey, CASE WHEN regexp_matches(n, '(?i)^chunks_export_new.*\\.(txt|jsonl)$') THEN 'chunks_new' WHEN regexp_matches(n, '(?i)^chunks.*\\.(txt|jsonl)$') THEN 'chunks' WHEN regexp_matches(n, '(?i)^docstore.*\\.(txt|jsonl)$') THEN 'docstore' WHEN regexp_matches(n, '(?i)^bm25.*\\.(txt|jsonl)$') THEN 'bm25' ELSE 'unknown' END AS kind FROM n)
SELECT p_partkey, kind, list_position(['docstore', 'chunks', 'chunks_new', 'bm25'], kind) IS NOT NULL AS known, coalesce(list_position(['docstore', 'chunks', 'chunks_new', 'bm25'], kind), 0)::INT AS priority FROM k""")
def artifact_kinds(spark, d):
    k, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat(F.lit("chunks_"), size, F.lit(".TXT"))).when(k == 1, F.concat(F.lit("Chunks_export_new"), size, F.lit(".jsonl"))).when(k == 2, F.concat(F.lit("docstore."), size, F.lit(".jsonl"))).when(k == 3, F.concat(F.lit("bm25"), size, F.lit(".txt"))).when(k == 4, F.concat(F.lit("chunks"), size, F.lit(".csv"))).when(k == 5, "my_chunks.txt").otherwise(F.col("p_name"))
    kind = files.artifact_kind(name, exports=True)
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), (kind != "unknown").alias("known"), files.artifact_priority(kind, True).alias("priority"))


@query("SELECT event_id, event_id % 6 IN (0, 1) AS artifact FROM events")
def artifact_guard(spark, d):
    """Files that begin with a record, with a vector beside content, with other objects, with text, with a broken record, with six blank lines."""
    k, props = F.col("event_id") % 6, F.col("props")
    record = F.to_json(F.struct(F.col("event_id").alias("chunk_id"), F.col("event_type").alias("content"), F.struct("user_id").alias("metadata")))
    vector = F.to_json(F.struct(F.array(F.col("value")).alias("embedding"), F.col("event_type").alias("content")))
    text = F.when(k == 0, F.concat(F.lit("\n  "), record)).when(k == 1, vector).when(k == 2, props).when(k == 3, F.concat(F.lit("text\n"), record)).when(k == 4, F.substring(record, 1, 20)).otherwise(F.concat(F.lit("\n\n\n\n\n\n"), record))
    return table(spark, d, "events").select("event_id", files.is_artifact(text).alias("artifact"))


def _chunks(spark, d) -> DataFrame:
    own = table(spark, d, "part")
    return own.select(F.col("p_partkey").cast("string").alias("chunk_id"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).otherwise("  ").alias("content"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("full_content"), F.when(F.col("p_size") % 3 == 0, "table").otherwise("text").alias("chunk_type"), F.col("p_brand").alias("source"), F.col("p_size").cast("long").alias("page"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey")).alias("seq"), F.lit(None).cast("string").alias("model"))


_PARTS = "c AS (SELECT p_partkey::VARCHAR AS chunk_id, CASE WHEN p_size % 5 > 0 THEN p_name ELSE '  ' END AS content, CASE WHEN p_size % 3 = 0 THEN p_type END AS full_content, CASE WHEN p_size % 3 = 0 THEN 'table' ELSE 'text' END AS chunk_type, p_brand AS source, p_size AS page, CASE WHEN p_partkey % 4 > 0 THEN p_partkey END AS seq, p_partkey FROM part)"


def _upserted(spark, d) -> DataFrame:
    own = _chunks(spark, d)
    old = own.where("chunk_id % 3 = 0").withColumn("content", F.lit("old")).withColumn("full_content", F.lit(None).cast("string"))
    return indexes.upserted(old, own.where("chunk_id % 2 = 0"))


@query(f"WITH {_PARTS}, n AS (SELECT * FROM c WHERE p_partkey % 2 = 0 AND trim(coalesce(nullif(full_content, ''), content), ' ') <> '') SELECT chunk_id, content FROM n UNION ALL SELECT chunk_id, 'old' FROM c WHERE p_partkey % 3 = 0 AND chunk_id NOT IN (SELECT chunk_id FROM n)")
def store_upsert(spark, d):
    return _upserted(spark, d).select("chunk_id", "content")


@query(f"WITH {_PARTS} SELECT source, seq, chunk_id, page::BIGINT AS page, 'unknown' AS model FROM c WHERE seq IS NOT NULL")
def adjacency_rows(spark, d):
    return indexes.adjacency(_chunks(spark, d)).select("source", "seq", "chunk_id", "page", "model")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'new ' || source ELSE lang || ' ' || source END), '[а-яёa-z0-9]+'), lambda t: length(t) > 1)) AS term FROM documents),
o AS (SELECT doc_id, unnest([lang, source]) AS term FROM documents WHERE doc_id % 3 = 0) SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT * FROM t UNION ALL SELECT * FROM o) GROUP BY term""")
def lexical_upsert(spark, d):
    """An index of language and source, of which a third is put in again with other texts, and a third with empty ones, which take nobody's place."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "lang", "source").alias("content"), "source")
    index = LexicalIndex(spark, f"{work_folder(spark)}/upsert-{uuid.uuid4().hex}").write(docs)
    new = docs.where("chunk_id % 3 < 2").select("chunk_id", F.when(F.col("chunk_id") % 3 == 1, F.concat(F.lit("new "), "source")).otherwise("").alias("content"))
    return index.upsert(new).table("terms")


@query("SELECT label % 3 = 0 AS is_text, count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS first FROM embeddings GROUP BY 1")
def vector_store(spark, d):
    """Vectors written twice, the second time some of them again, and read from their two folders."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 3 == 0, "text").otherwise("table").alias("chunk_type"), "embedding")
    path = f"{work_folder(spark)}/vectors-{uuid.uuid4().hex}"
    indexes.write_vectors(spark, path, own.withColumn("embedding", F.transform("embedding", lambda x: F.lit(9.0))).where("chunk_id % 2 = 0"))
    indexes.write_vectors(spark, path, own)
    both = indexes.read_vectors(spark, path, True).unionByName(indexes.read_vectors(spark, path, False))
    return both.groupBy("is_text").agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("first"))


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'meta' WHEN p_partkey % 3 = 1 THEN p_type ELSE 'text' END AS chunk_type, count(*) AS n FROM part GROUP BY 1")
def store_read(spark, d):
    k = F.col("p_partkey") % 3
    path = f"{work_folder(spark)}/store-{uuid.uuid4().hex}"
    table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.when(k == 1, F.col("p_type")).when(k == 0, "").alias("chunk_type"), F.when(k == 0, '{"chunk_type":"meta"}').otherwise("{}").alias("metadata")).write.parquet(path)
    return indexes.read_store(spark, path).groupBy("chunk_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal < 0 AS poor FROM customer")
def jsonl_write(spark, d):
    path = f"{work_folder(spark)}/lines-{uuid.uuid4().hex}"
    own = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") < 0).alias("poor"))
    if jsonl.write_lines(own, path) != own.count():
        raise ValueError("rows were lost")
    return spark.read.schema(own.schema).json(path)


@query("SELECT l_shipmode_key AS chunk_type, n FROM (SELECT l_returnflag AS l_shipmode_key, count(*) AS n FROM lineitem GROUP BY 1)")
def counts_by(spark, d):
    own = indexes.counts_by(table(spark, d, "lineitem").withColumn("chunk_type", F.col("l_returnflag")), "chunk_type")
    return own.select(F.explode("by_chunk_type").alias("chunk_type", "n"))


@query("""WITH f AS (SELECT p_name || p_partkey AS path, p_size AS size, sha256(p_type) AS sha FROM part WHERE p_partkey <= 200)
SELECT '{"version":"7","created_at":"2024-02-15T12:00:00Z","embedding":{"model":"m","prefix":"p"},"counts":{"n":' || count(*) || ',"bytes":' || sum(size) || '},"files":{' || string_agg('"' || path || '":{"size":' || size || ',"sha256":"' || sha || '"}', ',' ORDER BY path) || '}}' AS json FROM f""")
def bundle_manifest(spark, d):
    own = table(spark, d, "part").where("p_partkey <= 200").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("size"), F.sha2("p_type", 256).alias("sha256"))
    counts = own.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return bundle.manifest(own, {"prefix": "p", "model": "m"}, counts, "7", F.expr("TIMESTAMP '2024-02-15 12:00:00 UTC'")).select("json")


# records

#: Contents of records by kind of chunk, plain enough that cleaning changes nothing.
_MARKED = "CASE p_partkey % 6 WHEN 0 THEN 'passage: ' || p_type WHEN 1 THEN '| name | type |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_type || ' |' WHEN 2 THEN 'F = ' || p_size || ' * 9' WHEN 3 THEN p_type || ' 95% of ' || p_size WHEN 4 THEN '12-' || p_size ELSE '| abc |' END"
_DECLARED = "CASE p_partkey % 6 WHEN 1 THEN 'table' WHEN 2 THEN 'formula' WHEN 3 THEN 'Formula' WHEN 5 THEN 'table' WHEN 4 THEN 'odd' END"


def _record_rows(spark, d) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    content = F.when(k == 0, F.concat(F.lit("passage: "), "p_type")).when(k == 1, F.concat(F.lit("| name | type |\n| --- | --- |\n| "), "p_name", F.lit(" | "), "p_type", F.lit(" |"))).when(k == 2, F.concat(F.lit("F = "), size, F.lit(" * 9"))).when(k == 3, F.concat("p_type", F.lit(" 95% of "), size)).when(k == 4, F.concat(F.lit("12-"), size)).otherwise("| abc |")
    declared = F.when(k == 1, "table").when(k == 2, "formula").when(k == 3, "Formula").when(k == 5, "table").when(k == 4, "odd")
    meta = F.struct(F.when(F.col("p_size") % 4 > 0, F.concat("p_brand", F.lit(".pdf"))).alias("source"), F.when(F.col("p_size") % 3 > 0, size).alias("page"), F.when(F.col("p_size") % 5 == 0, "weak one").when(F.col("p_size") % 5 == 1, "A").alias("model"))
    own = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(content.alias("content"), declared.alias("chunk_type"), meta.alias("metadata"))).alias("value"), F.lit("f.jsonl").alias("file"), F.when(F.col("p_size") % 4 == 0, "chunks_new").otherwise("docstore").alias("kind"))
    return own


#: Facets of the records: words of the part types.
STRONG: L.Rules = (("A", (r"\bstandard\b",)),)
WEAK: L.Rules = (("A", (r"\bplated\b",)), ("B", (r"\bbrushed\b", r"\bsteel\b", r"\btin\b")))
_CLEAN = f"clean AS (SELECT p_partkey, p_size, p_brand, p_type, p_partkey % 6 AS k, regexp_replace({_MARKED}, '^passage: ', '') AS t, lower(coalesce({_DECLARED}, 'text')) AS declared, CASE WHEN p_size % 4 = 0 THEN 'chunks_new' ELSE 'docstore' END AS kind, CASE WHEN p_size % 4 > 0 THEN p_brand || '.pdf' ELSE '' END AS source, CASE WHEN p_size % 3 > 0 THEN p_size ELSE 0 END AS page, CASE p_size % 5 WHEN 0 THEN 'weak one' WHEN 1 THEN 'A' ELSE 'unknown' END AS raw_model, p_partkey % 6 = 1 AND 8 + length(p_name) + length(p_type) >= 30 AS useful FROM part)"
_SIGNS = "(regexp_matches(t, '(?i)(^|[^a-z])standard([^a-z]|$)'))::INT AS s, (regexp_matches(t, '(?i)(^|[^a-z])plated([^a-z]|$)'))::INT AS wa, (regexp_matches(t, '(?i)(^|[^a-z])brushed([^a-z]|$)'))::INT + (regexp_matches(t, '(?i)(^|[^a-z])steel([^a-z]|$)'))::INT + (regexp_matches(t, '(?i)(^|[^a-z])tin([^a-z]|$)'))::INT AS wb"
_FOUND = "CASE WHEN length(t) < 5 THEN 'unknown' WHEN s > 0 THEN 'A' WHEN wa >= wb AND wa > 0 THEN 'A' WHEN wb > 0 THEN 'B' ELSE 'unknown' END"


@query(f"""WITH {_CLEAN}, m AS (SELECT *, {_SIGNS} FROM clean), r AS (SELECT *, CASE WHEN raw_model = 'A' THEN 'A' ELSE {_FOUND} END AS model FROM m)
SELECT p_partkey, CASE WHEN k = 4 THEN 'noise' WHEN k = 5 THEN NULL END AS dropped, CASE WHEN useful THEN 'table' WHEN k = 2 THEN 'formula' ELSE 'text' END AS chunk_type, k = 3 AS reclassified, k = 5 OR (k = 1 AND NOT useful) AS downgraded, k = 0 AS fixed_prefix, page = 0 AS page_zero, p_size % 4 = 0 AND page = 0 AS no_citation, model, model <> raw_model AS fixed_model FROM r""")
def record_repair(spark, d):
    """Records with a prefix, a table, a formula, a false formula, noise, a table without cells."""
    own = rebuild.repaired(_record_rows(spark, d), STRONG, WEAK)
    return own.select("p_partkey", "dropped", "chunk_type", "reclassified", "downgraded", "fixed_prefix", "page_zero", "no_citation", "model", "fixed_model")


@query(f"""WITH {_CLEAN}, m AS (SELECT *, {_SIGNS} FROM clean)
SELECT p_partkey, CASE WHEN k = 4 THEN 'noise' END AS dropped, CASE WHEN kind = 'chunks_new' THEN 'text' WHEN useful THEN 'table' WHEN k = 2 THEN 'formula' ELSE 'text' END AS chunk_type, CASE WHEN kind = 'chunks_new' THEN 0 WHEN k IN (3, 4, 5) OR (k = 1 AND NOT useful) THEN 1 ELSE 0 END AS reclassified, CASE WHEN source = '' THEN 'f.jsonl' ELSE source END AS source, CASE WHEN raw_model <> 'unknown' THEN raw_model ELSE {_FOUND} END AS model FROM m""")
def record_import(spark, d):
    own = rebuild.imported(_record_rows(spark, d), STRONG, WEAK)
    return own.select("p_partkey", "dropped", "chunk_type", "reclassified", "source", "model")


def _rebuilt(spark, d) -> DataFrame:
    own = rebuild.repaired(_record_rows(spark, d), STRONG, WEAK)
    return rebuild.deduplicated(own.withColumn("file_no", F.lit(1)).withColumn("line_no", F.col("p_partkey")), rebuild.place_of())


_KEPT = f"""{_CLEAN}, m AS (SELECT *, {_SIGNS} FROM clean WHERE k <> 4), r AS (SELECT *, CASE WHEN raw_model = 'A' THEN 'A' ELSE {_FOUND} END AS model, CASE WHEN useful THEN 'table' WHEN k = 2 THEN 'formula' ELSE 'text' END AS kind2, CASE WHEN useful THEN length('Таблица (1 строк, 2 столбцов). Столбцы: name, type. Пример данных: ') + length(t) - length('| name | type |' || chr(10) || '| --- | --- |' || chr(10)) - 4 WHEN k = 2 THEN length('Формула: ' || t) ELSE length(t) END AS n FROM m),
q AS (SELECT *, n + CASE WHEN kind2 <> 'text' THEN 200 ELSE 0 END + CASE WHEN page > 0 THEN 500 ELSE 0 END + CASE WHEN model <> 'unknown' THEN 300 ELSE 0 END AS quality, CASE kind WHEN 'docstore' THEN 1 ELSE 3 END AS by_kind FROM r),
best AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY lower(t), kind2) AS copies FROM q WINDOW w AS (PARTITION BY lower(t), kind2 ORDER BY quality DESC, by_kind, p_partkey))"""


@query(f"WITH {_KEPT} SELECT p_partkey, quality::BIGINT AS quality, copies FROM best WHERE rn = 1")
def rebuild_dedup(spark, d):
    return _rebuilt(spark, d).select("p_partkey", F.col("quality").cast("long").alias("quality"), "copies")


@query(f"WITH {_KEPT} SELECT (SELECT count(*) FROM part) AS records_in, (SELECT count(*) FROM part WHERE p_partkey % 6 = 4) AS skipped_noise, (SELECT count(*) FROM part WHERE p_partkey % 6 = 0) AS fixed_prefix, (SELECT count(*) FROM part WHERE p_partkey % 6 = 3) AS reclassified_formula, (SELECT count(*) FROM clean WHERE k = 5 OR (k = 1 AND NOT useful)) AS downgraded_table, (SELECT count(*) FROM r WHERE page = 0) AS page_zero, (SELECT count(*) FROM r WHERE model <> raw_model) AS fixed_model, count(*) AS kept, sum(copies - 1)::BIGINT AS deduplicated, count(*) FILTER (kind2 = 'table') AS tables, count(*) FILTER (model = 'B') AS of_b FROM best WHERE rn = 1")
def rebuild_report(spark, d):
    rows = settle(rebuild.repaired(_record_rows(spark, d), STRONG, WEAK), "records")
    kept = settle(rebuild.deduplicated(rows.withColumn("file_no", F.lit(1)).withColumn("line_no", F.col("p_partkey")), rebuild.place_of()), "kept")
    out = rebuild.report(rows, kept)
    return out.select("records_in", "skipped_noise", "fixed_prefix", "reclassified_formula", "downgraded_table", "page_zero", "fixed_model", "kept", "deduplicated", F.coalesce(F.try_element_at("by_type", F.lit("table")), F.lit(0)).alias("tables"), F.coalesce(F.try_element_at("by_model", F.lit("B")), F.lit(0)).alias("of_b"))


@query("""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'heading' WHEN 'purchase' THEN 'table' ELSE 'text' END AS kind, event_id % 4 AS page, CASE WHEN event_type = 'click' THEN event_type || event_id % 3 ELSE event_type || ' ' || props END AS content FROM events),
h AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN content END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS head FROM e),
c AS (SELECT *, CASE WHEN kind <> 'text' OR (lag(page) OVER w IS DISTINCT FROM page) OR (lag(head) OVER w IS DISTINCT FROM head) OR (lag(kind) OVER w IS DISTINCT FROM kind) THEN 1 ELSE 0 END AS ch FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS buffer FROM c), g AS (SELECT user_id, buffer, min(head) AS heading, string_agg(content, chr(10) || chr(10) ORDER BY event_id) AS content, coalesce(min(CASE WHEN page > 0 THEN page END), 0) AS page FROM b WHERE kind = 'text' GROUP BY user_id, buffer)
SELECT user_id, CAST(buffer AS BIGINT) AS buffer, heading, page, sha256(content) AS digest FROM g WHERE length(content) >= 50""")
def text_buffers(spark, d):
    kind = F.when(F.col("event_type") == "click", "heading").when(F.col("event_type") == "purchase", "table").otherwise("text")
    content = F.when(F.col("event_type") == "click", F.concat("event_type", (F.col("event_id") % 3).cast("string"))).otherwise(F.concat("event_type", F.lit(" "), "props"))
    own = table(spark, d, "events").select(F.col("user_id").alias("source"), (F.col("event_id") % 4).alias("page"), F.col("event_id").alias("ord"), kind.alias("element_type"), content.alias("content"), F.lit("").alias("heading"))
    return chunking.buffers(own).select(F.col("source").alias("user_id"), F.col("buffer").cast("long").alias("buffer"), "heading", "page", F.sha2("content", 256).alias("digest"))


@query("""WITH s AS (SELECT event_id, user_id, CASE WHEN value > 90 THEN event_type END AS strong, CASE WHEN value < 50 THEN 'w' || event_type ELSE 'unknown' END AS weak, value / 50 AS sure FROM events)
SELECT event_id, coalesce(last_value(strong IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), CASE WHEN user_id % 5 = 0 THEN 'd' END, CASE WHEN sure >= 0.6 THEN nullif(weak, 'unknown') END, 'unknown') AS facet FROM s""")
def sticky_model(spark, d):
    """Strong signals stick; before the first, the file's own facet, then a sure weak one."""
    own = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") > 90, F.col("event_type")).alias("strong"), F.when(F.col("value") < 50, F.concat(F.lit("w"), "event_type")).otherwise("unknown").alias("weak"), (F.col("value") / 50).alias("sure"))
    return records.sticky(own, "strong", "weak", "sure", "user_id", "event_id", F.when(F.col("user_id") % 5 == 0, "d").otherwise("x"), ("d",)).select("event_id", "facet")


_ROW = "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag)"


@query(f"""WITH r AS (SELECT l_suppkey, {_ROW} - 1 AS n, '| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_returnflag || ' |' AS line FROM lineitem), b AS (SELECT l_suppkey, n // 80 + 1 AS page, count(*) AS num_rows, string_agg(CASE WHEN n % 80 = 0 THEN line || chr(10) || '| --- | --- | --- |' ELSE line END, chr(10) ORDER BY n) AS content FROM r GROUP BY ALL)
SELECT l_suppkey || '.csv' AS source, page, num_rows, sha256(content) AS digest FROM b""")
def csv_elements(spark, d):
    """A file of each supplier's lines: tables of 80 rows."""
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_returnflag")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(";", r["l_orderkey"].cast("string"), r["l_linenumber"].cast("string"), r["l_returnflag"])), "\n")
    own = table(spark, d, "lineitem").groupBy("l_suppkey").agg(text.alias("t")).select(F.concat(F.col("l_suppkey").cast("string"), F.lit(".csv")).alias("name"), F.lit("csv").alias("kind"), F.encode("t", "UTF-8").alias("content"))
    return files.elements(own).select("source", "page", "num_rows", F.sha2("content", 256).alias("digest"))


@query(r"""WITH p AS (SELECT doc_id, source, CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS t FROM documents), h AS (SELECT doc_id, source, t, length(trim(t, ' ')) < 50 AS small, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) >= 4 AND regexp_matches(x, '^\d+(\.\d+)*\s+.+$|^[А-ЯЁ][А-ЯЁ\s]{2,}$')) AS hs FROM p),
s AS (SELECT *, small AND doc_id % 12 <> 6 AND doc_id % 4 <> 1 AS scan FROM h),
e AS (SELECT doc_id, 'heading' AS element_type, least(3, len(hs)) AS n FROM s WHERE NOT scan UNION ALL SELECT doc_id, 'figure', CASE WHEN doc_id % 12 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END FROM s WHERE NOT scan UNION ALL SELECT doc_id, 'table', CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END FROM s WHERE NOT scan UNION ALL SELECT doc_id, 'scan', CASE WHEN doc_id % 12 = 0 THEN 1 ELSE 0 END FROM s WHERE scan)
SELECT doc_id, element_type, n::BIGINT AS n FROM e WHERE n > 0""")
def page_elements(spark, d):
    """Pages with pictures and tables; some have no text, and a picture that fills them (read by a stand-in) or does not."""
    k = F.col("doc_id")
    picture = lambda w, h: F.struct(F.encode(F.lit("picture of a whole page with enough text to be read"), "UTF-8").alias("data"), F.lit(w).cast("long").alias("width"), F.lit(h).cast("long").alias("height"), F.lit("figures/x.png").alias("path"))
    none = F.expr("cast(array() as array<struct<data: binary, width: bigint, height: bigint, path: string>>)")
    images = F.when(k % 12 == 0, F.array(picture(100, 99))).when(k % 12 == 6, F.array(picture(70, 90))).when(k % 4 == 1, F.array(picture(90, 85), picture(79, 100))).otherwise(none)
    grid = F.array(F.struct(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.col("lang"), F.lit(None).cast("string"))).alias("rows")), F.struct(F.array(F.array(F.lit("only"), F.lit("row"))).alias("rows")))
    tables = F.when(k % 5 == 0, grid).otherwise(F.expr("cast(array() as array<struct<rows: array<array<string>>>>)"))
    own = table(spark, d, "documents").select(F.col("source"), k.alias("page"), F.when(k % 6 == 0, "").otherwise(F.col("text")).alias("text"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), images.alias("images"), tables.alias("tables"))
    out = pages.elements(own, lambda data: F.decode(data, "UTF-8")).withColumn("element_type", F.when(F.col("ocr"), "scan").otherwise(F.col("element_type")))
    return out.where("element_type NOT IN ('text', 'formula')").groupBy(F.col("page").alias("doc_id"), "element_type").agg(F.count("*").alias("n"))


# messages

_WORDS = tuple(w for _, ws in chat.COMMANDS for w in ws) + ("", "Привет", "/helpme")


@query(f"WITH t AS (SELECT event_id, user_id, (['" + "', '".join(_WORDS) + f"'])[event_id % {len(_WORDS)} + 1] AS t FROM events) SELECT event_id, CASE " + " ".join(f"WHEN t IN ({_quoted(ws)}) THEN " + ("CASE WHEN user_id % 2 = 0 THEN 'health' ELSE 'denied' END" if n == "health" else f"'{n}'") for n, ws in chat.COMMANDS) + " END AS command FROM t")
def commands(spark, d):
    said = F.get(F.array(*(F.lit(f" {w.upper()}  ".replace(" ", "  ")) for w in _WORDS)), (F.col("event_id") % len(_WORDS)).cast("int"))
    return table(spark, d, "events").select("event_id", chat.command(said, admin=F.col("user_id") % 2 == 0).alias("command"))


@query("""WITH b AS (SELECT event_id, event_id % 8 AS k, user_id FROM events) SELECT event_id, CASE k WHEN 0 THEN 'nav' WHEN 1 THEN 'nav' WHEN 2 THEN 'help' WHEN 3 THEN 'faq' WHEN 4 THEN 'set_model' WHEN 5 THEN CASE WHEN user_id % 3 = 0 THEN 'set_model' END END AS action,
CASE k WHEN 0 THEN 'main' WHEN 1 THEN 'm' || user_id WHEN 2 THEN '' WHEN 3 THEN user_id::VARCHAR WHEN 4 THEN 'any' WHEN 5 THEN CASE WHEN user_id % 3 = 0 THEN '0' END END AS target FROM b""")
def buttons(spark, d):
    """Navigation with and without a menu, help, an item, any model, known and unknown models, an unknown command, no JSON."""
    k, user = F.col("event_id") % 8, F.col("user_id").cast("string")
    made = lambda **f: F.to_json(F.struct(*(v.alias(n) for n, v in f.items())))
    payload = F.when(k == 0, made(cmd=F.lit("nav"))).when(k == 1, made(cmd=F.lit(" nav "), to=F.concat(F.lit("m"), user))).when(k == 2, made(cmd=F.lit("help"))).when(k == 3, made(cmd=F.lit("faq"), id=user)).when(k == 4, made(cmd=F.lit("set_model"), model=F.lit(" any "))).when(k == 5, made(cmd=F.lit("set_model"), model=(F.col("user_id") % 3).cast("string"))).when(k == 6, made(cmd=F.lit("x"))).otherwise("{")
    return table(spark, d, "events").select("event_id", chat.button(payload, ("0",)).alias("b")).select("event_id", "b.action", "b.target")


@query("SELECT o_orderkey, n_name AS question FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 30")
def faq_lookup(spark, d):
    items = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("question"))
    return chat.question_of(items, table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" "), (F.col("o_orderkey") % 30).cast("string")).alias("faq_id"))).select("o_orderkey", "question")


@query("SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 OR (turn % 3 = 1 AND conv_id % 2 = 0) THEN substr(text, 1, 30) WHEN turn % 3 = 1 THEN '@Bot, ' || substr(text, 1, 30) ELSE 'bottle ' || substr(text, 1, 30) END, ' ') AS said FROM conversations")
def mention_strip(spark, d):
    """Mentions of the group, names of the bot in chats of several people and elsewhere, words that only begin like one."""
    k, own = F.col("turn") % 3, F.substring("text", 1, 30)
    text = F.when(k == 0, F.concat(F.lit(" [club12|Name]: "), own)).when(k == 1, F.concat(F.lit("@Bot, "), own)).otherwise(F.concat(F.lit("bottle "), own))
    # as in the SQL, only blanks go at the ends (line ends stay), and a null text stays null
    said = F.when(F.col("text").isNotNull(), F.trim(chat.plain(text, F.col("conv_id") % 2 == 0, ("helper,", "bot,"), blank=" ")))
    return table(spark, d, "conversations").select("conv_id", "turn", said.alias("said"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 AND event_id % 3 = 0 THEN 'code' ELSE 'ok' END AS reply, event_id % 5 < 3 AND event_id % 3 = 0 AS process FROM events""")
def webhook_replies(spark, d):
    """New messages, other events, confirmations, broken lines; right and wrong secrets and groups."""
    k, m = F.col("event_id") % 5, F.col("event_id") % 3
    line = F.to_json(F.struct(F.when(k < 3, "message_new").when(k == 3, "message_edit").otherwise("confirmation").alias("type"), F.when(m == 1, "7").otherwise("12").alias("group_id"), F.when(m == 2, "no").otherwise("s").alias("secret")))
    own = table(spark, d, "events").select("event_id", line.alias("value"))
    return V.replies(own, "code", secret="s", group="12").select("event_id", "reply", "process")


@query("""WITH m AS (SELECT event_id, user_id || ':' || event_type AS key, user_id % 4 = 0 AS chat FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY key, chat ORDER BY event_id) AS nth FROM m)
SELECT event_id, CASE WHEN chat THEN 'group_chat_disabled' WHEN nth > 1 OR key IN (SELECT user_id || ':view' FROM events WHERE user_id % 6 = 1) THEN 'duplicate' ELSE 'ok' END AS reason FROM n""")
def should_process(spark, d):
    own = table(spark, d, "events")
    messages = own.select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("event_key"), F.when(F.col("user_id") % 4 == 0, 2_000_000_001).otherwise(F.col("user_id")).alias("peer_id"), F.col("event_id").alias("t"))
    seen = own.where("user_id % 6 = 1").select(F.concat(F.col("user_id").cast("string"), F.lit(":view")).alias("event_key"))
    return V.to_process(messages, seen, groups=False).select("event_id", "reason")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '' ELSE text END AS query, CASE WHEN turn % 3 = 0 THEN 4 ELSE conv_id % 13 END::INT AS top_k, CASE WHEN turn % 4 = 0 OR length(text) > 3000 OR text = '' THEN 'query' WHEN turn % 3 <> 0 AND conv_id % 13 NOT BETWEEN 1 AND 10 THEN 'top_k' END AS error, CASE WHEN turn % 2 = 0 THEN 'api' ELSE role END AS user_id FROM conversations")
def requests(spark, d):
    own = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 > 0, F.col("text")).alias("query"), F.when(F.col("turn") % 3 > 0, F.col("conv_id") % 13).alias("top_k"), F.when(F.col("turn") % 2 > 0, F.col("role")).alias("user_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("model_filter", "string"), ("use_memory", "boolean"), ("validate", "boolean"))))
    return V.requests(own).select("conv_id", "turn", "query", "top_k", "error", "user_id")


@query("SELECT l_orderkey AS key, l_linenumber AS part, CASE WHEN l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 'K' END AS keyboard, CASE WHEN l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN l_returnflag END AS attachment FROM lineitem")
def deliveries(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("part"), F.lit("x").alias("content"), F.col("l_returnflag").alias("attachment"))
    return V.deliveries(own, "K").select("key", "part", "keyboard", "attachment")


@query("""WITH f AS (SELECT l_orderkey, l_partkey % 9 AS p, min(l_linenumber) AS place FROM lineitem WHERE l_partkey % 9 > 0 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, p::VARCHAR) AS n FROM f QUALIFY n <= 2)
SELECT l_orderkey AS query_id, string_agg('photo' || p, ',' ORDER BY n) AS attachment FROM n WHERE p <> 5 GROUP BY l_orderkey""")
def attachments(spark, d):
    """The first two pictures of each answer; one of them cannot be uploaded."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.when(F.col("l_partkey") % 9 > 0, (F.col("l_partkey") % 9).cast("string")).alias("image_path"))
    return V.attachments(own, lambda path: F.when(path != "5", F.concat(F.lit("photo"), path)))


_LINES = "list_distinct(list_transform(list_filter([{'d': p_brand, 'p': p_size}, {'d': ' ', 'p': 1}, {'d': p_brand, 'p': p_size}, {'d': p_type, 'p': p_partkey % 7}], lambda s: trim(s.d, ' ') <> ''), lambda s: '- ' || trim(s.d, ' ') || ', стр. ' || s.p))"


@query(f"""WITH a AS (SELECT p_partkey, p_name, p_brand || ', стр. ' || p_size AS one, p_type || ', стр. ' || p_partkey % 7 AS two, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 3 THEN 'Требуется проверка: ' || p_name WHEN 2 THEN p_name || ' [Документ: x, стр. 1]' ELSE p_name END AS answer, CASE p_size % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'review' ELSE 'rejected' END AS status, p_size FROM part),
b AS (SELECT *, CASE WHEN status = 'rejected' THEN '{chat.BLOCKED}' WHEN status = 'review' AND k <> 3 THEN 'Требуется проверка по официальной документации.' || chr(10) || chr(10) || answer ELSE answer END AS own FROM a)
SELECT p_partkey, 'Модель: ' || CASE WHEN p_size % 2 = 0 THEN 'Первая' ELSE 'любая' END || chr(10) || chr(10) || CASE WHEN contains(own, '[Документ:') THEN own ELSE own || chr(10) || chr(10) || 'Источники, найденные системой:' || chr(10) || '- ' || one || CASE WHEN two <> one THEN chr(10) || '- ' || two ELSE '' END END AS shown FROM b""")
def answer_format(spark, d):
    k = F.col("p_partkey") % 4
    answer = F.when(k == 3, F.concat(F.lit("Требуется проверка: "), "p_name")).when(k == 2, F.concat("p_name", F.lit(" [Документ: x, стр. 1]"))).otherwise(F.col("p_name"))
    status = F.when(F.col("p_size") % 3 == 0, "approved").when(F.col("p_size") % 3 == 1, "review").otherwise("rejected")
    place = lambda doc, page: F.struct(doc.alias("document"), page.cast("long").alias("page"))
    one = place(F.col("p_brand"), F.col("p_size"))
    sources = F.array(one, place(F.lit(" "), F.lit(1)), one, place(F.col("p_type"), F.col("p_partkey") % 7))
    header = chat.model_header(F.when(F.col("p_size") % 2 == 0, "m1"), {"m1": "Первая"}, "любая")
    return table(spark, d, "part").select("p_partkey", chat.formatted(answer, status, sources, header).alias("shown"))


# caches, paths, prefixes

@query("""WITH c AS (SELECT md5('q' || vec_id % 300) AS query_hash, min(vec_id) AS first FROM embeddings GROUP BY 1), n AS (SELECT md5('q' || event_id % 400) AS query_hash, event_type AS answer, row_number() OVER (PARTITION BY event_id % 400 ORDER BY ts DESC) AS rn FROM events WHERE event_id < 5000)
SELECT coalesce(n.query_hash, c.query_hash) AS query_hash, CASE WHEN n.query_hash IS NULL THEN 'old' ELSE n.answer END AS answer, CASE WHEN n.query_hash IS NULL THEN 7 ELSE 0 END AS hit_count FROM c FULL JOIN (SELECT * FROM n WHERE rn = 1) n ON n.query_hash = c.query_hash""")
def cache_set(spark, d):
    """New answers take the places of old ones and begin without hits."""
    old = table(spark, d, "embeddings").select(F.md5(F.concat(F.lit("q"), (F.col("vec_id") % 300).cast("string"))).alias("query_hash"), F.lit("old").alias("answer"), F.lit(7).alias("hit_count"), F.current_timestamp().alias("created_at")).distinct()
    new = table(spark, d, "events").where("event_id < 5000").select(F.concat(F.lit(" Q"), (F.col("event_id") % 400).cast("string")).alias("query"), F.col("event_type").alias("answer"), F.col("ts").cast("timestamp").alias("created_at"))
    return V.cache_set(old, new).select("query_hash", "answer", "hit_count")


@query("""WITH q AS (SELECT item_id, md5(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')) AS h, text FROM benchmark), c AS (SELECT DISTINCT h FROM q WHERE item_id % 3 = 0)
SELECT item_id, CASE WHEN h IN (SELECT h FROM c) THEN 'known' WHEN length('Ask: ' || (SELECT min(b.text) FROM q b WHERE b.h = q.h)) > 20 THEN 'Ask: ' || (SELECT min(b.text) FROM q b WHERE b.h = q.h) END AS hypothetical FROM q""")
def hyde_cache(spark, d):
    """Hypothetical answers: a third are cached, the others come from a stand-in that repeats its prompt."""
    asked = table(spark, d, "benchmark").select("item_id", F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    cache = asked.where("item_id % 3 = 0").select(V.query_key(F.col("query")).alias("query_hash"), F.lit("known").alias("hypothetical")).distinct()
    return V.hypothetical(asked, cache, lambda prompt: prompt, "Ask: {query}")[0].select("item_id", "hypothetical")


_STORED = "CASE p_partkey % 5 WHEN 0 THEN 'Q:\\out\\Figures\\' || p_size || '.png' WHEN 1 THEN 'output/figures/sub/' || p_size || '.png' WHEN 2 THEN p_size || '.png' WHEN 3 THEN '  ' ELSE '/abs/' || p_size || '.png' END"


def _stored():
    k, name = F.col("p_partkey") % 5, F.concat(F.col("p_size").cast("string"), F.lit(".png"))
    return F.when(k == 0, F.concat(F.lit("Q:\\out\\Figures\\"), name)).when(k == 1, F.concat(F.lit("output/figures/sub/"), name)).when(k == 2, name).when(k == 3, "  ").otherwise(F.concat(F.lit("/abs/"), name))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Figures/' || p_size || '.png' WHEN 1 THEN 'figures/sub/' || p_size || '.png' WHEN 3 THEN '  ' ELSE 'figures/' || p_size || '.png' END AS image_path, p_partkey % 5 <> 3 AS rebased FROM part")
def portable_paths(spark, d):
    return bundle.rebased(table(spark, d, "part").select("p_partkey", _stored().alias("image_path"))).select("p_partkey", "image_path", "rebased")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 AND p_size < 40 THEN '/abs/' || p_size || '.png' WHEN p_partkey % 5 = 1 AND p_size % 2 = 0 THEN '/home/output/figures/sub/' || p_size || '.png' WHEN p_partkey % 5 <> 3 AND p_size < 20 THEN '/home/figures/' || p_size || '.png' ELSE '' END AS resolved FROM part")
def resolve_paths(spark, d):
    """Stored paths that are there as they are, below the home, or under their name among the pictures."""
    sizes = table(spark, d, "part").select("p_size").distinct()
    there = lambda before, test: sizes.where(test).select(F.concat(F.lit(before), F.col("p_size").cast("string"), F.lit(".png")).alias("path"))
    found = there("/abs/", "p_size < 40").unionByName(there("/home/output/figures/sub/", "p_size % 2 = 0")).unionByName(there("/home/figures/", "p_size < 20"))
    return paths.resolved(table(spark, d, "part").select("p_partkey", _stored().alias("image_path")), found, "/home").select("p_partkey", "resolved")


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN ' Query:' || text WHEN item_id % 3 = 1 THEN 'passage: ' || text ELSE 'passage: ' END AS prefixed FROM benchmark")
def passage_prefix(spark, d):
    text = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" Query:"), "text")).when(F.col("item_id") % 3 == 1, F.col("text"))
    return table(spark, d, "benchmark").select("item_id", X.with_prefix(text, "passage: ").alias("prefixed"))


@query("""WITH a AS (SELECT conv_id, turn, role, text FROM conversations WHERE turn % 2 = 1) SELECT conv_id AS user_id, turn AS at, n::BIGINT AS turn, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE n WHEN 0 THEN 'q' || turn ELSE substr(text, 1, 500) END AS content FROM a, (VALUES (0), (1)) v(n) WHERE conv_id % 7 > 0""")
def remembered(spark, d):
    own = table(spark, d, "conversations").where("turn % 2 = 1").select(F.when(F.col("conv_id") % 7 > 0, F.col("conv_id").cast("string")).otherwise("anonymous").alias("user_id"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("query"), F.col("text").alias("answer"), F.col("turn").alias("at"))
    return answering.to_remember(own, F.col("at")).select(F.col("user_id").cast("long").alias("user_id"), F.col("t").alias("at"), "turn", "role", "content")
