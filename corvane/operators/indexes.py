"""Index tables on disk: upsert, verification, export, manifests, bundles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions import text as X


def chunk_counts(store: DataFrame) -> DataFrame:
    """Rows, empty contents and leaked prefixes of store(chunk_id, content, chunk_type) by type."""
    leaked = F.coalesce(F.col("content"), F.lit("")).rlike(r"(?i)^\s*(passage|query):")
    return store.groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce(F.col("content"), F.lit(""))) == "").alias("n_empty"), F.count_if(leaked).alias("n_leaked"))


def verified(store: DataFrame, lexical: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: counts, drift and verdict. Empty or leaked texts and lexical drift over max(5, 2 %) fail, vector drift over max(5, 5 %) only warns."""
    counts = chunk_counts(store).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_store"), F.coalesce(F.sum("n_empty"), F.lit(0)).alias("n_empty"), F.coalesce(F.sum("n_leaked"), F.lit(0)).alias("n_leaked"))
    one = functools.reduce(lambda a, b: a.crossJoin(b), [counts, lexical.agg(F.countDistinct("chunk_id").alias("n_lexical")), vectors.agg(F.countDistinct("chunk_id").alias("n_vectors"))])  # rows of one
    drift = lambda c: F.abs(F.col("n_store") - F.col(c))
    failed = (F.col("n_store") == 0) | (drift("n_lexical") > F.greatest(F.lit(5.0), 0.02 * F.col("n_store"))) | (F.col("n_leaked") > 0) | (F.col("n_empty") > 0)
    return one.withColumn("status", F.when(failed, "fail").when(drift("n_vectors") > F.greatest(F.lit(5.0), 0.05 * F.col("n_store")), "warn").otherwise("ok"))


def coerced(records: DataFrame, value: str = "value") -> DataFrame:
    """Records of JSON lines under one naming: chunk_id, content, chunk_type, source, page. Rows that hold nothing go.

    content comes from content if it is there, though empty, else from page_content or
    text; the id from chunk_id, id or metadata, else from a hash of the content.
    ``backfilled``: an id or the metadata were put in.
    """
    at = lambda path: F.get_json_object(F.col(value), path)
    first = lambda *paths: F.coalesce(*(F.nullif(at(p), F.lit("")) for p in paths))
    content = F.coalesce(at("$.content"), first("$.page_content", "$.text"))
    own_id, meta = first("$.chunk_id", "$.id", "$.metadata.chunk_id"), at("$.metadata")
    out = records.select(
        F.coalesce(own_id, F.concat(F.lit("rec_"), X.short_hash(F.coalesce(content, F.lit(""))))).alias("chunk_id"), (own_id.isNull() | ~F.coalesce(meta.startswith("{"), F.lit(False))).alias("backfilled"),
        content.alias("content"), F.coalesce(first("$.chunk_type", "$.metadata.chunk_type"), F.lit("text")).alias("chunk_type"),
        first("$.metadata.source", "$.source").alias("source"), F.coalesce(first("$.metadata.page", "$.page").try_cast("long"), F.lit(0)).alias("page"), F.when(meta.startswith("{"), meta).otherwise("{}").alias("metadata"))
    return out.where((F.trim(F.coalesce("content", F.lit(""))) != "") | (F.col("metadata") != "{}"))


def first_of_group(records: DataFrame, order: Column) -> DataFrame:
    """Import rule: one record a (source, page, type, first 2000 characters), the first in order; equal ids after the first get a suffix of six hex characters."""
    from pyspark.sql import Window as W

    key = [F.coalesce("source", F.lit("")).alias("k_source"), F.col("page").alias("k_page"), F.col("chunk_type").alias("k_type"), X.short_hash(F.substring(F.coalesce("content", F.lit("")), 1, 2000)).alias("k_hash")]
    own = records.select("*", *key, order.alias("k_order")).groupBy("k_source", "k_page", "k_type", "k_hash").agg(F.min_by(F.struct(*[F.col(c) for c in records.columns], F.col("k_order")), "k_order").alias("r")).select("r.*")
    n = F.row_number().over(W.partitionBy("chunk_id").orderBy("k_order"))
    return own.withColumn("k_n", n).withColumn("chunk_id", F.when(F.col("k_n") > 1, F.concat("chunk_id", F.lit("_"), F.substring(F.sha2(F.concat_ws(":", "chunk_id", F.col("k_n").cast("string")), 256), 1, 6))).otherwise(F.col("chunk_id"))).drop("k_n", "k_order")


def exported(chunks: DataFrame, path: str, by_type: bool = True) -> DataFrame:
    """Write chunks as JSON lines, in one folder a type if told so, and read them back."""
    writer = chunks.write.mode("overwrite")
    (writer.partitionBy("chunk_type") if by_type else writer).json(path)
    return chunks.sparkSession.read.schema(chunks.schema).json(path)


def with_seq(exported_rows: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Rows with the seq of adjacency(chunk_id, seq) where their own is missing."""
    known = adjacency.select("chunk_id", F.col("seq").alias("known"))
    return exported_rows.join(known, "chunk_id", "left").withColumn("seq", F.coalesce("seq", "known")).drop("known")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of the files of a folder; hidden files, logs and archives stay out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = files.where(~F.col("path").rlike(r"/(\.|_)[^/]*$|/logs/|/metadata/|\.zip$|\.crc$"))
    return kept.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def incompatible(manifest_settings: dict, settings: dict, keys=("model", "passage_prefix", "query_prefix")) -> list[str]:
    """Settings in which an index and its reader differ (compared without outer blanks)."""
    return [k for k in keys if str(manifest_settings.get(k, "")).strip() != str(settings.get(k, "")).strip()]


def counts_by(store: DataFrame, column: str) -> DataFrame:
    """One row: map of the values of a column to their numbers."""
    return store.groupBy(column).count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("key"), "count")))).alias(f"by_{column}"))


def upserted(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """A store with chunks put in by chunk_id: the shown text is full_content, else content; those without any are left out. Of equal new ids the last by seq stays."""
    shown = F.coalesce(F.nullif(F.trim(F.coalesce("full_content", F.lit(""))), F.lit("")), F.trim(F.coalesce("content", F.lit(""))))
    new = chunks.where(shown != "").groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in store.columns if c != "chunk_id"]), F.coalesce("seq", F.lit(-1))).alias("r")).select("chunk_id", "r.*").select(*store.columns)
    return store.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def adjacency(store: DataFrame) -> DataFrame:
    """Neighbour rows of a store: (source, seq, chunk_id, page, chunk_type, model) of the chunks that have a seq."""
    return store.where("seq IS NOT NULL").select(F.coalesce("source", F.lit("")).alias("source"), "seq", "chunk_id", F.coalesce("page", F.lit(0)).alias("page"), "chunk_type", F.coalesce("model", F.lit("unknown")).alias("model"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of chunks; a missing type is that of its metadata, else text."""
    own = spark.read.parquet(path)
    kind = F.nullif("chunk_type", F.lit("")) if "chunk_type" in own.columns else F.lit(None).cast("string")
    noted = F.nullif(F.get_json_object("metadata", "$.chunk_type"), F.lit("")) if "metadata" in own.columns else F.lit(None).cast("string")
    return own.withColumn("chunk_type", F.coalesce(kind, noted, F.lit("text")))


def write_vectors(spark: SparkSession, path: str, vectors: DataFrame) -> None:
    """Put vectors(chunk_id, chunk_type, embedding) into a stored table by chunk_id: texts and others lie in folders of their own."""
    from corvane import storage

    new = vectors.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), "chunk_type", (F.col("chunk_type") == "text").alias("is_text"))
    if storage.exists(spark, path):
        new = read_vectors(spark, path).join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)
    new.write.partitionBy("is_text").mode("overwrite").parquet(f"{path}-new")
    storage.move(spark, f"{path}-new", path)


def read_vectors(spark: SparkSession, path: str, text: bool | None = None) -> DataFrame:
    """Stored vectors: of texts, of others, or all."""
    own = spark.read.parquet(path).withColumn("is_text", F.col("is_text").cast("boolean"))
    return own if text is None else own.where(F.col("is_text") == text)
