"""One object for the whole engine: ingest, chunk, index, search, answer, verify, export, move, evaluate."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane import storage
from corvane.functions import repair, rules
from corvane.operators import answering, bundle, chunking, evaluate, indexes, models, rebuild, records, retrieval as R, serving
from corvane.operators.postings import LexicalIndex
from corvane.sources import files, jsonl

STORE = "chunk_id string, content string, full_content string, chunk_type string, source string, page long, page_end long, heading string, model string, doc_category string, chunk_index long, seq long"


@dataclasses.dataclass(frozen=True)
class Settings:
    """What an index is built with; a reader must have the same prefixes and model."""

    embedding: str | None = None
    passage_prefix: str = models.PASSAGE
    query_prefix: str = models.QUERY
    dimensions: int = 64
    strong: rules.Rules = ()
    weak: rules.Rules = ()
    reminder: str = "Сообщите об инциденте председателю участковой комиссии и на горячую линию технической поддержки по регламенту."

    def described(self) -> dict[str, str]:
        return {"model": self.embedding or "", "passage_prefix": self.passage_prefix, "query_prefix": self.query_prefix, "dim": str(self.dimensions)}


class Engine:
    """Every method takes and returns DataFrames; queries come in batches. ``home`` is a folder that all executors see."""

    def __init__(self, spark: SparkSession, home: str, settings: Settings = Settings()):
        self.spark, self.home, self.settings = spark, home.rstrip("/"), settings
        self.lexical = LexicalIndex(spark, self._at("lexical"))

    def _at(self, name: str) -> str:
        return f"{self.home}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def _has(self, name: str) -> bool:
        return storage.exists(self.spark, self._at(name))

    # ingest

    def ingest(self, folder: str, readers: dict | None = None, names: DataFrame | None = None) -> DataFrame:
        """Elements of a folder's files (of those in names(path), if given), cleaned."""
        found = files.discover(self.spark, folder)
        own = files.elements(found.join(names, "path", "left_semi") if names is not None else found, readers)
        return own.withColumn("content", repair.normalized(F.col("content")))

    def chunk(self, elements: DataFrame) -> DataFrame:
        """Chunks of elements with their order; of chunks with equal texts the best stays."""
        every = chunking.chunks_of(elements.withColumnRenamed("elem_ix", "ord"))
        return self._best(every)

    def _best(self, chunks: DataFrame) -> DataFrame:
        place = F.struct(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("seq", F.lit(0)).alias("seq"))
        own = chunks.select("chunk_id", F.coalesce("full_content", "content").alias("content"), "chunk_type", "source", "page", F.col("model").alias("facet"), "heading", place.alias("ord"))
        return chunks.join(records.best_of_group(own).select("chunk_id"), "chunk_id", "left_semi")

    def index(self, chunks: DataFrame) -> None:
        """Write store, lexical index and, with an embedder, vectors anew."""
        self.clear()
        self._store(indexes.upserted(self.spark.createDataFrame([], STORE), self._shaped(chunks)))
        own = self.table("store")
        self.lexical.write(self._shown(own))
        self._embed(own)

    def upsert(self, chunks: DataFrame) -> None:
        """Put chunks into all parts of the index; those that are there go by id."""
        if not self._has("store"):
            return self.index(chunks)
        new = storage.settle(self._shaped(chunks), "chunks")
        self._store(indexes.upserted(self.table("store"), new))
        self.lexical.upsert(self._shown(new))
        self._embed(new)

    def _shaped(self, chunks: DataFrame) -> DataFrame:
        fields = [f.split() for f in STORE.split(", ")]
        return chunks.select(*((F.col(c) if c in chunks.columns else F.lit(None)).cast(t).alias(c) for c, t in fields))

    def _store(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._at("store-new"))
        storage.move(self.spark, self._at("store-new"), self._at("store"))
        indexes.adjacency(self.table("store")).write.mode("overwrite").parquet(self._at("order"))

    def _shown(self, store: DataFrame) -> DataFrame:
        return store.select("chunk_id", F.coalesce(F.nullif("full_content", F.lit("")), "content").alias("content"))

    def _embed(self, store: DataFrame) -> None:
        if self.settings.embedding:
            embed = models.embedding(models.provider("embedding", self.settings.embedding), self.settings.passage_prefix)
            indexes.write_vectors(self.spark, self._at("vectors"), store.where("trim(content) <> ''").select("chunk_id", "chunk_type", embed(F.col("content")).alias("embedding")))

    def clear(self) -> None:
        """Delete store, order, lexical index, vectors and pictures."""
        for name in ("store", "order", "lexical", "vectors", "figures"):
            storage.delete(self.spark, self._at(name))

    def ingest_all(self, folder: str, artifacts: str | None = None, incremental: bool = True, readers: dict | None = None) -> DataFrame:
        """Bring the index up to date with a folder of documents and, if given, one of artifacts: the plan (key, status, action) that was carried out.

        A changed or removed file means that all is read again; otherwise new files only.
        """
        current = bundle.fingerprints(files.discover(self.spark, folder), "doc")
        if artifacts:
            current = current.unionByName(bundle.fingerprints(self._artifacts(artifacts), "artifact"))
        current = storage.settle(current, "manifest")
        plan = storage.settle(bundle.planned(self.spark, self._at("metadata/ingested"), current, incremental), "plan")
        wanted = current.join(plan.where("action = 'read'"), "key", "left_semi")
        if wanted.isEmpty() and plan.where("action = 'drop'").isEmpty():
            return plan
        fresh = not incremental or not plan.where("status IN ('removed', 'changed')").isEmpty() or not self._has("store")
        chunks = self.chunk(self.ingest(folder, readers, wanted.where("kind = 'doc'").select("path")))
        if artifacts:
            chunks = self._shaped(chunks).unionByName(self._shaped(self.imported(artifacts, wanted.where("kind = 'artifact'").select("path"))))
        chunks = storage.settle(chunks, "chunks")
        (self.index if fresh else self.upsert)(chunks)
        counts = chunks.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
        named = current.withColumn("name", F.substring_index("path", "/", -1)).join(counts, "name", "left").withColumn("chunks", F.coalesce("n", F.lit(0))).drop("name", "n")
        bundle.save_ingested(named, self._at("metadata/ingested"))
        return plan

    # stored records

    def _artifacts(self, folder: str) -> DataFrame:
        own = files.discover(self.spark, folder, ("txt", "jsonl"))
        return own.where(files.artifact_kind(F.col("name")) != "unknown")

    def lines(self, folder: str, names: DataFrame | None = None) -> DataFrame:
        """Repaired lines of a folder's artifacts: path, file, kind, file_no, line_no, status, value."""
        found = self._artifacts(folder)
        found = found.join(names, "path", "left_semi") if names is not None else found
        texts = found.select("path", F.decode("content", "UTF-8").alias("text"))
        own = jsonl.repaired(texts).withColumn("file", F.substring_index("path", "/", -1)).withColumn("kind", files.artifact_kind(F.col("file"), exports=True))
        return own.withColumn("file_no", F.xxhash64("path"))

    def imported(self, folder: str, names: DataFrame | None = None, lexical: bool = False) -> DataFrame:
        """Chunks of artifacts by the rules of an import."""
        own = rebuild.imported(self.lines(folder, names).where("status <> 'unrecoverable'"), self.settings.strong, self.settings.weak, lexical)
        return rebuild.first_of_import(own, rebuild.place_of(rebuild.IMPORT_ORDER)).select("*", rules.category(F.col("source")).alias("doc_category"))

    def rebuild(self, folder: str, export: bool = False, lexical: bool = False, dry: bool = False) -> DataFrame:
        """Index the artifacts of a folder by the rules of a rebuild, unless ``dry``: the report, one row."""
        every = storage.settle(self.lines(folder), "lines")
        rows = storage.settle(rebuild.repaired(rebuild.selected(every.where("status <> 'unrecoverable'"), export, lexical), self.settings.strong, self.settings.weak), "records")
        kept = storage.settle(rebuild.deduplicated(rows, rebuild.place_of()), "kept")
        if not dry:
            self.index(kept.withColumnRenamed("record_id", "chunk_id").withColumn("doc_category", rules.category(F.col("source"))))
        return rebuild.report(rows, kept, rebuild.selected(every, export, lexical))

    # queries

    def search(self, queries: DataFrame, k: int = R.FINAL_K, quarantine: DataFrame | None = None, rerank=None, strict: bool = True) -> DataFrame:
        """The best ``k`` chunks of queries(query_id, query[, facet, query_embedding]), hydrated, with their neighbours, in rank and prompt order."""
        store = self.table("store").withColumns({"facet": F.coalesce("model", F.lit("unknown")), "category": F.col("doc_category")})
        vectors = None
        if self._has("vectors"):
            vectors = indexes.read_vectors(self.spark, self._at("vectors")).select("chunk_id", "embedding")
            if "query_embedding" not in queries.columns and self.settings.embedding:
                embed = models.embedding(models.provider("embedding", self.settings.embedding), self.settings.query_prefix)
                queries = storage.settle(queries.withColumn("query_embedding", embed(F.col("query"))), "queries")
        out = R.search(queries, store, self.lexical, vectors, quarantine, k, strict, rerank)
        return out.withColumn("content", F.when(F.col("chunk_type") == "text", F.col("content")).otherwise(F.coalesce("full_content", "content")))

    def contexts(self, results: DataFrame) -> DataFrame:
        return serving.prompts(results)

    def answer(self, queries: DataFrame, k: int = 4, own: answering.Models = answering.Models(), history: DataFrame | None = None, cache: DataFrame | None = None, quarantine: DataFrame | None = None) -> DataFrame:
        """Answers to queries(query_id, user_id, query[, facet])."""
        return answering.answered(queries, lambda asked: self.search(asked, k, quarantine), own, self.settings.reminder, history=history, cache=cache)

    def ready(self) -> dict[str, bool]:
        """Parts of the index that are there; ready with the lexical one and vectors, or with the lexical one if no embedder is set."""
        there = {"lexical": self.lexical.exists(), "vectors": self._has("vectors"), "store": self._has("store")}
        return {"ready": there["lexical"] and there["store"] and (there["vectors"] or not self.settings.embedding), **there}

    # care

    def repair_jsonl(self, folder: str) -> DataFrame:
        own = self.spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        return jsonl.repaired(own)

    def verify(self) -> DataFrame:
        store = indexes.read_store(self.spark, self._at("store"))
        vectors = self.table("vectors") if self._has("vectors") else store
        return indexes.verified(store.withColumn("content", F.coalesce(F.nullif("full_content", F.lit("")), "content")), self.lexical.table("documents"), vectors)

    def export(self, folder: str, by_type: bool = True, source: str = "store") -> DataFrame:
        """Chunks of the store, or those of the lexical index, as JSON lines with their seq."""
        own = indexes.with_seq(self.table("store"), self.table("order").select("chunk_id", "seq"))
        own = own.join(self.lexical.table("documents").select("chunk_id"), "chunk_id", "left_semi") if source == "lexical" else own
        return indexes.exported(own.withColumn("id", F.col("chunk_id")), folder, by_type)

    def pack(self, to: str, version: str = "1") -> int:
        return bundle.pack(self.spark, self.home, to, self.settings.described(), version)

    def unpack(self, source: str, force: bool = False) -> list[str]:
        """Put a bundle in this engine's home; the settings in which they differ."""
        return bundle.unpack(self.spark, source, self.home, self.settings.described(), force)

    def evaluate(self, results: DataFrame) -> DataFrame:
        return evaluate.report(results)
