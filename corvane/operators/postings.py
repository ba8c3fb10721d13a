"""A lexical index that is stored and read by term.

Tables below a folder: ``documents`` (chunk_id, dl), ``postings`` (term,
chunk_id, tf, dl) in folders of term buckets, sorted by term, so that a search
reads the row groups of its terms, and ``terms`` (term, df). Texts are tokenised
once, when they are indexed. A term that a third of all documents hold is split
over several files of its bucket.

Scores are BM25 with the inverse document frequency floored at ``FLOOR``. A
search weighs the postings of its terms and sums them for all queries at once:
documents are dealt into blocks, and a block is one product of the document by
term matrix with the term by query matrix.

Defined results: null texts and texts without tokens are not indexed; a query
without tokens finds nothing; an empty index gives no results.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corvane import storage
from corvane.functions import text as X
from corvane.operators.scoring import _arrow, best_of, query_blocks, ranked

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Results of a query, term buckets, postings of a block of documents, about, queries that are searched together, entries of a dense matrix.
LEXICAL_K, BUCKETS, BLOCK, QUERIES, ENTRIES = 10, 16, 1 << 20, 256, 1 << 22


def postings(docs: DataFrame, key: str, text: str, lemmas: dict[str, str] | None = None) -> DataFrame:
    """(key, term, tf, dl): dl counts the tokens of the document."""
    own = docs.select(key, X.tokens(F.col(text), lemmas).alias("terms")).withColumn("dl", F.size("terms")).where("dl > 0")
    return own.select(key, "dl", F.explode("terms").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, key: str, text: str, lemmas: dict[str, str] | None = None) -> DataFrame:
    """(key, term): the distinct terms among the first twenty tokens of each query."""
    return queries.select(key, F.explode(X.query_terms(F.col(text), lemmas)).alias("term")).distinct()


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


class LexicalIndex:
    """The index in one folder. ``lemmas`` must be the same for writing and searching."""

    def __init__(self, spark: SparkSession, home: str, lemmas: dict[str, str] | None = None):
        self.spark, self.home, self.lemmas = spark, home.rstrip("/"), lemmas

    def _at(self, name: str) -> str:
        return f"{self.home}/{name}"

    def exists(self) -> bool:
        return storage.exists(self.spark, self._at("complete"))

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name == "postings":  # its schema is written down, for without rows it has no file
            reader = reader.schema(StructType.fromJson(json.loads(storage.read_text(self.spark, self._at("complete")))))
        return reader.parquet(self._at(name))

    def write(self, docs: DataFrame) -> "LexicalIndex":
        """Index docs(chunk_id, content) anew."""
        return self._store(postings(docs.select("chunk_id", "content"), "chunk_id", "content", self.lemmas))

    def upsert(self, docs: DataFrame) -> "LexicalIndex":
        """Index docs(chunk_id, content); what was indexed under their ids goes. Rows whose text has no tokens take nothing's place."""
        new = storage.settle(postings(docs.select("chunk_id", "content"), "chunk_id", "content", self.lemmas), "postings")
        old = self.table("postings").drop("bucket").join(new.select("chunk_id").distinct(), "chunk_id", "left_anti")
        return self._store(old.unionByName(new))

    def clear(self) -> None:
        storage.delete(self.spark, self.home)

    def _store(self, rows: DataFrame) -> "LexicalIndex":
        """Write the tables beside the old ones, then put them in their place."""
        fresh = f"{self.home}-{uuid.uuid4().hex}"
        own = rows.withColumn("bucket", _bucket())
        # the rebalance splits buckets that are too large, and joins small ones
        own.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{fresh}/postings")
        stored = self.spark.read.schema(own.schema).parquet(f"{fresh}/postings")
        stored.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{fresh}/terms")
        stored.groupBy("chunk_id").agg(F.first("dl").alias("dl")).write.parquet(f"{fresh}/documents")
        storage.write_text(self.spark, f"{fresh}/complete", own.schema.json())
        storage.move(self.spark, fresh, self.home)
        return self

    def search(self, queries: DataFrame, k: int = LEXICAL_K) -> DataFrame:
        """Top ``k`` chunks for queries(query_id, query): query_id, chunk_id, score, rank."""
        found = None
        for block in query_blocks(queries, QUERIES):
            part = self._search(block, k)
            found = part if found is None else found.unionAll(part)
        return ranked(found, [F.desc("score"), F.col("chunk_id")], k)

    def _search(self, queries: DataFrame, k: int) -> DataFrame:
        terms = query_terms(queries, "query_id", "query", self.lemmas)
        corpus = self.table("documents").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl")).first()
        # at most twenty terms a query, and a block of queries has a bound
        wanted = F.broadcast(terms.select("term").distinct())
        idf = F.greatest(F.lit(FLOOR), F.log((corpus["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        known = self.table("terms").join(wanted, "term", "left_semi").select("term", idf.alias("idf")).collect()
        place = {r["term"]: n for n, r in enumerate(sorted(known, key=lambda r: r["term"]))}
        asked = terms.collect()
        ids = sorted({r["query_id"] for r in asked})
        column = {q: n for n, q in enumerate(ids)}
        weights = np.zeros((len(place), len(ids)))
        idf_of = {r["term"]: r["idf"] for r in known}
        for r in asked:
            if r["term"] in place:
                weights[place[r["term"]], column[r["query_id"]]] = idf_of[r["term"]]
        sent = self.spark.sparkContext.broadcast((place, weights, ids))
        own = self.table("postings")
        if "bucket" in own.columns and len(place) < BUCKETS:
            buckets = terms.select(_bucket().alias("bucket")).distinct().collect()
            own = own.where(F.col("bucket").isin([r["bucket"] for r in buckets]))
        if 0 < len(place) <= 1000:  # such a list is pushed down to the row groups
            own = own.where(F.col("term").isin(list(place)))
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(corpus["avgdl"]))))
        rows = own.join(wanted, "term", "left_semi").select("chunk_id", "term", part.alias("part"))
        blocks = max(1, -(-self.table("postings").count() // BLOCK))
        dealt = rows.groupBy(F.pmod(F.xxhash64("chunk_id"), F.lit(max(blocks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))).alias("block"))
        chunk_kind, query_kind = (d.schema[c].dataType.simpleString() for d, c in ((rows, "chunk_id"), (queries, "query_id")))
        return dealt.applyInArrow(_product(sent, k, query_kind, chunk_kind), f"query_id {query_kind}, chunk_id {chunk_kind}, score double")


def _product(sent, k: int, query_kind: str, chunk_kind: str):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        place, weights, ids = sent.value
        chunk = rows.column("chunk_id").combine_chunks().dictionary_encode()
        term = rows.column("term").combine_chunks().dictionary_encode()
        names = np.array(chunk.dictionary.to_pylist(), object)
        order = np.argsort(names, kind="stable")
        nth = np.empty(len(names), np.int64)
        nth[order] = np.arange(len(names))
        row = nth[chunk.indices.to_numpy(zero_copy_only=False)]
        col = np.array([place[t] for t in term.dictionary.to_pylist()])[term.indices.to_numpy(zero_copy_only=False)]
        part = rows.column("part").to_numpy()
        by = np.argsort(row, kind="stable")
        row, col, part = row[by], col[by], part[by]
        out: list[tuple] = []
        step = max(64, ENTRIES // max(1, len(place)))
        for lo in range(0, len(names), step):
            a, b = np.searchsorted(row, [lo, lo + step])
            own = np.unique(col[a:b])
            dense = np.zeros((min(step, len(names) - lo), len(own)))
            dense[row[a:b] - lo, np.searchsorted(own, col[a:b])] = part[a:b]
            score = (dense @ weights[own]).round(6)
            met = (dense > 0).astype(np.float32) @ (weights[own] > 0).astype(np.float32) > 0
            for j, places in enumerate(best_of(np.where(met, -score, np.inf), np.full(len(ids), k))):
                out += [(ids[j], names[order[lo + p]], score[p, j]) for p in places.tolist()]
        kinds = (_arrow(query_kind), _arrow(chunk_kind), pa.float64())
        return pa.table([pa.array([r[n] for r in out], t) for n, t in enumerate(kinds)], names=["query_id", "chunk_id", "score"])

    return run


def index_of(spark: SparkSession, docs: DataFrame, source: str) -> LexicalIndex:
    """Index of docs(chunk_id, content) that were read from ``source``; it is written once an application for each state of that table."""
    index = LexicalIndex(spark, f"{storage.work_folder(spark)}/lexical-{storage.fingerprint(spark, source)}")
    return index if index.exists() else index.write(docs)
