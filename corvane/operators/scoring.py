"""Best rows of many queries by products of matrices: blocks of rows against all stated queries, the best of each block, then the best of those.

The queries are a stated set: they are taken in blocks of ``MOST_QUERIES`` rows,
so what the driver reads and the workers hold has a bound; the rows may be any
number. A block of rows costs one product, and at most k rows a query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of queries that are worked on together, and rows of a product.
MOST_QUERIES, ROWS = 2_000, 4096


def ranked(df: DataFrame, order: list[Column], k: int | Column) -> DataFrame:
    """Best ``k`` of each query in the given order: with rank from 1."""
    own = df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long"))
    return own.where(F.col("rank") <= k)


def query_blocks(queries: DataFrame, most: int = MOST_QUERIES) -> Iterator[DataFrame]:
    """The queries in blocks of about ``most`` rows."""
    blocks = max(1, -(-queries.count() // most))
    for b in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries


def best_of(score: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
    """For each column of ``score`` (rows, queries) the places of its k lowest values; equal values keep the order of the rows."""
    out = []
    for j, n in enumerate(np.minimum(k, len(score)).tolist()):
        own = score[:, j]
        if n <= 0:
            out.append(np.empty(0, np.int64))
            continue
        near = np.flatnonzero(own <= np.partition(own, n - 1)[n - 1])
        near = near[np.isfinite(own[near])]
        out.append(near[np.argsort(own[near], kind="stable")][:n])
    return out


def nearest(vectors: DataFrame, queries: DataFrame, metric: str, digits: int = 6) -> DataFrame | None:
    """(query_id, chunk_id, score, k) candidates of vectors(chunk_id, embedding) for queries(query_id, query_embedding, k): the best k of every task.

    Scores are rounded before they are compared. Rows without a vector, or with
    one of another length, are nobody's neighbour. None without queries.
    """
    chunk_kind, query_kind = vectors.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    found = None
    for block in query_blocks(queries):
        rows = block.where("query_embedding IS NOT NULL").collect()
        if not rows:
            continue
        dim = max(len(r["query_embedding"]) for r in rows)
        rows = [r for r in rows if len(r["query_embedding"]) == dim]
        sent = vectors.sparkSession.sparkContext.broadcast((np.array([r["query_embedding"] for r in rows], float), np.array([r["k"] for r in rows]), [r["query_id"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, k, ids = sent.value
            held: list[list[tuple]] = [[] for _ in ids]
            for whole in batches:
                for lo in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(lo, ROWS)
                    keys, x = _matrix(batch, q.shape[1])
                    if not len(keys):
                        continue
                    order = np.argsort(np.array(keys, object), kind="stable")
                    score = _scores(x[order], q, metric).round(digits)
                    sign = 1 if metric == "l2" else -1
                    for j, places in enumerate(best_of(sign * score, k)):
                        both = held[j] + [(sign * score[p, j], keys[order[p]]) for p in places.tolist()]
                        held[j] = sorted(both)[: k[j]]
            out = [(ids[j], key, s if metric == "l2" else -s, int(k[j])) for j, own in enumerate(held) for s, key in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate((_arrow(query_kind), _arrow(chunk_kind), pa.float64(), pa.int64()))], names=["query_id", "chunk_id", "score", "k"])

        part = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL").mapInArrow(run, f"query_id {query_kind}, chunk_id {chunk_kind}, score double, k long")
        found = part if found is None else found.unionAll(part)
    return found


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[list, np.ndarray]:
    column = batch.column("embedding")
    fits = np.asarray(column.value_lengths().fill_null(0)) == dim
    own = column.filter(pa.array(fits))
    flat = own.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dim)
    whole = ~np.isnan(x).any(1)
    keys = np.array(batch.column("chunk_id").filter(pa.array(fits)).to_pylist(), object)[whole].tolist()
    return keys, x[whole]


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    product = x @ q.T
    if metric == "l2":
        return np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1) - 2 * product, 0)
    norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))
    return np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
