"""Spans of a text: (start, end, kind) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.store import small_batches
from corvane.llm.textkit import slices

Span = tuple[int, int, str]


def written(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end, by start, then by the order of ``kinds``, then end; comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], rank[x[2]], x[1])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text: str) -> str:
    """A-Z as a-z, everything else as it is, so that positions stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(docs: DataFrame, make: Callable[[], Callable[[str], tuple]], fields: str) -> DataFrame:
    """Apply a text function to every row: doc_id and the fields that it returns. ``make`` runs once a task; null texts count as empty."""
    names = [f.split()[0] for f in fields.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = [types[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found = [each(x or "") for x in batch.column("text").to_pylist()]
                columns = list(zip(*found)) if found else [[] for _ in names]
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", *names])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {fields}")
