"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of every text; where its low bits vanish, the
word at hand ends a chunk, or, where no word ends nearby, the character at
hand, so that chunks move with their content and an insertion changes only its
neighbours. Of each digest the first document (lowest doc_id) is found by a
partial minimum in every task, so a chunk that a third of all documents hold is
one row a task; digests of two documents or more are joined back to the chunks,
where Spark splits a hot digest. A run of such chunks in a document, with
``LEAST_WORDS`` words or more, is a repeated passage; in text without spaces,
one of ``LEAST_CHARS`` characters.

A group of n copies costs n rows a chunk, never pairs.

Defined results: null and empty texts have no chunks; repetition inside one
document is left alone; a document is told by doc_id and text: equal rows
repeat nothing, other texts under one doc_id are documents of their own, in
the order of their hash; rows with a null doc_id are neither reported nor
counted as the first, and keep their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvane.llm import textkit as K
from corvane.llm.store import columns, settle, small_batches, table

#: Low bits of the gear hash that must vanish, least and largest bytes of a chunk, and bytes within which a cut waits for the end of a word.
MASK_BITS, LEAST, MOST, NEAR = 4, 8, 128, 24
#: Words of a reported passage, at least, or characters where words are longer than UNSPACED characters. A passage loses the parts of its first and last chunk.
LEAST_WORDS, LEAST_CHARS, UNSPACED = 30, 100, 12

_U = np.uint64
_GEAR = np.random.default_rng(31).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling value at every byte: the sum of the codes of the last 32 bytes, each shifted by its age."""
    h = _GEAR[data]
    for age in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[age:] = h[:-age] << np.uint32(age)
        h = h + older
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text; the last is the text's end. Cuts fall behind words, or between characters where no word ends within NEAR bytes."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    hits = np.flatnonzero((gear_hash(data) >> np.uint32(32 - MASK_BITS)) == 0)
    gaps = np.flatnonzero(~K.WORD_BYTE[data])
    word_end = np.append(gaps, n)[np.searchsorted(gaps, hits, "right")]
    here = hits + 1
    for _ in range(3):  # a character has three more bytes at most
        inner = here < n
        inner[inner] = (data[here[inner]] & 0xC0) == 0x80
        here = here + inner
    cuts = np.unique(np.where(word_end - hits <= NEAR, word_end, here))
    out, last = [], 0
    for cut in [*cuts.tolist(), n]:
        while cut - last > MOST:
            # forced: at the last gap that fits, else before a character
            k = int(np.searchsorted(gaps, last + MOST, "right")) - 1
            forced = int(gaps[k]) if k >= 0 and gaps[k] >= last + LEAST else last + MOST
            while forced < n and (data[forced] & 0xC0) == 0x80:
                forced += 1
            if forced >= cut:
                break
            out.append(forced)
            last = forced
        if cut - last >= LEAST or cut == n:
            if cut > last:
                out.append(cut)
            last = cut
    return np.array(out, np.int64)


_CHUNK = {"digest": pa.int64(), "doc": pa.int64(), "key": pa.int64(), "begin": pa.int32(), "size": pa.int32(), "words": pa.int32()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents(doc_id, key, text): digest, place and length in code points, words. Equal rows that a task meets again are passed over."""
    seen: set[tuple[int, int]] = set()
    for whole in batches:
        for batch in K.slices(whole, "text"):
            data, offs, _ = K.string_buffers(batch.column("text"))
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
            ends = []
            for a, b, who in zip(offs[:-1].tolist(), offs[1:].tolist(), zip(ids.tolist(), keys.tolist())):
                fresh = who not in seen
                if fresh and len(seen) < 1 << 20:
                    seen.add(who)
                ends.append(chunk_ends(data[a:b]) + a if fresh else np.empty(0, np.int64))
            count = np.array([len(e) for e in ends])
            end = np.concatenate(ends)
            if not len(end):
                continue
            doc = np.repeat(np.arange(len(ends)), count)
            start = np.concatenate([[0], end[:-1]])
            first = np.cumsum(count) - count
            start[first[count > 0]] = offs[:-1][count > 0]
            word = K.WORD_BYTE[data]
            fresh = word & ~np.concatenate([[False], word[:-1]])
            at = offs[:-1][offs[:-1] < len(data)]
            fresh[at] = word[at]
            opens = np.concatenate([[0], np.cumsum(fresh)])
            points = K.code_points(data)
            rows = (K.span_hashes(data, start, end).view(np.int64), ids[doc], keys[doc], points[start] - points[offs[doc]], points[end] - points[start], opens[end] - opens[start])
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, _CHUNK.values())], names=list(_CHUNK))


def _documents(docs: DataFrame) -> DataFrame:
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64("text"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` whose chunks all occur in earlier documents.

    One row a passage: doc_id, start and end in code points, n_words, the lowest
    document that holds a part of it, all documents that first hold its chunks,
    and the hash of its text (which of several texts under one doc_id it is of).
    """
    chunks = _documents(docs).mapInArrow(_chunks, ", ".join(f"{c} {'int' if t == pa.int32() else 'long'}" for c, t in _CHUNK.items()))
    who = F.struct("doc", "key")
    held = chunks.groupBy("digest").agg(F.min(who).alias("keeper"), F.max(who).alias("last")).where("keeper <> last")
    # settled, so that both sides of the join are dealt anew and a hot digest can be split
    first = settle(held.select("digest", "keeper"), "digests")
    again = chunks.join(first, "digest").where(who != F.col("keeper")).select("doc", "key", "begin", "size", "words", F.col("keeper.doc").alias("source"))
    own = W.partitionBy("doc", "key").orderBy("begin")
    past = own.rowsBetween(W.unboundedPreceding, 0)
    before, before_end = F.lag("begin").over(own), F.lag(F.col("begin") + F.col("size")).over(own)
    marked = again.withColumn("once", F.coalesce(before != F.col("begin"), F.lit(True))).withColumn("fresh", F.col("once") & F.coalesce(before_end != F.col("begin"), F.lit(True)))
    runs = marked.withColumn("run", F.sum(F.col("fresh").cast("long")).over(past)).where("once").groupBy("doc", "key", "run").agg(
        F.min("begin").cast("long").alias("start"), F.max(F.col("begin") + F.col("size")).cast("long").alias("end"), F.sum("words").alias("n_words"), F.min("source").alias("first_doc_id"), F.sort_array(F.collect_set("source")).alias("source_doc_ids"))
    length = F.col("end") - F.col("start")
    wanted = (F.col("n_words") >= LEAST_WORDS) | ((length >= LEAST_CHARS) & (length > UNSPACED * F.col("n_words")))
    return runs.where(wanted).select(F.col("doc").alias("doc_id"), "start", "end", "n_words", "first_doc_id", "source_doc_ids", F.col("key").alias("text_hash"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the repeated passages cut from their texts; all columns are kept."""
    spans = repeated_passages(docs).groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text = F.col("text").cast("string")
    own = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text).alias("own_key"))
    joined = own.join(spans, (F.col("own_id") == F.col("of_id")) & (F.col("own_key") == F.col("of_key")), "left")
    whole = F.col("row").getField("text").cast("string")
    pieces = F.aggregate(
        F.col("spans"), F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["text"], whole.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("text"), s["end"].alias("at")),
        lambda acc: F.concat(acc["text"], whole.substr((acc["at"] + 1).cast("int"), F.length(whole))))
    fields = {f.name: f.dataType for f in docs.schema}
    return joined.select(*[F.when(F.col("of_id").isNull(), whole).otherwise(pieces).cast(fields[c]).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
