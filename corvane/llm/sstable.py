"""Token-id output as sorted-string-table shards.

A shard file holds documents in ascending key order:

* data blocks, each compressed by zstd: entries of (shared key bytes, other key
  bytes, value bytes as varints; the other key bytes; the value),
* a sparse index: first key, place and size of each block,
* a Bloom filter over the document identifiers,
* a footer of fixed size with the places of index and filter, the counts, the
  CRC-32 of index and filter, and a magic number.

A key is one byte (0 for a null identifier, else 1), the identifier and the
hash of the text, both in big-endian order with the sign flipped, and a running
number for equal rows. Rows with equal identifier and text lie in one range, so
every key is unique over all shards, and shards have one order, by their first
keys. A value is the document's ids as unsigned 16- or 32-bit integers.

Shards are written by the tasks that hold a range of identifiers, each under a
name of its own; the manifest lists the shards of the tasks that succeeded, so
a repeated task leaves no double rows.

Defined results: a null text counts as empty and has only the end id; null
identifiers come first; rows that share an identifier follow one another in the
order of their text's hash, so reruns give equal starts; an empty table gives
no shard and an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvane.llm.store import lasting_uri, settle, small_batches, table
from corvane.llm.textkit import slices
from corvane.llm.tokens import encoder

MAGIC = b"CVSSTAB1"
_FOOTER = struct.Struct("<QQQQQQII8s")
#: Bytes of a block before compression, and Bloom filter bits a document.
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 10, 6
END_ID = 2
#: Bytes of text that a shard holds, about.
SHARD_BYTES = 64 << 20


#: Bytes of a key that tell the identifier.
_ID_BYTES = 9
#: Tasks that read shards, at most; each reads several beyond that.
MOST_READERS = 10_000


def key_of(doc_id: int | None, tie: int = -(2**63), nth: int = 0) -> bytes:
    """Key of a row; without tie and nth the least key of its identifier."""
    own = b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)
    return own + struct.pack(">QI", tie + 2**63, nth)


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:9])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return n, at
        shift += 7


def _bloom_spots(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a * 0x9E3779B1 + k * b) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard to a binary stream; entries come in ascending key order."""

    def __init__(self, out, wide: bool = False):
        self.out, self.at = out, 0
        self.type = "<u4" if wide else "<u2"
        self.block, self.block_first, self.last = bytearray(), b"", b""
        self.index: list[bytes] = []
        self.ids: list[bytes] = []
        self.docs = self.tokens = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, tokens: np.ndarray) -> None:
        value = tokens.astype(self.type).tobytes()
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.block_first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        if not self.ids or self.ids[-1] != key[:_ID_BYTES]:
            self.ids.append(key[:_ID_BYTES])
        self.docs += 1
        self.tokens += len(tokens)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.block:
            packed = self.zstd.compress(bytes(self.block))
            self.index.append(_varint(len(self.block_first)) + self.block_first + _varint(self.at) + _varint(len(packed)))
            self._put(packed)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.ids) * BLOOM_BITS)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.ids:
            for spot in _bloom_spots(key, bits):
                bloom[spot >> 3] |= 1 << (spot & 7)
        index_at = self.at
        self._put(index)
        self._put(bloom.tobytes())
        self._put(_FOOTER.pack(index_at, len(index), index_at + len(index), bits, self.docs, self.tokens, int(self.type[2]), zlib.crc32(index + bloom.tobytes()), MAGIC))


class ShardReader:
    """Reads a shard from a seekable stream: whole, or one identifier by Bloom filter and binary search."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - _FOOTER.size)
        index_at, index_size, bloom_at, self.bits, self.docs, self.tokens, width, crc, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.type = f"<u{width}"
        file.seek(index_at)
        both = file.read(size - _FOOTER.size - index_at)
        if zlib.crc32(both) != crc:
            raise ValueError("damaged index")
        index, self.bloom = both[:index_size], both[index_size:]
        self.firsts, self.places, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.firsts.append(index[at : at + n])
            at += n
            place, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            self.places.append((place, length))
        self.zstd = zstandard.ZstdDecompressor()

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        place, length = self.places[k]
        self.file.seek(place)
        data = self.zstd.decompress(self.file.read(length))
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, self.type, size // int(self.type[2]), at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.places)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier."""
        prefix = key_of(doc_id)[:_ID_BYTES]
        if not all(self.bloom[s >> 3] >> (s & 7) & 1 for s in _bloom_spots(prefix, self.bits)):
            return []
        out, k = [], max(0, bisect_right(self.firsts, key_of(doc_id)) - 1)
        while k < len(self.places) and self.firsts[k][:_ID_BYTES] <= prefix:
            out += [v for key, v in self._block(k) if key[:_ID_BYTES] == prefix]
            k += 1
        return out


def write_shards(docs: DataFrame, uri: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards below ``uri``; returns the settled manifest (path, first, docs, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(uri)
        name, coder, end = uuid.uuid4().hex, encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        wide = max(coder.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        rows, writer, held, part = [], None, 0, 0
        last, nth = None, 0

        def finish() -> None:
            writer.close()
            writer.out.close()
            files.move(f"{root}/{name}-{part}.part", f"{root}/{name}-{part}.sst")
            rows.append((f"{root}/{name}-{part}.sst", first, writer.docs, writer.tokens))

        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc_id, tie, text, ids in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), texts, coder.encode_many(texts)):
                    nth = nth + 1 if (doc_id, tie) == last else 0
                    last = doc_id, tie
                    if writer is None:
                        files.create_dir(root, recursive=True)
                        first = key_of(doc_id, tie, nth)
                        writer = ShardWriter(files.open_output_stream(f"{root}/{name}-{part}.part"), wide)
                    writer.add(key_of(doc_id, tie, nth), np.frombuffer(ids + end, "<u4"))
                    held += len(text)
                    if held >= SHARD_BYTES:
                        finish()
                        writer, held, part = None, 0, part + 1
        if writer is not None:
            finish()
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=["path", "first", "docs", "tokens"])

    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    ranged = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return settle(ranged.mapInArrow(run, "path string, first binary, docs long, tokens long"), "shards")


def read_shards(manifest: DataFrame, uri: str, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32, and the ids on demand.

    Where a shard begins is the sum of the shards before it: a running sum over
    one row a shard, a shard being some 64 MB of text.
    """
    before = W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    readers = max(1, min(MOST_READERS, manifest.count()))
    listed = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")).repartition(readers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_file(path) as file:
                    got: list[tuple] = []
                    for key, ids in ShardReader(file, file.size()):
                        flat = ids.astype("<u4")
                        got.append((id_of(key), at, len(flat), zlib.crc32(flat.tobytes()), flat.tolist() if with_ids else None))
                        at += len(flat)
                        if len(got) >= 4096:
                            yield _batch(got, with_ids)
                            got = []
                    yield _batch(got, with_ids)

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    return pa.record_batch(arrays + ([pa.array([r[4] for r in rows], pa.list_(pa.int64()))] if with_ids else []), names=names + ["ids"] * with_ids)


def lookup(manifest: DataFrame, uri: str, doc_id: int | None) -> list[np.ndarray]:
    """Ids of every document with this identifier: from the last shard that begins before it up to the last that begins with it."""
    low = key_of(doc_id)
    high = low[:_ID_BYTES] + b"\xff" * (len(low) - _ID_BYTES)
    at = manifest.where(F.col("first") <= F.lit(low)).agg(F.max("first")).first()[0]
    held = manifest.where((F.col("first") <= F.lit(high)) & (F.col("first") >= F.lit(bytes(at) if at is not None else low))).orderBy("first")
    files, _ = pafs.FileSystem.from_uri(uri)
    out: list[np.ndarray] = []
    for r in held.toLocalIterator():
        with files.open_input_file(r["path"]) as file:
            out += ShardReader(file, file.size()).get(doc_id)
    return out


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards into the shared folder, where they stay, and read them back: doc_id, start, n_tokens, ids_crc32."""
    uri = lasting_uri(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, uri, tokenizer), uri)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
