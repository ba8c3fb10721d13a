"""Vectorised text kernels over Arrow string buffers.

Texts are handled as the UTF-8 bytes that Arrow already holds: words are found
with a byte table, hashed with a polynomial over random byte codes modulo
2**64, and finished with a mixing step, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# memory goes back to the system when a batch is done; the default pool keeps it
pa.set_memory_pool(pa.system_memory_pool())

_U = np.uint64
_SEED = np.random.default_rng(20240917)
#: Bytes of a word; the separators are 0x20 and 0x09 to 0x0D.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_CODES = _SEED.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
#: Byte codes that take A-Z as a-z.
FOLDED = _CODES.copy()
FOLDED[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLOCK = 1 << 20
_STEP = _SEED.integers(1, 2**63, 64, dtype=_U) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _BLOCK + 1), _powers(_BASE_INV, _BLOCK + 1)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1, null mask) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    nulls = np.asarray(column.is_null())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), nulls
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0], nulls


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, one row at least."""
    _, offs, _ = string_buffers(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _block_ends(data: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of about 1 MB that end at a separator, or where a very long word ends."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + _BLOCK)
        if hi < n:
            back = word[lo:hi][::-1].argmin()
            if not word[hi - 1 - back]:
                hi -= int(back)
            else:
                while hi < n and word[hi]:
                    hi += 1
        yield lo, hi
        lo = hi


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Ends of the characters of scripts that do not put blanks between words (Chinese, Japanese, Thai), before and behind."""
    lead = (data >= 0xE3) & (data <= 0xE9)
    thai = np.flatnonzero(data[:-1] == 0xE0)
    lead[thai] = (data[thai + 1] == 0xB8) | (data[thai + 1] == 0xB9)
    at = np.flatnonzero(lead)
    both = np.unique(np.concatenate([at, at + 3]))
    return both[(both > 0) & (both < len(data))]


class Words:
    """Words of the texts of a buffer: hash, byte span, and first word of each text. With ``unspaced``, a character of a script without blanks is a word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, byte_table: np.ndarray = WORD_BYTE, codes: np.ndarray = FOLDED, unspaced: bool = False):
        word = byte_table[data] if len(data) else np.empty(0, bool)
        edge = np.empty(len(data) + 1, bool)
        if len(data):
            edge[0], edge[-1] = word[0], word[-1]
            np.not_equal(word[1:], word[:-1], out=edge[1:-1])
            inner = offs[(offs > 0) & (offs < len(data))]
            if unspaced:
                inner = np.concatenate([inner, _unspaced(data)])
            split = inner[word[inner] & word[inner - 1]]
            starts = np.flatnonzero(edge[:-1] & word)
            ends = np.flatnonzero(edge[1:] & word) + 1
            if len(split):
                split = np.unique(split)
                starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
        else:
            starts = ends = np.empty(0, np.int64)
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, offs)
        self.hashes = np.empty(len(starts), _U)
        done = 0
        for lo, hi in _block_ends(data, word):
            k = int(np.searchsorted(starts, hi))
            if k > done:
                n = hi - lo
                pow_, inv = (_POW, _INV) if n <= _BLOCK else (_powers(_BASE, n + 1), _powers(_BASE_INV, n + 1))
                sums = np.zeros(n + 1, _U)
                np.cumsum(codes[data[lo:hi]] * pow_[:n], out=sums[1:])
                s, e = starts[done:k] - lo, ends[done:k] - lo
                self.hashes[done:k] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(_U))
            done = k

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes; runs may cross texts, the caller cuts them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, _U)
    out = hashes[:n] * _STEP[0]
    for j in range(1, size):
        out += hashes[j : n + j] * _STEP[j]
    return mix(out + _U(size))


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """Hash of one whole short sequence, told apart from windows of other sizes."""
    return mix((hashes * _STEP[: len(hashes)]).sum(dtype=_U, keepdims=True) + _U(len(hashes)))


def shingle_sets(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; one for a shorter text, none without words."""
    runs = window_hashes(words.hashes, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = b - a
        if n >= size:
            own = np.sort(runs[a : b - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif n:
            yield sequence_hash(words.hashes[a:b])
        else:
            yield np.empty(0, _U)


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position, n + 1 values."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """Hash of the bytes of each span; the spans come in ascending order and do not overlap."""
    out, done = np.empty(len(starts), _U), 0
    while done < len(starts):
        lo = int(starts[done])
        k = max(done + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        n = int(ends[k - 1]) - lo
        pow_, inv = (_POW, _INV) if n <= _BLOCK else (_powers(_BASE, n + 1), _powers(_BASE_INV, n + 1))
        sums = np.zeros(n + 1, _U)
        np.cumsum(codes[data[lo : lo + n]] * pow_[:n], out=sums[1:])
        s, e = starts[done:k] - lo, ends[done:k] - lo
        out[done:k] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(_U))
        done = k
    return out
