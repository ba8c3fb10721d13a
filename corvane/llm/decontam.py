"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit checks.

Texts and items are sequences of folded words; in scripts without blanks between
words (Chinese, Japanese, Thai) every character is a word. The CGK embedding walks over a
sequence with random bits and writes the word it stands on at each step: close
in edit distance becomes close in Hamming distance. Windows of an item's size
are embedded, ``SAMPLED`` positions are read, and a window meets the items of
its size with the same reading; this is repeated until planted edits are met
with probability ``RECALL``. The number of repetitions depends on the item's
length alone: it is found by simulating edits on sequences of that length.
Lengths that would need more than ``MOST_READINGS`` take no readings: the
q-gram bound below is applied item by item, and every place that passes it is
checked, so nothing is missed. Every candidate is checked by its exact edit
distance, which may be ``EDIT_SHARE`` of the item's words at most.

Only windows that can be within that distance are embedded: by the q-gram lemma
such a passage, m + k words at most, holds m - 2 - 3k three-word runs of the items or more.
That bound is exact, so it drops no window that the check would accept.

The items are read in blocks of ``ITEM_BLOCK`` rows and ``ITEM_BYTES`` bytes, each
applied to all texts, so what the driver and a worker hold does not grow with
the benchmark (but for a single longer item).

Defined results: null texts and items, and those without words, match nothing;
items of fewer than ``LEAST_WORDS`` words are found word for word only, without
edits; rows that repeat are reported as often as they come; items that share an
item_id, or have none, are searched each by itself and reported under what they
have. Columns other than doc_id, item_id and text are not read, and the
pipeline form returns them as they come.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import textkit as K
from corvane.llm.licenses import WORD_BYTE
from corvane.llm.store import small_batches, table, through

LEAST_WORDS, EDIT_SHARE = 8, 0.2
#: Embedded positions that one reading joins, wanted recall, share of edited words it is wanted for, most repetitions; beyond them lengths are checked exactly.
SAMPLED, RECALL, PLANNED_EDITS, MOST_READINGS = 3, 0.95, 0.2, 96
#: Edited sequences that the simulation follows, and the step from one planned length to the next.
SIMULATED, LENGTH_STEP = 400, 1.1
ITEM_BLOCK, ITEM_BYTES = 20_000, 32 << 20
Q = 3
#: Places of items' runs that the exact check looks at together.
PLACES = 1 << 21

_U = np.uint64
_END = _U(0xA5A5A5A5A5A5A5A5)


def most_edits(words: int) -> int:
    return int(words * EDIT_SHARE)


def edit_distances(a: list[int], b: list[int], anywhere: bool = False) -> Iterator[int]:
    """Levenshtein distance of ``a`` (not empty) to each non-empty prefix of ``b``, or to the nearest end of it, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(x | plus) & full, plus & x
        score += bool(up & top) - bool(down & top)
        yield score
        up = (up << 1 | (not anywhere)) & full
        down = down << 1 & full
        plus, minus = down | ~((eq | minus) | up) & full, up & (eq | minus)


def nearest(item: list[int], text: list[int]) -> tuple[int, int, int] | None:
    """(edits, start, words) of the passage of ``text`` that is nearest to ``item``, the first and then the shortest of several; none beyond most_edits."""
    ends = list(edit_distances(item, text, anywhere=True))
    edits, m = min(ends, default=len(item)), len(item)
    if edits > most_edits(m):
        return None
    back = item[::-1]
    found = []
    for end in (j for j, e in enumerate(ends, 1) if e == edits):
        before = text[max(0, end - m - edits) : end][::-1]
        found += [(end - n, n) for n, e in enumerate(edit_distances(back, before), 1) if e == edits]
    return edits, *min(found)


class Walk:
    """One CGK walk and the positions that are read from it."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(1, 2**63, 1, dtype=_U)[0]
        self.spots = (np.arange(SAMPLED) + rng.random(SAMPLED)) / SAMPLED
        self.mixers = rng.integers(1, 2**63, SAMPLED, dtype=_U) * _U(2) + _U(1)

    def at(self, size: int) -> list[int]:
        """Steps that are read for sequences of ``size`` words: within the part of the walk that surely has words."""
        return (self.spots * 1.9 * size).astype(int).tolist()

    def embed(self, words: np.ndarray, starts: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, word) that the walk from each start stands on, at each step; it may run beyond the window."""
        place, out = starts.copy(), np.empty((steps, len(starts)), _U)
        index = np.empty((steps, len(starts)), np.int64)
        last = len(words) - 1
        for j in range(steps):
            inside = np.minimum(place, last)
            w = words[inside]
            out[j], index[j] = w, place
            bit = ((w ^ _U((int(self.salt) + j * 0x9E3779B97F4A7C15) % 2**64)) * _U(0xD6E8FEB86659FD93)) >> _U(63)
            place = place + bit.astype(np.int64)
        return index, out

    def whole(self, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Readings of the windows of ``size`` words at ``starts``."""
        index, out = self.embed(words, starts, max(self.at(size)) + 1)
        return self.read(index, out, starts, np.arange(len(starts)), size)

    def read(self, index: np.ndarray, out: np.ndarray, starts: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray:
        """Readings of windows of ``size`` words at the chosen columns of an embedding."""
        total = np.zeros(len(columns), _U)
        for m, j in zip(self.mixers, self.at(size)):
            within = index[j, columns] < starts[columns] + size
            total += np.where(within, out[j, columns], _END) * m
        return K.mix(total)


def readings_needed(words: int) -> int:
    """Readings that meet copies of an item of so many words, PLANNED_EDITS of them edited, with probability RECALL; 0 if MOST_READINGS do not."""
    length = LEAST_WORDS
    while length < words:  # the rate falls with length: that of the next planned length is kept
        length = max(length + 1, int(length * LENGTH_STEP))
    return _simulated(length)


@functools.lru_cache(None)
def _simulated(words: int) -> int:
    rng = np.random.default_rng(words)
    wide = 3 * words
    own = rng.integers(1, 2**63, (SIMULATED, wide), dtype=_U)
    copies = rng.integers(1, 2**63, (SIMULATED, wide), dtype=_U)
    for item, copy in zip(own, copies):
        edited = item[:words].tolist()
        for at in rng.permutation(words)[: most_edits(words)].tolist():
            kind, new = int(rng.integers(3)), int(rng.integers(1, 2**63))
            at = min(at, len(edited))
            edited[at : at + (kind != 1)] = [new] * (kind < 2)
        copy[: len(edited)] = edited
    starts, missed = np.arange(SIMULATED) * wide, np.ones(SIMULATED, bool)
    for r in range(MOST_READINGS):
        walk = Walk(1000 + r)
        missed &= walk.whole(own.ravel(), starts, words) != walk.whole(copies.ravel(), starts, words)
        if missed.mean() <= 1 - RECALL:
            return r + 1
    return 0


def words_of(data: np.ndarray, offs: np.ndarray) -> K.Words:
    return K.Words(data, offs, WORD_BYTE, K.FOLDED, unspaced=True)


class Plan:
    """Items of one block: their words, readings, and the walks."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int = 77):
        raw = [(text or "").encode("utf-8", "replace") for _, text in items]
        offs = np.cumsum([0, *map(len, raw)])
        every = words_of(np.frombuffer(b"".join(raw), np.uint8), offs)
        self.items: list[tuple[int | None, np.ndarray]] = []
        for k, (item_id, _) in enumerate(items):
            own = every.hashes[every.first[k] : every.first[k + 1]]
            if len(own):
                self.items.append((item_id, own))
        # short items, by size: hashes of the whole item, sorted, and the items
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, LEAST_WORDS):
            own = np.array([k for k, (_, w) in enumerate(self.items) if len(w) == m], np.int64)
            if len(own):
                whole = np.array([K.window_hashes(self.items[k][1], m)[0] for k in own.tolist()], _U)
                by = np.argsort(whole, kind="stable")
                self.short[m] = whole[by], own[by]
        runs = [K.window_hashes(w, Q) if len(w) >= LEAST_WORDS else np.empty(0, _U) for _, w in self.items]
        self.runs = np.unique(np.concatenate(runs)) if runs else np.empty(0, _U)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.runs & _U((1 << 20) - 1)] = True
        by_size: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) >= LEAST_WORDS:
                by_size.setdefault(len(w), []).append(k)
        readings = {m: readings_needed(m) for m in by_size}
        self.sizes = sorted(m for m, r in readings.items() if r)
        self.walks = [Walk(seed + r) for r in range(max(readings.values(), default=0) or 0)]
        self.tables: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for r, walk in enumerate(self.walks):
            table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for m in self.sizes:
                if r < readings[m]:
                    own = np.array(by_size[m])
                    got = walk.whole(np.concatenate([self.items[k][1] for k in own.tolist()]), np.arange(len(own)) * m, m)
                    by = np.argsort(got, kind="stable")
                    table[m] = got[by], own[by]
            self.tables.append(table)
        # the others: runs of each item, as places in ``runs``
        self.counted = np.array([k for m, own in by_size.items() if not readings[m] for k in own], np.int64)
        held = [np.searchsorted(self.runs, np.unique(runs[k])) for k in self.counted.tolist()]
        self.run_at = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
        self.run_of = np.concatenate(held) if held else np.empty(0, np.int64)

    def _places(self, hits: np.ndarray, doc: np.ndarray, run: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last start) where a passage of the text can hold as many runs of the item as one within its distance must."""
        sizes = np.array([len(self.items[k][1]) for k in self.counted.tolist()])
        edits = (sizes * EDIT_SHARE).astype(np.int64)
        least, most = sizes - Q + 1 - Q * edits, sizes + edits
        by = np.argsort(run, kind="stable")
        held = np.bincount(run, minlength=len(self.runs))
        begin = np.cumsum(held) - held
        weight = np.diff(np.concatenate([[0], np.cumsum(held[self.run_of])])[self.run_at])
        likely = np.flatnonzero(weight >= least)
        while len(likely):
            n = max(1, int(np.searchsorted(np.cumsum(weight[likely]), PLACES, "right")))
            part, likely = likely[:n], likely[n:]
            size = self.run_at[part + 1] - self.run_at[part]
            runs = self.run_of[np.repeat(self.run_at[part] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            times, item = held[runs], np.repeat(part, size)
            flat = by[np.repeat(begin[runs] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            item = np.repeat(item, times)
            order = np.lexsort((flat, item))
            flat, item = flat[order], item[order]
            at, own = hits[flat], doc[flat]
            far = np.arange(len(at)) + least[item] - 1
            far_in = np.minimum(far, len(at) - 1)
            fit = (far < len(at)) & (item[far_in] == item) & (own[far_in] == own) & (at[far_in] - at <= most[item] - Q)
            if not fit.any():
                continue
            a, b, own, item = at[fit], at[far_in[fit]], own[fit], item[fit]
            lo = np.maximum(b - (most[item] - Q), firsts[own])
            new = np.concatenate([[True], (item[1:] != item[:-1]) | (own[1:] != own[:-1]) | (lo[1:] > a[:-1] + 1)])
            last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])
            yield from zip(own[new].tolist(), self.counted[item[new]].tolist(), lo[new].tolist(), a[last].tolist())

    def _verbatim(self, words: np.ndarray, firsts: np.ndarray) -> dict[tuple[int, int], int]:
        """First place of each short item in each text: (text, item) to word."""
        out: dict[tuple[int, int], int] = {}
        for m, (whole, which) in self.short.items():
            got = K.window_hashes(words, m)
            left, right = np.searchsorted(whole, got, "left"), np.searchsorted(whole, got, "right")
            at = np.flatnonzero(right > left)
            doc = np.searchsorted(firsts, at, "right") - 1
            inside = at + m <= firsts[doc + 1]
            for start, d in zip(at[inside].tolist(), doc[inside].tolist()):
                for k in which[left[start] : right[start]].tolist():
                    out.setdefault((d, k), start)
        return out

    def search(self, words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Best match of each item in each text: (text, item, first word, words, edits)."""
        found = [(d, k, start - int(firsts[d]), len(self.items[k][1]), 0) for (d, k), start in self._verbatim(words, firsts).items()]
        return sorted(found + self._edited(words, firsts))

    def _edited(self, words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        grams = K.window_hashes(words, Q)
        likely = np.flatnonzero(self.bitmap[grams & _U((1 << 20) - 1)]) if len(self.runs) else np.empty(0, np.int64)
        if not len(likely):
            return []
        at = np.minimum(np.searchsorted(self.runs, grams[likely]), len(self.runs) - 1)
        known = self.runs[at] == grams[likely]
        hits, run = likely[known], at[known]
        doc = np.searchsorted(firsts, hits, "right") - 1
        inside = hits + Q <= firsts[doc + 1]
        hits, doc, run = hits[inside], doc[inside], run[inside]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, lo, hi in self._places(hits, doc, run, firsts) if len(self.counted) else ():
            item = self.items[k][1]
            stop = min(hi + len(item) + most_edits(len(item)), int(firsts[d + 1]))
            got = nearest(item.tolist(), words[lo:stop].tolist())
            if got:
                found = (got[0], lo + got[1], got[2])
                best[d, k] = min(best.get((d, k), found), found)
        starts_of: dict[int, np.ndarray] = {}
        for m in self.sizes:
            least = m - Q + 1 - Q * most_edits(m)
            if len(hits) < least:
                continue
            a, b = hits[: len(hits) - least + 1], hits[least - 1 :]
            most = m + most_edits(m)
            fit = (b - a <= most - Q) & (doc[: len(a)] == doc[least - 1 :])
            if not fit.any():
                continue
            # starts whose longest passage holds both ends
            lo, hi, own = b[fit] - (most - Q), a[fit], doc[: len(a)][fit]
            lo = np.maximum(lo, firsts[own])
            hi = np.minimum(hi, np.maximum(firsts[own + 1] - m + most_edits(m), firsts[own]))
            width = np.maximum(0, hi - lo + 1)
            flat = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
            starts_of[m] = np.unique(flat)
        starts = np.unique(np.concatenate(list(starts_of.values()))) if starts_of else np.empty(0, np.int64)
        columns = {m: np.searchsorted(starts, s) for m, s in starts_of.items()}
        met: set[tuple[int, int]] = set()
        for walk, tables in zip(self.walks, self.tables):
            longest = max((m for m in columns if m in tables), default=0)
            if not longest:
                continue
            for lo in range(0, len(starts), 1 << 15):
                part = starts[lo : lo + (1 << 15)]
                index, out = walk.embed(words, part, max(walk.at(longest)) + 1)
                for m, own in columns.items():
                    if m not in tables:
                        continue
                    cols = own[(own >= lo) & (own < lo + len(part))] - lo
                    readings, which = tables[m]
                    got = walk.read(index, out, part, cols, m)
                    left, right = np.searchsorted(readings, got, "left"), np.searchsorted(readings, got, "right")
                    for c in np.flatnonzero(right > left).tolist():
                        met.update((int(part[cols[c]]), int(which[k])) for k in range(left[c], right[c]))
        for start, k in sorted(met):
            d = int(np.searchsorted(firsts, start, "right")) - 1
            item = self.items[k][1]
            m = len(item)
            stop = min(start + m + most_edits(m), int(firsts[d + 1]))
            edits, size = min((e, n) for n, e in enumerate(edit_distances(item.tolist(), words[start:stop].tolist()), 1))
            if edits <= most_edits(m) and (edits, start, size) < best.get((d, k), (m + 1, 0, 0)):
                best[d, k] = (edits, start, size)
        return [(d, k, start - int(firsts[d]), n, edits) for (d, k), (edits, start, n) in best.items()]


def _plans(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast plans of the blocks of items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEM_BLOCK), -(-size["bytes"] // ITEM_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield docs.sparkSession.sparkContext.broadcast(Plan(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, first_word, n_words, edits, similarity."""
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, item_id long, first_word long, n_words long, edits long, similarity double"
    found = None
    for sent in _plans(docs, benchmark):
        part = own.mapInArrow(_finder(sent), fields)
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; each row is judged by its own text, without a shuffle."""
    for sent in _plans(docs, benchmark):
        docs = through(docs, _cleaner(sent))
    return docs


def _cleaner(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = sent.value
        for whole in batches:
            for batch in K.slices(whole, "text"):
                data, offs, _ = K.string_buffers(batch.column("text"))
                words = words_of(data, offs)
                keep = np.ones(batch.num_rows, bool)
                keep[[g[0] for g in plan.search(words.hashes, words.first)] if plan.items else []] = False
                yield batch.filter(pa.array(keep))

    return run


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = sent.value
        for whole in batches:
            for batch in K.slices(whole, "text"):
                data, offs, _ = K.string_buffers(batch.column("text"))
                words = words_of(data, offs)
                got = plan.search(words.hashes, words.first) if plan.items else []
                ids = batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                numbers = [pa.array([g[k] for g in got], pa.int64()) for k in (2, 3, 4)]
                share = [1 - g[4] / len(plan.items[g[1]][1]) for g in got]
                yield pa.record_batch([ids, pa.array([plan.items[g[1]][0] for g in got], pa.int64()), *numbers, pa.array(share, pa.float64())], names=["doc_id", "item_id", "first_word", "n_words", "edits", "similarity"])

    return run


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
