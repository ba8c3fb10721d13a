"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence.

A document is the set of its distinct five-word shingles; two documents link
when 100 * |A and B| >= 75 * |A or B|. The join returns every document's
component and the number of its links, without writing pairs inside groups of
copies to any table:

1. ``facts``: set size, set fingerprint and min-hash bands of every document,
   and the shingles that are frequent somewhere. Equal sets become one class.
2. Classes that share a band are compared with the band's pivots, so a group of n
   near copies costs a few times n exact comparisons. Classes that these links
   connect carry one label.
3. The incidence of each class is cut to the columns that any partner must share
   (the first |A| - ceil(0.75 |A|) + 1 shingles in a fixed order, rare first),
   dealt into column blocks and multiplied block by block. Pairs with one label
   are known to be connected already and are not made; the others accumulate
   their overlap over the blocks and are dropped below the bound that the two
   sizes and last columns give.
4. What is left is verified with whole sets. The components of all links are
   found by star contraction.
5. Links inside labels are counted exactly: the sets of a label are dealt into
   tiles, and each pair of tiles is one product of incidence matrices. Links of
   classes count for all rows of them. The work grows with the square of a group.

The order of shingles decides only the amount of work, never the result: the
list of frequent shingles has a fixed largest size and may be incomplete.

Defined results: a null or empty text has size 0, is its own component and has no links; a
row whose doc_id is null keeps its row, and its component is the smallest
non-null doc_id that it reaches (null if none); repeated rows are returned as
often as they come. Columns other than doc_id and text are not read.
Classes are told apart by 64-bit set fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvane.llm import textkit as K
from corvane.llm.components import component_labels
from corvane.llm.store import columns, settle, small_batches, table

SHINGLE = 5
#: Threshold NUM / DEN.
NUM, DEN = 75, 100
#: Bands of two min-hashes each, pivots of a band, and min-hashes that a class and its pivot must share to be compared.
BANDS, PIVOTS, AGREE = 8, 3, 9
#: Rows of the list of frequent shingles, at most (8 bytes each, broadcast). Frequent columns beyond it make more pairs to verify, not other results.
FREQUENT = 1 << 20
#: Shingle hashes that a worker looks at together for frequent ones.
GATHER = 1 << 21
#: Columns' entries in a block, about.
BLOCK_ENTRIES = 1 << 21
#: Bits of the filter that spares shuffling sets that no pair needs: so many for each wanted set, at least and at most (as powers of two); beyond that, more sets pass.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 16, 20, 28
#: Entries of a tile of a label: a 64th of the label's, but within these bounds; and classes on one side of a matrix that a worker makes.
LEAST_TILE, TILE_ENTRIES, TILES, SIDE = 1 << 16, 1 << 20, 64, 512

_U = np.uint64
_PERM = np.random.default_rng(7).integers(1, 2**63, (2 * BANDS, 2), dtype=_U) * _U(2) + _U(1)
_FACTS = "doc_id long, key long, n long, node long, mins array<int>, hot long, cnt long"


def _id_column(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("doc_id").cast(pa.int64())


def _fingerprint(own: np.ndarray) -> np.uint64:
    size = np.array([len(own) * 0x632BE59BD9B4E019 % 2**64], _U)
    return K.mix((own.sum(dtype=_U, keepdims=True) + size) ^ np.bitwise_xor.reduce(K.mix(own), keepdims=True))[0]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pool: list[np.ndarray] = []
    held, seen = 0, set()

    def frequent() -> pa.RecordBatch:
        # a shingle that three different sets of the pool hold
        every = np.sort(np.concatenate(pool))
        at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        cnt = np.diff(np.concatenate([at, [len(every)]]))
        few = cnt >= 3
        hot, cnt = every[at][few].view(np.int64), cnt[few]
        none = pa.nulls(len(hot), pa.int64())
        return pa.record_batch([none, none, none, none, pa.nulls(len(hot), pa.list_(pa.int32())), pa.array(hot), pa.array(cnt.astype(np.int64))], names=["doc_id", "key", "n", "node", "mins", "hot", "cnt"])

    for whole in batches:
        for batch in K.slices(whole, "text"):
            data, offs, _ = K.string_buffers(batch.column("text"))
            n, node, mins = [], [], []
            for own in K.shingle_sets(K.Words(data, offs), SHINGLE):
                n.append(len(own))
                if not len(own):
                    node.append(None)
                    mins.append(None)
                    continue
                fp = int(_fingerprint(own).view(np.int64))
                node.append(fp)
                low = [int((((own * a) ^ (own >> _U(29))) * b).min() >> _U(33)) for a, b in _PERM]
                mins.append(low)
                if fp not in seen:
                    seen.add(fp)
                    pool.append(own)
                    held += len(own)
                    if held >= GATHER:
                        yield frequent()
                        pool.clear()
                        seen.clear()
                        held = 0
            yield pa.record_batch([_id_column(batch), batch.column("key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(mins, pa.list_(pa.int32())), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names=["doc_id", "key", "n", "node", "mins", "hot", "cnt"])
    if pool:
        yield frequent()


def needed(n: int) -> int:
    """Least overlap of a set of n with any partner: ceil(n * NUM / DEN)."""
    return -(-n * NUM // DEN)


class _Order:
    """Fixed order of shingles: all others by hash, then the frequent ones, rarest first."""

    def __init__(self, hot: np.ndarray):
        # hot: hashes, most frequent first
        self.order = np.argsort(hot)
        self.hot = hot[self.order]
        self.rank = (_U(1) << _U(63)) + (len(hot) - 1 - self.order).astype(_U)

    def keys(self, own: np.ndarray) -> np.ndarray:
        out = own >> _U(1)
        if len(self.hot):
            at = np.searchsorted(self.hot, own)
            at[at == len(self.hot)] = 0
            hit = self.hot[at] == own
            out[hit] = self.rank[at[hit]]
        return np.sort(out)


def _prefixes(hot_sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = _Order(hot_sent.value), set()
        for whole in batches:
            for batch in K.slices(whole, "text"):
                data, offs, _ = K.string_buffers(batch.column("text"))
                node, n, last, keys = [], [], [], []
                for own in K.shingle_sets(K.Words(data, offs), SHINGLE):
                    if not len(own):
                        continue
                    fp = int(_fingerprint(own).view(np.int64))
                    if fp in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(fp)
                    cut = order.keys(own)[: len(own) - needed(len(own)) + 1]
                    node.append(fp)
                    n.append(len(own))
                    last.append(int(cut[-1].view(np.int64)))
                    keys.append(cut.tobytes())
                yield pa.record_batch([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(last, pa.int64()), pa.array(keys, pa.binary())], names=["node", "n", "last", "keys"])

    return run


def _deal(blocks: int, flush: int = 1 << 20):
    """Entries of many classes, packed by column block: one row for a block and a few thousand classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            nodes = np.array([r[0] for r in rows], np.int64)
            ns = np.array([r[1] for r in rows], np.int64)
            lasts = np.array([r[2] for r in rows], np.int64)
            labels = np.array([r[3] for r in rows], np.int64)
            lens = np.array([len(r[4]) for r in rows])
            keys = np.concatenate([r[4] for r in rows])
            doc = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
            spread = K.mix(keys)
            block = (spread >> _U(32)) % _U(blocks)
            by = np.argsort(block, kind="stable")
            ends = np.searchsorted(block[by], np.arange(blocks + 1, dtype=_U))
            got = {k: [] for k in ("block", "keys", "doc", "node", "n", "last", "label")}
            for b in range(blocks):
                own = by[ends[b] : ends[b + 1]]
                if not len(own):
                    continue
                docs, local = np.unique(doc[own], return_inverse=True)
                got["block"].append(b)
                got["keys"].append((spread[own] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes())
                got["doc"].append(local.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32).tobytes())
                got["node"].append(nodes[docs].tobytes())
                got["n"].append(ns[docs].astype(np.uint32).tobytes())
                got["last"].append((lasts[docs].view(_U) >> _U(32)).astype(np.uint32).tobytes())
                got["label"].append(labels[docs].tobytes())
            return pa.record_batch([pa.array(got["block"], pa.int64()), *(pa.array(got[k], pa.binary()) for k in ("keys", "doc", "node", "n", "last", "label"))], names=list(got))

        for batch in batches:
            for node, n, last, keys, label in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "last", "keys", "label"))):
                own = np.frombuffer(keys, _U)
                rows.append((node, n, last, label, own))
                held += len(own)
                if held >= flush or len(rows) >= 60000:
                    yield out()
                    rows.clear()
                    held = 0
        if rows:
            yield out()

    return run


def _pairs_of_runs(doc, at, length, n, label, emit) -> None:
    """All pairs of different labels and fitting sizes within runs of equal columns."""
    for size in np.unique(length):
        of = at[length == size]
        if size <= 48:
            left, right = np.triu_indices(int(size), 1)
            step = max(1, (1 << 20) // len(left))
            for k in range(0, len(of), step):
                who = doc[of[k : k + step, None] + np.arange(size)]
                a, b = who[:, left].ravel(), who[:, right].ravel()
                emit(a, b)
            continue
        for start in of.tolist():
            who = doc[start : start + size]
            lab = label[who]
            if (lab == lab[0]).all():
                continue
            who = who[np.argsort(n[who], kind="stable")]
            sizes, lab = n[who], label[who]
            ends = np.searchsorted(sizes * NUM, sizes * DEN, "right")
            for i, e in enumerate(ends.tolist()):
                other = who[i + 1 : e][lab[i + 1 : e] != lab[i]]
                if len(other):
                    emit(np.full(len(other), who[i]), other)


def _multiply(key: tuple, parts: pa.Table) -> pa.Table:
    """One block of the product: for each class its row, the partners and their overlap inside the block."""
    keys, docs, nodes, ns, lasts, labels, base = [], [], [], [], [], [], 0
    for row in parts.to_pylist():
        k = np.frombuffer(row["keys"], np.uint32)
        d = np.frombuffer(row["doc"], np.uint16 if len(row["doc"]) == 2 * len(k) else np.uint32)
        keys.append(k)
        docs.append(d.astype(np.int64) + base)
        nodes.append(np.frombuffer(row["node"], np.int64))
        ns.append(np.frombuffer(row["n"], np.uint32).astype(np.int64))
        lasts.append(np.frombuffer(row["last"], np.uint32))
        labels.append(np.frombuffer(row["label"], np.int64))
        base += len(nodes[-1])
    keys, docs, nodes, n, last, label = map(np.concatenate, (keys, docs, nodes, ns, lasts, labels))
    by = np.argsort(keys, kind="stable")
    keys, docs = keys[by], docs[by]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.concatenate([at, [len(keys)]]))
    many = length > 1
    found: list[np.ndarray] = []
    sums: list[tuple[np.ndarray, np.ndarray]] = []
    wide = np.int64(len(nodes))

    def pack() -> None:
        if found:
            pair, cnt = np.unique(np.concatenate(found), return_counts=True)
            sums.append((pair, cnt))
            found.clear()

    held = 0

    def emit(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal held
        keep = (label[a] != label[b]) & (np.minimum(n[a], n[b]) * DEN >= np.maximum(n[a], n[b]) * NUM)
        a, b = a[keep], b[keep]
        if len(a):
            found.append(np.minimum(a, b) * wide + np.maximum(a, b))
            held += len(a)
            if held > 1 << 22:
                pack()
                held = 0

    _pairs_of_runs(docs, at[many], length[many], n, label, emit)
    pack()
    if sums:
        pair, inverse = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
        cnt = np.bincount(inverse, np.concatenate([s[1] for s in sums]).astype(float)).astype(np.int64)
    else:
        pair = cnt = np.empty(0, np.int64)
    a, b = pair // wide, pair % wide
    swap = nodes[a] > nodes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    by = np.lexsort((b, a))
    a, b, cnt = a[by], b[by], cnt[by]
    at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    packed = {"b": nodes[b], "nb": n[b].astype(np.uint32), "lb": last[b], "overlap": cnt.astype(np.uint32)}
    pieces = {k: pa.array([x.tobytes() for x in np.split(v, at[1:])] if len(a) else [], pa.binary()) for k, v in packed.items()}
    return pa.table({"a": nodes[a[at]], "na": n[a[at]], "la": last[a[at]].astype(np.int64), **pieces})


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the product, added up over the blocks; pairs that reach the bound of their sizes. The rows of one class follow one another."""
    held: list[dict] = []

    def finish(out: list[tuple[int, np.ndarray]]) -> None:
        if not held:
            return
        b, nb, lb, overlap = (np.concatenate([np.frombuffer(r[k], t) for r in held]) for k, t in (("b", np.int64), ("nb", np.uint32), ("lb", np.uint32), ("overlap", np.uint32)))
        b, at, inverse = np.unique(b, return_index=True, return_inverse=True)
        total = np.bincount(inverse, overlap, len(b)).astype(np.int64)
        na, la, nb, lb = held[0]["na"], held[0]["la"], nb[at].astype(np.int64), lb[at].astype(np.int64)
        rest_a, rest_b = needed(na) - 1, -(-nb * NUM // DEN) - 1  # columns behind the prefix
        most = total + np.where(la < lb, rest_a, np.where(la > lb, rest_b, np.maximum(rest_a, rest_b)))
        out.append((held[0]["a"], b[most * (NUM + DEN) >= NUM * (na + nb)]))
        held.clear()

    def batch_of(out: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        a = np.concatenate([np.full(len(b), x, np.int64) for x, b in out] or [np.empty(0, np.int64)])
        b = np.concatenate([b for _, b in out] or [np.empty(0, np.int64)])
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        out: list[tuple[int, np.ndarray]] = []
        for row in batch.to_pylist():
            if held and held[0]["a"] != row["a"]:
                finish(out)
            held.append(row)
        yield batch_of(out)
    out = []
    finish(out)
    yield batch_of(out)


def _filter_bits(wanted: DataFrame, n: int) -> np.ndarray:
    """Bit filter over column ``h`` (long) of ``n`` rows."""
    bits = 1 << min(FILTER_MOST, max(FILTER_LEAST, (FILTER_SHARE * n).bit_length()))
    spots = wanted.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 24))).alias("h")).select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, _U)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(_U)
    return out


def _row_code(node: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return K.mix(node.view(_U) ^ (doc_id.view(_U) * _U(0x9E3779B97F4A7C15) + _U(1)))


def _sets(bits_sent):
    """Whole sets of the rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bits_sent.value, set()
        mask = 64 * len(bits) - 1
        for whole in batches:
            for batch in K.slices(whole, "text"):
                data, offs, _ = K.string_buffers(batch.column("text"))
                ids = _id_column(batch).fill_null(-(2**63) + 1).to_numpy(zero_copy_only=False)
                got: list[tuple[int, int, bytes]] = []
                for doc_id, own in zip(ids, K.shingle_sets(K.Words(data, offs), SHINGLE)):
                    if len(own):
                        fp = _fingerprint(own)
                        h = int(_row_code(np.array([fp], _U), np.array([doc_id], np.int64))[0])
                        if all(int(bits[(s & mask) >> 6]) >> (s & 63) & 1 for s in (h, h >> 24)) and (fp := int(fp.view(np.int64))) not in seen:
                            if len(seen) < 1 << 20:
                                seen.add(fp)
                            got.append((fp, len(own), own.tobytes()))
                yield pa.record_batch([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], names=["node", "n", "items"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        ids, sides = (batch.column(c).to_numpy() for c in ("a", "b")), [batch.column(c) for c in ("items_a", "items_b")]
        for k, (a, b) in enumerate(zip(*(x.tolist() for x in ids))):
            x, y = (np.frombuffer(side[k].as_buffer(), _U) for side in sides)  # no copies
            both = np.sort(np.concatenate([x, y]))
            overlap = int((both[1:] == both[:-1]).sum())
            if DEN * overlap >= NUM * (len(x) + len(y) - overlap):
                us.append(a)
                vs.append(b)
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column("node").to_numpy(zero_copy_only=False)
        doc_id = batch.column("doc_id").fill_null(-(2**63) + 1).to_numpy(zero_copy_only=False)
        yield pa.record_batch([pa.array(_row_code(node, doc_id).view(np.int64))], names=["h"])


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, by whole sets. ``pairs`` is a settled table."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = ends.join(classes.select("node", "doc_id"), "node").mapInArrow(_codes, "h long")
    bits = spark.sparkContext.broadcast(_filter_bits(wanted, 2 * pairs.count()))
    sets = docs.select("doc_id", "text").mapInArrow(_sets(bits), "node long, n long, items binary")
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")).hint("merge"), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")).hint("merge"), "a")
    return two.select("a", "b", "items_a", "items_b").mapInArrow(_verify, "u long, v long").distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap of each set of ``left`` with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])) for own in (left, right)]
    columns = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for items, row in sides:
        at = np.minimum(np.searchsorted(columns, items), len(columns) - 1) if len(columns) else np.empty(0, np.int64)
        hit = np.flatnonzero(columns[at] == items) if len(columns) else at
        by = hit[np.argsort(at[hit], kind="stable")]
        placed.append((at[by], row[by]))
    for lo in range(0, len(columns), 4096):
        dense = []
        for (at, row), own in zip(placed, (left, right)):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            matrix = np.zeros((len(own), min(4096, len(columns) - lo)), np.float32)
            matrix[row[a:b], at[a:b] - lo] = 1
            dense.append(matrix)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)  # exact: sets have fewer than 2**24 shingles


def _count_inside(key: tuple, parts: pa.Table) -> pa.Table:
    """Rows that each class links to inside its label: the pairs of one tile, or of two."""
    _, i, j = (k.as_py() for k in key)
    label, tile, node, copies = (parts.column(c).to_numpy() for c in ("label", "tile", "node", "n_copies"))
    items = [np.frombuffer(x, _U) for x in parts.column("items").to_pylist()]
    n = np.array([len(x) for x in items], np.int64)
    links = np.zeros(len(node), np.int64)
    order = np.lexsort((n, label))
    for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        one, two = (np.split(side, range(SIDE, len(side), SIDE)) for side in (own[tile[own] == i], own[tile[own] == j]))
        for p, a in enumerate(one):
            for b in two[p:] if i == j else two:
                if not len(a) or not len(b) or min(n[a[-1]], n[b[-1]]) * DEN < max(n[a[0]], n[b[0]]) * NUM:
                    continue
                both = _overlaps([items[x] for x in a], [items[x] for x in b])
                linked = DEN * both >= NUM * (n[a][:, None] + n[b] - both)
                if i == j and a[0] == b[0]:
                    np.fill_diagonal(linked, False)
                    links[a] += linked @ copies[b]
                else:
                    links[a] += linked @ copies[b]
                    links[b] += copies[a] @ linked
    some = links > 0
    return pa.table({"node": node[some], "links": links[some]})


def _inside(docs: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, links): the rows that each class links to among the classes of its label."""
    spark = docs.sparkSession
    own = classes.select("node", "doc_id", "n", "n_copies").join(labels.hint("merge"), "node")
    sums = own.groupBy("label").agg(F.sum("n").alias("entries")).withColumn("tiles", F.ceil(F.col("entries") / F.least(F.greatest(F.col("entries") / TILES, F.lit(LEAST_TILE)), F.lit(TILE_ENTRIES))))
    packs = -(-(sums.agg(F.sum("entries")).first()[0] or 0) // LEAST_TILE) + 1
    bits = spark.sparkContext.broadcast(_filter_bits(own.mapInArrow(_codes, "h long"), labels.count()))
    sets = docs.select("doc_id", "text").mapInArrow(_sets(bits), "node long, n long, items binary").dropDuplicates(["node"]).select("node", "items")
    tiled = own.join(sums.hint("merge"), "label").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles")).select("node", "n_copies", "label", "tiles", "tile")
    dealt = tiled.join(sets.hint("merge"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    # labels of one tile share a task by their hash
    dealt = dealt.select(F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("label"), F.lit(packs))).otherwise(F.col("label")).alias("pack"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "label", "tile", "node", "n_copies", "items")
    return dealt.groupBy("pack", "i", "j").applyInArrow(_count_inside, "node long, links long")


def _stars(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with pivots of their bands: a few for each class, whatever the size of its group.

    Pivots are the classes that share their bands with the most others: near
    copies differ most from one another and least from the text they come from.
    """
    signs = F.array(*(F.xxhash64(F.lit(k), F.col("mins")[2 * k], F.col("mins")[2 * k + 1]) for k in range(BANDS)))
    banded = classes.select("node", "n", F.explode(signs).alias("sign"))
    held = banded.groupBy("sign").agg(F.count("*").alias("held")).where("held > 1")
    shared = settle(banded.join(held.hint("merge"), "sign"), "bands")
    central = shared.groupBy("node").agg(F.sum("held").alias("central"))
    order = W.partitionBy("sign").orderBy(F.desc("central"), "node")
    ranked = shared.join(central.hint("merge"), "node").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PIVOTS)
    # settled, so that both sides of the next join are dealt anew and a band that a whole group shares can be split
    pivots = settle(ranked.select("sign", F.col("node").alias("pivot"), F.col("n").alias("pivot_n")), "pivots")
    fits = (F.col("pivot") != F.col("node")) & (F.least("n", "pivot_n") * DEN >= F.greatest("n", "pivot_n") * NUM)
    # bands that two classes share, of all their bands, estimate how like they are
    met = shared.join(pivots.hint("merge"), "sign").where(fits).groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).agg(F.count("*").alias("bands"))
    mins = classes.select("node", "mins")
    sided = met.join(mins.select(F.col("node").alias("a"), F.col("mins").alias("mins_a")).hint("merge"), "a").join(mins.select(F.col("node").alias("b"), F.col("mins").alias("mins_b")).hint("merge"), "b")
    alike = F.size(F.filter(F.zip_with("mins_a", "mins_b", lambda x, y: x == y), lambda same: same))
    return sided.where(alike >= AGREE).select("a", "b")


def _components(docs: DataFrame, count: bool) -> tuple[DataFrame, DataFrame]:
    """Facts of the rows, and (node, component_id, n_copies, keeper: the row that stands for the component) of the classes; n_links too if it is to ``count`` them."""
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = settle(docs.withColumn("key", F.xxhash64("text")).mapInArrow(_facts, _FACTS), "facts")
    facts = rows.where("hot IS NULL").select("doc_id", "key", "n", "node", "mins")
    classes = settle(facts.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("lead"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.count("*").alias("n_copies")), "classes")

    stars = settle(_stars(classes), "stars")
    first = settle(_links(docs, classes, stars), "links")
    labels = settle(component_labels(first).withColumnRenamed("component", "label"), "labels")

    # the product, block by block
    hot = rows.where("hot IS NOT NULL").groupBy("hot").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "hot").limit(FREQUENT).select("hot").toPandas()["hot"].to_numpy(np.int64).view(_U)
    total = classes.agg(F.sum("n")).first()[0] or 0
    blocks = max(8, -(-total * (DEN - NUM) // DEN // BLOCK_ENTRIES))
    sent = spark.sparkContext.broadcast(hot)
    prefix = docs.mapInArrow(_prefixes(sent), "node long, n long, last long, keys binary")
    own = prefix.groupBy("node").agg(F.first("n").alias("n"), F.first("last").alias("last"), F.first("keys").alias("keys"))
    labelled = own.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    dealt = labelled.mapInArrow(_deal(int(blocks)), "block long, keys binary, doc binary, node binary, n binary, last binary, label binary")
    made = dealt.groupBy("block").applyInArrow(_multiply, "a long, na long, la long, b binary, nb binary, lb binary, overlap binary")
    pairs = made.repartition("a").sortWithinPartitions("a").mapInArrow(_bounded, "a long, b long")
    left = settle(pairs, "pairs")
    second = settle(_links(docs, classes, left), "links")

    names = component_labels(first.unionByName(second))
    of = classes.join(names.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")).select("node", "doc_id", "lead", "component", "n_copies")
    lowest = of.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("lead").alias("keeper"))
    of = of.join(lowest, "component").select("node", "component_id", "n_copies", "keeper")
    if count:
        copies = classes.select("node", "n_copies")
        both = second.select(F.col("u").alias("node"), "v").unionByName(second.select(F.col("v").alias("node"), F.col("u").alias("v")))
        across = both.join(copies.select(F.col("node").alias("v"), F.col("n_copies").alias("links")).hint("merge"), "v").select("node", "links")
        links = across.unionByName(_inside(docs, classes, labels)).groupBy("node").agg(F.sum("links").alias("links"))
        of = of.join(links.hint("merge"), "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).drop("links")
    return facts, settle(of, "components")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, n_copies (rows with the same set), n_links (other rows that it links to)."""
    facts, of = _components(docs, count=True)
    return facts.join(of.hint("merge"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stand for their component: the one with its smallest doc_id, null ids last, then the lowest text hash.

    A row is known by its doc_id and its text; of rows with both the same one
    stays. Rows without a shingle are components of their own.
    """
    facts, of = _components(docs, count=False)
    rows = of.select("keeper.doc_id", "keeper.key").unionByName(facts.where("node IS NULL").select("doc_id", "key")).distinct()
    again = settle(facts.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"), F.col("key").alias("again_key")), "again")
    ids = settle(rows.join(again, F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key")), "left").select(F.col("doc_id").alias("keep_id"), F.col("key").alias("keep_key"), F.col("again_key").isNotNull().alias("several")), "groups")
    own = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_key") == F.col("keep_key"))
    if again.isEmpty():  # the usual case: texts are dealt once
        return own.join(ids.hint("shuffle_hash"), same, "left_semi").select("row.*")
    kept = own.join(ids.hint("shuffle_hash"), same)
    return kept.where("NOT several").select("row.*").unionAll(kept.where("several").groupBy("own_id", "own_key").agg(F.first("row").alias("row")).select("row.*"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
