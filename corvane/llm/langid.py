"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows, labels every byte with
a distribution over the learned languages, and the document's distribution is
the mean over all its bytes. Windows overlap by ``MARGIN`` bytes on both sides,
which give context and are labelled by their neighbours, so that a cut leaves no
byte without both directions. The network is trained in numpy by backpropagation
through time on a bounded sample of labelled rows: for each of the
``LANGUAGES`` commonest languages the rows with the lowest hash of their doc_id,
``SAMPLE`` rows in all, ``CUTS`` windows each, spread over the whole text.
Prediction reads every byte of every text; a text's result does not depend on
the rows it comes with.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned. Rows with a null doc_id are never
learned from and count as not held out. Repeated rows are returned as often as
they come. Columns other than doc_id, text and lang are not read, and the
pipeline form returns them as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvane.llm import textkit as K
from corvane.llm.store import small_batches, table, through

#: Labelled rows and windows of each that the network learns from, at most, shared by the languages, and languages that are learned, the commonest ones.
SAMPLE, CUTS, LANGUAGES = 2400, 3, 100
#: Bytes of a training window, of a reading window and of its margins, hidden units of each direction; reading windows are padded to a multiple of STEP.
LEARN_BYTES, READ_BYTES, MARGIN, UNITS, STEP = 64, 128, 8, 8, 16
EPOCHS, BATCH, RATE = 8, 128, 0.02
#: Rows that are ranked for each that is taken, about.
OVERSAMPLED = 3
#: Steps of the training at least, however few the rows.
LEAST_STEPS = 320
#: Rows whose crc32(doc_id) leaves this remainder by FOLDS are held out.
FOLDS, HELD = 5, 0
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class ByteGRU:
    """Parameters of both directions; hidden states are laid out (units, windows)."""

    def __init__(self, labels: list[str], units: int = UNITS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.units = labels, units
        n = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        # rows of ``x`` and ``u``: update gate, reset gate, candidate
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", n(3 * units, 256)), ("u", n(3 * units, units)))}
        self.p |= {"of": n(len(labels), units), "ob": n(len(labels), units), "bias": np.zeros((len(labels), 1), np.float32)}

    def _run(self, d: str, seq: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (T, units, N) of one direction over bytes (T, N) in reading order."""
        h_units, (steps, n) = self.units, seq.shape
        x, u = self.p[f"x{d}"], self.p[f"u{d}"]
        h = np.zeros((h_units, n), np.float32)
        out, kept = np.empty((steps, h_units, n), np.float32), []
        e, g, tmp = np.empty((3 * h_units, n), np.float32), np.empty((3 * h_units, n), np.float32), np.empty((h_units, n), np.float32)
        for t in range(steps):
            np.take(x, seq[t], axis=1, out=e, mode="clip")
            np.dot(u, h, out=g)
            gates = g[: 2 * h_units]
            gates += e[: 2 * h_units]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            c = g[2 * h_units :]
            if keep:
                before, inner = h.copy(), c.copy()
            c *= gates[h_units:]
            c += e[2 * h_units :]
            np.tanh(c, out=c)
            np.subtract(h, c, out=tmp)
            tmp *= gates[:h_units]
            np.add(c, tmp, out=h)
            out[t] = h
            if keep:
                kept.append((before, inner, g.copy()))
        return out, kept

    def probabilities(self, seq: np.ndarray) -> np.ndarray:
        """(T, labels, N) of bytes (T, N): the label distribution at every position."""
        f, _ = self._run("f", seq, False)
        b, _ = self._run("b", seq[::-1], False)
        out = np.matmul(self.p["of"], f)
        out += np.matmul(self.p["ob"], b[::-1])
        out += self.p["bias"]
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def gradients(self, seq: np.ndarray, want: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the masked positions, and its gradients through time. want: label of each window."""
        runs = {"f": self._run("f", seq, True), "b": self._run("b", seq[::-1], True)}
        f, b = runs["f"][0], runs["b"][0][::-1]
        score = np.matmul(self.p["of"], f) + np.matmul(self.p["ob"], b) + self.p["bias"]
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        n = np.arange(seq.shape[1])
        total = max(1.0, float(mask.sum()))
        loss = -float((np.log(p[:, want, n] + 1e-9) * mask).sum()) / total
        p[:, want, n] -= 1
        p *= (mask / total)[:, None, :]
        grads = {"of": np.einsum("tln,tun->lu", p, f), "ob": np.einsum("tln,tun->lu", p, b), "bias": p.sum((0, 2))[:, None]}
        for d in "fb":
            down = np.matmul(self.p[f"o{d}"].T, p)
            gx, gu = self._back(d, seq if d == "f" else seq[::-1], down if d == "f" else down[::-1], runs[d][1])
            grads |= {f"x{d}": gx, f"u{d}": gu}
        return loss, grads

    def _back(self, d: str, seq: np.ndarray, down: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        k, u = self.units, self.p[f"u{d}"]
        gx, gu = np.zeros((256, 3 * k), np.float32), np.zeros_like(u)
        dh = np.zeros((k, seq.shape[1]), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            before, inner, g = kept[t]
            z, r, c = g[:k], g[k : 2 * k], g[2 * k :]
            dh = dh + down[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * inner * r * (1 - r)
            at_u = np.concatenate([dz, dr, dc * r])
            np.add.at(gx, seq[t], np.concatenate([dz, dr, dc]).T)
            gu += at_u @ before.T
            dh = dh * z + u.T @ at_u
        return gx.T, gu

    def fit(self, windows: np.ndarray, lengths: np.ndarray, want: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> "ByteGRU":
        """windows: (N, T) bytes, of which the first ``lengths`` count; every label weighs the same, whatever its windows."""
        rng = np.random.default_rng(seed)
        count = np.bincount(want, minlength=len(self.labels))
        weight = (len(want) / (np.maximum(1, count) * max(1, (count > 0).sum())))[want].astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(want) // BATCH)))
        step, steps = 0, epochs * -(-len(want) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(want))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                mask = (np.arange(windows.shape[1])[:, None] < lengths[own]) * weight[own]
                _, grads = self.gradients(windows[own].T.astype(np.intp), want[own], mask)
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1 / (norm + 1e-9))
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def _cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """All texts in windows: (start, length, first and end of the labelled bytes inside, text) of each; the labelled bytes cover every text once."""
    n = np.diff(offs)
    inner = READ_BYTES - 2 * MARGIN
    many = -(-n // inner)
    doc = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    core = offs[doc] + nth * inner
    core_end = np.minimum(core + inner, offs[doc + 1])
    start = np.maximum(core - MARGIN, offs[doc])
    return start, np.minimum(core_end + MARGIN, offs[doc + 1]) - start, core - start, core_end - start, doc


def predict(net: ByteGRU | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(label, probability) of each text of a string column."""
    data, offs, _ = K.string_buffers(column)
    n = len(column)
    if not net:
        return [UNKNOWN] * n, np.zeros(n)
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    spoken = ascii_letters[offs[1:]] > ascii_letters[offs[:-1]]
    for k in np.flatnonzero(~spoken & (np.diff(offs) > 0)).tolist():
        spoken[k] = any(map(str.isalpha, column[k].as_py()))
    start, length, lo, hi, doc = _cut(data, offs)
    sums = np.zeros((n, len(net.labels)))
    # windows of one padded length together, so that no window sees the length of another
    steps_of = -(-length // STEP) * STEP
    for steps in np.unique(steps_of).tolist():
        at = np.flatnonzero(steps_of == steps)
        t = np.arange(steps)[:, None]
        for k in range(0, len(at), 1024):
            own = at[k : k + 1024]
            place = np.minimum(start[own] + t, len(data) - 1)
            p = net.probabilities(np.where(t < length[own], data[place], 32).astype(np.intp))
            p *= ((t >= lo[own]) & (t < hi[own]))[:, None, :]
            pooled = p.sum(0)
            for j in range(len(net.labels)):
                sums[:, j] += np.bincount(doc[own], pooled[j], n)
    share = sums / np.maximum(1, np.diff(offs))[:, None]
    best = share.argmax(1)
    labels = [net.labels[b] if s else UNKNOWN for b, s in zip(best.tolist(), spoken.tolist())]
    return labels, np.where(spoken, np.clip(share[np.arange(n), best], 0, 1), 0.0)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> ByteGRU | None:
    """The network, from the rows of ``docs`` that are not held out; None if none of them has a text with letters."""
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    open_ = own.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                data, offs, _ = K.string_buffers(batch.column("text"))
                rows: dict[str, list] = {"doc_id": [], "lang": [], "nth": [], "bytes": []}
                for k, (doc_id, lang) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist())):
                    a, b = int(offs[k]), int(offs[k + 1])
                    for nth in range(CUTS if b - a > LEARN_BYTES else min(1, b - a)):
                        at = a + (b - a - LEARN_BYTES) * nth // max(1, CUTS - 1) if b - a > LEARN_BYTES else a
                        rows["doc_id"].append(doc_id)
                        rows["lang"].append(lang)
                        rows["nth"].append(nth)
                        rows["bytes"].append(data[at : min(b, at + LEARN_BYTES)].tobytes())
                yield pa.record_batch([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["lang"], pa.string()), pa.array(rows["nth"], pa.int64()), pa.array(rows["bytes"], pa.binary())], names=list(rows))

    # the sample is chosen by a hash of the identifier, language by language, before any text is cut
    known = open_.where("text IS NOT NULL").select("lang", F.xxhash64("doc_id").alias("h"))
    spoken = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not spoken:
        return None
    each = max(1, sample // len(spoken))
    # hashes are even, so a share of them is about so many rows: few are ranked, whatever the table's size
    near = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.col("h") <= min(2**63 - 1, int(2**64 * OVERSAMPLED * each / r["n"]) - 2**63)) for r in spoken), F.lit(False))
    ranked = known.where(near).withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= each)
    highest = {r["lang"]: r["h"] for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    wanted = F.coalesce(*(F.when(F.col("lang") == lang, F.xxhash64("doc_id") <= h) for lang, h in highest.items()), F.lit(False))
    # equal identifiers share a hash: at most so many windows are taken, whatever their rows
    cuts = open_.where(wanted).mapInArrow(cut, "doc_id long, lang string, nth long, bytes binary")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "nth", "bytes"))
    rows = cuts.withColumn("place", place).where(F.col("place") <= each * CUTS).orderBy("lang", "place").collect()
    rows = [r for r in rows if any(map(str.isalpha, bytes(r["bytes"]).decode("utf-8", "ignore")))]
    if not rows:
        return None
    labels = sorted({r["lang"] for r in rows})
    windows = np.full((len(rows), LEARN_BYTES), 32, np.uint8)
    for k, r in enumerate(rows):
        windows[k, : len(r["bytes"])] = np.frombuffer(bytes(r["bytes"]), np.uint8)
    want = np.array([labels.index(r["lang"]) for r in rows])
    return ByteGRU(labels).fit(windows, np.array([len(r["bytes"]) for r in rows]), want, epochs)


def identify(docs: DataFrame, net: ByteGRU | None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text", 2 << 20):
                labels, score = predict(net, batch.column("text"))
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


#: A document whose language is less likely than this is rejected, as is one without a letter.
LEAST_SCORE = 0.35


def identified(docs: DataFrame, net: ByteGRU | None) -> DataFrame:
    """The rows of ``docs`` whose language is known well enough, with all their columns. Without a network nothing is rejected but texts without letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text", 2 << 20):
                labels, score = predict(net, batch.column("text"))
                if net:
                    keep = [x != UNKNOWN and s >= LEAST_SCORE for x, s in zip(labels, score.tolist())]
                else:
                    keep = [bool(x) and any(map(str.isalpha, x)) for x in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return through(docs, run)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
