"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

The generators propose overlapping spans of every kind. The base kinds (email,
ip, card, phone) are kept by their own rules; all other proposals are scored by
gradient-boosted trees whose features are the format of the span (lengths,
groups, checksums) and the words before it, and the calibrated probability must
reach the kind's threshold. The threshold of a kind is the least one that gives
``PRECISION`` on examples that the trees have not seen. A span that the model
adds never overlaps a base span; of overlapping added spans the likelier one stays.

The trees are trained on examples that this module generates (a documented
number of true and misleading spans in generated contexts), on the driver, and
sent to the workers; the model's size does not depend on the corpus.

Defined results: a null text counts as empty; no spans give the SHA-256 of the
empty string; repeated rows are returned as often as they come; redaction leaves
a null text null and returns all other columns as they come.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.boost import Boosted
from corvane.llm.spans import Span, ascii_lower, scan, sha256, written
from corvane.llm.store import table, through
from corvane.llm.textkit import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_words", "phone_local", "iban", "national_id", "mac")
#: Generated examples for the training and as many for the thresholds, precision that a kind's threshold must reach on the latter, and its least value.
EXAMPLES, PRECISION, LEAST_THRESHOLD = 6000, 0.97, 0.5
#: Characters before a span that make its context.
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match of these starts at the first digit of a run: one that fails there fails in the whole run
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
# an address in words is found from its "at" in both directions
_AT = re.compile(r"\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20", re.I)
_BEFORE_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,40}$")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{2,40}(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z]{2,10}(?![A-Za-z])", re.I)
_GENERATORS = {
    "phone_local": re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])"),
}
_HINTS = {
    "email_words": ("mail", "contact", "write", "reach", "correo", "courriel"),
    "phone_local": ("phone", "call", "tel", "fax", "mobile", "cell", "whatsapp", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "tax", "identity", "national"),
    "mac": ("mac", "ethernet", "wifi", "device", "address", "hardware"),
}
_AGAINST = ("order", "invoice", "part", "serial", "version", "isbn", "page", "total", "number", "ref", "sku", "item", "score", "chapter", "met", "stay", "arrive", "sold")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    text = text.replace(" ", "")
    return text.isalnum() and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _is_part(digits: str) -> bool:
    """Whether the number is at most 255; leading zeros may be of any length."""
    own = digits.lstrip("0")
    return len(own) <= 3 and int(own or "0") <= 255


def _emails(text: str) -> list[Span]:
    """Leftmost matches: the run of local characters before an @, from the end of the match before."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        k = at
        while k > done and (text[k - 1].isascii() and text[k - 1].isalnum() or text[k - 1] in "._%+-"):
            k -= 1
        if k < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((k, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_is_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def proposals(text: str) -> list[Span]:
    out: list[Span] = []
    for m in _AT.finditer(text):
        after = _AFTER_AT.match(text, m.end())
        before = _BEFORE_AT.search(text[max(0, m.start() - 41) : m.start()]) if after else None
        if before:
            out.append((m.start() - len(before[0]), after.end(), "email_words"))
    digits = bool(_DIGIT.search(text))
    for kind, pattern in _GENERATORS.items():
        if digits or kind == "mac" and text.count(":") + text.count("-") >= 5:
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    s, e, kind = span
    own, before = text[s:e], ascii_lower(text[max(0, s - CONTEXT) : s])
    low = ascii_lower(own)
    digits = [c for c in own if c.isdigit()]
    groups = re.findall(r"[A-Za-z0-9]+", own)
    marks = ("(at)" in low or "[at]" in low) + ("dot)" in low or "dot]" in low)
    return [
        *(float(kind == k) for k in KINDS[4:]), len(own), len(digits), sum(c.isalpha() for c in own), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        len(set(digits)), float(any(h in before for h in _HINTS[kind])), float(any(h in before for h in _AGAINST)), float(before.rstrip().endswith(":")),
        float(kind == "iban" and mod97(own)), float(kind == "national_id" and own[:3] not in ("000", "666") and own[0] != "9" and own[4:6] != "00" and own[7:] != "0000"),
        float(marks), float(" dot " in low), float("(" in own), float("." in own), float(len({c for c in own if not c.isalnum()}) == 1), float(low.endswith(("com", "org", "net", "edu", "de", "fr", "es"))),
    ]


def _iban(rng: random.Random) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    flat = f"DE{check:02d}{body}"
    return " ".join(flat[k : k + 4] for k in range(0, len(flat), 4)) if rng.random() < 0.5 else flat


def _example(rng: random.Random) -> tuple[str, list[float], bool] | None:
    """Kind, features and truth of one generated span; some contexts mislead, so that no rule is perfect."""
    kind, true = rng.choice(KINDS[4:]), rng.random() < 0.5
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    filler = " ".join(w() for _ in range(rng.randint(0, 6)))
    needs_hint = kind in ("phone_local", "national_id")
    if kind == "iban":
        own = _iban(rng) if true else f"{rng.choice(['AB', 'XK', 'DE', 'PN'])}{d(2)} " + " ".join(d(4) for _ in range(rng.randint(2, 5)))
    elif kind == "mac":
        own = ":".join(f"{rng.randrange(256):02x}" for _ in range(6)) if true else "-".join(d(2) for _ in range(6))
    elif kind == "national_id":
        own = f"{rng.choice(['123', '219', '457', '078'])}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    elif kind == "phone_local":
        shapes = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}"] if true else [f"{d(4)}-{d(3)}-{d(3)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}"]
        own = rng.choice(shapes)
    else:
        dot = rng.choice([" dot ", "[dot]", "(dot)", " (dot) ", " [dot] ", "."])
        at = rng.choice([" (at) ", "[at]", "(at)", " at "])
        if true:
            own, needs_hint = f"{w()}{at}{w()}{dot}{rng.choice(['com', 'org', 'net', 'edu', 'de'])}", at == " at " and dot in (".", " dot ")
        else:
            own = rng.choice([f"{w()} at {w()} dot {w()}", f"{w()} at {w()}.{w()}", f"{w()} at {w()}.com"])
    lead = rng.choice(_HINTS[kind]) if true and (needs_hint or rng.random() < 0.6) else "" if true else rng.choice((*_AGAINST, "", ""))
    text = f"{filler} {lead}{rng.choice([': ', ' ', ' is ', ' me '])}{own} {w()}"
    spans = [s for s in proposals(text) if s[2] == kind]
    return (kind, features(text, spans[0]), true) if spans else None


def _examples(seed: int, n: int = EXAMPLES) -> list[tuple[str, list[float], bool]]:
    rng = random.Random(seed)
    return [x for x in (_example(rng) for _ in range(n)) if x]


class Detector:
    """Trees and the thresholds of the kinds; ``report`` has precision and recall of each kind on the held-out examples."""

    def __init__(self, seed: int = 11):
        rows, held = _examples(seed), _examples(seed + 1)
        self.trees = Boosted().fit(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        p = self.trees.probability(np.array([r[1] for r in held]))
        kinds, truth = np.array([r[0] for r in held]), np.array([r[2] for r in held])
        self.thresholds: dict[str, float] = {}
        self.report: dict[str, tuple[float, float]] = {}
        for kind in KINDS[4:]:
            own = kinds == kind
            by = np.argsort(-p[own], kind="stable")
            value, right = p[own][by], np.cumsum(truth[own][by])
            precision = right / np.arange(1, len(by) + 1)
            last = np.append(value[1:] != value[:-1], True)  # a threshold takes all of one probability
            good = np.flatnonzero((precision >= PRECISION) & last & (value >= LEAST_THRESHOLD))
            at = int(good[-1]) if len(good) else -1
            self.thresholds[kind] = float(value[at]) if at >= 0 else 1.1
            self.report[kind] = (float(precision[at]), float(right[at] / max(1, truth[own].sum()))) if at >= 0 else (1.0, 0.0)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        free = [s for s in proposals(text) if not any(s[0] < e and b < s[1] for b, e, _ in base)]
        if not free:
            return []
        p = self.trees.probability(np.array([features(text, s) for s in free]))
        out: list[Span] = []
        for unlikely, s in sorted(zip(-p, free)):
            if -unlikely >= self.thresholds[s[2]] and not any(s[0] < e and b < s[1] for b, e, _ in out):
                out.append(s)
        return out


@functools.lru_cache(1)
def model() -> Detector:
    return Detector()


def pii_spans(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: counts of the base kinds, their digest, all spans and their number."""
    own = detector or model()

    def make():
        def each(text: str) -> tuple:
            base = base_spans(text)
            every = base + own.added(text, base)
            return (*(sum(s[2] == k for s in base) for k in BASE_KINDS), sha256(written(base, KINDS)), written(every, KINDS), len(every))

        return each

    return scan(docs, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted_text(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first span."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """The rows of ``docs`` with the personal data of their texts redacted; all columns are kept."""
    own = detector or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text) if text else []
                    texts.append(redacted_text(text, base + own.added(text, base)) if text else text)
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return through(docs, run)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
