"""Quality rules, line first: bad lines go, then documents that lost too much text.

Every line is judged by itself, in this order: boilerplate (set phrases of four
languages), navigation (separators between short pieces, menu words, lines of
labels), symbols, letters, capitals, repetition, and punctuation: running text
ends with a mark that ends a sentence, or at least holds marks between its
words; a short line without an end, or a long one without any mark, fails. The
lines that fail are removed, and a document is rejected if too large a share of
its words went with them.

Navigation and punctuation are told by the form of a line, not by its language;
the marks are those of Latin, Greek, Arabic, Indian and East Asian scripts.

Defined results: a null or empty text has no words and fails the base rule; an
empty line is no line; a line equal to an earlier one of its document is
removed; repeated rows are returned as often as they come; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import textkit as K
from corvane.llm.store import small_batches, table

LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
#: A document that loses more than this share of its words is rejected.
MOST_LOST = 0.5
#: A line with more than this share of symbols in its characters fails.
MOST_SYMBOLS = 0.1
#: Lines of fewer words must end with a mark; longer ones may be cut off, but must hold marks, one for so many words at least.
SHORT_LINE, WORDS_A_MARK = 12, 60
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Phrases of notices and consent banners in English, German, French and Spanish.
_BOILERPLATE = re.compile(
    r"all rights reserved|terms (?:of use|of service|and conditions)|(?:privacy|cookie) policy|we use cookies|accept (?:all )?cookies|sign up for our newsletter|subscribe to our|"
    r"click here to|enable javascript|lorem ipsum|share (?:this )?on (?:facebook|twitter|linkedin)|powered by wordpress|skip to (?:main )?content|"
    r"alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|wir verwenden cookies|cookies (?:akzeptieren|zulassen)|newsletter (?:abonnieren|anmelden)|javascript (?:aktivieren|ist deaktiviert)|zum inhalt springen|"
    r"tous droits réservés|conditions (?:générales|d.utilisation)|politique de confidentialité|nous utilisons des cookies|accepter (?:tous )?les cookies|abonnez-vous|activer javascript|aller au contenu|"
    r"todos los derechos reservados|términos y condiciones|política de (?:privacidad|cookies)|(?:usamos|utilizamos) cookies|aceptar (?:todas )?las cookies|suscríbete|activar? javascript|saltar al contenido")
#: Words of menus in the same languages.
_NAVIGATION = frozenset((
    "home about contact login logout register search menu sitemap faq blog news next previous back top help shop cart account "
    "startseite kontakt impressum anmelden abmelden registrieren suche hilfe warenkorb konto weiter zurück über "
    "accueil contacter connexion déconnexion inscription recherche aide panier compte suivant précédent retour "
    "inicio contacto entrar salir registrarse buscar ayuda carrito cuenta siguiente anterior volver").split())
_SEPARATOR = re.compile(r"\s[|»>·•/–—]\s")
#: Marks that end a sentence, what may stand behind them, and marks inside one.
_ENDS, _CLOSERS, _MARKS = ".!?…:;。！？；：؟۔।॥;", "\"'“”‘’»«)]}›」』）", ".,!?…:;。！？；：、，،؟؛۔।॥"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_fault(line: str, words: list[str]) -> str | None:
    """Name of the first rule that the line breaks; ``words`` are its words."""
    n = len(words)
    if not n:
        return None
    low = line.lower()
    if _BOILERPLATE.search(low):
        return "boilerplate"
    ended = line.rstrip().rstrip(_CLOSERS)[-1:] in _ENDS
    pieces = len(_SEPARATOR.findall(line)) + 1
    if pieces >= 4 and n <= 5 * pieces:
        return "navigation"
    if n <= SHORT_LINE and sum(w.strip(".,:;").lower() in _NAVIGATION for w in words) * 2 > n:
        return "navigation"
    if sum(map(line.count, "#*$%&|<>{}")) > MOST_SYMBOLS * len(line):
        return "symbols"
    letters = sum(map(str.isalpha, line))
    if n >= 3 and letters * 2 < len(line) - n:
        return "letters"
    if n >= 10 and low != line and line.upper() == line:
        return "capitals"
    if n >= 12 and sum(w[-1] in "!?" for w in words) * 2 > n:
        return "punctuation"
    if n >= 24 and len(set(words)) * 4 < n:
        return "repetition"
    if not ended and (n < SHORT_LINE or sum(map(line.count, _MARKS)) * WORDS_A_MARK < n):
        return "punctuation"
    return None


def clean_lines(text: str) -> tuple[list[str], int]:
    """The lines that pass, and the words that went with the others. A line equal to an earlier one goes too."""
    kept, lost, seen = [], 0, set()
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if words and (line in seen or line_fault(line, words)):
            lost += len(words)
        else:
            kept.append(line)
        if words:
            seen.add(line)
    return kept, lost


def repeated_words(hashes: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that the text holds twice or more."""
    runs = K.window_hashes(hashes, window)
    if len(runs) < 2:
        return 0
    by = np.argsort(runs)
    same = runs[by][1:] == runs[by][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[by[1:][same]] = twice[by[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _rows(batch: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    data, offs, _ = K.string_buffers(batch.column("text"))
    words = K.Words(data, offs, K.WORD_BYTE, K._CODES)
    n = words.counts()
    points = K.code_points(data)
    span = np.concatenate([[0], np.cumsum(points[words.ends] - points[words.starts])])
    chars = span[words.first[1:]] - span[words.first[:-1]]
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    symbols = marks[offs[1:]] - marks[offs[:-1]]
    repeats, doubles, lost, cleaned = [], [], [], []
    for k, text in enumerate(batch.column("text").to_pylist()):
        repeats.append(repeated_words(words.hashes[words.first[k] : words.first[k + 1]]))
        text = text or ""
        full = [x for x in text.split("\n") if _WORD.search(x)]
        doubles.append(len(full) - len(set(full)))
        kept, gone = clean_lines(text)
        lost.append(gone)
        if with_text:
            cleaned.append("\n".join(kept))
    repeats, lost = np.array(repeats, np.int64), np.array(lost, np.int64)
    failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
    kept = ~failed & (lost <= MOST_LOST * n)
    columns = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": doubles, "n_repeat_words": repeats, "base_failed": failed, "kept": kept, "lost_words": lost}
    arrays = [batch.column("doc_id"), *(pa.array(v, pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c, v in columns.items())]
    return pa.record_batch(arrays + ([pa.array(cleaned, pa.string())] if with_text else []), names=["doc_id", *columns] + (["clean_text"] if with_text else []))


def quality(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: counts, base_failed, kept, lost_words, and the cleaned text on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text", 4 << 20):
                yield _rows(batch, with_text)

    fields = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long" + (", clean_text string" if with_text else "")
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
