"""Secret scans: a keyword automaton, anchored expressions near its hits, checksums inside the tokens.

An Aho-Corasick automaton over the lower-cased text finds the keywords of all
kinds in one pass; the expression of a kind runs only at its hits. Kinds whose
tokens carry a checksum (the six base62 digits of a CRC-32 that end GitHub and
npm tokens) or a structure (the JSON header of a web token) are kept only if it
holds. Hexadecimal runs have no keyword and are found by their own expression.

Defined results: a null text counts as empty; no spans give the SHA-256 of the
empty string; repeated rows are returned as often as they come.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.spans import Span, ascii_lower, scan, sha256, written
from corvane.llm.store import table

BASE_KINDS = ("assign", "access", "hex")
#: All kinds, in the order in which spans with one start are listed.
KINDS = (*BASE_KINDS, "github", "npm", "slack", "google", "stripe", "jwt", "pem")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: kind: (keywords in lower case, expression at a hit, check of the match)
_ADDED = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), "crc"),
    "npm": (("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), "crc"),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxs-"), re.compile(r"xox[abps]-[0-9]{8,14}-[A-Za-z0-9-]{10,80}"), None),
    "google": (("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), None),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,99}"), None),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}"), "jwt"),
    "pem": (("-----begin",), re.compile(r"-----BEGIN (?:[A-Z]{2,9} )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}-----END (?:[A-Z]{2,9} )?PRIVATE KEY-----"), None),
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def token_checksum(body: str) -> str:
    """CRC-32 of the random part as six base62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.rjust(6, "0")


def _checked(token: str, how: str | None) -> bool:
    if how == "crc":
        body = token.partition("_")[2]
        return token_checksum(body[:-6]) == body[-6:]
    if how == "jwt":
        head = token.partition(".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except ValueError:
            return False
    return True


def finder():
    """A function from a text to (base spans, added spans)."""
    words = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        words.add_word(word, ("assign", len(word)))
    words.add_word("akia", ("access", 4))
    for kind, (keys, _, _) in _ADDED.items():
        for key in keys:
            words.add_word(key, (kind, len(key)))
    words.make_automaton()

    def find(text: str) -> tuple[list[Span], list[Span]]:
        base: list[Span] = []
        added: list[Span] = []
        done = dict.fromkeys(KINDS, 0)
        for last, (kind, size) in words.iter(ascii_lower(text)):
            at = last - size + 1
            if at < done[kind]:
                continue
            if kind == "assign":
                if m := _ASSIGN.match(text, at):
                    done[kind] = m.end()
                    if len(m[2]) >= 8:
                        base.append((at, m.end(), kind))
            elif kind == "access":
                if m := _ACCESS.match(text, at):
                    done[kind] = m.end()
                    if m.end() - at >= 16:
                        base.append((at, m.end(), kind))
            elif m := _ADDED[kind][1].match(text, at):
                done[kind] = m.end()
                if _checked(m[0], _ADDED[kind][2]):
                    added.append((at, m.end(), kind))
        base += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        return base, added

    return find


def _row():
    find = finder()

    def each(text: str) -> tuple:
        base, added = find(text)
        count = {k: sum(s[2] == k for s in base) for k in BASE_KINDS}
        return (*count.values(), sha256(written(base, KINDS)), written(base + added, KINDS))

    return each


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: counts of the base kinds, their digest, and all spans."""
    return scan(docs, _row, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
