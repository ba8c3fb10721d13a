"""Repair of recognised text: look-alike letters, replacement rules, glued words, deep cleaning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from corvane.functions import text as X

#: Letters that look alike, one position each.
LATIN, AS_CYRILLIC = "aceopxyABCEHKMOPTXYkmtnhb", "асеорхуАВСЕНКМОРТХУкмтпнь"
CYRILLIC, AS_LATIN = "АВСЕНКМОРТХУасеорху", "ABCEHKMOPTXYaceopxy"
#: Ordered replacements that hold in any domain; a domain's own go before them.
REPLACEMENTS = ((r"(?iuU)\btoto\b", "того"), (r"(?iuU)\bустановяич\w*", "установочный"), (r"(?iuU)\bсенсорнь[!1|]й\b", "сенсорный"), (r"(?iuU)\bбюллетен[ьb]\b", "бюллетень"), (r"(?<=\d)[lI](?=\d)", "1"), (r"(?<=\d)O(?=\d)", "0"), (r"(?<=\d)З(?=\d)", "3"), (r"\bN[°o]\.?\b", "№"))
LONG_RUN, LONGEST_WORD, SHORT_PENALTY = re.compile("[А-Яа-яЁё]{14,}"), 24, 2.0


def replaced(text: Column, rules=REPLACEMENTS) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def fix_homoglyphs(text: Column) -> Column:
    """Words of both scripts in one script: Cyrillic if at least half of their letters are."""
    def fixed(w):
        n_cyrillic = F.length(F.regexp_replace(w, r"[^\x{0400}-\x{04FF}]", ""))
        mixed = w.rlike("[а-яёА-ЯЁ]") & w.rlike("[A-Za-z]")
        mostly = n_cyrillic >= F.greatest(F.lit(1), F.floor(F.length(w) / 2))
        return F.when(mixed & mostly, F.translate(w, LATIN, AS_CYRILLIC)).when(mixed, F.translate(w, CYRILLIC, AS_LATIN)).otherwise(w)

    def own(t):
        parts = F.regexp_extract_all(t, F.lit("[а-яёА-ЯЁA-Za-z]+|[^а-яёА-ЯЁA-Za-z]+"), F.lit(0))
        # a word of both scripts has a place where they meet; texts without one are not taken apart
        return F.when(t.rlike("[а-яёА-ЯЁ][A-Za-z]|[A-Za-z][а-яёА-ЯЁ]"), F.array_join(F.transform(parts, fixed), "")).otherwise(t)

    # an array of one: what comes before is worked out once
    return F.get(F.transform(F.array(F.coalesce(text, F.lit(""))), own), F.lit(0))


def light(text: Column, rules=REPLACEMENTS) -> Column:
    return fix_homoglyphs(replaced(text, rules))


def normalized(text: Column, rules=REPLACEMENTS) -> Column:
    """Prefixes, split words, tags, light repair, cleaning, blanks: in this order. A null text is empty."""
    out = X.join_hyphens(X.strip_service_prefix(F.coalesce(text, F.lit(""))))
    out = F.regexp_replace(out, r"<[^<>\n]{1,80}>", " ")
    out = X.clean(light(out, rules))
    out = F.regexp_replace(F.regexp_replace(out, " {2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+\z", "")


def segment(token: str, costs: dict[str, float]) -> list[str] | None:
    """Cheapest split of a run into known words, two letters at least each; None if there is none."""
    low = token.lower().replace("ё", "е")
    reach: list[tuple[float, int] | None] = [(0.0, 0)]
    for end in range(1, len(low) + 1):
        ways = [(reach[b][0] + costs[low[b:end]] + (0.0 if end - b >= 3 else SHORT_PENALTY), b) for b in range(max(0, end - LONGEST_WORD), end) if reach[b] and low[b:end] in costs]
        reach.append(min(ways) if ways else None)
    cuts, at = [], len(low)
    while reach[at] and at:
        cuts.append((reach[at][1], at))
        at = reach[at][1]
    words = [token[a:b] for a, b in reversed(cuts)]
    return words if len(words) > 1 and all(len(w) > 1 for w in words) else None


def split_glued(text: Column, costs: dict[str, float]) -> Column:
    """Cyrillic runs of 14 letters or more cut into words of the dictionary; the dictionary travels with the plan and is a parameter."""

    def cut(match: re.Match) -> str:
        run = match.group(0)
        return run if run.lower().replace("ё", "е") in costs else " ".join(segment(run, costs) or [run])

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: LONG_RUN.sub(cut, t), na_action="ignore")

    # only rows that hold such a run go to Python
    return F.when(text.rlike(LONG_RUN.pattern), apply(text)).otherwise(text)


def deep_clean(text: Column, costs: dict[str, float] | None = None, rules=REPLACEMENTS) -> Column:
    """Normalised text without garbage lines; glued words are cut if a dictionary is given."""
    out = F.array_join(F.filter(F.split(normalized(text, rules), "\n"), lambda x: ~X.is_garbage_line(x)), "\n")
    return split_glued(out, costs) if costs else out
