"""Column functions over text: cleaning, tokens, predicates. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Fixed value: words that the lexical index leaves out.
STOP_WORDS = (
    "и", "в", "на", "с", "по", "для", "из", "к", "от", "о", "об", "а", "но", "да",
    "не", "что", "как", "это", "то", "же", "бы", "вы", "мы", "он", "она", "они", "оно",
    "я", "ты", "его", "её", "их", "мой", "твой", "наш", "ваш", "свой", "этот", "тот",
    "такой", "который", "весь", "все", "вся", "всё", "быть", "был", "была", "было",
    "были", "будет", "есть", "нет", "ещё", "уже", "только", "если", "или", "при",
    "про", "за", "до", "после", "между", "через", "над", "под", "перед", "так",
    "тоже", "лишь", "ведь", "вот", "даже", "ну", "ли", "ни", "тебя", "мне", "мной",
    "ним", "ней", "нами", "вам", "вас", "нас", "них", "чего", "чему", "чем", "кем",
    "ком", "где", "когда", "зачем", "почему", "куда", "откуда", "какой", "какая", "какие",
)
TOKEN = "[а-яёa-z0-9]+"
#: Tokens of a query that are searched.
QUERY_TOKENS = 20
#: A token of two characters or more that is no stop word, in one pattern; words of other scripts do not try the list.
WANTED_TOKEN = rf"(?<![а-яёa-z0-9])(?!(?=[а-яё])(?:{'|'.join(sorted(STOP_WORDS))})(?![а-яёa-z0-9]))[а-яёa-z0-9]{{2,}}"
#: Fixed value: signs of mathematics that make a short text worth keeping; written so that both Java and RE2 read it.
MATH = r"(?i)((?:^|[^\p{L}\p{N}_])[A-Za-zА-Яа-я]\s*[=+*/^]\s*[-+]?\d|\d+(?:[.,]\d+)?\s*[=+*/^]\s*[-+]?\d|(?:^|[^\p{L}\p{N}_])\d+\s*%[\p{L}\p{N}_]|[∑∫√∞≈≠≤≥±αβγδεζηθλμπρσφψω])"
_PY_MATH = re.compile(MATH.replace(r"[^\p{L}\p{N}_]", r"\W").replace(r"[\p{L}\p{N}_]", r"\w"))
#: Fixed value: characters outside this list are dropped from cleaned texts (guillemets, dashes and ellipses among them).
NOT_KEPT = r"""[^\p{L}\p{N}_\p{Z}\s+=*/()\[\]{}$<>,.;:!?%&|^~`"\\@#№°±≥≤≈×÷→←↑↓∈∑∫∂∇∞≠√∏∝∧∨¬⊂⊃⊆⊇∅∩∪\x{0400}-\x{04FF}\x27-]"""


def tokens(text: Column, lemmas: dict[str, str] | None = None) -> Column:
    """Lower-case runs of Cyrillic, Latin and digits, longer than one, without stop words and service prefixes; a null text has none.

    ``lemmas`` maps tokens to their base forms (a small table, which travels with the plan).
    """
    every = F.regexp_extract_all(F.lower(strip_service_prefix(F.coalesce(text, F.lit("")))), F.lit(WANTED_TOKEN), F.lit(0))
    if not lemmas:
        return every
    known = F.create_map(*(F.lit(x) for pair in lemmas.items() for x in pair))
    return F.transform(every, lambda t: F.coalesce(F.try_element_at(known, t), t))


def query_terms(text: Column, lemmas: dict[str, str] | None = None) -> Column:
    """Distinct terms among the first twenty tokens of a query."""
    return F.array_distinct(F.slice(tokens(text, lemmas), 1, QUERY_TOKENS))


def token_estimate(text: Column) -> Column:
    """Size unit: four tenths of the characters, one at least, 0 for an empty text."""
    n = F.length(text)
    return F.when(text.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n * 2 / 5))).cast("long")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def strip_service_prefix(text: Column) -> Column:
    """Remove leaked embedding prefixes, three at most."""
    return F.regexp_replace(text, r"(?i)^(?:\s*(?:passage|query):){1,3}\s*", "")


def join_hyphens(text: Column) -> Column:
    """Join words split at a line end; three or more line ends become two."""
    return F.regexp_replace(F.regexp_replace(text, r"([А-Яа-яA-Za-z])[-¬]\s*\n\s*([А-Яа-яA-Za-z])", "$1$2"), r"\n{3,}", "\n\n")


def strip_tags(text: Column) -> Column:
    """Short tags become a blank, runs of blanks one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<>\n]{1,80}>", " "), r"[ \t]+", " "))


def clean(text: Column) -> Column:
    """Drop control characters and all but the kept ones, squeeze blanks, trim every line and the outer empty lines."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, NOT_KEPT, "")
    out = F.array_join(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), "\n")
    return F.regexp_replace(F.regexp_replace(out, r"^\n+", ""), r"\n+\z", "")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def has_math(text: Column) -> Column:
    return text.rlike(MATH.replace("(?i)", "(?iu)"))


def is_noise(text: Column, least: int = 3) -> Column:
    """Nothing but digits and punctuation in twenty characters, too few letters without mathematics, or a syllable torn off at a hyphen."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = letters(t)
    return (t == "") | ((F.length(t) <= 20) & (n == 0)) | ((n < least) & ~has_math(t)) | ((F.length(t) <= 8) & t.endswith("-") & (n <= 6))


def noisy(text: str, least: int = 3) -> bool:
    """:func:`is_noise` for a text in a Python worker."""
    t = text.strip(" ")
    n = sum(map(str.isalpha, t))
    return not t or len(t) <= 20 and not n or n < least and not _PY_MATH.search(t) or len(t) <= 8 and t.endswith("-") and n <= 6


def is_garbage_line(line: Column) -> Column:
    """Recognition garbage: many very short words, or short words with few vowels. Table rows are exempt."""
    t = F.trim(F.coalesce(line, F.lit("")))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    once = lambda column, then: F.get(F.transform(F.array(column), then), F.lit(0))  # noqa: E731  an array of one: its value is worked out once

    def bad(n_letters, n):
        short = count(r"(?<!\S)(?:\p{L}\S?|[^\s\p{L}]\p{L})(?!\S)") / n
        average = F.length(F.regexp_replace(t, r"(?<!\S)[^\p{L}\s]+(?!\S)|\s+", "")) / n
        vowels = F.regexp_count(F.lower(t), F.lit("[аеёиоуыэюяaeiouy]")) / n_letters
        return ((average <= 3.2) & (short >= 0.55)) | ((average <= 2.6) & (vowels < 0.30))

    # cheap tests first: a line that fails one is not measured further; words are runs without blanks that hold a letter, counted without a step per word
    worded = lambda n_letters: once(count(r"\S*?\p{L}\S*"), lambda n: F.when(n < 6, False).otherwise(bad(n_letters, n)))
    lettered = once(count(r"\p{L}"), lambda n: F.when(n < 12, False).otherwise(worded(n)))
    return F.when(t.startswith("|") | (F.length(t) < 12), False).otherwise(lettered)


def with_prefix(text: Column, prefix: str) -> Column:
    """The text behind an embedding prefix, unless it has one; a null text is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(r"(?i)^\s*(?:passage|query):"), t).otherwise(F.concat(F.lit(prefix), t))


def random_id() -> Column:
    """Twelve random hexadecimal digits."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)


def cells(row: Column) -> Column:
    """Non-empty cells of a Markdown row."""
    return F.filter(F.transform(F.split(row, r"\|"), lambda c: F.trim(c)), lambda c: c != "")


def quality(text: Column, page: Column, facet: Column, heading: Column) -> Column:
    known = F.when(F.coalesce(facet, F.lit("unknown")) != "unknown", 300).otherwise(0)
    return F.length(text) + F.when(page > 0, 500).otherwise(0) + known + F.when(F.coalesce(heading, F.lit("")) != "", 100).otherwise(0)
