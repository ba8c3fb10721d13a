"""What a text element is: formula, caption, heading, citation; its context string."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from corvane.functions import tables as T, text as X

_W = r"[\p{L}\p{N}_]"
_UNITS = r"мм|см|дм|м|кг|г|мг|°|град|вт|в|в\.|а|а\.|гц|кгц|мгц|дб|дбм|с|мс|мкс|об|об\s*/\s*мин|rpm|%|°c"
#: Patterns of formulas and of what is none; written so that both Java and RE2 read them.
LATEX = r"\\[a-zA-Z]+|\$[^$]+\$"
CAPTION = r"(?i)^\s*(рисунок|рис\.|схема|таблица)\s+\S+"
TOLERANCE = rf"(?i)^\s*\(?\s*-?\d+(?:[.,]\d+)?\s*[±+−-]\s*\d+(?:[.,]\d+)?\s*\)?\s*(?:{_UNITS})?\s*\.?\s*$"
MEASURE = rf"(?i)\d+(?:[.,]\d+)?\s*(?:{_UNITS})?\s*\(?\s*\d+\s*[±+−-]\s*\d+"
PERCENT = r"(?:^|[^\p{L}\p{N}_])\d+(?:[.,]\d+)?\s*%(?:\s|[/0-9]|$)"
LEGAL = rf"(?i)(№\s*\d|постановлени|распоряжени|приказ|федеральн{_W}*\s+закон|Российск{_W}*\s+Федерац|стать[яи]\s+\d|(?:^|[^\p{{L}}\p{{N}}_])ст\.\s*\d|(?:^|[^\p{{L}}\p{{N}}_])п\.\s*\d|пункт\s+\d|Инструкци|комисси)"
DATE = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])\d{{1,2}}\s+(?:январ|феврал|март|апрел|ма[яй]|июн|июл|август|сентябр|октябр|ноябр|декабр){_W}*\s+\d{{4}}"
NUMBER = r"(?:^|[^\p{L}\p{N}_])\d{1,5}\s*/\s*\d{1,5}(?:-\d+)?(?:$|[^\p{L}\p{N}_])"
STRONG = rf"([∑∫√]|[αβγδεζηθλμπρσφψω]|[A-Za-zА-Яа-я]{_W}*\s*=\s*[-+]?\d|\d+(?:[.,]\d+)?\s*=\s*[-+]?\d|[A-Za-zА-Яа-я0-9_]\s*[+*^]\s*[A-Za-zА-Яа-я0-9_]\s*[=+*/^]|(?:^|[^A-Za-zА-Яа-я0-9])[A-Za-zА-Яа-я]{_W}*\s*=\s*(?:[A-Za-zА-Яа-я]{_W}*\s*[+*/^]|[A-Za-zА-Яа-я]{_W}*\s*\^|[-+]?\d+(?:[.,]\d+)?\s*[+*/^]))"
FIGURES = (r"(?i)(?:Рис\.|Рисунок)\s*\d+[.:]?\s*(.+?)(?:\n|$)", r"(?i)(?:Схема|схема)\s*\d+[.:]?\s*(.+?)(?:\n|$)", r"(?i)(?:Чертёж|чертёж)\s*\d+[.:]?\s*(.+?)(?:\n|$)")
CITATION = r"(?i)\[Документ:\s*([^,\]]+?),\s*стр(?:аница)?\.?\s*(\d+)\]"
HEADING = r"^\d+(\.\d+)*\s+.+$|^[А-ЯЁ][А-ЯЁ\s]{2,}$"
LONGEST_FORMULA, WEAK_CAPTION = 260, 40
_CASE = lambda p: p.replace("(?i)", "(?iu)")  # noqa: E731  Java folds Cyrillic case only when told so


def found(text: Column, pattern: str) -> Column:
    return text.rlike(_CASE(pattern))


def is_formula(text: Column, kind: Column | None = None) -> Column:
    """True equations and LaTeX; tolerances, bare percents, numbers of documents and dates are none."""
    kind = F.lit("") if kind is None else F.coalesce(kind, F.lit(""))
    t = F.trim(F.coalesce(text, F.lit("")))
    strong, plain = found(t, STRONG), ~t.contains("=")
    return (
        F.when(X.is_noise(t, 0), False).when(kind.isin("latex_inline", "latex_block") | found(t, LATEX), True)
        .when(found(t, CAPTION) | found(t, TOLERANCE), False)
        .when(strong, True)
        .when(plain & (found(t, MEASURE) | found(t, PERCENT)), False)
        .when(found(t, LEGAL) | found(t, DATE) | found(t, NUMBER) | (F.length(t) > LONGEST_FORMULA), False)
        .otherwise(X.has_math(t)))


def element_type(declared: Column, text: Column, kind: Column | None = None) -> Column:
    """Declared type, but a false formula is a figure under a figure's caption, else text; unknown types are text. ``kind``: the formula's."""
    t = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    own = F.coalesce(text, F.lit(""))
    figure = found(own, CAPTION) & F.lower(own).rlike("^(рис|схема)")
    return F.when(t == "formula", F.when(is_formula(text, kind), "formula").when(figure, "figure").otherwise("text")).when(t.isin("text", "table", "figure", "heading"), t).otherwise("text")


def headings(text: Column) -> Column:
    """Lines of four characters or more that are numbered or all capitals."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 4) & x.rlike(HEADING))


def figure_caption(text: Column) -> Column:
    """First caption by the first pattern that is found, else empty."""
    t = F.coalesce(text, F.lit(""))
    return F.trim(F.coalesce(*(F.nullif(F.regexp_extract(t, _CASE(p), 1), F.lit("")) for p in FIGURES), F.lit("")))


def is_weak_caption(caption: Column, fragments: tuple[str, ...] = ()) -> Column:
    """Too little to search by: empty, a placeholder, or short with few blanks, a known fragment or leading punctuation."""
    t = F.lower(F.trim(F.coalesce(caption, F.lit(""))))
    torn = functools.reduce(lambda a, f: a | t.startswith(f), fragments, t.rlike(r"^[)(.,;]"))
    few = F.length(F.regexp_replace(F.coalesce(caption, F.lit("")), "[^ ]", "")) <= 3
    return (t == "") | t.startswith("изображение") | ((F.length(t) <= WEAK_CAPTION) & (few | torn))


def citations(text: Column) -> Column:
    """array<struct<doc, page>> of the citations of an answer."""
    t = F.coalesce(text, F.lit(""))
    docs, pages = (F.regexp_extract_all(t, F.lit(_CASE(CITATION)), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(docs.alias("doc"), pages.alias("page")), lambda c: F.struct(c["doc"].alias("doc"), F.try_to_number(c["page"], F.lit("999999999")).cast("long").alias("page")))


def formulas(text: Column) -> Column:
    """array<struct<content, formula_type>>: LaTeX blocks, LaTeX inside lines, then lines of 5 to 260 characters that are formulas."""
    t = F.coalesce(text, F.lit(""))
    typed = lambda xs, kind: F.transform(xs, lambda x: F.struct(F.trim(x).alias("content"), F.lit(kind).alias("formula_type")))
    blocks = F.regexp_extract_all(t, F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1))
    rest = F.regexp_replace(t, r"(?s)\$\$.+?\$\$", " ")
    inline = F.regexp_extract_all(rest, F.lit(r"\$([^$]{1,500})\$"), F.lit(1))
    own = F.transform(F.split(F.regexp_replace(rest, r"\$[^$]{1,500}\$", " "), "\n"), lambda x: F.trim(x))
    wanted = F.filter(own, lambda x: F.length(x).between(5, LONGEST_FORMULA) & ~x.startswith("|") & X.has_math(x) & is_formula(x))
    return F.concat(typed(blocks, "latex_block"), typed(inline, "latex_inline"), typed(wanted, "suspected_formula"))


def formula_summary(text: Column, kind: Column) -> Column:
    label = F.when(kind == "latex_inline", "Формула (LaTeX, строковая)").when(kind == "latex_block", "Формула (LaTeX, блочная)").otherwise("Формула")
    return F.concat(label, F.lit(": "), F.substring(F.coalesce(text, F.lit("")), 1, 240))


def context_string(source: Column, page: Column, heading: Column, kind: Column, content: Column) -> Column:
    """What a prompt shows of a chunk: where it is from, its section, its labelled content."""
    where = F.concat(F.lit("[Документ: "), source, F.lit(", стр. "), page.cast("string"), F.lit("]"))
    section = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("Раздел: "), heading))
    shown = F.when(kind == "table", F.concat(F.lit("ТАБЛИЦА:\n"), T.for_prompt(content))).when(kind == "formula", F.concat(F.lit("ФОРМУЛА: "), content)).when(kind == "figure", F.concat(F.lit("РИСУНОК: "), content)).otherwise(content)
    return F.concat_ws("\n", where, section, shown)


def truncated(text: Column, tokens: int) -> Column:
    """At most that many tokens of two and a half characters, cut at the last blank."""
    most = int(tokens * 2.5)
    cut = F.regexp_replace(F.substring(text, 1, most), " [^ ]*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))
