"""Markdown tables: checks, summaries, truncation, splitting; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvane.functions.text import cells, token_estimate

#: Sizes: longest piece, rows and tokens of a prompt, and least cells, rows and characters.
LONGEST, PROMPT_ROWS, PROMPT_TOKENS, LEAST_COLUMNS, LEAST_ROWS, LEAST_CHARS = 3500, 30, 1500, 2, 2, 30


def lines(table: Column) -> Column:
    return F.filter(F.split(F.coalesce(table, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def is_separator(line: Column) -> Column:
    return line.rlike(r"^[\s|:-]+$")


def all_cells(table: Column) -> Column:
    return F.filter(cells(F.regexp_replace(F.coalesce(table, F.lit("")), "\n", "|")), lambda c: ~c.rlike("^:?-{3,}:?$"))


def _characters(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, c: n + F.length(c))


def is_degenerate(table: Column) -> Column:
    """Fewer than two header cells or data rows, or fewer than 30 characters in all cells."""
    rows = lines(table)
    data = F.filter(F.slice(rows, 2, 1_000_000), lambda x: ~is_separator(x))
    return (F.coalesce(F.size(cells(F.get(rows, 0))), F.lit(0)) < LEAST_COLUMNS) | (F.size(data) < LEAST_ROWS) | (_characters(all_cells(table)) < LEAST_CHARS)


def is_useful(table: Column) -> Column:
    """What an imported table must have: 30 characters, a pipe, two cells, 30 characters in cells."""
    own = all_cells(table)
    return F.coalesce((F.length(table) >= LEAST_CHARS) & table.contains("|") & (F.size(own) >= 2) & (_characters(own) >= LEAST_CHARS), F.lit(False))


def looks_like_table(text: Column) -> Column:
    """Text that begins with a pipe and has two more lines that do."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.startswith("|") & (F.regexp_count(t, F.lit(r"\n\|")) >= 2)


def from_rows(rows: Column) -> Column:
    """Markdown of array<array<string>>: the first row is the header, short rows are padded."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    # bound to a variable, so that the width is found once and not for every row
    bound = F.array(F.struct(F.array_max(F.transform(rows, lambda r: F.size(r))).alias("width"), rows.alias("rows")))

    def made(b):
        places = lambda fill: lambda r: F.transform(F.sequence(F.lit(0), b["width"] - 1), lambda i: F.coalesce(F.get(r, i), fill(i)))
        named, padded = places(lambda i: F.concat(F.lit("Кол."), (i + 1).cast("string"))), places(lambda i: F.lit(""))
        head = F.array(line(named(F.get(b["rows"], 0))), line(F.array_repeat(F.lit("---"), b["width"])))
        return F.array_join(F.concat(head, F.transform(F.slice(b["rows"], 2, 1_000_000), lambda r: line(padded(r)))), "\n")

    return F.when(F.size(rows) > 0, F.get(F.transform(bound, made), 0))


def summary(table: Column) -> Column:
    """Sentence with size, the first ten headers and the first cells of three rows."""
    rows = lines(table)
    headers = F.filter(cells(F.get(rows, 0)), lambda h: h != "---")
    size = F.concat(F.lit("Таблица ("), F.greatest(F.size(rows) - 2, F.lit(0)).cast("string"), F.lit(" строк, "), F.size(headers).cast("string"), F.lit(" столбцов)."))
    named = F.when(F.size(headers) > 0, F.concat(F.lit("Столбцы: "), F.array_join(F.slice(headers, 1, 10), ", "), F.lit(".")))
    data = F.slice(F.filter(F.slice(rows, 3, 1_000_000), lambda x: ~x.contains("---")), 1, 3)
    shown = F.filter(F.transform(data, lambda x: F.array_join(F.slice(cells(x), 1, 6), " | ")), lambda x: x != "")
    return F.concat_ws(" ", size, named, F.when(F.size(data) > 0, F.lit("Пример данных:")), F.when(F.size(shown) > 0, F.array_join(shown, " ")))


def for_prompt(table: Column, rows: int = PROMPT_ROWS, tokens: int = PROMPT_TOKENS) -> Column:
    """Header and first rows within both limits, with a note of how many are shown; a table within them stays as it is."""
    every = F.split(table, "\n")
    head = F.concat_ws("\n", F.get(every, 0), F.coalesce(F.get(every, 1), F.lit("")))
    data = F.slice(F.filter(F.slice(every, 3, 1_000_000), lambda x: F.trim(x) != ""), 1, rows)
    start = F.struct(token_estimate(F.concat(F.get(every, 0), F.coalesce(F.get(every, 1), F.lit("")))).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(s, x):
        full = s["full"] | (s["used"] + token_estimate(x) > tokens)
        return F.struct(F.when(full, s["used"]).otherwise(s["used"] + token_estimate(x)).alias("used"), F.when(full, s["n"]).otherwise(s["n"] + 1).alias("n"), full.alias("full"))

    n = F.aggregate(data, start, step, lambda s: s["n"])
    total = F.size(every) - 2
    note = F.when(n < F.greatest(total, F.lit(0)), F.concat(F.lit("\n\n[...таблица обрезана: показано "), n.cast("string"), F.lit(" из "), total.cast("string"), F.lit(" строк...]"))).otherwise("")
    fits = (F.size(every) <= rows + 2) & (token_estimate(table) <= tokens)
    return F.when(fits, table).otherwise(F.concat(F.concat_ws("\n", head, F.when(n > 0, F.array_join(F.slice(data, 1, n), "\n"))), note))


def pieces(table: Column, longest: int = LONGEST) -> Column:
    """Pieces of at most ``longest`` characters, each with header and separator; one row alone may be longer."""
    every = F.split(table, "\n")
    second = F.get(every, 1)
    own_rule = F.coalesce(is_separator(second), F.lit(False))
    rule = F.when(own_rule, second).otherwise(F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(cells(F.get(every, 0)))), " | "), F.lit(" |")))
    head = F.concat(F.get(every, 0), F.lit("\n"), rule)
    data = F.slice(every, F.when(own_rule, 3).otherwise(2), F.lit(1_000_000))
    # bound to a variable, so that the steps do not split the table again
    bound = F.array(F.struct(head.alias("head"), F.length(head).alias("n"), data.alias("data")))

    def cut(b):
        start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"), b["n"].alias("size"))

        def step(s, x):
            full = (s["size"] + F.length(x) + 1 > longest) & (s["now"] != "")
            return F.struct(
                F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
                F.when(full, F.concat(F.lit("\n"), x)).otherwise(F.concat(s["now"], F.lit("\n"), x)).alias("now"),
                F.when(full, b["n"] + 1 + F.length(x)).otherwise(s["size"] + 1 + F.length(x)).alias("size"))

        parts = F.aggregate(b["data"], start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["now"])), lambda x: x != ""))
        return F.transform(parts, lambda x: F.concat(b["head"], x))

    return F.when(F.length(table) <= longest, F.array(table)).otherwise(F.flatten(F.transform(bound, cut)))
