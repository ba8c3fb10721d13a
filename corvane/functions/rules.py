"""Rule tables over text: topics, incidents, facets, categories, intents. The tables are parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Rules = tuple[tuple[str, tuple[str, ...]], ...]

#: Topics that are not answered, by their description.
SENSITIVE: Rules = (
    ("Вопросы о статусе бюллетеней должны решаться по официальной процедуре УИК/ТИК.", (r"\bнедействительн(?:ый|ые|ых)\s+бюллетен", r"\bаннулировани(?:е|я)\s+бюллетен")),
    ("Жалобы и апелляции требуют обращения к ответственным лицам/официальной процедуре.", (r"\bжалоб(?:а|ы|у)\b", r"\bпожаловаться\b", r"\bпротест\b", r"\bапелляци(?:я|и|ю)\b")),
    ("Вопросы безопасности и фальсификаций должны передаваться ответственным службам.", (r"\bвзлом\b", r"\bнесанкционированный\s+доступ\b", r"\bутечка\s+данных\b", r"\bфальсификаци")),
)
#: Groups of incidents, by their description.
INCIDENTS: Rules = (
    ("общий технический сбой или нештатная ситуация", (r"\bнештатн\w*\b", r"\bинцидент\w*\b", r"\bтехническ\w*\s+сбо[йя]\b", r"\bсбо[йя]\b", r"\bотказ\w*\b", r"\bнеисправн\w*\b", r"\bавари[яий]\w*\b", r"\bошибк[аиу]\b")),
    ("оборудование не работает или не включается", (r"\bне\s+работа\w*\b", r"\bне\s+включа\w*\b", r"\bне\s+запуска\w*\b", r"\bне\s+печата\w*\b", r"\bне\s+сканиру\w*\b", r"\bне\s+считыва\w*\b", r"\bне\s+принима\w*\s+бюллетен\w*\b")),
    ("замятие, застревание или блокировка бюллетеня/механизма", (r"\bзастр\w*\b", r"\bзамяти\w*\b", r"\bзажевал\w*\b", r"\bзавис\w*\b", r"\bблокиров\w*\b")),
    ("питание, ИБП, кабель или соединение", (r"\bпитани\w*\b", r"\bибп\b", r"\bаккумулятор\w*\b", r"\bкабел\w*\b", r"\bсоединени\w*\b", r"\bиндикатор\w*\b")),
)
#: What an answer must not hold.
FORBIDDEN = (r"<\s*script", "javascript:", "data:text/html")
#: Pronouns that make a question depend on the ones before.
PRONOUNS = ("он", "она", "оно", "они", "его", "её", "их", "нему", "ней", "ними", "этом", "этот", "тот", "такой", "там", "это", "неё", "него", "у")
#: Stems of each intent.
INTENTS = (("table", ("таблиц", "значени", "параметр")), ("formula", ("формул", "вычислен", "расчёт")), ("figure", ("схем", "рисунок", "диаграмм")))
#: Parts of file names of each category, in order; else manual.
CATEGORIES = (("legal", ("постанов", "цик", "пост-", "пост.", "пост ", "_114_", "896-8", "1148-7")), ("procedure", ("инструкц", "порядк", "регламент", "139", "едг")), ("form", ("акт", "протокол", "приложение", "zp21")))
#: First words of small talk.
GREETINGS = ("привет", "здравствуйте", "здравствуй", "добрый", "доброе", "хай", "приветствую", "доброго", "ку", "здрасте", "салют")
THANKS = ("спасибо", "благодарю", "спс", "благодарствую", "пасибо", "thanks", "thx")
FAREWELLS = ("пока", "досвидания", "свидания", "бывай", "до")


def has(text: Column, pattern: str) -> Column:
    """Whether a pattern is found, whatever its case; word classes and boundaries are those of Unicode."""
    return F.coalesce(text, F.lit("")).rlike(f"(?iuU){pattern}")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return has(text, "|".join(f"(?:{p})" for p in patterns))


def first_topic(text: Column, rules: Rules = SENSITIVE) -> Column:
    """Name of the first rule that is found, else null."""
    return F.coalesce(*(F.when(any_of(text, patterns), F.lit(name)) for name, patterns in rules))


def reasons(text: Column, rules: Rules = INCIDENTS) -> Column:
    """Names of all rules that are found, in their order."""
    return F.filter(F.array(*(F.when(any_of(text, patterns), F.lit(name)) for name, patterns in rules)), lambda x: x.isNotNull())


def answer_fault(answer: Column, longest: int = 10_000) -> Column:
    """Why an answer may not go out, else null."""
    held = [F.when(has(answer, p), F.lit(f"Forbidden pattern: {p}")) for p in FORBIDDEN]
    return F.coalesce(*held, F.when(F.length(answer) > longest, F.lit("Answer too long")))


def sanitized(answer: Column) -> Column:
    """The answer without scripts and script addresses."""
    out = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?is)<\s*script[^>]*>.*?</script>", "")
    out = F.regexp_replace(F.regexp_replace(out, "(?i)javascript:", ""), "(?i)data:text/html", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def has_reminder(answer: Column) -> Column:
    t = F.lower(F.coalesce(answer, F.lit("")))
    who = t.contains("председател") & (t.contains("уик") | t.contains("участков") | t.contains("комисс"))
    return who & t.contains("горяч") & t.contains("лини") & (t.contains("цик") | t.contains("регламент"))


def incident_instruction(query: Column, wording: str, rules: Rules = INCIDENTS) -> Column:
    """Instruction for a prompt about an incident; ``{reasons}`` in the wording takes what it is. Empty for other questions."""
    before, _, behind = wording.partition("{reasons}")
    why = reasons(query, rules)
    return F.when(F.size(why) > 0, F.concat(F.lit(before), F.array_join(why, "; "), F.lit(behind))).otherwise("")


def as_list(items: Column) -> Column:
    """Markdown list of an array."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def reminded(answer: Column, query: Column, reminder: str, rules: Rules = INCIDENTS) -> Column:
    """The answer, with the reminder behind it if question or answer tells of an incident and it is not there."""
    own = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")
    must = (F.size(reasons(query, rules)) > 0) | (F.size(reasons(own, rules)) > 0)
    added = F.when(own == "", F.lit(reminder)).otherwise(F.concat(own, F.lit("\n\n" + reminder)))
    return F.when(must & ~has_reminder(own), added).otherwise(own)


def needs_rewrite(query: Column) -> Column:
    words = F.transform(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "^[,.!?]+|[,.!?]+$", ""))
    return F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS)))


def intent(query: Column) -> Column:
    """Weights (text, table, formula, figure) by the number of stems that a query holds."""
    t = F.lower(F.coalesce(query, F.lit("")))
    hits = {name: sum((t.contains(s).cast("int") for s in stems), F.lit(0)) for name, stems in INTENTS}
    total = hits["table"] + hits["formula"] + hits["figure"]
    text = F.when(total > 0, F.greatest(F.lit(0.3), F.lit(1.0) - total * 0.2)).otherwise(1.0)
    return F.struct(F.round(text, 6).alias("text"), *(F.least(n / 2, F.lit(1.0)).alias(name) for name, n in hits.items()))


def leg_sizes(weights: Column) -> Column:
    """How many results the text leg and the summary leg bring for an intent."""
    structured = F.greatest(weights["table"], weights["formula"], F.lit(0.3))
    return F.struct((F.floor(F.round(15 * weights["text"], 6)) + 3).cast("int").alias("text_k"), (F.floor(F.round(15 * structured, 6)) + 3).cast("int").alias("summary_k"))


def category(name: Column, rules=CATEGORIES, otherwise: str = "manual") -> Column:
    t = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*(F.when(F.greatest(*(t.contains(p) for p in parts), F.lit(False)), F.lit(c)) for c, parts in rules), F.lit(otherwise))


def _best(text: Column, rules: Rules) -> tuple[Column, Column]:
    """Rule with most patterns found (the first on a tie) and how many; without rules none."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(0)
    hits = [sum((has(text, p).cast("int") for p in patterns), F.lit(0)) for _, patterns in rules]
    most = F.greatest(F.lit(0), F.lit(0), *hits)
    return F.when(most > 0, F.coalesce(*(F.when(h == most, F.lit(name)) for (name, _), h in zip(rules, hits)))), most


def detect(text: Column, strong: Rules, weak: Rules, generic: str | None = None) -> Column:
    """Struct(name, confidence): a strong pattern gives 0.95, weak ones a third each, at most 1; then the first group of ``generic`` 0.3; else unknown."""
    s, _ = _best(text, strong)
    w, n = _best(text, weak)
    short = F.length(F.trim(F.coalesce(text, F.lit("")))) < 5
    named = F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?iu){generic}", 1)), F.lit("")) if generic else F.lit(None).cast("string")
    name = F.when(short, F.lit("unknown")).otherwise(F.coalesce(s, w, named, F.lit("unknown")))
    sure = F.when(short, 0.0).when(s.isNotNull(), 0.95).when(n > 0, F.round(F.least(n / 3, F.lit(1.0)), 3)).when(named.isNotNull(), 0.3).otherwise(0.0)
    return F.struct(name.alias("name"), sure.alias("confidence"))


def resolve(declared: Column, text: Column, file_name: Column, strong: Rules, weak: Rules) -> Column:
    """Facet of a row: the declared one if it is known, else the text's if surer than 0.3, else the file name's, else unknown."""
    known = [name for name, _ in weak]
    found = detect(text, strong, weak)
    own = F.trim(F.coalesce(declared, F.lit("")))
    by_name = F.coalesce(*(F.when(any_of(file_name, patterns), F.lit(name)) for name, patterns in weak), F.lit(None).cast("string"))
    return F.when(own.isin(known), own).otherwise(F.coalesce(F.when((found["confidence"] > 0.3) & found["name"].isin(known), found["name"]), by_name, F.lit("unknown")))


def small_talk(query: Column) -> Column:
    """greeting, thanks or farewell for messages of four words at most, else null."""
    t = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), "^[ .!?,]+|[ .!?,]+$", "")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    first = F.get(words, 0)
    kind = F.when(first.isin(*GREETINGS), "greeting").when(F.arrays_overlap(words, F.array(*map(F.lit, THANKS))), "thanks")
    return F.when(F.size(words) <= 4, kind.when(first.isin(*FAREWELLS) | t.isin("до свидания", "всего доброго", "всего хорошего"), "farewell"))
