"""Messages of a chat: text, commands, buttons, menus, answers. Menus and names of things are parameters."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Commands by name; the first rows also belong to a menu.
COMMANDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("menu", ("/start", "start", "начать", "/menu", "menu", "меню", "главное меню")),
    ("back", ("назад", "⬅️ назад", "back", "/back")),
    ("faq", ("частые вопросы", "❓ частые вопросы", "faq", "/faq", "вопросы")),
    ("models", ("выбрать модель",)),
    ("general", ("💬 общие вопросы", "общие вопросы", "общий режим")),
    ("help", ("/help", "help", "помощь", "что ты умеешь")),
    ("model", ("/model", "model", "модель", "сменить модель", "выбрать модель")),
    ("reset", ("/reset", "reset", "сброс", "очистить историю")),
    ("health", ("/health", "health", "статус")),
)
#: Fixed value: a preference for no model in particular.
ANY = "any"
#: Answers that replace or precede others.
BLOCKED, REVIEW, REVIEW_MARK, FOUND, NOTHING_FOUND = (
    "По вашему запросу не найдено точного ответа в официальных источниках.", "Требуется проверка по официальной документации.\n\n", "Требуется проверка",
    "Источники, найденные системой:", "По вашему запросу не найдено релевантных фрагментов в официальной документации.")
#: Sources that an answer lists.
LISTED = 3


def _stripped(text: Column, blank: str = r"\s") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{blank}+|{blank}+\z", "")


def plain(text: Column, group_chat: Column | bool = False, aliases: Sequence[str] = (), blank: str = r"\s") -> Column:
    """A message without the mention of the group and, in chats of several people, without the first of the bot's names.

    ``blank`` matches a character that goes at the ends and around what is removed.
    """
    own = _stripped(F.regexp_replace(_stripped(text, blank), rf"(?iu)^\[club\d+\|[^\]]+\]{blank}*[,;:—-]?{blank}*", ""), blank)
    if not aliases:
        return own
    named = _stripped(F.regexp_replace(own, rf"(?iu)^@?(?:{'|'.join(map(re.escape, aliases))}){blank}*[,;:—-]?{blank}*", ""), blank)
    return F.when(group_chat if isinstance(group_chat, Column) else F.lit(group_chat), named).otherwise(own)


def command(text: Column, commands=COMMANDS, admin: Column | None = None) -> Column:
    """Name of the command that a message is, else null; ``health`` answers admins only (``denied`` for others)."""
    own = F.regexp_replace(F.lower(_stripped(text)), r"\s+", " ")
    name = F.coalesce(*(F.when(own.isin(*words), F.lit(n)) for n, words in commands))
    return name if admin is None else F.when((name == "health") & ~F.coalesce(admin, F.lit(False)), "denied").otherwise(name)


def button(payload: Column, known: Sequence[str]) -> Column:
    """Struct(action, target) of a button's payload: nav (to a menu, main without one), help, faq (an item), set_model (a known model or any); null for other payloads."""
    own = F.from_json(payload, "cmd string, to string, id string, model string")
    cmd, model = F.trim(own["cmd"]), F.trim(F.coalesce(own["model"], F.lit("")))
    target = F.when(cmd == "nav", F.coalesce(F.nullif(own["to"], F.lit("")), F.lit("main"))).when(cmd == "faq", F.trim(F.coalesce(own["id"], F.lit("")))).when(cmd == "set_model", model).otherwise("")
    fits = cmd.isin("nav", "help", "faq") | ((cmd == "set_model") & model.isin(*known, ANY))
    return F.when(fits, F.struct(cmd.alias("action"), target.alias("target")))


def question_of(items: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(faq_id) with the question of items(id, question); null for an item that is not there. The items are a menu, so they are few."""
    return asked.join(F.broadcast(items.select(F.trim("id").alias("_id"), "question")), F.trim("faq_id") == F.col("_id"), "left").drop("_id")


def keyboard(rows: Sequence[Sequence[tuple[str, dict, str]]], inline: bool = False, one_time: bool = False) -> str:
    """JSON of a keyboard: rows of buttons (label, payload, color); a payload is a text inside it."""
    made = [[{"action": {"type": "text", "label": label, "payload": json.dumps(payload, ensure_ascii=False)}, "color": color} for label, payload, color in row] for row in rows]
    head = {"inline": True} if inline else {"one_time": one_time, "inline": False}
    return json.dumps({**head, "buttons": made}, ensure_ascii=False)


def model_rows(models: Sequence[tuple[str, str]], unsure: str, wide: int = 2) -> list[list[tuple[str, dict, str]]]:
    """Rows of buttons that choose a model (name, label), the last of them any."""
    every = [(label, {"cmd": "set_model", "model": name}, "primary") for name, label in models] + [(unsure, {"cmd": "set_model", "model": ANY}, "secondary")]
    return [every[k : k + wide] for k in range(0, len(every), wide)]


def faq_rows(items: Sequence[tuple[str, str]]) -> list[list[tuple[str, dict, str]]]:
    """A row with a button for each item (id, label)."""
    return [[(label, {"cmd": "faq", "id": name}, "secondary")] for name, label in items]


def menu_rows(entries: Sequence[tuple[str, dict]], first: str = "primary") -> list[list[tuple[str, dict, str]]]:
    """A row for each entry (label, payload) of a menu; the first stands out."""
    return [[(label, payload, "secondary" if k else first)] for k, (label, payload) in enumerate(entries)]


def back_row(label: str, to: str = "main") -> list[tuple[str, dict, str]]:
    return [(label, {"cmd": "nav", "to": to}, "secondary")]


def source_lines(sources: Column) -> Column:
    """Lines for the first distinct places of array<struct<document, page>> that have a document."""
    named = F.filter(sources, lambda s: F.trim(F.coalesce(s["document"], F.lit(""))) != "")
    shown = F.array_distinct(F.transform(named, lambda s: F.concat(F.lit("- "), F.trim(s["document"]), F.lit(", стр. "), F.coalesce(s["page"].cast("string"), F.lit("")))))
    return F.array_join(F.slice(shown, 1, LISTED), "\n")


def formatted(answer: Column, status: Column, sources: Column, header: Column) -> Column:
    """An answer as it goes out: header, a note if it needs review, the answer (or what replaces a rejected one), its sources unless it cites some."""
    own = _stripped(F.coalesce(F.nullif(answer, F.lit("")), F.lit("Не удалось сгенерировать ответ.")))
    own = F.when(status == "rejected", F.lit(BLOCKED)).when((status == "review") & ~own.startswith(REVIEW_MARK), F.concat(F.lit(REVIEW), own)).otherwise(own)
    lines = source_lines(sources)
    cited = own.contains("[Документ:") | (F.coalesce(lines, F.lit("")) == "")
    return _stripped(F.concat(header, F.when(cited, own).otherwise(F.concat(F.regexp_replace(own, r"\s+$", ""), F.lit(f"\n\n{FOUND}\n"), lines))))


def model_header(facet: Column, labels: dict[str, str], otherwise: str) -> Column:
    """Header with the label of a known facet, else a hint that none is chosen."""
    named = F.coalesce(*(F.when(facet == k, F.lit(v)) for k, v in labels.items()), F.lit(otherwise))
    return F.concat(F.lit("Модель: "), named, F.lit("\n\n"))
