"""Interfaces to models, and stand-ins that need none.

A model is a function over batches: embedders take texts and give vectors,
generators take prompts and give replies, scorers take (query, text) pairs and
give numbers, captioners take the bytes of a picture. ``factory`` makes it, once
a Python worker, so that a heavy model is loaded once. Providers are named in
``PROVIDERS`` and can be added there.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.functions import elements as E, text as X
from corvane.operators import evaluate

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[list[str]], list[str]]
Scorer = Callable[[list[str], list[str]], list[float]]
Captioner = Callable[[list[bytes]], list[str]]
_TOKEN = re.compile(X.WANTED_TOKEN)
#: Prefixes of passages and queries that local embedders expect.
PASSAGE, QUERY = "passage: ", "query: "


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic stand-in: signed token hashes, summed and brought to unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for k, text in enumerate(texts):
            for token in _TOKEN.findall(re.sub(r"(?i)^(?:\s*(?:passage|query):){1,3}\s*", "", text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest())
                out[k, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()

    return embed


def extractive_generator(most: int = 600) -> Generator:
    """Deterministic stand-in: the first cited passage of a prompt's context, with its source."""

    def generate(prompts: list[str]) -> list[str]:
        found = (re.search(r"(\[Документ:[^\]]*\])\n(.*?)(?=\n--- |\n</|\n\n|$)", p or "", re.S) for p in prompts)
        return [f"{m[2].strip()[:most]}\n{m[1]}" if m else "" for m in found]

    return generate


def overlap_scorer() -> Scorer:
    """Deterministic stand-in: share of the query's tokens that the text holds."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        sets = [(set(_TOKEN.findall((q or "").lower())), set(_TOKEN.findall((t or "").lower()))) for q, t in zip(queries, texts)]
        return [len(q & t) / len(q) if q else 0.0 for q, t in sets]

    return score


#: Factories by kind and provider.
PROVIDERS: dict[str, dict[str, Callable[[], Callable]]] = {
    "embedding": {"hashing": hashing_embedder}, "generation": {"extractive": extractive_generator}, "reranking": {"overlap": overlap_scorer},
}


def provider(kind: str, name: str) -> Callable[[], Callable]:
    """Factory of a provider; an unknown name is an error that lists the known ones."""
    known = PROVIDERS.get(kind, {})
    if name not in known:
        raise ValueError(f"unknown {kind} provider {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


def _each(factory: Callable[[], Callable], kind: str, arguments: int) -> Callable[..., Column]:
    """Column function that calls the model batch by batch; the model is made once a worker."""
    if arguments == 1:

        @F.pandas_udf(kind)
        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for batch in batches:
                yield pd.Series(list(model(batch.tolist())), dtype=object if kind != "double" else float)

        return one

    @F.pandas_udf(kind)
    def many(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield pd.Series(list(model(*(b.tolist() for b in batch))), dtype=object if kind != "double" else float)

    return many


def embedding(factory: Callable[[], Embedder], prefix: str = "") -> Callable[[Column], Column]:
    """Column of vectors of a text column; texts get ``prefix`` unless they have one."""
    udf = _each(factory, "array<double>", 1)
    return lambda text: udf(X.with_prefix(text, prefix) if prefix else F.coalesce(text, F.lit("")))


def reply(factory: Callable[[], Generator]) -> Callable[[Column], Column]:
    """Column of replies to a column of prompts."""
    udf = _each(factory, "string", 1)
    return lambda prompt: F.trim(udf(F.coalesce(prompt, F.lit(""))))


def likeness(factory: Callable[[], Scorer]) -> Callable[[Column, Column], Column]:
    """Column of scores of a query and a text column, for ``retrieval.reranked``."""
    return _each(factory, "double", 2)


def captioned(figures: DataFrame, pictures: DataFrame, factory: Callable[[], Captioner], most: int = 0, fragments: tuple[str, ...] = ()) -> DataFrame:
    """Figures(chunk_id, content, image_path) with weak captions replaced: content, vision_caption.

    Only weak captions whose picture is in pictures(image_path, data) are sent to
    the model, the first ``most`` by chunk_id if a limit is set; a caption stays in
    front of the description unless it is a placeholder.
    """
    weak = figures.where(E.is_weak_caption(F.col("content"), fragments)).join(pictures, "image_path").select("chunk_id", "content", "data")
    if most:  # the limit of model calls is the feature
        weak = weak.orderBy("chunk_id").limit(most)
    own = F.trim(F.coalesce("content", F.lit("")))
    kept = F.when((own == "") | F.lower(own).startswith("изображение"), "").otherwise(F.concat(own, F.lit(". ")))
    new = weak.withColumn("said", F.trim(F.coalesce(_each(factory, "string", 1)(F.col("data")), F.lit("")))).where(F.col("said") != "").select("chunk_id", F.concat(kept, F.col("said")).alias("described"))
    out = figures.join(new, "chunk_id", "left").withColumn("vision_caption", F.col("described").isNotNull())
    return out.withColumn("content", F.coalesce("described", "content")).drop("described")


#: Wording of the judge's questions; what is in braces is taken from the row's columns.
QUESTIONS = {
    "faithfulness": "Вопрос: {question}\nКонтекст:\n{context}\nОтвет:\n{answer}\nСодержит ли ответ только сведения из контекста? Одно число от 0 до 10.",
    "answer_relevancy": "Вопрос: {question}\nОтвет:\n{answer}\nОтвечает ли ответ на вопрос? Одно число от 0 до 10.",
    "context_precision": "Вопрос: {question}\nКонтекст:\n{context}\nКакая доля фрагментов нужна для ответа? Одно число от 0 до 10.",
    "context_recall": "Вопрос: {question}\nЭталон: {reference}\nКонтекст:\n{context}\nХватает ли контекста для полного ответа? Одно число от 0 до 10.",
}


def filled(wording: str) -> Column:
    """Text column of a wording with columns in braces; null values are empty."""
    parts = re.split(r"\{(\w+)\}", wording)
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for k, p in enumerate(parts)))


def judged(rows: DataFrame, factory: Callable[[], Generator], questions: dict[str, str] | None = None) -> DataFrame:
    """Rows(question, answer, context, reference) with the judge's scores, token F1 and has_reference; without a reference recall and F1 are 0."""
    from corvane.operators import records

    ask, has = reply(factory), F.coalesce("reference", F.lit("")) != ""
    own = records.token_f1(rows.withColumn("has_reference", has), "answer", "reference")
    for metric, wording in (questions or QUESTIONS).items():
        score = evaluate.score_of(ask(filled(wording)))
        own = own.withColumn(metric, F.when(F.col("has_reference"), score).otherwise(0.0) if "{reference}" in wording else score)
    return own


#: Wording of the question whether an answer keeps to its context, and characters of both that are shown.
FACTUAL, CONTEXT_CHARS, ANSWER_CHARS = "Проверь, основан ли ответ только на контексте.\n<retrieved_context>{context}</retrieved_context>\n<generated_answer>{answer}</generated_answer>\nОтветь JSON: {{\"is_factual\": true/false, \"issues\": []}}", 6000, 3000


def factual(answers: DataFrame, factory: Callable[[], Generator], wording: str = FACTUAL) -> DataFrame:
    """Answers(answer, context) with ``factual``: the judge's verdict; a reply without a readable verdict counts as true."""
    own = answers.withColumn("_c", F.substring(F.coalesce("context", F.lit("")), 1, CONTEXT_CHARS)).withColumn("_a", F.substring(F.coalesce("answer", F.lit("")), 1, ANSWER_CHARS))
    text = filled(wording.replace("{context}", "{_c}").replace("{answer}", "{_a}").replace("{{", "{").replace("}}", "}"))
    verdict = F.regexp_extract(reply(factory)(text), r'(?s)(\{[^{}]*"is_factual"[^{}]*\})', 1)
    return own.withColumn("factual", F.coalesce(F.get_json_object(verdict, "$.is_factual").try_cast("boolean"), F.lit(True))).drop("_c", "_a")


#: Turns that a rewriting sees, characters of each, turns that must be there, and lengths between which a rewritten question is taken.
TURNS, TURN_CHARS, LEAST_TURNS, REWRITTEN = 4, 200, 2, (10, 500)
REWRITE = "История диалога:\n{history}\n\nТекущий вопрос пользователя:\n{query}\n\nПереформулируй вопрос в самостоятельный запрос. Верни только вопрос."


def rewritten(queries: DataFrame, history: DataFrame, factory: Callable[[], Generator], wording: str = REWRITE) -> DataFrame:
    """Queries(query_id, user_id, query) with ``search_query``: rewritten by the model where the question points back and the user has a history(user_id, nth, role, content); else the query."""
    from corvane.functions import rules

    back = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("nth")))
    turn = F.concat(F.initcap("role"), F.lit(": "), F.substring("content", 1, TURN_CHARS))
    count = F.count("*").over(W.partitionBy("user_id"))
    last = history.withColumn("back", back).withColumn("n", count).where((F.col("back") <= TURNS) & (F.col("n") >= LEAST_TURNS)).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", turn.alias("turn")))), lambda s: s["turn"]), "\n").alias("history"))
    own = queries.join(last, "user_id", "left").withColumn("asks", F.col("history").isNotNull() & rules.needs_rewrite(F.col("query")))
    said = reply(factory)(F.when(F.col("asks"), filled(wording)).otherwise(""))
    fits = F.col("asks") & (F.length("said") > REWRITTEN[0]) & (F.length("said") < REWRITTEN[1])
    return own.withColumn("said", said).withColumn("search_query", F.when(fits, F.col("said")).otherwise(F.col("query"))).drop("said", "history", "asks")


@functools.lru_cache(64)
def canned(replies: str) -> Callable[[], Generator]:
    """Factory of a generator for tests: a JSON object of (part of a prompt) to reply; other prompts get an empty reply."""
    known = json.loads(replies)
    return lambda: lambda prompts: [next((r for part, r in known.items() if part in (p or "")), "") for p in prompts]
