"""Evaluation and validation of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import elements as E

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
#: Answers shorter than this are not checked.
LEAST_CHARS = 50


def score_of(reply: Column) -> Column:
    """First number of a judge's reply that is in 0 to 10, as a tenth; 0 without one."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1)), lambda x: x.cast("double"))
    return F.round(F.coalesce(F.get(F.filter(numbers, lambda x: x <= 10), 0) / 10, F.lit(0.0)), 3)


def rag_score(*metrics: Column) -> Column:
    """Mean of the positive metrics, three decimals; 0 without one."""
    own = F.filter(F.array(*metrics), lambda x: x > 0)
    return F.round(F.coalesce(F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0)), 3)


def report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Averages of metrics, token F1 and score over the rows without an error."""
    own = results.withColumn("rag_score", rag_score(*map(F.col, METRICS)))
    mean = lambda c: F.round(F.avg(F.when(F.col("error").isNull(), F.col(c))), 3).alias(c)
    return own.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count("error").alias("n_errors"), *map(mean, (*METRICS, "token_f1", "rag_score")))


def validated(answers: DataFrame) -> DataFrame:
    """Status of answers(answer, sources array<struct<source, page>>, factual boolean or null).

    Short answers are approved unchecked. A judged falsehood rejects; no citation, or one
    whose page and document match no source, asks for review. Without sources the
    citations are not compared. ``fake`` lists the documents that match nothing.
    """
    cited = F.col("cited")
    known = F.transform(F.filter("sources", lambda s: F.coalesce(s["source"], F.lit("")) != ""), lambda s: F.struct(F.lower(F.substring_index(s["source"], "/", -1)).alias("name"), s["page"].alias("page")))
    real = lambda c: F.exists(F.col("known"), lambda s: (s["page"] == c["page"]) & (s["name"].contains(F.lower(c["doc"])) | F.lower(c["doc"]).contains(s["name"])))
    own = answers.withColumn("cited", E.citations(F.col("answer"))).withColumn("known", F.coalesce(known, F.expr("cast(array() as array<struct<name: string, page: bigint>>)")))
    own = own.withColumn("fake", F.when(F.size("known") > 0, F.transform(F.filter(cited, lambda c: ~F.coalesce(real(c), F.lit(False))), lambda c: c["doc"])).otherwise(F.expr("cast(array() as array<string>)")))
    short = F.length(F.trim(F.coalesce(F.col("answer"), F.lit("")))) < LEAST_CHARS
    false = ~F.coalesce(F.col("factual"), F.lit(True))
    status = F.when(short, "approved").when(false, "rejected").when((F.size(cited) == 0) | (F.size("fake") > 0), "review").otherwise("approved")
    return own.withColumn("n_citations", F.size(cited)).withColumn("status", status).drop("cited", "known")
