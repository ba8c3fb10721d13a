"""Search over whole batches of queries: legs, fusion, policy, neighbours, order, and all of them as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.functions import rules
from corvane.operators.postings import LEXICAL_K, LexicalIndex
from corvane.operators.scoring import nearest, ranked

#: Weight of the vector leg, rank offset, results of the vector legs (text, others) without an intent, and of a search.
ALPHA, OFFSET, VECTOR_K, SUMMARY_K, FINAL_K = 0.6, 60, 18, 7, 6
#: Exact rows from which a strict policy drops unknown ones, neighbours on each side and characters of an expanded text.
LEAST_EXACT, WINDOW, LONGEST = 2, 1, 2400


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = VECTOR_K, metric: str = "l2") -> DataFrame:
    """Nearest chunks of vectors(chunk_id, embedding) for each of the stated queries(query_id, query_embedding[, k]): query_id, chunk_id, score, rank.

    ``k`` as a column says how many each query wants. The lowest squared distance
    (l2) or the highest cosine comes first, then the lowest chunk_id.
    """
    own = queries if "k" in queries.columns else queries.withColumn("k", F.lit(k))
    found = nearest(vectors, own.select("query_id", "query_embedding", F.col("k").cast("long").alias("k")), metric)
    if found is None:
        kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (vectors, "chunk_id"))]
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, rank long")
    return ranked(found, [F.asc("score") if metric == "l2" else F.desc("score"), F.col("chunk_id")], F.col("k")).drop("k")


def two_legs(text: DataFrame, summary: DataFrame) -> DataFrame:
    """Text results, then summary results of each query: legs(query_id, chunk_id, rank); an id counts once, at its first place."""
    both = text.select("query_id", "chunk_id", "rank", F.lit(0).alias("leg")).unionByName(summary.select("query_id", "chunk_id", "rank", F.lit(1).alias("leg")))
    first = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("leg", "rank")).alias("place"))
    return ranked(first, [F.col("place"), F.col("chunk_id")], 1 << 30).drop("place")


def fuse(vector: DataFrame, lexical: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked legs: query_id, chunk_id, score, rank, vector_rank, lexical_rank.

    A missing leg adds nothing. Equal scores go by vector rank, lexical rank (a
    missing rank comes last), then chunk_id. Further columns that both legs have
    are kept: those of the lexical leg where it holds the chunk.
    """
    extra = [c for c in vector.columns if c in lexical.columns and c not in ("query_id", "chunk_id", "rank")]
    legs = []
    for n, (leg, weight) in enumerate(((lexical, 1 - alpha), (vector, alpha))):
        legs.append(leg.select("query_id", "chunk_id", F.lit(n).alias("leg"), "rank", (F.lit(weight) / (OFFSET + F.col("rank"))).alias("part"), F.struct(*(F.col(c) for c in extra), F.lit(n).alias("of")).alias("payload")))
    own = legs[0].unionByName(legs[1]).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("part"), 9).alias("fused"), F.min(F.when(F.col("leg") == 1, F.col("rank"))).alias("vector_rank"), F.min(F.when(F.col("leg") == 0, F.col("rank"))).alias("lexical_rank"), F.min_by("payload", "leg").alias("payload"))
    order = [F.desc("fused"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("lexical_rank"), F.col("chunk_id")]
    out = ranked(own, order, 1 << 30)
    return out.select("query_id", "chunk_id", F.col("fused").alias("score"), "rank", "vector_rank", "lexical_rank", *(F.col(f"payload.{c}").alias("leg_score" if c == "score" else c) for c in extra))


def without_quarantined(results: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Anti-join with quarantine(chunk_id[, reviewed]); reviewed rows hold nothing back."""
    own = quarantine.where("reviewed = 0") if "reviewed" in quarantine.columns else quarantine
    return results.join(own.select("chunk_id").distinct(), "chunk_id", "left_anti")


def facet_policy(results: DataFrame, strict: bool | Column = True) -> DataFrame:
    """Order results(query_id, facet, wanted, category, rank): exact, cross-category, unknown; strict drops unknown when two or more are exact. Others go.

    Rows whose ``wanted`` is null or unknown have no policy and keep their order.
    """
    free = F.coalesce(F.col("wanted"), F.lit("unknown")) == "unknown"
    bucket = F.when(free, 0).when(F.col("facet") == F.col("wanted"), 0).when(F.col("category").isin("legal", "procedure"), 1).when(F.col("facet") == "unknown", 2)
    exact = F.count_if((F.col("bucket") == 0) & ~free).over(W.partitionBy("query_id"))
    own = results.withColumn("bucket", bucket).where("bucket IS NOT NULL").withColumn("exact", exact)
    tight = strict if isinstance(strict, Column) else F.lit(strict)
    own = own.where(~(tight & (F.col("bucket") == 2) & (F.col("exact") >= LEAST_EXACT)))
    return own.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("bucket", "rank"))).drop("exact")


def reranked(results: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """Results(query_id, rank, content) in the order of ``score(query, content)``, highest first, for queries with more than ``k`` results; others keep theirs.

    ``score`` makes a column of two text columns: an expression, or a pandas UDF around a model.
    """
    n = F.count("*").over(W.partitionBy("query_id"))
    own = results.join(queries.select("query_id", F.col("query").alias("asked")), "query_id").withColumn("n", n)
    own = own.withColumn("model_score", score(F.col("asked"), F.coalesce("content", F.lit(""))).cast("double"))
    order = W.partitionBy("query_id").orderBy(F.when(F.col("n") > k, -F.col("model_score")).asc_nulls_last(), "rank")
    return own.withColumn("rank", F.row_number().over(order).cast("long")).drop("asked", "n")


def neighbours(wanted: DataFrame, chunks: DataFrame, window: int = WINDOW, longest: int = LONGEST) -> DataFrame:
    """``wanted``(source, seq, chunk_type, content) with the text chunks beside each in its source: content, context_expanded.

    Only text rows that have a seq are expanded, and only text joins them, by
    seq; the text may be cut at ``longest`` characters, at the last blank, with an
    ellipsis. chunks(source, seq, chunk_type, content) are met by equal keys
    (source, seq), so no source is gathered in one task.
    """
    names = wanted.columns
    texts = chunks.where("chunk_type = 'text'").groupBy("source", "seq").agg(F.array_join(F.array_sort(F.collect_list("content")), "\n").alias("text"))
    may = (F.coalesce("chunk_type", F.lit("text")) == "text") & F.col("seq").isNotNull()
    out = wanted.withColumn("_at", F.when(may, F.col("seq")))
    sides = [d for d in range(-window, window + 1) if d]
    for n, d in enumerate(sides):
        side = texts.select(F.col("source").alias("_source"), (F.col("seq") - d).alias("_seq"), F.col("text").alias(f"_beside{n}"))
        out = out.join(side, (F.col("source") == F.col("_source")) & (F.col("_at") == F.col("_seq")), "left").drop("_source", "_seq")
    before, behind = ([F.col(f"_beside{n}") for n, d in enumerate(sides) if keep(d)] for keep in (lambda d: d < 0, lambda d: d > 0))
    any_ = F.coalesce(*before, *behind).isNotNull()
    joined = F.trim(F.array_join(F.array_compact(F.array(*before, F.coalesce("content", F.lit("")), *behind)), "\n"))
    cut = F.concat(F.regexp_replace(F.substring(joined, 1, longest), r" [^ ]*$", ""), F.lit("…"))
    out = out.withColumn("_stitched", F.when(any_, F.when(F.length(joined) > longest, cut).otherwise(joined)))
    changed = F.coalesce((F.col("_stitched") != "") & (F.col("_stitched") != F.coalesce("content", F.lit(""))), F.lit(False))
    return out.withColumn("context_expanded", changed).withColumn("content", F.when(changed, F.col("_stitched")).otherwise(F.col("content"))).select(*names, "context_expanded")


def u_shape(results: DataFrame) -> DataFrame:
    """Put the best results at both ends: first, last, second, second to last."""
    n = F.count("*").over(W.partitionBy("query_id"))
    half = F.ceil(F.col("n") / 2)
    return results.withColumn("n", n).withColumn("position", F.when(F.col("n") <= 2, F.col("rank")).when(F.col("rank") <= half, 2 * F.col("rank") - 1).otherwise(2 * (F.col("n") - F.col("rank") + 1))).drop("n")


def facet_filtered(leg: DataFrame, store: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of one leg whose facet is the query's or unknown, ranked anew; it comes after the leg's own limit. Queries without a facet keep all."""
    facets = store.select("chunk_id", F.coalesce("facet", F.lit("unknown")).alias("facet"))
    own = leg.select("query_id", "chunk_id", "score", "rank").join(facets, "chunk_id", "left").join(queries.select("query_id", "wanted"), "query_id")
    kept = own.where(F.col("wanted").isNull() | F.col("facet").isin("unknown") | (F.col("facet") == F.col("wanted")) | F.col("facet").isNull())
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("long")).select("query_id", "chunk_id", "score", "rank")


def search(
    queries: DataFrame, store: DataFrame, lexical: LexicalIndex, vectors: DataFrame | None = None, quarantine: DataFrame | None = None, k: int = FINAL_K, strict: bool = True,
    rerank: Callable[[Column, Column], Column] | None = None, expand: bool = True,
) -> DataFrame:
    """The whole search for queries(query_id, query[, facet, query_embedding]).

    store(chunk_id, content, chunk_type, source, page, heading, facet, category,
    seq[, full_content]); vectors(chunk_id, embedding). Intents size the vector
    legs (text, then other types); facets filter each leg after its limit; legs
    are fused; quarantine, facet policy and reranking follow; the best ``k`` are
    hydrated and expanded. Returns query_id, rank, position (in a prompt), score
    and the columns of the store.
    """
    own = queries.withColumn("wanted", F.nullif("facet", F.lit("unknown")) if "facet" in queries.columns else F.lit(None).cast("string"))
    legs = facet_filtered(lexical.search(own.select("query_id", "query"), LEXICAL_K), store, own)
    if vectors is not None and "query_embedding" in queries.columns:
        sized = own.withColumn("sizes", rules.leg_sizes(rules.intent(F.col("query"))))
        typed = vectors.join(store.select("chunk_id", "chunk_type"), "chunk_id")
        text = vector_topk(typed.where("chunk_type = 'text'"), sized.select("query_id", "query_embedding", F.col("sizes.text_k").alias("k")))
        other = vector_topk(typed.where("chunk_type <> 'text'"), sized.select("query_id", "query_embedding", F.col("sizes.summary_k").alias("k")))
        vector = two_legs(text, other).withColumn("score", F.lit(None).cast("double"))
        legs = fuse(facet_filtered(vector, store, own), legs)
    legs = without_quarantined(legs, quarantine) if quarantine is not None else legs
    placed = legs.select("query_id", "chunk_id", "score", "rank").join(store, "chunk_id").join(own.select("query_id", "wanted"), "query_id")
    placed = facet_policy(placed, strict).withColumn("rank", F.col("position").cast("long")).drop("position", "bucket", "wanted")
    placed = reranked(placed, queries, rerank, k) if rerank is not None else placed
    top = ranked(placed.withColumnRenamed("rank", "place"), [F.col("place")], k).drop("place")
    top = neighbours(top, store) if expand else top.withColumn("context_expanded", F.lit(False))
    return u_shape(top)
