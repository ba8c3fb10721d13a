"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every source gets a share of all words by its weight, at most ``MOST`` times its
own size; the excess goes to the other sources by weight until none is above.
A source whose target is r times its size is taken floor(r) times whole, and for
the rest the documents below a threshold of their hash are taken once more. The
threshold is found without sorting: words are summed by source and leading hash
bits, the bucket where the budget runs out is refined by the next bits, and all
other buckets are decided at once. Only sums per bucket are shuffled.

Defined results: a null text has size 0 and is taken 0 words; a null source is a
source of its own, last in order; the hash is that of doc_id and text, so rows
that share an identifier are decided one by one, and only equal rows together;
an empty table gives an empty result. Columns other than doc_id, text and
source are not read by the planning, and the pipeline form returns them as they
come.

The targets are found in one task over one row a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corvane.llm.store import columns, settle, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken this many times at most.
MOST = 3
#: Hash bits of each level of buckets, and of all levels.
BITS, HASH_BITS = 12, 48
#: Sources whose plan is broadcast, at most.
BROADCAST_SOURCES = 100_000
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def _hash() -> F.Column:
    """Leading bits of a digest of doc_id and text."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) by water-filling: one row a source, in closed form.

    With the sources in order of size / weight, the k-th is held at its most if
    the level that those before it leave is not below its own.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = (
        sums.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.sum("cap").over(level.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap"))
        .withColumn("weight_before", F.sum("weight").over(level.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("weight"))
        .withColumn("left", (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("held", F.col("cap") <= F.col("left") * F.col("weight"))
        .withColumn("rate", F.max(F.when(~F.col("held"), F.col("left"))).over(everything))
    )
    return filled.select("source", "source_size", F.when(F.col("held") | F.col("rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("rate") * F.col("weight"))).alias("target"))


def _thresholds(sized: DataFrame, plan: DataFrame, side) -> DataFrame:
    """(source, at): documents with a hash below ``at`` are taken once more.

    The last document that is taken is the one that brings the sum nearest to
    the budget.
    """
    # low: first hash of the bucket in which the budget runs out; below: words before it
    state = plan.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0.0).alias("below"))
    for depth in range(BITS, HASH_BITS + 1, BITS):
        shift = HASH_BITS - depth
        inside = sized.join(side(state), sized["source"].eqNullSafe(state["source"])).where(
            F.shiftright(F.col("hash"), shift + BITS) == F.shiftright(F.col("low"), shift + BITS) if depth > BITS else F.lit(True)
        ).select(state["source"], "budget", "below", (F.shiftright("hash", shift)).alias("bucket"), "size")
        sums = inside.groupBy("source", "budget", "below", "bucket").agg(F.sum("size").alias("words"))
        run = W.partitionBy("source").orderBy("bucket")
        cum = sums.withColumn("after", F.col("below") + F.sum("words").over(run)).withColumn("before", F.col("after") - F.col("words"))
        state = settle(
            cum.where("before < budget").groupBy("source", "budget").agg(F.max_by(F.struct((F.shiftleft("bucket", shift)).alias("low"), F.col("before").alias("below"), "after"), "bucket").alias("s"))
            .select("source", "budget", "s.low", "s.below", "s.after"), "mix-level")
        last = state
        state = state.drop("after")
    return last.select("source", F.when(F.col("after") - F.col("budget") < F.col("budget") - F.col("below"), F.col("low") + 1).otherwise(F.col("low")).alias("at"))


def _planned(docs: DataFrame, weights, most: int) -> tuple[DataFrame, DataFrame]:
    """The sizes and hashes of all rows, and for each source (``of``) its target, whole times and threshold, ready to be joined."""
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), _hash().alias("hash")), "mix-sizes")
    plan = settle(
        source_targets(sized, weights, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    # a row of a few numbers a source; beyond the bound, plain joins
    side = F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda x: x.hint("merge"))
    limits = _thresholds(sized, plan.where("budget > 0 AND source_size > 0").select("source", "budget"), side)
    targets = plan.join(limits.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", F.coalesce("at", F.lit(0)).alias("at"))
    return sized, side(targets)


_TIMES = "whole + CASE WHEN hash < at THEN 1 ELSE 0 END"


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, times (how often it is taken), taken."""
    sized, targets = _planned(docs, weights, most)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("times", F.expr(_TIMES))
    return joined.select("doc_id", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; texts are not shuffled while the sources can be broadcast."""
    _, targets = _planned(docs, weights, most)
    own = docs.select(F.struct(*columns(docs)).alias("row"), F.col("source").cast("string").alias("key"), _hash().alias("hash"))
    joined = own.join(targets, F.col("key").eqNullSafe(F.col("of"))).withColumn("times", F.expr(_TIMES))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


#: The same mix by sorting: budgets as running sums in hash order.
OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS hash
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM sums),
lev AS (SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
    sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS cap_before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - weight AS weight_before FROM weighed),
held AS (SELECT *, (all_size - cap_before) / (all_weight - weight_before) AS rest FROM lev),
rated AS (SELECT *, cap <= rest * weight AS is_held, max(CASE WHEN cap > rest * weight THEN rest END) OVER () AS rate FROM held),
targets AS (SELECT source, source_size, CASE WHEN is_held OR rate IS NULL THEN cap ELSE least(cap, rate * weight) END AS target FROM rated),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3, floor(target / source_size)) AS BIGINT) ELSE 0 END AS whole FROM targets),
budgets AS (SELECT *, target - whole * source_size AS budget FROM plan),
run AS (SELECT s.doc_id, s.size, s.source, b.source_size, b.target, b.whole, b.budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE UNBOUNDED PRECEDING), 0) AS after,
    sum(s.size) OVER (PARTITION BY s.source, s.hash) AS tied
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, source,
  CAST((whole + CASE WHEN budget > 0 AND source_size > 0 AND (after <= budget OR (after - tied < budget AND after - budget < budget - (after - tied))) AND NOT (after - tied >= budget) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM run
"""
