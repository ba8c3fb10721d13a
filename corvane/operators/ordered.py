"""Running values over long ordered sequences, without one task for a hot key.

Rows are ranged by key and order into blocks of bounded size; a block's own
running value is found inside it, and what earlier blocks of the key carry over
comes from one row a block. A key with a third of all rows is many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.storage import settle

_BLOCK = "_block"


def _blocked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the number of their range; settled, for the numbers must not change afterwards."""
    return settle(rows.repartitionByRange(F.col(key), F.col(order)).withColumn(_BLOCK, F.spark_partition_id()), "ordered")


def _within(key: str, order: str) -> W:
    return W.partitionBy(key, _BLOCK).orderBy(order)


def _joined(blocks: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """Rows with the carried values of their block; a null key is a key."""
    small = carried.select(F.col(key).alias("_key"), F.col(_BLOCK).alias("_of"), "_carried")
    return blocks.join(small, F.col(key).eqNullSafe(F.col("_key")) & (F.col(_BLOCK) == F.col("_of")), "left").drop("_key", "_of")


def running_sum(rows: DataFrame, value: Column, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the key up to each."""
    blocks = _blocked(rows.withColumn("_value", value.cast("long")), key, order)
    sums = blocks.groupBy(key, _BLOCK).agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(key).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.withColumn("_carried", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    own = F.sum("_value").over(_within(key, order).rowsBetween(W.unboundedPreceding, 0))
    return _joined(blocks, carried, key).withColumn(name, F.col("_carried") + own).drop(_BLOCK, "_value", "_carried")


def last_known(rows: DataFrame, value: Column, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` of the key up to each; null before the first."""
    blocks = _blocked(rows.withColumn("_value", value), key, order)
    ends = blocks.groupBy(key, _BLOCK).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    before = W.partitionBy(key).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", True).over(before))
    own = F.last("_value", True).over(_within(key, order).rowsBetween(W.unboundedPreceding, 0))
    return _joined(blocks, carried, key).withColumn(name, F.coalesce(own, F.col("_carried"))).drop(_BLOCK, "_value", "_carried")


def with_previous(rows: DataFrame, value: Column, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: a struct(value) of the row of the key before each, null before the first."""
    blocks = _blocked(rows.withColumn("_value", F.struct(value.alias("value"))), key, order)
    ends = blocks.groupBy(key, _BLOCK).agg(F.max_by("_value", order).alias("_end"))
    before = W.partitionBy(key).orderBy(_BLOCK)
    carried = ends.withColumn("_carried", F.lag("_end").over(before))
    return _joined(blocks, carried, key).withColumn(name, F.coalesce(F.lag("_value").over(_within(key, order)), F.col("_carried"))).drop(_BLOCK, "_value", "_carried")
