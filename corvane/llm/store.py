"""Shared working storage: settled tables and checkpoint folders.

On a cluster the driver and the executors share only the folder that
``spark.checkpoint.dir`` names; it is read from the session. A temporary folder
takes its place only in local mode without that setting (tests); elsewhere its
absence is an error. Working tables lie below a folder of the application, which
goes when the driver ends; results that are files lie beside it and stay.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_marked: set[str] = set()


def base_uri(spark: SparkSession) -> str:
    """Folder that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/corvane-work"
    return f"{base.rstrip('/')}/corvane"


def work_uri(spark: SparkSession) -> str:
    """Folder of the working tables of this application; it is deleted when the driver ends."""
    uri = f"{base_uri(spark)}/{spark.sparkContext.applicationId}"
    if uri not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(uri)
    return uri


def fresh_uri(spark: SparkSession, name: str) -> str:
    return f"{work_uri(spark)}/{name}-{uuid.uuid4().hex}"


def lasting_uri(spark: SparkSession, name: str) -> str:
    """Address for files that are a result: they are not deleted with the working tables."""
    return f"{base_uri(spark)}/{name}-{uuid.uuid4().hex}"


def settle_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`settle`, with the folder's address, so that the caller can :func:`discard` it."""
    spark = df.sparkSession
    uri = fresh_uri(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends here and survives lost executors."""
    return settle_at(df, name)[0]


def discard(spark: SparkSession, uri: str) -> None:
    """Delete a settled table that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch that goes to a Python worker; what a worker and its executor hold at a time follows from it.
BATCH_ROWS = 1000


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with its session set to hand texts to Python workers in small batches.

    Spark reads the setting when the plan runs, after the operator has returned,
    so it has to stay; a smaller value of the caller's own is left alone.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


def columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def through(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` after ``run``, with the same columns. ``text`` keeps its name on the way; other names may hold dots, which Spark would resolve."""
    moved = small_batches(docs).toDF(*(c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)))
    return moved.mapInArrow(run, moved.schema).toDF(*docs.columns)


#: Bytes of a table from which its rows are spread, if its files make fewer partitions than there are cores.
LEAST_SPREAD = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table read from files, dealt by its first column if its files make fewer partitions than the cluster has cores.

    Files of one row group are one task. What is dealt anew is at most a partition
    a core; larger tables are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(plan.optimizedPlan().stats().sizeInBytes()) < LEAST_SPREAD or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, df.columns[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
