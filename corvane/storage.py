"""Working tables and indexes in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_marked: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``; it is deleted when the driver ends.

    Without that setting a local temporary folder serves in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/corvane-work"
    uri = f"{base.rstrip('/')}/corvane/{spark.sparkContext.applicationId}-engine"
    if uri not in _marked:
        files, path = _files(spark, uri)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(uri)
    return uri


def _files(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    files, path = _files(spark, uri)
    return files.exists(path)


def is_folder(spark: SparkSession, uri: str) -> bool:
    files, path = _files(spark, uri)
    return files.getFileStatus(path).isDirectory()


def delete(spark: SparkSession, uri: str) -> None:
    files, path = _files(spark, uri)
    files.delete(path, True)


def move(spark: SparkSession, uri: str, to: str) -> None:
    """Rename a folder; what was there goes."""
    files, path = _files(spark, uri)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    files.delete(target, True)
    if not files.rename(path, target):
        raise OSError(f"{uri} could not be renamed to {to}")


def read_text(spark: SparkSession, uri: str) -> str | None:
    """A small text file, None if it is not there."""
    files, path = _files(spark, uri)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    files, path = _files(spark, uri)
    stream = files.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: the lineage ends there, and what the rows are does not change any more."""
    spark = df.sparkSession
    uri = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


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


def fingerprint(spark: SparkSession, uri: str) -> str:
    """Digest of names, lengths and times of the files at ``uri``; it changes when the table does."""
    files, path = _files(spark, uri)
    status = files.globStatus(path)
    found = []
    for s in status or []:
        for x in files.listStatus(s.getPath()) if s.isDirectory() else [s]:
            found.append(f"{x.getPath().toString()}:{x.getLen()}:{x.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]
