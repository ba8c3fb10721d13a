"""Indexes that move: manifests, bundles, reports, and the manifest of an ingest.

A bundle is a folder of the files of an index, below ``output/``, with a manifest
of its settings, counts and checksums. Files are copied by the tasks that read
them; the driver handles the manifest only. Where both places are local, a
bundle can be one zip archive.
"""

from __future__ import annotations

import json
import os
import posixpath
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane import storage
from corvane.functions import paths
from corvane.operators import indexes, records

MANIFEST, PREFIX = "index_manifest.json", "output"
#: Folders that stay behind.
LEFT_OUT = ("metadata", "logs")


def _below(path: F.Column, home: str) -> F.Column:
    """Path relative to a folder, whatever the scheme of both."""
    base = home.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    plain = F.regexp_replace(path, "^[a-z]+:/*", "/")
    return F.when(F.locate(base, plain) > 0, plain.substr(F.locate(base, plain) + len(base), F.length(plain))).otherwise(plain)


def files_of(spark: SparkSession, home: str, content: bool = False) -> DataFrame:
    """(path, size, sha256[, content]) of the files of an index that a bundle takes: no metadata, logs, hidden files or archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(home)
    own = files.select(_below(F.col("path"), home).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), *(["content"] if content else []))
    name = F.substring_index("path", "/", -1)
    left = F.substring_index("path", "/", 1).isin(*LEFT_OUT) & F.col("path").contains("/")
    return own.where(~left & ~name.startswith(".") & ~name.endswith(".zip") & (name != MANIFEST))


def manifest(files: DataFrame, settings: dict[str, str], counts: DataFrame, version: str, created_at: F.Column) -> DataFrame:
    """One row: version, created_at, embedding (settings), counts, files (path to size and checksum), and all of it as ``json``. counts is one row."""
    listed = files.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", F.struct("size", "sha256").alias("entry"))))).alias("files"))
    own = listed.crossJoin(counts.select(F.struct(*counts.columns).alias("counts")))  # rows of one
    fields = F.struct(*(F.lit(v).alias(k) for k, v in sorted(settings.items())))
    out = own.select(F.lit(version).alias("version"), F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"), fields.alias("embedding"), "counts", "files")
    return out.withColumn("json", F.to_json(F.struct(*out.columns)))


def pack(spark: SparkSession, home: str, bundle: str, settings: dict[str, str], version: str = "1") -> int:
    """Write the index at ``home`` with its manifest to a bundle; the number of its files."""
    files = files_of(spark, home)
    counts = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    row = manifest(files, settings, counts, version, F.current_timestamp()).first()
    if not row["files"]:
        raise FileNotFoundError(f"no index at {home}")
    if bundle.endswith(".zip"):
        return _zip(home, bundle, sorted(row["files"]), row["json"])
    _copied(files_of(spark, home, content=True), f"{bundle.rstrip('/')}/{PREFIX}")
    storage.write_text(spark, f"{bundle.rstrip('/')}/{PREFIX}/{MANIFEST}", row["json"])
    return len(row["files"])


def _copied(files: DataFrame, to: str) -> None:
    """Write files(path, content) below ``to``, each by the task that read it."""
    from pyarrow import fs as pafs

    target = to if "://" in to else f"file://{to}"

    def run(batches):
        out, root = pafs.FileSystem.from_uri(target)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                at = posixpath.join(root, path)
                out.create_dir(posixpath.dirname(at), recursive=True)
                with out.open_output_stream(at) as stream:
                    stream.write(content)
            yield batch[["path"]]

    files.select("path", "content").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def _zip(home: str, archive: str, names: list[str], text: str) -> int:
    base = home.removeprefix("file://")
    os.makedirs(os.path.dirname(os.path.abspath(archive)), exist_ok=True)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as out:
        out.writestr(f"{PREFIX}/{MANIFEST}", text)
        for name in names:
            out.write(os.path.join(base, name), f"{PREFIX}/{name}")
    return len(names)


def unsafe(names: list[str]) -> list[str]:
    """Names that would leave the folder they are unpacked into."""
    return [n for n in names if n.startswith(("/", "\\")) or ":" in n.split("/")[0] or ".." in n.replace("\\", "/").split("/")]


def unpack(spark: SparkSession, bundle: str, home: str, settings: dict[str, str] | None = None, force: bool = False) -> list[str]:
    """Put a bundle's index at ``home``; the settings in which it differs from ``settings``.

    An index that is there is replaced only with ``force``; a bundle with a name
    that leads out of its folder, or a file that is not what the manifest says,
    is refused before anything is written, or taken away again.
    """
    if storage.exists(spark, home) and not files_of(spark, home).isEmpty() and not force:
        raise FileExistsError(f"there is an index at {home}")
    if bundle.endswith(".zip"):
        text = _unzip(bundle, home)
    else:
        source = f"{bundle.rstrip('/')}/{PREFIX}"
        text = storage.read_text(spark, f"{source}/{MANIFEST}")
        files = files_of(spark, source, content=True)
        if bad := unsafe([r["path"] for r in files.select("path").toLocalIterator()]):
            raise ValueError(f"unsafe names in the bundle: {bad[:3]}")
        if force:
            storage.delete(spark, home)
        _copied(files, home)
    known = json.loads(text) if text else {}
    if known:
        storage.write_text(spark, f"{home.rstrip('/')}/{MANIFEST}", text)
        wanted = spark.createDataFrame([(p, e["sha256"]) for p, e in known["files"].items()], "path string, sha string")
        damaged = wanted.join(files_of(spark, home), "path", "left").where("sha256 IS NULL OR sha <> sha256")
        if not damaged.isEmpty():
            storage.delete(spark, home)
            raise ValueError("the bundle is damaged")
    return indexes.incompatible(known.get("embedding", {}), settings) if settings is not None and known else []


def _unzip(archive: str, home: str) -> str | None:
    base = home.removeprefix("file://")
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        if bad := unsafe(names) + [n for n in names if not n.startswith(f"{PREFIX}/")]:
            raise ValueError(f"unsafe names in the bundle: {bad[:3]}")
        for name in names:
            at = os.path.join(base, name.removeprefix(f"{PREFIX}/"))
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "wb") as out:
                out.write(z.read(name))
        return z.read(f"{PREFIX}/{MANIFEST}").decode() if f"{PREFIX}/{MANIFEST}" in names else None


def rebased(store: DataFrame, path: str = "image_path") -> DataFrame:
    """A store whose picture paths are portable, with ``rebased``: whether a path changed."""
    new = paths.portable(F.col(path))
    changed = F.coalesce((F.trim(path) != "") & (new != F.replace(F.col(path), F.lit("\\"), F.lit("/"))), F.lit(False))
    return store.withColumn("rebased", changed).withColumn(path, F.when(F.col("rebased"), new).otherwise(F.col(path)))


def write_report(rows: DataFrame, path: str) -> str:
    """Write the one row of a report as a JSON file, and return its text."""
    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("json")).first()["json"]
    storage.write_text(rows.sparkSession, path, text)
    return text


def write_results(rows: DataFrame, path: str) -> None:
    """Evaluation results as a folder of JSON lines."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_ingested(rows: DataFrame, path: str) -> None:
    """Save an ingest manifest(key, kind, path, size, sha, chunks) beside the old one, then in its place."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}-new")
    storage.move(spark, f"{path.rstrip('/')}-new", path.rstrip("/"))


INGESTED = "key string, kind string, path string, size long, sha string, chunks long"


def load_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The saved manifest; an empty one if there is none or it cannot be read, after which everything is read again and put in by id."""
    try:
        own = spark.read.parquet(path)
        return own.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in INGESTED.split(", ")))
    except Exception:  # whatever is wrong with it, the files are still there
        return spark.createDataFrame([], INGESTED)


def fingerprints(files: DataFrame, kind: str) -> DataFrame:
    """Manifest rows of discovered files(path, name, size, sha256): the key is the kind and the path."""
    return files.select(F.concat(F.lit(f"{kind}:"), "path").alias("key"), F.lit(kind).alias("kind"), "path", "size", F.col("sha256").alias("sha"), F.lit(None).cast("long").alias("chunks"))


def planned(spark: SparkSession, path: str, current: DataFrame, incremental: bool = True) -> DataFrame:
    """What an ingest does with each file, by the manifest saved at ``path``."""
    old = load_ingested(spark, path)
    return records.ingest_plan(old, current, incremental and not old.isEmpty())
