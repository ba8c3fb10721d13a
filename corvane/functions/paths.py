"""Paths of pictures in an index that moves between machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Folder of the pictures inside an index.
FOLDER = "figures/"


def portable(path: Column) -> Column:
    """``figures/<name>`` of any stored path: what follows the folder's name, whatever its case, else the file's name; empty for none."""
    own = F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    at = F.locate(FOLDER, F.lower(own))
    return F.when(own == "", "").when(at > 0, own.substr(at, F.length(own))).otherwise(F.concat(F.lit(FOLDER), F.substring_index(own, "/", -1)))


def relative(path: Column, home: str) -> Column:
    """The path below ``home``, else as it is, with forward slashes."""
    own = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    base = home.replace("\\", "/").rstrip("/") + "/"
    return F.when(own.startswith(base), own.substr(F.lit(len(base) + 1), F.length(own))).otherwise(own)


def resolved(rows: DataFrame, files: DataFrame, home: str, path: str = "image_path") -> DataFrame:
    """``rows`` with ``resolved``: the first of the stored path, the path below ``home`` and the name in its folder of pictures that is in files(path); empty for none."""
    base, own = home.rstrip("/"), F.trim("_stored")
    name = F.substring_index(F.replace(own, F.lit("\\"), F.lit("/")), "/", -1)
    ways = F.array(own, F.concat(F.lit(f"{base}/"), own), F.concat(F.lit(f"{base}/{FOLDER}"), name))
    tried = rows.select(F.col(path).alias("_stored")).where(own != "").distinct().select("_stored", F.posexplode(ways).alias("_nth", "_way"))
    there = tried.join(files.select(F.col("path").alias("_way")).distinct(), "_way").groupBy("_stored").agg(F.min_by("_way", "_nth").alias("resolved"))
    return rows.join(there, F.col(path) == F.col("_stored"), "left").drop("_stored").withColumn("resolved", F.coalesce("resolved", F.lit("")))
