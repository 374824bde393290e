"""Files held against a manifest of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder whose names match; path is relative to it.

    A task holds one file's bytes at a time, 2 GB at most (Spark's own limit of a
    binary value).  Spark doesn't read empty files, so they aren't found.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    # Spark writes paths in full and with escapes; the last part that is the folder itself ends the prefix.
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    path = F.expr("url_decode(_metadata.file_path)")
    return files.select(F.substring_index(path, f"/{name}/", -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, bytes, sha256, expected, status) of files found and listed (path, sha256): ok, mismatch, missing or unlisted.

    A path listed twice with different digests is ok only if the file has the
    least of them; digests are compared without regard to case.
    """
    listed = manifest.groupBy("path").agg(F.min(F.lower("sha256")).alias("expected"))
    both = found.join(listed, "path", "full")
    status = F.when(F.col("expected").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "ok").otherwise("mismatch")
    return both.select("path", "bytes", "sha256", "expected", status.alias("status"))
