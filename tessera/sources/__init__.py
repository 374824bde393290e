"""Reading tables, and tables between steps in the folder that executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is ever broadcast, in bytes, as measured before doing so.
BROADCAST_LIMIT = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where none is set, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def place_for(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors."""
    path = place_for(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast df where its counted rows fit into limit; else the join is left to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def content_key(df: DataFrame, *more: str) -> str:
    """A name for what df was read from and how: its files with sizes and times, and its plan's columns; a df of no files has a name of its own."""
    if not df.inputFiles():
        return uuid.uuid4().hex
    plan = re.sub(r"#\d+L?|plan_id=\d+", "", df._jdf.queryExecution().analyzed().toString())
    held = df.sparkSession.read.format("binaryFile").load(df.inputFiles()).select("path", "length", "modificationTime").orderBy("path").collect()  # as many as the driver lists to read df
    return hashlib.sha1(repr([plan, held, more]).encode()).hexdigest()
