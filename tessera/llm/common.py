"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is ever broadcast, in bytes, as measured before doing so.
BROADCAST_LIMIT = 64 * 1024 * 1024
#: In a salted join a part of one key's rows is about one in so many of all rows, and PART_ROWS at least.
PARTS = 1000
PART_ROWS = 200
#: Bytes of rows that go to a Python worker at once, while tables between steps are written.
BATCH_BYTES = 4 * 1024 * 1024
#: Bytes of rows that a task holds of a table between steps before it writes them out.
ROW_GROUP_BYTES = 32 * 1024 * 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share; in local mode, where none is set, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Long texts go to Python workers in batches of few bytes: buffers of both sides follow the largest batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage in a way that outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    with small_batches(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast df when its counted rows fit into limit; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def parts_of(key: Column, counts: DataFrame, least: int | None = None) -> Column | None:
    """Into how many parts the rows of a key are dealt, so that none has many more than one in PARTS of all rows that counts (n) tells, or `least`; None where all are whole."""
    held = max(least or PART_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // PARTS)
    hot: dict[int, list[int]] = {}
    for h, n in counts.where(F.col("n") > held).select(key, "n").collect():  # fewer than PARTS
        hot.setdefault(1 << (-(-n // held) - 1).bit_length(), []).append(h)
    parts = F.lit(1)
    for size, hashes in hot.items():
        parts = F.when(key.isin(hashes), size).otherwise(parts)
    return parts if hot else None


def salted_join(rows: DataFrame, groups: DataFrame, keys: str | list[str], spread: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined to groups, which has one row a key at most, though one key may hold any part of rows.

    Keys with over one in PARTS of the rows are fewer than PARTS, so their hashes
    may go into the plan.  Their rows are dealt to parts by a hash of `spread`, and
    their groups repeated once a part, which makes 4 * PARTS rows more at most; no
    other row is joined for that.
    counts (keys, n), a table written before, may tell how many rows the keys that
    matter have; then the part is of these rows.  how is inner or left.
    """
    keys = [keys] if isinstance(keys, str) else keys
    counts = materialise(rows.groupBy(*keys).agg(F.count("*").alias("n")), "counts") if counts is None else counts.select(*keys, "n")
    key = F.xxhash64(*[F.col(k).cast(rows.schema[k].dataType) for k in keys])
    parts = parts_of(key, counts)
    if parts is None:
        return rows.join(groups, keys, how)
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
    right = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
