"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, without a
ring table: a linear congruential generator seeded with the key's hash jumps
from shard to shard, and the last jump below the number of shards counts.
When a shard is appended only the rows that jump into it move.

Rows are numbered inside their shard without a shuffle: each partition counts
for itself, the counts (partitions x shards of them) become offsets, and the
two are added.

Defined results: a null key is a key like any other; equal keys share a shard,
and equal rows get a slot each; a null text has no bytes and so size 1; an
empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach, 2014), all keys at once."""
    key = keys.astype(np.uint64)
    here = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    while len(todo):
        # Wraps round at 64 bits, as it should.
        k = key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead = ((here[todo] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        go = ahead < shards
        todo = todo[go]
        here[todo] = ahead[go]
    return here.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """A column with the shard of a key of any type."""

    @F.pandas_udf("int")
    def shard(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(), shards))

    return shard(F.xxhash64(key))


def _number(names: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            order = np.argsort(shard, kind="stable")
            values, start, n = np.unique(shard[order], return_index=True, return_counts=True)
            local = np.empty(len(shard), np.int64)
            for v, s, k in zip(values.tolist(), start.tolist(), n.tolist(), strict=True):
                local[order[s : s + k]] = np.arange(k) + seen.get(v, 0)
                seen[v] = seen.get(v, 0) + k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(local)], names=[*names, "_part", "_local"])

    return count


def number_in_shards(rows: DataFrame) -> DataFrame:
    """Add slot: 0, 1, 2 ... in each value of the column shard."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", _part int, _local long"
    counted = materialise(rows.mapInArrow(_number(rows.columns), schema), "shards")
    # Partitions x shards rows, however many documents there are.
    sizes = counted.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return counted.join(offsets, ["shard", "_part"]).withColumn("slot", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes + 1), text_crc32, shard, grown_shard (with one shard more) and slot."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    thin = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    both = thin.select("*", jump_shard(F.col("doc_id"), shards).alias("shard"), jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))
    return number_in_shards(both)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
