"""Keyed tables in a shared folder: a cache by content, and a table that takes the latest row of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.sources import written

#: Keys are dealt to so many folders, of which a change rewrites only those it touches.
FOLDERS = 64


def _replace(rows: DataFrame, path: str, by: str) -> None:
    """Put rows in the place of the folders of `by` that they touch.  They are written aside first, since they may come from these folders."""
    written(rows, "staged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class ContentCache:
    """Values computed once for each text and model: a table (shard, key, value) by shard, key being the SHA-1 of both."""

    def __init__(self, spark: SparkSession, path: str, model: str, value_type: str):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.schema = f"key string, value {value_type}, shard string"

    def key(self, text):
        return F.sha1(F.concat(F.lit(self.model + "\n"), text))

    def stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if _exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema)

    def fill(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Compute what the rows (shard, text) lack: compute gets (key, text), each key once, and gives (key, value).  Returns how many keys that were.

        What any shard has counts for all; a run that is repeated finds what it left.
        """
        asked = rows.where("text is not null").select("shard", self.key(F.col("text")).alias("key"), "text")
        lacking = asked.groupBy("key").agg(F.min("shard").alias("shard"), F.first("text").alias("text")).join(self.stored().select("key"), "key", "left_anti")
        lacking = written(lacking, "lacking")
        n = lacking.count()
        if n:
            made = compute(lacking.select("key", "text")).select("key", "value").join(lacking.select("key", "shard"), "key")
            made.write.mode("append").partitionBy("shard").parquet(self.path)
        return n

    def values(self, rows: DataFrame) -> DataFrame:
        """rows (shard, text, ...) with their values; null where none was computed."""
        own = self.stored().groupBy("key").agg(F.first("value").alias("value"))
        return rows.withColumn("__key", self.key(F.col("text"))).join(own.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")

    def compact(self, rows: DataFrame) -> None:
        """Rewrite the shards of rows with exactly the keys that these rows use, each once; other shards stay."""
        used = rows.where("text is not null").select("shard", self.key(F.col("text")).alias("key")).distinct()
        own = self.stored().groupBy("key").agg(F.first("value").alias("value"))
        _replace(used.join(own, "key").select("key", "value", "shard"), self.path, "shard")


class LatestTable:
    """A table of one row for each key, the one that comes last by `order`; merging the same rows again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str]):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, keys, order

    def read(self) -> DataFrame:
        return self._stored().drop("folder")

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("folder", IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path) if _exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def merge(self, rows: DataFrame) -> None:
        """Take rows in; only the folders of their keys are read and rewritten."""
        names = [f.name for f in self.schema.fields]
        own = rows.select(*names).withColumn("folder", F.pmod(F.xxhash64(*self.keys), F.lit(FOLDERS)).cast("int"))
        own = written(self._latest(own), "merged")
        touched = [r["folder"] for r in own.select("folder").distinct().collect()]  # FOLDERS rows at most
        if touched:
            _replace(self._latest(own.unionByName(self._stored().where(F.col("folder").isin(touched)))), self.path, "folder")

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Aggregated before it is shuffled, so a hot key is no hot task; rows that tie in the order are told apart by what else they hold."""
        names = [f.name for f in self.schema.fields]
        last = F.struct(*[F.col(c) for c in self.order], F.to_json(F.struct(*names)).alias("__all"))
        return rows.groupBy(*self.keys, "folder").agg(F.max_by(F.struct(*names), last).alias("row")).select("row.*", "folder")
