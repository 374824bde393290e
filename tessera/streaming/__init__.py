"""Run-log statistics as streams: the batch aggregations over a growing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.evaluation import run_stats
from tessera.sources import place_for, table
from tessera.sources.keyed import LatestTable

#: How late events may be.
LATE = "7 days"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1000).parquet(sf_dir)


def _drain(result: DataFrame, label: str, *keys: str) -> DataFrame:
    """Run a stream until all that is there is read; each batch's changed rows go to a table in the shared folder, whose latest of a key count."""
    spark = result.sparkSession
    place = place_for(spark, label)

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites what it left.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/rows/{number}")

    query = result.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*result.schema.fields, StructField("batch", IntegerType(), False)])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{place}/rows")
    others = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row")).select(*keys, "row.*")


def stream_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state is one row per event type."""
    return _drain(run_stats(_events(spark, sf_dir)), "run_stats", "event_type")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by tumbling hour and type; hours LATE behind the latest event leave the state, and events of theirs are dropped."""
    timed = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)
    counted = timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return _drain(counted.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"), "hourly", "hour", "event_type")


def upsert(stream: DataFrame, latest: LatestTable, label: str = "upsert") -> DataFrame:
    """Merge a stream into a keyed table batch by batch until all that is there is read; a batch that is run again changes nothing."""
    place = place_for(latest.spark, label)
    query = stream.writeStream.foreachBatch(lambda batch, _: latest.merge(batch)).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest.read()


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user."""
    events = _events(spark, sf_dir)
    latest = LatestTable(spark, place_for(spark, "latest"), events.schema, ["user_id"], ["ts", "event_id"])
    return upsert(events, latest).select("user_id", "event_id", "event_type")
