"""Copied runs of words between texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import once, words
from tessera.sources import broadcast_if_small, written

RUN = 8


def shingles(rows: DataFrame, key: str, text: str, size: int = RUN) -> DataFrame:
    """(key, pos, shingle): a 64-bit hash of each run of `size` words."""
    split = rows.select(key, once(words(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.xxhash64(F.slice("w", i + 1, size)))
    return split.where(F.size("w") >= size).select(key, F.posexplode(runs).alias("pos", "shingle"))


def _same(a: Column, b: Column, at: Column, origin: Column, length: Column) -> Column:
    return F.slice(a, at + 1, length) == F.slice(b, origin + 1, length)


def runs(docs: DataFrame, protected: DataFrame, key: str = "doc_id", other: str = "item_id", text: str = "text", size: int = RUN) -> DataFrame:
    """(key, other, pos, origin, length): the runs of `size` words or more that two texts share.

    Documents' shingles that no protected text has are left out before anything
    is shuffled.  Equal ones on a diagonal that follow each other make one run,
    whose words then are compared.
    """
    b = written(shingles(protected, other, text, size).withColumnRenamed("pos", "origin"), "shingles")
    known = broadcast_if_small(b.select("shingle").distinct(), 16)
    met = shingles(docs, key, text, size).join(known, "shingle", "left_semi").join(broadcast_if_small(b, 32), "shingle").select(key, other, "pos", "origin", (F.col("pos") - F.col("origin")).alias("diagonal"))
    order = W.partitionBy(key, other, "diagonal").orderBy("pos")
    island = met.withColumn("island", F.col("pos") - F.row_number().over(order))
    found = island.groupBy(key, other, "diagonal", "island").agg(F.min("pos").alias("pos"), F.min("origin").alias("origin"), (F.count("*") + size - 1).cast("int").alias("length"))
    found = written(found.select(key, other, "pos", "origin", "length"), "runs")
    own = docs.join(broadcast_if_small(found.select(key).distinct(), 16), key, "left_semi").select(key, once(words(F.coalesce(F.col(text), F.lit("")))).alias("a"))
    theirs = protected.select(other, once(words(F.coalesce(F.col(text), F.lit("")))).alias("b"))
    both = found.join(own, key).join(theirs, other)
    return both.where(_same(F.col("a"), F.col("b"), F.col("pos"), F.col("origin"), F.col("length"))).select(key, other, "pos", "origin", "length")


def shared_runs(docs: DataFrame, protected: DataFrame, key: str = "doc_id", other: str = "item_id", text: str = "text", size: int = RUN) -> DataFrame:
    """(key, other, longest, runs): the longest run of words two texts share, of `size` words at least, and how many there are."""
    return runs(docs, protected, key, other, text, size).groupBy(key, other).agg(F.max("length").cast("long").alias("longest"), F.count("*").alias("runs"))
