"""Ordered rows in segments: by headings, by gaps, by blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def headed_segments(rows: DataFrame, key: str, place: str, heading: Column, text: str) -> DataFrame:
    """(key, segment, first, last, n, heading): each heading opens a segment, 0 being what comes before the first.

    `heading` of a segment is its first row's text.
    """
    order = W.partitionBy(key).orderBy(place)
    cut = rows.withColumn("segment", F.sum(F.coalesce(heading, F.lit(False)).cast("int")).over(order))
    return cut.groupBy(key, "segment").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"), F.min_by(text, place).alias("heading"))


def gap_segments(rows: DataFrame, key: str, time: str, tie: str, gap: str) -> DataFrame:
    """(key, segment, first, last, n): a row later than `gap` after the one before it opens a segment, from 1."""
    order = W.partitionBy(key).orderBy(time, tie)
    opens = F.coalesce(F.col(time) - F.lag(time).over(order) > F.expr(f"interval {gap}"), F.lit(True))
    cut = rows.withColumn("opens", opens.cast("int")).withColumn("segment", F.sum("opens").over(order))
    return cut.groupBy(key, "segment").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, body): what blank lines separate, from 1; a text without any is one paragraph, an empty one none."""
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n[ \t\r\n]*\n"), lambda p: F.regexp_replace(p, "^[ \t\r\n]+|[ \t\r\n]+$", ""))
    cut = docs.select(key, F.posexplode(F.filter(parts, lambda p: p != "")).alias("pos", "body"))
    return cut.select(key, (F.col("pos") + 1).alias("pos"), "body")
