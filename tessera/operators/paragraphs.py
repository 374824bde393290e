"""Drafts as paragraphs with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import dot
from tessera.operators.checks import PLACEHOLDER, tidy

# What stands between paragraphs, and for a placeholder that names nothing.
BETWEEN = r"\n\s*\n"
UNKNOWN = "[⚠]"
EDGES = r"^\s+|\s+$"


def split_paragraphs(drafts: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, place, raw): the paragraphs of each reply that hold more than white space, from 0."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(reply), F.lit("")), BETWEEN), lambda p: F.regexp_replace(p, EDGES, "")), lambda p: p != "")
    return drafts.select(key, F.posexplode(parts).alias("place", "raw"))


def nearest_paragraph(paragraphs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, id, place): the paragraph (key, place, vector) of greatest inner product, to six digits, for each item (key, id, vector), the first of equals."""
    met = items.select(key, "id", F.col("vector").alias("asked")).join(paragraphs.select(key, "place", "vector"), key)
    score = F.round(dot(F.col("asked"), F.col("vector")), 6)
    return met.groupBy(key, "id").agg(F.max_by("place", F.struct(score.alias("score"), (-F.col("place")).alias("first"))).alias("place"))


def paragraphs(drafts: DataFrame, labels: DataFrame, paragraph_vectors: DataFrame, item_vectors: DataFrame, key: str = "doc_id", reply: str = "reply", cited: str = "cited") -> DataFrame:
    """(key, paragraphs): array of struct(id, text, sources) for each draft that has any.

    Placeholders become the labels (id, label) of what they name, or UNKNOWN.  A
    source belongs to the paragraph that names it first; cited ids that no
    placeholder names follow, each once and in order, at the paragraph nearest in
    meaning (the vectors of either, the first without).  Ids without a label are no
    sources.  Paragraphs are numbered as they were, those left empty are dropped.
    """
    parts = split_paragraphs(drafts, key, reply)
    cut = parts.select(key, "place", F.split("raw", PLACEHOLDER, -1).alias("pieces"), F.regexp_extract_all("raw", F.lit(PLACEHOLDER), F.lit(1)).alias("ids"))
    marks = cut.select(key, "place", F.posexplode("ids").alias("k", "id")).join(labels.select("id", "label").dropDuplicates(["id"]), "id", "left")
    named = marks.groupBy(key, "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("label", F.lit(UNKNOWN)).alias("label")))), lambda x: x["label"]).alias("put"))
    whole = cut.join(named, [key, "place"], "left").withColumn("put", F.coalesce("put", F.array().cast("array<string>")))
    text = F.array_join(F.zip_with("pieces", "put", lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    texts = whole.select(key, "place", tidy(text).alias("text"))
    first = marks.where("label is not null").groupBy(key, "id").agg(F.min(F.struct("place", "k")).alias("at"))
    placed = first.select(key, "id", "at.place", F.lit(0).alias("late"), F.col("at.k").alias("k"))
    asked = drafts.select(key, F.posexplode(F.col(cited)).alias("k", "id")).groupBy(key, "id").agg(F.min("k").alias("k")).join(labels.select("id").distinct(), "id", "left_semi").join(first, [key, "id"], "left_anti")
    rest = asked.join(nearest_paragraph(paragraph_vectors, item_vectors, key), [key, "id"], "left").select(key, "id", F.coalesce("place", F.lit(0)).alias("place"), F.lit(1).alias("late"), "k")
    sources = placed.unionByName(rest).groupBy(key, "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("late", "k", "id"))), lambda x: x["id"]).alias("sources"))
    met = texts.where("text <> ''").join(sources, [key, "place"], "left")
    one = F.struct("place", F.concat(F.lit("p"), (F.col("place") + 1).cast("string")).alias("id"), "text", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    listed = met.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("p"))
    return listed.select(key, F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["sources"].alias("sources"))).alias("paragraphs"))
