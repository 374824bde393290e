"""From raw documents to packed training windows.

Each stage takes all that the one before it kept.  A stage works on rows by
(doc_id, hash of the text), so it doesn't need ids to be unique: rows that agree
in both are one document that occurs several times.

Defined results: null and empty texts and those without letters are rejected by
the first stage, and so are texts of LONG_ENOUGH letters whose language can't be
told; without any label nothing else is.  Rows that agree in id and text are
reduced to one by the second and third (the one whose other columns come first
as JSON stays) and mixed as copies of one by the fourth; further columns, maps
too and whatever their names, go along up to the last stage; empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BATCH_BYTES, broadcast_if_small, documents, materialise
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.language_id import UNKNOWN, language_of, train
from tessera.llm.mixing import mix, word_counts
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import default_tokenizer, pack_documents

#: A text whose language is less sure than this is rejected, if it has so many letters that it could be told.
LEAST_SCORE = 0.5
LONG_ENOUGH = 20


def _bound_batches(spark: SparkSession) -> None:
    """The session's texts go to Python workers in small batches from now on: a stage's result is computed when it is written, by the caller."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, id, row_key): whole rows aside, so that no column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row_key"))


def _among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows (row, id, row_key) joined to keys (doc_id, row_key), broadcast where their counted size allows."""
    keys = broadcast_if_small(keys.select(F.col("doc_id").alias("of"), F.col("row_key").alias("of_key")), 32)
    return rows.join(keys, F.col("id").eqNullSafe(F.col("of")) & (F.col("row_key") == F.col("of_key")), how)


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row for each id and row_key, the first as JSON."""
    return rows.groupBy("id", "row_key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row", "id", "row_key")


def _without(rows: DataFrame, dropped: DataFrame, again: DataFrame) -> DataFrame:
    """rows but for those dropped, and of those that occur again one each."""
    left = _among(rows, dropped, "left_anti")
    if again.isEmpty():
        return left
    return _among(left, again, "left_anti").unionByName(_one_of_each(_among(left, again, "left_semi")))


def _keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs that decisions (doc_id, row_key, kept) keep, each once."""
    per = decisions.groupBy("doc_id", "row_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    per = materialise(per.where("not kept or n > 1"), "decisions")
    return _without(_keyed(docs), per.where("not kept"), per.where("kept and n > 1")).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told, and short ones that have letters."""
    _bound_batches(spark)
    model = train(docs)
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    if not model.languages:
        return docs.where(letters > 0)
    found = language_of(spark.sparkContext.broadcast(model), F.col("text"))
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), letters.alias("letters"), found.alias("found"))
    sure = (F.col("found.lang_pred") != UNKNOWN) & ((F.col("found.score") >= LEAST_SCORE) | (F.col("letters") < LONG_ENOUGH))
    return told.where(sure).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return _keep(docs, exact_duplicates(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return _keep(docs, near_duplicates(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    _bound_batches(spark)
    copies = materialise(mix(word_counts(docs)).groupBy("doc_id", "row_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")), "copies")
    rows = _without(_keyed(docs), copies.where("false"), copies.where("n > 1"))
    taken = copies.where("copies > 0").select(F.col("doc_id").alias("of"), F.col("row_key").alias("of_key"), "copies")
    met = rows.join(taken, F.col("id").eqNullSafe(F.col("of")) & (F.col("row_key") == F.col("of_key")))
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in windows."""
    _bound_batches(spark)
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the alignment, the Newton steps or the tokeniser; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
