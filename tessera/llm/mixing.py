"""Mixing sources to token targets by entropy balancing.

Every document gets a rate, the expected number of its copies.  Of all rates
whose words meet the sources' targets those are taken that stray least from 1
(Kullback-Leibler).  They are exp(lambda * x) with x the document's size over
its source's mean size, held at the limit of copies, and lambda maximises a
concave dual: distributed Newton steps, kept in a bracket, solve it.  A step
is one aggregation over (source, size, number of documents), written once;
lambdas stay in a table, and only how many sources are not yet there reaches
the driver.  Steps that end without a solution are an error.

Rates become whole copies by carrying the rounding error on from document to
document, large ones first, within blocks of a source that have a bounded
number of rows, so that a source's words miss its target by some of its
smallest documents only.  Blocks go by a hash of id and text: the same input
gives the same copies.

Defined results: a null text has size 0 and any number of words taken is 0;
a null source is a source, the last one; sources without a word have target 0;
equal rows are documents each; targets stop at the limit of copies times the
source's size, where each document gets that many; an empty table gives an
empty table; columns besides doc_id, text and source are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise, shuffle_partitions

MAX_COPIES = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Newton steps end when each source's words are this near its target, relatively.
TOLERANCE = 1e-6
MAX_STEPS = 80
#: Rows in a block whose rounding errors are carried on, about.
BLOCK_ROWS = 4_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column, text as bytes, by its number of words."""
    for batch in batches:
        sizes = [len((raw or b"").split()) for raw in batch.columns[-1].to_pylist()]  # bytes.split() parts at just these six
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=["doc_id", "row_key", "source", "size"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row_key (xxhash64 of the text), source and size."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("binary").alias("raw"))
    return thin.mapInArrow(_count_words, "doc_id long, row_key long, source string, size long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with rank, their number from 0 in the order of their code points, null last; one count a partition reaches the driver."""
    spark, order = sources.sparkSession, F.col("source").asc_nulls_last()
    parted = sources.repartitionByRange(shuffle_partitions(spark), order).withColumn("part", F.spark_partition_id())
    parted = materialise(parted.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(order))), "sources")
    counts = dict(sorted((r["part"], r["n"]) for r in parted.groupBy("part").agg(F.count("*").alias("n")).collect()))
    before = dict(zip(counts, accumulate(counts.values(), initial=0), strict=False))
    ahead = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, ahead long")
    return parted.join(F.broadcast(ahead), "part").withColumn("rank", F.col("ahead") + F.col("rank") - 1).drop("part", "ahead")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = MAX_COPIES) -> DataFrame:
    """source, docs, source_size, target: all words dealt out by weight, at most limit times a source's size.

    What a source can't take goes to the others by weight: all sources below
    their limit take weight x level, and the level rises until no further source
    is above its limit.  A step is one aggregation over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = _numbered(per).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(limit))
    per = materialise(per.select("source", "docs", "source_size", "weight", "most"), "sources")
    level, full = 0.0, -1
    while True:
        above = F.col("most") <= F.col("weight") * level if full >= 0 else F.lit(False)
        got = per.agg(
            F.sum(above.cast("long")).alias("full"), F.sum(F.col("source_size").cast("double")).alias("every"),
            F.sum(F.when(above, F.col("most"))).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if (got["full"] or 0) == full or not got["weight"]:
            break
        full, level = got["full"] or 0, (got["every"] - (got["taken"] or 0.0)) / got["weight"]
    return per.select("source", "docs", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def _rate(size: str = "size") -> Column:
    return F.when(F.col("full"), F.lit(1.0) * F.col("limit")).otherwise(F.least(F.col("limit"), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col(size) / F.col("mean")))))


def balance(sizes: DataFrame, targets: DataFrame, limit: float = MAX_COPIES, tolerance: float = TOLERANCE) -> DataFrame:
    """targets with mean, limit, full and lam, each source's solution of the dual."""
    counts = materialise(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    state = targets.select(
        "source", "source_size", "target",
        F.greatest(F.lit(1e-9), F.col("source_size") / F.col("docs")).alias("mean"),
        F.lit(float(limit)).alias("limit"),
        (F.col("target") >= F.col("source_size") * limit * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"),
    )
    state = materialise(state, "balance")
    for _ in range(MAX_STEPS):
        rate = _rate()
        met = counts.join(state, counts["source"].eqNullSafe(state["source"])).drop(counts["source"])
        met = met.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"),
            # The derivative by lambda; documents at the limit don't move.
            F.sum(F.when(rate < F.col("limit"), F.col("n") * F.col("size") * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        met = met.select(F.col("source").alias("of"), "words", "slope")
        step = state.join(met, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        step = step.withColumn("near", F.col("full") | F.col("words").isNull() | (F.abs(F.col("words") - F.col("target")) <= tolerance * F.col("target")))
        step = step.withColumn("low", F.when(F.col("words") < F.col("target"), F.col("lam")).otherwise(F.col("low")))
        step = step.withColumn("high", F.when(F.col("words") > F.col("target"), F.col("lam")).otherwise(F.col("high")))
        # Newton on the logarithm of the words; where it leaves the bracket, the middle or twice as far.
        newton = F.col("lam") + F.log(F.col("target") / F.col("words")) * F.col("words") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        aside = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        step = step.withColumn("lam", F.when(F.col("near"), F.col("lam")).when(inside, newton).otherwise(aside)).withColumn("done", F.col("near"))
        state = materialise(step.drop("words", "slope", "near"), "balance")
        if state.where("not done").isEmpty():
            return state
    raise ArithmeticError(f"the targets were not met within {MAX_STEPS} steps")


def _round_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies whose words follow the rates' words as closely as they can."""
    pdf = pdf.sort_values(["size", "doc_id", "row_key"], ascending=[False, True, True], kind="stable", na_position="first")
    copies, ahead = np.empty(len(pdf), np.int64), 0.0
    for i, (size, rate, limit) in enumerate(zip(pdf["size"].tolist(), pdf["rate"].tolist(), pdf["limit"].tolist(), strict=True)):
        low = int(min(rate, limit))
        up = ahead + (low + 1 - rate) * size
        ahead += (low - rate) * size
        if abs(up) < abs(ahead) and low + 1 <= limit:
            low, ahead = low + 1, up
        copies[i] = low
    return pdf[["doc_id", "row_key", "source", "size"]].assign(copies=copies)


def mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = MAX_COPIES) -> DataFrame:
    """doc_id, row_key, source, size, source_size, target and copies, from word_counts()."""
    sizes = materialise(sizes, "words")
    targets = materialise(source_targets(sizes, weights, limit), "targets")
    solved = balance(sizes, targets, limit).select(F.col("source").alias("of"), "mean", "limit", "full", "lam")
    blocks = targets.select("source", F.ceil(F.col("docs") / BLOCK_ROWS).alias("blocks"))
    info = solved.join(blocks, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    rated = sizes.join(info, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", _rate())
    rated = rated.select("doc_id", "row_key", "source", "size", "rate", "limit", F.pmod(F.xxhash64("doc_id", "row_key"), F.col("blocks")).alias("block"))
    copies = rated.groupBy("source", "block").applyInPandas(_round_block, "doc_id long, row_key long, source string, size long, copies long")
    per = targets.select(F.col("source").alias("of"), "source_size", "target")
    return copies.join(per, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(word_counts(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
