"""Evaluation figures and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources import broadcast_if_small, written


def discrete_quantile(rows: DataFrame, group: str, value: str, rule: str, parts: int = 1000) -> DataFrame:
    """The element at a place of the sorted values: `rule` is SQL for that place, from 1, given n.

    Values are counted in `parts` ranges of equal width first; only those of the
    range that holds the place are ordered.  So what one task orders is a group's
    ranges, and then the different values of one range.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    bounds = rows.groupBy(F.col("g").alias("of")).agg(F.min("v").alias("least"), F.max("v").alias("most"))
    bounds = broadcast_if_small(written(bounds, "bounds"), 64)
    width = F.when(F.col("most") > F.col("least"), (F.col("most") - F.col("least")) / parts).otherwise(1.0)
    parted = rows.join(bounds, F.col("g").eqNullSafe(F.col("of"))).select("g", "v", F.least(F.lit(parts - 1), F.floor((F.col("v") - F.col("least")) / width)).alias("part"))
    counts = parted.groupBy("g", "part").agg(F.count("*").alias("k"))
    order, every = W.partitionBy("g").orderBy("part"), W.partitionBy("g")
    placed = counts.withColumn("upto", F.sum("k").over(order)).withColumn("n", F.sum("k").over(every)).withColumn("place", F.expr(rule))
    held = placed.where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("k") < F.col("place")))
    held = broadcast_if_small(written(held.select(F.col("g").alias("of"), F.col("part").alias("of_part"), "n", (F.col("place") - F.col("upto") + F.col("k")).alias("place")), "held"), 64)
    inside = parted.join(held, F.col("g").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).groupBy("g", "v", "n", "place").agg(F.count("*").alias("k"))
    upto = inside.withColumn("upto", F.sum("k").over(W.partitionBy("g").orderBy("v"))).where("upto >= place")
    return upto.groupBy(F.col("g").alias(group)).agg(F.min("v").alias("value"), F.max("n").alias("n"))


def p90(rows: DataFrame, group: str, value: str) -> DataFrame:
    return discrete_quantile(rows, group, value, "greatest(1, bround(0.9D * n))")


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    return discrete_quantile(rows, group, value, "floor(n / 2) + 1")


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """For thresholds 0.10 to 0.95: share of answerable rows (truth) below it, of others below it, and both balanced.

    Scores are counted by the number of thresholds they reach first.
    """
    step = F.explode(F.sequence(F.lit(10), F.lit(95), F.lit(5)))
    counted = scored.groupBy(F.floor(F.col("score") * 100).alias("pct"), "truth").agg(F.count("*").alias("n"))
    met = counted.withColumn("t", step)
    out = met.groupBy("t").agg(
        (F.sum(F.when(F.col("truth") & (F.col("pct") < F.col("t")), F.col("n")).otherwise(0)) / F.sum(F.when(F.col("truth"), F.col("n")))).alias("a"),
        (F.sum(F.when(~F.col("truth") & (F.col("pct") < F.col("t")), F.col("n")).otherwise(0)) / F.sum(F.when(~F.col("truth"), F.col("n")))).alias("u"),
    )
    rounded = out.select("t", F.round("a", 6).alias("answerable_abstained"), F.round("u", 6).alias("unanswerable_abstained"))
    return rounded.withColumn("balanced", F.round((1 - F.col("answerable_abstained") + F.col("unanswerable_abstained")) / 2, 6))


def recall_mrr(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: share of queries with a relevant document (query, doc) among the first k, and the mean reciprocal rank."""
    first = ranked.join(relevant, ["query", "doc"]).where(F.col("rank") <= k).groupBy("query").agg(F.min("rank").alias("first"))
    every = queries.select("query").join(first, "query", "left")
    return every.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("recall"), F.round(F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"))


def applicable_rate(rows: DataFrame, group: str, *checks: str) -> DataFrame:
    """Rates over the rows where a check applies, and how many these are: null is not false."""
    out = [x for c in checks for x in (F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate"), F.count(c).alias(f"{c}_n"))]
    return rows.groupBy(group).agg(*out)


def run_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.round(F.sum(F.col("value").cast("decimal(38,6)")).cast("double"), 2).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of a key the last by `order`, as an upsert leaves it."""
    others = [c for c in rows.columns if c != key and c not in order]
    top = rows.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("r"))
    return top.select(key, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c != key])


def check_results(rows: DataFrame, checks: str = "checks") -> DataFrame:
    """rows with `passed`: whether all checks that a map<string,boolean> has are true; a check that doesn't apply is not in it."""
    return rows.withColumn("passed", F.forall(F.map_values(F.map_filter(checks, lambda k, v: v.isNotNull())), lambda v: v))


def roll_up(rows: DataFrame, group: str, checks: str, latency: str) -> DataFrame:
    """(group, cases, passed, mean_latency, p90_latency) and, for each check, its rate and number of rows that it applies to, as a sorted string."""
    met = check_results(rows, checks)
    base = met.groupBy(group).agg(F.count("*").alias("cases"), F.sum(F.col("passed").cast("long")).alias("passed"), F.round(F.avg(latency), 6).alias("mean_latency"))
    each = met.select(group, F.explode(checks).alias("name", "ok")).where("ok is not null").groupBy(group, "name").agg(F.avg(F.col("ok").cast("double")).alias("rate"), F.count("*").alias("n"))
    entry = F.format_string("%s=%.3f/%d", F.col("name"), F.col("rate"), F.col("n"))
    listed = each.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("rates"))
    slow = p90(rows, group, latency).select(group, F.col("value").alias("p90_latency"))
    return base.join(listed, group, "left").join(slow, group, "left")
