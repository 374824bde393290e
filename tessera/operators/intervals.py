"""Closed integer intervals: lookup, containment, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup takes at most so many rows, so an interval can be spelt out and joined by equality.
MAX_SPAN = 40


def range_lookup(rows: DataFrame, refs: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """(key, lo, hi, text) of refs whose places all exist, each ref once; others are left out.

    Of rows of one key and place the first text counts.
    """
    fit = refs.where((F.col("lo") <= F.col("hi")) & (F.col("hi") - F.col("lo") < MAX_SPAN)).select(key, "lo", "hi").distinct()
    spelt = fit.select(key, "lo", "hi", F.explode(F.sequence("lo", "hi")).alias(place))
    met = spelt.join(rows.groupBy(key, place).agg(F.min(text).alias(text)), [key, place])
    whole = met.groupBy(key, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct(place, text))).alias("parts"))
    whole = whole.where(F.size("parts") == F.col("hi") - F.col("lo") + 1)
    return whole.select(key, "lo", "hi", F.array_join(F.transform("parts", lambda p: F.concat(F.lit("("), p[place].cast("string"), F.lit(") "), p[text])), " ").alias("text"))


def covered(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Rows of inner (key, lo, hi) that lie inside an interval of outer with the same key."""
    o = outer.select(F.col(key).alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return inner.join(o, (F.col(key) == F.col("_k")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")), "left_semi")


def overlaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi, n, share): with how many intervals of right each of left overlaps, and in how many places."""
    r = right.select(F.col(key).alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    met = left.join(r, (F.col(key) == F.col("_k")) & (F.col("lo") <= F.col("_hi")) & (F.col("_lo") <= F.col("hi")))
    places = F.least("hi", "_hi") - F.greatest("lo", "_lo") + 1
    return met.groupBy(key, "lo", "hi").agg(F.count("*").alias("n"), F.sum(places).cast("long").alias("places"))


def _levels(rows: DataFrame) -> Column:
    """The level of an interval: buckets of 2 ** level places are the least that two of them hold it."""
    return F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int")


def overlapping(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """(left_id, right_id): the intervals (id, key, lo, hi) of either side that have a place in common, of any length.

    Intervals are put into the one or two buckets of their level that hold them,
    and of the levels above it that the other side has.  Two that overlap meet in a
    bucket of the longer one's level, so pairs come from an equality join.
    """
    sides = [df.where((F.col("lo") <= F.col("hi")) & F.col(key).isNotNull()).withColumn("level", _levels(df)) for df in (left, right)]
    levels = [sorted(r["level"] for r in df.select("level").distinct().collect()) for df in sides]  # 64 at most
    every = sorted({*levels[0], *levels[1]})

    def placed(df: DataFrame, name: str) -> DataFrame:
        up = F.filter(F.array(*[F.lit(x) for x in every]).cast("array<int>"), lambda x: x >= F.col("level"))
        each = df.select(F.col("id").alias(name), key, F.col("lo").cast("long").alias(f"{name}_lo"), F.col("hi").cast("long").alias(f"{name}_hi"), F.col("level").alias(f"{name}_level"), F.explode(up).alias("at"))
        first, last = F.expr(f"shiftright({name}_lo, at)"), F.expr(f"shiftright({name}_hi, at)")
        return each.withColumn("bucket", F.explode(F.array_distinct(F.array(first, last))))

    met = placed(sides[0], "left_id").join(placed(sides[1], "right_id"), [key, "at", "bucket"])
    longer = F.greatest("left_id_level", "right_id_level")
    return met.where((F.col("at") == longer) & (F.col("left_id_lo") <= F.col("right_id_hi")) & (F.col("right_id_lo") <= F.col("left_id_hi"))).select("left_id", "right_id").distinct()


def matches(found: DataFrame, expected: DataFrame, nested: str = "QA:") -> DataFrame:
    """The pairs of found and expected ids (id, key, lo, hi) that agree: equal, one of a kind with parts beneath the other, or ranges of one key that overlap.

    Ids are paths with colons; only of those that begin with `nested` what lies
    beneath counts.  key, lo and hi are null for ids that are no range.
    """
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("id", ":"))), lambda i: F.array_join(F.slice(F.split("id", ":"), F.lit(1), i), ":")), lambda p: p != "")
    own = F.when(F.col("id").startswith(nested), above).otherwise(F.array("id"))
    beneath = found.select(F.col("id").alias("found"), F.explode(own).alias("expected")).where((F.col("expected") == F.col("found")) | F.col("expected").startswith(nested))
    beneath = beneath.join(expected.select(F.col("id").alias("expected")), "expected")
    over = overlapping(found, expected).select(F.col("left_id").alias("found"), F.col("right_id").alias("expected"))
    return beneath.select("found", "expected").unionByName(over).distinct()
