"""Terms, aliases, scripts and headings of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import once, words
from tessera.sources import broadcast_if_small

# Letters that count for a script, the length of a heading, and how many terms a text is given.
ARABIC = "[ء-ي]"
LATIN = "[a-zà-ÿ]"
HEADING = 140
MOST_TERMS = 15


def script(text: Column) -> Column:
    """arabic where a text has three Arabic letters and more of them than Latin ones, else latin, or none without letters."""
    count = lambda letters: F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(letters))
    arabic, latin = count(ARABIC), count(LATIN)
    return F.when((arabic >= 3) & (arabic > latin), "arabic").when(latin > 0, "latin").otherwise("none")


def heading(text: Column) -> Column:
    """The first line that isn't blank, cut to HEADING characters with an ellipsis; empty for a null text."""
    line = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit(""))
    return F.when(F.length(line) > HEADING, F.concat(F.substring(line, 1, HEADING - 1), F.lit("…"))).otherwise(line)


def unique_aliases(names: DataFrame, key: str, name: str) -> DataFrame:
    """(alias, key): the last word of a name where only one name ends with it."""
    last = names.select(key, F.element_at(F.split(F.lower(F.trim(name)), " "), -1).alias("alias"))
    return last.groupBy("alias").agg(F.min(key).alias(key), F.count("*").alias("__n")).where("__n = 1").select("alias", key)


def terms_in(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, rank): the terms of two words that a text has, by their priority and then name, MOST_TERMS at most.

    An equality join on word pairs, told apart within each text before it.
    """
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.array_distinct(F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))
    split = texts.where(F.col(text).isNotNull()).select(key, once(words(F.col(text))).alias("w"))
    met = split.select(key, F.explode(pairs).alias("term")).join(broadcast_if_small(terms, 64), "term")
    rank = F.row_number().over(W.partitionBy(key).orderBy("priority", "term"))
    return met.withColumn("rank", rank).where(F.col("rank") <= MOST_TERMS).select(key, "term", "rank")
