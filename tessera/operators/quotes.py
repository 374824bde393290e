"""Quotations in messages, matched to the closest run of consecutive passages of a store."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as texts
from tessera.functions.text import once, strip_diacritics
from tessera.operators.chat import FUNCTION_WORDS
from tessera.sources import broadcast_if_small, written

# The marks of quotations, references and sentences, and the limits of a match.
BRACKETS = "﴿([^﴾]+)﴾"
QUOTES = r"""«[^»]+»|"[^"]+"|“[^”]+”|\([^)]{12,}\)"""
REFERENCE = r"\[[^\]]{1,40}\]"
SENTENCE_END = "[.!?؟،,\n:؛]+"
LETTERS = "a-zà-ÿء-ي"
LEAST_LETTERS = 12
MOST_PASSAGES = 8
MOST_CANDIDATES = 8
LEAST_SIMILARITY = 0.80
EXACT = 0.995
TOO_LONG = 1.3

#: A passage is looked at if it has so much of the shorter side's word pairs in common with a quotation.
LEAST_SHARED = 0.2
_RUN = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType())])
_STOP = sorted({w for stop in FUNCTION_WORDS.values() for w in stop})


def letters_only(text: Column) -> Column:
    """The normal form with all but letters made single spaces."""
    return texts.letters_only(text, LETTERS)


def sentences(text: Column) -> Column:
    """The letters of each sentence that has any, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), letters_only), lambda s: s != "")


def quote_spans(messages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, span): bracketed quotations, then those in other marks; a text without any gives its sentences.

    References in square brackets are no part of a quotation, and one of fewer
    than LEAST_LETTERS letters is left out.  A null text has none.
    """
    has = lambda c, mark, put: F.when(F.contains(c, F.lit(mark)), put).otherwise(c)
    without = lambda c: has(c, "[", F.regexp_replace(c, REFERENCE, " "))
    cut = messages.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).select(key, "t", once(has(F.col("t"), "﴿", F.regexp_replace("t", BRACKETS, " "))).alias("rest"))
    cut = cut.select(key, "t", once(without(F.col("rest"))).alias("rest"))
    none = F.array().cast("array<string>")
    bracketed = F.when(F.contains("t", F.lit("﴿")), F.regexp_extract_all("t", F.lit(BRACKETS), F.lit(1))).otherwise(none)
    cut = cut.select(key, "rest", once(F.concat(bracketed, F.transform(F.regexp_extract_all("rest", F.lit(QUOTES), F.lit(0)), lambda q: F.substr(q, F.lit(2), F.length(q) - 2)))).alias("quoted"))
    cut = cut.select(key, once(F.when(F.size("quoted") > 0, F.col("quoted")).otherwise(F.split("rest", SENTENCE_END))).alias("spans"))
    cut = cut.select(key, F.posexplode(F.transform("spans", lambda s: F.trim(without(s)))).alias("pos", "span"))
    count = F.length(F.array_join(F.regexp_extract_all(F.lower(strip_diacritics(F.col("span"))), F.lit(f"[{LETTERS}]+"), F.lit(0)), ""))
    # Shorter ones need no look at their letters.
    return cut.where((F.length("span") >= LEAST_LETTERS) & (count >= LEAST_LETTERS))


def _pairs(words: Column) -> Column:
    """Hashes of neighbouring words, but not of two function words; long words stand for themselves too."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.when(~(a.isin(_STOP) & b.isin(_STOP)), F.xxhash64(a, b)))
    long = F.transform(F.filter(words, lambda w: F.length(w) >= LEAST_LETTERS), lambda w: F.xxhash64(w))
    return F.array_distinct(F.concat(F.array_compact(pairs), long))


def candidates(quotes: DataFrame, store: DataFrame) -> DataFrame:
    """(quote, book, n): the MOST_CANDIDATES passages with most word pairs of a quotation."""
    cut = lambda df, text: df.select("*", once(F.split(text, " ")).alias("words")).select("*", once(_pairs(F.col("words"))).alias("pairs")).drop("words")
    asked = cut(quotes, "quote").select("quote", F.size("pairs").alias("quote_pairs"), F.explode("pairs").alias("pair"))
    index = cut(store, "body").select("book", "n", F.size("pairs").alias("body_pairs"), F.explode("pairs").alias("pair"))
    shared = asked.join(broadcast_if_small(index, 32), "pair").groupBy("quote", "book", "n").agg(F.count("*").alias("shared"), F.min(F.least("quote_pairs", "body_pairs")).alias("least"))
    order = W.partitionBy("quote").orderBy(F.col("shared").desc(), "book", "n")
    near = shared.where(F.col("shared") >= LEAST_SHARED * F.col("least")).withColumn("rank", F.row_number().over(order))
    return near.where(F.col("rank") <= MOST_CANDIDATES).select("quote", "book", "n")


def _places(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(text):
        found[c] = found.get(c, 0) | 1 << i
    return found


def _common(places: dict[str, int], size: int, text: str) -> int:
    """The length of the longest common subsequence, counted in the bits of one integer (Hyyrö, 2004)."""
    full = (1 << size) - 1
    left, at = full, places.get
    for c in text:
        met = left & at(c, 0)
        if met:
            left = ((left + met) | (left - met)) & full
    return size - left.bit_count()


def similarity(quote: str, text: str, places: dict[str, int] | None = None, least: float = 0.0) -> float:
    """Twice the longest common subsequence over both lengths, for the part of text that is as long as quote and most like it.

    Parts begin with a word, or end with the text.  A part has no longer a
    subsequence in common than the whole text, so where even that makes less
    than `least` the parts are not tried, and 0 is returned.
    """
    if quote in text:
        return 1.0
    places = _places(quote) if places is None else places
    size = len(quote)
    whole = _common(places, size, text)
    if len(text) <= size:
        return 2 * whole / (size + len(text))
    if 2 * whole / (size + whole) < least:
        return 0.0
    starts = {0, len(text) - size} | {i + 1 for i, c in enumerate(text[:-size]) if c == " "}
    parts = {text[start : start + size].strip() for start in starts}
    return max(2 * _common(places, size, part) / (size + len(part)) for part in parts)


def best_run(quote: str, n: int, body: dict[int, str]) -> tuple[float, int, int]:
    """(similarity, start, length) of the run of passages around n that is most like quote; of equals the shortest, then first.

    A run has one passage more at most than fit into TOO_LONG times the quote from n on.
    """
    ahead = [body[i] for i in range(n, n + MOST_PASSAGES) if all(j in body for j in range(n, i + 1))]
    longest = min(MOST_PASSAGES, 1 + sum(x - 1 <= TOO_LONG * len(quote) for x in accumulate(len(b) + 1 for b in ahead)))
    # At the end of a book a run can only grow towards its beginning.
    runs = [(length, start) for length in range(1, longest + 1) for start in range(n - length + 1, n + 1) if all(i in body for i in range(start, start + length))]
    places = _places(quote)
    score, length, start = max((round(similarity(quote, " ".join(body[i] for i in range(s, s + k)), places, LEAST_SIMILARITY), 9), -k, -s) for k, s in runs)
    return score, -start, -length


@F.pandas_udf(_RUN)
def _closest(quote: pd.Series, n: pd.Series, at: pd.Series, bodies: pd.Series) -> pd.DataFrame:
    found = [best_run(q, k, dict(zip(a.tolist(), b.tolist(), strict=True))) for q, k, a, b in zip(quote, n, at, bodies, strict=True)]
    return pd.DataFrame(found, columns=["score", "start", "length"])


def match_quotes(spans: DataFrame, store: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, book, start, length, pos, similarity, is_exact): the run of passages each span quotes, the first span of each run.

    store has (book, n, body), n counting a book's passages without gaps and
    body in letters only.  Equal quotations are matched once, however many
    texts hold them; each meets only passages that share word pairs with it,
    and their neighbours by equality of book and place.
    """
    asked = written(spans.select(key, "pos", once(letters_only(F.col("span"))).alias("quote")).where(F.length("quote") >= LEAST_LETTERS), "asked")
    near = candidates(asked.select("quote").distinct(), store)
    reach = MOST_PASSAGES - 1
    around = near.withColumn("at", F.explode(F.sequence(F.col("n") - reach, F.col("n") + reach))).join(store.select("book", F.col("n").alias("at"), "body"), ["book", "at"])
    # These rows are few bytes but much work, so their partitions must not be joined into a few large ones.
    around = around.repartition(int(store.sparkSession.conf.get("spark.sql.shuffle.partitions")), "quote")
    runs = around.groupBy("quote", "book", "n").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("a"))
    scored = runs.select("quote", "book", _closest("quote", "n", F.col("a.at"), F.col("a.body")).alias("m"))
    best = scored.where(F.col("m.score") >= LEAST_SIMILARITY).groupBy("quote").agg(F.min(F.struct((-F.col("m.score")).alias("worse"), F.col("m.length").alias("length"), "book", F.col("m.start").alias("start"))).alias("b"))
    met = asked.join(best, "quote").groupBy(key, "b.book", "b.start", "b.length").agg(F.min(F.struct("pos", (-F.col("b.worse")).alias("score"))).alias("f"))
    return met.select(key, "book", "start", "length", "f.pos", F.round("f.score", 3).alias("similarity"), (F.col("f.score") >= EXACT).alias("is_exact"))
