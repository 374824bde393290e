import random

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import copies, labels, quotes

RNG = random.Random(5)


def test_texts_are_taken_apart_once(spark):
    """A text's regular expressions stand once in a plan, and equal the plain normal form."""
    chars = " \t\n\x1c\x85  ⁢‪‐‏­abZÉßİẞ9.!ـأإىةیکًٰۭ«\"([،؟١漢ﬁ﻿"
    df = spark.createDataFrame([("".join(RNG.choices(chars, k=RNG.randrange(14))),) for _ in range(2000)] + [(None,)], "text string")
    t = F.col("text")
    plain = F.translate(text.strip_diacritics(F.regexp_replace(t, text.INVISIBLE, "")), text.LETTERS_FROM, text.LETTERS_TO)
    plain = F.lower(F.trim(F.regexp_replace(plain, text.SPACES, " ")))
    own = {"norm": (text.norm(t), plain), "words": (text.words(t), F.regexp_extract_all(plain, F.lit(text.WORD), F.lit(0))), "letters": (quotes.letters_only(t), F.trim(F.regexp_replace(plain, f"[^{quotes.LETTERS}]+", " ")))}
    assert {name: df.where(~a.eqNullSafe(b)).count() for name, (a, b) in own.items()} == dict.fromkeys(own, 0)
    docs = df.withColumn("doc_id", F.monotonically_increasing_id())
    planned = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert planned(quotes.quote_spans(docs)).count(quotes.QUOTES) == 1
    assert planned(copies.shingles(docs, "doc_id", "text")).count(text.WORD) == 1
    terms = spark.createDataFrame([("a b", 1)], "term string, priority long")
    assert planned(labels.terms_in(docs, terms)).count(text.WORD) == 1
