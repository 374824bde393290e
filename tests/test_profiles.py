"""Profiles of languages against a plain reckoning, and on texts that they weren't learned from."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import profiles as pf


def plain_ranks(texts):
    counts = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            w = f"_{w[: pf.LONGEST_WORD]}_"
            counts.update(g for n in pf.ORDERS for i in range(len(w) - n + 1) if (g := w[i : i + n]) != "_")
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: pf.SIZE], 1)}


SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then the cat sleeps while they were reading this book about history",
    "id": "mengapa umat islam menyembah kabah dan bagaimana mereka belajar membaca kitab yang diturunkan kepada nabi mereka dengan bahasa arab",
    "ms": "mengapa umat islam menyembah kaabah dan bagaimanakah mereka belajar membaca kitab yang diturunkan kepada nabi mereka dalam bahasa arab",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann schläft die katze während sie dieses buch über geschichte lesen",
    "arz": "هو الكلام ده عامل ايه النهارده يا جماعة احنا عايزين نعرف الحكاية دي كلها علشان نفهم",
}


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(t, k, 1) for k, t in SAMPLES.items()] + [("nobody knows", None, 1), (None, "en", 1), ("123", "de", 1)]
    return pf.learn(spark.createDataFrame(rows, "text string, lang string, rank int"))


def test_profiles_and_probabilities(spark, learned):
    got: dict = {}
    for r in learned.collect():
        got.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    want = {k: plain_ranks([t]) for k, t in SAMPLES.items()}
    assert got == want
    texts = ["the dog sleeps", "mengapa kitab", "Über den Hund!", "quoted «the quick brown fox» schläft die katze", "", None, "123", "x"]
    found: dict = {}
    for r in pf.probabilities(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), learned).collect():
        found.setdefault(r["doc_id"], {})[r["lang"]] = r["prob"]
    assert set(found) == {0, 1, 2, 3, 7}
    for k, own in found.items():
        t = texts[k] if k != 3 else "schläft die katze quoted"
        ranks = plain_ranks([t])
        near = {lang: sum(pf.SIZE - min(abs(n - p[g]) if g in p else pf.SIZE, pf.SIZE) for g, n in ranks.items()) / (len(ranks) * pf.SIZE) for lang, p in want.items()}
        weight = {lang: math.exp(pf.SHARPNESS * (x - max(near.values()))) for lang, x in near.items()}
        assert own == pytest.approx({lang: w / sum(weight.values()) for lang, w in weight.items()}, abs=2e-6)


def test_groups_english_and_names_that_stand_for_others(spark, learned):
    texts = {0: "mengapa umat islam belajar kitab", 1: "الحكاية دي كلها عامل ايه", 2: "why is the fuchs springt schläft", 3: "", 4: "der hund", 5: "what [[Q:1:2]] did he do"}
    got = {r["doc_id"]: (r["lang"], r["prob"]) for r in pf.detect(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), learned).collect()}
    top = {r["lang"]: r["prob"] for r in pf.probabilities(spark.createDataFrame([(0, texts[0])], "doc_id int, text string"), learned).collect()}
    first = max(("id", "ms"), key=top.get)
    assert got[0] == (first, round(top["id"] + top["ms"] if top[first] < pf.LEAST_SURE else top[first], 3)) and got[0][1] > 0.9
    assert got[1][0] == "ar" and got[2][0] == "en" and got[3] == ("en", 0.0) and got[4][0] == "de" and got[5][0] == "en"
    assert pf.detect(spark.createDataFrame([], "doc_id int, text string"), learned).count() == 0


def test_accuracy_on_held_out_texts(spark):
    """Two thirds teach; long and short texts of the rest are told."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text rlike '\\\\p{L}'")
    learned = pf.learn(docs.where("doc_id % 3 <> 1"))
    held = docs.where("doc_id % 3 = 1").select("doc_id", "lang", F.substring("text", 1, 200).alias("text"))
    told = pf.detect(held, learned).select("doc_id", F.col("lang").alias("told"))
    right, n = held.join(told, "doc_id").agg(F.avg((F.col("lang") == F.col("told")).cast("double")), F.count("*")).first()
    assert n > 200 and right >= 0.97, right


def test_rows_of_one_key_are_one_text(spark, learned):
    """Also of none; and where keys differ no n-gram is shuffled."""
    rows = [(1, "der hund schläft"), (2, "the dog"), (2, "sleeps while they"), (None, "the fox"), (None, "and the cat"), (3, "12")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    got: dict = {}
    for r in pf.probabilities(texts, learned).collect():
        got.setdefault(r["doc_id"], []).append((r["place"], r["lang"], r["prob"]))
    one = spark.createDataFrame([(1, "der hund schläft"), (2, "the dog sleeps while they")], "doc_id int, text string")
    alone = pf.probabilities(one, learned)
    assert {k: v for k, v in got.items() if k} == {k: [tuple(r)[1:] for r in alone.where(F.col("doc_id") == k).collect()] for k in (1, 2)}
    assert got[None] == [(k, lang, 0.2) for k, lang in enumerate(sorted(SAMPLES), 1)]
    assert "Exchange" not in alone._jdf.queryExecution().sparkPlan().toString() and "Aggregate" not in alone._jdf.queryExecution().optimizedPlan().toString()
