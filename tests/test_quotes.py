import random

from pyspark.sql import functions as F

from tessera.operators import checks, quotes, segments

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(3, 9))) for _ in range(300)]
BOOKS = {(b, n): " ".join(RNG.choices(VOCABULARY, k=RNG.randrange(5, 9))) for b in range(4) for n in range(12)}


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[-1], row[j + 1]))
    return out


def test_similarity_against_plain_alignment():
    for _ in range(60):
        a = "".join(RNG.choices("ab c", k=RNG.randrange(1, 14))).strip() or "a"
        b = "".join(RNG.choices("ab c", k=RNG.randrange(0, len(a) + 1))).strip()
        assert quotes.similarity(a, b) == (1.0 if a in b else 2 * _common(a, b) / (len(a) + len(b)))
    assert quotes.similarity("one two", "zero one two three") == 1.0
    assert quotes.similarity("one tvo", "zero one two three") == 12 / 14


def _match(spark, rows):
    store = spark.createDataFrame([(b, n, t) for (b, n), t in BOOKS.items()], "book int, n long, body string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["book"], r["start"], r["length"]): r for r in quotes.match_quotes(quotes.quote_spans(docs), store).collect()}


def test_quotations_against_every_run(spark):
    """Each quotation, whole, edited or over several passages, meets the best of all runs of all books."""
    asked = []
    for _ in range(25):
        b, n, k = RNG.randrange(4), RNG.randrange(9), RNG.randrange(1, 4)
        words = " ".join(BOOKS[b, n + i] for i in range(k)).split()
        if RNG.random() < 0.6:
            words[RNG.randrange(len(words))] = "zzzz"
        asked.append(" ".join(words))
    got = _match(spark, [(i, f'he said "{q}" there') for i, q in enumerate(asked)])
    every = [(b, s, k, " ".join(BOOKS[b, s + i] for i in range(k))) for b in range(4) for s in range(12) for k in range(1, 9) if s + k <= 12]
    want = {}
    for i, q in enumerate(asked):
        score, k, b, s = min((-round(quotes.similarity(q, t), 9), k, b, s) for b, s, k, t in every)
        if -score >= quotes.LEAST_SIMILARITY:
            want[i, b, s, k] = round(-score, 3)
    assert {key: r["similarity"] for key, r in got.items()} == want
    assert len(want) >= 20 and any(r["is_exact"] for r in got.values()) and not all(r["is_exact"] for r in got.values())


def test_quotations_of_odd_texts(spark):
    text = BOOKS[2, 5]
    rows = [(1, None), (2, ""), (3, f"«{text}» [2: 5] and again “{text}”"), (4, "nothing of the kind is here, not a word of it"), (5, "short"), (6, f"{text}. {BOOKS[1, 1]}!"), (6, text)]
    got = _match(spark, rows)
    assert set(got) == {(3, 2, 5, 1), (6, 2, 5, 1), (6, 1, 1, 1)} and all(r["is_exact"] and r["similarity"] == 1.0 for r in got.values())
    assert _match(spark, []) == {}


def test_spans(spark):
    rows = [(1, "﴿first one in brackets﴾ then «second in quotes» (tiny)"), (2, "One whole sentence here. Tiny. Another [1: 2] one, longer than that")]
    got = [tuple(r) for r in quotes.quote_spans(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "first one in brackets"), (1, 1, "second in quotes"), (2, 0, "One whole sentence here"), (2, 3, "longer than that")]


def test_phrases_and_choices(spark):
    rows = [("For Sure it is", "de-AT"), ("no", "xx"), (None, None), ("for sure, in short", "EN_us")]
    docs = spark.createDataFrame(rows, "t string, lang string")
    got = docs.select(checks.phrases_in(F.col("t"), ["for sure", "in short"]).alias("i"), checks.pick({"en": "e", "de": "d"}, F.col("lang")).alias("p")).collect()
    assert [r["i"] for r in got] == [["for sure"], [], [], ["for sure", "in short"]]
    assert [tuple(r["p"]) for r in got] == [("d", True), ("e", False), ("e", False), ("e", True)]


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, " a\nb \n \n\n c "), (2, "one"), (3, " \n\n "), (4, None)], "doc_id long, text string")
    assert [tuple(r) for r in segments.paragraphs(docs).orderBy("doc_id", "pos").collect()] == [(1, 1, "a\nb"), (1, 2, "c"), (2, 1, "one")]
