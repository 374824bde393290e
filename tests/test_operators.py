import random
import re
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.text import has_arabic, html_text, norm, normalise, stem, strip_diacritics, terms, without_quotes, words
from tessera.operators import chat, checks, chunks, copies, evaluation, intervals, labels, records, search, store


def _one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_text(spark):
    assert _one(spark, "  Café  \n au LAIT ", norm) == "café au lait"
    assert _one(spark, "أَحْمَد", norm) == "احمد"
    assert _one(spark, "كـتاب", strip_diacritics) == "كتاب"
    assert _one(spark, "والكتاب", stem) == "كتاب"
    assert _one(spark, "The 2 cafés, a-b أَحْمَد", words) == ["the", "2", "cafés", "a", "b", "احمد"]
    # Stop words go before prefixes do; one letter is no term.
    assert _one(spark, "The Books of والكتاب في المدرسة x 7 للناس", terms) == ["books", "كتاب", "مدرسه", "ناس"]
    assert _one(spark, "a\u200fb\u2066c\u00adt کتاب ے ٱلله", norm) == "abct كتاب ي الله"
    assert _one(spark, "مرحبا", has_arabic) and not _one(spark, "hello", has_arabic)
    assert _one(spark, "see «نص طويل» [x: 1]", without_quotes) == "see" and _one(spark, "«نص»", without_quotes) == "«نص»"
    forms = spark.createDataFrame([(1, "ﻛﺘﺎب ①"), (2, "Plain Text"), (3, None), (4, "ﬁne\u00a0x")], "i int, t string")
    assert {r["i"]: r["t"] for r in normalise(forms, "t").collect()} == {1: "كتاب 1", 2: "plain text", 3: None, 4: "fine x"}
    pages = spark.createDataFrame([(1, "<p>a &amp;lt; b&nbsp;&middot; c</p>"), (2, "&eacute;&#x41;<br>&amp;"), (3, None)], "i int, h string")
    assert {r["i"]: r["t"] for r in html_text(pages, "h", "t").collect()} == {1: "a &lt; b · c", 2: "éA &", 3: None}


def test_rrf_prefers_the_document_of_most_lists(spark):
    lists = [(1, "x", 1, 1), (1, "x", 2, 2), (1, "x", 3, 3), (1, "y", 2, 1), (1, "y", 1, 2), (1, "z", 2, 1)]
    got = search.best(search.rrf(spark.createDataFrame(lists, "query int, channel string, doc int, rank int")), 9).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [2, 1, 3]


def test_diversity_keeps_two_a_parent(spark):
    rows = [(1, d, 1.0 / d, "p" if d < 5 else "q") for d in range(1, 8)]
    got = search.diversify(spark.createDataFrame(rows, "query int, doc int, score double, parent string"), "parent").collect()
    assert sorted(r["doc"] for r in got) == [1, 2, 5, 6]


def test_range_lookup_is_all_or_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "d")], "k int, n int, t string")
    refs = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (1, 2, 4), (1, 2, 1), (1, 1, 99), (2, 1, 1)], "k int, lo int, hi int")
    assert [tuple(r) for r in intervals.range_lookup(rows, refs, "k", "n", "t").collect()] == [(1, 1, 2, "(1) a (2) b")]


def test_intervals_against_brute_force(spark):
    rng = random.Random(1)
    span = lambda: (rng.randrange(3), a := rng.randrange(20), a + rng.randrange(6))
    x, y = sorted({span() for _ in range(60)}), sorted({span() for _ in range(40)})
    left, right = (spark.createDataFrame(z, "k int, lo int, hi int") for z in (x, y))
    assert sorted(map(tuple, intervals.covered(left, right, "k").collect())) == [a for a in x if any(a[0] == b[0] and b[1] <= a[1] and a[2] <= b[2] for b in y)]
    want = {a: sum(a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2] for b in y) for a in x}
    assert {(r["k"], r["lo"], r["hi"]): r["n"] for r in intervals.overlaps(left, right, "k").collect()} == {a: n for a, n in want.items() if n}


def test_reply_language_falls_back(spark):
    en, de, fr = "the cat and the dog of the house", "der Hund und die Katze ist nicht das", "le chat et la maison est dans la rue"
    rows = [(1, 0, "user", de), (2, 0, "user", en), (2, 1, "user", "???"), (3, 0, "user", "123"), (4, 0, "user", de), (4, 1, "assistant", en), (4, 2, "user", de), (4, 3, "user", en), (4, 9, "user", "hm"), (5, 0, "assistant", "x")]
    told = chat.message_languages(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    known = spark.createDataFrame([(3, "FR_ca", "de"), (5, None, "es-MX")], "conv_id int, conversation string, profile string")
    assert {r["conv_id"]: (r["turn"], r["lang"], r["source"]) for r in chat.reply_language(told, known).collect()} == {
        1: (0, "de", "target_message"), 2: (1, "en", "recent_messages"), 3: (0, "fr", "conversation"), 4: (9, "de", "recent_messages"), 5: (0, "es", "profile"),
    }
    assert {r["conv_id"]: r["source"] for r in chat.reply_language(told).collect()}[3] == "default"
    more = rows + [(6, 0, "user", fr), (6, 1, "user", "?"), (6, 2, "user", en), (6, 3, "user", "!"), (6, 8, "user", "...")]
    told = chat.message_languages(spark.createDataFrame(more, "conv_id int, turn int, role string, text string"))
    targets = spark.createDataFrame([(6, 1), (6, 8), (4, 1), (4, 77), (4, 0)], "conv_id int, turn int")
    # Of equally near messages the earlier counts; another's message, or none, can't be answered.
    assert {(r["conv_id"], r["turn"]): (r["lang"], r["source"]) for r in chat.reply_language(told, None, targets).collect()} == {
        (6, 1): ("fr", "nearby_message"), (6, 8): ("en", "nearby_message"), (4, 1): (None, "invalid_target"), (4, 77): (None, "invalid_target"), (4, 0): ("de", "target_message"),
    }


def test_chunks(spark):
    text = "\n".join(["x" * 500] * 5 + ["y" * 10])
    long = ". ".join("w" * 400 for _ in range(9))
    rows = [(1, text), (2, None), (3, "z" * 3000), (4, "  0" + "a" * 90 + " \n10" + "b" * 90 + "1"), (5, long)]
    got = chunks.chunk_pages(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id", "chunk").collect()
    assert [(r["doc_id"], r["chunk"], r["n_parts"], r["chars"]) for r in got] == [(1, 1, 3, 1502), (1, 2, 3, 1012), (3, 1, 1, 3000), (4, 1, 2, 185), (5, 1, 1, 1607), (5, 2, 1, 1607), (5, 3, 1, 400)]
    lines = "\n".join(["a" * 700 + "."] * 4 + ["b" * 90])
    got = chunks.chunk_sentences(spark.createDataFrame([(1, lines), (2, "c" * 100), (3, "d\n" * 1300)], "doc_id int, text string")).orderBy("doc_id", "chunk").collect()
    assert [(r["doc_id"], r["chunk"], r["chars"]) for r in got][:3] == [(1, 1, 1403), (1, 2, 1494), (2, 1, 100)] and all(r["chars"] <= 2240 + 420 for r in got)
    pages = spark.createDataFrame([([("٢", 5), ("٢", 7)],), ([("المقدمة", 3)],), ([(None, None)],), ([(None, 9), ("x", 9)],)], "p array<struct<part:string,page:int>>")
    assert [r[0] for r in pages.select(chunks.page_label(F.col("p"))).collect()] == ["ج ٢ ص 5-7", "المقدمة، ص 3", "", "ص 9"]


def test_references(spark):
    cases = {"Q:2:255": (2, 255, 255), " Q:112:1-4": (112, 1, 4), "Q:0:1": None, "Q:115:1": None, "Q:2:5-3": None, "H:x": None, "Q:2": None, "2:255": None}
    got = spark.createDataFrame([(r,) for r in cases], "r string").select("r", store.parse_ref(F.col("r")).alias("p")).collect()
    assert {r["r"]: None if r["p"] is None else tuple(r["p"]) for r in got} == cases
    rows = spark.createDataFrame([(2, 1, "a"), (2, 2, "b"), (2, 2, "b"), (2, 3, "c")], "key int, place int, text string")
    said = spark.createDataFrame([(2, 1, "en", "A"), (2, 2, "en", "B"), (2, 1, "fr", "Af")], "key int, place int, lang string, text string")
    asked = spark.createDataFrame([("Q:2:1-2", "de"), ("Q:2:1-2", "de"), ("Q:2:1-2", "fr-FR"), ("Q:2:2-3", "en"), ("Q:2:3-4", "en"), ("Q:2:1", "ar"), ("Q:2:1", "fr")], "ref string, lang string")
    got = {(r["ref"], r["lang"]): (r["text"], r["translation"]) for r in store.lookup(asked, rows, said, ["en", "fr"]).collect()}
    pair = "a ۝١ b ۝٢"
    assert got == {("Q:2:1-2", "de"): (pair, "(1) A (2) B"), ("Q:2:1-2", "fr-FR"): (pair, None), ("Q:2:2-3", "en"): ("b ۝٢ c ۝٣", None), ("Q:2:1", "ar"): ("a", None), ("Q:2:1", "fr"): ("a", "Af")}
    ids = spark.createDataFrame([("Q:2:1-4", 2, 1, 4), ("Q:2:9", 2, 9, 9), ("QA:s:9:3", None, None, None), ("QA:s:91", None, None, None)], "id string, key int, lo int, hi int")
    want = spark.createDataFrame([("Q:2:1", 2, 1, 1), ("QA:s:9", None, None, None)], "id string, key int, lo int, hi int")
    assert sorted(map(tuple, intervals.matches(ids, want).collect())) == [("Q:2:1-4", "Q:2:1"), ("QA:s:9:3", "QA:s:9")]


def test_draft_checks(spark):
    def issues(reply, evidence=("Q:2:1-5", "S:1"), cited=("S:1",), points=(("m", ("S:1",)),), lang="en", detected=None, level="B", copied=None):
        return (reply, lang, level, list(evidence), list(cited), [(m, list(s)) for m, s in points], ["ramadan"], detected, copied)

    cases = [
        (issues("fine [[Q:2:3]]"), []), (issues("so [[Q:9:1]]"), ["placeholder"]), (issues("x", cited=("S:2",)), ["cited_id"]), (issues("x", cited=()), ["no_citation"]),
        (issues("﴿x﴾"), ["brackets"]), (issues("x ([GL:1])"), ["raw_id"]), (issues("кот"), ["garbled"]), (issues("x", points=(("m", ()),)), ["point_without_source"]),
        (issues("x", points=(("m", ("S:7",)),)), ["point_source"]), (issues("x", points=()), ["no_points"]), (issues("x", detected="fr"), ["language"]), (issues("x", lang="ur", detected="fa"), []),
        (issues("x", copied=8), ["copied"]), (issues("All scholars agree", level="D"), ["certainty"]), (issues("All scholars agree", level="A"), []),
    ]
    drafts = spark.createDataFrame([c[0] for c in cases], "reply string, lang string, level string, evidence array<string>, cited array<string>, points array<struct<meaning:string,sources:array<string>>>, latin array<string>, detected string, copied int")
    assert [r["issues"] for r in checks.draft_issues(drafts).collect()] == [c[1] for c in cases]
    letters = [("وقد Exploration Stem sorry", "ar", "latin_run"), ("كلمة Ramadan فقط", "ar", None), ("أوshares", "en", "glued"), ("plain english words", "en", None), ("[[Q:1:1]] https://a.b/c نص", "ar", None)]
    rows = spark.createDataFrame(letters, "t string, lang string, want string").select("want", checks.garbled(F.col("t"), F.col("lang"), F.array(F.lit("ramadan"))).alias("got"))
    assert all(r["want"] == r["got"] for r in rows.collect())
    assert _one(spark, "a ([GL:1], [SH:2]) b  \n\n\n\nc [[Q:1:2]]", checks.tidy) == "a b\n\nc [[Q:1:2]]"


def test_search_finds_words_of_both_alphabets(spark):
    docs = spark.createDataFrame([(1, "الصلاة عماد الدين"), (2, "prayer is the pillar"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "صلاة"), (8, "Prayer"), (9, "the of")], "item_id long, text string")
    index = search.build_index(docs)
    assert index.documents == 3 and {(r["query"], r["doc"]) for r in search.bm25_scores(index, asked).collect()} <= {(7, 1), (8, 2)}
    many = spark.createDataFrame([(k, "الصلاة" if k == 1 else f"word{k} text") for k in range(1, 9)], "doc_id long, text string")
    assert [(r["query"], r["doc"]) for r in search.bm25(search.build_index(many), asked).collect()] == [(7, 1)]


def test_vector_search_in_blocks(spark):
    rng = random.Random(4)
    rows = [(k, [float(rng.randrange(-3, 4)) for _ in range(4)]) for k in range(90)]
    corpus = spark.createDataFrame(rows, "doc long, vector array<float>").repartition(3)
    asked = spark.createDataFrame(rows[:11], "query long, vector array<float>")
    want = [(q, d) for q, v in rows[:11] for d in sorted(range(90), key=lambda d: (-sum(a * b for a, b in zip(v, rows[d][1], strict=True)), d))[:5]]
    for block in (1 << 20, 100):
        assert sorted((r["query"], r["rank"], r["doc"]) for r in search.dense(corpus, asked, 5, block).collect()) == [(q, i % 5 + 1, d) for i, (q, d) in enumerate(want)]


def test_copied_runs_against_all_places(spark):
    rng = random.Random(6)
    a = [(k, [rng.choice("abc") for _ in range(40)]) for k in range(4)]
    b = [(9, a[1][1][5:25] + ["z"] + a[2][1][:12])]
    got = {(r["doc_id"], r["pos"], r["origin"], r["length"]) for r in copies.runs(*(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{key} long, text string") for rows, key in ((a, "doc_id"), (b, "item_id")))).collect()}
    want = set()
    for k, x in a:
        for p in range(40):
            for q in range(len(b[0][1])):
                if p and q and x[p - 1] == b[0][1][q - 1]:
                    continue
                n = 0
                while p + n < 40 and q + n < len(b[0][1]) and x[p + n] == b[0][1][q + n]:
                    n += 1
                if n >= 8:
                    want.add((k, p, q, n))
    assert got == want and (1, 5, 0, 20) in got


def test_glossary_terms_and_alternates(spark):
    terms = spark.createDataFrame([("zakat", "الزكاة", "Zakat (alms-tax)", True), ("hajj", "الحج", "hajj, pilgrimage", False)], "term string, ar string, en string, official boolean")
    texts = spark.createDataFrame([(1, "وبالزكاة"), (2, "the pilgrimage and ZAKAT"), (3, "والحج ثم للزكاة"), (4, "pilgrimages"), (5, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["rank"] for r in records.glossary_terms(texts, terms).collect()}
    assert got == {(2, "zakat"): 1, (2, "hajj"): 2, (3, "hajj"): 2, (3, "zakat"): 1}
    assert _one(spark, "<i>12. Say</i> * it [3] , now", records.clean_translation) == "Say  it, now"


def test_discrete_quantiles(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 6)] + [("b", 7.0)], "g string, v double")
    assert {r["g"]: r["value"] for r in evaluation.p90(rows, "g", "v").collect()} == {"a": 4.0, "b": 7.0}
    assert {r["g"]: r["value"] for r in evaluation.upper_median(rows, "g", "v").collect()} == {"a": 3.0, "b": 7.0}


def test_labels(spark):
    assert [_one(spark, t, labels.script) for t in ("كتاب a", "كت", "a كتاب bcde", "12", None)] == ["arabic", "none", "latin", "none", "none"]
    assert [_one(spark, t, labels.heading) for t in (" \n a \nb", None, "x" * 141)] == ["a", "", "x" * 139 + "…"]
    names = spark.createDataFrame([(1, "Al Baqara"), (2, "An Nisa"), (3, "al nisa")], "k int, n string")
    assert [tuple(r) for r in labels.unique_aliases(names, "k", "n").collect()] == [("baqara", 1)]
    texts = spark.createDataFrame([(1, "the red cat, the red cat"), (2, None), (3, "cat")], "doc_id int, text string")
    terms = spark.createDataFrame([("red cat", 2), ("the red", 1), ("cat the", 2)], "term string, priority int")
    assert sorted(map(tuple, labels.terms_in(texts, terms).collect())) == [(1, "cat the", 2), (1, "red cat", 3), (1, "the red", 1)]


def test_translations_with_notes(spark):
    rows = [("In the name &amp; of<br>_______<br>[1] note &lt;x&gt;",), ("(12) ﻻ إله [3] * , ok",), (None,), ("plain",), ("<i>5. Say</i><BR/> _____ <br />",)]
    got = [tuple(r) for r in records.translations(spark.createDataFrame(rows, "raw string").coalesce(1)).collect()]
    assert sorted(got, key=repr) == sorted([("In the name & of", "[1] note <x>"), ("لا إله, ok", None), ("", None), ("plain", None), ("Say", None)], key=repr)
    assert _one(spark, "a ﷽ b", records.clean_page) == "a بسم الله الرحمن الرحيم b"


def test_names_of_any_length(spark):
    glossary = spark.createDataFrame([(1, None, "the oneness of god in worship, tawhid", True), (2, "x", "", False)], "term int, ar string, en string, official boolean")
    texts = spark.createDataFrame([(1, "so The oneness of God, in worship!"), (2, "Tawhid"), (3, "oneness of god")], "doc_id int, text string")
    assert sorted((r["doc_id"], r["term"]) for r in records.glossary_terms(texts, glossary).collect()) == [(1, 1), (2, 1)]


def test_overlapping_intervals_of_any_length(spark):
    import random

    from tessera.operators import intervals

    rng = random.Random(1)
    side = lambda name: [(f"{name}{k}", rng.randrange(3) if rng.random() < 0.95 else None, lo := rng.randrange(-500, 500), lo + rng.choice([0, 1, 5, 40, 41, 200, 900, -3])) for k in range(120)]
    a, b = side("a"), side("b") + [("all", 0, -(1 << 40), 1 << 40)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, key int, lo long, hi long")
    got = {tuple(r) for r in intervals.overlapping(frame(a), frame(b)).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]}
    paths = [("Q:2:1-60", 2, 1, 60), ("Q:2:10-50", 2, 10, 50), ("Q:2", None, None, None), ("Q:2:5", 2, 5, 5), ("QA:s:1:2", None, None, None), ("QA:s:1", None, None, None), ("QA:s:11", None, None, None)]
    met = {tuple(r) for r in intervals.matches(frame(paths), frame(paths)).collect()}
    assert ("Q:2:1-60", "Q:2:10-50") in met and ("Q:2:5", "Q:2") not in met and ("QA:s:1:2", "QA:s:1") in met and ("QA:s:11", "QA:s:1") not in met and ("QA:s:1", "QA:s:1:2") not in met


def test_placeholders_are_rendered_and_terms_may_be_cited(spark):
    blocks = spark.createDataFrame([("Q:2:1", "B1"), ("H:a", "B2")], "ref string, block string")
    rows = [(1, "[[ Q:2:1 ]] and [[note]] [[H:a]]x[[Q:9:9]]"), (2, None), (3, "[[Q:2:1]][[Q:2:1\n]]"), (4, "[[[Q:2:1]]]")]
    got = {r["doc_id"]: (r["text"], r["missing"]) for r in store.render(spark.createDataFrame(rows, "doc_id int, text string"), blocks).collect()}
    assert got == {1: ("B1 and [[note]] B2x[[Q:9:9]]", 1), 2: ("", 0), 3: ("B1B1", 0), 4: ("[B1]", 0)}
    schema = "doc_id int, reply string, lang string, level string, evidence array<string>, cited array<string>, points array<struct<meaning:string,sources:array<string>>>, detected string, latin array<string>, copied int, glossary array<string>"
    drafts = [(1, "so [[Q:2:1]]", "en", "B", ["Q:2:1"], ["Q:2:1", "GL:5"], [("m", ["Q:2:1"])], None, None, 0, ["GL:5"]), (2, "so [[Q:2:1]]", "en", "B", ["Q:2:1"], ["GL:6"], [("m", ["Q:2:1"])], None, None, 0, ["GL:5"]), (3, "so [[Q:2:1]]", "en", "B", ["Q:2:1"], ["GL:6"], [("m", ["Q:2:1"])], None, None, 0, None)]
    frame = spark.createDataFrame(drafts, schema)
    assert {r["doc_id"]: r["issues"] for r in checks.draft_issues(frame).collect()} == {1: [], 2: ["cited_id"], 3: ["cited_id"]}
    assert {r["doc_id"]: r["issues"] for r in checks.draft_issues(frame.drop("glossary")).collect()} == {1: ["cited_id"], 2: ["cited_id"], 3: ["cited_id"]}


def test_html_with_given_entities_only(spark):
    pages = spark.createDataFrame([(1, "a&ampb <b>c</b>&lt;&nbsp;d &amp;quot; &quot;\u00a0e")], "i int, h string")
    assert html_text(pages, "h", "t", {"&quot;": '"', "&amp;": "&"}, "[ \\t\\r\\n]+").first()["t"] == 'a&ampb c &lt;&nbsp;d &quot; "\u00a0e'


def test_references_count_for_a_drafts_language(spark):
    rows = [(1, 0, "user", "the cab [GL:12] [SH:3] oak elm fir ash yew")]
    told = [chat.message_languages(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), quotes=q).first() for q in (False, True)]
    assert [(r["share"], r["sure"]) for r in told] == [(round(1 / 7, 6), True), (round(1 / 11, 6), False)]


def test_alternates_meet_a_name_once(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "a"]), (3, ["x"])], "k int, names array<string>")
    entries = [("a", None), ("a", None), ("c", None), ("b", "y"), ("b", "x"), ("b", None)] * 50
    best = records.best_alternate(rows, spark.createDataFrame(entries, "name string, en string"), "k", "names")
    assert {r["k"]: (r["name"], r["en"]) for r in best.collect()} == {1: ("b", "x"), 2: ("c", None)}
    # Entries of a name are one before the join.
    assert best._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_vector_search_holds_few_products_at_once():
    class Block:
        value = (np.arange(3000), np.random.default_rng(3).integers(-3, 4, (3000, 8)).astype(float))

    vectors = np.random.default_rng(4).integers(-3, 4, (4000, 8)).astype(np.float32)
    batches = [pd.DataFrame({"doc": np.arange(k, k + 2000)[::-1], "vector": list(vectors[k : k + 2000][::-1])}) for k in (2000, 0)]
    tracemalloc.start()
    got = pd.concat(search._scorer(Block, 5)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    every = Block.value[1] @ vectors.astype(float).T
    for query, own in list(got.groupby("query"))[::100]:
        want = sorted((-score, doc) for doc, score in enumerate(every[query]))[:5]
        assert sorted(zip(-own["score"], own["doc"], strict=True)) == want


def test_index_keeps_how_often_a_term_occurs(spark):
    docs = spark.createDataFrame([(1, "oak oak elm"), (2, "oak ash"), (3, None)], "doc_id long, text string")
    index = search.build_index(docs)
    assert sorted(map(tuple, index.vocabulary.select("term", "df", "times").collect())) == [("ash", 1, 1), ("elm", 1, 1), ("oak", 2, 3)]
    assert (index.documents, index.mean) == (3, 5 / 3)


def test_bm25_of_whole_documents(spark, monkeypatch):
    """The best documents are those of all scores, and neither texts nor scores of all documents are shuffled."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    some = lambda n: " ".join(rng.choices(words, range(1, 41), k=n))
    docs = [(k, some(rng.randrange(1, 30))) for k in range(200)] + [(200, None), (201, "")]
    asked = spark.createDataFrame([(q, some(6)) for q in range(30)] + [(30, None), (31, "unknown")], "item_id long, text string")
    monkeypatch.setattr(search, "QUERY_BYTES", 256 * 60)
    plain = search._term_scorer
    monkeypatch.setattr(search, "_term_scorer", lambda block, mean, top: plain(block, mean, top, 70))
    allowed = spark.createDataFrame([(k,) for k in range(0, 210, 3)], "doc long")
    for rows in (docs, docs + [(7, some(9)), (8, some(20)), (8, some(3))]):
        index = search.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        every = search.bm25_scores(index, asked)
        for few in (None, allowed):
            got = search.bm25(index, asked, top=5, allowed=few)
            want = search.best(every if few is None else every.join(few, "doc", "left_semi"), 5)
            assert sorted(map(tuple, got.select("query", "doc", "score", "rank").collect())) == sorted(map(tuple, want.select("query", "doc", "score", "rank").collect()))
        if rows is docs:
            assert "doc" not in "".join(re.findall(r"hashpartitioning\([^)]*", search.bm25(index, asked)._jdf.queryExecution().executedPlan().toString()))


def test_names_of_many_terms(spark):
    rng = random.Random(5)
    words = ["alder", "birch", "cedar", "maple"]
    entries = [(t, ", ".join(rng.sample(words, 2)), rng.random() < 0.05) for t in range(300)]
    entries += [(t, rng.choice(words), rng.random() < 0.3) for t in range(0, 300, 7)]
    texts = [(1, "Alder and birch"), (2, "cedar"), (3, "maple, alder, cedar"), (4, "none"), (5, None)]
    glossary = spark.createDataFrame([(t, None, en, o) for t, en, o in entries], "term int, ar string, en string, official boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = records.glossary_terms(spark.createDataFrame(texts, "doc_id int, text string"), glossary)
        # Runs of words aren't shuffled.
        assert "hashpartitioning(name" not in got._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for doc, text in texts:
        official = {}
        for t, en, o in entries:
            if any(n in (text or "").lower() for n in en.split(", ")):
                official[t] = official.get(t, False) or o
        want += [(doc, t, k) for k, t in enumerate(sorted(official, key=lambda t: (not official[t], t))[:15], 1)]
    assert found == sorted(want)
