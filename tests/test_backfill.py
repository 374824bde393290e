"""References filled in, against one regular expression of all names and a loop over its matches."""

import random
import re

from pyspark.sql import functions as F

from tessera.jobs import QUERIES
from tessera.operators import backfill

NAMES = [("البقرة", 2), ("آل عمران", 3), ("المؤمنون", 23), ("عمران بيت", 9), ("Al Nur", 24), ("Nur", 25), ("يس", 36), ("بيت", 40)]
STORE = [(n, p, f"نص {n} {p}") for n in (2, 3, 9, 24, 25, 36) for p in range(1, 60) if (n, p) != (2, 7)]


def fold(s):
    return re.sub(r"\s+", " ", re.sub("[ً-ْ]", "", s).translate(str.maketrans("أإآةىؤ", "اااهيو"))).strip().lower()


def plain_fill(text):
    ways = {}
    for name, n in sorted(NAMES, key=lambda x: -x[1]):
        ways[fold(name)] = n
    lasts = [w.split()[-1] for w in map(fold, dict(NAMES))]
    for name, n in NAMES:
        last = fold(name).split()[-1]
        if lasts.count(last) == 1 and len(last) >= 3 and last not in map(fold, dict(NAMES)):
            ways[last] = n
    classes = {"ا": "اأإآ", "ه": "هة", "ي": "يى", "و": "وؤ"}
    alt = "|".join("".join(r"\s*" if c == " " else f"[{classes.get(c, c)}][ً-ْ]*" for c in w) for w in sorted(ways, key=len, reverse=True))
    num = r"([0-9٠-٩]{1,3})(?:\s*[-–]\s*([0-9٠-٩]{1,3}))?"
    found = [(m.start(), m.end(), m[1], m[2], m[3]) for m in re.finditer(rf"(?i)\[\s*({alt})\s*:\s*{num}\s*\]", text)]
    found += [(m.start(), m.end(), m[3], m[1], m[2]) for m in re.finditer(rf"(?i)\]{num}\s*:\s*\[?\s*({alt})(?![^\W\d_])", text)]
    out, refs, last, names = "", [], 0, {n: s for s, n in NAMES}
    spaced = {w.replace(" ", ""): n for w, n in sorted(ways.items(), key=lambda x: len(x[0]))}
    held = {(n, p): t for n, p, t in STORE}
    for start, end, name, a, b in sorted(found):
        number = spaced[fold(name).replace(" ", "")]
        lo, hi = sorted((int(a), int(b or a)))
        if start < last or lo < 1 or hi - lo >= 40 or any((number, p) not in held for p in range(lo, hi + 1)):
            continue
        span = str(lo) if lo == hi else f"{lo}-{hi}"
        body = held[number, lo] if lo == hi else " ".join(f"{held[number, p]} ۝{str(p).translate(str.maketrans('0123456789', '٠١٢٣٤٥٦٧٨٩'))}" for p in range(lo, hi + 1))
        refs.append(f"Q:{number}:{span}")
        out += text[last:start] + f" \ue000{body}\ue001 [{names[number]}: {span}] "
        last = end
    out = re.sub("[﴿﴾]", " ", out + text[last:]).replace("\ue000", "﴿").replace("\ue001", "﴾")
    return re.sub(r"[\s\xa0]+", " ", out).strip(), refs


def test_fill(spark):
    rng = random.Random(1)
    ways = ["البقرة", "البَقَرَه", "آل عمران", "ال عمران", "العمران", "عمران", "المؤمنون", "المومنون", "عمران بيت", "بيت", "Al Nur", "alnur", "AL  NUR", "Nur", "يس", "يسر", "غيره", "nurse"]
    number = lambda: rng.choice(["1", "7", "٥", "12", "3-5", "5 – 3", "6-8", "1-58", "999", "0", "58-60", "٢-٤"])
    part = lambda: rng.choice([lambda: f"[{rng.choice(ways)}: {number()}]", lambda: f"[ {rng.choice(ways)}:{number()} ]", lambda: f"]{number()} :[{rng.choice(ways)}", lambda: f"]{number()}:{rng.choice(ways)}{rng.choice([' ', '،', '1', ''])}", lambda: rng.choice(["قال ﴿", "﴾", "so ", "[", "]", "]7", "\n", "\xa0 x "])])()
    rows = [(k, rng.choice(["", " "]).join(part() for _ in range(rng.randrange(7)))) for k in range(400)]
    rows += [(900, None), (901, ""), (902, "[البقرة: 6]3 :[يس وغيره"), (903, "]3 :[آل عمران: 4]"), (904, "\U0001f600 [يس: 3] \U0001f600 ]2:[يس"), (905, "]4 :[عمران بيت] ]5 :[عمران")]
    got = backfill.fill(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(NAMES, "name string, number int"), spark.createDataFrame(STORE, "number int, place int, text string")).collect()
    want = {k: plain_fill(t or "") for k, t in rows}
    assert sum(len(refs) for _, refs in want.values()) > 300
    for r in got:
        assert (r["text"], r["refs"]) == want[r["doc_id"]], dict(rows)[r["doc_id"]]
    assert len(got) == len(rows)


def test_nothing_to_fill(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    names = spark.createDataFrame(NAMES, "name string, number int")
    store = spark.createDataFrame(STORE, "number int, place int, text string")
    assert backfill.fill(none, names, store).count() == 0
    left = backfill.fill(spark.createDataFrame([(1, "[Nur: 3]")], "doc_id int, text string"), names.where("false"), store).collect()
    assert [tuple(r) for r in left] == [(1, "[Nur: 3]", [])]


def test_repair(spark):
    rows = [
        (1, "He said «in the name of all» and (in the name of all) too", ["Q:1:1-3"], ""),
        (2, "so “a b c d” ends", [], "Text: A b, c D here"),
        (3, "so “a b c d” ends", [], "other"),
        (4, "x (a.b*c) y $1", ["Q:2:5"], None),
        (5, None, None, None),
    ]
    typed = [(1, 0, "in the name of all", "Q:1:2"), (1, 1, "in the name of all", "Q:1:2"), (2, 0, "a b c d", "Q:7:7"), (3, 0, "a b c d", "Q:7:7"), (4, 0, "a.b*c", "Q:2:5"), (4, 1, "not there", "Q:2:5")]
    drafts = spark.createDataFrame(rows, "doc_id int, reply string, evidence array<string>, evidence_text string")
    got = {r["doc_id"]: (r["reply"], r["repaired"]) for r in backfill.repair(drafts, spark.createDataFrame(typed, "doc_id int, pos int, quoted string, ref string")).collect()}
    assert got == {1: ("He said [[Q:1:2]] and [[Q:1:2]] too", 2), 2: ("so [[Q:7:7]] ends", 1), 3: (rows[2][1], 0), 4: ("x [[Q:2:5]] y $1", 1), 5: ("", 0)}
    assert backfill.repair(drafts.where(F.lit(False)), spark.createDataFrame(typed, "doc_id int, pos int, quoted string, ref string")).count() == 0


def test_passages_are_not_shuffled_with_texts(spark, monkeypatch):
    """Texts are put together with passages' numbers, unless these are too many for a plan: alike either way."""
    rows = [(1, "[Al Nur: 3] and ]5-4 :[يس, so [بيت: 2]"), (2, "[البقرة: 6-8] [البقرة : 5]"), (3, "none"), (4, None), (5, "[Al Nur: 3][Al Nur: 3-5]")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    names, store = spark.createDataFrame(NAMES, "name string, number int"), spark.createDataFrame(STORE, "number int, place int, text string")
    found = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(backfill, "IN_PLAN", most)
        filled = backfill.fill(texts, names, store)
        plan = filled._jdf.queryExecution().executedPlan().toString()
        assert ("block#" in plan) == (most == 0)
        found.append(sorted((r["doc_id"], r["text"], tuple(r["refs"])) for r in filled.collect()))
    want = {k: plain_fill(t or "") for k, t in rows}
    assert found[0] == found[1] == [(k, want[k][0], tuple(want[k][1])) for k in sorted(want)]


def test_few_passages_need_no_shuffle(spark):
    """What texts name is looked up where it stands; neither texts nor references come together by key."""
    texts = spark.createDataFrame([(1, "[Al Nur: 3] and ]5-4 :[يس, so [بيت: 2]"), (1, "[يس: 1]"), (2, None)], "doc_id int, text string")
    filled = backfill.fill(texts, spark.createDataFrame(NAMES, "name string, number int"), spark.createDataFrame(STORE, "number int, place int, text string"))
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    # So two texts of one key don't mix either.
    want = [(1, *plain_fill("[Al Nur: 3] and ]5-4 :[يس, so [بيت: 2]")), (1, *plain_fill("[يس: 1]")), (2, "", [])]
    assert sorted((r["doc_id"], r["text"], r["refs"]) for r in filled.collect()) == sorted(want)


def test_places_of_what_is_written_alike(spark, monkeypatch):
    """Matches that occur again, or in part before, and odd spaces; passages in the plan or not."""
    rng = random.Random(5)
    parts = ["[يس: 3]", "[ يس:3 ]", "[يس: 3", "]3:يس", "]3:[ يس", "]3: يس عمران بيت", "]3:", "]3 : [", "يس", "بيت عمران", "[Nur:\xa03-\t5]", "]5–3:\x0b[\fal nur", " \x0b\r ", "\xa0", "", " ", "﴾", "x\x00y", "\U0001f600", "[", "]"]
    rows = [(k, "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(12)))) for k in range(600)]
    texts, names, store = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(NAMES, "name string, number int"), spark.createDataFrame(STORE, "number int, place int, text string")
    want = {k: plain_fill(t) for k, t in rows}
    assert sum(len(refs) for _, refs in want.values()) > 500
    for most in (1 << 20, 0):
        monkeypatch.setattr(backfill, "IN_PLAN", most)
        got = {r["doc_id"]: (r["text"], r["refs"]) for r in backfill.fill(texts, names, store).collect()}
        assert len(got) == len(rows)
        for k, t in rows:
            assert got[k] == want[k], t


def test_orders_of_one_file_are_dealt_out(spark, tmp_path, monkeypatch):
    """Each row is a lot of work, so a table in one file isn't left to one task."""
    spark.range(25).selectExpr("int(id) AS n_nationkey", "concat('NATION_', id) AS n_name").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(400).selectExpr("id % 100 AS conv_id", "int(id / 100) AS turn", "concat('Text ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.range(500).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey", "'5-LOW' AS o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = []
    monkeypatch.setattr(backfill, "written", lambda df, label: found.append(df.rdd.getNumPartitions()) or df)
    assert QUERIES["verse_backfill"](spark, str(tmp_path)).count() == 500
    assert max(found) >= spark.sparkContext.defaultParallelism
