"""References in texts replaced by the passages they name, and typed quotations by placeholders."""

from __future__ import annotations

import json
from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import once
from tessera.operators.checks import allowed_ids, covered
from tessera.operators.intervals import MAX_SPAN
from tessera.operators.quotes import letters_only
from tessera.operators.store import DIGITS, INDIC, marker
from tessera.sources import broadcast_if_small, written

# Letters that names are written with in more than one way, marks of short vowels, and the brackets of quoted passages.
VARIANTS_FROM, VARIANTS_TO = "أإآةىؤ", "اااهيو"
VOWELS = r"[\x{64b}-\x{652}]"
OPEN, CLOSE = "﴿", "﴾"
LEAST_LAST_WORD = 3

SPACE = r"[\s\x{a0}]"
_NUMBER = rf"([0-9٠-٩]{{1,3}})(?:{SPACE}*[-–]{SPACE}*([0-9٠-٩]{{1,3}}))?"
#: [name: lo-hi], and ]lo-hi :[name, which is how a right-to-left page may come out.
NORMAL = rf"\[{SPACE}*([^\[\]:]{{1,60}}?){SPACE}*:{SPACE}*{_NUMBER}{SPACE}*\]"
REVERSED = rf"\]{_NUMBER}{SPACE}*:{SPACE}*\[?{SPACE}*"
_WORD = r"[\p{L}\p{M}]+"
#: Stand for the brackets of passages that are put in, while those that the text had go.
_PUT_OPEN, _PUT_CLOSE = "\ue000", "\ue001"
#: Characters of passages, and of what stands for them, that may go into a plan.
IN_PLAN = 1 << 22
#: SPACE in a form that Java looks up in a table.
_FAST_SPACE = r"[ \t-\r\xa0]"
#: What becomes one space; single spaces, which are most of it, aren't replaced.
_SPACES = rf"[\t-\r\xa0]{_FAST_SPACE}*| {_FAST_SPACE}+"


def head_pattern(words: int) -> str:
    """A name of so many words at the beginning of a text, and what ends it."""
    return rf"^({_WORD}(?:{SPACE}*{_WORD}){{{words - 1}}})(?:[^\p{{L}}\p{{M}}]|$)"


def folded(name: Column) -> Column:
    """A name without short vowels, each letter in one form, in lower case, with single spaces."""
    plain = F.translate(F.regexp_replace(name, VOWELS, ""), VARIANTS_FROM, VARIANTS_TO)
    return F.lower(F.trim(F.regexp_replace(plain, f"{SPACE}+", " ")))


def aliases(names: DataFrame) -> DataFrame:
    """(written, size, number): how names (name, number) may be written in folded form, and the size of what is written there.

    The spaces of a name may be left out.  A name's last word of LEAST_LAST_WORD
    letters stands for it where no other name ends with it or is the same.  Of names
    written alike the longest counts, then the one of the least number.
    """
    own = names.select(folded(F.col("name")).alias("alias"), "number")
    last = own.select(F.element_at(F.split("alias", " "), -1).alias("alias"), "number")
    alone = last.groupBy("alias").agg(F.count("*").alias("n"), F.min("number").alias("number")).where((F.col("n") == 1) & (F.length("alias") >= LEAST_LAST_WORD)).drop("n")
    every = own.unionByName(alone.join(own.select("alias").distinct(), "alias", "left_anti"))
    parts = F.split("alias", " ")
    more = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    spelt = F.aggregate(more, F.array(parts[0]), lambda had, w: F.flatten(F.transform(had, lambda x: F.array(F.concat(x, w), F.concat(x, F.lit(" "), w)))))
    best = every.select(F.explode(spelt).alias("written"), F.length("alias").alias("size"), "number").groupBy("written").agg(F.min(F.struct((-F.col("size")).alias("s"), "number")).alias("b"))
    return best.select("written", (-F.col("b.s")).alias("size"), "b.number")


def _spots(text: str, pattern: str) -> Column:
    """(whole, stop) of each match of a pattern.  From where the one before stops, what matched isn't found earlier, or it would have matched there."""
    none = F.array().cast("array<struct<whole:string,stop:int>>")
    last = lambda had: F.coalesce(F.try_element_at(had, F.lit(-1))["stop"], F.lit(0))
    stop = lambda had, w: F.position(w, F.col(text), last(had) + 1) - 1 + F.length(w)
    return F.aggregate(F.regexp_extract_all(F.col(text), F.lit(pattern.replace(SPACE, _FAST_SPACE)), F.lit(0)), none, lambda had, w: F.array_append(had, F.struct(w.alias("whole"), stop(had, w).alias("stop"))))


def references(wholes: DataFrame, ways: DataFrame, most: int) -> DataFrame:
    """(whole, size, number, lo, hi): what has the form of a reference (whole), either way round, how much of it is one, and from which place to which.

    In a reversed one the name is the longest that follows and ends there, of most words.
    """
    found = []
    for begins, pattern, lo in (("[", NORMAL, 2), ("]", REVERSED, 1)):
        plain = lambda k: F.nullif(F.translate(F.regexp_extract("whole", pattern, k), INDIC, DIGITS), F.lit("")).cast("int")  # noqa: E731, B023
        first, second = plain(lo), F.coalesce(plain(lo + 1), plain(lo))
        part = F.regexp_extract("whole", pattern, 0)
        ahead = F.expr("substr(whole, length(part) + 1)")
        heads = F.array(F.regexp_extract("whole", pattern, 1)) if lo == 2 else F.array_distinct(F.array(*[F.regexp_extract(ahead, head_pattern(n), 1) for n in range(1, most + 1)]))
        each = wholes.where(F.col("whole").startswith(begins)).withColumn("part", part).select("whole", "part", F.least(first, second).alias("lo"), F.greatest(first, second).alias("hi"), F.explode(heads).alias("head"))
        size = F.length("part") + (F.lit(0) if lo == 2 else F.length("head"))
        found.append(each.where("head <> ''").select("whole", "lo", "hi", size.alias("stop"), folded(F.col("head")).alias("written")))
    met = found[0].unionByName(found[1]).join(ways, "written")
    best = met.groupBy("whole", "lo", "hi").agg(F.max(F.struct("size", "stop", "number")).alias("b"))
    return best.select("whole", F.col("b.stop").alias("size"), "b.number", "lo", "hi")


def passages(refs: DataFrame, store: DataFrame, names: DataFrame) -> DataFrame:
    """(number, lo, hi, passage, label) of references (number, lo, hi) of which the store (number, place, text) has every place, MAX_SPAN at most."""
    asked = refs.select("number", "lo", "hi").distinct().where((F.col("lo") >= 1) & (F.col("hi") - F.col("lo") < MAX_SPAN))
    spelt = asked.withColumn("place", F.explode(F.sequence("lo", "hi"))).join(store.groupBy("number", "place").agg(F.min("text").alias("text")), ["number", "place"])
    whole = spelt.groupBy("number", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p")).where(F.size("p") == F.col("hi") - F.col("lo") + 1)
    several = F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit(" "), marker(x["place"]))), " ")
    own = names.groupBy("number").agg(F.min("name").alias("name"))
    span = F.concat(F.col("lo").cast("string"), F.when(F.col("hi") > F.col("lo"), F.concat(F.lit("-"), F.col("hi").cast("string"))).otherwise(F.lit("")))
    named = whole.join(own, "number").withColumn("span", span)
    return named.select("number", "lo", "hi", F.when(F.size("p") == 1, F.col("p")[0]["text"]).otherwise(several).alias("passage"), F.concat("name", F.lit(": "), "span").alias("label"), F.concat(F.lit("Q:"), F.col("number").cast("string"), F.lit(":"), "span").alias("ref"))


def _told(rows: list[dict], key: str, fields: str) -> Callable[[Column], Column]:
    """A look-up of rows by a string, as a literal of the plan; dealt by checksums, so that a key is compared with a few only."""
    dealt: list[list[dict]] = [[] for _ in rows or [None]]
    for row in rows:
        dealt[crc32(row[key].encode()) % len(dealt)].append(row)
    held = _literal(dealt, f"array<array<struct<{fields}>>>")
    return lambda k: F.get(F.filter(F.get(held, (F.crc32(k) % len(dealt)).cast("int")), lambda row: row[key] == k), F.lit(0))


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind, {"mode": "FAILFAST"})


def _bracketed(text: Column) -> Column:
    """A text whose own brackets are spaces, with the brackets of what is put in; each character stays where it is."""
    for old, new in ((OPEN, " "), (CLOSE, " "), (_PUT_OPEN, OPEN), (_PUT_CLOSE, CLOSE)):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def fill(texts: DataFrame, names: DataFrame, store: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, refs): texts with each reference replaced by the passage it names in brackets, and the ids put in, in order.

    names (name, number) is a dimension; each of its names is written in a few ways.
    Of references that overlap the leftmost stays; those whose places aren't all
    in the store stay as they are and hide none.  Brackets that the text had
    become spaces, and white space one space.  A null text is an empty one.
    """
    ways = written(aliases(names), "aliases")
    most = ways.agg(F.max(F.size(F.split("written", " ")))).first()[0] or 1
    rows = texts.select(key, once(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    spots = F.concat(_spots("text", NORMAL), _spots("text", rf"{REVERSED}{_WORD}(?:{SPACE}*{_WORD}){{0,{most - 1}}}"))
    met = written(rows.select(key, _bracketed(F.col("text")).alias("text"), spots.alias("spots")), "spots")
    # What is written alike is told once, however many texts have it.
    wholes = written(met.select(F.explode("spots.whole").alias("whole")).distinct(), "wholes")
    known = written(references(wholes, broadcast_if_small(ways, 200), most), "references")
    # So are passages made plain, which are much longer than the texts around them.
    block = _spaced(_bracketed(F.concat(F.lit(_PUT_OPEN), "passage", F.lit(f"{_PUT_CLOSE} ["), "label", F.lit("]"))))
    blocks = written(passages(known, store, names).select("number", "lo", "hi", "ref", block.alias("block")), "blocks")
    told = known.join(blocks.select("number", "lo", "hi", "ref"), ["number", "lo", "hi"]).select("whole", "size", "ref")
    size = lambda rows, *of: rows.agg(F.sum(sum((F.length(c) for c in of), F.lit(32)))).first()[0] or 0
    at = lambda x: x["stop"] - F.length(x["whole"])
    if size(blocks, "ref", "block") + size(told, "whole") <= IN_PLAN:
        # Few passages, however many texts name them: they go into the plan, and nothing is shuffled.
        every = {b["ref"]: (i, b["block"]) for i, b in enumerate(blocks.select("ref", "block").collect())}
        known_as = _told([{"whole": r["whole"], "size": r["size"], "id": every[r["ref"]][0]} for r in told.collect()], "whole", "whole string, size int, id int")
        named = F.transform("spots", lambda x: F.struct(at(x).alias("at"), known_as(x["whole"]).alias("of")))
        named = F.transform(F.filter(named, lambda x: x["of"].isNotNull()), lambda x: F.struct(x["at"].alias("at"), (x["at"] + x["of"]["size"]).alias("stop"), x["of"]["id"].alias("put")))
        found = met.select(key, "text", F.sort_array(named).alias("m"))
        puts = {"ref": _literal(list(every), "array<string>"), "block": _literal([b for _, b in every.values()], "array<string>")}
        put = lambda x, name: F.get(puts[name], x["put"])
    else:
        each = met.select(key, F.explode("spots").alias("x")).select(key, at(F.col("x")).alias("at"), "x.whole").join(told, "whole").join(blocks.select("ref", "block"), "ref")
        per = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("size")).alias("stop"), F.struct("ref", "block").alias("put")))).alias("m"))
        found = met.select(key, "text").join(per, key, "left").withColumn("m", F.coalesce("m", F.array()))
        put = lambda x, name: x["put"][name]
    none = F.filter("m", lambda x: F.lit(False))
    piece = lambda begin, end: _spaced(F.substring(F.col("text"), begin + 1, end - begin))

    def whole(s: Column) -> Column:
        stop = lambda i: F.coalesce(F.get(s["kept"], i - 1)["stop"], F.lit(0))
        parts = F.flatten(F.transform(s["kept"], lambda x, i: F.array(piece(stop(i), x["at"]), put(x, "block"))))
        parts = F.array_append(parts, piece(s["last"], F.length("text")))
        return F.struct(F.array_join(F.filter(parts, lambda p: p != ""), " ").alias("text"), F.transform(s["kept"], lambda x: put(x, "ref")).alias("refs"))

    done = F.aggregate("m", F.struct(F.lit(0).alias("last"), none.alias("kept")), lambda s, x: F.when(x["at"] >= s["last"], F.struct(x["stop"].alias("last"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s), whole)
    return found.select(key, "text", once(F.col("m")).alias("m")).select(key, done.alias("done")).select(key, "done.text", "done.refs")


def repair(drafts: DataFrame, typed: DataFrame, key: str = "doc_id", reply: str = "reply") -> DataFrame:
    """drafts with `reply`, quotations that were typed replaced by placeholders, and `repaired`, how many were.

    drafts has the ids of its evidence, an array, and evidence_text; typed (key,
    pos, quoted, ref) says which passage a quotation is.  One is replaced, with the
    marks around it and where it is first, if its id is covered by the evidence or
    its letters are in the evidence's text; in the order of pos, each in what the
    ones before it left.
    """
    per = typed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "quoted", "ref"))).alias("__typed"))
    rows = drafts.join(per, key, "left")
    allowed = allowed_ids(F.coalesce("evidence", F.array().cast("array<string>")))
    rows = rows.withColumn("__allowed", allowed).withColumn("__key", letters_only(F.coalesce("evidence_text", F.lit(""))))
    may = lambda q: covered(q["ref"], F.col("__allowed")) | F.contains(F.col("__key"), letters_only(q["quoted"]))
    some = F.filter(F.coalesce("__typed", F.expr("cast(array() as array<struct<pos:int,quoted:string,ref:string>>)")), may)

    def put(state: Column, q: Column) -> Column:
        around = F.concat(F.lit(r'[«"“(]?\s*\Q'), q["quoted"], F.lit(r'\E\s*[»"”)]?'))
        parts = F.split(state["reply"], around, 2)
        met = (q["quoted"] != "") & F.contains(state["reply"], q["quoted"])
        return F.when(met, F.struct(F.concat(parts[0], F.lit("[["), q["ref"], F.lit("]]"), parts[1]).alias("reply"), (state["n"] + 1).alias("n"))).otherwise(state)

    done = F.aggregate(some, F.struct(F.coalesce(F.col(reply), F.lit("")).alias("reply"), F.lit(0).alias("n")), put)
    return rows.withColumn("__done", done).withColumn(reply, F.col("__done.reply")).withColumn("repaired", F.col("__done.n")).drop("__typed", "__allowed", "__key", "__done")
