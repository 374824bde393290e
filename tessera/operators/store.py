"""The verbatim store: references to places of a store, looked up whole, with translations, and resolved to citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import once
from tessera.operators.checks import PLACEHOLDER
from tessera.operators.intervals import MAX_SPAN
from tessera.sources import broadcast_if_small, written

# The form of references, the marks of places and the form of citations in texts.
REFERENCE = r"^Q:([0-9]{1,3}):([0-9]{1,3})(?:-([0-9]{1,3}))?$"
LAST_KEY = 114
DIGITS, INDIC = "0123456789", "٠١٢٣٤٥٦٧٨٩"
CITED = r"[\[(](?:سورة[ \t\n]+)?([ء-يA-Za-z ]{2,20}?)[ \t\n]*:[ \t\n]*([0-9٠-٩]{1,3})(?:[ \t\n]*[-–][ \t\n]*([0-9٠-٩]{1,3}))?[ \t\n]*[\])]"
URL = "https://quranpedia.net/surah/1/%d/%d"


def parse_ref(ref: Column) -> Column:
    """struct(key, lo, hi) of a reference `Q:key:lo[-hi]`; null where it is malformed, its key isn't from 1 to LAST_KEY or its places aren't in order."""
    part = lambda k: F.nullif(F.regexp_extract(F.trim(ref), REFERENCE, k), F.lit("")).cast("int")
    key, lo = part(1), part(2)
    hi = F.coalesce(part(3), lo)
    return F.when(key.between(1, LAST_KEY) & (lo >= 1) & (hi >= lo), F.struct(key.alias("key"), lo.alias("lo"), hi.alias("hi")))


def marker(place: Column) -> Column:
    """The mark of the end of a place, with its number in Indic digits."""
    return F.concat(F.lit("\u06dd"), F.translate(place.cast("string"), DIGITS, INDIC))


def label(key: Column, lo: Column, hi: Column, lang: Column) -> Column:
    """A reference as readers of a language write it."""
    number = F.concat(key.cast("string"), F.lit(":"), lo.cast("string"), F.when(hi != lo, F.concat(F.lit("-"), hi.cast("string"))).otherwise(F.lit("")))
    words = F.create_map(*[F.lit(x) for pair in {"en": "Quran ", "ur": "قرآن ", "id": "QS ", "fr": "Coran "}.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(words, lang), F.lit("Q ")), number)


def translation_lang(lang: Column, stored: list[str]) -> Column:
    """The stored translation that serves a language: none for Arabic, its own, else English."""
    head = F.split(F.lower(F.coalesce(lang, F.lit(""))), "-")[0]
    return F.when(head != "ar", F.when(head.isin(stored), head).otherwise(F.lit("en")))


def lookup(refs: DataFrame, store: DataFrame, translations: DataFrame, stored: list[str]) -> DataFrame:
    """(ref, lang, key, lo, hi, text, translation, url) of references (ref, lang) whose places are all in the store (key, place, text), each once.

    A range's places carry their marks.  The translation (key, place, lang, text)
    is given only where all places have one; of rows of one key and place the
    first text counts.
    """
    asked = refs.select("ref", "lang").distinct().withColumn("r", parse_ref(F.col("ref"))).where("r is not null and r.hi - r.lo < %d" % MAX_SPAN)
    asked = asked.select("ref", "lang", "r.*", translation_lang(F.col("lang"), stored).alias("tr_lang"))
    spelt = asked.withColumn("place", F.explode(F.sequence("lo", "hi")))
    own = store.groupBy("key", "place").agg(F.min("text").alias("text"))
    theirs = translations.groupBy("key", "place", F.col("lang").alias("tr_lang")).agg(F.min("text").alias("tr"))
    met = spelt.join(own, ["key", "place"]).join(theirs, ["key", "place", "tr_lang"], "left")
    parts = met.groupBy("ref", "lang", "key", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("place", "text", "tr"))).alias("p"), F.count("tr").alias("translated"))
    n = F.col("hi") - F.col("lo") + 1
    one = n == 1
    text = F.when(one, F.col("p")[0]["text"]).otherwise(F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit(" "), marker(x["place"]))), " "))
    several = F.array_join(F.transform("p", lambda x: F.concat(F.lit("("), x["place"].cast("string"), F.lit(") "), x["tr"])), " ")
    whole = parts.where(F.size("p") == n).withColumn("text", text)
    translation = F.when(F.col("translated") == n, F.when(one, F.col("p")[0]["tr"]).otherwise(several))
    return whole.select("ref", "lang", "key", "lo", "hi", "text", translation.alias("translation"), F.format_string(URL, "key", "lo").alias("url"))


def kind(ref: Column) -> Column:
    """Which store a reference belongs to: verse, hadith, cached, or null."""
    t = F.trim(ref)
    return F.when(t.startswith("Q:"), "verse").when(t.startswith("H:hadeethenc:"), "hadith").when(t.startswith("H:"), "cached")


def hadith(refs: DataFrame, store: DataFrame) -> DataFrame:
    """(ref, lang, text, grade, translation, url) of references `H:hadeethenc:number`; store (id, text, grade, translations as JSON, url).

    The translation is the one in the reader's language, none for Arabic; the URL is the reader's only where there is one.
    """
    asked = refs.select("ref", "lang", F.nullif(F.regexp_extract(F.trim("ref"), "^H:hadeethenc:([0-9]+)$", 1), F.lit("")).alias("id")).where("id is not null").distinct()
    met = asked.join(store, "id").withColumn("all", F.from_json("translations", "map<string,struct<hadeeth:string>>"))
    own = F.when(F.col("lang") != "ar", F.try_element_at("all", F.col("lang")))
    url = F.when(own.isNotNull(), F.replace(F.col("url"), F.lit("/ar/"), F.concat(F.lit("/"), F.col("lang"), F.lit("/")))).otherwise(F.col("url"))
    return met.select("ref", "lang", "text", "grade", own["hadeeth"].alias("translation"), url.alias("url"))


def cited(texts: DataFrame, names: DataFrame, store: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, ref): the citations `[name: lo-hi]` in a text whose places all exist, each once, in order.

    names (name, number) is a dimension of a few names; store has (key, place).
    """
    parts = lambda k: F.regexp_extract_all(F.col(text), F.lit(CITED), F.lit(k))
    texts = texts.select(key, once(F.col(text)).alias(text))
    found = texts.select(key, F.posexplode(F.arrays_zip(parts(1).alias("name"), parts(2).alias("lo"), parts(3).alias("hi"))).alias("pos", "c"))
    plain = lambda x: F.nullif(F.translate(F.col(x), INDIC, DIGITS), F.lit(""))
    found = found.select(key, "pos", F.trim("c.name").alias("name"), plain("c.lo").alias("lo"), plain("c.hi").alias("hi")).join(F.broadcast(names), "name")
    found = found.select(key, "pos", F.concat(F.lit("Q:"), F.col("number").cast("string"), F.lit(":"), F.concat_ws("-", "lo", "hi")).alias("ref"))
    first = found.groupBy(key, "ref").agg(F.min("pos").alias("pos"))
    asked = first.select("ref").distinct().withColumn("r", parse_ref(F.col("ref"))).where("r is not null and r.hi - r.lo < %d" % MAX_SPAN)
    spelt = asked.select("ref", F.col("r.key").alias("key_of"), (F.col("r.hi") - F.col("r.lo") + 1).alias("n"), F.explode(F.sequence("r.lo", "r.hi")).alias("place"))
    held = spelt.join(store.select(F.col("key").alias("key_of"), "place").distinct(), ["key_of", "place"]).groupBy("ref", "n").agg(F.count("*").alias("met")).where("met = n")
    # References are few and each is cited by many texts, so none of them is a shuffle key.
    return first.join(broadcast_if_small(written(held.select("ref"), "held"), 64), "ref", "left_semi").select(key, "pos", "ref")


def citations(cites: DataFrame, *dims: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rank, id, source, resolved): the ids that a text cites (key, pos, id), each once in order, looked up in dims (id, source), the first that has it."""
    first = cites.groupBy(key, "id").agg(F.min("pos").alias("pos"))
    every = None
    for n, dim in enumerate(dims):
        own = dim.select("id", F.col("source").alias("source"), F.lit(n).alias("n"))
        every = own if every is None else every.unionByName(own)
    known = every.join(first.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.struct("n", "source")).alias("of"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("pos"))
    return first.join(known, "id", "left").select(key, rank.alias("rank"), "id", F.col("of.source").alias("source"), F.col("of").isNotNull().alias("resolved"))


def render(texts: DataFrame, blocks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, missing): placeholders `[[ref]]` replaced by the blocks (ref, block) they name, in order; those that name none stay and are counted.

    White space inside the brackets doesn't count; other things in double brackets are no placeholders.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    part = lambda k: F.regexp_extract_all(own, F.lit(PLACEHOLDER), F.lit(k))
    cut = texts.select(key, F.split(own, PLACEHOLDER, -1).alias("pieces"), F.arrays_zip(part(1).alias("ref"), part(0).alias("whole")).alias("m"))
    met = cut.select(key, F.posexplode("m").alias("pos", "x")).select(key, "pos", "x.ref", "x.whole").join(blocks.select("ref", "block"), "ref", "left")
    put = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("block", "whole").alias("body"))))
    per = met.groupBy(key).agg(F.transform(put, lambda x: x["body"]).alias("put"), F.sum(F.col("block").isNull().cast("long")).alias("missing"))
    whole = cut.join(per, key, "left").withColumn("put", F.coalesce("put", F.array().cast("array<string>")))
    return whole.select(key, F.array_join(F.zip_with("pieces", "put", lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "").alias("text"), F.coalesce("missing", F.lit(0).cast("long")).alias("missing"))
