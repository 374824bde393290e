"""Building the records of a corpus from nested and partial sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import SPACES, nfkc, norm, single_spaced, unescape
from tessera.sources import broadcast_if_small, written

# Limits and forms of record texts.
RERANK_CHARS = 1500
ALTERNATES = 4
NOTE_MARK = r"\[[0-9]{1,2}\]|\*+"
LEADING = r"^[ \t\n]*\(?[0-9]{1,3}\)?[.)]?[ \t\n]+"
NOTES = r"(?i)<br\s*/?>\s*_{5,}\s*<br\s*/?>"
LIGATURE, SPELT = "﷽", "بسم الله الرحمن الرحيم"
PREFIXES = ["و", "ف", "ب", "ل", "ك", "ال", "وال", "بال", "لل"]
MOST_TERMS = 15


def nested_records(parents: DataFrame, translations: DataFrame, topics: DataFrame, key: str, children: str, place: str) -> DataFrame:
    """(key, place, text, translations, topics): children of nested parents with what two other tables say of them.

    translations (key, place, lang, text) become a map, topics (key, place, topic,
    parent) the sorted set of topics and their parents; a child without any has
    an empty one.
    """
    each = parents.select(key, F.explode(children).alias("c")).select(key, F.col(f"c.{place}").alias(place), "c.text")
    said = translations.groupBy(key, place).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", F.col("text").alias("tr"))))).alias("translations"))
    names = topics.groupBy(key, place).agg(F.array_sort(F.array_union(F.collect_set("topic"), F.collect_set("parent"))).alias("topics"))
    met = each.join(said, [key, place], "left").join(names, [key, place], "left")
    none = F.expr("cast(map() as map<string,string>)")
    return met.select(key, place, "text", F.coalesce("translations", none).alias("translations"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def kept_grades(rows: DataFrame, grade: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose grade holds one of the words to keep, and (grade, n) of the others."""
    holds = F.coalesce(F.exists(F.array(*[F.lit(k) for k in keep]), lambda k: F.contains(F.col(grade), k)), F.lit(False))
    return rows.where(holds), rows.where(~holds).groupBy(grade).agg(F.count("*").alias("n"))


def parts_of(heads: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """(id, parent, part, text): a summary record of each head, and its details numbered from 2 as records beneath it."""
    own = heads.select(F.concat(F.lit("QA:"), F.col(key).cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("part"), "text")
    rank = F.row_number().over(W.partitionBy(key).orderBy("pos")) + 1
    more = details.withColumn("part", rank).select(F.format_string("QA:%d:%d", F.col(key), F.col("part")).alias("id"), F.format_string("QA:%d", F.col(key)).alias("parent"), "part", "text")
    return own.unionByName(more)


def numbered(rows: DataFrame, key: str, page: str, order: str) -> DataFrame:
    """rows with `id`: key and page, and from the second row of these on their number."""
    n = F.row_number().over(W.partitionBy(key, page).orderBy(order))
    base = F.concat_ws(":", F.col(key).cast("string"), F.col(page).cast("string"))
    return rows.withColumn("n", n).withColumn("id", F.when(F.col("n") == 1, base).otherwise(F.concat_ws(":", base, F.col("n").cast("string")))).drop("n")


def embed_text(kind: Column, title: Column, text: Column, english: Column, topics: Column) -> Column:
    """The text of a record that is embedded: its title where it has one of its own, the text, the English one and the topics of verses; blank parts are left out."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.concat_ws("\n", F.when(kind != "verse", blank(title)), blank(text), F.when(kind == "verse", blank(english)), F.when(kind == "verse", blank(F.array_join(topics, ", "))))


def rerank_text(kind: Column, text: Column, english: Column) -> Column:
    """What a scorer reads of a record: a verse with its English text, of others the beginning."""
    return F.when(kind == "verse", F.concat(text, F.lit("\n"), F.coalesce(english, F.lit("")))).otherwise(F.substring(text, 1, RERANK_CHARS))


def clean_translation(raw: Column) -> Column:
    """Without note marks, tags, a leading number and spaces before punctuation."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", " "), SPACES, " "))
    body = F.trim(F.regexp_replace(F.regexp_replace(plain, NOTE_MARK, ""), LEADING, ""))
    return F.regexp_replace(body, r"[ \t\n]+([,.;:!?،۔])", "$1")


def translations(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with `text` and `notes` instead of a raw translation: foot-notes apart (null without any), entities and compatibility forms resolved.

    Only rows that hold an entity or other than plain letters go through Python.
    """
    cut = F.split(F.coalesce(F.col(raw), F.lit("")), NOTES, 2)
    parts = rows.withColumn("text", F.regexp_replace(cut[0], "<[^>]+>", " ")).withColumn("notes", F.regexp_replace(F.nullif(F.get(cut, 1), F.lit("")), "<[^>]+>", " ")).drop(raw)
    odd = F.concat_ws(" ", "text", "notes").rlike(r"&[#A-Za-z]|[^\x00-\x{7f}\x{c0}-\x{131}\x{60c}-\x{65f}\x{670}-\x{674}\x{679}-\x{6d3}]")
    own = parts.where(~odd).unionByName(parts.where(odd).withColumn("text", nfkc(unescape("text"))).withColumn("notes", nfkc(unescape("notes"))))
    tidy = lambda c: F.trim(single_spaced(c))
    body = F.trim(F.regexp_replace(F.regexp_replace(tidy(F.col("text")), NOTE_MARK, ""), LEADING, ""))
    return own.withColumn("text", F.regexp_replace(body, r"[ \t\n]+([,.;:!?،۔])", "$1")).withColumn("notes", tidy(F.col("notes")))


def clean_page(body: Column) -> Column:
    """A book page without tags and foot-note marks; blanks and empty lines collapsed."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(body, F.lit("\r"), F.lit("\n")), "<[^>]+>", ""), r"\(?¬[0-9٠-٩*]*\)?|\[¬\*?\]", "")
    plain = F.replace(plain, F.lit(LIGATURE), F.lit(SPELT))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\n{2,}", "\n"), "[ \t]+", " "), "^[ \t\n]+|[ \t\n]+$", "")


def name_uuid(namespace: str, name: Column) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def best_alternate(rows: DataFrame, entries: DataFrame, key: str, alternates: str, most: int = ALTERNATES) -> DataFrame:
    """(key, name, en): of the entries (name, en) that a row's first alternates name the first with an English text, else the first."""
    named = rows.select(key, F.posexplode(F.slice(alternates, 1, most)).alias("pos", "name"))
    # Of a name's entries one alone can be chosen, the least text, so that a name that many entries share meets a row once.
    met = named.join(entries.groupBy("name").agg(F.min("en").alias("en")), "name")
    return met.groupBy(key).agg(F.min_by(F.struct("name", "en"), F.struct(F.col("en").isNull(), F.col("pos"), F.col("name"), F.col("en"))).alias("b")).select(key, "b.name", "b.en")


def names_of(text: Column) -> Column:
    """The single names of a term: parts between slashes, commas and brackets, of four letters or more."""
    parts = F.transform(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "‘’", "''"), "[/،,()]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) >= 4)


def _grams(lengths: list[int]) -> Column:
    """All runs of so many words of column w, each once."""
    runs = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.array_join(F.slice("w", i + 1, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[runs(k) for k in lengths]))


def glossary_terms(texts: DataFrame, glossary: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_TERMS) -> DataFrame:
    """(key, term, rank): the terms of a glossary (term, ar, en, official) that a text has, official ones first, then by term.

    An Arabic name also matches behind the particles that are written with it, an
    English one as any of its names.  Names are keys of an equality join with the
    runs of words of a text, of the lengths that names have.

    The ranks follow from the `most` first terms of each name: one that comes
    after so many of its name's comes after them in the text too.  So a text's
    names are gathered as numbers first, with the least of its names' last places,
    which none of the text's ranked terms comes after.
    """
    ar = norm(F.coalesce("ar", F.lit("")))
    bare = F.when(ar.startswith("ال") & (F.length(ar) > 4), F.substring(ar, 3, 1000)).otherwise(ar)
    arabic = F.concat(F.array(ar, bare), *[F.array(F.concat(F.lit(p), bare)) for p in PREFIXES])
    names = F.filter(F.array_distinct(F.concat(arabic, F.transform(names_of(F.col("en")), lambda n: F.trim(F.regexp_replace(norm(n), r"[^\p{L}\p{N}']+", " "))))), lambda n: F.length(n) > 1)
    each = glossary.select("term", F.col("official").cast("int").alias("official"), F.explode(names).alias("name")).groupBy("name", "term").agg(F.max("official").alias("official"))
    place = F.struct((-F.col("official")).alias("other"), "term")
    first = each.withColumn("of_name", F.row_number().over(W.partitionBy("name").orderBy(F.col("official").desc(), "term"))).where(F.col("of_name") <= most)
    listed = first.groupBy("name").agg(F.array_sort(F.collect_list(place)).alias("places")).withColumn("number", F.monotonically_increasing_id())
    keys = written(listed.withColumn("bound", F.get("places", most - 1)), "names")
    lengths = sorted(r[0] for r in keys.select(F.size(F.split("name", " "))).distinct().collect())  # a few
    split = texts.select(key, F.regexp_extract_all(norm(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}']+"), F.lit(0)).alias("w"))
    found = split.select(key, F.explode(_grams(lengths)).alias("name")).join(broadcast_if_small(keys.select("name", "number", "bound"), 200), "name")
    found = found.groupBy(key).agg(F.collect_set("number").alias("numbers"), F.min("bound").alias("bound"))
    met = found.select(key, "bound", F.explode("numbers").alias("number")).join(broadcast_if_small(keys.select("number", "places"), 32 * most), "number")
    near = F.filter("places", lambda p: F.col("bound").isNull() | (p <= F.col("bound")))
    met = met.select(key, F.inline(near)).groupBy(key, "term").agg(F.min("other").alias("other"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("other", "term"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "term", "rank")


def in_sequence(rows: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """(key, accepted): the numbers of a list of contents in order, each the next one after the last that was accepted, the first being 1; others are noise.

    One fold over a key's own numbers.
    """
    listed = rows.where(F.col(number).isNotNull()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, number))), lambda x: x[number].cast("long")).alias("n"))
    taken = F.aggregate("n", F.lit(0).cast("int"), lambda s, x: s + F.when(x == s + 1, 1).otherwise(0))
    return listed.select(key, taken.alias("accepted"), (F.size("n") - taken).alias("noise"))


def carried(rows: DataFrame, key: str, order: str, value: Column, out: str = "section") -> DataFrame:
    """rows with the last value that isn't null at or before each, in the order of its key."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
