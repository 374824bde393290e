"""Packing a document's lines into chunks, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes of the two chunkers.
SIZE, SOFT, LEAST = 1800, 1260, 80
CHUNK, OVER, TAIL = 1400, 1.6, 0.3
#: Where a page is cut: white space after the end of a sentence, or a line break.
CUT = r"(?<=[.؟!:])\s+|\n"
ENDS = "[.:؛!؟]$"


def _fold(parts: Column, joined, full) -> Column:
    """Gather parts in order; joined(open, part) is the text with a part more, or null to close what is open first; full(text) closes it after."""
    start = F.expr("named_struct('done', cast(array() as array<string>), 'open', cast('' as string))")

    def add(state: Column, part: Column) -> Column:
        more = joined(state["open"], part)
        grown = F.coalesce(more, part)
        kept = F.when(more.isNotNull() | (state["open"] == ""), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        closes = full(grown)
        return F.struct(F.when(closes, F.concat(kept, F.array(grown))).otherwise(kept).alias("done"), F.when(closes, F.lit("")).otherwise(grown).alias("open"))

    return F.aggregate(parts, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def split_long(text: Column, most: int = SIZE) -> Column:
    """The parts of a page: itself if it is not too long, else gathered from its sentences and lines; only a sentence that is longer makes a longer part."""
    pieces = F.filter(F.split(text, CUT), lambda x: F.trim(x) != "")
    long = _fold(F.transform(pieces, lambda x: F.trim(x)), lambda o, x: F.when((o != "") & (F.length(o) + F.length(x) <= most), F.concat(o, F.lit(" "), x)), lambda t: F.lit(False))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(long)


def chunk_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, n_parts, chars, body): lines, long ones split, gathered until the next would pass SIZE or SOFT is reached.

    Lengths are of the parts, without the line breaks between them.  Chunks under
    LEAST characters are dropped and the rest numbered.  One fold over a
    document's own lines.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: split_long(x)))
    size = lambda t: F.length(F.replace(t, F.lit("\n"), F.lit("")))
    folded = _fold(parts, lambda o, x: F.when((o != "") & (size(o) + F.length(x) <= SIZE), F.concat(o, F.lit("\n"), x)), lambda t: size(t) >= SOFT)
    out = docs.select(key, F.posexplode(F.filter(folded, lambda c: F.length(c) >= LEAST)).alias("pos", "body"))
    return out.select(key, (F.col("pos") + 1).alias("chunk"), F.size(F.split("body", "\n")).alias("n_parts"), F.length("body").alias("chars"), "body")


def chunk_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """(key, chunk, chars, body): lines joined by spaces until there are `size` characters and a line ends a sentence, or OVER times as many; a short tail goes to the chunk before it."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t\r]+", " "))), lambda x: x != "")
    joined = lambda o, x: F.when(o != "", F.concat(o, F.lit(" "), x))
    folded = _fold(lines, joined, lambda t: ((F.length(t) >= size) & t.rlike(ENDS)) | (F.length(t) >= size * OVER))
    n = F.size("c")
    tail = F.element_at("c", -1)
    # Only what is still open in the end can be as short as that.
    short = (n > 1) & (F.length(tail) < size * TAIL)
    merged = F.when(short, F.concat(F.slice("c", F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.element_at("c", -2), F.lit(" "), tail)))).otherwise(F.col("c"))
    out = docs.select(key, folded.alias("c")).where(F.size("c") > 0).select(key, F.posexplode(merged).alias("pos", "body"))
    return out.select(key, (F.col("pos") + 1).alias("chunk"), F.length("body").alias("chars"), "body")


def page_label(pages: Column) -> Column:
    """The printed pages of a chunk, an array of (part, page): volume if it is a number, first and last page; empty without any."""
    numbered = F.filter(pages, lambda p: p["page"].isNotNull() & (p["page"] != 0))
    first, last = F.try_element_at(numbered, F.lit(1)), F.try_element_at(numbered, F.lit(-1))
    span = F.when(first["page"] == last["page"], first["page"].cast("string")).otherwise(F.concat_ws("-", first["page"].cast("string"), last["page"].cast("string")))
    part = F.translate(F.trim(F.coalesce(first["part"], F.lit(""))), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    named = F.when(part.rlike("^[0-9]+$"), F.concat(F.lit("ج "), F.trim(first["part"]), F.lit(" ص "), span)).when(part == "المقدمة", F.concat(F.lit("المقدمة، ص "), span)).otherwise(F.concat(F.lit("ص "), span))
    return F.when(F.size(numbered) == 0, F.lit("")).otherwise(named)
