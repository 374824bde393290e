"""Tables of contents: numbered entries in order, with titles that run over lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What heads a page of contents, how an entry's number and page are written.
HEADING, HEADERS = "فهرس", ("المسألة الصفحة", "الصفحة المسألة")
NUMBER = r"([0-9]{1,3})\("
DOTS = r"\.{3,}"
PAGE = r"(^|\s)[0-9]{1,4}(\s|$)"
EDGE_PAGE = r"^\s*[0-9]{1,4}\s+|\s+[0-9]{1,4}\s*$"
SIGNS = r"-?\)\s*:?|^\s*[-:]\s*"
BRACKETS = "[﴿﴾]"

_ENTRY = "key long, number long, mark string, line string, tail string"


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of books from lines (key, text), which come sorted by book and place; all that is kept is the number expected next and the entry that is open."""
    number, page = re.compile(NUMBER), re.compile(PAGE)

    def lines() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    for key, own in groupby(lines(), key=lambda r: r[0]):
        expected, waiting, done = 1, None, []
        for _, line in own:
            met = next((m for m in number.finditer(line) if str(expected).endswith(m[1])), None)
            if met is None:
                if waiting:
                    done.append((*waiting, line))
                    waiting = None
                continue
            if waiting:
                done.append((*waiting, None))
            waiting, expected = (expected, met[0], line), expected + 1
            if page.search(line.replace(met[0], " ")):
                done.append((*waiting, None))
                waiting = None
            if len(done) > 4096:
                yield _batch(key, done)
                done = []
        if done:
            yield _batch(key, done)


def _batch(key: int, done: list[tuple]) -> pa.RecordBatch:
    numbers, marks, lines, tails = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([key] * len(done), pa.int64()), pa.array(numbers, pa.int64()), pa.array(marks), pa.array(lines), pa.array(tails, pa.string())], names=["key", "number", "mark", "line", "tail"])


def title(mark: Column, line: Column, tail: Column) -> Column:
    """An entry's title: its line without number, page, dots and signs, and the line that it runs over to."""
    own = F.regexp_replace(F.regexp_replace(F.replace(line, mark, F.lit(" ")), EDGE_PAGE, " "), SIGNS, " ")
    both = F.concat(own, F.coalesce(F.concat(F.lit(" "), F.regexp_replace(tail, PAGE, " ")), F.lit("")))
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(both, BRACKETS, " "), r"\s+", " ")), r"^[ \-.:]+|[ \-.:]+$", "")


def contents(lines: DataFrame, key: str = "book", order: str = "pos", text: str = "text") -> DataFrame:
    """(key, number, title): the entries of each book's contents, numbered 1, 2, 3 ... in the order of lines.

    A line has an entry's number if it holds the number expected next before a
    bracket, or its last digits, as where digits were torn apart; other numbers
    are noise.  An entry without a page is open: a line that has no number ends
    its title, the next entry closes it as it is, and one that is open in the end
    is left out.  Headings and lines that are null don't count.  Lines stream by
    book; a book is never held.
    """
    rows = lines.select(F.col(key).cast("long").alias("key"), F.col(order).alias("pos"), F.col(text).alias("text")).where("text is not null")
    rows = rows.where(~F.contains("text", F.lit(HEADING)) & ~F.trim("text").isin(*HEADERS)).withColumn("text", F.regexp_replace("text", DOTS, " "))
    found = rows.repartition("key").sortWithinPartitions("key", "pos").select("key", "text").mapInArrow(entries, _ENTRY)
    return found.select(F.col("key").alias(key), "number", title(F.col("mark"), F.col("line"), F.col("tail")).alias("title"))
