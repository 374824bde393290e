"""HTML answers of a search service: results, their labelled fields, and which of them are authentic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import html_text

# How results are marked, the labels of their fields, the two collections whose rows count unless graded otherwise, and words of a negative grade.
RESULT = '<div[^>]*class="hadith"[^>]*>'
INFO = 'class="hadith-info"'
FIELDS = {"narrator": "الراوي", "muhaddith": "المحدث", "source": "المصدر", "number": "الصفحة أو الرقم", "grade": "خلاصة حكم المحدث"}
COLLECTIONS = {"صحيح البخاري": "bukhari", "صحيح مسلم": "muslim"}
NEGATIVE = "ضعيف|موضوع|منكر|لا يصح|باطل|لا أصل|كذب|شاذ|مرسل|منقطع|معلول|واه"
AUTHENTIC = "صحيح"
NUMBERED = r"^[0-9]+\s*-\s*"


def field_pattern(label: str) -> str:
    """What follows a label, up to the next label or the end."""
    return rf"{label}\s*:\s*(.*?)(?:(?:{'|'.join(FIELDS.values())})\s*:|$)"


def results(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, text, a column for each of FIELDS, authentic): the results of each answer in order; those without text don't count.

    pos counts results from 0 as they are marked.  A field that a result lacks is empty, but for one
    whose label another one's ends with: it has that one's value.
    """
    parts = pages.select(key, F.posexplode(F.split(F.coalesce(F.col(html), F.lit("")), RESULT)).alias("pos", "part")).where("pos > 0")
    at = F.instr("part", INFO)
    cut = parts.select(
        key, (F.col("pos") - 1).alias("pos"), F.split(F.when(at > 0, F.substring_index("part", INFO, 1)).otherwise(F.col("part")), "</div>")[0].alias("text_html"),
        F.when(at > 0, F.expr(f"substring(part, instr(part, '{INFO}') + {len(INFO)})")).otherwise(F.lit("")).alias("info_html"),
    )
    plain = html_text(html_text(cut, "text_html", "text"), "info_html", "info")
    named = [F.regexp_replace(F.regexp_extract("info", field_pattern(label), 1), r"^[ \-|]+|[ \-|]+$", "").alias(name) for name, label in FIELDS.items()]
    rows = plain.select(key, "pos", F.regexp_replace("text", NUMBERED, "").alias("text"), *named).where("text <> ''")
    return rows.withColumn("authentic", authentic(F.col("source"), F.col("grade")))


def authentic(source: Column, grade: Column) -> Column:
    """A grade without a negative word that says so, or none of these words on a row of the two collections."""
    good = ~F.coalesce(grade, F.lit("")).rlike(NEGATIVE)
    return good & (F.coalesce(source, F.lit("")).isin(*COLLECTIONS) | F.contains(F.coalesce(grade, F.lit("")), F.lit(AUTHENTIC)))
