"""Text functions as columns: all of them stay in the JVM but for nfkc() and html_text()."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes and replacements of the normal form, prefixes and stop words of search terms.
INVISIBLE = r"[\x{feff}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{ad}]"
DIACRITICS = r"[\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6dc}\x{6df}-\x{6e8}\x{6ea}-\x{6ed}\x{640}]"
LETTERS_FROM = "آأإٱٲٳىةؤئیےکہ"
LETTERS_TO = "اااااايهويييكه"
ARABIC_PREFIX = "^(وال|بال|كال|فال|لل|ال)(.{3,})$"
ENGLISH_STOP = (
    "a an the of to in on and or is are was were be been it its this that these those for with as by at from do does did "
    "why what how who whom which when where can could would should i you he she we they me my your our their his her them "
    "us not no so if then than there about into over also just"
)
ARABIC_STOP = (
    "في من على الى عن ما ماذا لماذا هل ان او ثم لا لم لن قد كان كانت هو هي هم هذا هذه ذلك تلك التي الذي الذين كل بعض اي كيف متي "
    "اين مع عند بين حتي اذا لكن بل انا نحن انت"
)

STOP = sorted({*ENGLISH_STOP.split(), *ARABIC_STOP.split()})
SPACES = r"[\t-\r\x{1c}- \x{85}\x{a0}\x{2028}\x{2029}]+"
#: Its runs but for a single blank, which is what they become.
OTHER_SPACES = f" {SPACES}|[\\t-\\r\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}]{SPACES[:-1]}*"
#: A search term: Arabic letters, or Latin ones and digits.
TERM = "[ء-ي]+|[a-zà-ÿ0-9]+"
#: Only a text with such a character can hold marks or letter forms to unify.
BEYOND = r"[^\x00-\x{ac}\x{ae}-\x{5ff}\x{2010}-\x{2029}\x{2030}-\x{2065}]"
#: A word of any script.
WORD = r"[\p{L}\p{N}]+"
ARABIC = "[ء-ي]"


def once(value: Column) -> Column:
    """A generator keeps the optimiser from putting an expression in every place of the next step that looks at it."""
    return F.explode(F.array(value))


def strip_diacritics(text: Column) -> Column:
    return F.regexp_replace(text, DIACRITICS, "")


def norm(text: Column) -> Column:
    """Invisible marks and diacritics dropped, letter forms unified, spaces collapsed, lower case.

    Compatibility forms stay; normalise() sees to these as well.
    """
    plain = F.translate(strip_diacritics(F.regexp_replace(text, INVISIBLE, "")), LETTERS_FROM, LETTERS_TO)
    return F.lower(F.trim(single_spaced(plain)))


def single_spaced(text: Column) -> Column:
    """A text with each run of white space made one blank; single blanks, which are most of it, aren't replaced."""
    return F.regexp_replace(text, OTHER_SPACES, " ")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise(rows: DataFrame, text: str) -> DataFrame:
    """rows with `text` in NFKC and normal form; only rows that hold other than ASCII, common Latin or plain Arabic letters go through Python."""
    plain = F.coalesce(~F.col(text).rlike(r"[^\x00-\x{7f}\x{c0}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{60c}-\x{65f}\x{670}-\x{674}\x{679}-\x{6d3}«»“”]"), F.lit(True))
    direct, other = rows.where(plain), rows.where(~plain)
    return direct.withColumn(text, norm(F.col(text))).unionByName(other.withColumn(text, norm(nfkc(F.col(text)))))


def has_arabic(text: Column) -> Column:
    return norm(text).rlike(ARABIC)


def letters_only(text: Column, letters: str) -> Column:
    """The normal form with all but letters made single spaces."""
    return F.array_join(F.regexp_extract_all(_cut_form(text), F.lit(f"[{letters}]+"), F.lit(0)), " ")


def stem(term: Column) -> Column:
    return F.regexp_replace(term, ARABIC_PREFIX, "$2")


def words(text: Column) -> Column:
    """All words of a text in normal form, whatever their script, in order."""
    return F.regexp_extract_all(_cut_form(text), F.lit(WORD), F.lit(0))


def _cut_form(text: Column) -> Column:
    """norm() for a pattern that no white space matches: runs of it stay, and texts without marks or letter forms to unify are looked at once."""
    marks = f"[{INVISIBLE[1:-1]}{DIACRITICS[1:-1]}]"
    # ASCII is told by its length, the rest by a class of few ranges.
    other = (F.octet_length(text) != F.length(text)) & text.rlike(BEYOND)
    return F.lower(F.when(other, F.translate(F.regexp_replace(text, marks, ""), LETTERS_FROM, LETTERS_TO)).otherwise(text))


def terms(text: Column) -> Column:
    """Search terms in order: without stop words, Arabic ones without their prefix, two letters or more."""
    found = F.filter(F.regexp_extract_all(_cut_form(text), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(STOP))
    # Prefixes are looked for in terms from the first Arabic letter on, by the order of code points.
    return F.filter(F.transform(found, lambda t: F.when(t >= F.lit("ء"), stem(t)).otherwise(t)), lambda t: F.length(t) > 1)


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def html_text(rows: DataFrame, source: str, out: str, entities: dict[str, str] | None = None, spaces: str = SPACES) -> DataFrame:
    """rows with `out`, the text of HTML: tags become spaces, entities their characters, white space one space.

    Entities beyond the commonest ones go through Python, where a row has any.
    Where entities are given, these alone are resolved, one after the other.
    """
    plain = F.regexp_replace(F.col(source), "<[^>]*>", " ")
    if entities is not None:
        for name, value in entities.items():
            plain = F.replace(plain, F.lit(name), F.lit(value))
        return rows.withColumn(out, F.trim(F.regexp_replace(plain, spaces, " ")))
    for name, value in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")):
        plain = F.replace(plain, F.lit(name), F.lit(value))
    rows = rows.withColumn(out, plain)
    rest = F.coalesce(F.regexp_replace(out, "&amp;", " ").rlike("&(#[0-9xX]|[A-Za-z])"), F.lit(False))
    direct = rows.where(~rest).withColumn(out, F.replace(F.col(out), F.lit("&amp;"), F.lit("&")))
    both = direct.unionByName(rows.where(rest).withColumn(out, unescape(F.regexp_replace(source, "<[^>]*>", " "))))
    return both.withColumn(out, F.trim(F.regexp_replace(out, spaces, " ")))


def without_quotes(text: Column) -> Column:
    """A text without quotations, placeholders and references, unless fewer than three letters are left."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, r"﴿[^﴾]*﴾|«[^»]*»|\[\[[^\]]*\]\]|\[[^\]]{1,40}\]", " "), SPACES, " "))
    return F.when(F.regexp_count(rest, F.lit(r"\p{L}")) >= 3, rest).otherwise(text)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_sql(text: str) -> str:
    """norm() as DuckDB SQL."""
    plain = f"regexp_replace(regexp_replace({text}, '{INVISIBLE}', '', 'g'), '{DIACRITICS}', '', 'g')"
    return f"lower(trim(regexp_replace(translate({plain}, '{LETTERS_FROM}', '{LETTERS_TO}'), '{SPACES}', ' ', 'g')))"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({norm_sql(text)}, '{WORD}')"


def terms_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    found = f"list_filter(regexp_extract_all({norm_sql(text)}, '{TERM}'), lambda x: x NOT IN ({stop}))"
    return f"list_filter(list_transform({found}, lambda x: regexp_replace(x, '{ARABIC_PREFIX}', '\\2')), lambda x: length(x) > 1)"
