"""Checks of drafted texts and choices by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# Forms of placeholders and ids, characters that no reply has, limits of Latin text, phrases and groups of languages.
PLACEHOLDER = r"\[\[[ \t\n]*((?:Q|H):[^\] \t\n]+)[ \t\n]*\]\]"
RAW_ID = r"\[{1,2}[ \t\n]*(?:GL|SH|QA|BK|Q|H):[^\]]*\]{1,2}"
RAW_GROUP = r"[ \t\n]*\([ \t\n]*(?:\[{1,2}[^\]]*\]{1,2}[ \t\n,،;]*)+\)|[ \t\n]*\[{1,2}[ \t\n]*(?:GL|SH|QA|BK):[^\]]*\]{1,2}"
IGNORED = r"\[\[[^\]]*\]\]|https?://[^ \t\n]+|[A-Z]{1,3}:[A-Za-z0-9_:.-]+"
FOREIGN = r"[\x{400}-\x{4ff}\x{e00}-\x{e7f}\x{900}-\x{97f}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
GLUED = r"[\x{621}-\x{64a}\x{671}-\x{6d3}]+[A-Za-z]+|[A-Za-z]+[\x{621}-\x{64a}\x{671}-\x{6d3}]+"
LATIN_WORD = "[A-Za-z][A-Za-z'’-]+"
LATIN_RUN = r"""[A-Za-z][A-Za-z'’-]*(?:[ \t\n.…,;:!?"'()-]+[A-Za-z][A-Za-z'’-]*)+"""
LATIN_LIMITS = {"ar": (2, 3), "fa": (3, 6), "ur": (3, 6)}
BOILERPLATE = [
    "يثير البعض", "يوضح أهل العلم", "يُوضح أهل العلم", "بين أهل العلم", "ذكر أهل العلم", "قرر أهل العلم", "ومما ينبغي التنبيه عليه",
    "تجدر الإشارة إلى", "والجواب عن هذه الشبهة", "الجواب عن ذلك من وجوه", "scholars have explained", "scholars explain that",
    "it should be noted", "it is worth noting", "some people raise questions", "the answer to this doubt", "in conclusion,",
]
CERTAINTY = [
    "all muslims agree", "all scholars agree", "there is consensus", "there is a consensus", "unanimously agreed", "every scholar", "no scholar disagrees",
    "أجمع المسلمون", "أجمع العلماء", "بإجماع العلماء", "بالإجماع", "لا خلاف بين العلماء", "باتفاق جميع العلماء",
]
BRACKETS = "[﴿﴾]"
SAME_LANGUAGE = [["ur", "fa", "pnb"], ["id", "ms"], ["ar", "arz", "ary"]]


def placeholders(text: Column) -> Column:
    """The ids of a text's placeholders, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLACEHOLDER), F.lit(1))


def strip_placeholders(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), PLACEHOLDER, " ")


def raw_ids(text: Column) -> Column:
    """Ids in brackets that aren't placeholders."""
    return F.regexp_extract_all(strip_placeholders(text), F.lit(RAW_ID), F.lit(0))


def tidy(text: Column) -> Column:
    """A text without stray ids, blanks at the end of lines and more than one blank line."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), RAW_GROUP, ""), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(plain, "\n{3,}", "\n\n"), "^[ \t\r\n]+|[ \t\r\n]+$", "")


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """The phrases that a text holds, in the order given."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, F.lower(p)))


def garbled(text: Column, lang: Column, allowed: Column) -> Column:
    """What is wrong with a text's letters: foreign, glued, latin_run, latin_total, or null.

    Limits of Latin text hold for replies in Arabic script; words in `allowed`, an
    array in lower case, don't count.
    """
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, " ")
    told = lambda t: F.size(F.filter(F.regexp_extract_all(t, F.lit(LATIN_WORD), F.lit(0)), lambda w: ~F.array_contains(F.coalesce(allowed, F.array().cast("array<string>")), F.lower(w))))
    limit = lambda k: F.coalesce(*[F.when(lang == name, F.lit(both[k])) for name, both in LATIN_LIMITS.items()])
    run = F.exists(F.regexp_extract_all(clean, F.lit(LATIN_RUN), F.lit(0)), lambda r: told(r) >= limit(0))
    return F.when(clean.rlike(FOREIGN), "foreign").when(clean.rlike(GLUED), "glued").when(limit(0).isNull(), None).when(run, "latin_run").when(told(clean) >= limit(1), "latin_total")


def same_language(a: Column, b: Column) -> Column:
    """Equal, or of one group of languages that are taken for each other."""
    alike = a == b
    for group in SAME_LANGUAGE:
        alike = alike | (a.isin(group) & b.isin(group))
    return alike


def covered(id_: Column, allowed: Column) -> Column:
    """An id is among allowed ones, or is a range inside one of them; allowed is an array of struct(id, key, lo, hi)."""
    part = lambda k: F.nullif(F.regexp_extract(id_, r"^Q:([0-9]+):([0-9]+)(?:-([0-9]+))?$", k), F.lit("")).cast("int")
    key, lo, hi = part(1), part(2), F.coalesce(part(3), part(2))
    inside = lambda o: (o["key"] == key) & (o["lo"] <= lo) & (hi <= o["hi"]) & (lo <= hi)
    return F.exists(allowed, lambda o: F.coalesce((o["id"] == id_) | inside(o), o["id"] == id_))


def allowed_ids(ids: Column) -> Column:
    """An array of ids as covered() takes it."""
    part = lambda x, k: F.nullif(F.regexp_extract(x, r"^Q:([0-9]+):([0-9]+)(?:-([0-9]+))?$", k), F.lit("")).cast("int")
    return F.transform(ids, lambda x: F.struct(x.alias("id"), part(x, 1).alias("key"), part(x, 2).alias("lo"), F.coalesce(part(x, 3), part(x, 2)).alias("hi")))


def draft_issues(drafts: DataFrame) -> DataFrame:
    """drafts with `issues`, the rules that each breaks, an array in a fixed order.

    drafts has reply, lang, level, evidence and cited (arrays of ids), points
    (array of struct(meaning, sources)), detected (the language told from the
    reply, or null), latin (allowed Latin words) and copied (the longest run of
    words that it shares with an explanation).  A column glossary, the ids of terms
    that were given to the draft, may be cited too, but isn't in placeholders.
    """
    allowed = allowed_ids(F.coalesce("evidence", F.array().cast("array<string>")))
    known = lambda x: covered(x, F.col("__allowed"))
    marks, plain = placeholders(F.col("reply")), strip_placeholders(F.col("reply"))
    sources = lambda p: F.coalesce(p["sources"], F.array().cast("array<string>"))
    points = F.coalesce("points", F.expr("cast(array() as array<struct<meaning:string,sources:array<string>>>)"))
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    terms = F.coalesce("glossary", F.array().cast("array<string>")) if "glossary" in drafts.columns else F.array().cast("array<string>")
    rules = {
        "placeholder": F.exists(marks, lambda x: ~known(x)),
        "cited_id": F.exists(cited, lambda x: ~known(x) & ~F.array_contains(terms, x)),
        "no_citation": (F.size(cited) == 0) & (F.size(marks) == 0),
        "brackets": plain.rlike(BRACKETS),
        "raw_id": F.size(raw_ids(F.col("reply"))) > 0,
        "garbled": garbled(F.col("reply"), F.col("lang"), F.col("latin")).isNotNull(),
        "point_without_source": F.exists(points, lambda p: F.size(sources(p)) == 0),
        "point_source": F.exists(points, lambda p: F.exists(sources(p), lambda x: ~known(x))),
        "no_points": (F.size("__allowed") > 0) & (F.size(points) == 0),
        "language": F.col("detected").isNotNull() & ~same_language(F.col("detected"), F.col("lang")),
        "copied": F.coalesce("copied", F.lit(0)) >= 8,
        "certainty": F.col("level").isin("C", "D") & (F.size(phrases_in(F.col("reply"), CERTAINTY)) > 0),
    }
    listed = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return drafts.withColumn("__allowed", allowed).withColumn("issues", listed).drop("__allowed")


def verdict(issues: Column, style: Column, attempts: Column, most: int = 2) -> Column:
    """retry while attempts are left and the draft breaks a rule or sounds like a book, else fail or pass."""
    broken, bookish = F.size(issues) > 0, F.size(style) > 0
    return F.when((broken | bookish) & (attempts < most), "retry").when(broken, "fail").otherwise("pass")


def pick(table: dict[str, str], lang: Column, default: str = "en") -> Column:
    """struct(value, exact): the entry of a language's first part, else the default's."""
    head = F.substring(F.split(F.replace(F.lower(lang), F.lit("_"), F.lit("-")), "-")[0], 1, 3)
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    own = F.try_element_at(entries, F.coalesce(head, F.lit("")))
    return F.struct(F.coalesce(own, F.lit(table[default])).alias("value"), own.isNotNull().alias("exact"))


def merge_pinned(ranked: DataFrame, pinned: DataFrame, score: float = 1.0) -> DataFrame:
    """(query, doc, score, pinned): ranked rows, and those pinned ones that they lack with a score of their own."""
    more = pinned.select("query", "doc").distinct().join(ranked.select("query", "doc"), ["query", "doc"], "left_anti")
    return ranked.select("query", "doc", "score", F.lit(False).alias("pinned")).unionByName(more.select("query", "doc", F.lit(score).alias("score"), F.lit(True).alias("pinned")))
