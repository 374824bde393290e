"""Queries of language profiles, learned from documents that have a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import SPACES
from tessera.jobs.registry import query
from tessera.operators import profiles
from tessera.sources import table


def _words(text: str) -> str:
    return rf"list_transform(regexp_extract_all(lower({text}), '\p{{L}}+'), lambda x: '_' || left(x, {profiles.LONGEST_WORD}) || '_')"


_GRAMS = "list_filter(flatten([" + ", ".join(f"list_transform(range(1, length(word) - {n} + 2), lambda i: substr(word, i::BIGINT, {n}))" for n in profiles.ORDERS) + "]), lambda g: g <> '_')"
_PROFILES = f"""
lw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_words("coalesce(text, '')")}) AS word FROM documents WHERE lang IS NOT NULL) GROUP BY ALL),
lg AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, n, unnest({_GRAMS}) AS gram FROM lw) GROUP BY ALL),
pf AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank FROM lg QUALIFY rank <= {profiles.SIZE})
"""


@query(f"WITH {_PROFILES} SELECT lang, gram, rank::INT AS rank FROM pf")
def language_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest letter n-grams of each language, in order."""
    return profiles.learn(table(spark, sf, "documents"))


_REST = r"trim(regexp_replace(regexp_replace(t, '﴿[^﴾]*﴾|«[^»]*»|\[\[[^\]]*\]\]|\[[^\]]{1,40}\]', ' ', 'g'), '" + SPACES + "', ' ', 'g'))"
_LETTERS = r"length(regexp_replace({}, '[^\p{{L}}]', '', 'g'))"
_PROBABILITIES = f"""{_PROFILES},
mt AS (SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS t FROM conversations),
mq AS (SELECT doc_id, CASE WHEN {_LETTERS.format(_REST)} >= 3 THEN {_REST} ELSE t END AS plain FROM mt),
mw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_words('plain')}) AS word FROM mq) GROUP BY ALL),
mg AS (SELECT doc_id, gram, sum(n) AS n FROM (SELECT doc_id, n, unnest({_GRAMS}) AS gram FROM mw) GROUP BY ALL),
mr AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM mg QUALIFY rank <= {profiles.SIZE}),
ms AS (SELECT doc_id, count(*) AS size FROM mr GROUP BY ALL),
sv AS (SELECT doc_id, lang, sum({profiles.SIZE} - least(abs(mr.rank - pf.rank), {profiles.SIZE})) AS saved FROM mr JOIN pf USING (gram) GROUP BY ALL),
nr AS (SELECT ms.doc_id, l.lang, round(coalesce(saved, 0) / (size * {profiles.SIZE}), 9) AS near FROM ms, (SELECT DISTINCT lang FROM pf) l LEFT JOIN sv ON sv.doc_id = ms.doc_id AND sv.lang = l.lang),
we AS (SELECT *, exp({profiles.SHARPNESS} * (near - max(near) OVER (PARTITION BY doc_id))) AS weight FROM nr),
pb AS (SELECT doc_id, lang, round(weight / sum(weight) OVER (PARTITION BY doc_id), 6) AS prob FROM we),
tp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, lang) AS place, lang, prob FROM pb QUALIFY place <= {profiles.TOP})
"""


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


@query(f"WITH {_PROBABILITIES} SELECT doc_id, place::INT AS place, lang, prob FROM tp")
def language_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The most likely languages of each message."""
    return profiles.probabilities(_messages(spark, sf), language_profiles(spark, sf))


_ENGLISH = ", ".join(f"'{w}'" for w in profiles.ENGLISH)
_GROUP = " ".join(f"WHEN list_contains({group}, a.lang) THEN (SELECT sum(prob) FROM tp WHERE tp.doc_id = mq.doc_id AND list_contains({group}, tp.lang))" for group in profiles.GROUPS)


@query(f"""WITH {_PROBABILITIES},
ew AS (SELECT doc_id, plain, regexp_extract_all(lower(plain), '[a-z'']+') AS w, length(regexp_replace(plain, '[^A-Za-z]', '', 'g')) AS latin, {_LETTERS.format('plain')} AS letters FROM mq),
en AS (SELECT doc_id, CASE WHEN letters > 0 AND latin >= {profiles.LEAST_LATIN} * letters AND len(w) >= {profiles.LEAST_WORDS} THEN len(list_filter(w, lambda x: x IN ({_ENGLISH}))) / len(w) END AS english FROM ew),
fd AS (SELECT mq.doc_id, a.lang, a.prob, english, coalesce(CASE {_GROUP} END, 0) AS of_group FROM mq LEFT JOIN tp a ON a.doc_id = mq.doc_id AND a.place = 1 JOIN en ON en.doc_id = mq.doc_id)
SELECT doc_id, CASE WHEN lang <> 'en' AND english >= {profiles.LEAST_ENGLISH} THEN 'en' ELSE coalesce(lang, 'en') END AS lang,
CASE WHEN lang IS NULL THEN 0 WHEN lang <> 'en' AND english >= {profiles.LEAST_ENGLISH} THEN round(greatest(prob, english), 3) WHEN round(prob, 3) < {profiles.LEAST_SURE} THEN round(greatest(prob, of_group), 3) ELSE round(prob, 3) END::DOUBLE AS prob FROM fd""")
def language_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles, unless enough of a Latin text's words are English."""
    return profiles.detect(_messages(spark, sf), language_profiles(spark, sf))
