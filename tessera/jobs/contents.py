"""Contents of books: documents are entries, dealt to books by their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.jobs.registry import query
from tessera.operators import contents
from tessera.sources import table

# Each document gives a line with its number in the book (all of it or its last digit, with or without a page), and a second line: a tail, a stray number, a heading.
_LINES = r"""
en AS (SELECT doc_id, doc_id % 40 AS book, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS n, replace(left(regexp_replace(coalesce(text, ''), '[^\p{L} ]+', ' ', 'g'), 60), chr(10), ' ') AS t FROM documents),
li AS (SELECT book, doc_id * 2 AS pos, CASE doc_id % 4 WHEN 0 THEN n || '( ' || t || ' ..... ' || (doc_id % 700) WHEN 1 THEN (n % 10) || '( -' || t WHEN 2 THEN (doc_id % 700) || ' .... ' || t || ' -' || n || '(' ELSE n || '(-): ' || t END AS text FROM en
       UNION ALL SELECT book, doc_id * 2 + 1, CASE doc_id % 5 WHEN 0 THEN 'more ﴿' || left(t, 9) || '﴾ ..... ' || (doc_id % 700) WHEN 1 THEN (n + 7) || '( stray ' || n WHEN 2 THEN 'فهرس ' || n WHEN 3 THEN NULL ELSE 'and so on' END FROM en)
"""


@query(rf"""WITH RECURSIVE {_LINES},
ls AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) AS i, regexp_replace(text, '\.{{3,}}', ' ', 'g') AS x FROM li WHERE text IS NOT NULL AND NOT contains(text, 'فهرس') AND trim(text) NOT IN ('المسألة الصفحة', 'الصفحة المسألة')),
st AS (SELECT DISTINCT book, 0::BIGINT AS i, 0::BIGINT AS expected, NULL::VARCHAR AS mark, false AS page FROM ls
  UNION ALL SELECT book, i, expected + CASE WHEN mark IS NULL THEN 0 ELSE 1 END, mark, mark IS NOT NULL AND regexp_matches(replace(x, mark, ' '), '(^|\s)[0-9]{{1,4}}(\s|$)')
  FROM (SELECT s.book, l.i, s.expected, l.x, list_filter(regexp_extract_all(l.x, '[0-9]{{1,3}}\('), lambda m: ends_with((s.expected + 1)::VARCHAR, replace(m, '(', '')))[1] AS mark FROM st s JOIN ls l ON l.book = s.book AND l.i = s.i + 1)),
ev AS (SELECT st.book, st.i, expected, mark, page, x, lead(mark) OVER w AS next_mark, lead(x) OVER w AS next_x FROM st JOIN ls USING (book, i) WINDOW w AS (PARTITION BY st.book ORDER BY st.i)),
tt AS (SELECT book, expected AS number, regexp_replace(regexp_replace(replace(x, mark, ' '), '^\s*[0-9]{{1,4}}\s+|\s+[0-9]{{1,4}}\s*$', ' ', 'g'), '-?\)\s*:?|^\s*[-:]\s*', ' ', 'g')
       || CASE WHEN NOT page AND next_mark IS NULL THEN ' ' || regexp_replace(next_x, '(^|\s)[0-9]{{1,4}}(\s|$)', ' ', 'g') ELSE '' END AS t FROM ev WHERE mark IS NOT NULL AND (page OR next_x IS NOT NULL))
SELECT book, number, regexp_replace(trim(regexp_replace(translate(t, '﴿﴾', '  '), '\s+', ' ', 'g')), '^[ \-.:]+|[ \-.:]+$', '', 'g') AS title FROM tt""")
def contents_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Torn numbers, stray ones, titles that run over lines."""
    docs = table(spark, sf, "documents")
    plain = F.replace(F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L} ]+", " "), 1, 60), F.lit("\n"), F.lit(" "))
    own = docs.select("doc_id", (F.col("doc_id") % 40).alias("book"), plain.alias("t")).withColumn("n", F.row_number().over(W.partitionBy("book").orderBy("doc_id")))
    page, n = (F.col("doc_id") % 700).cast("string"), F.col("n").cast("string")
    kind, second = F.col("doc_id") % 4, F.col("doc_id") % 5
    first = F.when(kind == 0, F.concat(n, F.lit("( "), "t", F.lit(" ..... "), page)).when(kind == 1, F.concat((F.col("n") % 10).cast("string"), F.lit("( -"), "t"))
    first = first.when(kind == 2, F.concat(page, F.lit(" .... "), "t", F.lit(" -"), n, F.lit("("))).otherwise(F.concat(n, F.lit("(-): "), "t"))
    more = F.when(second == 0, F.concat(F.lit("more ﴿"), F.substring("t", 1, 9), F.lit("﴾ ..... "), page)).when(second == 1, F.concat((F.col("n") + 7).cast("string"), F.lit("( stray "), n))
    more = more.when(second == 2, F.concat(F.lit("فهرس "), n)).when(second == 4, F.lit("and so on"))
    lines = own.select("book", F.posexplode(F.array(first, more)).alias("k", "text"), (F.col("doc_id") * 2).alias("pos"))
    return contents.contents(lines.select("book", (F.col("pos") + F.col("k")).alias("pos"), "text"))
