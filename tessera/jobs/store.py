"""Queries of the verbatim store: conversations are its keys, turns its places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs.registry import query
from tessera.operators import intervals, store
from tessera.sources import table, written

_STORE = """
so AS (SELECT conv_id % 130 + 1 AS key, (conv_id // 130) * 20 + turn + 1 AS place, text FROM conversations),
st AS (SELECT key, place, min(text) AS text FROM so WHERE text IS NOT NULL GROUP BY ALL),
tr AS (SELECT key, place, CASE WHEN key % 2 = 0 THEN 'fr' ELSE 'en' END AS lang, 'T ' || text AS tr FROM st WHERE place % 7 <> 0),
li AS (SELECT l_orderkey % 140 AS k, l_linenumber % 9 AS a, l_linenumber % 9 + l_suppkey % 5 AS b, l_partkey % 4 AS f FROM lineitem),
rf AS (SELECT DISTINCT CASE f WHEN 0 THEN 'Q:' || k || ':' || a WHEN 1 THEN 'Q:' || k || ':' || b || '-' || a WHEN 2 THEN ' Q:' || k || ':' || a || '-' || b ELSE 'H:' || k END AS ref,
       CASE WHEN k % 3 = 0 THEN 'ar' WHEN k % 3 = 1 THEN 'fr-CA' ELSE 'id' END AS lang FROM li),
rp AS (SELECT ref, lang, regexp_extract(trim(ref), '^Q:([0-9]{1,3}):([0-9]{1,3})(?:-([0-9]{1,3}))?$', ['k', 'a', 'b']) AS p FROM rf),
rr AS (SELECT ref, lang, try_cast(p.k AS INT) AS k, try_cast(p.a AS INT) AS lo, coalesce(try_cast(nullif(p.b, '') AS INT), try_cast(p.a AS INT)) AS hi FROM rp),
ok AS (SELECT * FROM rr WHERE k BETWEEN 1 AND 114 AND lo >= 1 AND hi >= lo)
"""  # fmt: skip


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "conversations").where("text is not null")
    rows = rows.select((F.col("conv_id") % 130 + 1).cast("int").alias("key"), (F.floor(F.col("conv_id") / 130) * 20 + F.col("turn") + 1).cast("int").alias("place"), "text")
    first = rows.groupBy("key", "place").agg(F.min("text").alias("text"))
    translated = first.where("place % 7 <> 0").select("key", "place", F.when(F.col("key") % 2 == 0, "fr").otherwise("en").alias("lang"), F.concat(F.lit("T "), F.col("text")).alias("text"))
    return rows, translated


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    """References of all forms, also malformed ones, of which most occur many times."""
    line = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 140).alias("k"), (F.col("l_linenumber") % 9).alias("a"), (F.col("l_linenumber") % 9 + F.col("l_suppkey") % 5).alias("b"), (F.col("l_partkey") % 4).alias("f"))
    form = F.when(F.col("f") == 0, F.format_string("Q:%d:%d", "k", "a")).when(F.col("f") == 1, F.format_string("Q:%d:%d-%d", "k", "b", "a")).when(F.col("f") == 2, F.format_string(" Q:%d:%d-%d", "k", "a", "b"))
    lang = F.when(F.col("k") % 3 == 0, "ar").when(F.col("k") % 3 == 1, "fr-CA").otherwise("id")
    return line.select(F.coalesce(form, F.format_string("H:%d", "k")).alias("ref"), lang.alias("lang"))


@query(f"WITH {_STORE} SELECT ref, lang, k AS key, lo, hi FROM ok")
def ref_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _refs(spark, sf).distinct().withColumn("r", store.parse_ref(F.col("ref"))).where("r is not null").select("ref", "lang", "r.*")


_MARK = "('۝' || translate(s.place::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩'))"
_LOOKUP = f"""{_STORE},
sp AS (SELECT ref, lang, k, lo, hi, CASE WHEN lang = 'ar' THEN NULL WHEN lang = 'fr-CA' THEN 'fr' ELSE 'en' END AS tl, unnest(range(lo, hi + 1)) AS place FROM ok),
lk AS (SELECT sp.ref, sp.lang, sp.k AS key, lo, hi, count(*) AS n, count(t.tr) AS nt,
       CASE WHEN lo = hi THEN min(s.text) ELSE string_agg(s.text || ' ' || {_MARK}, ' ' ORDER BY s.place) END AS text,
       CASE WHEN lo = hi THEN min(t.tr) ELSE string_agg('(' || s.place || ') ' || t.tr, ' ' ORDER BY s.place) END AS translation
       FROM sp JOIN st s ON s.key = sp.k AND s.place = sp.place LEFT JOIN tr t ON t.key = sp.k AND t.place = sp.place AND t.lang = sp.tl GROUP BY sp.ref, sp.lang, sp.k, lo, hi)
"""


@query(f"WITH {_LOOKUP} SELECT ref, lang, key, lo, hi, text, CASE WHEN nt = n THEN translation END AS translation, 'https://quranpedia.net/surah/1/' || key || '/' || lo AS url FROM lk WHERE n = hi - lo + 1")
def verbatim_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Whole ranges with their marks; a translation only where every place has one, English where a language has none."""
    return store.lookup(_refs(spark, sf), *_store(spark, sf), ["en", "fr"])


@query(f"WITH {_STORE} SELECT ref, lang, k AS key, lo, hi FROM ok WHERE hi - lo + 1 > (SELECT count(*) FROM st WHERE key = k AND place BETWEEN lo AND hi)")
def range_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    """References that are well formed but have a place missing."""
    asked = ref_parse(spark, sf)
    return asked.join(store.lookup(asked.select("ref", "lang"), *_store(spark, sf), ["en", "fr"]).select("ref", "lang"), ["ref", "lang"], "left_anti")


@query(f"""WITH {_STORE} SELECT ref, lang, CASE WHEN trim(ref) LIKE 'Q:%' THEN 'verse' WHEN trim(ref) LIKE 'H:hadeethenc:%' THEN 'hadith' WHEN trim(ref) LIKE 'H:%' THEN 'cached' END AS kind,
coalesce(CASE lang WHEN 'id' THEN 'QS ' END, 'Q ') || k || ':' || lo || CASE WHEN hi <> lo THEN '-' || hi ELSE '' END AS label FROM rr""")
def ref_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Which store a reference belongs to, and what readers call it; malformed numbers give no label."""
    refs = _refs(spark, sf).distinct()
    part = lambda k: F.nullif(F.regexp_extract(F.trim("ref"), store.REFERENCE, k), F.lit("")).cast("int")
    return refs.select("ref", "lang", store.kind(F.col("ref")).alias("kind"), store.label(part(1), part(2), F.coalesce(part(3), part(2)), F.col("lang")).alias("label"))


@query("""WITH c AS (SELECT o_orderkey, 'H:hadeethenc:' || (o_custkey % 400) AS ref, CASE o_orderkey % 4 WHEN 0 THEN 'ar' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'ur' END AS lang FROM orders),
h AS (SELECT doc_id, text, source AS grade, lang FROM documents WHERE doc_id < 400 AND text IS NOT NULL)
SELECT DISTINCT c.ref, c.lang, h.text, h.grade, CASE WHEN c.lang = h.lang AND c.lang <> 'ar' THEN sha1(h.text) END AS translation,
'https://h.example/' || CASE WHEN c.lang = h.lang AND c.lang <> 'ar' THEN c.lang ELSE 'ar' END || '/' || h.doc_id AS url
FROM c JOIN h ON c.ref = 'H:hadeethenc:' || h.doc_id""")
def hadith_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Translations are JSON by language."""
    docs = table(spark, sf, "documents").where("doc_id < 400 and text is not null")
    own = F.to_json(F.create_map(F.coalesce("lang", F.lit("none")), F.struct(F.sha1("text").alias("hadeeth"))))
    held = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("grade"), own.alias("translations"), F.format_string("https://h.example/ar/%d", "doc_id").alias("url"))
    k = F.col("o_orderkey") % 4
    refs = table(spark, sf, "orders").select(F.format_string("H:hadeethenc:%d", F.col("o_custkey") % 400).alias("ref"), F.when(k == 0, "ar").when(k == 1, "en").when(k == 2, "fr").otherwise("ur").alias("lang"))
    return store.hadith(refs, held)


# Messages cite what the store's keys are called: names of nations stand in for them.
_CITING = """
nm AS (SELECT translate(lower(n_name), '0123456789_', 'abcdefghij ') AS name, n_nationkey + 1 AS number FROM nation),
tx AS (SELECT o.o_orderkey AS doc_id, 'see [' || a.name || ': ' || (o.o_orderkey % 12) || '] and (' || b.name || ':٣-' || (o.o_custkey % 9) || '), [' || a.name || ': ' || (o.o_orderkey % 12) || ']' AS text
       FROM orders o JOIN nm a ON a.number = o.o_custkey % 25 + 1 JOIN nm b ON b.number = o.o_orderkey % 25 + 1)
"""


@query(f"""WITH {_STORE}, {_CITING},
fd AS (SELECT doc_id, unnest(regexp_extract_all(text, '{store.CITED}', 1)) AS name, translate(unnest(regexp_extract_all(text, '{store.CITED}', 2)), '٠١٢٣٤٥٦٧٨٩', '0123456789') AS a, translate(unnest(regexp_extract_all(text, '{store.CITED}', 3)), '٠١٢٣٤٥٦٧٨٩', '0123456789') AS b,
       unnest(range(0, len(regexp_extract_all(text, '{store.CITED}', 1)))) AS pos FROM tx),
fr AS (SELECT doc_id, pos, number, 'Q:' || number || ':' || a || CASE WHEN b <> '' THEN '-' || b ELSE '' END AS ref, a::INT AS lo, coalesce(nullif(b, ''), a)::INT AS hi FROM fd JOIN nm ON nm.name = trim(fd.name))
SELECT doc_id, min(pos)::INT AS pos, ref FROM fr WHERE lo >= 1 AND hi >= lo AND hi - lo < 40 AND hi - lo + 1 = (SELECT count(DISTINCT place) FROM so WHERE so.key = number AND place BETWEEN lo AND hi AND so.text IS NOT NULL) GROUP BY doc_id, ref""")
def cited_refs(spark: SparkSession, sf: str) -> DataFrame:
    return store.cited(_citing(spark, sf), _names(spark, sf), _store(spark, sf)[0])


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.translate(F.lower("n_name"), "0123456789_", "abcdefghij ").alias("name"), (F.col("n_nationkey") + 1).alias("number"))


def _citing(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda k: F.broadcast(_names(spark, sf).select(F.col("name").alias(f"name_{k}"), F.col("number").cast("long").alias(f"key_{k}")))
    orders = table(spark, sf, "orders").withColumn("key_a", F.col("o_custkey") % 25 + 1).withColumn("key_b", F.col("o_orderkey") % 25 + 1)
    own = F.concat(F.lit("["), F.col("name_a"), F.lit(": "), (F.col("o_orderkey") % 12).cast("string"), F.lit("]"))
    text = F.concat(F.lit("see "), own, F.lit(" and ("), F.col("name_b"), F.lit(":٣-"), (F.col("o_custkey") % 9).cast("string"), F.lit("), "), own)
    return orders.join(named("a"), "key_a").join(named("b"), "key_b").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


@query("""WITH ci AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE l_partkey % 3 WHEN 0 THEN 'D:' || l_partkey WHEN 1 THEN 'B:' || (l_suppkey % 60) ELSE 'Q:' || l_suppkey END AS id FROM lineitem),
f AS (SELECT doc_id, id, min(pos) AS pos FROM ci GROUP BY ALL),
k AS (SELECT 'D:' || doc_id AS id, 0 AS n, source FROM documents UNION ALL SELECT 'B:' || item_id, 1, 'benchmark' FROM benchmark UNION ALL SELECT 'D:' || doc_id, 2, 'labels' FROM labels)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS rank, f.id, o.source, o.n IS NOT NULL AS resolved
FROM (SELECT doc_id, id, pos FROM f) f LEFT JOIN (SELECT id, min(n) AS n, arg_min(source, n) AS source FROM k GROUP BY id) o ON o.id = f.id""".replace("ORDER BY pos)", "ORDER BY pos, f.id)"))
def citation_list(spark: SparkSession, sf: str) -> DataFrame:
    """Cited ids, each once and in order, resolved in three stores."""
    line, of = table(spark, sf, "lineitem"), F.col("l_partkey") % 3
    id_ = F.when(of == 0, F.format_string("D:%d", "l_partkey")).when(of == 1, F.format_string("B:%d", F.col("l_suppkey") % 60)).otherwise(F.format_string("Q:%d", "l_suppkey"))
    cites = line.select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", id_.alias("id")).alias("pos"), id_.alias("id"))
    docs = table(spark, sf, "documents").select(F.format_string("D:%d", "doc_id").alias("id"), "source")
    bench = table(spark, sf, "benchmark").select(F.format_string("B:%d", "item_id").alias("id"), F.lit("benchmark").alias("source"))
    marked = table(spark, sf, "labels").select(F.format_string("D:%d", "doc_id").alias("id"), F.lit("labels").alias("source"))
    return store.citations(cites, docs, bench, marked)


@query(f"""WITH {_LOOKUP}, bl AS (SELECT DISTINCT trim(ref) AS ref, '﴿' || text || '﴾ [' || key || ']' AS block FROM lk WHERE n = hi - lo + 1 AND lang = 'fr-CA'),
dr AS (SELECT o_orderkey AS doc_id, 'Q:' || (o_custkey % 140) || ':' || (o_orderkey % 5 + 1) AS a, 'Q:' || (o_orderkey % 120) || ':2-3' AS b FROM orders)
SELECT doc_id, 'As [[x said: ' || coalesce(x.block, '[[' || a || ']]') || ' and ' || coalesce(y.block, '[[' || b || ']]') || '.' AS text, ((x.block IS NULL)::INT + (y.block IS NULL)::INT)::BIGINT AS missing
FROM dr LEFT JOIN bl x ON x.ref = a LEFT JOIN bl y ON y.ref = b""")
def rendered_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Placeholders give way to the exact text of the store."""
    held = store.lookup(_refs(spark, sf), *_store(spark, sf), ["en", "fr"]).where("lang = 'fr-CA'")
    block = F.concat(F.lit("﴿"), F.col("text"), F.lit("﴾ ["), F.col("key").cast("string"), F.lit("]"))
    blocks = written(held.select(F.trim("ref").alias("ref"), block.alias("block")).distinct(), "blocks")
    draft = F.format_string("As [[x said: [[Q:%d:%d]] and [[Q:%d:2-3]].", F.col("o_custkey") % 140, F.col("o_orderkey") % 5 + 1, F.col("o_orderkey") % 120)
    return store.render(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), draft.alias("text")), blocks)


@query("""WITH f AS (SELECT DISTINCT 'Q:' || (l_orderkey % 50) || ':' || l_linenumber || CASE WHEN l_partkey % 2 = 0 THEN '-' || (l_linenumber + l_suppkey % CASE WHEN l_partkey % 20 = 0 THEN 97 ELSE 3 END) ELSE '' END AS id, l_orderkey % 50 AS key, l_linenumber AS lo, l_linenumber + CASE WHEN l_partkey % 2 = 0 THEN l_suppkey % CASE WHEN l_partkey % 20 = 0 THEN 97 ELSE 3 END ELSE 0 END AS hi FROM lineitem
  UNION SELECT 'QA:s:' || (o_custkey % 30) || CASE WHEN o_orderkey % 2 = 0 THEN ':' || (o_orderkey % 7) ELSE '' END, NULL, NULL, NULL FROM orders),
e AS (SELECT * FROM f WHERE (key % 7 = 0 AND lo % 2 = 0) OR (key IS NULL AND length(id) < 8))
SELECT DISTINCT f.id AS found, e.id AS expected FROM f, e WHERE f.id = e.id OR (starts_with(e.id, 'QA:') AND starts_with(f.id, e.id || ':')) OR (f.key = e.key AND f.lo <= e.hi AND e.lo <= f.hi)""")
def id_match(spark: SparkSession, sf: str) -> DataFrame:
    """Found and expected ids that agree: equal, a part of it, or ranges that overlap."""
    line = table(spark, sf, "lineitem")
    more = F.when(F.col("l_partkey") % 20 == 0, F.col("l_suppkey") % 97).when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 3).otherwise(F.lit(0))
    tail = F.when(F.col("l_partkey") % 2 == 0, F.format_string("-%d", F.col("l_linenumber") + more)).otherwise(F.lit(""))
    ranges = line.select(F.concat(F.format_string("Q:%d:%d", F.col("l_orderkey") % 50, F.col("l_linenumber")), tail).alias("id"), (F.col("l_orderkey") % 50).alias("key"), F.col("l_linenumber").cast("long").alias("lo"), (F.col("l_linenumber") + more).cast("long").alias("hi"))
    part = F.when(F.col("o_orderkey") % 2 == 0, F.format_string(":%d", F.col("o_orderkey") % 7)).otherwise(F.lit(""))
    none = F.lit(None).cast("long")
    paths = table(spark, sf, "orders").select(F.concat(F.format_string("QA:s:%d", F.col("o_custkey") % 30), part).alias("id"), none.alias("key"), none.alias("lo"), none.alias("hi"))
    found = written(ranges.unionByName(paths).distinct(), "ids")
    return intervals.matches(found, found.where("(key % 7 = 0 and lo % 2 = 0) or (key is null and length(id) < 8)"))
