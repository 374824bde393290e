"""Queries of sources: nested answers, labelled results, a cache by content, files and their digests, a table of latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import SPACES
from tessera.jobs.registry import query
from tessera.operators import labelled, nested
from tessera.sources import files, place_for, table
from tessera.sources.keyed import ContentCache
from tessera.streaming import stream_latest

_TEXT = "coalesce(text, '')"


@query(f"""WITH RECURSIVE an AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{{"core": {{"question": ' || to_json({_TEXT})::VARCHAR || ', "extra": {{"lang": "' || coalesce(lang, 'none') || '", "level": ' || (doc_id % 5) || '}}}}, "level": 99, "other": 1}}'
   WHEN 1 THEN '{{"question": ' || to_json({_TEXT})::VARCHAR || ', "meta": {{"deep": {{"lang": "hidden"}}}}, "level": ' || (doc_id % 7) || '}}' WHEN 2 THEN '{{"level": 3, "a": {{"level": 4, "lang": "in a"}}, "b": {{"lang": "in b", "question": ' || to_json({_TEXT})::VARCHAR || '}}}}' ELSE 'no answer ' || {_TEXT} END AS j FROM documents),
lv AS (SELECT doc_id, []::BIGINT[] AS path, j::JSON AS m FROM an WHERE json_valid(j)
  UNION ALL SELECT doc_id, list_append(path, i), json_extract(m, '$."' || k[i] || '"') FROM (SELECT doc_id, path, m, json_keys(m) AS k, unnest(range(1, len(json_keys(m)) + 1)) AS i FROM lv)
  WHERE json_type(m, '$."' || k[i] || '"') = 'OBJECT' AND list_has_any(json_keys(m, '$."' || k[i] || '"'), ['question', 'lang', 'level'])),
lf AS (SELECT doc_id, list_append(path, i) AS path, k[i] AS field, json_extract_string(m, '$."' || k[i] || '"') AS value FROM (SELECT doc_id, path, m, json_keys(m) AS k, unnest(range(1, len(json_keys(m)) + 1)) AS i FROM lv)
  WHERE k[i] IN ('question', 'lang', 'level') AND NOT (json_type(m, '$."' || k[i] || '"') = 'OBJECT' AND list_has_any(json_keys(m, '$."' || k[i] || '"'), ['question', 'lang', 'level'])))
SELECT doc_id, field, arg_min(value, path) AS value FROM lf GROUP BY ALL""")
def lifted_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of answers that were nested too deep; the first in reading order counts."""
    docs, k = table(spark, sf, "documents"), F.col("doc_id") % 4
    text, lang = F.coalesce("text", F.lit("")).alias("question"), F.coalesce("lang", F.lit("none")).alias("lang")
    first = F.to_json(F.struct(F.struct(text, F.struct(lang, (F.col("doc_id") % 5).alias("level")).alias("extra")).alias("core"), F.lit(99).alias("level"), F.lit(1).alias("other")))
    second = F.to_json(F.struct(text, F.struct(F.struct(F.lit("hidden").alias("lang")).alias("deep")).alias("meta"), (F.col("doc_id") % 7).alias("level")))
    third = F.to_json(F.struct(F.lit(3).alias("level"), F.struct(F.lit(4).alias("level"), F.lit("in a").alias("lang")).alias("a"), F.struct(F.lit("in b").alias("lang"), text).alias("b")))
    answer = F.when(k == 0, first).when(k == 1, second).when(k == 2, third).otherwise(F.concat(F.lit("no answer "), F.coalesce("text", F.lit(""))))
    return nested.lifted_fields(docs.select("doc_id", answer.alias("answer")), ["question", "lang", "level"])


_GRADES = ["صحيح", "ضعيف", "إسناده صحيح", "لا يصح", ""]
_SOURCES = ["صحيح البخاري", "سنن", "صحيح مسلم"]
_PLAIN_TEXT = "translate(coalesce(text, ''), '<>&', '   ')"
_HTML = f"""
pg AS (SELECT doc_id, '<p>x</p><div id="a" class="hadith">' || doc_id || ' - <b>' || {_PLAIN_TEXT} || '</b></div> <div class="hadith-info"><span>الراوي :</span> of ' || (doc_id % 9) || ' <span>المصدر:</span> ' || {_SOURCES}[1 + doc_id % 3] || ' | <span>الصفحة أو الرقم :</span> ' || doc_id
  || CASE WHEN doc_id % 2 = 0 THEN '<span>خلاصة حكم المحدث : </span>' || {_GRADES}[1 + doc_id % 5] ELSE '' END || '</div><div class="hadith"> <i></i></div><div class="hadith">2 - again ' || doc_id || '</div>' AS html FROM documents)"""


def _plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '{SPACES}', ' ', 'g'))"


@query(f"""WITH {_HTML},
pr AS (SELECT doc_id, i - 2 AS pos, p[i] AS part FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT doc_id, string_split_regex(html, '{labelled.RESULT}') AS p FROM pg))),
ct AS (SELECT doc_id, pos, {_plain("string_split(string_split(part, '" + labelled.INFO + "')[1], '</div>')[1]")} AS t, {_plain("CASE WHEN contains(part, '" + labelled.INFO + "') THEN substr(part, instr(part, '" + labelled.INFO + "') + " + str(len(labelled.INFO)) + ") ELSE '' END")} AS info FROM pr),
rs AS (SELECT doc_id, pos::INT AS pos, regexp_replace(t, '{labelled.NUMBERED}', '') AS text, {', '.join(f"regexp_replace(regexp_extract(info, '{labelled.field_pattern(label)}', 1), '^[ \\-|]+|[ \\-|]+$', '', 'g') AS {name}" for name, label in labelled.FIELDS.items())} FROM ct)
SELECT *, NOT regexp_matches(grade, '{labelled.NEGATIVE}') AND (source IN ('صحيح البخاري', 'صحيح مسلم') OR contains(grade, 'صحيح')) AS authentic FROM rs WHERE text <> ''""")
def labelled_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of HTML answers with their labelled fields."""
    i = F.col("doc_id")
    of = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (i % n).cast("int"))
    graded = F.when(i % 2 == 0, F.concat(F.lit("<span>خلاصة حكم المحدث : </span>"), of(_GRADES, 5))).otherwise(F.lit(""))
    html = F.concat(
        F.lit('<p>x</p><div id="a" class="hadith">'), i.cast("string"), F.lit(" - <b>"), F.translate(F.coalesce("text", F.lit("")), "<>&", "   "), F.lit('</b></div> <div class="hadith-info"><span>الراوي :</span> of '),
        (i % 9).cast("string"), F.lit(" <span>المصدر:</span> "), of(_SOURCES, 3), F.lit(" | <span>الصفحة أو الرقم :</span> "), i.cast("string"), graded,
        F.lit('</div><div class="hadith"> <i></i></div><div class="hadith">2 - again '), i.cast("string"), F.lit("</div>"),
    )
    return labelled.results(table(spark, sf, "documents").select("doc_id", html.alias("html")), "doc_id")


@query("""WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS shard, text FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(DISTINCT text) FILTER (doc_id % 2 = 0) AS first_run, count(DISTINCT text) AS all_runs FROM d)
SELECT shard, count(*) AS n_rows, count(DISTINCT text) AS keys, sum(length(text))::BIGINT AS total, (SELECT first_run FROM n) AS first_run, (SELECT all_runs - first_run FROM n) AS second_run, 0::BIGINT AS third_run FROM d GROUP BY shard""")
def content_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A second run computes only what is new, and a third nothing; the rewritten shards hold the keys in use."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.coalesce("lang", F.lit("none")).alias("shard"), "text")
    cache = ContentCache(spark, place_for(spark, "cache"), "length", "bigint")
    compute = lambda rows: rows.select("key", F.length("text").cast("long").alias("value"))
    runs = [cache.fill(rows, compute) for rows in (docs.where("doc_id % 2 = 0"), docs, docs)]
    cache.compact(docs)
    per = cache.values(docs).groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"))
    kept = cache.stored().groupBy("shard").agg(F.count("*").alias("keys"))
    return per.join(kept, "shard").select("shard", "n_rows", "keys", "total", *[F.lit(n).cast("long").alias(name) for n, name in zip(runs, ("first_run", "second_run", "third_run"), strict=True)])


@query("""WITH f AS (SELECT conv_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
m AS (SELECT 'conv_id=' || conv_id AS path, CASE WHEN conv_id % 7 = 0 THEN 'changed' ELSE sha256(body) END AS expected FROM f WHERE conv_id % 11 <> 0 UNION ALL SELECT 'conv_id=none', 'absent'),
g AS (SELECT 'conv_id=' || conv_id AS path, octet_length(encode(body)) AS bytes, sha256(body) AS sha256 FROM f)
SELECT path, bytes, sha256, expected, CASE WHEN expected IS NULL THEN 'unlisted' WHEN sha256 IS NULL THEN 'missing' WHEN sha256 = expected THEN 'ok' ELSE 'mismatch' END AS status FROM g FULL JOIN m USING (path)""")
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation written to a file of its own, read back as bytes and held against a manifest with faults."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    place = place_for(spark, "texts")
    rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", F.col("text").alias("value")).write.partitionBy("conv_id").text(place)
    found = files.digests(spark, place, "*.txt").withColumn("path", F.substring_index("path", "/", 1))
    body = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), F.lit("\n"))
    listed = rows.groupBy("conv_id").agg(body.alias("body")).where("conv_id % 11 <> 0")
    manifest = listed.select(F.format_string("conv_id=%d", "conv_id").alias("path"), F.when(F.col("conv_id") % 7 == 0, "changed").otherwise(F.sha2("body", 256)).alias("sha256"))
    return files.verified(found, manifest.unionByName(spark.range(1).select(F.lit("conv_id=none").alias("path"), F.lit("absent").alias("sha256"))))


query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")(stream_latest)
