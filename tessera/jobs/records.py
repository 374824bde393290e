"""Queries that build records of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import SPACES, norm_sql
from tessera.jobs.registry import query
from tessera.operators import evaluation, records
from tessera.sources import place_for, table, written


@query("""WITH t AS (SELECT conv_id, turn, 'en' AS lang, 'T ' || text AS tr FROM conversations WHERE turn % 3 <> 0 UNION ALL SELECT conv_id, turn, 'fr', lower(text) FROM conversations WHERE turn % 2 = 0),
tp AS (SELECT user_id % 40 AS conv_id, event_id % 6 AS turn, event_type AS topic, 'of ' || (event_id % 3) AS parent FROM events),
n AS (SELECT conv_id, turn, list_sort(list_distinct(list_concat(list(topic), list(parent)))) AS topics FROM tp GROUP BY ALL)
SELECT c.conv_id, c.turn, c.text, coalesce((SELECT string_agg(lang || '=' || tr, '|' ORDER BY lang) FROM t WHERE t.conv_id = c.conv_id AND t.turn = c.turn), '') AS translations, coalesce(array_to_string(n.topics, '|'), '') AS topics
FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn""")
def nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations nested first, as the sources are, then taken apart again and joined to translations and topics."""
    rows = table(spark, sf, "conversations")
    parents = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    said = rows.where("turn % 3 <> 0").select("conv_id", "turn", F.lit("en").alias("lang"), F.concat(F.lit("T "), F.col("text")).alias("text"))
    said = said.unionByName(rows.where("turn % 2 = 0").select("conv_id", "turn", F.lit("fr").alias("lang"), F.lower("text").alias("text")))
    topics = table(spark, sf, "events").select((F.col("user_id") % 40).alias("conv_id"), (F.col("event_id") % 6).alias("turn"), F.col("event_type").alias("topic"), F.format_string("of %d", F.col("event_id") % 3).alias("parent"))
    got = records.nested_records(parents, said, topics, "conv_id", "turns", "turn")
    entries = F.transform(F.map_entries("translations"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return got.select("conv_id", "turn", "text", F.array_join(F.array_sort(entries), "|").alias("translations"), F.array_join("topics", "|").alias("topics"))


_KEEP = "(contains(o_orderpriority, 'HIGH') OR contains(o_orderpriority, 'MEDIUM'))"


@query(f"SELECT o_orderpriority AS grade, count(*) AS n FROM orders WHERE NOT {_KEEP} GROUP BY ALL UNION ALL SELECT 'kept', count(*) FROM orders WHERE {_KEEP}")
def grade_filter(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of each rejected grade there are, and how many rows are kept."""
    kept, rejected = records.kept_grades(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "grade"), "grade", ["HIGH", "MEDIUM"])
    return rejected.unionByName(kept.agg(F.lit("kept").alias("grade"), F.count("*").alias("n")))


@query("""SELECT 'QA:' || doc_id AS id, NULL::VARCHAR AS parent, 1 AS part, substr(text, 1, 80) AS text FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'QA:' || doc_id || ':' || (i + 1), 'QA:' || doc_id, (i + 1)::INT, p[i] FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))""")
def part_records(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    details = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return records.parts_of(docs.select("doc_id", F.substring("text", 1, 80).alias("text")), details, "doc_id")


@query("""WITH n AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice, l_shipdate) AS n FROM lineitem)
SELECT l_suppkey || ':' || l_linenumber || CASE WHEN n > 1 THEN ':' || n ELSE '' END AS id, l_orderkey FROM n""")
def numbered_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Several passages of a page are numbered from the second on."""
    rows = table(spark, sf, "lineitem").withColumn("place", F.struct("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"))
    return records.numbered(rows, "l_suppkey", "l_linenumber", "place").select("id", "l_orderkey")


@query("""WITH r AS (SELECT 'D:' || doc_id AS id, 'doc' AS type, text, lang FROM documents UNION ALL SELECT 'B:' || item_id, 'protected', text, NULL FROM benchmark UNION ALL SELECT 'C:' || conv_id || ':' || turn, 'message', text, NULL FROM conversations)
SELECT type, count(*) AS records, count(DISTINCT id) AS ids, count(lang) AS with_lang, sum(length(text))::BIGINT AS chars FROM r GROUP BY type""")
def record_union(spark: SparkSession, sf: str) -> DataFrame:
    """The records of three kinds in one table; what a kind lacks is null."""
    docs = table(spark, sf, "documents").select(F.format_string("D:%d", "doc_id").alias("id"), F.lit("doc").alias("type"), "text", "lang")
    bench = table(spark, sf, "benchmark").select(F.format_string("B:%d", "item_id").alias("id"), F.lit("protected").alias("type"), "text")
    chat = table(spark, sf, "conversations").select(F.format_string("C:%d:%d", "conv_id", "turn").alias("id"), F.lit("message").alias("type"), "text")
    every = docs.unionByName(bench, allowMissingColumns=True).unionByName(chat, allowMissingColumns=True)
    # Ids are counted before they are told apart, so that a kind is no task's alone.
    per = every.groupBy("type", "id").agg(F.count("*").alias("n"), F.count("lang").alias("langs"), F.sum(F.length("text")).alias("chars"))
    return per.groupBy("type").agg(F.sum("n").alias("records"), F.count("*").alias("ids"), F.sum("langs").alias("with_lang"), F.sum("chars").alias("chars"))


_KIND = "CASE WHEN lang = 'en' THEN 'verse' ELSE 'other' END"


@query(f"""WITH d AS (SELECT doc_id, {_KIND} AS kind, source AS title, text, lower(text) AS english, [source, lang] AS topics FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN kind <> 'verse' THEN nullif(trim(title), '') END, nullif(trim(text), ''), CASE WHEN kind = 'verse' THEN nullif(trim(english), '') END, CASE WHEN kind = 'verse' THEN nullif(trim(array_to_string(topics, ', ')), '') END)) AS embed,
md5(CASE WHEN kind = 'verse' THEN text || chr(10) || coalesce(english, '') ELSE substr(text, 1, 1500) END) AS rerank FROM d""")
def record_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of records that are embedded, and that a scorer reads."""
    docs = table(spark, sf, "documents").where("lang is not null and source is not null")
    kind, english = F.when(F.col("lang") == "en", "verse").otherwise("other"), F.lower("text")
    embedded = records.embed_text(kind, F.col("source"), F.col("text"), english, F.array("source", "lang"))
    return docs.select("doc_id", F.md5(embedded).alias("embed"), F.md5(records.rerank_text(kind, F.col("text"), english)).alias("rerank"))


@query(rf"""SELECT page_id, md5(regexp_replace(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{SPACES}', ' ', 'g')), '{records.NOTE_MARK}', '', 'g'), '{records.LEADING}', '')), '[ \t\n]+([,.;:!?،۔])', '\1', 'g')) AS translation,
md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(html, chr(13), chr(10)), '<[^>]+>', '', 'g'), '\(?¬[0-9٠-٩*]*\)?|\[¬\*?\]', '', 'g'), '{records.LIGATURE}', '{records.SPELT}'), '\n{{2,}}', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')) AS page FROM pages""")
def page_cleanups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(records.clean_translation(F.col("html"))).alias("translation"), F.md5(records.clean_page(F.col("html"))).alias("page"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || ('D:' || doc_id)::BLOB) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point FROM h""")
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", records.name_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.format_string("D:%d", "doc_id")).alias("point"))


@query("""WITH a AS (SELECT c_custkey, i - 1 AS pos, 'n' || ((c_custkey * i) % 90) AS name FROM customer, range(1, 7) r(i)),
e AS (SELECT 'n' || (p_partkey % 80) AS name, CASE WHEN p_size % 3 = 0 THEN p_brand END AS en FROM part),
m AS (SELECT a.c_custkey, a.name, e.en, row_number() OVER (PARTITION BY c_custkey ORDER BY e.en IS NULL, pos, a.name, e.en) AS rn FROM a JOIN e USING (name) WHERE pos < 4)
SELECT c_custkey, name, en FROM m WHERE rn = 1""")
def best_alternate(spark: SparkSession, sf: str) -> DataFrame:
    names = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("n"), ((F.col("c_custkey") * i) % 90).cast("string")))
    rows = table(spark, sf, "customer").select("c_custkey", names.alias("names"))
    entries = table(spark, sf, "part").select(F.format_string("n%d", F.col("p_partkey") % 80).alias("name"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("en"))
    return records.best_alternate(rows, entries, "c_custkey", "names")


_GLOSSARY = r"""
gl AS (SELECT p_partkey AS term, p_partkey % 3 = 0 AS official, unnest(list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(replace(replace(lower(n), '‘', chr(39)), '’', chr(39)), '[/،,()]'), lambda p: trim(p)), lambda p: length(p) >= 4), lambda p: trim(regexp_replace(p, '[^\p{L}\p{N}'']+', ' ', 'g'))), lambda p: length(p) > 1))) AS name
       FROM (SELECT p_partkey, (SELECT lower(w[1 + p_partkey % len(w)] || ' ' || w[1 + (p_partkey + 1) % len(w)] || ', ' || w[1 + (p_partkey * 7) % len(w)] || ', ' || array_to_string(w[1 + p_partkey % 5:6 + p_partkey % 5], ' ')) FROM (SELECT string_split(text, ' ') AS w FROM benchmark WHERE item_id = p_partkey % 40)) AS n FROM part WHERE p_partkey % 5 = 0))
"""


@query(rf"""WITH {_GLOSSARY}, w AS (SELECT doc_id, regexp_extract_all({norm_sql("coalesce(text, '')")}, '[\p{{L}}\p{{N}}'']+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)], list_transform(range(1, len(w) - 4 + 2), lambda i: array_to_string(w[i:i + 4 - 1], ' ')), list_transform(range(1, len(w) - 5 + 2), lambda i: array_to_string(w[i:i + 5 - 1], ' ')), list_transform(range(1, len(w) - 6 + 2), lambda i: array_to_string(w[i:i + 6 - 1], ' '))))) AS name FROM w),
m AS (SELECT doc_id, term, max(official) AS official FROM g JOIN gl USING (name) GROUP BY ALL)
SELECT doc_id, term, rank::INT AS rank FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY official DESC, term) AS rank FROM m) WHERE rank <= 15""")
def glossary_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of one, two and six words, made of the protected texts."""
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.split("text", " ").alias("w"))
    parts = table(spark, sf, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("term"), (F.col("p_partkey") % 40).alias("item"))
    word = lambda k: F.get("w", (k % F.size("w")).cast("int"))
    name = F.concat(word(F.col("term")), F.lit(" "), word(F.col("term") + 1), F.lit(", "), word(F.col("term") * 7), F.lit(", "), F.array_join(F.slice("w", (F.col("term") % 5 + 1).cast("int"), 6), " "))
    terms = written(parts.join(bench, "item").select("term", F.lit(None).cast("string").alias("ar"), name.alias("en"), (F.col("term") % 3 == 0).alias("official")), "glossary")
    return records.glossary_terms(table(spark, sf, "documents"), terms)


@query("""WITH l AS (SELECT l_suppkey, list(l_quantity::BIGINT % 12 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS n FROM lineitem GROUP BY l_suppkey),
t AS (SELECT l_suppkey, len(n) AS every, list_reduce(list_transform(n, lambda x: [x]), lambda s, x: CASE WHEN x[1] = len(s) + 1 THEN list_concat(s, x) ELSE s END, []::BIGINT[]) AS s FROM l)
SELECT l_suppkey, len(s)::INT AS accepted, (every - len(s))::INT AS noise FROM t""")
def contents_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that follow each other in a supplier's lines are accepted, others are noise."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("place"), (F.col("l_quantity").cast("long") % 12).alias("n"))
    return records.in_sequence(rows, "l_suppkey", "place", "n")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations""")
def section_carry(spark: SparkSession, sf: str) -> DataFrame:
    """For each message what the user asked last."""
    return records.carried(table(spark, sf, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("text"))).select("conv_id", "turn", "section")


@query("SELECT event_type, count(*) AS n, round(sum(value::DECIMAL(38,6))::DOUBLE, 2) AS total FROM events WHERE event_id % 17 <> 0 GROUP BY event_type")
def log_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A log of JSON lines, some cut short, is written by appending and read again; lines that are no JSON are skipped."""
    events = table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("line"))
    place = place_for(spark, "log")
    lines = events.select(F.when(F.col("event_id") % 17 == 0, F.expr("substring(line, 1, length(line) - 5)")).otherwise(F.col("line")).alias("value"))
    lines.write.mode("append").text(place)
    read = spark.read.schema("event_id long, event_type string, value double").option("mode", "DROPMALFORMED").json(place)
    return read.where("event_id is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(38,6)")).cast("double"), 2).alias("total"))


_CHECKS = """
ck AS (SELECT e.event_id, e.event_type AS level, e.value AS latency, CASE WHEN e.event_id % 3 <> 0 THEN e.value > 20 END AS status, CASE WHEN e.event_id % 4 <> 0 THEN e.user_id % 5 > 0 END AS cited, e.event_id % 7 <> 3 AS lang FROM events e)
"""


@query(f"""WITH {_CHECKS}, p AS (SELECT *, coalesce(status, true) AND coalesce(cited, true) AND lang AS passed FROM ck),
q AS (SELECT level, latency, row_number() OVER (PARTITION BY level ORDER BY latency) AS rn, count(*) OVER (PARTITION BY level) AS n FROM ck WHERE latency IS NOT NULL)
SELECT p.level, count(*) AS cases, sum(passed::INT)::BIGINT AS passed, round(avg(latency), 6) AS mean_latency,
printf('cited=%.3f/%d,lang=%.3f/%d,status=%.3f/%d', avg(cited::INT), count(cited), avg(lang::INT), count(lang), avg(status::INT), count(status)) AS rates,
(SELECT latency FROM q WHERE q.level = p.level AND rn = greatest(1, round_even(0.9 * n, 0))) AS p90_latency FROM p GROUP BY p.level""")
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Cases pass if all checks that apply do; a check's rate is over the cases it applies to."""
    e = table(spark, sf, "events")
    status, cited = F.when(F.col("event_id") % 3 != 0, F.col("value") > 20), F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 5 > 0)
    checks = F.create_map(F.lit("status"), status, F.lit("cited"), cited, F.lit("lang"), F.col("event_id") % 7 != 3)
    return evaluation.roll_up(e.select(F.col("event_type").alias("level"), F.col("value").alias("latency"), checks.alias("checks")), "level", "checks", "latency")


@query("""WITH t AS (SELECT event_id % 50 AS case_id, list_sort(list_distinct(list(event_type))) AS has FROM events WHERE event_id % 3 > 0 GROUP BY ALL)
SELECT c_custkey, array_to_string(list_sort(list_filter(['click', 'error', 'view'], lambda x: NOT list_contains(coalesce(has, []), x))), ',') AS unmet FROM customer LEFT JOIN t ON case_id = c_custkey % 60""")
def unmet_requires(spark: SparkSession, sf: str) -> DataFrame:
    """What a case requires and isn't available."""
    has = table(spark, sf, "events").where("event_id % 3 > 0").groupBy((F.col("event_id") % 50).alias("case_id")).agg(F.collect_set("event_type").alias("has"))
    asked = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 60).alias("case_id"), F.array(*[F.lit(x) for x in ("click", "error", "view")]).alias("requires"))
    met = asked.join(has, "case_id", "left")
    return met.select("c_custkey", F.array_join(F.array_sort(F.array_except("requires", F.coalesce("has", F.array().cast("array<string>")))), ",").alias("unmet"))


_ASCII = "regexp_replace(coalesce(text, ''), '[^ -%''-~]', ' ', 'g')"
_TIDY = lambda x: f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{SPACES}', ' ', 'g'))"


@query(rf"""WITH t AS (SELECT doc_id, {_ASCII} AS a FROM documents),
r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN a WHEN 1 THEN (doc_id % 50) || '. <i>' || a || '</i> [' || (doc_id % 9) || '] , so*' ELSE a || '<BR> ______ <br/>[1] <b>note</b>  ' || doc_id END AS raw FROM t),
p AS (SELECT doc_id, string_split_regex(raw, '{records.NOTES}') AS p FROM r)
SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace({_TIDY('p[1]')}, '{records.NOTE_MARK}', '', 'g'), '{records.LEADING}', '')), '[ \t\n]+([,.;:!?،۔])', '\1', 'g') AS text, {_TIDY("array_to_string(nullif(p[2:], []), ' ')")} AS notes FROM p""")
def translation_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Foot-notes apart from translations, both without marks."""
    a, k, i = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -%'-~]", " "), F.col("doc_id") % 3, F.col("doc_id")
    raw = F.when(k == 0, a).when(k == 1, F.concat((i % 50).cast("string"), F.lit(". <i>"), a, F.lit("</i> ["), (i % 9).cast("string"), F.lit("] , so*")))
    raw = raw.otherwise(F.concat(a, F.lit("<BR> ______ <br/>[1] <b>note</b>  "), i.cast("string")))
    return records.translations(table(spark, sf, "documents").select("doc_id", raw.alias("raw")))
