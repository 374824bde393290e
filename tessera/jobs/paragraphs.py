"""Drafts as paragraphs with their sources: documents are replies, embeddings the meaning of paragraphs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs.registry import query
from tessera.operators import checks, paragraphs
from tessera.sources import table, written

# What placeholders and cited ids may name.
_KNOWN = ["Q:2:1", "Q:2:2", "Q:2:3", "Q:2:4", "Q:2:5", "Q:3:1", "Q:3:2", "H:x", *[f"S:{n}" for n in range(6)]]
_LABEL = f"CASE WHEN list_contains({_KNOWN}, x) THEN '(' || x || ')' ELSE '{paragraphs.UNKNOWN}' END"


@query(rf"""WITH dr AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) || ' [[Q:2:' || (doc_id % 5 + 1) || ']] and [[H:x]]' || chr(10) || ' ' || chr(10) || 'Last [[Q:2:1]] [[Q:3:' || (doc_id % 4) || ']]' AS reply,
  ['S:' || (doc_id % 6), 'Q:2:1', 'S:' || (doc_id % 4), 'S:99'] AS cited FROM documents),
pa AS (SELECT doc_id, list_filter(list_transform(string_split_regex(reply, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM dr),
pe AS (SELECT doc_id, i - 1 AS place, ps[i] AS raw FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM pa)),
mk AS (SELECT doc_id, place, string_split_regex(raw, '{checks.PLACEHOLDER}') AS pieces, regexp_extract_all(raw, '{checks.PLACEHOLDER}', 1) AS ids FROM pe),
tx AS (SELECT doc_id, place, regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(list_transform(ids, lambda x: {_LABEL})[i], '')), ''),
  '{checks.RAW_GROUP}', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS text FROM mk),
us AS (SELECT doc_id, place, unnest(range(1, len(ids) + 1)) AS k, unnest(ids) AS id FROM mk),
fi AS (SELECT doc_id, id, arg_min(place, place * 100000 + k) AS place, arg_min(k, place * 100000 + k) AS k FROM us WHERE list_contains({_KNOWN}, id) GROUP BY ALL),
ct AS (SELECT doc_id, id, min(k) AS k FROM (SELECT doc_id, unnest(range(1, 5)) AS k, unnest(cited) AS id FROM dr) WHERE list_contains({_KNOWN}, id) GROUP BY ALL),
re AS (SELECT * FROM ct ANTI JOIN fi USING (doc_id, id)),
m AS (SELECT max(vec_id) + 1 AS m FROM embeddings),
sc AS (SELECT re.doc_id, re.id, re.k, pe.place, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM re CROSS JOIN m JOIN pe ON pe.doc_id = re.doc_id AND pe.place < 8
  JOIN embeddings a ON a.vec_id = (re.doc_id + substr(re.id, 3)::INT * 17) % m JOIN embeddings b ON b.vec_id = (pe.doc_id * 8 + pe.place) % m),
pl AS (SELECT doc_id, id, place, 0 AS late, k FROM fi UNION ALL SELECT doc_id, id, place, 1, k FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY score DESC, place) = 1),
so AS (SELECT doc_id, place, string_agg(id, ',' ORDER BY late, k) AS sources FROM pl GROUP BY ALL)
SELECT doc_id, 'p' || (place + 1) AS id, text, coalesce(sources, '') AS sources FROM tx LEFT JOIN so USING (doc_id, place) WHERE text <> ''""")
def draft_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """First uses of sources across paragraphs; what is cited besides goes to the paragraph nearest in meaning."""
    i = F.col("doc_id")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    reply = F.concat(text, F.format_string(" [[Q:2:%d]] and [[H:x]]\n \nLast [[Q:2:1]] [[Q:3:%d]]", i % 5 + 1, i % 4))
    cited = F.array(F.format_string("S:%d", i % 6), F.lit("Q:2:1"), F.format_string("S:%d", i % 4), F.lit("S:99"))
    drafts = written(table(spark, sf, "documents").select("doc_id", reply.alias("reply"), cited.alias("cited")), "drafts")
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    m = (vectors.agg(F.max("vec_id")).first()[0] or 0) + 1
    places = paragraphs.split_paragraphs(drafts, "doc_id", "reply").where("place < 8").select("doc_id", "place", ((i * 8 + F.col("place")) % m).alias("vec_id"))
    ids = drafts.select("doc_id", F.explode(F.array_distinct("cited")).alias("id")).where("id like 'S:%'").select("doc_id", "id", ((i + F.substring("id", 3, 9).cast("int") * 17) % m).alias("vec_id"))
    known = spark.createDataFrame([(x, f"({x})") for x in _KNOWN], "id string, label string")
    made = paragraphs.paragraphs(drafts, known, places.join(vectors, "vec_id"), ids.join(vectors, "vec_id"))
    return made.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.id", "p.text", F.array_join("p.sources", ",").alias("sources"))
