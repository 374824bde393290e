"""Known fields found at any depth of JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import written

_MAP = "map<string,string>"
#: Answers nested deeper than this are an error, not silently cut.
DEEPEST = 64


def lifted_fields(rows: DataFrame, fields: list[str], key: str = "doc_id", json: str = "answer") -> DataFrame:
    """(key, field, value): the known fields of each JSON object, as JSON texts, wherever they are.

    An object in an object that has a known field itself is looked into, not taken;
    of a field that is found several times the first in reading order counts.
    Objects are taken apart level by level, all rows at once.  What is no JSON object
    has no fields.
    """
    known = lambda m: F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(f) for f in fields]))
    level = rows.select(key, F.array().cast("array<int>").alias("path"), F.from_json(F.col(json), _MAP).alias("m")).where("m is not null")
    found = None
    for _ in range(DEEPEST):
        each = level.select(key, "path", F.posexplode(F.map_entries("m")).alias("at", "e"))
        each = each.select(key, F.concat("path", F.array("at")).alias("path"), F.col("e.key").alias("field"), F.col("e.value").alias("value"), F.when(F.ltrim("e.value").startswith("{"), F.from_json("e.value", _MAP)).alias("m"))
        each = written(each.withColumn("inside", F.coalesce(F.col("m").isNotNull() & known(F.col("m")), F.lit(False))), "level")
        own = each.where(~F.col("inside") & F.col("field").isin(fields)).select(key, "field", "path", "value")
        found = own if found is None else found.unionByName(own)
        level = each.where("inside").select(key, "path", "m")
        if level.isEmpty():
            return found.groupBy(key, "field").agg(F.min_by("value", "path").alias("value"))
    raise ValueError(f"answers nested deeper than {DEEPEST}")
