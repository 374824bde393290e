"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Each input partition hashes its normalised texts, sorts the distinct
   fingerprints and sends each owner (a range of the hash space) its slice,
   Golomb coded: some 3 bytes a text, instead of the text.
2. An owner decodes what all partitions sent and answers each of them with a
   bitmap of the fingerprints that others have as well.
3. Only the suspects' texts are read again, brought together and compared
   byte by byte.  Equal texts are combined before that shuffle, so a text
   that a third of all rows hold crosses it once a partition.  What was found
   of a text goes back to its rows by a join in which such texts are split.

Defined results: a null text counts as the empty text, which is a text like
any other; equal rows (same id too) are copies of which one stays; a null
doc_id sorts before all others; an empty table gives an empty table; columns
besides doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, documents, materialise, salted_join, shuffle_partitions
from tessera.llm.golomb import owner_of, pack_by_owner, repeated_bitmaps, unpack

#: Deleted before texts are compared.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
WHITE_PATTERN = r"[\x20\x09-\x0D]"
#: Fingerprints of so many bits: at 1e11 texts under 1 % are suspected wrongly, and cleared by the bytes.
FINGERPRINT_BITS = 44

_SENT = "kind int, pid long, owner long, pos int, rid long, doc_id long, n_chars long, row_key long, sha binary, local boolean, blob binary"


def _sender(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        ids, chars, keys, shas = [], [], [], []
        for batch in batches:
            ids.append(batch.column(0))
            chars.append(batch.column(1))
            keys.append(batch.column(2))
            shas += [hashlib.sha256((raw or b"").translate(None, WHITE)).digest() for raw in batch.column(3).to_pylist()]
        n = len(shas)
        if not n:
            return
        head = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64) >> np.uint64(64 - FINGERPRINT_BITS)
        values, place, count = np.unique(head, return_inverse=True, return_counts=True)
        owner = owner_of(values, FINGERPRINT_BITS, owners)
        first = np.searchsorted(owner, owner)  # where the owner's slice starts
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.zeros(n, np.int32)),
                pa.array(np.full(n, pid, np.int64)),
                pa.array(owner[place]),
                pa.array((place - first[place]).astype(np.int32)),
                pa.array((np.int64(pid) << 33) + np.arange(n, dtype=np.int64)),
                pa.concat_arrays(ids).cast(pa.int64()),
                pa.concat_arrays(chars).cast(pa.int64()),
                pa.concat_arrays(keys),
                pa.array(shas, pa.binary()),
                pa.array(count[place] > 1),
                pa.nulls(n, pa.binary()),
            ],
            names=[c.split()[0] for c in _SENT.split(", ")],
        )
        sent = pack_by_owner(values, FINGERPRINT_BITS, owners)
        k = len(sent)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(k, np.int32)),
                pa.array(np.full(k, pid, np.int64)),
                pa.array([s[0] for s in sent], pa.int64()),
                *(pa.nulls(k, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())),
                pa.array([s[3] for s in sent], pa.binary()),
            ],
            names=[c.split()[0] for c in _SENT.split(", ")],
        )

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"pid": pdf["pid"], "owner": pdf["owner"], "bits": repeated_bitmaps([unpack(b) for b in pdf["blob"]])})


def _bit(bits: str, pos: str) -> Column:
    """Bit pos of a binary column, the highest of its first byte being bit 0."""
    return F.expr(f"(cast(conv(hex(substring({bits}, cast({pos} div 8 as int) + 1, 1)), 16, 10) as int) & shiftright(128, {pos} % 8)) > 0")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: rid (unique), doc_id, n_chars, row_key (xxhash64 of the text), keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    owners = shuffle_partitions(spark)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.xxhash64(F.col(text_col)).alias("row_key"), text.cast("binary").alias("raw"))
    sent = materialise(thin.mapInArrow(_sender(owners), _SENT), "fingerprints", "kind")
    answers = sent.where("kind = 1").select("pid", "owner", "blob").groupBy("owner").applyInPandas(_answer, "pid long, owner long, bits binary")
    rows = sent.where("kind = 0").drop("kind", "blob")
    marked = materialise(
        rows.join(answers, ["pid", "owner"]).select("rid", "doc_id", "n_chars", "row_key", "sha", (F.col("local") | _bit("bits", "pos")).alias("suspect")), "suspects"
    )
    alone = marked.where("not suspect").select("rid", "doc_id", "n_chars", "row_key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")

    suspects = marked.where("suspect").drop("suspect")
    wanted = broadcast_if_small(suspects.select(F.col("doc_id").alias("wanted")).distinct(), 16)
    equal = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
        .groupBy(F.regexp_replace("text", WHITE_PATTERN, "").alias("norm"))
        .agg(F.count("*").alias("group_size"))
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    )
    # Of the rows of a text the longest original, then the smallest id, then the first row.
    best = suspects.groupBy("sha").agg(F.min(F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").alias("id"), F.col("rid").alias("best"))).alias("b"), F.count("*").alias("n"))
    groups = best.join(equal, "sha").select(
        "sha", F.col("b.id").alias("keep_id"), F.col("b.best").alias("best"), F.when(F.col("n") == F.col("group_size"), F.col("n")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).alias("group_size")
    )
    groups = materialise(groups, "groups")
    met = salted_join(suspects, groups, "sha", "rid", groups.withColumnRenamed("group_size", "n")).select("rid", "doc_id", "n_chars", "row_key", "keep_id", "group_size", (F.col("rid") == F.col("best")).alias("kept"), "sha")
    return alone.unionByName(met).select("rid", "doc_id", "n_chars", "row_key", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS rn
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256
FROM r
"""
