"""Resampling towards a target distribution by hashed word n-grams.

A document is put in order once: its words in lower case with one space between
them.  The running CRC-32 is stored at both ends of every word.  CRC-32 is linear
over GF(2): the checksum of any run of words is the checksum up to its end, with
the one up to its start cancelled after moving it over the run's bytes, which is
a product with the power of a bit matrix; tables of the powers of two move whole
arrays at once.  Thus each n-gram is one exclusive or, and no n-gram is ever made
as a string.

The buckets of all documents and of the target are counted in each task and
summed by Spark; what reaches the driver is one number a bucket.  Gains of
buckets are broadcast, BUCKETS numbers.  The draw without replacement is by
Gumbel noise made from the id: the best scores are drawn, and ranks come from a
distributed sort, numbered by offsets of its partitions.

Defined results: a null or empty text, or one without words, has no features and
weight 0 and is not drawn; a null id counts as an empty string in the noise and
comes before others in ties; rows that agree in id and text draw alike, each for
itself; without target or documents gains are 0; an empty table gives an empty
table; columns besides those named are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words that are taken together, which bounds what a very long text needs.
_BLOCK = 1 << 17
_POLYNOMIAL = 0xEDB88320
#: Moves over 2**k zero bytes for k below this; longer runs of words are not to be had in a block.
_MOVES = 31


def _moves() -> np.ndarray:
    """(k, byte, value): what bits of a checksum become when it is moved over 2**k zero bytes, by the byte they are in."""

    def over(images: list[int], value: int) -> int:
        out = 0
        for bit in range(32):
            if value >> bit & 1:
                out ^= images[bit]
        return out

    images = [1 << bit for bit in range(32)]
    for _ in range(8):  # one byte is eight steps of one bit
        images = [(v >> 1) ^ (_POLYNOMIAL if v & 1 else 0) for v in images]
    tables = np.zeros((_MOVES, 4, 256), np.uint32)
    for k in range(_MOVES):
        for byte in range(4):
            for bit in range(8):
                tables[k, byte, 1 << bit : 2 << bit] = tables[k, byte, : 1 << bit] ^ np.uint32(images[8 * byte + bit])
        images = [over(images, v) for v in images]
    return tables


def move(checksums: np.ndarray, over: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each checksum moved over as many zero bytes as `over` says."""
    out = checksums.astype(np.uint32)
    for k in range(int(over.max()).bit_length() if len(over) else 0):
        at = np.flatnonzero(over >> k & 1)
        v, t = out[at], tables[k]
        out[at] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return out


def prefix_checksums(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(checksum up to each word's start, up to its end, bytes of each word) of the words with a space between."""
    starts, ends, crc, crc32 = [], [], 0, zlib.crc32
    for word in words:
        starts.append(crc)
        crc = crc32(word, crc)
        ends.append(crc)
        crc = crc32(b" ", crc)
    return np.array(starts, np.uint32), np.array(ends, np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def ngram_checksums(words: list[bytes], longest: int, tables: np.ndarray) -> Iterator[np.ndarray]:
    """The CRC-32 of every run of 1 to longest words, one array for each length."""
    starts, ends, size = prefix_checksums(words)
    after = np.cumsum(size + 1)  # the byte after each word and its space
    for n in range(1, min(longest, len(words)) + 1):
        own = after[n - 1 :] - 1 - (after[: len(words) - n + 1] - 1 - size[: len(words) - n + 1])
        yield ends[n - 1 :] ^ move(starts[: len(words) - n + 1], own, tables)


def buckets(raw: bytes, tables: np.ndarray, longest: int = LONGEST, modulus: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the n-grams that end in them) for each block of a text."""
    kept: list[bytes] = []
    words: list[bytes] = []

    def block() -> tuple[int, np.ndarray]:
        own = kept + words
        # A run that ends among the words kept from the block before was counted there.
        parts = [c[max(0, len(kept) - n + 1) :] for n, c in enumerate(ngram_checksums(own, longest, tables), 1)]
        return len(words), np.concatenate(parts).astype(np.int64) % modulus

    for m in _WORD.finditer(raw.lower()):
        words.append(m[0])
        if len(words) == _BLOCK:
            yield block()
            kept, words = (kept + words)[-(longest - 1) :] if longest > 1 else [], []
    if words:
        yield block()


def _counter(longest: int, modulus: int):
    tables = _moves()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(modulus, np.int64)
        for batch in batches:
            held, waiting = [], 0
            for raw in batch.column(0).to_pylist():
                for _, own in buckets(raw or b"", tables, longest, modulus):
                    held.append(own)
                    waiting += len(own)
                    if waiting > _BLOCK:
                        total += np.bincount(np.concatenate(held), minlength=modulus)
                        held, waiting = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=modulus)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, modulus: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds."""
    counted = texts.select(F.col(text_col).cast("binary").alias("raw")).mapInArrow(_counter(longest, modulus), "bucket int, n long")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(modulus, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier a bucket is in the target, rounded down."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigher(gains, longest: int):
    tables = _moves()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gains.value
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                words = features = total = 0
                for new, own in buckets(raw or b"", tables, longest, len(table)):
                    words, features, total = words + new, features + len(own), total + int(table[own].sum())
                rows.append((words, features, total // features if features else 0))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns]], names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def weighed(docs: DataFrame, target: DataFrame, longest: int = LONGEST, modulus: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document: the mean gain of its features, rounded down."""
    gains = gains_of(bucket_counts(docs, text_col, longest, modulus), bucket_counts(target, text_col, longest, modulus))
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(_weigher(shared, longest), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, modulus: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the rank is null where it isn't drawn."""
    rows = weighed(docs, target, longest, modulus)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    rows = materialise(rows.select("doc_id", "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("may")), "scores")
    drawn = percent * rows.where("may").count() // 100
    best = rows.orderBy(F.desc("may"), F.desc("score"), "doc_id").withColumn("at", F.monotonically_increasing_id())
    # The number has the partition in its upper bits and the place in it in the lower 33.
    best = materialise(best.select("doc_id", "n_features", "weight", "score", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "sorted")
    before, total = [], 0
    for part, n in sorted(map(tuple, best.groupBy("part").agg(F.count("*")).collect())):  # one number a partition
        before.append((part, total))
        total += n
    offsets = docs.sparkSession.createDataFrame(before, "part int, before long")
    ranked = best.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = f"""
WITH steps AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, {_POLYNOMIAL}) ELSE c // 2 END, x::BIGINT)) AS t),
texts AS (SELECT 'd' AS kind, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
worded AS (SELECT kind, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
grams AS (
    SELECT kind, k, unnest(w) AS g FROM worded
    UNION ALL SELECT kind, k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) > 1),
summed AS (
    SELECT g, xor(list_reduce(list_transform(range(octet_length(encode(g))), lambda i: ('0x' || hex(encode(g))[2 * i + 1:2 * i + 2])::BIGINT),
                              lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS b
    FROM (SELECT DISTINCT g FROM grams), steps),
placed AS (SELECT kind, k, b FROM grams JOIN summed USING (g)),
source AS (SELECT b, count(*) AS s FROM placed WHERE kind = 'd' GROUP BY b),
target AS (SELECT b, count(*) AS t FROM placed WHERE kind = 't' GROUP BY b),
gains AS (
    SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
    FROM source LEFT JOIN target USING (b)),
weights AS (SELECT k, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM placed JOIN gains USING (b) WHERE kind = 'd' GROUP BY k),
scored AS (
    SELECT w.k, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= {LEAST_WORDS} AS may,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM worded w LEFT JOIN weights USING (k) WHERE kind = 'd'),
ranked AS (SELECT *, row_number() OVER (ORDER BY may DESC, score DESC, doc_id NULLS FIRST) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * (SELECT count(*) FROM scored WHERE may) // 100 THEN r END AS rank FROM ranked
"""
