"""Toxicity: logistic regression fitted by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the buckets of its words, of the first letters of longer
words (which compounds and inflected forms have in common), of neighbouring
words and of pairs with one or two words between them, each present or not.  FTRL
keeps two numbers a bucket, the gradients' sum and that of their squares: each
weight has a rate of its own, and is 0 unless its sum exceeds L1, so that a few
hundred weights are left of BUCKETS.  Those are broadcast; scoring looks at no
other bucket.  One weight more, which all texts have and L1 spares, holds how
rare the label is.

Fitting goes through rows one after the other, in an order made from their ids.
It takes labelled rows by a hash of the id, SAMPLE of them or somewhat more where
there are more; their buckets are computed in parallel and written, and each pass
streams them through one task.  Scoring covers all rows and whole texts.

Defined results: a null or empty text, or one without words, gets what the common
weight says; a label's id that is null teaches nothing, nor does a null label;
of several labels for an id the highest counts; rows that share a labelled id all
teach; without labels every score is 0.5; equal texts get equal scores; an empty
table gives an empty table; columns besides those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise
from tessera.llm.hashing import mix, prefix_hash, run_hashes, word_edges

BITS = 20
BUCKETS = 1 << BITS
#: Bytes of a word's beginning that are features of their own.
HEADS = (4, 5, 6, 7)
#: Distances of the words of a pair: neighbours, and with one or two words between them.
REACH = (1, 2, 3)
#: Labelled rows that are learned from, about; all where there are fewer.
SAMPLE = 12_000
PASSES = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
THRESHOLD = 0.7
_STEEPEST = 35.0
#: Bytes of text whose features are computed together.
_BLOCK = 1 << 20


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the features of texts, in blocks of bounded size; a feature may come more than once."""
    held: list[bytes] = []
    rows: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for part in _parts(text or ""):
            held.append(part)
            rows.append(i)
            size += len(part)
            if size >= _BLOCK:
                yield _features(held, rows)
                held, rows, size = [], [], 0
    if held:
        yield _features(held, rows)


def _parts(text: str) -> Iterator[bytes]:
    """A text in lower case as UTF-8, cut between words where it is long; a part repeats the words before it that pairs reach."""
    raw, before, size = text.lower().encode("utf-8", "surrogatepass"), 0, _BLOCK
    while len(raw) - before > size:
        start, end = word_edges(np.frombuffer(raw[before : before + size], np.uint8))
        if len(start) < max(REACH) + 2:  # few words of about this size
            size *= 2
            continue
        # The last word may go on, so the part ends before it.
        yield raw[before : before + int(end[-2])]
        before, size = before + int(start[-1 - max(REACH)]), _BLOCK
    yield raw[before:]


def _features(parts: list[bytes], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    start, end = word_edges(data)
    part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, "right")
    prefix = prefix_hash(data)
    word = run_hashes(prefix, start, end)
    found, of = [mix(word + np.uint64(1))], [part]
    for k in HEADS:
        long = end - start > k
        found.append(mix(run_hashes(prefix, start[long], start[long] + k) + np.uint64(100 + k)))
        of.append(part[long])
    for k in REACH:
        same = part[:-k] == part[k:]
        found.append(mix(word[:-k] * np.uint64(0x100000001B3) + word[k:] + np.uint64(200 + k))[same])
        of.append(part[:-k][same])
    return np.array(rows)[np.concatenate(of)], (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def packed(buckets: np.ndarray) -> bytes:
    """Ascending buckets as the gaps between them, 2 bytes each, or 4 where one is too large for that; the first byte tells which."""
    gaps = np.diff(buckets, prepend=0)
    size = 2 if not len(gaps) or gaps.max() < 1 << 16 else 4
    return bytes([size]) + gaps.astype(f"<u{size}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, f"<u{raw[0]}", offset=1), dtype=np.int64)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place in the order, toxic, distinct buckets packed) of labelled texts."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for k, text in enumerate(texts):
            own = [bucket for _, bucket in blocks([text])]
            buckets = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([packed(buckets)])], names=["place", "toxic", "buckets"])


def weights_of(z: np.ndarray, n: np.ndarray, spare: np.ndarray | float = L1) -> np.ndarray:
    """The weights that sums of gradients z and of their squares n stand for; those within the L1 bound are 0."""
    return np.where(np.abs(z) > spare, -(z - np.sign(z) * spare) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def step(z: np.ndarray, n: np.ndarray, at: np.ndarray, toxic: int) -> None:
    """Learn from one text: z and n change at its buckets and at the last place, the common weight, which L1 spares."""
    at = np.append(at, BUCKETS)
    spare = np.where(at == BUCKETS, 0.0, L1)
    zs, ns = z[at], n[at]
    w = weights_of(zs, ns, spare)
    g = 1 / (1 + np.exp(-np.clip(w.sum(), -_STEEPEST, _STEEPEST))) - toxic
    rate = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
    z[at] = zs + g - rate * w
    n[at] = ns + g * g


def _pass(state):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        at, held_z, held_n = state.value
        z[at], n[at] = held_z, held_n
        for batch in batches:
            for toxic, buckets in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                step(z, n, unpacked(buckets), toxic)
        at = np.flatnonzero(n)
        for k in range(0, len(at), 1 << 16):
            own = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(z[own]), pa.array(n[own])], names=["bucket", "z", "n"])

    return learn


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) that aren't 0, from docs (doc_id, text) and labels (doc_id, toxic).

    The driver holds two numbers a bucket, BUCKETS at most.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = F.pmod(F.xxhash64("of"), F.lit(1 << 30))
    count = known.count()
    if count > sample:
        known = known.where(share < int((1 << 30) * sample / count))
    rows = docs.select(F.col("doc_id").cast("long").alias("of"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(known) if sample <= SAMPLE else known, "of").select(F.xxhash64("of", "text").alias("place"), (F.col("toxic") > 0).cast("int").alias("toxic"), "text")
    rows = materialise(rows.mapInArrow(_featured, "place long, toxic int, buckets binary"), "features")
    state = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(state)
        learned = rows.repartition(1).sortWithinPartitions("place").mapInArrow(_pass(shared), "bucket int, z double, n double").toArrow()
        state = tuple(learned[c].to_numpy() for c in ("bucket", "z", "n"))
        shared.destroy()
    at, z, n = state
    w = weights_of(z, n, np.where(at == BUCKETS, 0.0, L1))
    return at[w != 0].astype(np.int64), w[w != 0]


def score_batch(texts: list[str | None], at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The probability that each text is toxic."""
    table = np.zeros(BUCKETS + 1)
    table[at] = weights
    used = table != 0
    found = []
    for row, bucket in blocks(texts):
        hit = used[bucket]
        found.append(np.unique(row[hit] * np.int64(2 * BUCKETS) + bucket[hit]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    total = np.bincount(pairs // (2 * BUCKETS), table[pairs % (2 * BUCKETS)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total + table[BUCKETS], -_STEEPEST, _STEEPEST)))


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights = model.value
        for batch in batches:
            # Equal texts get equal scores to the last bit only if sums are taken in one order, which bincount does.
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_batch(batch.column(1).to_pylist(), at, weights))], names=["doc_id", "score"])

    return score


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scorer(shared), "doc_id long, score double")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
