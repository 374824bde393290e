"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training: each task counts the hashed 1- to 3-grams of its labelled texts per
language and emits the counts that are not 0; Spark adds them up.  The model is
a matrix languages x buckets of log probabilities.  Its size, and what the driver
needs to make it, is known before any text is read and has a limit; it is
broadcast.  Scoring: the n-grams of a batch of texts make one sparse matrix, rows
of bucket numbers end to end; it is multiplied with the model in numpy, for up
to SCORE_AT_ONCE n-grams at once.

Texts are read whole, in blocks, in lower case; a run of other characters than
letters counts as one space, so numbers, marks and lay-out don't matter.

Defined results: a text that is null or has no letter gets `und` and score 0;
rows without a label teach nothing; without any labelled text every text gets
`und`; ties go to the language that sorts first; equal texts get equal
results; columns besides those named are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

ORDERS = (1, 2, 3)
BUCKETS = 1 << 17
SMOOTHING = 0.5
#: What the driver holds of a language and bucket while it makes the model: a counted row (16 bytes), its place, the probability.
CELL_BYTES = 32
#: The model holds 4 bytes of each language and bucket; where making it takes more than this, it is refused rather than broadcast.
MODEL_LIMIT = 512 * 1024 * 1024
#: N-grams whose probabilities are looked up together.
SCORE_AT_ONCE = 1 << 19
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
_BLOCK = 1 << 19


def features(text: str) -> Iterator[np.ndarray]:
    """The hashed n-grams of a whole text, in blocks of bounded size; a border counts as a space."""
    for start in range(0, len(text), _BLOCK):
        part = _OTHER.sub(" ", text[start : start + _BLOCK].lower())
        code = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(code) <= 2:
            continue
        yield grams(code)


def grams(code: np.ndarray) -> np.ndarray:
    out = []
    value = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(code):
            break
        value = value[: len(code) - n + 1] * np.uint32(0x01000193) + (code[n - 1 :] + np.uint32(1))
        if n in ORDERS:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((mixed ^ (mixed >> np.uint32(12))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for block in features(text):
                own += np.bincount(block, minlength=BUCKETS)
            texts[lang] = texts.get(lang, 0) + 1
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        # Bucket -1 has the number of texts.
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(own[at], texts[lang]))], names=["lang", "bucket", "n"]
        )


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    log_probability: np.ndarray  # BUCKETS x languages


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count over all labelled rows; the result has at most languages x (BUCKETS + 1) numbers."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    most = MODEL_LIMIT // (BUCKETS * CELL_BYTES)
    names = sorted(r["lang"] for r in rows.select("lang").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} languages: the model would take over {MODEL_LIMIT} bytes; use fewer labels or buckets")
    if not names:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    counted = rows.mapInArrow(_counter, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    place = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    table = counted.select(place[F.col("lang")].cast("int").alias("lang"), "bucket", F.col("n").cast("double")).toArrow()
    lang, bucket, n = (c.to_numpy() for c in table.columns)
    texts = np.zeros(len(names))
    texts[lang[bucket < 0]] = n[bucket < 0]
    counts = np.full((len(names), BUCKETS + 1), SMOOTHING, np.float32)  # the last column, bucket -1, is not used
    counts[lang, bucket] += n
    total = counts[:, :BUCKETS].sum(axis=1, dtype=np.float64)
    np.log(counts, out=counts)
    counts -= np.log(total).astype(np.float32)[:, None]
    return Model(names, np.log(texts / texts.sum()), counts[:, :BUCKETS].T)


def _score_rows(model: Model, blocks: list[np.ndarray]) -> np.ndarray:
    """(rows, languages): for each row of a sparse matrix of ones, given by its columns, its product with the model."""
    flat = np.concatenate(blocks)
    starts = np.cumsum([0, *(len(b) for b in blocks[:-1])])
    # A few languages' columns are read faster one by one than as a table of narrow rows.
    return np.stack([np.add.reduceat(model.log_probability[:, i][flat], starts, dtype=np.float64) for i in range(len(model.languages))], axis=1)


def score_batch(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and posterior probability of each text; null stands for a text without letters."""
    total = np.zeros((len(texts), len(model.languages)))
    blocks: list[np.ndarray] = []
    rows: list[int] = []

    def flush() -> None:
        np.add.at(total, rows, _score_rows(model, blocks))
        blocks.clear()
        rows.clear()

    waiting = 0
    for i, text in enumerate(texts if model.languages else ()):
        for block in features(text or ""):
            blocks.append(block)
            rows.append(i)
            waiting += len(block)
            if waiting >= SCORE_AT_ONCE:
                flush()
                waiting = 0
    if blocks:
        flush()
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = np.array([t is not None for t in texts], bool)
    if model.languages and known.any():
        total += model.prior
        best = total.argmax(axis=1)
        posterior = 1.0 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        scores = np.where(known, posterior, 0.0)
    return names, scores


def language_of(model, text: Column) -> Column:
    """struct(lang_pred, score) of a text; model is a broadcast Model."""

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        names, scores = score_batch(model.value, [None if pd.isna(t) else t for t in texts.tolist()])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return score(F.when(text.rlike(r"\p{L}"), text))


def predict(docs: DataFrame, model: Model, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, lang_pred and score (the posterior probability) of every row."""
    found = language_of(docs.sparkSession.sparkContext.broadcast(model), F.col(text_col))
    return docs.select(F.col(key_col).cast("long").alias("key"), found.alias("found")).select("key", "found.lang_pred", "found.score")


def held_out(id_col: str = "doc_id") -> Column:
    """A third of all ids, by checksum: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    found = predict(docs, model)
    return found.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "lang_pred", "score")
