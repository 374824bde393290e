"""Removal of repeated passages by content-defined chunks.

A gear hash rolls over a text's bytes; a chunk ends where the hash is the least
within RADIUS bytes to either side.  That depends on the bytes around alone, so
chunks fall back into step right after an insertion, and a passage is cut the
same way in every document that has it; a chunk is cut after each MOST bytes of
it, as fillers of one letter need.  Chunks are compared by a 128-bit digest:
those that also occur under a smaller id are repeats.  Runs of repeats that make
up `least` bytes are removed, one chunk or many, and so is a text that consists
of repeats; with 0 all repeats are.  Chunks that very many documents hold are split in the join that
tells their documents.

Defined results: a null text is the empty text; rows that share an id don't remove each other's passages, nor
does a text its own; a null id is the smallest; equal rows get equal results;
a very long text is hashed in blocks; an empty table gives an empty table;
columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise, salted_join
from tessera.llm.hashing import mix

RADIUS = 24
#: A run of repeated chunks shorter than this stays, unless it is the whole text; with 0 every repeated chunk goes.
MIN_RUN = 64
#: The longest chunk.
MOST = 4096
_SHIFT, _WINDOW = 2, 16  # 32 bits shifted by 2 a byte forget a byte after 16
_BLOCK = 1 << 20
_NULL = -(1 << 63)

GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """hash[i] = GEAR[data[i]] + (hash[i - 1] << 2), modulo 2**32, by doubling the window."""
    h = GEAR[data]
    step = 1
    while step < _WINDOW:
        h[step:] += h[:-step] << np.uint32(_SHIFT * step)
        step *= 2
    return h


def _least_around(h: np.ndarray) -> np.ndarray:
    """Places whose value is below all within RADIUS before them and not above any within RADIUS after."""

    def sliding(x: np.ndarray) -> np.ndarray:
        width = 1
        while width < RADIUS:
            step = min(width, RADIUS - width)
            x = np.minimum(x[:-step], x[step:])
            width += step
        return x

    least = sliding(h)  # least[i]: of h[i : i + RADIUS]
    at = np.arange(RADIUS, len(h) - RADIUS)
    return at[(h[at] < least[at - RADIUS]) & (h[at] <= least[at + 1])] if len(at) else at


def chunk_ends(raw: bytes) -> np.ndarray:
    """Where the chunks of a text end; the last end is the text's."""
    data, found = np.frombuffer(raw, np.uint8), []
    edge = _WINDOW + RADIUS
    for start in range(0, len(data), _BLOCK):
        low = max(0, start - edge)
        at = _least_around(gear_hash(data[low : start + _BLOCK + RADIUS + 1])) + low
        found.append(at[(at >= start) & (at < start + _BLOCK)] + 1)
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.concatenate(found)
    ends = np.append(ends[ends < len(data)], len(data))
    size = np.diff(ends, prepend=0)
    parts = -(-size // MOST)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        ends = np.minimum(np.repeat(ends - size, parts) + nth * MOST, np.repeat(ends, parts))
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, starts, sizes, times = [], [], [], []
        for raw in batch.column(2).to_pylist():
            ends = chunk_ends(raw).tolist()
            begins = [0, *ends[:-1]] if ends else []
            digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begins, ends, strict=True)]
            starts += begins
            sizes += [b - a for a, b in zip(begins, ends, strict=True)]
            times.append(len(ends))
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        row = pa.array(np.repeat(np.arange(len(times)), times))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), batch.column(0).take(row), batch.column(1).take(row), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32())],
            names=["d1", "d2", "doc_id", "row_key", "start", "size"],
        )


def runs_to_remove(chunks: list[tuple[int, int]], size: int, least: int) -> list[tuple[int, int]]:
    """Spans of successive repeated chunks (start, size) that are long enough, or the whole text of that size."""
    spans: list[list[int]] = []
    for start, length in sorted(chunks):
        if spans and spans[-1][1] == start:
            spans[-1][1] += length
        else:
            spans.append([start, start + length])
    return [(a, b) for a, b in spans if b - a >= least or b - a == size]


def _cutter(least: int):
    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sources = [], [], []
            for raw, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cut = runs_to_remove([(c["start"], c["size"]) for c in found or []], len(raw), least)
                spans.append([[a, b] for a, b in cut])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(raw)], strict=True)))
                sources.append(sorted({c["first"] for c in found or [] if any(a <= c["start"] < b for a, b in cut)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in batch.column(1).to_pylist()], pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()), pa.array(sources, pa.list_(pa.int64()))],
                names=["doc_id", "n_bytes", "spans", "kept", "repeats_of"],
            )

    return cut_all


def remove_repeated_passages(docs: DataFrame, least: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed, from and to in bytes), kept (bytes), repeats_of (ids that have the passages first).

    Runs of repeated chunks of fewer than `least` bytes stay, unless they are a whole text; 0 keeps none.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(raw).alias("row_key"), raw.alias("raw"))
    chunks = thin.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), "row_key", "raw").mapInArrow(_chunks, "d1 long, d2 long, doc_id long, row_key long, start long, size int")
    # Combined before the shuffle: a chunk of a hot passage crosses it once a partition.
    repeated = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    repeated = materialise(repeated, "repeated")
    copies = salted_join(chunks, repeated.drop("n"), ["d1", "d2"], "doc_id", repeated).where("doc_id > first")
    found = copies.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "size", "first")).alias("found"))
    met = thin.join(found.withColumnRenamed("doc_id", "of"), F.coalesce(thin["doc_id"], F.lit(_NULL)).eqNullSafe(F.col("of")) & (thin["row_key"] == found["row_key"]), "left")
    return met.select(thin["doc_id"], "raw", "found").mapInArrow(_cutter(least), "doc_id long, n_bytes long, spans array<array<long>>, kept binary, repeats_of array<long>")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return remove_repeated_passages(documents(spark, sf_dir)).select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "repeats_of")
