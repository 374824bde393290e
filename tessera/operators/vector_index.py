"""A partitioned index of vectors for searches by inner product.

Centres of cells are fitted on a bounded sample; every vector is put into the
cell of its nearest centre, and the table is written by cells.  A query looks into
as many of its nearest cells as a sample of the corpus shows to be needed for
the recall asked for, and reads no other.  search.dense() is the exact way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.search import QUERY_BYTES, TOP, best
from tessera.sources import BROADCAST_LIMIT, place_for, written

#: The sample that centres are fitted on and recall is measured on, in bytes of vectors held by the driver.
SAMPLE_BYTES = 64 * 1024 * 1024
#: Of the sample so many vectors are looked up in the rest of it to measure recall.
TRIED = 500
MOST_CELLS = 4096
ROUNDS = 12
RECALL = 0.95
#: Rows of a cell in one file, about.
PART_ROWS = 200_000


class VectorIndex(NamedTuple):
    """The written table (doc, vector, cell), the centres of its cells, how many cells a query looks into, and the size of a vector."""

    table: DataFrame
    centres: np.ndarray
    probes: int
    width: int


def fit_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of length 1 by spherical k-means, from rows at even distances; a cell that loses all its rows keeps its centre."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centres = unit[np.linspace(0, len(unit) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = nearest(unit, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray, n: int, digits: int = 9) -> np.ndarray:
    """The n cells of greatest inner product for each vector, best first, of equals the first."""
    return np.argsort(-np.round(vectors @ centres.T, digits), axis=1, kind="stable")[:, :n]


def probes_needed(sample: np.ndarray, centres: np.ndarray, top: int, recall: float, tried: int = TRIED) -> int:
    """The fewest cells in which `tried` rows of the sample find so much of their `top` best ones in it."""
    asked = sample[np.linspace(0, len(sample) - 1, min(tried, len(sample))).astype(int)]
    own = nearest(sample, centres, 1)[:, 0]
    wanted = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :top]
    place = np.argsort(nearest(asked, centres, len(centres)), axis=1)  # of each cell in each query's order
    needed = np.take_along_axis(place, own[wanted], axis=1).ravel()
    return int(np.quantile(needed, recall, method="higher")) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 1))


def assign(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(doc, cell): the centre (cell, vector) of greatest inner product, to six digits, for each of rows (doc, vector); the least cell of equal ones.

    The centres go to every task, so more than BROADCAST_LIMIT bytes of them are refused.
    """
    size = centres.select(F.count("*"), F.max(F.size("vector"))).first()
    if (size[0] or 0) * (size[1] or 0) * 8 > BROADCAST_LIMIT:
        raise ValueError(f"centres of more than {BROADCAST_LIMIT} bytes")
    held = centres.orderBy("cell").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((held["cell"].to_numpy(), _matrix(held["vector"].combine_chunks())))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, matrix = shared.value
        for batch in batches:
            if len(batch) and len(cells):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells[nearest(_matrix(batch.column(1)), matrix, 1, 6)[:, 0]])], names=["doc", "cell"])

    return rows.where("vector is not null").select("doc", "vector").mapInArrow(own, "doc long, cell int")


def _assigner(centres, n: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cells = nearest(_matrix(batch.column(1)), centres.value, n).astype(np.int32)
                found = pa.array(cells[:, 0]) if n == 1 else pa.array(list(cells), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["id", "vector", "cells"])

    return assign


def build(corpus: DataFrame, cells: int | None = None, top: int = TOP, recall: float = RECALL) -> VectorIndex:
    """The index of corpus (doc, vector); vectors are of one size, rows without one are left out."""
    spark = corpus.sparkSession
    rows = corpus.where("doc is not null and vector is not null").select("doc", F.col("vector").cast("array<double>").alias("vector"))
    n = rows.count()
    if not n:
        return VectorIndex(rows.withColumn("cell", F.lit(0)), np.zeros((1, 1)), 1, 1)
    width = rows.select(F.size("vector")).first()[0]
    most = max(1, SAMPLE_BYTES // (8 * width))
    share = F.pmod(F.xxhash64("doc"), F.lit(1 << 30))
    some = rows if n <= most else rows.where(share < int((1 << 30) * most / n))
    held = some.withColumn("share", share).toArrow()
    order = np.lexsort((held["doc"].to_numpy(), held["share"].to_numpy()))
    sample = _matrix(held["vector"].combine_chunks())[order]
    cells = max(1, min(MOST_CELLS, isqrt(n) if cells is None else cells, len(sample)))
    centres = fit_cells(sample, cells)
    probes = min(cells, probes_needed(sample, centres, top, recall))
    # Files of one cell are as many as its rows need, so that a cell with a third of all rows is no single task.
    placed = written(rows.mapInArrow(_assigner(spark.sparkContext.broadcast(centres), 1), "doc long, vector array<double>, cell int"), "placed")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))  # MOST_CELLS rows at most
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    path = place_for(spark, "cells")
    dealt.repartition("cell", "part").select("doc", "vector", "cell").write.partitionBy("cell").parquet(path)
    return VectorIndex(spark.read.schema("doc long, vector array<double>, cell int").parquet(path), centres, probes, width)


def _blocks(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks) for queries by their nearest cell: neighbours share a block, a cell of many queries has several."""
    found, block, left = [], 0, capacity
    for cell, n in sorted(counts.items()):
        if n > capacity:
            if left < capacity:
                block += 1
            parts = -(-n // capacity)
            found.append((cell, block, parts))
            block, left = block + parts, capacity
            continue
        if n > left:
            block, left = block + 1, capacity
        found.append((cell, block, 1))
        left -= n
    return found


def _scorer(block, top: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, probed = block.value
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cells = batch.column(2).to_numpy()
            for cell in np.unique(cells).tolist():
                own = probed.get(cell)
                if own is None:
                    continue
                some = batch.filter(pa.array(cells == cell))
                docs, scores = some.column(0).to_numpy(), np.round(matrix[own] @ _matrix(some.column(1)).T, 6)
                for q, row in zip(own.tolist(), scores, strict=True):
                    had = found.get(q, (np.zeros(0, np.int64), np.zeros(0)))
                    d, s = np.concatenate([had[0], docs]), np.concatenate([had[1], row])
                    best_ones = np.lexsort((d, -s))[:top]
                    found[q] = (d[best_ones], s[best_ones])
        for q, (d, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ids[q])), pa.array(d), pa.array(s)], names=["query", "doc", "score"])

    return score


def search(index: VectorIndex, queries: DataFrame, top: int = TOP, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, doc, score, rank): the best documents in the cells that each of queries (query, vector) looks into.

    Queries go to the tasks in blocks of bounded size, neighbours together; a block
    reads the cells that its queries look into and no others.
    """
    spark = queries.sparkSession
    rows = queries.where("vector is not null").select("query", F.col("vector").cast("array<double>").alias("vector"))
    shape = "query long, doc long, score double"
    if index.table.isEmpty():
        return best(spark.createDataFrame([], shape), top)
    asked = rows.mapInArrow(_assigner(spark.sparkContext.broadcast(index.centres), index.probes if index.probes > 1 else 2), "id long, vector array<double>, cells array<int>")
    asked = written(asked.withColumn("cells", F.slice("cells", 1, index.probes)), "asked")
    counts = {r["cell"]: r["n"] for r in asked.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("n")).collect()}  # MOST_CELLS rows at most
    if not counts:
        return best(spark.createDataFrame([], shape), top)
    dealt = spark.createDataFrame(_blocks(counts, max(1, block_bytes // (8 * index.width))), "first_cell int, block int, blocks int")
    asked = asked.join(F.broadcast(dealt), F.col("cells")[0] == F.col("first_cell")).withColumn("block", F.col("block") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    path = f"{place_for(spark, 'found')}-{uuid.uuid4().hex}"
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        own = asked.where(F.col("block") == block).select("id", "vector", "cells").toArrow()
        probed: dict[int, list[int]] = {}
        for q, cells in enumerate(own["cells"].to_pylist()):
            for cell in cells:
                probed.setdefault(cell, []).append(q)
        held = spark.sparkContext.broadcast((own["id"].to_numpy(), _matrix(own["vector"].combine_chunks()), {c: np.array(q) for c, q in probed.items()}))
        index.table.where(F.col("cell").isin(sorted(probed))).mapInArrow(_scorer(held, top), shape).write.mode("append").parquet(path)
        held.destroy()
    return best(spark.read.schema(shape).parquet(path), top)
