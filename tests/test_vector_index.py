"""The index of vectors: recall against all inner products, and that looking into every cell is exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(30, 24))
    rows = middle[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    rows[:700] = rows[700]  # a hot cell
    return spark.createDataFrame([(i, [float(x) for x in v], "x", 1) for i, v in enumerate(rows)] + [(None, [0.0] * 24, "x", 1), (9999, None, None, None)], "doc long, vector array<double>, cell string, part int")


def _of(found):
    out: dict = {}
    for r in found.collect():
        out.setdefault(r["query"], []).append((r["rank"], r["doc"], r["score"]))
    return {q: sorted(rows) for q, rows in out.items()}


@pytest.mark.parametrize("block_bytes", [1 << 25, 24 * 8 * 7])
def test_recall_and_blocks(spark, vectors, monkeypatch, block_bytes):
    monkeypatch.setattr(vector_index, "PART_ROWS", 200)
    whole = vectors.where("doc is not null and vector is not null").select("doc", "vector")
    queries = whole.where("doc % 50 = 0").select(F.col("doc").alias("query"), "vector")
    exact = _of(search.dense(whole, queries, 10))
    index = vector_index.build(vectors, top=10)
    assert index.probes < len(index.centres) / 2 and index.table.count() == 3000
    got = _of(vector_index.search(index, queries, 10, block_bytes))
    # A row counts as found if its score is among the best: equal vectors tie.
    least = {q: rows[-1][2] for q, rows in exact.items()}
    recall = sum(s >= least[q] - 1e-9 for q, rows in got.items() for _, _, s in rows) / sum(map(len, exact.values()))
    assert recall >= 0.9, recall
    everywhere = _of(vector_index.search(index._replace(probes=len(index.centres)), queries, 10, block_bytes))
    assert everywhere == exact


def test_sample_bounds_what_is_fitted(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE_BYTES", 24 * 8 * 400)
    index = vector_index.build(vectors, cells=20)
    again = vector_index.build(vectors.repartition(3), cells=20)
    assert len(index.centres) == 20 and np.allclose(index.centres, again.centres) and index.probes == again.probes


def test_nothing_to_find(spark, vectors):
    index = vector_index.build(vectors.where("false"))
    queries = vectors.where("doc = 1").select(F.col("doc").alias("query"), "vector")
    assert vector_index.search(index, queries).count() == 0
    assert vector_index.search(vector_index.build(vectors), queries.where("false")).count() == 0


def test_blocks_keep_cells_together():
    assert vector_index._blocks({0: 3, 1: 4, 2: 25, 3: 1, 4: 9, 5: 1}, 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 4, 1), (5, 5, 1)]


def test_recall_of_the_query(spark):
    """Against all inner products of the given vectors, which lie in no clear cells."""
    from tessera.jobs import QUERIES

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        exact, got = _of(QUERIES["dense_topk"](spark, sf)), _of(QUERIES["ann_topk"](spark, sf))
        assert sum(len({d for _, d, _ in rows} & {d for _, d, _ in got[q]}) for q, rows in exact.items()) >= 0.9 * sum(map(len, exact.values()))
