"""The neighbour graph over many blocks: recall against brute force, and one component."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyflow.llm.nn_descent import Graph, nearest
from tallyflow.llm.scratch import Scratch


def made(kind: str, n: int, dim: int = 32) -> np.ndarray:
    rng = np.random.default_rng(4)
    if kind == "gaussian":
        return rng.normal(size=(n, dim))
    return rng.normal(size=(60, dim))[rng.integers(60, size=n)] + 0.3 * rng.normal(size=(n, dim))


def frame(spark, vectors):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(vectors)), "embedding": pa.array(vectors.tolist())})).repartition(6)


@pytest.mark.parametrize(("kind", "n", "block"), [("gaussian", 20000, 256), ("clustered", 20000, 256), ("gaussian", 2000, 64)])
def test_recall_over_many_blocks(spark, kind, n, block):
    vectors = made(kind, n)
    got = {}
    for r in nearest(frame(spark, vectors), F.col("vec_id") % 50 == 0, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    exact = brute.nearest(list(enumerate(vectors)), set(range(0, n, 50)))
    assert set(got) == set(exact)
    assert sum(len(set(got[q]) & set(exact[q])) for q in exact) >= 0.95 * sum(map(len, exact.values()))


def test_graph_crosses_blocks(spark):
    """Most nodes of a Gaussian cloud have neighbours in other blocks."""
    vectors = made("gaussian", 1500).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    packed = spark.createDataFrame([(i, bytes(v.tobytes())) for i, v in enumerate(vectors)], "id long, vec binary")
    graph = Graph(packed, Scratch(spark, "test"), block=64)
    rows = graph.adjacency.select("id", "near").collect()
    assert len({r["id"] >> 32 for r in rows}) >= 16
    assert sum(any(u >> 32 != r["id"] >> 32 for u in r["near"]) for r in rows) >= 0.9 * len(rows)


def test_tiny_and_huge_components(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 0.0]), (2, [5e-324, 5e-324]), (3, [-1e308, 1e308]), (4, [1.0, 1e-300]), (5, [0.0, 1e-160])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest(df, F.lit(True)).collect()}
    assert len(got) == 30 and all(np.isfinite(s) for s in got.values())
    half = 0.5**0.5
    for pair, score in {(0, 1): 1, (0, 2): half, (1, 3): -half, (2, 3): 0, (4, 0): 1, (5, 3): half, (5, 0): 0}.items():
        assert got[pair] == pytest.approx(score, abs=1e-12), pair


@pytest.mark.parametrize(("sample", "block"), [(32, 64), (8192, 2)])
def test_leaves_cut_by_hash_stay_connected(spark, monkeypatch, sample, block):
    """Trees that stop early have leaves that a hash cuts in ten parts or more: neighbours are found across them."""
    from tallyflow.llm import nn_descent

    monkeypatch.setattr(nn_descent, "SAMPLE", sample)
    n = 6000 if sample == 32 else 12000
    vectors = made("clustered", n)
    got = {}
    for r in nearest(frame(spark, vectors), F.col("vec_id") % 50 == 0, block=block).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    exact = brute.nearest(list(enumerate(vectors)), set(range(0, n, 50)))
    assert sum(len(set(got[q]) & set(exact[q])) for q in exact) >= 0.9 * sum(map(len, exact.values()))
