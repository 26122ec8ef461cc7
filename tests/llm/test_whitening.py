"""Whitening against dense eigenvectors and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import queries as Q
from tallyflow.llm.whitening import lanczos, whiten

SMALL = "/root/testdata/sf0.001"


def dense(rows, components=8):
    """n, deviations by row, eigenvalues, axes and centred rows, from the whole covariance."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in rows], np.int64)
    n, total = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
    centred = (x * n - total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, values[::-1][:components], axes[:, ::-1][:, :components], centred, values.sum()


def check(got, rows, components=8):
    n, deviation, values, axes, centred, trace = dense(list(rows.values()), components)
    at = {k: i for i, k in enumerate(rows)}
    want = centred @ axes / np.sqrt(values)
    sign = {}
    assert len(got) == n * len(values)
    for r in got:
        i, k = at[r["vec_id"]], r["component"] - 1
        assert (r["n"], int(r["deviation"])) == (n, deviation[i])
        assert abs(r["explained"] - values[k] / trace) <= 1e-9 and 0 <= r["identity_error"] <= 1e-9
        if abs(want[i, k]) > 1e-3:
            s = sign.setdefault(k, np.sign(r["whitened"] * want[i, k]))
            assert abs(s * r["whitened"] - want[i, k]) < 1e-7 * max(1, abs(want[i, k]))


def test_query_against_dense_covariance(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    check(Q.op13_whitening(spark, SMALL).collect(), rows)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    good = {i: [float(c) for c in rng.standard_normal(12) * np.arange(1, 13)] for i in range(60)}
    bad = [(100, None), (101, [None] + [1.0] * 11), (102, [float("nan")] * 12), (103, [float("inf")] + [0.0] * 11), (104, []), (105, [1.0] * 5), (106, [1e300] * 12)]
    vectors = spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<double>")
    vectors = vectors.withColumns({c: F.lit("x") for c in ("vector", "n", "component", "deviation", "at", "held")})
    check(whiten(vectors).collect(), good)
    assert whiten(vectors.where("false")).collect() == [] and whiten(vectors.where("vec_id >= 106")).collect() == []
    assert whiten(vectors.where("vec_id = 1")).collect() == []


def test_repeated_rows_missing_ids_and_small_rank(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [2.0, 4.0, 6.0]), (3, [0.0, 0.0, 0.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [r["component"] for r in got] == [1] * 4 and sorted(str(r["vec_id"]) for r in got) == ["1", "1", "3", "None"]
    assert abs(sum(r["whitened"] ** 2 for r in got) / 4 - 1) < 1e-9 and abs(got[0]["explained"] - 1) < 1e-9


@pytest.mark.parametrize("rows", [{1: [1.0] * 10, 2: [2.0, 3.0] * 5, 7: [0.5, -4.0] * 5}, {5: [2.0] * 3}, {1: [0.25] * 9, 2: [0.25] * 9}])
def test_query_on_few_rows_has_each_component(spark, tmp_path, rows):
    odd = [(100, None), (101, [None, 1.0]), (102, [math.nan] * 3)]
    spark.createDataFrame([*rows.items(), *odd], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.op13_whitening(spark, str(tmp_path)).collect()
    n, deviation, values, axes, centred, trace = dense(list(rows.values()))
    want = [(i, k + 1, n, d) for i, d in zip(rows, deviation, strict=True) for k in range(len(values))]
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == sorted(want, key=lambda w: w[:2])
    for r in got:
        v = values[r["component"] - 1]
        assert (r["whitened"] is None) == (v <= max(values[0], 1e-9) * 1e-12) and (r["identity_error"] is None) == (trace == 0)
        assert r["explained"] is None if trace == 0 else abs(r["explained"] - v / trace) <= 1e-9
        assert trace == 0 or r["identity_error"] <= 1e-9


def test_rows_take_part_up_to_the_range_of_a_long(spark):
    rows = [(1, [2.0**53 - 128]), (2, [-(2.0**53)]), (3, [3.0]), (4, [2.0**53 - 1]), (5, [-(2.0**53) - 2])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    assert sorted((r["vec_id"], r["n"]) for r in got) == [(1, 3), (2, 3), (3, 3)]


def test_exact_beyond_64_bits(spark):
    rows = {i: [float(v), 1.0] for i, v in enumerate((0, 1 << 40, 1 << 44, 3))}
    got = whiten(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"), components=1).collect()
    _, deviation, *_ = dense(rows.values())
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(enumerate(deviation)) and max(deviation) > 1 << 64


@pytest.mark.parametrize(("size", "block", "most"), [(64, 16, 256), (200, 8, 40), (5, 16, 64), (40, 3, 30)])
def test_lanczos_on_known_spectra(size, block, most):
    rng = np.random.default_rng(size)
    values = np.sort(rng.random(size))[::-1] * 100
    values[2:5] = values[2]
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    whole = turn @ np.diag(values) @ turn.T
    found, axes, passes = lanczos(lambda q: whole @ q, size, 8, block, 1e-12, most)
    k = min(8, size)
    assert np.abs(found - values[:k]).max() < 1e-9 and np.abs(whole @ axes - axes * found).max() < 1e-8
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-9 and passes <= 500


def test_lanczos_restarts_on_breakdown():
    whole = np.diag([5.0] * 10 + [1.0] * 30)
    found, axes, _ = lanczos(lambda q: whole @ q, 40, 8, 8, 1e-12, 30)
    assert np.abs(found - 5).max() < 1e-9 and np.abs(axes[10:]).max() < 1e-9
    found, _, _ = lanczos(lambda q: np.diag([5.0] * 2 + [0.0] * 30) @ q, 32, 8, 8, 1e-12, 30)
    assert np.abs(found - ([5.0] * 2 + [0.0] * 6)).max() < 1e-9
