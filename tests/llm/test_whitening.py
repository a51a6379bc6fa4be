"""Whitening against numpy on all vectors at once."""

import math

import numpy as np
import pytest

from voxlake.llm import whitening
from voxlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, z string, x string, n string, component string"


def made(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)


def check(rows, vectors, count=8):
    """rows of the result against a plain computation; vectors: (vec_id, entries) that take part."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    centred = np.array(x, float) - np.array(s) / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1], w[:, ::-1]
    assert len(rows) == n * min(count, d)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    z = np.array([[by[i][c + 1][0]["whitened"] for c in range(min(count, d))] for i, _ in vectors])
    assert np.abs(np.abs(z) - np.abs(centred @ w[:, : min(count, d)] / np.sqrt(e[: min(count, d)]))).max() < 1e-6
    cov = (z - z.mean(0)).T @ (z - z.mean(0)) / n
    for r in rows:
        at = [i for i, _ in vectors].index(r["vec_id"])
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x[at], s, strict=True))
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
        assert r["identity_error"] == pytest.approx(np.abs(cov - np.eye(len(cov))).max(), abs=1e-9) and r["identity_error"] < 1e-4


def test_query_on_the_small_table(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    good = [(i, v) for i, v in table if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(QUERIES["op13_whitening"](spark, SF).collect(), good)


def test_moments_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(5000, 0.01, 5)]) for i in range(300)] + [(900, [1e9, 2.0, -3.0, 1e6, 0.0])]
    vectors = whitening.whole_vectors(made(spark, rows))
    moments = whitening.polarised(vectors)
    x = [r["x"] for r in vectors.collect()]
    n, s = len(x), [sum(v[i] for v in x) for i in range(5)]
    want = [[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in x) for j in range(5)] for i in range(5)]
    assert moments.n == n and moments.sums == s and moments.products == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (2, [0.0, 1.5, -2.0]), (3, [-1.0, 0.25, 3.0]), (4, [2.0, -2.0, 1.0]), (6, [0.5, 0.5, -0.75])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 1.0]), (10, [inf, 1.0, 1.0]), (11, [1.0, 2.0]), (12, [])]
    check(whitening.whitened(made(spark, good + bad)).collect(), good)
    doubled = good + [good[0], good[0]]
    check(whitening.whitened(made(spark, doubled), 2).collect(), doubled, 2)
    assert whitening.whitened(made(spark, bad[:2])).collect() == []
    assert whitening.whitened(made(spark, good).limit(0)).collect() == []


def test_components_without_variance(spark):
    rows = whitening.whitened(made(spark, [(None, [1.0, 2.0]), (3, [1.0, 2.0])])).collect()
    assert {(r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(i, c, 0, 0.0, 0.0, 0.0) for i in (None, 3) for c in (1, 2)}
    flat = whitening.whitened(made(spark, [(1, [1.0, 7.0]), (2, [2.0, 7.0]), (3, [4.0, 7.0])])).collect()
    assert {r["whitened"] for r in flat if r["component"] == 2} == {0.0} and flat[0]["identity_error"] < 1e-4
