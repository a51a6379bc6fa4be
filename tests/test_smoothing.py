import itertools

import pytest
from pyspark.sql import functions as F

from voxlake.functions import geometry as G
from voxlake.operators.voxels import VoxelConfig, dense_samples, sample_totals, smooth_sparse


def plain(rows, n):
    taps, out = G.gaussian_taps(), {}
    radius = len(taps) // 2
    mirrored = lambda c: -1 - c if c < 0 else 2 * n - 1 - c if c >= n else c
    for key, ch, *at, v in rows:
        for steps in itertools.product(range(len(taps)), repeat=3):
            cell = tuple(mirrored(c + k - radius) for c, k in zip(at, steps))
            w = 1000.0
            for k in steps:
                w *= taps[k]
            out[(key, ch, *cell)] = out.get((key, ch, *cell), 0.0) + v * w
    return out


def test_smoothing_gives_the_stencil_without_tap_rows(spark):
    rows = [("a", 0, 0, 0, 5, 2.0), ("a", 0, 5, 2, 3, 1.0), ("a", 0, 5, 2, 3, 4.0), ("a", 1, 3, 3, 3, 1.0), (None, 2, 5, 0, 0, 1.0), ("z", 0, 2, 2, 2, 0.0)]
    counts = spark.createDataFrame(rows, "k string, ch int, ix int, iy int, iz int, v double")
    smooth = smooth_sparse(counts, VoxelConfig(box_size=6.0), ["k"])
    assert smooth.columns == ["k", "ch", "ix", "iy", "iz", "v"]
    got = {tuple(r)[:5]: r["v"] for r in smooth.collect()}
    want = plain(rows, 6)
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(v, rel=1e-12) for c, v in want.items())
    assert "MapInArrow" in smooth._jdf.queryExecution().toString()


def test_totals_of_samples_are_those_of_their_arrays(spark):
    packed = spark.createDataFrame([("a", [(0, 2.0), (7, 1.0)]), ("b", [(3, 5.0)])], "k string, cells array<struct<cell:int,v:float>>")
    x = dense_samples(packed, VoxelConfig(box_size=4.0)).select("k", "x")
    want = {r["k"]: (r["t"], r["p"]) for r in x.select("k", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("t"), F.array_max("x").alias("p")).collect()}
    got = {r["k"]: (r["total"], r["peak"]) for r in sample_totals(x).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    odd = spark.createDataFrame([("e", []), ("n", None), ("v", [2.0, 3.0])], "k string, x array<float>")
    assert {r["k"]: (r["total"], r["peak"]) for r in sample_totals(odd).collect()} == {"e": (0.0, None), "n": (0.0, None), "v": (5.0, 3.0)}


def test_smoothed_cells_as_lists_are_those_of_the_rows(spark):
    """Few voxels are spread tap by tap, many as a dense block: the same cells either way, with or without rows."""
    few = [("a", 0, 0, 0, 5, 2.0), ("a", 0, 5, 2, 3, 1.0), ("z", 0, 2, 2, 2, 0.0)]
    many = [("m", 3, *at, float(sum(at) % 3 + 1)) for at in itertools.product(range(6), repeat=3)]
    counts = spark.createDataFrame(few + many, "k string, ch int, ix int, iy int, iz int, v double").coalesce(1)
    for rows in (few, many, few + many):
        part = counts.where(F.col("k").isin([r[0] for r in rows]))
        want = {}
        for (key, ch, *cell), v in sorted(plain(rows, 6).items()):
            want.setdefault((key, ch), []).append(v)
        got = {(r["k"], r["ch"]): r["x"] for r in smooth_sparse(part, VoxelConfig(box_size=6.0), ["k"], rows=False).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
