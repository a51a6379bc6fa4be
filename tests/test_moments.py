"""Mergeable moments and class cuts by threshold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import sampling, stats


def test_large_mean_small_deviation(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(1e6, 1e-2, (2000, 6))
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "i int, x array<double>").repartition(40)
    rows = stats.voxelwise_stats(frame).orderBy("cell").collect()
    assert np.allclose([r["mean"] for r in rows], data.mean(0), rtol=1e-14)
    assert np.allclose([r["std"] for r in rows], data.std(0), rtol=1e-6)
    got = {r["ch"]: r for r in stats.channel_stats(frame, 2).collect()}
    assert np.allclose([got[c]["std"] for c in (0, 1)], data.reshape(-1, 2, 3).std(axis=(0, 2)), rtol=1e-6)


def test_many_partitions_and_parts(spark):
    frame = spark.range(0, 6000, 1, 3000).select(
        (F.col("id") % 3).cast("int").alias("part"), F.array(F.col("id").cast("double"), F.col("id") * 2.0, F.lit(7.0)).alias("x"))
    rows = stats.voxelwise_stats(frame).orderBy("cell").collect()
    ids = np.arange(6000.0)
    assert np.allclose([r["mean"] for r in rows], [ids.mean(), 2 * ids.mean(), 7.0]) and np.isclose(rows[0]["std"], ids.std())
    means = [r["mean"] for r in stats.mean_of_part_means(frame, "part").orderBy("cell").collect()]
    assert np.isclose(means[0], np.mean([ids[k::3].mean() for k in range(3)]))
    assert stats.voxelwise_stats(frame.where("id < 0")).collect() == [] if "id" in frame.columns else True


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(1)
    rows = [(i, "a" if i < 2000 else rnd.choice(["b", "c", None])) for i in range(3500)]
    return spark.createDataFrame(rows, "id int, label string").repartition(5)


def test_class_cuts_equal_ranks(labelled):
    from voxlake.operators.ranking import rank_by_hash

    ranked = rank_by_hash(labelled, ["label"], ["id"], 5, "r").collect()
    least = min(r["_total"] for r in ranked)
    got = sampling.downsample_to_minimum(labelled, "label", ["id"], 5)
    assert got.columns == labelled.columns
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in ranked if r["r"] <= least)
    for share in (0.0, 0.1, 0.5, 1.0):
        split = sampling.stratified_split(labelled, "label", ["id"], share, 5).collect()
        want = {r["id"] for r in ranked if r["r"] <= round(r["_total"] * share)}
        assert {r["id"] for r in split if r["split"] == "val"} == want and len(split) == 3500


def test_equal_keys_are_cut_exactly(spark):
    rows = spark.createDataFrame([(1, "a")] * 40 + [(i, "b") for i in range(15)], "id int, label string")
    got = sampling.downsample_to_minimum(rows, "label", ["id"], 2).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"a": 15, "b": 15}
    assert sampling.downsample_to_minimum(rows.limit(0), "label", ["id"], 2).collect() == []


def test_rows_are_not_exchanged(labelled):
    """The plan of the result compares rows with their threshold; counts were exchanged before."""
    plan = sampling.downsample_to_minimum(labelled, "label", ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
