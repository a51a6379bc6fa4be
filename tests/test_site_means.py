"""Means over the sites of a group, and atoms that two branches of a plan share."""

import random

import pytest
from pyspark.sql import functions as F

from voxlake.catalog import views as V
from voxlake.catalog.voxels import RELAXED, centres
from voxlake.operators.voxels import box_join, mean_over_sites


def test_means_count_every_site_and_travel_as_lists(spark):
    draw, rows = random.Random(5), []
    for group, sites in (("one", 1), ("some", 7), ("large", 300), (None, 3)):
        for site in range(sites):
            cells = {tuple(draw.randrange(n) for n in (4, 20, 20, 3)) for _ in range(draw.randrange(1, 9))}
            rows += [(group, "A", site if site else None, *c, float(draw.randrange(1, 4))) for c in cells]
    rows.append(("one", "A", None, 65535, 65535, 0, 65535, 2.0))
    cells = spark.createDataFrame(rows, "g string, chain string, no int, ch int, ix int, iy int, iz int, v double")
    mean = mean_over_sites(cells, ["g"], ["chain", "no"])
    assert mean.columns == ["g", "ch", "ix", "iy", "iz", "v"]
    want, sites = {}, {}
    for g, chain, no, *cell, v in rows:
        if g is not None:  # a group without a name has no mean
            want[(g, *cell)] = want.get((g, *cell), 0.0) + v
            sites.setdefault(g, set()).add((chain, no))
    got = {tuple(r)[:5]: r["v"] for r in mean.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v / len(sites[k[0]])) for k, v in want.items())
    assert "MapInArrow" in mean._jdf.queryExecution().executedPlan().toString()  # no exchange of a row for each cell
    assert mean_over_sites(cells.where("false"), ["g"], ["chain", "no"]).collect() == []


def test_centres_and_neighbours_share_one_exchange_of_the_atoms(spark, tmp_path):
    spark.range(400).select(
        (F.col("id") % 31).alias("l_orderkey"), (F.col("id") * 7).alias("l_partkey"), (F.col("id") % 3).alias("l_suppkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity"),
        F.lit("A").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = box_join(centres(spark, str(tmp_path)), V.atoms(spark, str(tmp_path)), RELAXED)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
