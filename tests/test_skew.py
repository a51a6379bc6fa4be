"""The lookup join against a plain join; heavy keys are dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from voxlake.operators import skew


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(3)
    rows = [(7 if rnd.random() < 0.5 else rnd.randrange(300), i, None if i % 50 == 0 else "x") for i in range(6000)]
    rows += [(None, 10_000 + i, "x") for i in range(2000)]
    lookup = [(k, k * 2, "x") for k in range(0, 250)] + [(7, -1, "x"), (None, 5, "x")]
    return spark.createDataFrame(rows, "k int, i int, p string"), spark.createDataFrame(lookup, "k int, v int, p string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_plain_join(sides, how):
    rows, lookup = sides
    for on in (["k"], ["k", "p"]):
        right = lookup if len(on) == 2 else lookup.drop("p")
        got, want = skew.lookup_join(rows, right, on, how, deal=["i"]), rows.join(right, on, how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_task_reads_much_more_than_the_median(spark, sides):
    """One key has half of all rows; after the deal no partition has over twice the median."""
    rows, lookup = sides
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.lookup_join(rows.where("k is not null").select("k", "i"), lookup.drop("p"), ["k"], "left", deal=["i"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_empty_sides(spark, sides):
    rows, lookup = sides
    assert skew.lookup_join(rows.limit(0), lookup.drop("p"), ["k"]).count() == 0
    assert skew.lookup_join(rows, lookup.drop("p").limit(0), ["k"], "left", deal=["i"]).count() == rows.count()
    with pytest.raises(ValueError):
        skew.lookup_join(rows, lookup, ["k"], "full")
