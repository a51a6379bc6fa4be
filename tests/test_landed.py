"""Landed frames leave no shuffle files behind; what travels in a dedupe gives back whole rows."""

import time

from pyspark.sql import functions as F

from voxlake.operators import quality
from voxlake.runtime import TIDY, landed


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_the_job_that_lands_a_frame(spark):
    before, setting = shuffle_files(spark), spark.conf.get(TIDY, None)
    summed = spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    rows = landed(summed, "test-landed")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(TIDY, None) == setting
    assert {r["k"]: r["s"] for r in rows.collect()} == {k: sum(range(k, 5000, 7)) for k in range(7)}
    assert summed.count() == 7  # the frame itself can be run again


def test_preferred_rows_come_back_as_they_were(spark):
    names = ["example_id", "structure_id", "chain_id", "res_no", "res_name", "label", "sample_path", "task", "channel_scheme"]
    rows = [
        (" e1", "S", "A", "1", "GLY", "3", " v/a.npz", "t", "c", "manifest", None, 1),
        ("e1", None, "A", "1", "GLY", "3", "v/a.npz ", "t", "c", "manifest", None, 2),  # less complete
        (None, "S", "A", "1", "GLY", "3", "v/b.npz", "t", "c", "disk", False, 3),
        ("", "S", "A", "1", "GLY", "3", "v/c.npz", "t", "c", "manifest", True, 4),
        ("", "S", "A", "1", "GLY", "3", "v/c.npz", "t", "c", "disk", False, 0),  # the earlier row lends its position
        ("e\n2", "S", "A", "1", "GLY", None, "v/d.npz", "t", "c", "disk", True, 6),
        ("e 2", "S", "A", "1", "GLY", "3", "v/e.npz", "t", "c", "manifest", True, 5),  # the same id, not from disk
        ("e3", "S", "A", "1", "GLY", "3", " ", "t", "c", "disk", True, 7),  # no path
    ]
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*names, "source"]) + ", validated boolean, pos int")
    kept = quality.preferred_rows(table)
    assert kept.columns == table.columns
    want = {rows[0], rows[2], (*rows[3][:-1], 0), (*rows[5][:-1], 5)}
    assert {tuple(r) for r in kept.collect()} == want
    moved = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in moved  # a row travels once, with its rank, not beside it
