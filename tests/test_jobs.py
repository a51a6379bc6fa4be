"""Jobs that own their outputs: ledgers, caches, activity files, reports."""

import numpy as np
import pytest
from helpers import atom_line
from pyspark.sql import functions as F

from voxlake.functions.columns import ManifestError
from voxlake.operators import access, activity
from voxlake.operators.voxels import VoxelConfig
from voxlake.plans.reports import annotate_sasa, prediction_reports
from voxlake.plans.voxels import build_activity_files
from voxlake.streaming.incremental import append_ledgers, first_of_stream, ledgers, present_files, run_ledgers


def test_ledgers_retry_what_is_missing(spark, tmp_path):
    root, pages, out = tmp_path / "pdb", tmp_path / "pages", str(tmp_path / "out")
    root.mkdir()
    pages.mkdir()

    def run():
        stream = spark.readStream.schema("value string").text(str(pages)).select(F.col("value").alias("accession"))
        run_ledgers(spark, stream, present_files(str(root)), out)
        got, missing = ledgers(spark, out)
        return {r["accession"]: r["batch"] for r in got.collect()}, sorted(r["accession"] for r in missing.collect())

    (root / "AF-Q1-F1-model_v6.pdb").write_text("x")
    (pages / "1.txt").write_text("Q1\n Q2 \n\nQ3\n")
    assert run() == ({"Q1": 0}, ["Q2", "Q3"])
    assert run() == ({"Q1": 0}, ["Q2", "Q3"])  # nothing new, nothing done
    (root / "AF-Q3-F1-model_v6.pdb").write_text("x")
    (pages / "2.txt").write_text("Q4\n")
    assert run() == ({"Q1": 0, "Q3": 1}, ["Q2", "Q4"])


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    wanted = spark.createDataFrame([("A",), ("B",)], "accession string")
    files = spark.createDataFrame([("/x/AF-A-F1-model_v6.pdb",)], "path string")
    for _ in range(2):
        append_ledgers(wanted, files, 0, out)
    assert spark.read.parquet(f"{out}/downloaded").count() == 1 and spark.read.parquet(f"{out}/not_downloaded").count() == 1
    append_ledgers(wanted.limit(0), files.limit(0), 1, out)
    assert [r["accession"] for r in ledgers(spark, out)[1].collect()] == ["B"]


def test_first_file_of_each_id_is_state(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run(rows, name):
        spark.createDataFrame(rows, "structure_id string, pdb_path string, v int").coalesce(1).write.parquet(str(source / name))
        stream = spark.readStream.schema("structure_id string, pdb_path string, v int").parquet(f"{source}/*")
        query = first_of_stream(stream).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}/c").format("parquet").option("path", f"{out}/d").start()
        query.awaitTermination()
        return sorted((r["structure_id"], r["pdb_path"], r["v"]) for r in spark.read.parquet(f"{out}/d").collect())

    assert run([("a", "2", 1), ("a", "1", 2), ("b", "9", 3)], "x") == [("a", "1", 2), ("b", "9", 3)]
    assert run([("a", "0", 4), ("c", "5", 5)], "y") == [("a", "1", 2), ("b", "9", 3), ("c", "5", 5)]


def test_cache_is_joined_where_it_lies(spark, tmp_path):
    keys = "structure_id string, chain_id string, res_no string, res_name string"
    scores = spark.createDataFrame([(f"S{i}", "A", str(i), "HIS", float(i)) for i in range(50)], f"{keys}, abs_total double")
    wanted = spark.createDataFrame([(f"S{i}", "A", str(i), "HIS") for i in range(40, 60)], keys)
    cache = access.write_cache(scores, "score_cache_of_test", str(tmp_path / "cache"), 4)
    missing = access.missing_from_cache(wanted, cache, 4)
    assert sorted(r["structure_id"] for r in missing.collect()) == [f"S{i}" for i in range(50, 60)]
    plan = missing._jdf.queryExecution().executedPlan().toString()
    # one exchange, of the requested residues; the plan shows its initial and its final form
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 2 and "res_name#" in plan
    assert "abs_total" not in plan
    assert access.missing_from_cache(wanted, scores).count() == 10


def toy(res, name="GLY"):
    return "\n".join([
        atom_line(1, "N", name, "A", res, 0, 0, 0, "N"), atom_line(2, "CA", name, "A", res, 1, 0, 0, "C"),
        atom_line(3, "C", name, "A", res, 1.5, 1, 0, "C"), atom_line(4, "O", name, "A", res, 1.3, 2.1, 0, "O"),
        atom_line(5, "CA", "ALA", "A", res + 1, 3, 3, 3, "C")])


def test_last_path_of_an_activity_structure_wins(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(toy(1))
    (tmp_path / "b.pdb").write_text(toy(7))
    (tmp_path / "never.pdb").write_text("not opened")
    rows = spark.createDataFrame(
        [(1, "S1", "a.pdb", "A", "7", "0.5"), (2, "S1", str(tmp_path / "b.pdb"), "A", "1", "0.7"), (3, "S2", "gone.pdb", "A", "1", "1")],
        "row_no int, structure_id string, pdb_path string, chain_id string, res_no string, label string")
    paths = {r["structure_id"]: r["pdb_path"] for r in activity.structure_paths(rows, str(tmp_path)).collect()}
    assert paths == {"S1": str(tmp_path / "b.pdb"), "S2": str(tmp_path / "gone.pdb")}
    built = build_activity_files(rows, str(tmp_path), VoxelConfig(box_size=10.0), out=str(tmp_path / "manifest"))
    assert [(r["row_no"], r["value"]) for r in built.packed.collect()] == [(1, 0.5)]
    assert {r["skip"]: r["n"] for r in built.skipped.collect()} == {"missing_residue": 1, "missing_structure": 1}
    manifest = spark.read.option("header", True).csv(str(tmp_path / "manifest"))
    assert manifest.count() == 1 and manifest.first()["sample_path"].startswith(str(tmp_path))
    with pytest.raises(ManifestError):
        activity.structure_paths(rows.withColumn("pdb_path", F.lit("")), str(tmp_path)).count()


def test_reports_write_what_they_own(spark, tmp_path):
    rng = np.random.default_rng(0)
    names = ["His", "Lys", "Arg"]
    rows = [(f"S{i}", f"A:{i}:HIS", names[i % 3], names[int(rng.integers(3))], "Positively Charged", "Positively Charged", 0.5, 0.9) for i in range(30)]
    predictions = spark.createDataFrame(rows, "structure_name string, site string, actual string, predicted string, actual_type string, predicted_type string, entropy double, confidence double")
    tables = prediction_reports(predictions, "site", out=str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report" / "predictions")).count() == 30
    for name in tables:
        assert (tmp_path / "report" / name / "_SUCCESS").exists(), name
    head = spark.read.option("header", True).csv(str(tmp_path / "report" / "per_class"))
    assert head.count() == tables["per_class"].count()


def test_augmented_predictions_are_written(spark, tmp_path):
    predictions = spark.createDataFrame(
        [(1, "S1", "A:1:HIS", "His", "His", ["His", "Lys"]), (2, "S1", "odd", "Lys", "Arg", ["Arg", "Lys"])],
        "row_no int, structure_name string, site string, actual string, predicted string, topk array<string>")
    manifest = spark.createDataFrame([(1, "S1", "A", "1", "HIS")], "row_no int, structure_id string, chain_id string, res_no string, res_name string")
    scores = spark.createDataFrame([("S1", "A", "1", "HIS", 10.0, 0.1)], "structure_id string, chain_id string, res_no string, res_name string, abs_total double, rel_total double")
    annotate_sasa(predictions.withColumn("topk_labels", F.array_join("topk", "|")), manifest, scores, bins=1, out=str(tmp_path / "sasa"))
    summary = spark.read.json(str(tmp_path / "sasa" / "summary")).first()
    assert summary["matched_residues"] == 1 and (tmp_path / "sasa" / "bins" / "_SUCCESS").exists()
    written = spark.read.option("header", True).csv(str(tmp_path / "sasa" / "predictions"))
    assert written.count() == 2 and set(access.ADDED) <= set(written.columns)
