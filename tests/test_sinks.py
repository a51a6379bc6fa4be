import numpy as np
import pytest

from tests.test_manifests import dat
from tests.test_voxels import ATOMS, TOY
from voxlake import constants as K
from voxlake.functions.columns import ManifestError
from voxlake.operators.metrics import confusion
from voxlake.plans.datasets import feature_dataset
from voxlake.plans.voxels import sasa_table
from voxlake.sources.sinks import (
    augmented_columns, prediction_columns, site_violations, wide_confusion, write_predictions, write_report,
    write_structures,
)


def test_prediction_text(spark, tmp_path):
    df = spark.createDataFrame(
        [("S1", "A:1:HIS", "His", "", "Positively Charged", "Unknown", 0.12345678, 0, None, 0.9, [(0, "His", 0.9), (1, "Lys", 0.1)])],
        "structure_name string, site string, predicted string, actual string, predicted_type string, actual_type string, "
        "entropy double, predicted_index int, actual_index int, confidence double, topk array<struct<idx:int,label:string,prob:double>>")
    row = prediction_columns(df, output_probs=True).first()
    assert row["entropy"] == "0.123457" and row["topk_labels"] == "His|Lys" and row["actual_index"] == ""
    write_predictions(df, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).first()["entropy"] == "0.123457"
    write_report(df.select("site"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    assert augmented_columns(df, ["site", "entropy"], ["entropy", "actual"]).columns == ["site", "entropy", "actual"]


def test_wide_confusion(spark):
    df = spark.createDataFrame([("His", "Lys"), ("His", "Lys"), ("Lys", "Lys"), ("Zzz", "His")], "actual string, predicted string")
    wide = {r["actual/predicted"]: (r["His"], r["Lys"]) for r in wide_confusion(confusion(df, ["His", "Lys"]), ["His", "Lys"], "actual/predicted").collect()}
    assert wide == {"His": (0, 2), "Lys": (0, 1)}


def test_site_rules(spark):
    row = {f: "x" for f in K.SITE_FIELDS}
    good = spark.createDataFrame([{**row, "sample_path": "a.npz"}])
    bad = spark.createDataFrame([{**row, "sample_path": "a.npz", "label": "a\nb"}, {**row, "sample_path": "a.pdb"}])
    assert site_violations(good).count() == 0
    assert sorted(r["rule"] for r in site_violations(bad).collect()) == ["embedded newline", "sample path without .npz"]
    files = spark.createDataFrame([("b.npz",)], "path string")
    assert site_violations(good, files).first()["rule"] == "missing file"
    with pytest.raises(ManifestError):
        site_violations(good.drop("task"))
    empty = spark.createDataFrame([], "pdb_id string, pdb_path string, chains array<string>, num_residues int, sequence string")
    with pytest.raises(ManifestError):
        write_structures(empty, "/tmp/never-written")


def test_feature_matrices(spark, tmp_path):
    for part, v in ((0, 1.0), (1, 3.0)):
        dat(tmp_path / f"FEATURE_train_X_{part}.dat", np.full((2, 3), v, np.float32))
        dat(tmp_path / f"FEATURE_train_y_{part}.dat", np.full(2, part, np.float32))
    dat(tmp_path / "FEATURE_val_X.dat", np.full((1, 3), 5.0, np.float32))
    dat(tmp_path / "FEATURE_val_y.dat", np.zeros(1, np.float32))
    rows = {(r["split"], r["part"], r["sample_index"]): r["x"] for r in feature_dataset(spark, str(tmp_path)).collect()}
    assert rows[("train", 0, 0)] == [-1.0] * 3 and rows[("val", 0, 0)] == [3.0] * 3


def test_sasa_table(spark):
    rows = {r["res_name"]: r for r in sasa_table(spark.createDataFrame(TOY, ATOMS)).collect()}
    assert abs(rows["SER"]["rel_total"] - rows["SER"]["abs_total"] / 155.0) < 1e-12
