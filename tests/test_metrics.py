import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions.arrays import entropy, softmax, top_indices
from voxlake.operators import metrics as M
from voxlake.operators.ranking import exact_quantiles, rank_by_hash
from voxlake.operators.scoring import prediction_rows, score_samples, with_predictions
from voxlake.plans.reports import evaluate, prediction_reports


def scored(spark, rows):
    return with_predictions(spark.createDataFrame(rows, "example_id int, logits array<double>, label int"), 2)


def test_reference_metric_vectors(spark):
    df = scored(spark, [(0, [2.0, 1.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 1), (3, [0.0, 1.0], 1)])
    cells = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion(df, [0, 1], "label", "predicted").collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    row = M.evaluate(df, ["balanced_accuracy", "top1", "accuracy", "confusion", "auroc", "prauc"], "residue_identity", 2).first()
    assert row["balanced_accuracy"] == 0.75 and row["top1"] == 0.75 and row["num_examples"] == 4
    assert abs(row["auroc"] - 0.75) < 1e-12 and abs(row["prauc"] - 2 / 3) < 1e-12
    with pytest.raises(ValueError):
        M.evaluate(df, ["accuracy"], "regression")
    with pytest.raises(ValueError):
        M.evaluate(df, ["nonsense"], "residue_identity", 2)


def test_group_accuracy(spark):
    df = spark.createDataFrame([(0, 2), (3, 4), (19, 19)], "label int, predicted int")
    assert M.group_accuracy(df).first()[0] == 1.0
    assert abs(M.accuracy(df).first()[0] - 1 / 3) < 1e-12
    assert M.accuracy(df.limit(0)).first()[0] == 0.0


def test_softmax_entropy_topk(spark):
    r = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "l array<double>").select(
        softmax(F.col("l")).alias("p"), top_indices(F.col("l"), 3).alias("t"), entropy(softmax(F.col("l"))).alias("e")).first()
    want = np.exp([1, 3, 3, 0]) / np.exp([1, 3, 3, 0]).sum()
    assert np.allclose(r["p"], want) and r["t"] == [1, 2, 0]
    assert abs(r["e"] + (want * np.log(want + 1e-12)).sum()) < 1e-12


def test_calibration_edge(spark):
    df = spark.createDataFrame([(0.3, True), (1.0, False), (0.0, True)], "confidence double, correct boolean")
    bins = {r["bin"]: r["n"] for r in M.calibration_bins(df, 10).collect()}
    assert bins[2] == 1 and bins[3] == 0 and bins[9] == 1 and bins[0] == 1 and len(bins) == 10
    hist = {(r["series"], r["bin"]): r["n"] for r in M.confidence_histogram(df).collect()}
    assert hist[("all", 19)] == 1 and len(hist) == 60


def test_quantiles_and_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 5.0), ("b", 5.0)], "g string, v double")
    q = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert [q[("a", p)] for p in (0.0, 0.25, 0.5, 1.0)] == [1, 1.75, 2.5, 10]
    assert q[("b", 0.25)] == 5.0
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=3000), 2)
    big = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["q"]: r["quantile"] for r in exact_quantiles(big, [], "v", [0.1, 0.5, 0.77]).collect()}
    for p, v in got.items():
        assert abs(v - np.quantile(values, p)) < 1e-9
    ranked = rank_by_hash(big.withColumn("id", F.monotonically_increasing_id()), [], ["id"], 3)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 3001))


def test_entropy_summary_of_nothing_is_nan(spark):
    empty = spark.createDataFrame([], "entropy double, confidence double, correct boolean")
    row = M.entropy_summary(empty).first()
    assert row["num_samples"] == 0 and math.isnan(row["mean_entropy"]) and math.isnan(row["median_entropy"])


def test_scoring_and_reports(spark):
    samples = spark.createDataFrame(
        [(f"v/S1__A:{i}:HIS.npz", i % 3, [2, 1, 1, 1], [float(i % 3), 1.0]) for i in range(9)],
        "sample_path string, label int, shape array<int>, x array<float>")
    norm = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0])], "mean array<double>, std array<double>")

    def scorer(block):
        out = np.zeros((len(block), 3))
        out[np.arange(len(block)), block[:, 0].ravel().astype(int)] = 4.0
        return out

    row = evaluate(samples, norm, scorer, "residue_identity", 3).first()
    assert row["accuracy"] == 1.0 and row["top5"] == 1.0
    meta = samples.withColumns({c: F.lit("") for c in ("structure_id", "chain_id", "res_no", "res_name", "example_id")})
    rows = prediction_rows(with_predictions(score_samples(meta, scorer), 2), F.col("sample_path"))
    first = rows.orderBy("site").first()
    assert first["structure_name"] == "S1" and first["site"] == "A:0:HIS" and first["predicted"] == "His"
    assert first["predicted_type"] == "Positively Charged" and first["topk"][0]["label"] == "His"
    tables = prediction_reports(rows, "site")
    assert {r["amino_acid"]: r["support"] for r in tables["support"].collect()}["His"] == 3
    per = {r["amino_acid"]: r for r in tables["per_class"].collect()}
    assert per["His"]["f1"] == 1.0 and abs(per["__macro_avg__"]["recall"] - 3 / 20) < 1e-12
    assert per["__weighted_avg__"]["recall"] == 1.0 and tables["confusions"].count() == 0
    assert tables["type_accuracy"].first()[0] == 1.0
    assert len(K.REPORT_NAMES) == 20


def test_principal_components(spark):
    from voxlake.operators.embeddings import pca_2d, principal_variances
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, vec array<double>")
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    got = principal_variances(df, "vec", 5).first()
    assert np.allclose([got["var1"], got["var2"]], want, rtol=1e-6)
    centred = x - x.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    first = np.array([r["pc1"] for r in pca_2d(df, "vec").orderBy("id").collect()])
    assert np.allclose(np.abs(first), np.abs(centred @ vt[0]), atol=1e-6)
    one = spark.createDataFrame([([2.0],)], "vec array<double>")
    assert pca_2d(one, "vec").first()["pc2"] == 0.0
