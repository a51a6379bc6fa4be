import io
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import atom_line, ca_text, write
from voxlake.catalog import manifests
from voxlake.functions.columns import (
    ManifestError, coerce_label, first_alias, infer_metadata, is_blank, labels_match, npz_hits, sample_path_column, sanitize,
)
from voxlake.operators import access, quality, stats
from voxlake.operators.sampling import downsample_to_minimum
from voxlake.operators.voxels import VoxelConfig
from voxlake.plans import checks, datasets
from voxlake.plans.reports import annotate_sasa, annotate_sasa_files
from voxlake.sources.manifests import (
    list_files, read_accession_pages, read_id_list, read_manifest, read_sasa_cif, read_scop,
)
from voxlake.sources.samples import load_split_parts, read_samples, shard_files
from voxlake.sources.sinks import write_report_tables
from voxlake.streaming.incremental import build_incremental, reconcile_accessions


def npz(path, **arrays):
    path.parent.mkdir(parents=True, exist_ok=True)
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    path.write_bytes(buffer.getvalue())


def dat(path, array):
    path.parent.mkdir(parents=True, exist_ok=True)
    buffer = io.BytesIO()
    np.save(buffer, array)
    path.write_bytes(buffer.getvalue())


def test_aliases(spark):
    df = spark.createDataFrame([("", "x")], "structure_id string, pdb_id string")
    assert df.select(first_alias(df, ["structure_id", "pdb_id", "id"]).alias("v")).first()["v"] == "x"
    with pytest.raises(ManifestError):
        first_alias(df, ["nope"])
    with pytest.raises(ManifestError):
        sample_path_column(spark.createDataFrame([("a",)], "pdb_path string"))


def test_label_rules(spark):
    df = spark.createDataFrame([("3.9", 3.0), ("", 0.0), ("x", 1.0)], "t string, y double")
    got = [r[0] for r in df.select(coerce_label(F.col("t"), "residue_identity")).collect()]
    assert got == ["3", "", None]
    same = df.select(labels_match(F.lit("1.0"), F.lit(1.000001), "regression").alias("a"),
                     labels_match(F.lit("nan"), F.lit(float("nan")), "regression").alias("b"),
                     labels_match(F.lit("2"), F.lit(3.0), None).alias("c")).first()
    assert same["a"] and same["b"] and not same["c"]


def test_metadata_from_paths(spark):
    df = spark.createDataFrame([("/r/S_1/a_b_A_12_HIS.npz",), ("/r/bad.npz",), ("/q/P/x_A_-3_GLY.npz",)], "p string")
    m = [r["m"] for r in df.select(infer_metadata(F.col("p"), "/r").alias("m")).collect()]
    assert (m[0]["structure_id"], m[0]["chain_id"], m[0]["res_no"], m[0]["res_name"]) == ("S_1", "A", "12", "HIS")
    assert not m[1]["parse_clean"] and m[2]["structure_id"] == "P" and m[2]["res_no"] == "-3"


HEADER = "example_id,structure_id,chain_id,res_no,res_name,label,sample_path,task,channel_scheme"


def site(name, label="0", path=None):
    return f"{name},S1,A,1,HIS,{label},{path or f'S1/{name}.npz'},t,element4"


def test_validation_of_real_files(spark, tmp_path):
    npz(tmp_path / "S1" / "a_A_1_HIS.npz", x=np.zeros((4, 2, 2, 2)), y=np.int64(0))
    npz(tmp_path / "S1" / "b_A_1_HIS.npz", x=np.zeros((3, 2, 2, 2)), y=np.int64(5))
    npz(tmp_path / "S1" / "c_A_1_HIS.npz", z=np.zeros(3))
    (tmp_path / "S1" / "d_A_1_HIS.npz").write_bytes(b"junk")
    lines = [HEADER, site("a_A_1_HIS"), site("b_A_1_HIS"), site("c_A_1_HIS"), site("d_A_1_HIS"), site("gone"),
             site("a_A_1_HIS"), site("q", label=""), "broken,row", site("r", path="x.txt"), '"q,1",S1,A,2,HIS,0,S1/a_A_1_HIS.npz,t,e']
    manifest = write(tmp_path / "m", "manifest.csv", "\n".join(lines) + "\n")
    summary, errors = checks.validate_manifest(spark, str(manifest), str(tmp_path), "residue_identity", 4, 2)
    row = summary.first().asDict()
    assert row["total_rows_scanned"] == 10 and row["rows_validated"] == 7 and not row["validation_passed"]
    assert (row["corrupted_rows"], row["missing_files"], row["unreadable_files"], row["npz_missing_x"]) == (1, 1, 1, 1)
    assert (row["label_mismatches"], row["shape_mismatches"]) == (1, 1)
    assert (row["duplicate_paths"], row["duplicate_example_ids"], row["duplicate_residue_keys"]) == (2, 1, 5)


def test_repair_is_idempotent(spark, tmp_path):
    root = tmp_path / "v"
    npz(root / "S1" / "S1_A_1_HIS.npz", x=np.zeros((4, 2, 2, 2)), y=np.int64(0))
    npz(root / "S1" / "S1_A_2_LYS.npz", x=np.zeros((4, 2, 2, 2)), y=np.int64(1))
    two = f"{root}/S1/S1_A_1_HIS.npz"
    lines = [HEADER, f"S1_A_1_HIS,S1,A,1,HIS,0,{two},t,e", f"junk {two} and {root}/S1/S1_A_2_LYS.npz", "nothing,here"]
    manifest = write(tmp_path / "m", "manifest.csv", "\n".join(lines) + "\n")
    rows, summary = checks.repair_manifest(
        spark, str(root), str(tmp_path / "out.csv"), "residue_identity", "element4", str(manifest),
        dedupe=True, validate=True, infer_labels=True)
    got = sorted((r["example_id"], r["label"], r["res_name"]) for r in rows.collect())
    assert got == [("S1_A_1_HIS", "0", "HIS"), ("S1_A_2_LYS", "1", "LYS")]
    s = summary.first().asDict()
    assert s["likely_concatenated_rows_detected"] == 1 and s["parse_failures"] == 1
    assert s["rows_written"] == 2 and s["files_discovered_on_disk"] == 2 and s["duplicates_removed"] == 3
    again, _ = checks.repair_manifest(spark, str(root), None, "residue_identity", "element4", dedupe=True,
                                      validate=True, infer_labels=True)
    assert sorted((r["example_id"], r["label"], r["res_name"]) for r in again.collect()) == got


def test_leakage_job(spark, tmp_path):
    paths = {}
    for name, ids in (("train", "ab"), ("val", "c"), ("test", "da")):
        paths[name] = str(write(tmp_path, f"{name}.csv", "structure_id,split\n" + "".join(f"{i},{name}\n" for i in ids)))
    report = checks.check_leakage(spark, paths).first()
    assert report["overlap_train__test"] == 1 and report["dup_train"] == 0 and report["has_issues"]
    with pytest.raises(ManifestError):
        checks.check_leakage(spark, paths, ["missing"])
    read_manifest(spark, paths["train"]).write.parquet(str(tmp_path / "m.parquet"))
    assert read_manifest(spark, str(tmp_path / "m.parquet")).count() == 2
    with pytest.raises(ManifestError):
        read_manifest(spark, "x.json")


def test_text_sources(spark, tmp_path):
    scop = write(tmp_path, "scop.txt", "#\n" * 5 + "d1 1abc A: f.1 x\nd2 2abc B: f.2 x\n")
    assert [tuple(r) for r in read_scop(spark, str(scop)).orderBy("sid").collect()] == [("d1", "1abc", "f.1"), ("d2", "2abc", "f.2")]
    train, test = write(tmp_path, "tr.txt", "1ABC x\n"), write(tmp_path, "te.txt", "2abc\n1abc\n")
    assert read_id_list(spark, str(test)).count() == 2
    assert [r["family"] for r in checks.family_leakage(spark, str(scop), str(train), str(test)).collect()] == ["f.1"]
    cif = write(tmp_path / "cif", "1abcX.cif", "a 1 ALA 9 9\n_freeSASA_rsa.rel_polar\nA 5 ALA 10.0 0.5\nA 6 ZZZ 1 1\n")
    assert [tuple(r) for r in read_sasa_cif(spark, str(cif)).collect()] == [("1abc", "5", "A", "10.0", "0.5")]
    page = write(tmp_path, "p.json", json.dumps({"results": [{"metadata": {"accession": "Q1"}}, {"metadata": {"accession": "Q2"}}]}))
    wanted = read_accession_pages(spark, str(page))
    write(tmp_path / "pdb", "AF-Q1-F1-model_v6.pdb", "x")
    landed, missing = reconcile_accessions(wanted, list_files(spark, str(tmp_path / "pdb")))
    assert [r[0] for r in landed.collect()] == ["Q1"] and [r[0] for r in missing.collect()] == ["Q2"]


def test_normalisation_of_samples(spark, tmp_path):
    dat(tmp_path / "shard.dat", np.stack([np.zeros((2, 2, 2, 2)), np.full((2, 2, 2, 2), 2.0)]).astype(np.float32))
    manifest = spark.createDataFrame([("shard.dat", "0"), ("shard.dat", "1")], "sample_path string, sample_index string")
    row = datasets.compute_normalization(read_samples(spark, manifest, str(tmp_path)), "per-channel").first()
    assert row["mean"] == [1.0, 1.0] and row["std"] == [1.0, 1.0] and row["num_samples"] == 2
    npz(tmp_path / "e" / "one.npz", x=np.full((9, 9, 9, 2), 4.0), y=np.int64(0))
    one = spark.createDataFrame([("e/one.npz", "0")], "path string, label string")
    got = read_samples(spark, one, str(tmp_path)).first()
    assert got["shape"] == [2, 9, 9, 9] and got["y"] == 0.0
    capped = datasets.compute_normalization(
        spark.createDataFrame([(str(i), [float(v)] * 8, [1, 2, 2, 2]) for i, v in enumerate((0, 1, 3))],
                              "sample_path string, x array<float>, shape array<int>"), "global", 2).first()
    assert capped["num_samples"] == 2 and len(capped["mean"]) == 1
    scaled = stats.normalize(
        spark.createDataFrame([([2.0, 4.0],)], "x array<float>"),
        spark.createDataFrame([([1.0, 1.0], [1.0, 3.0])], "mean array<double>, std array<double>")).first()
    assert scaled["x"] == [1.0, 1.0]


def test_prepared_dataset(spark, tmp_path):
    for split, name, n, v in (("train", "HIS_0", 4, 1.0), ("train", "LYS_0", 4, 3.0), ("test", "HIS_9", 2, 5.0), ("train", "QQQ_1", 2, 9.0)):
        dat(tmp_path / split / f"{name}.dat", np.full((n, 2, 2), v, np.float32))
    row = datasets.prepare_dataset(spark, str(tmp_path), str(tmp_path / "out"), 0.25, "weighted_loss").first()
    assert np.allclose(row["mean"], 2.0) and np.allclose(row["std"], 1.0) and row["num_samples"] == 6
    assert row["class_weights"] == [1.0, 1.0]
    sizes = {n: spark.read.option("header", True).csv(str(tmp_path / "out" / f"manifest_{n}.csv")).count() for n in ("train", "val", "test")}
    assert sizes == {"train": 6, "val": 2, "test": 2}
    labels = spark.createDataFrame([(0, i) for i in range(4)] + [(1, i) for i in range(2)], "label int, id int")
    assert {r["label"]: r["count"] for r in downsample_to_minimum(labels, "label", ["id"], 1).groupBy("label").count().collect()} == {0: 2, 1: 2}
    weights = stats.class_weights(spark.createDataFrame([(0,), (0,), (1,)], "label int")).orderBy("label").collect()
    assert [w["weight"] for w in weights] == [0.75, 1.5]


def test_bundles(spark, tmp_path):
    root = tmp_path / "in"
    for shard, labels in ((1, [1, 2]), (2, [3])):
        dat(root / "train" / f"X_smooth{shard}_1.dat", np.ones((len(labels), 4, 2, 2, 2), np.float32))
        dat(root / "train" / f"y{shard}_1.dat", np.array(labels, dtype=np.float32).reshape(-1, 1))
    for p, labels in (("v", [4, 5]), ("t", [6])):
        dat(root / "x" / f"X{p}_smooth_1.dat", np.ones((len(labels), 4, 2, 2, 2), np.float32))
        dat(root / "x" / f"y{p}_1.dat", np.array(labels, dtype=np.float32))
    rows = load_split_parts(shard_files(spark, str(root))).orderBy("split", "shard", "sample_index").collect()
    assert [(r["split"], r["label"]) for r in rows] == [("test", 6), ("train", 1), ("train", 2), ("train", 3), ("val", 4), ("val", 5)]
    datasets.convert_bundles(spark, str(root), str(tmp_path / "out"), ["train", "val", "test"], [1], 2, {"channels": 4, "class_map": {"HIS": 0}})
    meta = {r["split"]: r for r in spark.read.json(str(tmp_path / "out" / "metadata")).collect()}
    assert meta["train"]["data_shape"] == [3, 4, 2, 2, 2] and meta["val"]["channels"] == 4
    for splits, parts, shards in ((["train"], [1, 2], None), (["train"], [1], 3), (["holdout"], [1], None)):
        with pytest.raises(ManifestError):
            datasets.convert_bundles(spark, str(root), str(tmp_path / "o2"), splits, parts, shards)
    dat(root / "train" / "X_smooth27_1.dat", np.ones((2, 4, 2, 2, 2), np.float32))
    for labels, message in ((None, "no y file"), ([7], "2 samples, 1 labels")):
        if labels:
            dat(root / "train" / "y27_1.dat", np.array(labels, dtype=np.float32))
        with pytest.raises(ManifestError, match=message):
            datasets.convert_bundles(spark, str(root), str(tmp_path / "o2"), ["train"], [1])
    assert not (tmp_path / "o2").exists()
    dat(root / "train" / "y27_1.dat", np.array([7, 8], dtype=np.float32))
    datasets.convert_bundles(spark, str(root), str(tmp_path / "o3"), ["train"], [1])
    assert spark.read.parquet(str(tmp_path / "o3" / "data")).count() == 5  # a high shard number is no reason to drop it
    centred = datasets.legacy_atom_box(spark.read.parquet(str(tmp_path / "out" / "data")), 1)
    assert all(abs(v) < 1e-6 for r in centred.collect() for v in r["x"])


def test_sasa_annotation(spark):
    predictions = spark.createDataFrame([
        (1, "S1", "A:1:HIS", "His", "His", ["His", "Lys"]), (2, "S1", "A:2:LYS", "Lys", "Arg", ["Arg", "Lys"]),
        (3, "S1", "A:3:GLY", "Gly", "Ala", ["Ala"]), (4, "S1", "oops", "Gly", "Ala", ["Ala"]),
    ], "row_no int, structure_name string, site string, actual string, predicted string, topk array<string>")
    manifest = spark.createDataFrame([(1, "S1", "A", "1", "HIS"), (2, "S1", "A", "2", "ARG")],
                                     "row_no int, structure_id string, chain_id string, res_no string, res_name string")
    scores = spark.createDataFrame([("S1", "A", "1", "HIS", 10.0, 0.1), ("S1", "A", "2", "ARG", 20.0, 0.3)],
                                   "structure_id string, chain_id string, res_no string, res_name string, abs_total double, rel_total double")
    out = annotate_sasa(predictions, manifest, scores, bins=2)
    status = {r["row_no"]: r["status"] for r in out["annotated"].collect()}
    assert status == {1: "exact", 2: "fallback", 3: "no_match", 4: "invalid_site"}
    bins = [(r["bin_index"], r["support"], r["top1_accuracy"], r["top3_accuracy"]) for r in out["bins"].orderBy("bin_index").collect()]
    assert bins == [(0, 1, 1.0, 1.0), (1, 1, 0.0, 1.0)]
    s = out["summary"].first()
    assert (s["matched_residues"], s["residues_scored"], s["fallback_warnings"]) == (2, 2, 1)
    cached = annotate_sasa(predictions, manifest, scores, bins=2, cache=scores.limit(1))
    assert cached["new_scores"].count() == 1 and cached["annotated"].where("sasa_selected is not null").count() == 2
    held = annotate_sasa(predictions, manifest, scores, bins=2, structures=spark.createDataFrame([("S2",)], "structure_id string"))
    assert held["summary"].first()["missing_pdb_files"] == 1
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert access.bin_edges(flat, "v", "equal_frequency", 4).first()["edges"] == [5 - 5e-6, 5 + 5e-6]


def test_incremental_build(spark, tmp_path):
    def toy(res):
        return "\n".join([
            atom_line(1, "N", "GLY", "A", res, 0, 0, 0, "N"), atom_line(2, "CA", "GLY", "A", res, 1, 0, 0, "C"),
            atom_line(3, "C", "GLY", "A", res, 1.5, 1, 0, "C"), atom_line(4, "O", "GLY", "A", res, 1.3, 2.1, 0, "O"),
            atom_line(5, "CA", "ALA", "A", res + 1, 3, 3, 3, "C")])

    source, out = tmp_path / "in", str(tmp_path / "out")
    write(source, "s1.pdb", toy(1))
    config = VoxelConfig(box_size=10.0)
    assert build_incremental(spark, str(source), out, config).count() == 1
    write(source, "s2.pdb", toy(5))
    both = build_incremental(spark, str(source), out, config)
    assert sorted(r["example_id"] for r in both.select("example_id").collect()) == ["s1_A_1_GLY", "s2_A_5_GLY"]
    assert build_incremental(spark, str(source), out, VoxelConfig(box_size=8.0)).count() == 2
    write(source / "z", "s1.pdb", toy(1))  # the same id at a second, later path
    again = build_incremental(spark, str(source), out, config, overwrite=True)
    assert sorted(r["example_id"] for r in again.select("example_id").collect()) == ["s1_A_1_GLY", "s2_A_5_GLY"]
    write(source, "s1.pdb", toy(9))
    again = build_incremental(spark, str(source), out, config, overwrite=True)
    assert sorted(r["example_id"] for r in again.select("example_id").collect()) == ["s1_A_9_GLY", "s2_A_5_GLY"]
    assert build_incremental(spark, str(source), out, config).count() == 2
    assert spark.read.parquet(f"{out}/done").count() >= 4
    assert ca_text("A")


def test_split_fields_and_blank_lines(spark, tmp_path):
    lines = ["a,b", "a,", "", ",", '"x,y",z', '"say ""hi""",', 'a,"b"', "only"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    got = [r["fields"] for r in quality.with_fields(rows).orderBy("i").collect()]
    assert got == [["a", "b"], ["a", ""], [""], ["", ""], ["x,y", "z"], ['say "hi"', ""], ["a", "b"], ["only"]]
    path = tmp_path / "m.csv"
    path.write_text("path,label\nq.npz,1\n\nr.npz,2\n")
    summary, _ = checks.validate_manifest(spark, str(path), str(tmp_path), check_files=False)
    row = summary.first()
    assert (row["total_rows_scanned"], row["corrupted_rows"]) == (3, 1)
    report = quality.validation_report(*checks.validate_manifest(spark, str(path), str(tmp_path)), limit=1).first()
    assert (report["error_count"], report["error_limit"], len(report["errors"])) == (3, 1, 1)
    npz(tmp_path / "q.npz", x=np.zeros((4, 3, 3, 3)), y=np.array(1))
    summary, found = checks.validate_manifest(spark, str(path), str(tmp_path), "residue_identity", channels=5)
    assert sorted(r["code"] for r in found.collect()) == ["corrupted_row", "missing_file", "shape_mismatch"]


def test_report_tables(spark, tmp_path):
    table = spark.createDataFrame([("Ala", 0.5, [1.0, 2.0], 3)], "name string, share double, parts array<double>, n int")
    write_report_tables({"shares": table}, str(tmp_path))
    row = spark.read.option("header", True).csv(str(tmp_path / "shares")).first()
    assert tuple(row) == ("Ala", "0.500000", "1.0;2.0", "3")


def test_accessibility_from_a_folder(spark, tmp_path):
    write(tmp_path, "t1.pdb", "\n".join([atom_line(1, "N", "GLY", "A", 1, 0, 0, 0, "N"), atom_line(2, "CA", "GLY", "A", 1, 1.4, 0, 0, "C")]))
    predictions = spark.createDataFrame([(1, "t1", "A:1:GLY", "Gly", "Gly", ["Gly"]), (2, "t9", "A:1:GLY", "Gly", "Gly", ["Gly"])],
                                        "row_no int, structure_name string, site string, actual string, predicted string, topk array<string>")
    manifest = spark.createDataFrame([(1, "t1", "A", "1", "GLY"), (2, "t9", "A", "1", "GLY")],
                                     "row_no int, structure_id string, chain_id string, res_no string, res_name string")
    out = annotate_sasa_files(predictions, manifest, str(tmp_path), bins=1)
    row = out["summary"].first()
    assert (row["residues_scored"], row["missing_residues_reported"], row["missing_pdb_files"]) == (1, 1, 1)


def test_sample_paths_are_looked_for_at_token_starts_only(spark):
    texts = ["", "a.npz", ".npz", ".npz.npz", "x a.npzb.npz,c.npz\"d.npz'", "a.npz.npzz e.npy", "\ta.npz\x0bb.npz", "é.npz,,q"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["h"] for r in rows.select(npz_hits(F.col("t")).alias("h")).collect()]
    assert got == [re.findall(r"""[^,\s"']+\.npz""", t) for t in texts]
    assert "(?<!" in rows.select(npz_hits(F.col("t")))._jdf.queryExecution().toString()


def test_preferred_rows_rank_without_interpreted_lambdas(spark):
    values = ["", " ", "\r\n ", " a\nb ", "\t", None, "\u00a0"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = [tuple(r) for r in rows.select(sanitize(F.col("v")), is_blank(F.col("v"))).collect()]
    assert got == [("", True), ("", True), ("", True), ("a b", False), ("\t", False), ("", True), ("\u00a0", False)]
    plain = {f: "x" for f in manifests.HEADER}
    table = spark.createDataFrame([
        {**plain, "label": "\n", "source": "disk", "validated": True, "pos": 1}, {**plain, "label": "2", "source": "disk", "validated": True, "pos": 2},
        {**plain, "label": "3", "source": "manifest", "validated": True, "pos": 0}, {**plain, "sample_path": " ", "source": "disk", "validated": True, "pos": 3},
    ])
    best = quality.preferred_rows(table)
    assert [(r["label"], r["pos"]) for r in best.collect()] == [("2", 0)]
    assert "lambda" not in best._jdf.queryExecution().toString()


def test_validation_parses_the_manifest_once(spark, tmp_path, monkeypatch):
    rows = [(k, 10 + k % 3, 1 + k % 13, 1 + k % 4, "ANR"[k % 3], 0) for k in range(1, 400)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, n int"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    parsed, of = [], manifests.checked_rows
    monkeypatch.setattr(manifests, "checked_rows", lambda *a: parsed.append(1) or of(*a))
    row = manifests.validation_summary(spark, str(tmp_path)).first()
    assert len(parsed) == 1
    counted = {c: 0 for c in quality.COUNTERS.values()}
    for part in ("manifest_row_errors", "manifest_duplicates", "missing_files", "payload_errors"):
        for r in manifests.QUERIES[part](spark, str(tmp_path)).groupBy("code").count().collect():
            counted[r["code"]] = counted.get(r["code"], 0) + r["count"]
    assert row["total_rows_scanned"] == 399 and all(row[n] == counted[c] for n, c in quality.COUNTERS.items())
    assert row["missing_files"] and row["label_mismatches"]
