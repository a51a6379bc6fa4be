from pyspark.sql import functions as F

from tests.helpers import atom_line, ca_text, write
from voxlake import constants as K
from voxlake.plans.structures import make_splits, structure_manifest
from voxlake.sources.sinks import write_splits, write_structures
from voxlake.sources.structures import (
    ca_trace, discover_structures, first_files, first_model_lines, parse_atoms, parse_legacy_atoms, structure_lines,
)


def test_constant_tables_agree():
    assert sorted(K.LABEL_OF.values()) == list(range(20))
    assert len(set(K.LETTER_OF.values())) == 20
    for name in K.RESIDUES:
        assert set(K.BACKBONE_ATOMS) <= set(K.TEMPLATE_OF[name])
    bonds = K.bonds()
    for name, a, b, energy in bonds:
        assert {a, b} <= set(K.TEMPLATE_OF[name]) and energy > 0
    energy = {(r, a, b): e for r, a, b, e in bonds}
    assert energy[("ASP", "CG", "OD1")] == 745 and energy[("ASP", "CG", "OD2")] == 358
    assert energy[("ARG", "CZ", "NH2")] == 615 and energy[("CYS", "CB", "SG")] == 259
    assert len(K.LEGACY_BIAS) == 3


def test_manifest_of_one_file(spark, tmp_path):
    write(tmp_path, "probe.pdb", ca_text("GHWY"))
    row = structure_manifest(spark, str(tmp_path)).first()
    assert (row["pdb_id"], row["chains"], row["num_residues"], row["sequence"]) == ("probe", ["A"], 4, "GHWY")
    assert row["pdb_path"] == str(tmp_path / "probe.pdb")
    write_structures(structure_manifest(spark, str(tmp_path)), str(tmp_path / "out"))
    stored = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert stored["chains"] == "A" and stored["num_chains"] == "1"


def test_minimum_and_dedupe(spark, tmp_path):
    for name, seq in (("k", "FW"), ("m", "LKPLK"), ("n", "LKPLK")):
        write(tmp_path, f"{name}.pdb", ca_text(seq))
    rows = structure_manifest(spark, str(tmp_path), min_residues=3, dedupe=True).collect()
    assert [(r["pdb_id"], r["sequence"]) for r in rows] == [("m", "LKPLK")]


def test_two_files_of_one_stem(spark, tmp_path):
    write(tmp_path / "p", "q.pdb", ca_text("WY"))
    write(tmp_path / "r", "q.pdb", ca_text("HHK"))
    rows = structure_manifest(spark, str(tmp_path), recursive=True).orderBy("pdb_path").collect()
    assert [(r["pdb_id"], r["sequence"]) for r in rows] == [("q", "WY"), ("q", "HHK")]
    chosen = first_files(discover_structures(spark, str(tmp_path), recursive=True))
    assert [r["pdb_path"] for r in chosen.collect()] == [str(tmp_path / "p" / "q.pdb")]


def test_recursive_glob(spark, tmp_path):
    write(tmp_path / "deep", "under.ent", ca_text("QNV"))
    rows = structure_manifest(spark, str(tmp_path), "*.ent", recursive=True).collect()
    assert [(r["pdb_id"], r["sequence"]) for r in rows] == [("under", "QNV")]


def test_atom_records(spark, tmp_path):
    text = "\n".join([
        "HEADER",
        atom_line(1, "N", "ALA", "A", 1, 1.5, 2, 3, "N"),
        atom_line(2, "CA", "ALA", " ", 1, 1, 2, 3, ""),
        atom_line(3, "CB", "ALA", "A", 1, 1, 2, 3, "C", altloc="B"),
        atom_line(4, "CB", "ALA", "A", 1, 1, 2, 3, "C", altloc="A"),
        atom_line(5, "ZN", "ZN", "A", 9, 1, 2, 3, "ZN", record="HETATM"),
        atom_line(6, "C", "ALA", "A", "x", 1, 2, 3, "C"),
        "ENDMDL",
        atom_line(7, "O", "ALA", "A", 1, 1, 2, 3, "O"),
    ])
    write(tmp_path, "m.pdb", text)
    lines = structure_lines(discover_structures(spark, str(tmp_path)))
    atoms = parse_atoms(lines).orderBy("line_no").collect()
    assert [(a["atom"], a["chain_id"], a["element"]) for a in atoms] == [
        ("N", "A", "N"), ("CA", "_", "C"), ("CB", "A", "C")]
    assert atoms[0]["x"] == 1.5
    assert parse_atoms(lines, include_hetero=True).where("hetatm").count() == 1
    legacy = parse_legacy_atoms(lines)
    assert legacy.count() == 4  # every altloc, no HETATM, no bad number
    raw = spark.createDataFrame(
        [("m", i, s) for i, s in enumerate(text.split("\n"))], "structure_id string, line_no int, line string")
    assert parse_atoms(first_model_lines(raw)).count() == 3


def test_insertion_codes_make_different_sequences(spark, tmp_path):
    text = "\n".join([
        atom_line(1, "CA", "ALA", "A", 1, 0, 0, 0),
        atom_line(2, "CA", "GLY", "A", 1, 0, 0, 0, icode="B"),
        atom_line(3, "CA", "UNK", "A", 2, 0, 0, 0),
    ])
    write(tmp_path, "m.pdb", text)
    lines = structure_lines(discover_structures(spark, str(tmp_path)))
    assert ca_trace(lines).count() == 3
    assert ca_trace(lines, insertion_codes=False).count() == 2
    assert structure_manifest(spark, str(tmp_path)).first()["sequence"] == "GAX"  # "_" sorts after letters


def test_random_split_outputs(spark, tmp_path):
    for i in range(10):
        write(tmp_path / "in", f"s{i}.pdb", ca_text("ACDEFG"))
    splits = make_splits(spark, str(tmp_path / "in"), "random", (0.6, 0.2, 0.2), seed=1)
    sizes = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}
    assert sizes == {"train": 6, "val": 2, "test": 2}
    write_splits(splits, str(tmp_path / "out"), legacy_lists=True)
    ids = spark.read.text(str(tmp_path / "out" / "PDB_train.txt")).count()
    stored = spark.read.option("header", True).csv(str(tmp_path / "out" / "manifest"))
    assert ids == 6 and stored.count() == 10


def test_similar_sequences_stay_together(spark, tmp_path):
    for name, seq in (("a1", "A" * 10), ("a2", "A" * 10), ("c1", "C" * 10), ("c2", "C" * 10)):
        write(tmp_path, f"{name}.pdb", ca_text(seq))
    splits = make_splits(spark, str(tmp_path), "sequence-cluster", (0.5, 0.25, 0.25), threshold=0.9)
    found = {r["structure_id"]: r["split"] for r in splits.collect()}
    assert found["a1"] == found["a2"] and found["c1"] == found["c2"] and found["a1"] != found["c1"]


def test_scaffold_split(spark, tmp_path):
    for name, seq in (("a", "AVILMFWY"), ("b", "STNQCGP"), ("c", "KRHDE")):
        write(tmp_path, f"{name}.pdb", ca_text(seq))
    splits = make_splits(spark, str(tmp_path), "scaffold")
    assert splits.count() == 3
    assert splits.where(F.col("split").isin(K.SPLITS)).count() == 3


def test_lines_are_formatted_once_and_as_the_formatter_does(spark):
    from pyspark.sql import functions as F

    from voxlake.catalog import views as V

    values = [None, 0.0, -0.0, -0.0004, 0.0005, 0.0015, -2.0005, 9999.9995, 1e16, float("nan"), float("-inf"), 12.3456]
    numbers = spark.createDataFrame([(v,) for v in values], "x double")
    assert numbers.where(~V.coordinate(F.col("x")).eqNullSafe(F.format_string("%8.3f", "x"))).count() == 0
    texts = spark.createDataFrame([(t,) for t in (None, "", "CA", "LONGER")], "t string")
    for width in (-3, 5):
        assert texts.where(~V.padded(F.col("t"), width).eqNullSafe(F.format_string(f"%{width}s", "t"))).count() == 0
    lines = V.structure_text(spark, "/root/testdata/sf0.001").where(F.trim(F.substring("line", 1, 6)).isin("ATOM"))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 3  # one fallback for each coordinate, none again in the filter


def test_models_end_by_structure_and_lines_without_id_stay(spark):
    rows = [("A", 1, "ATOM 1"), ("A", 2, "ENDMDL"), ("A", 3, "ATOM 2"), ("", 5, "ATOM 3"), (None, 1, "ENDMDL"), (None, 2, "ATOM 4")]
    kept = first_model_lines(spark.createDataFrame(rows, "structure_id string, line_no int, line string"))
    assert kept.columns == ["structure_id", "line_no", "line"]
    assert sorted(r["line"] for r in kept.collect()) == ["ATOM 1", "ATOM 3", "ATOM 4", "ENDMDL"]
