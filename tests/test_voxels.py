import numpy as np
import pytest

from voxlake.operators.residues import atom_positions, residues_from_atoms
from voxlake.operators.surface import exposed_points, residue_areas, sphere_points
from voxlake.operators.voxels import (
    VoxelConfig, box_join, dense_samples, screen_centres, smooth_sparse, voxel_counts,
)
from voxlake.plans.voxels import build_activity, build_sites, legacy_boxes, site_manifest
from voxlake.sources.sinks import activity_manifest, write_samples, write_sites

ATOMS = "structure_id string, line_no int, atom string, res_name string, chain_id string, res_no int, x double, y double, z double, element string"
#: Two residues of a made-up chain, all heavy atoms, at places of our own.
SPOTS = {
    ("SER", 14): {"N": (-0.4, 1.3, 0.2), "CA": (0.7, 0.6, -0.3), "CB": (0.85, -0.75, 0.45), "OG": (2.15, -1.3, 0.2), "C": (1.9, 1.45, 0.1), "O": (2.05, 2.6, -0.25)},
    ("CYS", 15): {"SG": (4.4, 3.9, 2.35), "N": (2.8, 0.9, 0.95), "O": (6.3, 0.95, 1.85), "CB": (4.15, 2.15, 2.7), "C": (5.15, 0.55, 1.6), "CA": (4.05, 1.55, 1.3)},
}
TOY = [
    ("T7", 10 * number + i, atom, name, "B", number, *spot, atom[0])
    for (name, number), atoms in SPOTS.items() for i, (atom, spot) in enumerate(atoms.items())
]
CHANNEL = {"O": 0, "C": 1, "N": 2, "S": 3}


def plain_axes(name):
    """Origin and axes of a residue, as the frame is defined: N direction, in-plane, normal."""
    own = {t[2]: np.array(t[6:9]) for t in TOY if t[3] == name}
    to_n, to_c = own["N"] - own["CA"], own["C"] - own["CA"]
    normal = np.cross(to_n, to_c)
    if "CB" in own and (own["CB"] - own["CA"]) @ normal < 0:
        normal = -normal
    axes = np.array([to_n, np.cross(normal, to_n), normal])
    return own["CA"], axes / np.linalg.norm(axes, axis=1, keepdims=True)


def plain_voxels(name):
    """Occupied (channel, x, y, z) cells of a residue's 20 x 20 x 20 box, atom by atom."""
    origin, axes = plain_axes(name)
    local = [(CHANNEL[t[9]], axes @ (np.array(t[6:9]) - origin)) for t in TOY if t[3] != name]
    return {(ch, *(int(v) for v in np.floor(p + 10))) for ch, p in local if (abs(p) < 10).all()}


@pytest.fixture()
def toy(spark):
    return spark.createDataFrame(TOY, ATOMS)


def test_two_residue_golden_voxels(spark, toy):
    centres = screen_centres(residues_from_atoms(toy), VoxelConfig()).where("skip is null")
    for r in centres.collect():
        assert np.allclose([[r[f"{a}{k}"] for k in "xyz"] for a in "uvw"], plain_axes(r["res_name"])[1])
    counts = voxel_counts(box_join(centres, toy, VoxelConfig())).collect()
    found = {}
    for r in counts:
        assert r["v"] == 1.0
        found.setdefault(r["res_name"], set()).add((r["ch"], r["ix"], r["iy"], r["iz"]))
    assert found == {name: plain_voxels(name) for name in ("SER", "CYS")}
    assert len(found["SER"]) == len(found["CYS"]) == 6


def brute_smooth(block):
    taps = [np.exp(-0.5 * (i / 0.6) ** 2) for i in range(-2, 3)]
    taps = np.array(taps) / sum(taps)
    out = block
    for axis in (1, 2, 3):
        padded = np.pad(out, [(2, 2) if a == axis else (0, 0) for a in range(4)], mode="symmetric")
        out = sum(t * np.take(padded, range(i, i + block.shape[axis]), axis=axis) for i, t in enumerate(taps))
    return out * 1000


def test_dense_and_sparse_smoothing_agree(spark, toy):
    config = VoxelConfig(box_size=6.0)
    built = build_sites(toy, config)
    dense = {r["res_name"]: np.array(r["x"]).reshape(4, 6, 6, 6) for r in dense_samples(built.packed, config).collect()}
    centres = screen_centres(residues_from_atoms(toy), config).where("skip is null")
    counts = voxel_counts(box_join(centres, toy, config))
    raw = {}
    for r in counts.collect():
        raw.setdefault(r["res_name"], np.zeros((4, 6, 6, 6)))[r["ch"], r["ix"], r["iy"], r["iz"]] = r["v"]
    for r in smooth_sparse(counts, config).collect():
        expected = brute_smooth(raw[r["res_name"]])[r["ch"], r["ix"], r["iy"], r["iz"]]
        assert abs(expected - r["v"]) < 1e-9
        assert abs(dense[r["res_name"]][r["ch"], r["ix"], r["iy"], r["iz"]] - expected) < 1e-3
    for name, block in raw.items():
        assert abs(dense[name].sum() - 1000 * block.sum()) < 0.05


def test_isolated_atom_peak(spark, toy):
    built = build_sites(toy, VoxelConfig())
    x = {r["res_name"]: np.array(r["x"]).reshape(4, 20, 20, 20) for r in dense_samples(built.packed, VoxelConfig()).collect()}
    taps = np.exp(-0.5 * (np.arange(-2, 3) / 0.6) ** 2)
    peak = 1000 * (taps[2] / taps.sum()) ** 3
    (alone,) = [c for c in plain_voxels("SER") if c[0] == CHANNEL["N"]]  # the only nitrogen around
    assert abs(x["SER"][alone] - peak) < 0.01


def test_skip_reasons_and_modes(spark, toy):
    extra = spark.createDataFrame([
        ("T7", 510, "CA", "XXX", "B", 3, 0.0, 9.0, 0.0, "C"),
        ("T7", 511, "CA", "SER", "B", 4, 0.0, 8.0, 0.0, "C"),
        ("S2", 1, "N", "GLY", "A", 1, 0.0, 0.0, 0.0, "N"),
        ("S2", 2, "CA", "GLY", "A", 1, 1.0, 0.0, 0.0, "C"),
        ("S2", 3, "C", "GLY", "A", 1, 2.0, 0.0, 0.0, "C"),
        ("S2", 4, "O", "GLY", "A", 1, 3.0, 0.0, 0.0, "O"),
        ("S3", 1, "N", "GLY", "A", 1, 0.0, 0.0, 0.0, "N"),
        ("S3", 2, "CA", "GLY", "A", 1, 1.0, 0.0, 0.0, "C"),
        ("S3", 3, "C", "GLY", "A", 1, 2.0, 1.0, 0.0, "C"),
        ("S3", 4, "O", "GLY", "A", 1, 3.0, 0.0, 0.0, "O"),
    ], ATOMS)
    built = build_sites(toy.union(extra), VoxelConfig())
    assert {r["skip"]: r["n"] for r in built.skipped.collect()} == {
        "invalid_label": 1, "missing_atoms": 1, "degenerate": 1, "density": 1}
    assert sorted(r["example_id"] for r in built.packed.collect()) == ["T7_B_14_SER", "T7_B_15_CYS"]
    targets = spark.createDataFrame([("T7", "15; 7")], "structure_id string, positions string")
    assert [r["res_no"] for r in build_sites(toy, VoxelConfig(), targets).packed.collect()] == [15]
    assert build_sites(toy, VoxelConfig(), max_sites=1).packed.count() == 1


def test_samples_and_manifest_round_trip(spark, toy, tmp_path):
    config = VoxelConfig()
    samples = dense_samples(build_sites(toy, config).packed, config)
    write_samples(samples, str(tmp_path / "samples"))
    stored = spark.read.parquet(str(tmp_path / "samples"))
    sites = site_manifest(stored, "/voxels", config)
    write_sites(sites, str(tmp_path / "sites"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "sites")).collect()
    assert [r["example_id"] for r in rows] == ["T7_B_14_SER", "T7_B_15_CYS"]
    assert rows[0]["label"] == "5" and rows[0]["sample_path"] == "/voxels/T7/T7_B_14_SER.npz"


def test_activity_examples(spark, toy):
    structures = spark.createDataFrame([("T7", "/p/T7.pdb", 0)], "structure_id string, pdb_path string, row_no int")
    activity = spark.createDataFrame([
        (0, "T7", "B", "14", "L7Q", "0.75"), (1, "T7", "B", "7", "", "2"), (2, "S9", "A", "1", "", "3"),
        (3, "T7", "", "14", "", "4"),
    ], "row_no int, structure_id string, chain_id string, res_no string, mutation string, activity_value string")
    built = build_activity(toy, structures, activity, VoxelConfig())
    rows = built.packed.collect()
    assert [(r["example_id"], r["value"], r["mutation"]) for r in rows] == [("T7_B_14_0", 0.75, "L7Q")]
    assert {r["skip"]: r["n"] for r in built.skipped.collect()} == {"missing_residue": 2, "missing_structure": 1}
    whole = build_activity(toy, structures, activity, VoxelConfig(), "whole_structure")
    kept = whole.packed.collect()
    assert {r["example_id"] for r in kept} == {"T7_whole"} and len(kept) == 3
    manifest = activity_manifest(built.packed, "/act")
    assert manifest.columns == ["example_id", "structure_id", "chain_id", "res_no", "mutation", "label", "task", "sample_path", "channel_scheme", "example_unit"]
    (line,) = manifest.collect()
    assert (line["label"], line["sample_path"], line["example_unit"]) == ("0.75", "/act/T7/T7_B_14_0.npz", "mutation_site")
    assert activity_manifest(whole.packed, "/act").where("chain_id = '' and res_no = ''").count() == 3
    total = sum(c["v"] for c in kept[0]["cells"])
    assert abs(total - (6 + 6) / 2) < 1e-6


def test_last_atom_row_wins(spark, toy):
    twice = toy.union(spark.createDataFrame([("T7", 999, "CA", "SER", "B", 14, 7.0, 7.0, 7.0, "C")], ATOMS))
    own = residues_from_atoms(twice).where("res_name = 'SER'").first()
    assert own["ca"]["x"] == 7.0
    full = atom_positions(twice).where("res_name = 'SER'").first()["atoms"]
    assert full["CA"]["y"] == 7.0 and len(full) == 6


def test_surface_against_brute_force(spark, toy):
    radii = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}
    got = {r["line_no"]: r for r in exposed_points(toy, ["structure_id", "line_no"]).collect()}
    points = np.array(sphere_points(92))
    xyz = np.array([t[6:9] for t in TOY])
    r = np.array([radii[t[9]] + 1.4 for t in TOY])
    for i, t in enumerate(TOY):
        surface = xyz[i] + points * r[i]
        free = np.ones(92, bool)
        for j in range(len(TOY)):
            if j != i:
                free &= ((surface - xyz[j]) ** 2).sum(1) >= r[j] ** 2
        assert got[t[1]]["exposed"] == free.sum()
    areas = {a["res_name"]: a for a in residue_areas(exposed_points(toy, ["structure_id", "line_no"])).collect()}
    for a in areas.values():
        assert abs(a["abs_total"] - a["abs_mainchain"] - a["abs_sidechain"]) < 1e-9
        assert abs(a["abs_total"] - a["abs_polar"] - a["abs_apolar"]) < 1e-9


def test_legacy_boxes_run(spark, toy):
    far = spark.createDataFrame([("T7", 520, "CA", "TRP", "B", 1, 95.0, 3.0, 3.0, "C")], ATOMS)
    boxes = legacy_boxes(toy.union(far), density=0.0, block=2).collect()
    assert boxes and all(b["block"] == 0 for b in boxes)


def test_voxels_travel_as_one_number(spark):
    pairs = spark.createDataFrame(
        [("T7", "B", 14, "SER", *voxel) for voxel in [(0, 0, 0, 0), (3, 19, 0, 19), (3, 19, 0, 19), (65535, 65535, 65535, 65535), (1, 0, 65535, 2)]]
        + [(None, "B", None, "SER", 2, 1, 0, 5)] * 3,
        "structure_id string, chain_id string, res_no int, res_name string, ch int, ix int, iy int, iz int")
    counts = voxel_counts(pairs)
    assert counts.schema.simpleString() == pairs.schema.add("v", "double").simpleString()
    assert sorted((r["structure_id"] or "", *r[4:]) for r in counts.collect()) == [
        ("", 2, 1, 0, 5, 3.0), ("T7", 0, 0, 0, 0, 1.0), ("T7", 1, 0, 65535, 2, 1.0), ("T7", 3, 19, 0, 19, 2.0),
        ("T7", 65535, 65535, 65535, 65535, 1.0)]
    moved = counts._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")[1]
    assert "iy" not in moved.split("Project")[0]  # the exchange carries the one number
