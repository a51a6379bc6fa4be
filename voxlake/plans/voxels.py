"""Residue-centred examples, activity examples and legacy boxes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.constants import LEGACY_BIAS
from voxlake.functions.columns import in_target_list
from voxlake.functions.residues import residue_label
from voxlake.operators import activity as act
from voxlake.operators import legacy as old
from voxlake.operators.residues import RESIDUE_KEY, residues_from_atoms
from voxlake.operators.sampling import sample_per_group
from voxlake.operators.surface import exposed_points, residue_areas
from voxlake.operators.voxels import (
    VoxelConfig, box_join, example_id, mean_over_sites, pack_examples,
    screen_centres, voxel_counts,
)
from voxlake.runtime import cut_lineage
from voxlake.sources.sinks import write_activity
from voxlake.sources.structures import discover_structures, first_files, named_structures, parse_atoms, structure_lines


@dataclass
class Examples:
    """Packed examples plus the counters of what was left out."""

    packed: DataFrame
    skipped: DataFrame


def pick_centres(
    residues: DataFrame, targets: DataFrame | None, max_sites: int | None, seed: int
) -> DataFrame:
    """Centre filter (positions listed per structure) and per-structure cap."""
    picked = residues
    if targets is not None:
        picked = residues.join(targets, "structure_id").where(
            in_target_list(F.col("res_no"), F.col("positions"))
        ).drop("positions")
    if max_sites is not None:
        picked = sample_per_group(picked, ["structure_id"], max_sites, RESIDUE_KEY, seed)
    return picked


def build_sites(
    atoms: DataFrame, config: VoxelConfig, targets: DataFrame | None = None,
    max_sites: int | None = None, seed: int = 0, landed: bool = False,
) -> Examples:
    """Atoms -> packed voxel examples.

    ``targets`` is (structure_id, positions) for the mutated-site or
    active-site modes. The sampling comes before the label and template
    filters, as the counters expect. ``landed`` writes the examples once, for
    callers that use both results: the counters then need no box join of their own.
    """
    residues = pick_centres(residues_from_atoms(atoms), targets, max_sites, seed)
    screened = screen_centres(residues, config)
    usable = screened.where("skip is null")
    counts = voxel_counts(box_join(usable, atoms, config))
    packed = pack_examples(counts, config)
    if landed:
        packed = cut_lineage(packed)
    dense_enough = usable.select(*RESIDUE_KEY).join(
        packed.select(*RESIDUE_KEY), RESIDUE_KEY, "left_anti"
    ).agg(F.count("*").alias("n")).select(F.lit("density").alias("skip"), "n")
    skipped = (
        screened.where("skip is not null").groupBy("skip").agg(F.count("*").alias("n"))
        .unionByName(dense_enough.where("n > 0"))
    )
    labelled = packed.withColumn("label", residue_label(F.col("res_name")))
    return Examples(
        labelled.withColumn("example_id", example_id(*RESIDUE_KEY)), skipped
    )


def build_folder(
    spark: SparkSession, path: str, config: VoxelConfig, glob: str = "*.pdb", recursive: bool = False,
    include_hetero: bool = False, targets: DataFrame | None = None, max_sites: int | None = None, seed: int = 0,
) -> Examples:
    """Structure files below a folder -> packed examples; of one id the first path is built."""
    files = first_files(discover_structures(spark, path, glob, recursive))
    atoms = cut_lineage(parse_atoms(structure_lines(files), include_hetero))
    return build_sites(atoms, config, targets, max_sites, seed, landed=True)


def site_manifest(samples: DataFrame, root: str, config: VoxelConfig) -> DataFrame:
    """The nine-column manifest as a projection of the stored samples."""
    return samples.select(
        "example_id", "structure_id", "chain_id", F.col("res_no").cast("string").alias("res_no"),
        "res_name", F.col("label").cast("string").alias("label"),
        F.concat(F.lit(root.rstrip("/") + "/"), "structure_id", F.lit("/"), "example_id",
                 F.lit(".npz")).alias("sample_path"),
        F.lit(config.task).alias("task"), F.lit(config.channel_scheme).alias("channel_scheme"),
    )


def build_activity(
    atoms: DataFrame, structures: DataFrame, activity: DataFrame, config: VoxelConfig,
    unit: str = "mutation_site",
) -> Examples:
    """Activity rows -> examples of one residue or of a whole structure.

    The packed cells are counts (of a structure: their mean over its sites);
    ``dense_samples`` smooths both kinds.
    """
    rows = act.match_structures(act.with_ordinals(act.activity_rows(activity)), structures)
    residues = cut_lineage(screen_centres(residues_from_atoms(atoms), config))  # feeds several branches
    usable = residues.where("skip is null")
    if unit == "whole_structure":
        cells = voxel_counts(box_join(usable, atoms, config))
        if config.density > 0:
            kept = pack_examples(cells, config).select(*RESIDUE_KEY)
            cells = cells.join(kept, RESIDUE_KEY, "left_semi")
        # Smoothing is linear: the mean of the counts is smoothed once later.
        mean = mean_over_sites(cells, ["structure_id"], ["chain_id", "res_no", "res_name"])
        packed = pack_examples(mean, replace(config, density=0.0), ["structure_id"])
        joined = act.whole_examples(rows).join(packed, "structure_id", "left")
        reason = F.when(~F.col("has_structure"), "missing_structure").when(
            F.col("cells").isNull(), "missing_sites")
        marked = joined.withColumn("skip", reason)
    else:
        judged = cut_lineage(act.match_residues(rows, residues))
        matched = act.site_examples(judged)
        wanted = matched.select(*RESIDUE_KEY).distinct()
        centres = usable.join(wanted, RESIDUE_KEY, "left_semi")
        packed = pack_examples(voxel_counts(box_join(centres, atoms, config)), config)
        reasons = residues.select(*RESIDUE_KEY, F.col("skip").alias("_why"))
        ready = matched.drop("skip").join(packed, RESIDUE_KEY, "left").join(reasons, RESIDUE_KEY, "left")
        late = ready.withColumn(
            "skip", F.when(F.col("cells").isNull(), F.coalesce("_why", F.lit("density")))
        ).drop("_why")
        early = judged.where("skip is not null")
        marked = late.unionByName(early, allowMissingColumns=True)
    kept = marked.where("skip is null").withColumns({
        "task": F.lit("regression"), "channel_scheme": F.lit(config.channel_scheme),
        "example_unit": F.lit(unit),
    })
    skipped = marked.where("skip is not null").groupBy("skip").agg(F.count("*").alias("n"))
    return Examples(kept, skipped)


def build_activity_files(
    activity: DataFrame, root: str, config: VoxelConfig, unit: str = "mutation_site", include_hetero: bool = False,
    out: str | None = None,
) -> Examples:
    """``build_activity`` from the structure files that the activity rows name.

    Of rows that name several files for one id the last wins; only these files
    are opened, and an id whose file is not there is a missing structure. ``out``
    names a folder for the activity manifest.
    """
    files = cut_lineage(named_structures(act.structure_paths(activity, root)))
    atoms = cut_lineage(parse_atoms(structure_lines(files), include_hetero))
    built = build_activity(atoms, files.select("structure_id"), activity, config, unit)
    if out is not None:
        built = Examples(cut_lineage(built.packed), built.skipped)
        write_activity(built.packed, root, out)
    return built


def legacy_boxes(
    atoms: DataFrame, scheme: str = "element4", density: float = 0.01, block: int = 1000, seed: int = 0,
) -> DataFrame:
    """Grid-picked boxes of the legacy dialect, grouped into blocks per label."""
    config = VoxelConfig(channel_scheme=scheme, density=density, exclude="sidechain",
                         bias=tuple(LEGACY_BIAS))
    residues = residues_from_atoms(atoms, ["structure_id", "chain_id", "res_no"])
    names = atoms.groupBy("structure_id", "chain_id", "res_no").agg(
        F.min_by("res_name", "line_no").alias("res_name")
    )
    residues = residues.join(names, ["structure_id", "chain_id", "res_no"])
    nearest = old.nearest_atoms(old.grid_points(atoms), atoms)
    centres = screen_centres(old.picked_centres(nearest, residues), config).where("skip is null")
    packed = pack_examples(voxel_counts(box_join(centres, atoms, config)), config)
    labelled = packed.withColumn("label", residue_label(F.col("res_name")))
    return old.label_blocks(labelled, RESIDUE_KEY, block, seed)


def sasa_table(atoms: DataFrame, points: int = 92) -> DataFrame:
    """Absolute and relative accessibility of every residue."""
    return residue_areas(exposed_points(atoms, ["structure_id", "line_no"], points))

