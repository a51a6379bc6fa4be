"""Structure manifests and leak-aware splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.residues import assemble_sequences, dedupe_by_sequence
from voxlake.operators.splits import assign_splits, group_records
from voxlake.sources.structures import ca_trace, discover_structures, structure_lines


def structures_from_files(files: DataFrame, insertion_codes: bool = True) -> DataFrame:
    """pdb_id, pdb_path, sequence, chains, num_residues of every file, read once."""
    trace = ca_trace(structure_lines(files), insertion_codes)
    order = ["chain_id", "res_no"] + (["icode"] if insertion_codes else [])
    return assemble_sequences(trace, order).withColumnRenamed("structure_id", "pdb_id")


def structure_manifest(
    spark: SparkSession, path: str, glob: str = "*.pdb", recursive: bool = False,
    min_residues: int = 0, dedupe: bool = False,
) -> DataFrame:
    rows = structures_from_files(discover_structures(spark, path, glob, recursive))
    kept = rows.where((F.col("num_residues") >= min_residues) & (F.col("sequence") != ""))
    return dedupe_by_sequence(kept) if dedupe else kept


def make_splits(
    spark: SparkSession, path: str, method: str = "sequence-cluster",
    fractions: Sequence[float] = (0.8, 0.1, 0.1), threshold: float = 0.4, seed: int = 0,
) -> DataFrame:
    files = discover_structures(spark, path, "*.{pdb,ent}")
    records = structures_from_files(files, insertion_codes=False).withColumnRenamed(
        "pdb_id", "structure_id"
    ).where("sequence <> ''").select("structure_id", "pdb_path", "sequence")
    grouped = group_records(records, method, threshold)
    return assign_splits(grouped, fractions, seed).select(
        "structure_id", "pdb_path", "sequence", "split"
    )
