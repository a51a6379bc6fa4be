"""Residues, sequences and structure rows from atom records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.residues import residue_letter
from voxlake.sources.structures import structure_key

RESIDUE_KEY = ["structure_id", "chain_id", "res_no", "res_name"]
FRAME_ATOMS = ["N", "CA", "C", "CB"]


def residues_from_atoms(
    atoms: DataFrame, keys: Sequence[str] = RESIDUE_KEY, order: str = "line_no"
) -> DataFrame:
    """One row per residue: its atom names and the frame atoms' positions.

    Of repeated atom names the last row wins. The name set has at most a few
    dozen members, whatever the number of rows, so the one exchange carries
    partial aggregates only.
    """
    position = F.struct("x", "y", "z")
    frame = [
        F.max_by(
            F.when(F.col("atom") == name, position), F.when(F.col("atom") == name, F.col(order))
        ).alias(name.lower())
        for name in FRAME_ATOMS
    ]
    return atoms.groupBy(*keys).agg(
        F.array_sort(F.collect_set("atom")).alias("atom_names"), *frame
    )


def atom_positions(
    atoms: DataFrame, keys: Sequence[str] = RESIDUE_KEY, order: str = "line_no"
) -> DataFrame:
    """Residue rows with a name -> position map (last row of a name wins)."""
    last = atoms.groupBy(*keys, "atom").agg(
        F.max_by(F.struct("x", "y", "z"), order).alias("pos")
    )
    return last.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("atom", "pos")))).alias("atoms")
    )


def assemble_sequences(trace: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per structure file: residue letters in key order, chains, length."""
    file = structure_key(trace)
    keyed = trace.select(
        *file, "chain_id",
        F.struct(*order, residue_letter(F.col("res_name")).alias("letter")).alias("item"),
    )
    return keyed.groupBy(*file).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("item")), lambda s: s["letter"]), ""
        ).alias("sequence"),
        F.array_sort(F.collect_set("chain_id")).alias("chains"),
        F.count("*").alias("num_residues"),
    )


def dedupe_by_sequence(structures: DataFrame, order: str = "pdb_path") -> DataFrame:
    """Keep the structure with the first path of every distinct sequence."""
    columns = structures.columns
    first = structures.groupBy("sequence").agg(
        F.min_by(F.struct(*columns), order).alias("_row")
    )
    return first.select(*[F.col(f"_row.{c}").alias(c) for c in columns])


def first_row_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row (by ``order``) of every id."""
    columns = df.columns
    first = df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return first.select(*[F.col(f"_row.{c}").alias(c) for c in columns])
