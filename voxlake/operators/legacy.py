"""Legacy box generation: grid points pick the centre residues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import geometry as G
from voxlake.functions.residues import residue_label
from voxlake.operators.ranking import rank_by_hash
from voxlake.runtime import cut_lineage

GRID = 10.0


def grid_points(atoms: DataFrame, grid: float = GRID) -> DataFrame:
    """(structure_id, gi, gj, gk, gx, gy, gz) over each structure's extent."""
    extent = atoms.groupBy("structure_id").agg(
        *[F.min(k).alias(f"_lo{k}") for k in "xyz"], *[F.max(k).alias(f"_hi{k}") for k in "xyz"]
    )
    points = extent
    for k, i in zip("xyz", "ijk"):
        steps = F.ceil((F.col(f"_hi{k}") - F.col(f"_lo{k}")) / F.lit(grid)).cast("int")
        points = points.where(steps > 0).withColumn(
            f"g{i}", F.explode(F.sequence(F.lit(0), steps - 1))
        )
    return points.select(
        "structure_id", "gi", "gj", "gk",
        *[(F.col(f"_lo{k}") + F.col(f"g{i}") * F.lit(grid)).alias(f"g{k}") for k, i in zip("xyz", "ijk")],
    )


def nearest_atoms(points: DataFrame, atoms: DataFrame, order: str = "line_no", start: float = GRID) -> DataFrame:
    """The nearest atom of every grid point; equal distances by atom order.

    A search in the 27 cells of width h is certain up to distance h. Points
    without an atom that close look again with twice the width, so the rounds
    grow with the logarithm of the widest gap.
    """
    keys = ["structure_id", "gi", "gj", "gk"]
    carried = [c for c in atoms.columns if c != "structure_id"]
    spark = points.sparkSession
    open_points = cut_lineage(points)
    atoms = cut_lineage(atoms)  # every round reads them
    found: DataFrame | None = None
    width = start
    while not open_points.isEmpty():
        around = open_points.withColumn("_o", F.explode(G.neighbour_offsets())).withColumns({
            f"_c{k}": G.cell(F.col(f"g{k}"), width) + F.col(f"_o.d{k}") for k in "xyz"
        }).drop("_o")
        cloud = atoms.select(
            F.col("structure_id").alias("_sid"), F.struct(*carried).alias("_atom"),
            *[G.cell(F.col(k), width).alias(f"_k{k}") for k in "xyz"],
        )
        same = F.col("structure_id") == F.col("_sid")
        for k in "xyz":
            same = same & (F.col(f"_c{k}") == F.col(f"_k{k}"))
        delta = tuple(F.col(f"_atom.{k}") - F.col(f"g{k}") for k in "xyz")
        best = around.join(cloud, same).withColumn("_d2", G.dot(delta, delta)).groupBy(*keys).agg(
            F.min_by("_atom", F.struct("_d2", F.col(f"_atom.{order}"))).alias("_atom"),
            F.min("_d2").alias("d2"),
        )
        best = cut_lineage(best.where(F.col("d2") <= width * width))
        found = best if found is None else found.unionByName(best)
        open_points = cut_lineage(open_points.join(best, keys, "left_anti"))
        width *= 2.0
    if found is None:
        empty = points.limit(0).select(*keys)
        return empty.join(spark.createDataFrame([], atoms.schema), "structure_id").select(*keys, *carried)
    return found.select(*keys, "d2", *[F.col(f"_atom.{c}").alias(c) for c in carried])


def picked_centres(nearest: DataFrame, residues: DataFrame) -> DataFrame:
    """Distinct centre residues (by CA position) the grid points fall on."""
    chosen = nearest.where(residue_label(F.col("res_name")).isNotNull()).select(
        "structure_id", "chain_id", "res_no", F.struct("gi", "gj", "gk").alias("_g")
    )
    first = chosen.groupBy("structure_id", "chain_id", "res_no").agg(F.min("_g").alias("_g"))
    named = first.join(residues, ["structure_id", "chain_id", "res_no"]).where("ca is not null")
    columns = [c for c in named.columns if c != "_g"]
    once = named.groupBy("structure_id", F.col("ca").alias("_ca")).agg(
        F.min_by(F.struct(*columns), "_g").alias("_r")
    )
    return once.select(*[F.col(f"_r.{c}").alias(c) for c in columns])


def label_blocks(boxes: DataFrame, key: list[str], size: int, seed: int = 0) -> DataFrame:
    """Add ``block``: consecutive blocks per label; the last one may be short."""
    return rank_by_hash(boxes, ["label"], key, seed, "_rank").withColumn(
        "block", F.floor((F.col("_rank") - 1) / F.lit(size))
    ).drop("_rank", "_total")
