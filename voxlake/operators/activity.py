"""Activity labels attached to residues or to whole structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.columns import (
    ACTIVITY_ALIASES, RES_NO_ALIASES, STRUCTURE_ID_ALIASES, STRUCTURE_PATH_ALIASES, ManifestError, chain_column,
    first_alias, resolve_path,
)
from voxlake.functions.residues import residue_label
from voxlake.operators.ranking import rank_in_order


def activity_rows(raw: DataFrame, order: str = "row_no") -> DataFrame:
    """Resolve the alias columns of an activity manifest."""
    mutation = F.col("mutation") if "mutation" in raw.columns else F.lit("")
    return raw.select(
        F.col(order).alias("row_no"),
        first_alias(raw, STRUCTURE_ID_ALIASES).alias("structure_id"),
        chain_column(raw).alias("chain"),
        first_alias(raw, RES_NO_ALIASES, required=False).try_cast("int").alias("res_no"),
        F.coalesce(mutation.cast("string"), F.lit("")).alias("mutation"),
        first_alias(raw, ACTIVITY_ALIASES).cast("double").alias("value"),
    ).where("structure_id is not null")


def structure_paths(raw: DataFrame, root: str, order: str = "row_no") -> DataFrame:
    """(structure_id, pdb_path) of an activity manifest with structure paths: of each id the last row's path.

    Rows need both an id and a path; relative paths are below ``root``.
    """
    named = raw.select(
        F.col(order).alias("row_no"), first_alias(raw, STRUCTURE_ID_ALIASES).alias("structure_id"),
        first_alias(raw, STRUCTURE_PATH_ALIASES).alias("path"))
    lacking = named.where("structure_id is null or path is null").limit(1).collect()
    if lacking:
        raise ManifestError(f"row {lacking[0]['row_no']} lacks a structure id or a structure path")
    last = named.groupBy("structure_id").agg(F.max_by("path", "row_no").alias("path"))
    return last.select("structure_id", resolve_path(F.col("path"), root).alias("pdb_path"))


def with_ordinals(rows: DataFrame) -> DataFrame:
    """Add ``ordinal``: 0-based position among the rows of a structure.

    Range buckets of the row number keep each window small even when one
    structure has most of the rows.
    """
    return rank_in_order(rows, ["structure_id"], "row_no", "_rank").withColumn(
        "ordinal", F.col("_rank") - 1
    ).drop("_rank")


def match_structures(rows: DataFrame, structures: DataFrame) -> DataFrame:
    """Add ``has_structure``."""
    known = structures.select("structure_id").distinct().withColumn("_known", F.lit(True))
    return rows.join(known, "structure_id", "left").withColumn(
        "has_structure", F.col("_known").isNotNull()
    ).drop("_known")


def match_residues(rows: DataFrame, residues: DataFrame) -> DataFrame:
    """Add the one residue an activity row means, or the reason there is none.

    Residues are counted per key before the join, so a row meets exactly one
    summary row however many residues share its number.
    """
    r = residues.select("structure_id", "res_no", "chain_id", "res_name")
    any_chain = r.groupBy("structure_id", "res_no").agg(
        F.count("*").alias("_n"), F.first(F.struct("chain_id", "res_name")).alias("_r")
    )
    with_chain = r.groupBy("structure_id", "res_no", F.col("chain_id").alias("chain")).agg(
        F.count("*").alias("_nc"), F.first(F.struct("chain_id", "res_name")).alias("_rc")
    )
    free = rows.where("chain is null").join(any_chain, ["structure_id", "res_no"], "left")
    fixed = rows.where("chain is not null").join(
        with_chain, ["structure_id", "res_no", "chain"], "left"
    ).withColumnsRenamed({"_nc": "_n", "_rc": "_r"})
    both = free.unionByName(fixed)
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    return both.withColumns({
        "chain_id": F.when(one, F.col("_r.chain_id")),
        "res_name": F.when(one, F.col("_r.res_name")),
    }).withColumn("skip", activity_skip(one)).drop("_n", "_r")


def activity_skip(one: Column) -> Column:
    return (
        F.when(~F.col("has_structure"), "missing_structure")
        .when(~one, "missing_residue")
        .when(residue_label(F.col("res_name")).isNull(), "invalid_label")
    )


def site_examples(matched: DataFrame) -> DataFrame:
    """Manifest columns of the rows that have a residue."""
    return matched.where("skip is null").withColumn(
        "example_id", F.concat_ws("_", "structure_id", "chain_id", "res_no", "ordinal")
    )


def whole_examples(rows: DataFrame) -> DataFrame:
    return rows.withColumn("example_id", F.concat("structure_id", F.lit("_whole")))
