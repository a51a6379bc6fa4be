"""Structure files: discovery and fixed-width atom records."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.columns import computed_once, file_stem
from voxlake.runtime import spread
from voxlake.sources.arrays import Handle, exists


def discover_structures(
    spark: SparkSession, path: str, glob: str = "*.pdb", recursive: bool = False
) -> DataFrame:
    """(structure_id, pdb_path, text), one row per file."""
    raw = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(path)
    )
    return with_structure_id(raw)


def named_structures(paths: DataFrame) -> DataFrame:
    """(structure_id, pdb_path, text) of the files that a table (structure_id, pdb_path) names.

    No other file is opened; a file that is not there gives no row.
    """
    schema = "structure_id string, pdb_path string, text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            if exists(row["pdb_path"]):
                with Handle(row["pdb_path"]) as handle:
                    text = handle.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_pydict({"structure_id": [row["structure_id"]], "pdb_path": [row["pdb_path"]], "text": [text]})

    return spread(paths.select("structure_id", "pdb_path"), "pdb_path").mapInArrow(run, schema)


def with_structure_id(raw: DataFrame) -> DataFrame:
    """Turn whole-text rows (batch or streaming) into structure rows."""
    location = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return raw.select(
        file_stem(location).alias("structure_id"),
        location.alias("pdb_path"),
        F.col("value").alias("text"),
    )


def structure_key(df: DataFrame) -> list[str]:
    """The columns that tell structures apart: the id, and the path where it is known."""
    return [c for c in ("structure_id", "pdb_path") if c in df.columns]


def first_files(files: DataFrame) -> DataFrame:
    """The file with the first path of each structure id; the choice reads no text."""
    first = files.groupBy("structure_id").agg(F.min("pdb_path").alias("pdb_path"))
    return files.join(first, ["structure_id", "pdb_path"], "left_semi")


def structure_lines(files: DataFrame) -> DataFrame:
    """Lines of the first model of each file.

    The text is cut at the first line that starts with ENDMDL before it is
    exploded, so no window over the lines of a file is needed.
    """
    first_model = F.get(F.split(F.concat(F.lit("\n"), F.col("text")), "\nENDMDL", 2), F.lit(0))
    return files.select(
        "structure_id",
        "pdb_path",
        F.posexplode(F.split(first_model, "\r?\n")).alias("line_no", "line"),
    )


def first_model_lines(lines: DataFrame) -> DataFrame:
    """The same cut for a table of lines that was never one text per file.

    Lines without an id are never cut. Their NULL meets NULL here, with no end: a
    plain equality would filter one reading of the lines and not the other, so
    that no exchange below could serve both.
    """
    ends = (
        lines.where(F.col("line").startswith("ENDMDL"))
        .groupBy(F.col("structure_id").alias("_sid"))
        .agg(F.min(F.when(F.col("structure_id").isNotNull(), F.col("line_no"))).alias("end_no"))
    )
    return (
        lines.join(ends, F.col("structure_id").eqNullSafe(F.col("_sid")), "left")
        .where(F.col("end_no").isNull() | (F.col("line_no") < F.col("end_no")))
        .drop("_sid", "end_no")
    )


def _field(start: int, width: int) -> Column:
    """Trimmed fixed-width field; ``start`` counts from 0."""
    return F.trim(F.substring("line", start + 1, width))


def _raw(start: int, width: int) -> Column:
    return F.substring("line", start + 1, width)


def parse_atoms(lines: DataFrame, include_hetero: bool = False) -> DataFrame:
    """Atom records; rows whose numbers do not parse are skipped."""
    record = _field(0, 6)
    kinds = ["ATOM", "HETATM"] if include_hetero else ["ATOM"]
    keep = [c for c in ("structure_id", "pdb_path", "line_no") if c in lines.columns]
    fields = {
        "atom": _field(12, 4),
        "res_name": _field(17, 3),
        "chain_id": F.coalesce(F.nullif(_field(21, 1), F.lit("")), F.lit("_")),
        "res_no": _field(22, 4).try_cast("int"),
        "icode": F.coalesce(F.nullif(_field(26, 1), F.lit("")), F.lit("_")),
        **{c: _field(30 + 8 * i, 8).try_cast("double") for i, c in enumerate("xyz")},
        "element": F.coalesce(
            F.nullif(_field(76, 2), F.lit("")), F.substring(_field(12, 4), 1, 1)
        ),
        "hetatm": record == "HETATM",
        "altloc": _field(16, 1),
    }
    wanted = lines.where(record.isin(*kinds) & _field(16, 1).isin("", "A"))
    parsed = computed_once(wanted, fields).select(*keep, *fields)
    return parsed.where(
        F.col("res_no").isNotNull() & F.col("x").isNotNull()
        & F.col("y").isNotNull() & F.col("z").isNotNull()
    )


def parse_legacy_atoms(lines: DataFrame) -> DataFrame:
    """Legacy dialect: ATOM only, every altloc, narrower columns."""
    return lines.where(F.get(F.split(F.trim("line"), "\\s+"), F.lit(0)) == "ATOM").select(
        "structure_id",
        "line_no",
        _field(13, 3).alias("atom"),
        _raw(17, 3).alias("res_name"),
        _raw(21, 1).alias("chain_id"),
        _field(22, 4).try_cast("int").alias("res_no"),
        *[_field(30 + 8 * i, 7).try_cast("double").alias(c) for i, c in enumerate("xyz")],
        F.substring(_field(13, 3), 1, 1).alias("element"),
    ).where(F.col("res_no").isNotNull() & F.col("x").isNotNull())


def ca_trace(lines: DataFrame, insertion_codes: bool = True) -> DataFrame:
    """One row per residue that has a CA; the first line of a key wins.

    Files are told apart by their path, where there is one: two files with one
    stem stay two structures.
    """
    file = structure_key(lines)
    keys = [*file, "chain_id", "res_no"] + (["icode"] if insertion_codes else [])
    ca = lines.where(F.col("line").startswith("ATOM") & (_field(12, 4) == "CA")).select(
        *file,
        "line_no",
        F.coalesce(F.nullif(_field(21, 1), F.lit("")), F.lit("_")).alias("chain_id"),
        _field(17, 3).alias("res_name"),
        F.coalesce(F.nullif(_field(26, 1), F.lit("")), F.lit("_")).alias("icode"),
        _field(22, 4).try_cast("int").alias("res_no"),
    ).where(F.col("res_no").isNotNull())
    return ca.groupBy(*keys).agg(F.min_by("res_name", "line_no").alias("res_name"))
