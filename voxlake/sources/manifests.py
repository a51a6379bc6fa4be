"""Manifest and ledger readers: CSV, Parquet, JSON pages, text lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.columns import ManifestError
from voxlake.functions.residues import lookup
from voxlake import constants as K
from voxlake.sources.arrays import array_files


def read_manifest_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """CSV with a header, every column a string, quoted newlines allowed."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by suffix; Parquet values become text, NULL becomes ''."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".csv"):
        return read_manifest_csv(spark, path)
    if lowered.endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
        return df.select(
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
        )
    raise ManifestError(f"unsupported manifest format: {path}")


def read_accession_pages(spark: SparkSession, path: str) -> DataFrame:
    """Accessions of landed JSON result pages."""
    schema = "results array<struct<metadata:struct<accession:string>>>"
    pages = spark.read.schema(schema).option("multiLine", True).json(path)
    return pages.select(F.explode("results").alias("r")).select(
        F.col("r.metadata.accession").alias("accession")
    )


def read_scop(spark: SparkSession, path: str, skip: int = 5) -> DataFrame:
    """(sid, pdb, family) rows; the first ``skip`` lines are a preamble."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return scop_rows(lines.where(F.col("pos") >= skip))


def scop_rows(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("line"), "\\s+")
    return lines.where(F.size(parts) >= 4).select(
        F.get(parts, F.lit(0)).alias("sid"),
        F.get(parts, F.lit(1)).alias("pdb"),
        F.get(parts, F.lit(3)).alias("family"),
    )


def read_sasa_cif(spark: SparkSession, path: str) -> DataFrame:
    """Per-residue accessibility from CIF-style text files."""
    whole = spark.read.text(path, wholetext=True).select(
        F.substring(F.substring_index(F.col("_metadata.file_path"), "/", -1), 1, 4).alias("gene"),
        "value",
    )
    marker = "\\n\\s*_freeSASA_rsa\\.rel_polar(?=\\s|$)"
    after = F.get(F.split(F.concat(F.lit("\n"), "value"), marker, 2), F.lit(1))
    lines = whole.where(after.isNotNull()).select(
        "gene", F.explode(F.split(after, "\r?\n")).alias("line")
    )
    parts = F.split(F.trim("line"), "\\s+")
    letter = lookup(K.LETTER_OF, F.get(parts, F.lit(2)))
    return lines.where(letter.isNotNull()).select(
        "gene",
        F.get(parts, F.lit(1)).alias("position"),
        letter.alias("aa"),
        F.get(parts, F.lit(3)).alias("SASA_abs_total"),
        F.get(parts, F.lit(4)).alias("SASA_rel_total"),
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case first tokens of a legacy split list."""
    first = F.lower(F.get(F.split(F.trim("value"), "\\s+"), F.lit(0)))
    return spark.read.text(path).select(first.alias("id")).where("id <> ''").distinct()


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path and size of the files below a folder, empty ones too; none is opened."""
    return array_files(spark, path, "listing", glob)
