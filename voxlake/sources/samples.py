"""Examples in array files: shards, archives, feature matrices; once into Parquet, columnar from then on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.columns import (
    blank_to_null, file_stem, parse_shard_name, resolve_path, sample_path_column,
)
from voxlake.functions.residues import residue_label
from voxlake.sources.arrays import array_files, paired_samples, with_samples


def read_archives(spark: SparkSession, path: str, arrays: bool = True) -> DataFrame:
    """Payload of every per-example archive below a folder; without ``arrays`` only raw shapes and labels."""
    return array_files(spark, path, "payload" if arrays else "payload-headers", "*.npz")


def read_shards(spark: SparkSession, path: str, glob: str = "*.dat") -> DataFrame:
    """(path, sample_index, shape, x) of every array shard below a folder; filters on path and sample_index prune the reading."""
    return array_files(spark, path, "samples", glob)


def read_samples(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """Samples named by a manifest: per-example archives or shard rows.

    Only files that the manifest names are opened, and of shards only the
    samples named. What is not there gives nulls.
    """
    index = (
        blank_to_null(F.col("sample_index")).try_cast("bigint")
        if "sample_index" in manifest.columns else F.lit(None).cast("bigint")
    )
    located = manifest.withColumns({"path": resolve_path(sample_path_column(manifest), root), "sample_index": index})
    return with_samples(located)


def discover_shards(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Shard-example rows of the files in a folder, from their headers; shards of unknown residues are left out."""
    lengths = array_files(spark, path, "headers", "*.dat", recursive=False).select("path", "n")
    meta = parse_shard_name(file_stem(F.col("path")))
    return (
        lengths.withColumn("m", meta)
        .withColumn("label", residue_label(F.col("m.residue")))
        .where(F.col("label").isNotNull() & (F.col("n") > 0))
        .select(
            F.col("path").alias("sample_path"),
            F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sample_index"),
            "label",
            F.col("m.residue").alias("residue"),
            F.lit(split).alias("split"),
            F.col("m.pdb_id").alias("pdb_id"),
            F.col("m.chain").alias("chain"),
            F.col("m.resnum").alias("resnum"),
        )
    )


def split_file_key(path: Column) -> Column:
    """(kind, split, shard, part) of a paired shard file name."""
    name = F.substring_index(path, "/", -1)
    pattern = "^(X|y)(v|t)?(?:_smooth|_?smooth)?_?(\\d+)?_(\\d+)\\.dat$"
    letter = F.regexp_extract(name, pattern, 2)
    return F.struct(
        F.regexp_extract(name, pattern, 1).alias("kind"),
        F.when(letter == "v", "val").when(letter == "t", "test").otherwise("train").alias("split"),
        F.regexp_extract(name, pattern, 3).try_cast("int").alias("shard"),
        F.regexp_extract(name, pattern, 4).try_cast("int").alias("part"),
    )


def shard_files(spark: SparkSession, root: str) -> DataFrame:
    """(kind, split, shard, part, n, path) of the paired shard files, from their headers."""
    keyed = array_files(spark, root, "headers", "*.dat").withColumn("k", split_file_key(F.col("path"))).where("k.kind <> ''")
    return keyed.select("k.kind", "k.split", F.coalesce("k.shard", F.lit(0)).alias("shard"), "k.part", "n", "path")


def shard_gaps(
    files: DataFrame, splits: Sequence[str], parts: Sequence[int], train_shards: int | None = None
) -> DataFrame:
    """(split, part, shard, problem) of what a set of paired shards lacks.

    Expected are both kinds of every shard that any part of its split has, at
    least one shard for every split and part, and the training shards 1 to
    ``train_shards`` where a number is given; pairs must agree in their rows.
    """
    spark = files.sparkSession
    asked = spark.createDataFrame([(s, p) for s in splits for p in parts], "split string, part int")
    shards = files.select("split", "shard").distinct()
    if train_shards is not None and "train" in splits:
        numbered = spark.range(1, train_shards + 1).select(F.lit("train").alias("split"), F.col("id").cast("int").alias("shard"))
        shards = shards.unionByName(numbered).distinct()
    expected = asked.join(shards, "split", "left")
    sizes = files.groupBy("split", "part", "shard").agg(
        F.max(F.when(F.col("kind") == "X", F.col("n"))).alias("nx"), F.max(F.when(F.col("kind") == "y", F.col("n"))).alias("ny"))
    problem = (
        F.when(F.col("nx").isNull() & F.col("ny").isNull(), "no files")
        .when(F.col("nx").isNull(), "no X file").when(F.col("ny").isNull(), "no y file")
        .when(F.col("nx") != F.col("ny"), F.format_string("%d samples, %d labels", "nx", "ny"))
    )
    return expected.join(sizes, ["split", "part", "shard"], "left").select("split", "part", "shard", problem.alias("problem")).where("problem is not null")


def load_split_parts(files: DataFrame) -> DataFrame:
    """(split, part, shard, sample_index, shape, x, label) of the paired files of ``shard_files``.

    The task that reads a run of samples reads its labels too: dense rows are not
    shuffled.
    """
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    pairs = files.groupBy("split", "part", "shard").agg(of("X", "path").alias("x_path"), of("y", "path").alias("y_path"), of("X", "n").alias("n"))
    return paired_samples(pairs.where("x_path is not null").select("split", "part", "shard", "x_path", "y_path", "n"))


def read_feature_shards(spark: SparkSession, root: str, parts: Sequence[int] | None = None) -> DataFrame:
    """(split, part, sample_index, x, label) of the generic feature matrices; ``parts`` may select."""
    pattern = "^FEATURE_(train|val|test)_(X|y)(?:_(\\d+))?\\.dat$"
    name = F.substring_index("path", "/", -1)
    files = array_files(spark, root, "headers", "FEATURE_*.dat").select(
        F.regexp_extract(name, pattern, 1).alias("split"), F.regexp_extract(name, pattern, 2).alias("kind"),
        F.coalesce(F.regexp_extract(name, pattern, 3).try_cast("int"), F.lit(0)).alias("part"), F.lit(0).alias("shard"), "n", "path")
    if parts is not None:
        files = files.where(F.col("part").isin(list(parts)))
    return load_split_parts(files).select("split", "part", "sample_index", "x", F.col("label").cast("float").alias("label"))
