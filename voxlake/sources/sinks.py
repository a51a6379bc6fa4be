"""Writers with the checks the manifests must pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions.columns import ManifestError


def assert_empty(violations: DataFrame, message: str) -> None:
    """Raise with one example if any row violates a rule."""
    bad = violations.limit(1).collect()
    if bad:
        raise ManifestError(f"{message}: {bad[0].asDict()}")


def write_csv(df: DataFrame, path: str) -> None:
    """With a header in each file; values keep their white space."""
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_structures(structures: DataFrame, path: str) -> None:
    """Structure manifest; an empty result is an error."""
    if structures.isEmpty():
        raise ManifestError("no parseable structure files were found")
    write_csv(
        structures.select(
            "pdb_id", "pdb_path", F.size("chains").alias("num_chains"),
            F.concat_ws(";", "chains").alias("chains"), "num_residues", "sequence",
        ).orderBy("pdb_path"),
        path,
    )


def write_splits(splits: DataFrame, path: str, legacy_lists: bool = False) -> None:
    """Split manifest partitioned by split, plus one id list per split."""
    ordered = splits.select("structure_id", "pdb_path", "sequence", "split")
    (
        ordered.repartitionByRange("split", "pdb_path").sortWithinPartitions("split", "pdb_path")
        .write.mode("overwrite").partitionBy("split").option("header", True).csv(f"{path}/manifest")
    )
    for name in K.SPLITS:
        ids = ordered.where(F.col("split") == name).orderBy("pdb_path").select("structure_id")
        ids.write.mode("overwrite").text(f"{path}/{name}.txt")
        if legacy_lists:
            ids.write.mode("overwrite").text(f"{path}/PDB_{name}.txt")


def site_violations(sites: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows a site manifest must not have, with the broken rule."""
    if set(sites.columns) != set(K.SITE_FIELDS):
        raise ManifestError(
            f"manifest has fields {sorted(sites.columns)}, expected {sorted(K.SITE_FIELDS)}"
        )
    broken = F.lit(False)
    for name in K.SITE_FIELDS:
        broken = broken | F.col(name).cast("string").rlike("[\\r\\n]")
    rule = F.when(broken, F.lit("embedded newline")).when(
        ~F.col("sample_path").endswith(".npz"), F.lit("sample path without .npz")
    )
    found = sites.withColumn("rule", rule).where("rule is not null")
    if files is None:
        return found
    missing = sites.join(files.select(F.col("path").alias("sample_path")), "sample_path", "left_anti")
    return found.unionByName(missing.withColumn("rule", F.lit("missing file")))


def write_sites(sites: DataFrame, path: str, files: DataFrame | None = None) -> None:
    assert_empty(site_violations(sites, files), "invalid site manifest row")
    write_csv(sites.select(*K.SITE_FIELDS).orderBy("example_id"), path)


def write_activity(examples: DataFrame, root: str, path: str) -> None:
    """The ten-column activity manifest, by example id."""
    write_csv(activity_manifest(examples, root).orderBy("example_id"), path)


def activity_manifest(examples: DataFrame, root: str) -> DataFrame:
    """The ten columns of an activity manifest; a whole structure has neither chain nor residue."""
    def of_site(name: str) -> Column:
        if name not in examples.columns:
            return F.lit("").alias(name)
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(F.col("example_unit") == "whole_structure", F.lit("")).otherwise(value).alias(name)

    return examples.select(
        "example_id", "structure_id", of_site("chain_id"), of_site("res_no"), F.coalesce("mutation", F.lit("")).alias("mutation"),
        F.col("value").cast("string").alias("label"), "task",
        F.concat(F.lit(root.rstrip("/") + "/"), "structure_id", F.lit("/"), "example_id", F.lit(".npz")).alias("sample_path"),
        "channel_scheme", "example_unit",
    )


#: Samples that one task writes.
SAMPLE_ROWS = 4096


def write_samples(samples: DataFrame, path: str, buckets: int = 64) -> None:
    """Dense samples, partitioned by a hash of the structure.

    Rows are dealt by bucket first, so a bucket gets few files; a second key
    lets a bucket fill as many tasks as its rows need. ``samples`` is counted
    and then written, so it should be a written table.
    """
    bucket = F.pmod(F.xxhash64("structure_id"), F.lit(buckets)).alias("bucket")
    loads = samples.groupBy(bucket).agg(F.ceil(F.count("*") / F.lit(SAMPLE_ROWS)).cast("int").alias("salts")).collect()  # a row a bucket
    salts = F.create_map(*[F.lit(x) for r in loads for x in (r["bucket"], r["salts"])]) if loads else F.create_map(F.lit(0), F.lit(1))
    tasks = sum(r["salts"] for r in loads) or 1
    bucketed = samples.withColumn("bucket", bucket)
    salt = F.pmod(F.xxhash64("example_id"), F.element_at(salts, F.col("bucket")))
    bucketed.repartition(tasks, "bucket", salt).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_bundles(rows: DataFrame, path: str, details: dict[str, object]) -> None:
    """Samples per (split, part) and one metadata row each, as JSON.

    Rows are dealt by part and run of samples, so a part has one file for each
    run; metadata comes from the shapes written.
    """
    spark, width = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = F.expr(f"sample_index div {SAMPLE_ROWS}")
    dealt = rows.repartition(width, "split", "part", "shard", run) if {"shard", "sample_index"} <= set(rows.columns) else rows
    dealt.write.mode("overwrite").partitionBy("split", "part").parquet(f"{path}/data")
    written = spark.read.schema(rows.select("split", "part", "shape").schema).parquet(f"{path}/data")
    meta = bundle_metadata(written).withColumns(
        {k: F.lit(v) if not isinstance(v, dict)
         else F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) for k, v in details.items()}
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def bundle_metadata(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "part").agg(
        F.count("*").alias("sample_count"),
        F.concat(F.array(F.count("*").cast("int")), F.first("shape")).alias("data_shape"),
        F.array(F.count("*").cast("int")).alias("label_shape"),
    )


def prediction_columns(predictions: DataFrame, output_probs: bool = False) -> DataFrame:
    """Text form of predictions for CSV; Parquet keeps the doubles."""
    cols = [
        "structure_name", "site", "predicted", "actual", "predicted_type", "actual_type",
        F.format_string("%.6f", "entropy").alias("entropy"),
    ]
    if output_probs:
        cols += [
            F.col("predicted_index").cast("string").alias("predicted_index"),
            F.coalesce(F.col("actual_index").cast("string"), F.lit("")).alias("actual_index"),
            F.format_string("%.6f", "confidence").alias("confidence"),
            F.array_join(F.transform("topk", lambda t: t["idx"].cast("string")), "|").alias("topk_indices"),
            F.array_join(F.transform("topk", lambda t: t["label"]), "|").alias("topk_labels"),
        ]
    return predictions.select(*cols)


def write_predictions(predictions: DataFrame, path: str, output_probs: bool = False) -> None:
    write_csv(prediction_columns(predictions, output_probs), path)


def augmented_columns(rows: DataFrame, original: Sequence[str], added: Sequence[str]) -> DataFrame:
    """Original columns followed by the added ones they do not hold yet."""
    return rows.select(*original, *[c for c in added if c not in original])


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def report_table(table: DataFrame) -> DataFrame:
    """Text form of a report table: six decimals, lists joined by ';'."""
    def text(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return F.when(F.col(name).isNotNull(), F.format_string("%.6f", name))
        if kind.startswith("array"):
            return F.array_join(F.col(name).cast("array<string>"), ";")
        return F.col(name).cast("string")

    return table.select(*[text(name, kind).alias(name) for name, kind in table.dtypes])


def write_report_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table of a prediction report as CSV."""
    for name, table in tables.items():
        write_csv(report_table(table), f"{folder.rstrip('/')}/{name}")


def write_stats(row: DataFrame, sizes: DataFrame, out: str) -> None:
    """Normalisation statistics (one row) and the split sizes they stand for."""
    row.write.mode("overwrite").parquet(f"{out}/normalization_stats")
    sizes.coalesce(1).write.mode("overwrite").json(f"{out}/normalization_meta")


def wide_confusion(cells: DataFrame, names: Sequence[str], header: str) -> DataFrame:
    """Square confusion table with a fixed column order."""
    return (
        cells.groupBy(F.col("actual").alias(header))
        .pivot("predicted", list(names))
        .agg(F.sum("n"))
        .na.fill(0)
    )
