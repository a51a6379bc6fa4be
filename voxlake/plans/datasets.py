"""Normalisation, prepared datasets and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.columns import ManifestError
from voxlake.operators import sampling, stats
from voxlake.runtime import cut_lineage
from voxlake.sources.samples import discover_shards, load_split_parts, read_feature_shards, read_samples, shard_files, shard_gaps
from voxlake.sources.sinks import write_bundles, write_csv, write_stats


def compute_normalization(
    samples: DataFrame, mode: str = "per-channel", max_samples: int | None = None,
    seed: int = 1337, key: str = "sample_path",
) -> DataFrame:
    """One-row statistics of all dense samples, or of ``max_samples`` of them on request."""
    keys = [key] + (["sample_index"] if "sample_index" in samples.columns else [])
    total = samples.count()
    if not total:
        raise ManifestError("manifest is empty")
    picked = sampling.sample_n(samples, max_samples, keys, seed) if (
        max_samples and total > max_samples) else samples
    used = min(total, max_samples) if max_samples and max_samples > 0 else total
    if mode == "global":
        return stats.stats_row(stats.global_stats(picked), None, mode, used, seed)
    counts = picked.select(F.get("shape", F.lit(0)).alias("c")).distinct().limit(2).collect()
    if len(counts) != 1:
        raise ManifestError("samples differ in their channel count")
    per_channel = stats.channel_stats(picked, counts[0]["c"])
    return stats.stats_row(per_channel, "ch", mode, used, seed)


def prepare_dataset(
    spark: SparkSession, root: str, out: str, val_fraction: float = 0.05,
    balance_mode: str = "downsample", seed: int = 1337,
) -> DataFrame:
    """Shards -> balanced, split manifests and voxel-wise statistics."""
    key = ["sample_path", "sample_index"]
    train = discover_shards(spark, f"{root}/train", "train")
    test = discover_shards(spark, f"{root}/test", "test")
    balanced = sampling.balance(train, balance_mode, "label", key, seed)
    split = cut_lineage(sampling.stratified_split(balanced, "label", key, val_fraction, seed))
    columns = ["sample_path", "sample_index", "label", "residue", "split", "pdb_id", "chain", "resnum"]
    for name, rows in (
        ("train", split.where("split = 'train'")), ("val", split.where("split = 'val'")), ("test", test),
    ):
        write_csv(rows.select(*columns), f"{out}/manifest_{name}.csv")
    chosen = split.where("split = 'train'")
    used = read_samples(spark, chosen.select(*key), f"{root}/train")
    n = chosen.count()
    if not n:
        raise ManifestError("the training split is empty")
    weights = stats.class_weights(chosen) if balance_mode == "weighted_loss" else None
    row = stats.stats_row(stats.voxelwise_stats(used), "cell", "voxel-wise", n, seed, weights)
    write_stats(row, stats.split_sizes(split.select("split").unionByName(test.select("split"))), out)
    return row


def convert_bundles(
    spark: SparkSession, root: str, out: str, splits: list[str], parts: list[int],
    train_shards: int | None = None, details: dict | None = None,
) -> None:
    """Paired shards -> one partition per (split, part) with metadata.

    Every shard found is used. ``train_shards`` says how many the training
    split must have. Nothing is written when a shard is missing, has no partner
    or differs from it in its number of rows. Headers are read once, samples
    once; metadata comes from the rows written.
    """
    wanted = F.col("split").isin(splits) & F.col("part").isin(parts)
    files = cut_lineage(shard_files(spark, root).where(wanted))
    gaps = shard_gaps(files, splits, parts, train_shards)
    if found := gaps.orderBy("split", "part", "shard").limit(20).collect():  # the message names the first
        named = ", ".join(f"{g['split']}/part {g['part']}/shard {g['shard']}: {g['problem']}" for g in found)
        raise ManifestError(f"incomplete input arrays: {named}")
    write_bundles(load_split_parts(files), out, details or {})


def legacy_atom_box(bundles: DataFrame, parts: int, mean: list[float] | None = None,
                    eval_splits: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Train parts plus the first part of the other splits, mean-centred."""
    rows = bundles.where(
        ((F.col("split") == "train") & F.col("part").between(1, parts))
        | (F.col("split").isin(*eval_splits) & (F.col("part") == 1))
    )
    if mean is None:
        cells = stats.mean_of_part_means(rows.where("split = 'train'"), "part")
        listed = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "mean"))).alias("m")).first()["m"]
        mean = [r["mean"] for r in listed]
    return stats.center_on_mean(rows, mean)


def feature_dataset(spark: SparkSession, root: str) -> DataFrame:
    """Generic feature matrices minus the training mean."""
    rows = read_feature_shards(spark, root)
    cells = stats.voxelwise_stats(rows.where("split = 'train'"))
    listed = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "mean"))).alias("m")).first()["m"]
    return stats.center_on_mean(rows, [r["mean"] for r in listed])
