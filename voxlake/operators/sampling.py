"""Sampling without replacement, class balancing and stratified splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.ranking import rank_by_hash, seeded_hash
from voxlake.operators.skew import lookup_join
from voxlake.runtime import cut_lineage

#: Hexadecimal digits of the order key that one level of a threshold search counts.
DIGITS = 3
#: Groups whose thresholds are broadcast; more of them are joined.
SMALL = 100_000


def sample_n(df: DataFrame, n: int | None, key: Sequence[str], seed: int) -> DataFrame:
    """Exactly n rows (or all), uniformly, the same ones for the same seed."""
    if n is None or n <= 0:
        return df
    return rank_by_hash(df, [], key, seed, "_rank", at_most=n).drop("_rank", "_total")


def sample_per_group(
    df: DataFrame, groups: Sequence[str], n: int, key: Sequence[str], seed: int
) -> DataFrame:
    """At most n rows of every group."""
    return rank_by_hash(df, groups, key, seed, "_rank", at_most=n).drop("_rank", "_total")


def _first_of_groups(df: DataFrame, groups: Sequence[str], quota: Column, key: Sequence[str], seed: int, name: str) -> DataFrame:
    """Add the flag ``name``: whether a row is among the first of its group in seeded-hash order of ``key``.

    ``quota`` says how many of a group are first, from ``_n``, its number of rows,
    and ``_least``, that of the smallest group. No row is ranked or exchanged: rows
    are counted by the leading digits of their hash, which shows in which bin
    each group's threshold lies; only bins that hold a threshold are counted by
    their next digits. Rows are then compared with their group's threshold. Rows
    whose keys are equal are told apart only if the threshold parts them.
    """
    hashed = df.withColumns({"_g": F.struct(*groups), "_hash": seeded_hash(seed, *[F.col(k) for k in key])})

    def histogram(rows: DataFrame, digits: int) -> DataFrame:
        return rows.groupBy("_g", F.substring("_hash", 1, digits).alias("_bin")).agg(F.count("*").alias("_b"))

    counts = cut_lineage(histogram(hashed, DIGITS))
    sizes = counts.groupBy("_g").agg(F.sum("_b").alias("_n"))
    least = sizes.agg(F.min("_n").alias("_least"))
    open_ = sizes.crossJoin(F.broadcast(least)).select("_g", quota.cast("bigint").alias("_need"))  # one row
    settled: DataFrame | None = None
    for digits in range(DIGITS, 32 + DIGITS, DIGITS):
        before = Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_o", F.coalesce(F.sum("_b").over(before), F.lit(0))).join(open_, "_g")
        # the bin that holds the last row wanted; a quota of none ends before the first bin
        cut = cut_lineage(placed.where((F.col("_o") < F.col("_need")) & (F.col("_need") <= F.col("_o") + F.col("_b"))).select(
            "_g", "_bin", (F.col("_need") - F.col("_o")).alias("_need"), "_b"))
        whole = (F.col("_need") == F.col("_b")) | F.lit(digits >= 32)
        done = cut.where(whole).select("_g", "_bin", F.col("_need").alias("_tie"), (F.col("_need") == F.col("_b")).alias("_all"))
        settled = done if settled is None else settled.unionByName(done)
        open_ = cut.where(~whole).select("_g", "_bin", "_need")
        found = open_.limit(SMALL + 1).count()
        if not found:
            break
        inside = _of_bin(hashed, open_, digits, found <= SMALL)
        counts, open_ = cut_lineage(histogram(inside, digits + DIGITS)), open_.drop("_bin")
    bounds = cut_lineage(settled.select("_g", F.concat("_bin", F.when(F.col("_all"), "~").otherwise("")).alias("_bound"), F.when(~F.col("_all"), F.col("_tie")).alias("_tie")))
    few = bounds.limit(SMALL + 1).count() <= SMALL
    placed = hashed.join(F.broadcast(bounds), "_g", "left") if few else lookup_join(hashed, bounds, ["_g"], "left")
    first = F.coalesce(F.col("_hash") < F.col("_bound"), F.lit(False))
    if not bounds.where("_tie is not null").isEmpty():  # equal keys at a threshold
        order = Window.partitionBy("_g", "_hash").orderBy(*key)
        placed = placed.withColumn("_at", F.when(F.col("_hash") == F.col("_bound"), F.row_number().over(order)))
        first = first | F.coalesce(F.col("_at") <= F.col("_tie"), F.lit(False))
    return placed.withColumn(name, first).drop("_g", "_hash", "_bound", "_tie", "_at")


def _of_bin(hashed: DataFrame, cut: DataFrame, digits: int, few: bool) -> DataFrame:
    """Rows in the bin that holds their group's threshold."""
    keyed = hashed.withColumn("_bin", F.substring("_hash", 1, digits))
    wanted = cut.select("_g", "_bin")
    return (keyed.join(F.broadcast(wanted), ["_g", "_bin"], "left_semi") if few else lookup_join(keyed, wanted, ["_g", "_bin"], "left_semi")).drop("_bin")


def downsample_to_minimum(df: DataFrame, label: str, key: Sequence[str], seed: int) -> DataFrame:
    """The same number of rows for every label: that of the rarest one."""
    return _first_of_groups(df, [label], F.col("_least"), key, seed, "_first").where("_first").drop("_first")


def balance(df: DataFrame, mode: str, label: str, key: Sequence[str], seed: int) -> DataFrame:
    if mode in ("none", "weighted_loss"):
        return df
    if mode == "downsample":
        return downsample_to_minimum(df, label, key, seed)
    raise ValueError(f"unknown balance mode {mode!r}")


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], val_fraction: float, seed: int
) -> DataFrame:
    """Rewrite ``split``: per label round-half-even(n * fraction) rows to val."""
    to_val = F.bround(F.col("_n") * F.lit(float(val_fraction)))
    placed = _first_of_groups(df, [label], to_val, key, seed, "_first")
    return placed.withColumn("split", F.when(F.col("_first"), F.lit("val")).otherwise(F.lit("train"))).drop("_first")
