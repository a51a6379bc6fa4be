"""Duplicate and overlap counts between splits."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions.columns import ManifestError


def check_columns(df: DataFrame, requested: Sequence[str] | None = None) -> list[str]:
    """Key columns of the check; a missing one is an error."""
    if requested is None:
        names = ["example_id"] if "example_id" in df.columns else ["structure_id"]
    else:
        names = [c.strip() for c in requested if c.strip()]
        if not names:
            raise ManifestError("at least one key column is needed")
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ManifestError(f"manifest is missing the columns {missing}")
    return names


def _key_counts(rows: DataFrame, keys: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Rows per split for every distinct trimmed key: one exchange."""
    trimmed = [
        F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(f"_k{i}")
        for i, k in enumerate(keys)
    ]
    return rows.groupBy(*trimmed).agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits]
    )


def leakage_report(
    rows: DataFrame, keys: Sequence[str], splits: Sequence[str] = tuple(K.SPLITS)
) -> DataFrame:
    """One row: dup_<split>, overlap_<a>__<b>, has_issues."""
    counts = _key_counts(rows, keys, splits)
    dups = [
        F.coalesce(F.sum(F.greatest(F.col(f"n_{s}") - 1, F.lit(0))), F.lit(0)).alias(f"dup_{s}")
        for s in splits
    ]
    overlaps = [
        F.count_if((F.col(f"n_{a}") > 0) & (F.col(f"n_{b}") > 0)).alias(f"overlap_{a}__{b}")
        for a, b in combinations(splits, 2)
    ]
    report = counts.agg(*dups, *overlaps)
    issue = F.lit(False)
    for c in report.columns:
        issue = issue | (F.col(c) > 0)
    return report.withColumn("has_issues", issue)


def duplicates_per_split(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(split, rows, distinct_keys, duplicates)."""
    per_key = rows.groupBy(
        "split", *[F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(f"_k{i}")
                   for i, k in enumerate(keys)]
    ).agg(F.count("*").alias("_n"))
    return per_key.groupBy("split").agg(
        F.sum("_n").alias("n_rows"),
        F.count("*").alias("distinct_keys"),
        (F.sum("_n") - F.count("*")).alias("duplicates"),
    )


def overlap_pairs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(left_split, right_split, n) for every pair of splits sharing keys."""
    per_key = rows.groupBy(
        *[F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(f"_k{i}")
          for i, k in enumerate(keys)]
    ).agg(F.array_sort(F.collect_set("split")).alias("in_splits"))
    pairs = F.flatten(F.transform(
        "in_splits",
        lambda a: F.transform(
            F.filter("in_splits", lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r"))
        ),
    ))
    return (
        per_key.where(F.size("in_splits") > 1).select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.l").alias("left_split"), F.col("p.r").alias("right_split"))
        .agg(F.count("*").alias("n"))
    )


def shared_keys(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Distinct keys that occur in both splits."""
    a = rows.where(F.col("split") == left).select(key)
    b = rows.where(F.col("split") == right).select(key)
    return a.intersect(b)


def shared_families(members: DataFrame, families: DataFrame, left: str, right: str) -> DataFrame:
    """Families that have members in both splits.

    ``members`` is (id, split), ``families`` (id, family). The pairs are made
    distinct before they meet, so a family is compared once per split.
    """
    tagged = (
        members.select("id", "split").distinct()
        .join(families.select("id", "family").distinct(), "id")
        .groupBy("family")
        .agg(
            F.count_if(F.col("split") == left).alias(f"n_{left}"),
            F.count_if(F.col("split") == right).alias(f"n_{right}"),
        )
    )
    return tagged.where((F.col(f"n_{left}") > 0) & (F.col(f"n_{right}") > 0))
