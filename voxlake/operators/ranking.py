"""Exact ranks, running totals and quantiles without one-task windows.

A plain window partitioned by a group sorts the whole group in one task. Here
every group is cut into order-preserving buckets first: the window runs inside
(group, bucket), and a small table of bucket totals supplies the offset. The
result is the exact rank or running total at any group size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.runtime import cut_lineage


def bucket_count(df: DataFrame) -> int:
    """Buckets of a group: several for each shuffle partition, so no window limits the width."""
    return max(128, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_count(df: DataFrame) -> int:
    """Ranges over all groups: two for each shuffle partition."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def seeded_hash(seed: int | str, *key: Column) -> Column:
    """Uniform hexadecimal order key; the same in every run for a seed."""
    return F.md5(F.concat_ws("_", F.lit(str(seed)), *[k.cast("string") for k in key]))


def _group_key(groups: Sequence[str]) -> Column:
    """One never-NULL key per group, so that joins and windows share it."""
    return F.struct(*groups) if groups else F.lit(0)


def _bucket_offsets(keyed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """One row per (_g, _bucket): its own totals ``_t_*``, those of all earlier
    buckets ``_o_*`` and those of the whole group ``_s_*``.
    """
    per_bucket = keyed.groupBy("_g", "_bucket").agg(*[c.alias(f"_t_{n}") for n, c in sums.items()])
    order = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("_g")
    return per_bucket.select(
        "_g", "_bucket", *[f"_t_{n}" for n in sums],
        *[F.coalesce(F.sum(f"_t_{n}").over(order), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(everything).alias(f"_s_{n}") for n in sums],
    )


def _with_offsets(
    df: DataFrame, groups: Sequence[str], sums: dict[str, Column], before: int | None = None
) -> DataFrame:
    """Add the group key ``_g`` and the offsets ``_o_*`` and totals ``_s_*`` of each row's bucket.

    The join and the windows of the callers use the same key (_g, _bucket),
    so the rows are exchanged once. Without groups the buckets are few and
    known in number, so they are broadcast. ``before`` keeps only buckets with
    less than so many rows (sum ``n``) ahead of them.
    """
    keyed = df.withColumn("_g", _group_key(groups))
    offsets = _bucket_offsets(keyed, sums).drop(*[f"_t_{n}" for n in sums])
    if before is not None:
        offsets = offsets.where(F.col("_o_n") < before)
    return keyed.join(offsets if groups else F.broadcast(offsets), ["_g", "_bucket"])


def rank_by_hash(
    df: DataFrame, groups: Sequence[str], key: Sequence[str], seed: int | str,
    name: str = "rank", total: str = "_total", at_most: int | None = None,
) -> DataFrame:
    """1-based rank inside each group in seeded-hash order of ``key``, and the
    number of rows of the group as ``total``.

    The leading hash digits are the buckets: uniform, so even a group that
    holds a third of all rows spreads over all tasks. ``at_most`` leaves out
    later rows; buckets that hold none of the first go before the exchange.
    """
    digits = 3
    while 16**digits < bucket_count(df):
        digits += 1
    hashed = df.withColumn("_hash", seeded_hash(seed, *[F.col(k) for k in key])).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    placed = _with_offsets(hashed, groups, {"n": F.count("*")}, at_most)
    inside = Window.partitionBy("_g", "_bucket").orderBy("_hash", *key)
    ranked = placed.withColumn(
        name, (F.row_number().over(inside) + F.col("_o_n")).cast("bigint")
    ).withColumnRenamed("_s_n", total).drop("_hash", "_bucket", "_g", "_o_n")
    return ranked if at_most is None else ranked.where(F.col(name) <= at_most)


def rank_in_order(df: DataFrame, groups: Sequence[str], order: str, name: str = "rank") -> DataFrame:
    """1-based rank inside each group by a distinct, sortable order column."""
    placed = _with_offsets(range_bucketed(df, groups, order), groups, {"n": F.count("*")})
    inside = Window.partitionBy("_g", "_bucket").orderBy(order)
    return placed.withColumn(
        name, (F.row_number().over(inside) + F.col("_o_n")).cast("bigint")
    ).drop("_bucket", "_g", "_o_n", "_s_n")


def range_bucketed(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Add ``_bucket``, which follows the order of the values in every group.

    The buckets are the partitions of one range exchange over (groups, value):
    a group of any share of the rows is cut into as many as it fills. They are
    written once, since sampled bounds need not be the same in a second run.
    """
    ranged = df.repartitionByRange(range_count(df), *groups, value)
    return cut_lineage(ranged.withColumn("_bucket", F.spark_partition_id()))


def running_totals(
    df: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Inclusive running totals ``cum_<name>`` of the sums, by value order.

    ``df`` must hold one row per (group, value): ties are added up before, so
    a value shared by a third of the rows is a single row here.
    """
    bucketed = range_bucketed(df, groups, value)
    if descending:
        bucketed = bucketed.withColumn("_bucket", -F.col("_bucket"))
    placed = _with_offsets(bucketed, groups, {s: F.sum(s) for s in sums})
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy("_g", "_bucket").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return placed.withColumns(
        {f"cum_{s}": F.sum(s).over(inside) + F.col(f"_o_{s}") for s in sums}
    ).drop("_bucket", "_g", *[f"{c}{s}" for s in sums for c in ("_o_", "_s_")])


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, quantiles: Sequence[float]
) -> DataFrame:
    """(groups, q, quantile): linear interpolation between order statistics.

    Bucket totals tell which buckets hold a wanted rank; only their values are
    exchanged and ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(
        *groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    keyed = range_bucketed(counts, groups, "_v").withColumn("_g", _group_key(groups))

    def inside(rank: Column, start: Column, stop: Column) -> Column:
        return (F.floor(rank) >= start) & (F.floor(rank) < stop) | (F.ceil(rank) >= start) & (F.ceil(rank) < stop)

    spots = F.transform(
        F.array(*[F.lit(float(q)) for q in quantiles]),
        lambda q: F.struct(q.alias("q"), (q * (F.col("_s_n") - 1)).alias("at")),
    )
    start = F.col("_o_n")
    wanted = _bucket_offsets(keyed, {"n": F.sum("n")}).select(
        "_g", "_bucket", "_o_n",
        F.filter(spots, lambda t: inside(t["at"], start, start + F.col("_t_n"))).alias("_spots"),
    ).where(F.size("_spots") > 0)
    # without groups at most two buckets for each quantile
    placed = keyed.join(wanted if groups else F.broadcast(wanted), ["_g", "_bucket"])
    order = Window.partitionBy("_g", "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("_upto", F.sum("n").over(order) + F.col("_o_n"))
    before, upto = F.col("_upto") - F.col("n"), F.col("_upto")
    hits = ranked.select(
        *groups, "_v", before.alias("_before"), "_upto",
        F.explode(F.filter("_spots", lambda t: inside(t["at"], before, upto))).alias("t"),
    )

    def covers(rank: Column) -> Column:
        return (rank >= F.col("_before")) & (rank < F.col("_upto"))

    low = F.max(F.when(covers(F.floor("t.at")), F.col("_v")))
    high = F.max(F.when(covers(F.ceil("t.at")), F.col("_v")))
    share = F.first("t.at") - F.floor(F.first("t.at"))
    return hits.groupBy(*groups, F.col("t.q").alias("q")).agg(
        (low + (high - low) * share).alias("quantile")
    )
