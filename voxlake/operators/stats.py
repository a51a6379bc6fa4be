"""Normalisation statistics and class weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.columns import ManifestError
from voxlake.runtime import cut_lineage

STD_FLOOR = 1e-6
VARIANCE_FLOOR = 1e-12


#: Vectors that one task merges, and cells of a vector that travel together.
FAN_IN = 32

MOMENTS = "part int, n bigint, mean array<double>, square array<double>"


def merged_moments(a: tuple | None, b: tuple) -> tuple:
    """(n, mean, centred squares) of two disjoint sets from those of each."""
    if a is None:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * (b[0] / n))


def _moment_rows(held: dict) -> pa.RecordBatch:
    keys = list(held)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()),
         pa.array([held[k][1] for k in keys], pa.list_(pa.float64())), pa.array([held[k][2] for k in keys], pa.list_(pa.float64()))],
        names=["part", "n", "mean", "square"])


def moments(samples: DataFrame, x: str, part: str | None = None, channels: int | None = None) -> DataFrame:
    """(part, n, mean, square): count, mean and centred squares of each array position, or of each channel.

    Each task centres its batches before squaring and merges them; tasks' vectors
    are written and merged pairwise by levels of FAN_IN, as many as the tasks
    need, so the number of input partitions may be any. Every sample counts once
    for a position, and once for each cell of a channel.
    """
    def of_samples(batches):
        held: dict = {}
        for record in batches:
            if not record.num_rows:
                continue
            column = record.column(1)
            lengths = np.asarray(column.value_lengths())
            if (lengths != lengths[0]).any() or channels and lengths[0] % channels:
                raise ValueError("samples differ in their channel count or size")
            parts = np.asarray(record.column(0))
            block = np.asarray(column.flatten(), dtype=np.float64).reshape(record.num_rows, channels or -1, *([-1] if channels else []))
            axes = (0, 2) if channels else (0,)
            for key in np.unique(parts):
                mine = block[parts == key]
                mean = mine.mean(axis=axes)
                mine -= mean[None, :, None] if channels else mean
                n = len(mine) * (mine.shape[2] if channels else 1)
                if n:
                    held[int(key)] = merged_moments(held.get(int(key)), (n, mean, np.square(mine).sum(axis=axes)))
        if held:
            yield _moment_rows(held)

    def of_vectors(batches):
        held: dict = {}
        for record in batches:
            for i in range(record.num_rows):
                key, n = record.column(0)[i].as_py(), record.column(1)[i].as_py()
                held[key] = merged_moments(held.get(key), (n, *(np.asarray(record.column(c)[i].values) for c in (2, 3))))
        if held:
            yield _moment_rows(held)

    key = F.lit(0) if part is None else F.col(part).cast("int")
    now = cut_lineage(samples.select(key.alias("part"), x).mapInArrow(of_samples, MOMENTS))
    groups = now.select("part").distinct().count()
    tasks = -(-now.count() // max(1, groups))
    while tasks > 1:  # one level of the tree
        tasks = -(-tasks // FAN_IN)
        dealt = now.withColumn("_b", F.pmod(F.monotonically_increasing_id(), F.lit(tasks))) if tasks > 1 else now.withColumn("_b", F.lit(0))
        now = cut_lineage(dealt.repartition(tasks * groups, "part", "_b").drop("_b").mapInArrow(of_vectors, MOMENTS))
        tasks = -(-now.count() // max(1, groups)) if tasks > 1 else 1
    return now


def _spread_of(square, n, floor: float = STD_FLOOR):
    return F.greatest(F.sqrt(F.greatest(square / n, F.lit(0.0))), F.lit(floor)).alias("std")


def _finish(sum_, square, count, floor: float = STD_FLOOR):
    mean = sum_ / count
    variance = F.greatest(square / count - mean * mean, F.lit(0.0))
    return mean.alias("mean"), F.greatest(F.sqrt(variance), F.lit(floor)).alias("std")


def channel_stats(samples: DataFrame, channels: int, x: str = "x") -> DataFrame:
    """(ch, mean, std) over all cells of all samples, zeros included."""
    rows = moments(samples, x, None, channels)
    cells = rows.select("n", F.posexplode(F.arrays_zip("mean", "square")).alias("ch", "p"))
    return cells.select("ch", F.col("p.mean").alias("mean"), _spread_of(F.col("p.square"), F.col("n")))


def global_stats(samples: DataFrame, x: str = "x") -> DataFrame:
    """One (mean, std) row over every cell; no samples is an error downstream."""
    return channel_stats(samples, 1, x).drop("ch")


def sparse_channel_stats(
    cells: DataFrame, n_samples: DataFrame, cells_per_channel: int
) -> DataFrame:
    """Channel stats of sparse voxels; absent cells count as zeros.

    ``n_samples`` is one row with the column ``n_samples``.
    """
    sums = cells.groupBy("ch").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    count = F.col("n_samples") * F.lit(float(cells_per_channel))
    return sums.crossJoin(F.broadcast(n_samples)).select(  # one row
        "ch", *_finish(F.col("s"), F.col("q"), count)
    )


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select("part", "n", F.posexplode(F.arrays_zip("mean", "square")).alias("cell", "p"))


def voxelwise_stats(samples: DataFrame, x: str = "x") -> DataFrame:
    """(cell, mean, std) per array position."""
    variance = F.greatest(F.col("p.square") / F.col("n"), F.lit(VARIANCE_FLOOR))
    return _cells(moments(samples, x)).select("cell", F.col("p.mean").alias("mean"), F.sqrt(variance).alias("std"))


def mean_of_part_means(samples: DataFrame, part: str, x: str = "x") -> DataFrame:
    """Legacy (cell, mean): every part weighs the same, whatever its size."""
    return _cells(moments(samples, x, part)).groupBy("cell").agg(F.avg("p.mean").alias("mean"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) for 0..max label; absent labels weigh 0."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(
        F.sum("n").alias("_total"), F.count("*").alias("_present"), F.max(label).alias("_max")
    )
    slots = totals.where("_max is not null").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_max").cast("bigint"))).alias(label),
        "_total", "_present",
    )
    return slots.join(counts, label, "left").select(
        label,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.col("_total") / (F.col("_present") * F.col("n")), F.lit(0.0)).alias("weight"),
    )


def stats_row(stats: DataFrame, key: str | None, mode: str, num_samples: int, seed: int,
              weights: DataFrame | None = None) -> DataFrame:
    """One-row table of the statistics as arrays."""
    if key is None:
        arrays = stats.select(F.array("mean").alias("mean"), F.array("std").alias("std"))
    else:
        ordered = F.array_sort(F.collect_list(F.struct(key, "mean", "std")))
        arrays = stats.agg(ordered.alias("_r")).select(
            F.transform("_r", lambda r: r["mean"]).alias("mean"),
            F.transform("_r", lambda r: r["std"]).alias("std"),
        )
    out = arrays.where(F.size("mean") > 0).withColumns({
        "mode": F.lit(mode), "num_samples": F.lit(num_samples).cast("bigint"),
        "seed": F.lit(seed).cast("bigint"),
    })
    if weights is None:
        return out.withColumn("class_weights", F.lit(None).cast("array<double>"))
    listed = F.array_sort(F.collect_list(F.struct("label", "weight")))
    w = weights.agg(F.transform(listed, lambda r: r["weight"]).alias("class_weights"))
    return out.crossJoin(F.broadcast(w))  # one row, one number per class


def split_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def normalize(samples: DataFrame, stats: DataFrame, floor: float = STD_FLOOR,
              batch: int = 256) -> DataFrame:
    """(x - mean) / max(std, floor) in Arrow batches.

    ``stats`` is the one-row table: 1, C or all-cell values.
    """
    row = stats.select("mean", "std").first()
    if row is None:
        raise ManifestError("no normalisation statistics")
    return _scaled(samples, row["mean"], np.maximum(np.asarray(row["std"], dtype=np.float64), floor), batch)


def _scaled(samples: DataFrame, mean: Sequence[float], std: Sequence[float], batch: int = 256) -> DataFrame:
    mean, std = np.asarray(mean, dtype=np.float64), np.asarray(std, dtype=np.float64)
    names = samples.columns
    at = names.index("x")

    def scale(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                record = whole.slice(start, batch)
                column = record.column(at)
                flat = np.asarray(column.flatten(), dtype=np.float64)
                block = flat.reshape(record.num_rows, len(mean), -1)
                scaled = (block - mean[None, :, None]) / std[None, :, None]
                x = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))]).astype(np.int32)),
                    pa.array(scaled.astype(np.float32).ravel()),
                )
                columns = [x if i == at else record.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return samples.mapInArrow(scale, samples.schema)


def center_on_mean(samples: DataFrame, mean: Sequence[float]) -> DataFrame:
    """x - mean only; the mean has one value per cell (model-sized, fixed)."""
    return _scaled(samples, mean, np.ones(len(mean)))
