"""Whitening of embeddings by covariances from squares alone.

With c a centred value, cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. So one
pass adds up squares of every dimension and of every sum of two dimensions, in
whole numbers: entries are integers, centred at the integer next to the mean;
what that leaves (n times the mean of the centred values, squared) is taken off
exactly. The matrix is assembled from differences and decomposed on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.shared import columns, slices, stored

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: A component counts as without variance below this share of the largest eigenvalue.
FLAT = 1e-12


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x array<bigint>: entries as integers, of vectors without null or non-finite entries.

    Vectors have as many entries as most do (of equally common lengths the
    longer); the others lack entries and are dropped like those with nulls, and
    so are empty ones. An entry whose integer exceeds a long is an error.
    """
    entries = F.transform("embedding", lambda c: c.cast("double"))
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    common = good.groupBy(F.size("c").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("n")).first()
    if common is None:
        return good.select("vec_id", F.col("c").cast("array<bigint>").alias("x")).limit(0)
    return good.where(F.size("c") == common["n"]).select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    values = batch[name]
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1)


def _exact(x: np.ndarray) -> np.ndarray:
    """Integers whose sums and squares fit: 64-bit where safe, else Python's."""
    return x if not x.size or max(abs(int(x.max())), abs(int(x.min()))) < 1 << 24 else x.astype(object)


def _sums(vectors: DataFrame, fn, rows: int = 4096) -> dict[int, int]:
    """Exact sums by position of fn(matrix) -> vector, over all vectors.

    Each task adds up its own and sends one row for each position; d (d + 1) / 2
    positions reach the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in slices(batches, rows):
            found = fn(_matrix(part)).astype(object)
            total = found if total is None else total + found
        if total is not None:
            yield columns(at=pa.array(range(len(total)), pa.int32()), value=pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)))

    added = vectors.mapInArrow(run, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value"))
    return {r["at"]: int(r["value"]) for r in added.collect()}


@dataclass
class Moments:
    """n, sums of each dimension, and n * n * n times the covariance matrix, all whole numbers."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def covariance(self) -> np.ndarray:
        return np.array([[float(_ratio(v, self.n**3)) for v in row] for row in self.products])


def _ratio(a: int, b: int) -> float:
    return a / b  # of Python's integers: correctly rounded


def polarised(vectors: DataFrame) -> Moments | None:
    """Moments of x from squares of dimensions and of sums of two dimensions; None without vectors."""
    n = vectors.count()
    if not n:
        return None
    sums = _sums(vectors, lambda x: _exact(x).sum(0))
    d = len(sums)
    s = [sums[i] for i in range(d)]
    centre = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)

    def squares(x: np.ndarray) -> np.ndarray:
        y = _exact(x - centre)
        return np.concatenate([((y[:, i : i + 1] + y[:, i + 1 :]) ** 2).sum(0) if i >= 0 else (y**2).sum(0) for i in range(-1, d - 1)])

    found = _sums(vectors, squares)
    left = [v - n * int(c) for v, c in zip(s, centre, strict=True)]  # sums of the centred values

    def variance(q: int, t: int) -> int:
        return n * (n * q - t * t)  # n cubed times the variance, for squares q and sum t

    own = [variance(found[i], left[i]) for i in range(d)]
    products = [[own[i] if i == j else 0 for j in range(d)] for i in range(d)]
    at = d
    for i in range(d):
        for j in range(i + 1, d):
            both = variance(found[at], left[i] + left[j])
            products[i][j] = products[j][i] = (both - own[i] - own[j]) // 2
            at += 1
    return Moments(n, s, products)


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1].copy(), v[:, ::-1].copy()
    v *= np.sign(v[np.abs(v).argmax(0), np.arange(len(e))])
    return e, v


def _identity_error(scores: DataFrame, k: int, live: int) -> float:
    """Largest absolute entry of the scores' covariance minus the identity, over components with variance.

    Each batch is centred before it is multiplied; means and products of tasks
    are merged pairwise by the same rule, at most one row a task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for part in slices(batches, 65_536):
            z = _matrix(part, "z")[:, :live]
            state = _merge(state, (len(z), z.mean(0), (z - z.mean(0)).T @ (z - z.mean(0))))
        if state is not None:
            yield columns(n=pa.array([state[0]], pa.int64()), mean=pa.array([state[1]]), products=pa.array([state[2].ravel()]))

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for r in batch.to_pylist():
                state = _merge(state, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(live, live)))
        if state is not None:
            yield columns(n=pa.array([state[0]], pa.int64()), mean=pa.array([state[1]]), products=pa.array([state[2].ravel()]))

    schema = "n long, mean array<double>, products array<double>"
    parts = scores.mapInArrow(run, schema)
    width = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    state = None
    for r in parts.repartition(width).mapInArrow(merged, schema).collect():  # width rows of live * live numbers
        state = _merge(state, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(live, live)))
    return float(np.abs(state[2] / state[0] - np.eye(live)).max())


def _merge(x: tuple | None, y: tuple) -> tuple:
    if x is None:
        return y
    n, gap = x[0] + y[0], y[1] - x[1]
    return n, x[1] + gap * (y[0] / n), x[2] + y[2] + np.outer(gap, gap) * (x[0] * y[0] / n)


def whitened(embeddings: DataFrame, count: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    One row for each vector that takes part and each of the first count
    components (fewer if vectors are shorter). deviation is the exact sum of
    (n x - S) squared, an error if it exceeds a long. Components without
    variance (one vector, equal vectors) have whitened 0 and explained 0 and
    take no part in identity_error, which is 0 if no component is left. Repeated
    rows count as often as they occur; rows without vec_id take part; other
    columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = stored(whole_vectors(embeddings), "vectors")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    moments = polarised(vectors)
    if moments is None:
        return spark.createDataFrame([], schema)
    n, d = moments.n, len(moments.sums)
    e, v = components(moments.covariance())
    k = min(count, d)
    live = int((e[:k] > max(float(e[0]), 0.0) * FLAT).sum())
    base = np.array([s // n for s in moments.sums], np.int64)
    rest = np.array([s % n for s in moments.sums], np.int64)  # mean = base + rest / n
    turn = v[:, :live] / np.sqrt(e[:live])

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        y = _matrix(batch) - base
        z = np.zeros((len(y), k))
        z[:, :live] = (y - rest / n) @ turn
        most = max(abs(int(y.max())), abs(int(y.min())), 1) if y.size else 1
        c = (y if (n * (most + 1)) ** 2 * d < 1 << 63 else y.astype(object)) * n - rest
        deviation = [int(x) for x in (c * c).sum(1)]
        return columns(vec_id=batch["vec_id"], deviation=pa.array(deviation, pa.int64()), z=pa.array(list(z), pa.list_(pa.float64())))

    scored = stored(vectors.mapInArrow(lambda batches: (part(s) for s in slices(batches, 4096)), "vec_id long, deviation long, z array<double>"), "scores")
    error = _identity_error(scored, k, live) if live else 0.0
    share = [float(x) for x in e[:k] / e.sum()] if live else [0.0] * k
    share = [s if i < live else 0.0 for i, s in enumerate(share)]
    shares = F.array(*(F.lit(s) for s in share))
    return scored.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
