"""Exact top-k inner products through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it, and the table
is sorted by that key, so a run of rows is an annulus around a pivot. For a
query q, a row x and a pivot p, |q - x| >= ||q - p| - |x - p||, hence
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 is bounded by the annulus. Each task
expands its annuli from the best bound downwards and stops a query when no bound
reaches its k-th score so far, which it keeps for all its rows. Queries visit the
index in blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.shared import columns, shuffle_width, stored

#: Sample that pivots and first thresholds come from (rows), pivots, rows of an annulus, components of a block of queries.
SAMPLE, PIVOTS, ANNULUS, QUERY_BLOCK = 4096, 64, 512, 2_000_000
#: Products below this are exact in doubles; larger vectors are multiplied as Python integers.
EXACT = float(1 << 52)


def whole_vectors(table: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """key and floor(scale * component) as long; rows with a null or non-finite component go."""
    as_double = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(as_double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), as_double.alias("raw")).where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull())
    return rows.where(finite.isNull() | finite).select("vec_id", F.transform("raw", lambda v: F.floor(v * scale).cast("long")).alias("vector"))


def _matrix(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch["vector"]
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two row sets, held within the range of long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    af, bf = a.astype(np.float64), b.astype(np.float64)
    if np.abs(af).max() * np.abs(bf).max() * a.shape[1] < EXACT:
        return (af @ bf.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Found:
    """What a task has found for a block of queries: best rows, k-th scores, and the pairs of query and annulus it multiplied."""

    def __init__(self, floor: np.ndarray):
        self.kth, self.pairs = floor.copy(), 0
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class QueryBlock:
    """Queries of one dimension with a lower bound of each k-th score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm2 = (vectors.astype(np.float64) ** 2).sum(1)
        self.to_pivot = _distances(vectors, pivots)
        self.floor = np.full(len(ids), -np.inf)

    def raise_floor(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A k-th score among any rows of the table bounds the final one from below."""
        if len(ids):
            s = np.where(ids[None, :] == self.ids[:, None], -np.inf, _products(self.vectors, vectors).astype(np.float64))
            if s.shape[1] >= self.k:
                self.floor = np.maximum(self.floor, -np.sort(-s, 1)[:, self.k - 1])

    def expand(self, annuli: list[tuple], state: Found) -> None:
        """Best rows of these annuli for every query, on top of what the task has found so far."""
        bounds = np.stack([self.bound(*a[:4]) for a in annuli], 1)
        order = np.argsort(-bounds.max(0))
        kth, found = state.kth, state.found
        for a in order:
            ids, vectors = annuli[a][4:]
            active = np.flatnonzero(bounds[:, a] >= kth)
            state.pairs += len(active)
            for at in range(0, len(active), 1024):
                some = active[at : at + 1024]
                scores = _products(self.vectors[some], vectors)
                hit = (scores >= kth[some][:, None]) & (ids[None, :] != self.ids[some][:, None])
                for row in np.flatnonzero(hit.any(1)):
                    q, mine = int(some[row]), hit[row]
                    have = found.get(q, (ids[:0], scores[0, :0]))
                    all_ids, all_scores = np.concatenate([have[0], ids[mine]]), np.concatenate([have[1], scores[row, mine]])
                    keep = _best(all_ids, all_scores, self.k)
                    found[q] = (all_ids[keep], all_scores[keep])
                    if len(keep) == self.k:
                        kth[q] = max(kth[q], float(all_scores[keep[-1]]))

    def bound(self, pivot: int, near: float, far: float, norm2: float) -> np.ndarray:
        """Largest possible product with a row of the annulus; rounding only raises it."""
        d = self.to_pivot[:, pivot]
        gap = np.maximum(0, np.maximum(near - d, d - far))
        top = (self.norm2 + norm2 - gap * gap) / 2
        return top + 1e-6 * (self.norm2 + norm2) + 1


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = vectors.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    if not len(vectors):
        return vectors
    chosen, gap = [0], _distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(n, len(vectors)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def pivot_index(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Every vector with pivot, distance and squared norm, range-sorted by them and stored."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch)
            pivot, distance, norm = np.zeros(len(rows), np.int32), np.zeros(len(rows)), np.zeros(len(rows))
            width = np.array([len(r) for r in rows], np.int32)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x = np.stack([rows[i] for i in at])
                norm[at] = (x.astype(np.float64) ** 2).sum(1)
                if w in sent.value:
                    d = _distances(x, sent.value[w])
                    pivot[at], distance[at] = d.argmin(1), d.min(1)
                else:  # a width that the sample has not: all around the origin
                    distance[at] = np.sqrt(norm[at])
            yield columns(vec_id=batch["vec_id"], width=pa.array(width), pivot=pa.array(pivot), distance=pa.array(distance), norm2=pa.array(norm), vector=batch["vector"])

    keyed = vectors.mapInArrow(key, "vec_id long, width int, pivot int, distance double, norm2 double, vector array<bigint>")
    order = ("width", "pivot", "distance", "vec_id")
    return stored(keyed.repartitionByRange(shuffle_width(vectors.sparkSession), *order).sortWithinPartitions(*order), "pivot-index")


def _annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of sorted rows with one width and pivot, up to ANNULUS rows, a Spark batch at a time."""
    for batch in batches:
        rows = _matrix(batch)
        width, pivot = batch["width"].to_numpy(), batch["pivot"].to_numpy()
        distance, norm, ids = batch["distance"].to_numpy(), batch["norm2"].to_numpy(), batch["vec_id"].to_numpy()
        edges = np.flatnonzero((np.diff(width) != 0) | (np.diff(pivot) != 0)) + 1
        found: dict[int, list[tuple]] = {}
        for start, stop in zip([0, *edges], [*edges, len(rows)], strict=True):
            for at in range(start, stop, ANNULUS):
                s = slice(at, min(stop, at + ANNULUS))
                if s.stop > s.start:
                    found.setdefault(int(width[at]), []).append((int(pivot[at]), distance[s].min(), distance[s].max(), norm[s].max(), ids[s], np.stack(rows[s])))
        yield from found.items()


def top_k(table: DataFrame, query_ids: F.Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each query.

    query_ids: condition on vec_id that says which rows are queries. A query is
    compared with every other row of its own width; rows with its own id are not
    candidates. Rows without id, null vectors and vectors with null or
    non-finite components take no part; empty vectors have product 0. Equal
    scores go to the smaller id. Of repeated ids, each row is a candidate and
    the query is the row with the smallest vector. A product outside the
    range of long counts as the end of that range. Other columns are ignored; an empty table gives no rows.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, key, vector, scale)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in {len(r["vector"]) for r in sample}:
        own = [r for r in sample if len(r["vector"]) == w]
        by_width[w] = (np.array([r["vec_id"] for r in own]), np.array([r["vector"] for r in own], np.int64).reshape(len(own), w))
    pivots = {w: choose_pivots(x, PIVOTS) for w, (_, x) in by_width.items()}
    index = pivot_index(vectors, pivots)
    queries = index.where(query_ids).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = stored(queries, "queries")
    n = queries.agg(F.sum(F.size("vector") + 1).alias("n")).first()["n"] or 0
    blocks = -(-2 * n // QUERY_BLOCK)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    results = []
    for b in range(blocks):  # one pass over the index for each
        some = queries.where(F.col("block") == b).collect()  # about QUERY_BLOCK / 2 components
        if not some:
            continue
        prepared = {}
        for w in {len(r["vector"]) for r in some}:
            own = [r for r in some if len(r["vector"]) == w]
            zero = np.zeros((1, w), np.int64)
            q = QueryBlock(np.array([r["vec_id"] for r in own]), np.array([r["vector"] for r in own], np.int64).reshape(len(own), w), pivots.get(w, zero), k)
            if w in by_width:
                q.raise_floor(*by_width[w])
            prepared[w] = q
        results.append(_search(index, spark.sparkContext.broadcast(prepared)))
        if len(results) == 16:  # keeps the plan and the driver small
            results = [stored(functools.reduce(DataFrame.unionByName, results), "found")]
    schema = "query_id long, vec_id long, score long"
    found = functools.reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(index: DataFrame, block) -> DataFrame:
    """Up to k rows for each query and task: bounds rise through all of a task's batches."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Found] = {}
        for width, annuli in _annuli(batches):
            if width in block.value:
                q = block.value[width]
                q.expand(annuli, states.setdefault(width, Found(q.floor)))
        for width, state in states.items():
            if state.found:
                q, found = block.value[width], state.found
                of = np.repeat([q.ids[at] for at in found], [len(ids) for ids, _ in found.values()])
                yield columns(query_id=pa.array(of), vec_id=pa.array(np.concatenate([x[0] for x in found.values()])), score=pa.array(np.concatenate([x[1] for x in found.values()])))

    return index.mapInArrow(search, "query_id long, vec_id long, score long")
