"""Residue-centred voxel examples: frames, 3-D range join, bins, smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake import constants as K
from voxlake.functions import geometry as G
from voxlake.functions.columns import computed_once
from voxlake.functions.residues import channel_index, residue_label, template_atoms
from voxlake.operators.residues import RESIDUE_KEY
from voxlake.runtime import extended, spread


# Cell width of the range join as a share of the box: smaller cells test fewer
# atoms outside the box, larger ones copy each centre less often. A test costs
# nanoseconds, a copy is a wide row of the exchange.
CELL_SHARE = 1.3
#: Slots over which the cells of one group are dealt, so that a large group is not one task.
SLOTS = 8


@dataclass(frozen=True)
class VoxelConfig:
    box_size: float = 20.0
    voxel_size: float = 1.0
    channel_scheme: str = "element4"
    density: float = 0.0
    template: str = "exact"  # exact | superset | backbone
    exclude: str = "residue"  # residue | full_chain | sidechain
    bias: tuple[float, float, float] = (0.0, 0.0, 0.0)
    task: str = "residue_identity"

    @property
    def cells(self) -> int:
        return int(self.box_size / self.voxel_size)

    @property
    def channels(self) -> int:
        return len(K.CHANNEL_SCHEMES[self.channel_scheme])

    @property
    def min_atoms(self) -> float:
        return self.box_size ** 3 * self.density

    def as_dict(self) -> dict:
        return asdict(self)


def screen_centres(residues: DataFrame, config: VoxelConfig) -> DataFrame:
    """Label every residue and say why it cannot be a centre (``skip``)."""
    expected = template_atoms(F.col("res_name"))
    names = F.col("atom_names")
    if config.template == "exact":
        complete = names == expected
    elif config.template == "superset":
        complete = F.size(F.array_except(expected, names)) == 0
    else:
        complete = F.size(F.array_except(F.array(*map(F.lit, ["N", "CA", "C"])), names)) == 0
    labelled = residues.withColumn("label", residue_label(F.col("res_name")))
    framed = with_frames(labelled)
    degenerate = ~(F.col("norms") > 0)
    reason = (
        F.when(F.col("label").isNull(), "invalid_label")
        .when(~F.coalesce(complete, F.lit(False)), "missing_atoms")
        .when(F.coalesce(degenerate, F.lit(True)), "degenerate")
    )
    return framed.withColumn("skip", reason).drop("norms")


def with_frames(residues: DataFrame) -> DataFrame:
    """Add the CA origin (r*) and the unit axes (u*, v*, w*) of each residue."""
    def at(name: str) -> G.Vec:
        return tuple(F.col(f"{name}.{c}") for c in "xyz")

    n, ca, c, cb = at("n"), at("ca"), at("c"), at("cb")
    a = dict(zip(("_ax", "_ay", "_az"), G.sub(n, ca)))
    b = dict(zip(("_ex", "_ey", "_ez"), G.sub(c, ca)))
    edges = computed_once(residues, {**dict(zip(("rx", "ry", "rz"), ca)), **a, **b})
    normal = computed_once(
        edges, dict(zip(("_bx", "_by", "_bz"), G.cross(G.vec("_a"), G.vec("_e"))))
    )
    flips = (F.col("label") != K.LABEL_OF["GLY"]) & F.col("cb").isNotNull()
    side = F.signum(G.dot(G.sub(cb, ca), G.vec("_b")))
    sign = F.when(F.coalesce(flips, F.lit(False)), side).otherwise(F.lit(1.0))
    up = computed_once(normal, {f"_w{k}": F.col(f"_b{k}") * sign for k in "xyz"})
    across = computed_once(up, dict(zip(("_vx", "_vy", "_vz"), G.cross(G.vec("_w"), G.vec("_a")))))
    lengths = computed_once(across, {
        "_nu": G.norm(G.vec("_a")), "_nv": G.norm(G.vec("_v")), "_nw": G.norm(G.vec("_w")),
    })
    axes = {
        f"{axis}{k}": F.col(f"{source}{k}") / F.nullif(F.col(f"_n{axis}"), F.lit(0.0))
        for axis, source in (("u", "_a"), ("v", "_v"), ("w", "_w")) for k in "xyz"
    }
    out = computed_once(lengths, {**axes, "norms": F.least("_nu", "_nv", "_nw")})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def box_join(
    centres: DataFrame, atoms: DataFrame, config: VoxelConfig, keys: Sequence[str] = RESIDUE_KEY
) -> DataFrame:
    """(keys, ch, ix, iy, iz): atoms inside each centre's rotated box.

    Space is cut into cubic cells. A centre looks into the cells that the
    axis-aligned bounds of its rotated box touch: an equi-join on
    (structure, cell). A structure that holds a large share of all rows is
    spread over its cells instead of meeting in one task.
    """
    edge = config.box_size * CELL_SHARE
    frame = [f"{a}{k}" for a in "ruvw" for k in "xyz"]
    near = centres.select(*keys, *frame)
    for k in "xyz":
        half = G.bound(k, config.box_size, config.bias)
        low, high = G.cell(F.col(f"r{k}") - half, edge), G.cell(F.col(f"r{k}") + half, edge)
        near = near.withColumn(f"_c{k}", F.explode(F.sequence(low, high)))
    cloud = atoms.select(
        F.col("structure_id").alias("_sid"),
        F.col("chain_id").alias("_chain"),
        F.col("res_no").alias("_res_no"),
        F.col("atom").alias("_atom"),
        channel_index(F.col("atom"), F.col("element"), config.channel_scheme).alias("ch"),
        *[F.col(k).alias(f"p{k}") for k in "xyz"],
        *[G.cell(F.col(k), edge).alias(f"_k{k}") for k in "xyz"],
    ).where("ch is not null")
    if config.exclude == "full_chain":
        own = (F.col("_chain") == F.col("chain_id")) & (F.col("_res_no") == F.col("res_no"))
    else:
        own = (F.substring("_chain", 1, 1) == F.substring("chain_id", 1, 1)) & (
            F.col("_res_no") == F.col("res_no")
        )
    if config.exclude == "sidechain":
        own = own & ~F.col("_atom").isin(K.BACKBONE_ATOMS)
    same_cell = (
        (F.col("structure_id") == F.col("_sid"))
        & (F.col("_cx") == F.col("_kx")) & (F.col("_cy") == F.col("_ky"))
        & (F.col("_cz") == F.col("_kz"))
    )
    pairs = near.join(cloud, same_cell).where(~own)
    local = pairs.withColumns({
        f"t{k}": G.to_local(G.vec("p"), G.vec("r"), G.vec(axis)) - F.lit(b)
        for k, axis, b in zip("xyz", "uvw", config.bias)
    })
    half = F.lit(config.box_size / 2.0)
    inside = F.lit(True)
    for k in "xyz":
        inside = inside & (F.col(f"t{k}") > -half) & (F.col(f"t{k}") < half)
    return local.where(inside).select(
        *keys, "ch",
        *[G.voxel_index(F.col(f"t{k}"), config.box_size, config.voxel_size).alias(f"i{k}")
          for k in "xyz"],
    )


def voxel_counts(pairs: DataFrame, keys: Sequence[str] = RESIDUE_KEY) -> DataFrame:
    """Atoms per occupied voxel.

    Rows are placed by example once; this aggregation and every later one
    over the same examples reuse that placement. The four numbers of a voxel
    travel and are grouped as one (16 bits each), so rows and keys are narrow.
    """
    counts = spread(pairs.select(*keys, _code().alias("_code")), *keys).groupBy(*keys, "_code").agg(
        F.count("*").cast("double").alias("v"))
    return counts.select(*keys, *_numbers(), "v")


#: Where the four numbers of a voxel lie in one.
PLACES = {"ch": 48, "ix": 32, "iy": 16, "iz": 0}


def _code():
    return sum((F.shiftleft(F.col(c).cast("bigint"), bits) for c, bits in PLACES.items()), F.lit(0).cast("bigint"))


def _numbers(code: str = "_code") -> list:
    return [
        F.shiftright(code, bits).bitwiseAND(F.lit(0xFFFF).cast("bigint")).cast("int").alias(c)
        for c, bits in PLACES.items()
    ]


def pack_examples(
    counts: DataFrame, config: VoxelConfig, keys: Sequence[str] = RESIDUE_KEY
) -> DataFrame:
    """One row per example with its sparse cells and atom count.

    The list is bounded by channels * cells**3. Examples at or below the
    density threshold are dropped.
    """
    n = config.cells
    cell = ((F.col("ch") * n + F.col("ix")) * n + F.col("iy")) * n + F.col("iz")
    packed = counts.groupBy(*keys).agg(
        F.collect_list(F.struct(cell.cast("int").alias("cell"), F.col("v").cast("float").alias("v"))).alias("cells"),
        F.sum("v").alias("atom_count"),
    )
    return packed.where(F.col("atom_count") > F.lit(float(config.min_atoms)))


def smooth_sparse(
    counts: DataFrame, config: VoxelConfig, keys: Sequence[str] = RESIDUE_KEY, rows: bool = True
) -> DataFrame:
    """Gaussian smoothing with mirrored edges, x1000: every cell that an occupied voxel reaches.

    A channel of an example is one dense block of a numpy kernel, so taps are never
    rows; a block becomes rows only when it is smoothed. Without ``rows`` it stays one
    row: ``x`` lists the values of all these cells in order of ix, iy and iz.
    """
    n = config.cells
    cell = (F.col("ix") * n + F.col("iy")) * n + F.col("iz")
    packed = counts.groupBy(*keys, "ch").agg(
        F.collect_list(F.struct(cell.cast("int").alias("cell"), F.col("v").cast("double").alias("v"))).alias("cells"))
    kept, size, taps = [*keys, "ch"], n ** 3, G.gaussian_taps()

    def smooth(batches):
        for part in _slices(batches, 16):
            at, v = _places(part.column("cells"), size)
            values = _smooth_cells(at, v, part.num_rows, n, taps) * 1000.0
            reached = values > 0
            if not (v > 0).all():  # a count of zero reaches its cells too
                reached = _smooth_cells(at, np.ones(len(at)), part.num_rows, n, taps) > 0
            found = np.flatnonzero(reached)
            ends = pa.array(np.searchsorted(found, np.arange(part.num_rows + 1) * size).astype(np.int32))
            lists = {"x": values[found], **({"at": (found % size).astype(np.int32)} if rows else {})}
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), *(pa.ListArray.from_arrays(ends, pa.array(a)) for a in lists.values())], names=[*kept, *lists])

    smoothed = packed.mapInArrow(smooth, extended(packed.select(*kept).schema, "x array<double>" + ", at array<int>" * rows))
    if not rows:
        return smoothed
    cells = smoothed.select(*kept, F.inline(F.arrays_zip("at", "x")))
    return cells.select(*kept, *[
        (F.floor(F.col("at") / F.lit(n ** i)) % n).cast("int").alias(f"i{k}") for i, k in ((2, "x"), (1, "y"), (0, "z"))
    ], F.col("x").alias("v"))


def _slices(batches, rows: int):
    for record in batches:
        for start in range(0, record.num_rows, rows):
            yield record.slice(start, rows)


def _places(cells: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in a batch of dense blocks, value) of lists of sparse cells."""
    rows = np.repeat(np.arange(len(cells)), np.asarray(cells.value_lengths()))
    flat = cells.flatten()
    return rows * size + np.asarray(flat.field("cell")), np.asarray(flat.field("v"))


def _equal_lists(values: pa.Array, rows: int, size: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * size + 1, size, dtype=np.int32)), values)


def _smooth_block(block: np.ndarray, taps: list[float]) -> np.ndarray:
    """Separable kernel over the last three axes of a batch: a matrix product along each."""
    radius = len(taps) // 2

    def along(n: int) -> np.ndarray:
        mirrored = np.pad(np.eye(n), ((radius, radius), (0, 0)), mode="symmetric")
        return sum(w * mirrored[i : i + n] for i, w in enumerate(taps))

    *_, a, b, c = block.shape
    out = (block.reshape(-1, c) @ along(c).T).reshape(-1, b, c)
    out = (along(b) @ out).reshape(-1, a, b * c)
    return (along(a) @ out).reshape(block.shape)


def _smooth_cells(at: np.ndarray, v: np.ndarray, rows: int, n: int, taps: list[float]) -> np.ndarray:
    """Smoothed blocks, flat; sparse cells are spread tap by tap where that is less than the blocks hold."""
    if len(at) * len(taps) ** 3 > rows * n ** 3:
        return _smooth_block(np.bincount(at, v, rows * n ** 3).reshape(-1, n, n, n), taps).ravel()
    mirrored = np.pad(np.arange(n), len(taps) // 2, mode="symmetric")
    near = np.lib.stride_tricks.sliding_window_view(mirrored, len(taps))
    w = np.asarray(taps)
    plane, z = np.divmod(at, n)
    line, y = np.divmod(plane, n)
    row, x = np.divmod(line, n)
    to = ((row[:, None] * n + near[x])[:, :, None] * n + near[y][:, None, :])[:, :, :, None] * n + near[z][:, None, None, :]
    return np.bincount(to.ravel(), np.multiply.outer(v, w[:, None, None] * w[:, None] * w).ravel(), rows * n ** 3)


def dense_samples(
    packed: DataFrame, config: VoxelConfig, smooth: bool = True, batch: int = 64
) -> DataFrame:
    """Packed examples -> dense float32 arrays (smoothed, x1000), in Arrow batches."""
    kept = [c for c in packed.columns if c != "cells"]
    schema = packed.select(*kept).schema
    shape = (config.channels, config.cells, config.cells, config.cells)
    size = math.prod(shape)
    taps = G.gaussian_taps()

    def build(batches):
        for part in _slices(batches, batch):
            at, v = _places(part.column("cells"), size)
            block = np.zeros(part.num_rows * size)
            block[at] = v
            block = block.reshape(part.num_rows, *shape)
            if smooth:
                block = _smooth_block(block, taps) * 1000.0
            x = _equal_lists(pa.array(block.astype(np.float32).ravel()), part.num_rows, size)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [x], names=[*kept, "x"])

    out = packed.mapInArrow(build, schema.add("x", T.ArrayType(T.FloatType())))
    return out.withColumn("shape", F.array(*[F.lit(s) for s in shape]))


def sample_totals(samples: DataFrame) -> DataFrame:
    """Samples with ``total`` and ``peak`` of x, as doubles, in place of the array; empty or missing arrays: 0 and NULL."""
    kept = [c for c in samples.columns if c != "x"]

    def run(batches):
        for part in _slices(batches, 64):
            x = part.column("x")
            n = np.asarray(x.value_lengths().fill_null(0)).astype(np.int64)
            flat = np.asarray(x.flatten()).astype(np.float64)
            some = np.flatnonzero(n)
            heads = (np.cumsum(n) - n)[some]
            total, peak = np.zeros(len(n)), np.zeros(len(n))
            if len(some):
                total[some], peak[some] = np.add.reduceat(flat, heads), np.maximum.reduceat(flat, heads)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(total), pa.array(peak, mask=n == 0)], names=[*kept, "total", "peak"])

    return samples.mapInArrow(run, extended(samples.select(*kept).schema, "total double, peak double"))


def example_id(*suffix: str):
    return F.concat_ws("_", *[F.col(c).cast("string") for c in suffix])


def mean_over_sites(cells: DataFrame, groups: Sequence[str], site_key: Sequence[str]) -> DataFrame:
    """Cell-wise mean over the sites of a group; an absent cell counts as 0.

    A site's cells travel as lists, in as many slots of its group as ``SLOTS``, so
    the exchange carries few keys and a large group is not one task; sites that
    meet in a batch are added up before. The first entry of a list, without a
    place, counts the sites, so one exchange gives the sums and their divisors.
    """
    groups = list(groups)
    packed = cells.groupBy(*groups, *site_key).agg(F.collect_list(F.struct(_code().alias("_code"), F.col("v").cast("double").alias("v"))).alias("cells"))

    def deal(batches):
        for part in _slices(batches, 4096):
            seen: dict[tuple, int] = {}
            group = np.array([seen.setdefault(k, len(seen)) for k in zip(*(part.column(c).to_pylist() for c in groups))])
            first = pa.array(np.repeat(np.unique(group, return_index=True)[1], SLOTS))
            flat = part.column("cells").flatten()
            code, v = np.asarray(flat.field("_code")), np.asarray(flat.field("v"))
            bucket = np.repeat(group, np.asarray(part.column("cells").value_lengths())) * SLOTS + sum(code >> bits for bits in PLACES.values()) % SLOTS
            order = np.lexsort((code, bucket))
            code, bucket = code[order], bucket[order]
            heads = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])][: len(code)])
            sums = np.add.reduceat(v[order], heads) if len(heads) else v
            sizes = np.bincount(bucket[heads], minlength=len(first))
            at = np.cumsum(sizes) - sizes
            sites = np.repeat(np.bincount(group), SLOTS)
            codes = pa.array(np.insert(code[heads], at, 0), mask=np.insert(np.zeros(len(heads), bool), at, True))
            ends = pa.array(np.r_[0, np.cumsum(sizes + 1)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, a) for a in (codes, pa.array(np.insert(sums, at, sites)))]
            slot = pa.array(np.arange(len(first), dtype=np.int32) % SLOTS)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(first) for c in groups), slot, *lists], names=[*groups, "_slot", "_code", "v"])

    by = [*groups, "_slot"]
    schema = extended(packed.select(*groups).schema, "_slot int, _code array<bigint>, v array<double>")
    entries = spread(packed.mapInArrow(deal, schema), *by).select(*by, F.inline(F.arrays_zip("_code", "v")))
    sites = entries.where("_code is null").groupBy(*by).agg(F.sum("v").alias("_sites"))
    sums = entries.where("_code is not null").groupBy(*by, "_code").agg(F.sum("v").alias("_sum"))
    return sums.join(sites.hint("shuffle_hash"), by).select(*groups, *_numbers(), (F.col("_sum") / F.col("_sites")).alias("v"))
