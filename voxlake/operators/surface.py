"""Solvent-accessible surface by counting exposed sphere points (1973)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions import geometry as G
from voxlake.functions.residues import lookup
from voxlake.runtime import extended, spread

PROBE = 1.4
# Van der Waals radii by element.
RADII = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}
DEFAULT_RADIUS = 1.7
# Largest possible residue areas (published theoretical set, 2013).
MAX_AREA = {
    "ALA": 129.0, "ARG": 274.0, "ASN": 195.0, "ASP": 193.0, "CYS": 167.0,
    "GLN": 225.0, "GLU": 223.0, "GLY": 104.0, "HIS": 224.0, "ILE": 197.0,
    "LEU": 201.0, "LYS": 236.0, "MET": 224.0, "PHE": 240.0, "PRO": 159.0,
    "SER": 155.0, "THR": 172.0, "TRP": 285.0, "TYR": 263.0, "VAL": 174.0,
}


def sphere_points(n: int) -> list[tuple[float, float, float]]:
    """n nearly even unit vectors on a spiral."""
    turn = math.pi * (3.0 - math.sqrt(5.0))
    points = []
    for i in range(n):
        z = 1.0 - (2.0 * i + 1.0) / n
        ring = math.sqrt(1.0 - z * z)
        points.append((ring * math.cos(turn * i), ring * math.sin(turn * i), z))
    return points


def atom_radius(element: Column) -> Column:
    return F.coalesce(lookup(RADII, F.upper(element)), F.lit(DEFAULT_RADIUS))


#: Grid cells along the edge of a tile; a cell is as wide as two expanded radii.
TILE = 4
#: Rows of whole tiles that a task works on at a time, and pairs tested at a time.
ROWS, PAIRS = 8192, 16_384
#: Products this close to their limit (in angstrom) are decided by the distance itself.
MARGIN = 1e-9


def _tiled(atoms: DataFrame, edge: float) -> DataFrame:
    """Atoms with the tile they own a place in, and copies for the tiles whose border they touch.

    ``_lx``, ``_ly``, ``_lz`` are cells inside the tile; a copy's lie one cell outside, at -1
    or TILE, along at least one axis.
    """
    placed = atoms
    for k in "xyz":
        cell = G.cell(F.col(k), edge)
        tile = F.floor(cell / F.lit(TILE))
        place = cell - tile * TILE
        spots = F.array_compact(F.array(
            F.struct(tile.alias("t"), place.cast("int").alias("l")),
            F.when(place == 0, F.struct((tile - 1).alias("t"), F.lit(TILE).alias("l"))),
            F.when(place == TILE - 1, F.struct((tile + 1).alias("t"), F.lit(-1).alias("l"))),
        ))
        placed = placed.withColumn(f"_{k}", F.explode(spots))
    return placed.withColumns({
        **{f"_t{k}": F.col(f"_{k}.t") for k in "xyz"}, **{f"_l{k}": F.col(f"_{k}.l") for k in "xyz"},
    }).drop("_x", "_y", "_z")


def _exposed_of_tiles(table: pa.Table, keys: list[str], spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that their tile owns, exposed points of each) for rows of whole tiles, sorted by tile.

    Atoms meet by cell inside their tile. A point of the sphere lies in another
    one where its direction's product with the way between the centres stays under
    a limit, so a pair's points are one matrix product; points within rounding of
    the limit are decided by their distance. Buried points are bits of a word row
    for each atom, and atoms without an open point look no further.
    """
    column = lambda name: table[name].to_numpy(zero_copy_only=False)
    codes = lambda name: table[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    tile = np.stack([codes("structure_id"), *(column(f"_t{k}") for k in "xyz")])
    number = np.concatenate([[0], np.cumsum((tile[:, 1:] != tile[:, :-1]).any(0))])
    local = [column(f"_l{k}") + 1 for k in "xyz"]
    side = TILE + 2
    cell = ((number * side + local[0]) * side + local[1]) * side + local[2]
    own = np.flatnonzero(np.all([(c > 0) & (c <= TILE) for c in local], axis=0))
    order = np.argsort(cell, kind="stable")
    sorted_cell = cell[order]
    x, y, z = (column(k).astype(np.float64) for k in "xyz")
    radius = column("_rad")
    ident = np.zeros(table.num_rows, np.int64)
    for code in map(codes, keys):
        ident = np.unique(ident * (len(code) + 1) + code + 1, return_inverse=True)[1]
    words = -(-len(spots) // 64)
    whole = _words(np.ones((1, len(spots)), bool), words)
    buried = np.zeros((table.num_rows, words), np.uint64)
    steps = sorted(((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)), key=lambda s: abs(s[0]) + abs(s[1]))  # the nearest first
    open_ = own
    for a, b in steps:
        open_ = open_[(buried[open_] != whole).any(axis=1)]
        step = (a * side + b) * side  # three cells in a row along z
        low = np.searchsorted(sorted_cell, cell[open_] + step - 1, "left")
        n = np.searchsorted(sorted_cell, cell[open_] + step + 1, "right") - low
        ends = np.cumsum(n)
        at = 0
        while at < len(open_):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            part = n[at:stop]
            mine = np.repeat(open_[at:stop], part)
            first = np.concatenate([[0], np.cumsum(part)[:-1]])
            other = order[np.repeat(low[at:stop] - first, part) + np.arange(len(mine))]
            at = stop
            dx, dy, dz = x[mine] - x[other], y[mine] - y[other], z[mine] - z[other]
            limit = radius[mine] + radius[other]
            near = np.flatnonzero(dx * dx + dy * dy + dz * dz < limit * limit)
            near = near[ident[mine[near]] != ident[other[near]]]
            if not len(near):
                continue
            mine, other = mine[near], other[near]
            delta = np.stack([dx[near], dy[near], dz[near]], axis=1)
            packed = _words(_inside(delta, radius[mine], radius[other], spots), words)
            heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            buried[mine[heads]] |= np.bitwise_or.reduceat(packed, heads, axis=0)
    return own, len(spots) - np.bitwise_count(buried[own]).sum(axis=1, dtype=np.int64)


def _words(flags: np.ndarray, words: int) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.zeros((len(flags), words * 8), np.uint8)
    bits = np.packbits(flags, axis=1, bitorder="little")
    packed[:, : bits.shape[1]] = bits
    return packed.view(np.uint64)


def _inside(delta: np.ndarray, radius: np.ndarray, reach: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """For each pair the points of the first sphere that lie inside the second; delta leads from the second to the first."""
    square = delta[:, 0] * delta[:, 0] + delta[:, 1] * delta[:, 1] + delta[:, 2] * delta[:, 2]
    limit = (reach * reach - radius * radius - square) / (2.0 * radius)
    along = delta @ spots.T
    hit = along < (limit - MARGIN)[:, None]
    close = hit != (along < (limit + MARGIN)[:, None])
    if close.any():
        row, point = np.nonzero(close)
        d = [spots[point, k] * radius[row] + delta[row, k] for k in range(3)]
        hit[row, point] = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < reach[row] * reach[row]
    return hit


def exposed_points(atoms: DataFrame, atom_key: list[str], points: int = 92, probe: float = PROBE) -> DataFrame:
    """Add ``exposed``: sphere points of each atom outside all neighbours.

    Atoms are dealt to tiles with copies of the atoms around each tile's border,
    so a tile knows all neighbours of its own atoms; a numpy kernel tests the
    points of a tile's pairs. Neither pairs nor points are rows.
    """
    edge = 2.0 * (max([*RADII.values(), DEFAULT_RADIUS]) + probe)
    sized = atoms.withColumn("_rad", atom_radius(F.col("element")) + F.lit(probe))
    spots = np.array(sphere_points(points))
    kept, tile = sized.columns, ["structure_id", "_tx", "_ty", "_tz"]
    names = [c for c in kept if c != "_rad"]

    def exposed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            own, count = _exposed_of_tiles(table, atom_key, spots)
            mine = table.select(kept).take(pa.array(own)).append_column("exposed", pa.array(count, pa.int32()))
            yield from mine.combine_chunks().to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                whole = pa.Table.from_batches(held)
                same = [pc.fill_null(pc.equal(whole[c], whole[c][rows - 1]), False) for c in tile]
                cut = rows - int(np.logical_and.reduce([m.to_numpy() for m in same]).sum())  # sorted: the last tile's rows
                yield from exposed(whole.slice(0, cut))
                held, rows = whole.slice(cut).to_batches(), rows - cut
        if held:
            yield from exposed(pa.Table.from_batches(held))

    dealt = spread(_tiled(sized, edge), *tile).sortWithinPartitions(*tile)
    counted = dealt.mapInArrow(run, extended(sized.schema, "exposed int"))
    area = F.lit(4.0 * math.pi) * F.col("_rad") * F.col("_rad") * F.col("exposed") / F.lit(float(points))
    return counted.withColumn("area", area).select(*names, "exposed", "area")


def residue_areas(atoms: DataFrame) -> DataFrame:
    """Ten accessibility measures per residue from atoms with ``area``."""
    main = F.col("atom").isin(K.BACKBONE_ATOMS)
    polar = F.upper("element").isin("N", "O")
    parts = {"total": F.lit(True), "sidechain": ~main, "mainchain": main, "polar": polar, "apolar": ~polar}
    sums = atoms.groupBy("structure_id", "chain_id", "res_no", "res_name").agg(*[
        F.sum(F.when(cond, F.col("area")).otherwise(0.0)).alias(f"abs_{name}")
        for name, cond in parts.items()
    ])
    largest = lookup(MAX_AREA, F.col("res_name"))
    return sums.withColumns({f"rel_{n}": F.col(f"abs_{n}") / largest for n in parts})
