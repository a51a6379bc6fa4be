"""Residue-centred local frames and voxel indices as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def to_local(point: Vec, origin: Vec, axis: Vec) -> Column:
    return dot(sub(point, origin), axis)


def voxel_index(t: Column, box: float, voxel: float) -> Column:
    """Bin of a coordinate already known to lie inside the open box."""
    last = int(box / voxel) - 1
    raw = ((t + F.lit(box / 2.0)) / F.lit(float(voxel))).cast("int")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(last))


def bound(k: str, box: float, bias: tuple[float, float, float]) -> Column:
    """Half width along one axis of the bounds of the rotated, shifted box."""
    half = F.lit(0.0)
    for axis, shift in zip("uvw", bias):
        half = half + F.abs(F.col(f"{axis}{k}")) * F.lit(box / 2.0 + abs(shift))
    return half + F.lit(1e-6)


def cell(c: Column, edge: float) -> Column:
    return F.floor(c / F.lit(float(edge)))


def neighbour_offsets() -> Column:
    """The 27 cell offsets around a cell, as an array of structs."""
    steps = (-1, 0, 1)
    return F.array(
        *[
            F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("dz"))
            for i in steps
            for j in steps
            for k in steps
        ]
    )


def gaussian_taps(sigma: float = 0.6, truncate: float = 4.0) -> list[float]:
    """Normalised weights of the one-dimensional kernel."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]
