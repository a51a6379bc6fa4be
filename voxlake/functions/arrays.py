"""Row-wise array mathematics: softmax, entropy, top-k, channel order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, also inside inner lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column) -> Column:
    """Weights relative to the maximum; maximum and sum are evaluated once a row."""
    def shares(peak: Column) -> Column:
        weights = F.transform(logits, lambda v: F.exp(v.cast("double") - peak))
        return bound(weights, lambda w: bound(
            F.aggregate(w, F.lit(0.0), lambda acc, v: acc + v), lambda total: F.transform(w, lambda v: v / total)))

    return bound(F.array_max(logits).cast("double"), shares)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def entropy(probs: Column, eps: float = 1e-12) -> Column:
    return F.aggregate(
        probs, F.lit(0.0), lambda acc, p: acc - p * F.log(p + F.lit(eps))
    )


def top_indices(values: Column, k: int) -> Column:
    """Positions of the k largest values; ties keep the lower position first."""
    ranked = F.array_sort(
        F.transform(values, lambda v, i: F.struct((-v).alias("neg"), i.alias("idx")))
    )
    return F.transform(F.slice(ranked, 1, k), lambda s: s["idx"])
