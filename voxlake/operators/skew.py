"""A lookup join whose heavy keys are dealt over many tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy beyond total / (SHARE x shuffle partitions) rows, and beyond LEAST rows unless told otherwise.
SHARE, LEAST = 4, 256
_SALT = "__salt"


def heavy_keys(
    rows: DataFrame, on: Sequence[str], least: int = LEAST, counts: DataFrame | None = None
) -> list[tuple[int, int]]:
    """(hash of the key, salts) of every heavy key: at most SHARE x shuffle partitions of them.

    ``counts`` (the key columns and n) saves the counting where it is known.

    Rows are counted by the hash of their key, partially before the exchange, so
    that exchange carries 16 bytes for each key and task. Keys with a null part
    match nothing and are not counted.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        total = rows.count()
        counts = rows.where(_whole(on)).groupBy(F.xxhash64(*on).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    else:
        total = counts.agg(F.sum("n")).first()[0] or 0
        counts = counts.where(_whole(on)).groupBy(F.xxhash64(*on).alias("key")).agg(F.sum("n").alias("n"))
    limit = max(least, total // (SHARE * width))
    return [(r["key"], -(-r["n"] // limit)) for r in counts.where(F.col("n") > limit).collect()]


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", deal: Sequence[str] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """rows joined with lookup on equal keys; how: inner, left, left_semi or left_anti.

    Rows of a heavy key are dealt over salts by the hash of the columns deal (all
    by default; they should tell the key's rows apart), and the key's lookup rows
    are copied to each salt. Other rows meet as in any join. Rows with a null in
    their key match nothing and are dealt over all partitions. rows is read
    twice, once to count its keys unless counts says them, so it should be a
    written table; lookup should have few rows for each key. Empty inputs give an empty or unmatched
    result.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    on, spark = list(on), rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = heavy_keys(rows, on, counts=counts)
    if not known and how in ("inner", "left_semi"):
        return rows.join(lookup, on, how)
    spread = F.xxhash64(*(deal or rows.columns))
    lookup = lookup.where(_whole(on))
    mine = others = F.lit(0)
    if known:
        heavy = F.broadcast(spark.createDataFrame(known, "__key long, __salts long"))
        rows, lookup = (side.withColumn("__key", F.xxhash64(*on)).join(heavy, "__key", "left") for side in (rows, lookup))
        mine = F.pmod(spread, F.coalesce("__salts", F.lit(1)))
        others = F.explode(F.sequence(F.lit(0), (F.coalesce("__salts", F.lit(1)) - 1).cast("int")))
    salted = rows.withColumn(_SALT, F.when(~_whole(on), F.pmod(spread, F.lit(width))).otherwise(mine).cast("int")).drop("__key", "__salts")
    copies = lookup.withColumn(_SALT, others).drop("__key", "__salts")
    return salted.join(copies, [*on, _SALT], how).drop(_SALT)


def _whole(on: Sequence[str]) -> F.Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
