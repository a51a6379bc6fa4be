"""Helpers of the corpus operators: tables, Arrow batches, file systems."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.runtime import fresh_dir

# Arrow's own allocator keeps freed batches of texts in every Python worker; the system's gives them back.
pa.set_memory_pool(pa.system_memory_pool())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to a new folder below the shared one and read back: cuts the lineage."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_places(docs: DataFrame, place: str) -> DataFrame:
    """docs written once, with each row's place in this one reading as a column."""
    return stored(docs.withColumn(place, F.monotonically_increasing_id()), "placed")


#: Rows of one id that are broadcast, some 30 MB; more are joined by a shuffle.
FEW_ROWS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if its counted rows allow it."""
    return F.broadcast(ids) if ids.limit(FEW_ROWS + 1).count() <= FEW_ROWS else ids


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small zero-copy slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 256) -> DataFrame:
    """Apply a function of one batch slice in every partition."""
    return df.mapInArrow(lambda batches: (fn(part) for part in slices(batches, rows)), schema)


def columns(**arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def doc_texts(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def tokenizer_json(name: str) -> str:
    """The definition of a public tokenizer, read once on the driver (1 to 2 MB, fixed)."""
    import public_tokenizers

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as file:
        return file.read()


#: ASCII-only lower-casing of UTF-8 bytes: bytes.lower() changes A-Z and nothing else.
def ascii_lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()
