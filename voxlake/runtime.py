"""Session helpers: reliable checkpoints and shared working folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in one local process a temporary one where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured and not current:
        spark.sparkContext.setCheckpointDir(configured)
    elif not configured and not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxlake-ckpt-"))
    return configured or spark.sparkContext.getCheckpointDir()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: While this is set, Spark removes the shuffle files of a query when it ends, not when its plan is collected.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def landed(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet to a new shared folder and read back.

    Cuts the lineage too; a reader takes the columns that it needs, where a
    checkpoint gives whole rows back one by one. The job's shuffle files go with it.
    """
    spark = df.sparkSession
    path, before = fresh_dir(spark, label), spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition into the full number of shuffle partitions.

    For rows that are small but expensive: sized by bytes alone they would be
    put back together into a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def extended(schema: StructType, more: str) -> StructType:
    """A schema with more columns, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])
