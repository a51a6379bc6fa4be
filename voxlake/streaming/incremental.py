"""Incremental builds: new files only, each batch written exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from voxlake.functions.columns import config_fingerprint
from voxlake.operators.voxels import VoxelConfig, dense_samples
from voxlake.plans.voxels import build_sites
from voxlake.runtime import cut_lineage
from voxlake.sources.arrays import exists
from voxlake.sources.structures import parse_atoms, structure_lines, with_structure_id

#: Batch numbers of a run start at a multiple of this.
RUN = 1_000_000_000
DONE = "structure_id string, n_examples bigint, fingerprint string, batch bigint"


def fingerprint(spark: SparkSession, config: dict) -> str:
    return spark.range(1).select(config_fingerprint(config).alias("f")).first()["f"]


def done_structures(spark: SparkSession, out: str, tag: str) -> DataFrame:
    """Finished structures of one configuration."""
    try:
        done = spark.read.schema(DONE).parquet(f"{out}/done")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":  # a damaged ledger is not an empty one
            raise
        done = spark.createDataFrame([], DONE)
    return done.where(F.col("fingerprint") == tag)


def latest_samples(spark: SparkSession, out: str, tag: str) -> DataFrame:
    """Samples of each structure's last batch: a rebuilt structure replaces its old examples."""
    last = done_structures(spark, out, tag).groupBy("structure_id").agg(F.max("batch").alias("batch"))
    samples = spark.read.parquet(f"{out}/samples").where(F.col("fingerprint") == tag)
    return samples.withColumn("batch", F.col("batch").cast("long")).join(last, ["structure_id", "batch"], "left_semi")


class FirstFiles(StatefulProcessor):
    """Rows of the first file of each structure id; its path is the id's state.

    An id is looked up in the state store by itself, so a micro-batch touches
    the ids it brings and no others. Of files that arrive together the one with
    the least path is first. A batch that is run again starts from the state
    before it and gives the same rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "pdb_path string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            best = pdf if best is None else pd.concat([best, pdf])
            best = best[best["pdb_path"] == best["pdb_path"].min()].head(1)
        if best is not None and not self.first.exists():
            self.first.update((best["pdb_path"].iloc[0],))
            yield best

    def close(self) -> None:
        pass


def first_of_stream(stream: DataFrame) -> DataFrame:
    """The stream's rows whose structure id is new to the query."""
    stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy("structure_id").transformWithStateInPandas(FirstFiles(), stream.schema, "Append", "None")


def write_batch(rows: DataFrame, batch: int, out: str, tag: str, build: Callable) -> None:
    """Build one micro-batch of new structures into its own partition.

    The partition is named after the configuration and the batch, so a batch
    that is run again after a failure replaces itself.
    """
    spark = rows.sparkSession
    pending = cut_lineage(rows)
    samples = build(pending)
    where = f"fingerprint={tag}/batch={batch}"
    samples.write.mode("overwrite").parquet(f"{out}/samples/{where}")
    written = spark.read.parquet(f"{out}/samples/{where}").groupBy("structure_id").agg(
        F.count("*").alias("n_examples")
    )
    pending.select("structure_id").join(written, "structure_id", "left").na.fill(0).write.mode(
        "overwrite"
    ).parquet(f"{out}/done/{where}")


def voxel_builder(config: VoxelConfig, include_hetero: bool = False) -> Callable:
    def build(files: DataFrame) -> DataFrame:
        atoms = parse_atoms(structure_lines(files), include_hetero)
        examples = build_sites(atoms, config)
        return dense_samples(examples.packed, config)

    return build


def run_incremental(
    spark: SparkSession, stream: DataFrame, out: str, config: dict, build: Callable,
    overwrite: bool = False,
) -> str:
    """Drain what has arrived since the last run; returns the fingerprint.

    ``overwrite`` starts a new run, with progress, state and batch numbers of its
    own, and so builds every file again. Which ids are finished is the state of
    the run's query; the ledger below ``done`` is written and not read again.
    """
    tag = fingerprint(spark, config)
    newest = done_structures(spark, out, tag).agg(F.max("batch")).first()[0]
    run = (newest or 0) // RUN + (1 if overwrite and newest is not None else 0)
    query = (
        first_of_stream(stream).writeStream.outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{out}/progress/{tag}/run={run}")
        .foreachBatch(lambda df, batch: write_batch(df, run * RUN + batch, out, tag, build))
        .start()
    )
    query.awaitTermination()
    return tag


def structure_stream(spark: SparkSession, path: str, glob: str = "*.pdb") -> DataFrame:
    raw = (
        spark.readStream.format("text").option("wholetext", True)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    )
    return with_structure_id(raw)


def build_incremental(
    spark: SparkSession, path: str, out: str, config: VoxelConfig, overwrite: bool = False,
) -> DataFrame:
    """Structures below a folder -> stored samples of every run so far."""
    tag = run_incremental(
        spark, structure_stream(spark, path), out, config.as_dict(), voxel_builder(config), overwrite
    )
    return latest_samples(spark, out, tag)


def reconcile_accessions(wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(landed, missing) accessions by the file name each one gets."""
    named = wanted.where(F.trim("accession") != "").withColumn(
        "name", F.concat(F.lit("AF-"), F.trim("accession"), F.lit("-F1-model_v6.pdb"))
    )
    present = files.select(F.substring_index("path", "/", -1).alias("name")).distinct()
    return (
        named.join(present, "name", "left_semi").drop("name"),
        named.join(present, "name", "left_anti").drop("name"),
    )


DOWNLOADED, OUTSTANDING = "downloaded", "not_downloaded"


def _outstanding(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """Accessions still missing after the last batch (before the given one); only that batch is read."""
    try:
        kept = spark.read.schema("accession string, batch bigint").parquet(f"{out}/{OUTSTANDING}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "accession string")
    earlier = kept if before is None else kept.where(F.col("batch") < before)
    last = earlier.agg(F.max("batch")).first()[0]
    return kept.where(F.col("batch") == (-1 if last is None else last)).select("accession")


def append_ledgers(
    wanted: DataFrame, files: DataFrame | Callable[[DataFrame], DataFrame], batch: int, out: str
) -> None:
    """Success and failure ledgers of one micro-batch, idempotent by batch.

    What earlier batches could not get is asked for again, so the last batch of
    the failure ledger holds everything outstanding. ``files`` lists what is
    there (path), or says it for a table of accessions. No earlier success is read.
    """
    spark = wanted.sparkSession
    asked = wanted.select(F.trim("accession").alias("accession")).where("accession <> ''")
    asked = cut_lineage(asked.unionByName(_outstanding(spark, out, batch)).distinct())
    landed, missing = reconcile_accessions(asked, files(asked) if callable(files) else files)
    for rows, name in ((landed, DOWNLOADED), (missing, OUTSTANDING)):
        rows.select("accession").write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")


def ledgers(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(accession and the batch that first got it, accessions outstanding)."""
    got = spark.read.schema("accession string, batch bigint").parquet(f"{out}/{DOWNLOADED}")
    return got.groupBy("accession").agg(F.min("batch").alias("batch")), _outstanding(spark, out)


def present_files(root: str) -> Callable[[DataFrame], DataFrame]:
    """For accessions: the paths of their files that are in a folder; each is asked for by name."""

    def paths(asked: DataFrame) -> DataFrame:
        named = asked.select(F.concat(F.lit(f"{root.rstrip('/')}/AF-"), "accession", F.lit("-F1-model_v6.pdb")).alias("path"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([exists(p) for p in batch["path"].to_pylist()], pa.bool_()))

        return named.mapInArrow(run, "path string")

    return paths


def run_ledgers(spark: SparkSession, accessions: DataFrame, files: DataFrame | Callable, out: str) -> None:
    """Reconcile a stream of wanted accessions, batch by batch, until what has arrived is done."""
    query = (
        accessions.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/progress")
        .foreachBatch(lambda df, batch: append_ledgers(df, files, batch, out)).start()
    )
    query.awaitTermination()
