"""Records of delimited text whose quoted fields may hold line breaks, read split by split.

Whether a line begins a record depends on all quotes before it in its file. A
line turns the state (outside or inside quotes) into another; so does a split,
and such maps compose. Each split therefore reports where it ends from both
start states, a scan over the splits of a file fixes every split's start, and
lines are cut into records without reading any file in one piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.runtime import cut_lineage, landed


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line leaves a quoted field open.

    A quote opens a field only as its first character; inside, a doubled quote
    is one of its characters; what follows the closing quote up to the comma
    belongs to the field.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
            at += 1
        elif line.startswith('"', at):
            inside = True
            at += 1
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


_LINES = (
    "file string, block bigint, seq bigint, line string, before0 boolean, before1 boolean, "
    "after0 boolean, after1 boolean, start0 bigint, start1 bigint"
)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each split; for both start states: the state before and after, and where the record began."""
    split, seq, state, start = None, 0, [False, True], [None, None]
    for batch in batches:
        files, blocks, lines = (batch[c].to_pylist() for c in ("file", "block", "line"))
        out: list[list] = [[] for _ in range(7)]
        for file, block, line in zip(files, blocks, lines, strict=True):
            if (file, block) != split:
                split, seq, state, start = (file, block), 0, [False, True], [None, None]
            start = [start[h] if state[h] else seq for h in (0, 1)]
            after = [ends_inside(line, s) for s in state]
            for column, value in zip(out, (seq, *state, *after, *start), strict=True):
                column.append(value)
            state, seq = after, seq + 1
        kinds = [pa.int64(), *[pa.bool_()] * 4, pa.int64(), pa.int64()]
        seqs, *rest = (pa.array(c, k) for c, k in zip(out, kinds, strict=True))
        names = [c.split()[0] for c in _LINES.split(", ")]
        yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], seqs, batch["line"], *rest], names=names)


def split_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, opened): the state in which each split begins, and the record open there.

    One row for each split of the input files. A split keeps the state, swaps
    it, or sets it; so a split's start is the last state set before it in its
    file, swapped as often as splits since then swap.
    """
    last = F.max_by(F.struct("after0", "after1", "start0", "start1"), "seq")
    ends = lines.groupBy("file", "block").agg(last.alias("e")).select("file", "block", "e.*")
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum((F.col("after0") & ~F.col("after1")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("swaps", swaps)
    fixed = F.when(F.col("after0") == F.col("after1"), F.struct(F.col("after0").cast("int").alias("to"), "swaps"))
    ends = ends.withColumns({
        "fixed": F.last(fixed, ignorenulls=True).over(earlier), "swapped": F.coalesce(F.lag("swaps").over(order), F.lit(0)),
    })
    turns = F.coalesce("fixed.to", F.lit(0)) + F.col("swapped") - F.coalesce("fixed.swaps", F.lit(0))
    ends = ends.withColumn("inside", turns % 2 == 1)
    began = F.when(F.col("inside"), F.col("start1")).otherwise(F.col("start0"))
    opened = F.when(began.isNotNull(), F.struct("block", began.alias("seq")))
    return ends.select("file", "block", "inside", F.last(opened, ignorenulls=True).over(earlier).alias("opened"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """line (the record's whole text) and row_no (file, block, seq of its first line) of every record.

    Lines are written once with their positions, as another reading may be
    split elsewhere. Line breaks inside quotes become "\\n". A field that is
    never closed runs to the end of its file. Blank lines outside quotes are
    records with an empty text.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = landed(text.mapInArrow(_scan, _LINES), "manifest-lines")
    states = cut_lineage(split_states(lines))  # one row for each split of the input
    placed = lines.join(F.broadcast(states), ["file", "block"])

    def actual(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    own = F.when(actual("start").isNotNull(), F.struct("block", actual("start").alias("seq")))
    placed = placed.select("file", "block", "seq", "line", (actual("before") | actual("after")).alias("joined"), F.coalesce(own, "opened").alias("first"))
    alone = placed.where(~F.col("joined")).select("line", F.struct("file", "block", "seq").alias("row_no"))
    parts = placed.where("joined").groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "line"))).alias("parts"))
    several = parts.select(
        F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"),
        F.struct("file", F.col("first.block").alias("block"), F.col("first.seq").alias("seq")).alias("row_no"))
    return alone.unionByName(several)


def is_header(row_no: str = "row_no") -> Column:
    """The first record of a file."""
    return (F.col(f"{row_no}.block") == 0) & (F.col(f"{row_no}.seq") == 0)
