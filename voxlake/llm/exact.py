"""Exact duplicates through a minimal perfect hash over a history of digests.

The history is the set of distinct digests of an older part of the table (the
larger half of the doc_ids, so that its winners stay winners). It is cut into
shards by digest; each shard is a minimal perfect hash (levels of bit sets, in
which a key takes the first level where it is alone) whose slots hold the whole
digest, the winner's locator and the number of its rows. A row's digest leads to
one slot; only if the slot's bytes equal the digest is the row a member, and a
repeat of the history's winner. Rows that are not members are grouped among
themselves, and members that the history did not count are added to its sizes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.shared import ascii_lower, columns, few, map_rows, shuffle_width, stored, with_places
from voxlake.operators.skew import lookup_join

#: Digests of a shard aimed at, and most shards; the table of shard sizes is broadcast, so it is bounded by the latter.
SHARD, MAX_SHARDS = 32_768, 65_536
SIZE = 32  # bytes of a digest


def text_digests(docs: DataFrame, place: str | None = None) -> DataFrame:
    """doc_id, row_id, digest: SHA-256 of the text with A-Z lower-cased; null counts as empty.

    row_id is the column place; without one, the row's place in this reading.
    """

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [hashlib.sha256(ascii_lower(t)).digest() for t in batch["text"].to_pylist()]
        return columns(doc_id=batch["doc_id"], row_id=batch["row_id"], digest=pa.array(out, pa.binary()))

    row_id = F.col(place) if place else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id.alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, part, "doc_id long, row_id long, digest binary")


def _words(digests: np.ndarray) -> np.ndarray:
    """Digests (n, SIZE) as four 64-bit integers each."""
    return np.ascontiguousarray(digests).view("<u8")


class PerfectHash:
    """Levels of bit sets with ranks; n keys take slots 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # rest: digests that no level parts, slots after all others
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        first = np.concatenate([[0], np.cumsum([s[-1] for s in sums])]).astype(np.int64)
        self.ranks, self.placed = [s + f for s, f in zip(sums, first, strict=False)], int(first[-1])

    @staticmethod
    def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = words[:, 1] + np.uint64(2 * level + 1) * words[:, 2]
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(size)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """digests: distinct rows (n, SIZE)."""
        left, levels = digests, []
        while len(left) and len(levels) < 48:
            size = max(8, len(left) * 3 // 2)
            at = cls.place(_words(left), len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, left)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for each digest; for digests outside the set any slot, or -1."""
        out, open_ = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self.place(_words(digests[open_]), level, len(bits)).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        for i, d in enumerate(self.rest):
            out[open_[(digests[open_] == d).all(1)]] = self.placed + i
        return out

    def packed(self) -> list[bytes]:
        return [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes], rest: bytes) -> PerfectHash:
        bits = [np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")).astype(bool) for x in levels]
        return cls(bits, _digest_rows([rest]))


def _digest_rows(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, SIZE)


def shard_of(digest: F.Column, shards: int) -> F.Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


_INDEX = "shard int, levels array<binary>, rest binary, digests binary, keep_ids array<bigint>, keep_rows array<bigint>, sizes array<bigint>"


def build_index(known: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of the history.

    known: distinct digests with winner struct(doc_id, row_id) and size. A
    shard's rows meet in one task: they are distinct, so no group of copies can
    make a shard large, and about SHARD of them until MAX_SHARDS is reached.
    """

    def build(group: pa.Table) -> pa.Table:
        digests = _digest_rows(group["digest"].to_pylist())
        mph = PerfectHash.build(digests)
        order = np.argsort(mph.slots(digests))
        take = lambda name: pa.array([group[name].take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))
        return pa.table({
            "shard": pa.array([group["shard"][0].as_py()], pa.int32()), "levels": pa.array([mph.packed()], pa.list_(pa.binary())),
            "rest": pa.array([mph.rest.tobytes()], pa.binary()), "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "keep_ids": take("keep_id"), "keep_rows": take("keep_row"), "sizes": take("size"),
        })

    rows = known.select("digest", F.col("winner.doc_id").alias("keep_id"), F.col("winner.row_id").alias("keep_row"), "size", shard_of(F.col("digest"), shards).alias("shard"))
    return rows.groupBy("shard").applyInArrow(build, _INDEX)


_FOUND = "doc_id long, row_id long, digest binary, member boolean, keep_id long, keep_row long, size long"


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """rows (doc_id, row_id, digest) with the slot's winner where the slot's bytes are the digest.

    Rows meet their shard in groups of bounded size: a shard with many rows, as
    with a text copied everywhere, is dealt over as many salts as its rows need.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("shard", shard_of(F.col("digest"), shards))
    loads = stored(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "shard-loads")  # at most MAX_SHARDS rows
    total = loads.agg(F.sum("n")).first()[0] or 0
    aim = min(SHARD, max(256, total // (4 * shuffle_width(spark)) or 1))
    salts = loads.select("shard", F.ceil(F.col("n") / F.lit(aim)).cast("int").alias("salts"))
    probes = keyed.join(F.broadcast(salts), "shard").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int")).drop("salts")
    copies = index.join(F.broadcast(salts), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        member, values = np.zeros(n, bool), {c: np.zeros(n, np.int64) for c in ("keep_ids", "keep_rows", "sizes")}
        nulls = np.zeros(n, bool)
        if n and right.num_rows:
            row = right.slice(0, 1).to_pylist()[0]
            mph, held = PerfectHash.unpacked(row["levels"], row["rest"]), _digest_rows([row["digests"]])
            digests = _digest_rows(left["digest"].to_pylist())
            slot = mph.slots(digests)
            member = slot >= 0
            member[member] = (held[slot[member]] == digests[member]).all(1)
            for c, out in values.items():
                out[member] = np.array([x if x is not None else 0 for x in row[c]], np.int64)[slot[member]]
            nulls[member] = np.array([x is None for x in row["keep_ids"]], bool)[slot[member]]
        of = lambda c, hide: pa.array(values[c], mask=hide)
        return pa.table({"doc_id": left["doc_id"], "row_id": left["row_id"], "digest": left["digest"].cast(pa.binary()), "member": pa.array(member), "keep_id": of("keep_ids", ~member | nulls), "keep_row": of("keep_rows", ~member), "size": of("sizes", ~member)})

    return probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probe, _FOUND)


def digest_groups(digests: DataFrame) -> DataFrame:
    """digest, winner struct(doc_id, row_id), size; copies are counted before the shuffle."""
    return digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row_id")).alias("winner"), F.count(F.lit(1)).alias("size"))


#: Share of the doc_ids, from the largest, whose digests are the history.
HISTORY = 0.5


def history_start(digests: DataFrame) -> int | None:
    """The doc_id at which the history begins; any would give the same groups."""
    return digests.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", 1 - HISTORY)).first()[0]


def shards_for(n: int, spark: SparkSession) -> int:
    """Shards of a history of n digests."""
    return max(-(-n // SHARD), min(MAX_SHARDS, shuffle_width(spark))) if n <= SHARD * MAX_SHARDS else MAX_SHARDS


def exact_groups(docs: DataFrame, place: str | None = None) -> DataFrame:
    """doc_id, row_id, keep_id, keep_row, group_size, kept, text_sha256 of every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest doc_id stays; of rows that also share it, the last
    in reading order, so one row of each text stays. Rows without doc_id lose to
    rows with one. Other columns are ignored; an empty table gives no rows.
    row_id is the column place, if given.
    """
    digests = stored(text_digests(docs, place), "digests")
    start = history_start(digests)
    old = F.coalesce(F.col("doc_id") >= F.lit(start), F.lit(False)) if start is not None else F.lit(False)
    known = stored(digest_groups(digests.where(old)), "history")
    shards = shards_for(known.count(), docs.sparkSession)
    found = delivered(digests, stored(build_index(known, shards), "perfect-hash"), shards, old)
    return found.select(
        "doc_id", "row_id", "keep_id", "keep_row", F.col("size").alias("group_size"), (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def delivered(digests: DataFrame, index: DataFrame, shards: int, counted: F.Column | None = None) -> DataFrame:
    """doc_id, row_id, digest, member, keep_id, keep_row, size of rows judged against a history.

    Members get the history's winner; the others are grouped among themselves,
    largest doc_id first. size is the group's: the history's rows and those
    members that it has not counted (all, unless counted says which it has).
    """
    counted = F.lit(False) if counted is None else counted
    found = stored(look_up(digests, index, shards).withColumn("new", ~counted), "looked-up")
    more = found.where(F.col("member") & F.col("new")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    members = lookup_join(found.where("member"), stored(more.withColumnRenamed("n", "more"), "added"), ["digest"], "left", deal=["row_id"], counts=more)
    members = members.withColumn("size", F.col("size") + F.coalesce("more", F.lit(0)))
    rest = found.where(~F.col("member"))
    own = stored(digest_groups(rest), "new-groups")
    own = own.select("digest", F.col("winner.doc_id").alias("own_id"), F.col("winner.row_id").alias("own_row"), F.col("size").alias("n"))
    fresh = lookup_join(rest, own, ["digest"], deal=["row_id"], counts=own)
    fresh = fresh.withColumns({"keep_id": F.col("own_id"), "keep_row": F.col("own_row"), "size": F.col("n")})
    names = ("doc_id", "row_id", "digest", "member", "keep_id", "keep_row", "size")
    return members.select(*names).unionByName(fresh.select(*names))


def keep_winners(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns, with one row for each text.

    A row's place differs between readings with other splits, so docs is
    written once with it, and only that table is read.
    """
    place = "__row_id"
    placed = with_places(docs, place)
    copies = stored(exact_groups(placed, place).where(~F.col("kept")).select(F.col("row_id").alias(place)), "copies")
    return placed.join(few(copies), place, "left_anti").drop(place)
