"""Near duplicates: SimHash fingerprints linked through vantage-point trees.

Distances to a vantage point part the distinct fingerprints into an inner and an
outer half, again and again, down to shards. By the triangle inequality a
fingerprint has neighbours within the radius in a half only if its own distance
comes within the radius of the border, so it is sent to its own shard and to
those shards whose borders it overlaps. Each shard builds a tree of its own,
prunes branches in the same way and compares what is left bit by bit. Pairs are
folded into a spanning forest at once, so a large group yields few edges.

Where a similarity of shingle sets decides, fingerprints are only the finder.
Sets meet in the groups that the vantage-point shards link over all fingerprints.
Pairs that lie farther apart are kept within the key that they share: sets meet in
the groups that fingerprints link under one shingle minimum, or that share one
rare shingle, and no two such groups are joined before their sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.components import star_components
from voxlake.llm.shared import ascii_lower, columns, few, map_rows, shuffle_width, stored, with_places
from voxlake.operators.skew import lookup_join

SEED = 42
#: Fingerprints of a shard aimed at, most levels of the shard tree, its sample; leaf of a tree, cells compared at a time.
SHARD, LEVELS, SAMPLE = 32_768, 16, 16_384
LEAF, CELLS = 256, 1 << 20
#: Keys that a group's rows are joined under.
SALTS = 32
#: Texts of at most FEW shingles are found by shared shingles; shingles that a task compares, aimed at.
FEW, WORK = 64, 4_000_000
#: Differing bits of 64 at which fingerprints alone make texts candidates, as they link them in op10.
CLOSE = 4


def shingle_hashes(text: str, words: int, bits: int = 64) -> np.ndarray:
    """Hash bytes of every run of words (all of them, if fewer), A-Z lower-cased; (n, bits / 8).

    64 bits: XXH64; 128 bits: XXH128, both with SEED.
    """
    parts = ascii_lower(text).split()  # splits bytes at ASCII white space only
    if not parts:
        return np.zeros((0, bits // 8), np.uint8)
    joined = b" ".join(parts)
    ends = list(accumulate((len(p) + 1 for p in parts), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends)]
    digest = {64: xxhash.xxh64_digest, 128: xxhash.xxh128_digest}[bits]
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[min(words, len(parts)) - 1 :], strict=False)]
    return np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, bits // 8)


def majority(hashes: np.ndarray) -> bytes:
    """The fingerprint: bits that more than half of the hashes have, highest first; zero without any."""
    counts = np.zeros(8 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def shingle_minima(hashes: np.ndarray, n: int) -> list[int]:
    """Minima of n mixed hash functions of 128-bit shingle hashes; all zero without shingles."""
    if not len(hashes):
        return [0] * n
    low, high = hashes.view("<u8").T
    mixed = (low[None, :] + np.arange(1, n + 1, dtype=np.uint64)[:, None] * high[None, :]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ mixed >> np.uint64(32)).min(1).view(np.int64).tolist()


def fingerprints(docs: DataFrame, words: int, bits: int = 64) -> DataFrame:
    """doc_id, row_id, fp (the fingerprint's bytes)."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [majority(shingle_hashes(text, words, bits)) for text in batch["text"].to_pylist()]
        return columns(doc_id=batch["doc_id"], row_id=batch["row_id"], fp=pa.array(fps, pa.binary()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, part, "doc_id long, row_id long, fp binary")


def _bits(fps: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit integers."""
    values = fps.to_pylist()
    return np.frombuffer(b"".join(values), "<u8").reshape(len(values), -1) if values else np.zeros((0, 1), np.uint64)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits over the last axis; at most 128, so bytes hold it."""
    return sum(np.bitwise_count(a[..., k] ^ b[..., k]) for k in range(a.shape[-1]))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and each row's place among them."""
    order = np.lexsort(rows.T)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[order[new]], place


class ShardTree:
    """Vantage points and borders; leaves are shards."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.shards = 0
        self.root = self._grow(sample, levels)

    def _grow(self, sample: np.ndarray, levels: int):
        if levels and len(sample) > 1:
            point = sample[len(sample) // 2]
            gaps = _gap(sample, point)
            border = int(np.median(gaps))
            if border == gaps.max():
                border -= 1
            inner = gaps <= border
            if inner.any() and not inner.all():
                return point, border, self._grow(sample[inner], levels - 1), self._grow(sample[~inner], levels - 1)
        self.shards += 1
        return self.shards - 1

    def visits(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """shard, positions in fps that may have neighbours there; radius 0: their own shards."""
        stack = [(self.root, np.arange(len(fps)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            point, border, inner, outer = node
            gaps = _gap(fps[at], point).astype(np.int64)
            stack += [(inner, at[gaps - radius <= border]), (outer, at[gaps + radius > border])]


class Forest:
    """Spanning forest of the pairs seen so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        new = np.flatnonzero(la != lb)
        if not len(new):
            return
        low, high = np.minimum(la[new], lb[new]), np.maximum(la[new], lb[new])
        _, first = np.unique(low * len(self.label) + high, return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        for i in first.tolist():
            x, y = find(int(low[i])), find(int(high[i]))
            if x != y:
                root[max(x, y)] = min(x, y)
                self.edges.append((int(a[new[i]]), int(b[new[i]])))
        moved = np.arange(len(self.label))
        for x in root:
            moved[x] = find(x)
        self.label = moved[self.label]


def near_forest(members: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of all pairs (query, member) within the radius, by a vantage-point tree over the members."""
    values, _, forest = _linked(members, queries, radius)
    edges = np.array(forest.edges, np.int64).reshape(-1, 2)
    return values[edges[:, 0]], values[edges[:, 1]]


def near_labels(members: np.ndarray, radius: int) -> np.ndarray:
    """For each row a label of the group that pairs within the radius link it to."""
    _, place, forest = _linked(members, members[:0], radius, True)
    return forest.label[place]


def _linked(members: np.ndarray, queries: np.ndarray, radius: int, among: bool = False) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Distinct rows, each row's place among them, and their forest; among: members are the queries too."""
    values, place = _distinct(np.concatenate([members, queries]))
    forest = Forest(len(values))
    first = np.unique(place[: len(members)])
    stack = [(first, first if among else np.unique(place[len(members) :]))]
    while stack:
        m, q = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > LEAF:
            point = values[m[len(m) // 2]]
            gaps = _gap(values[m], point)
            border = int(np.median(gaps))
            border -= border == gaps.max()
            inner = gaps <= border
            if inner.any() and not inner.all():
                far = _gap(values[q], point).astype(np.int64)
                stack += [(m[inner], q[far - radius <= border]), (m[~inner], q[far + radius > border])]
                continue
        rows = max(1, CELLS // len(m))
        for at in range(0, len(q), rows):
            some = q[at : at + rows]
            x, y = np.nonzero(_gap(values[some][:, None], values[m][None, :]) <= radius)
            a, b = some[x], m[y]
            forest.add(a[a != b], b[a != b])
    return values, place, forest


def near_edges(fps: DataFrame, radius: int) -> DataFrame:
    """a, b: a spanning forest for each shard of the links between distinct fingerprints fp."""
    spark = fps.sparkSession
    n = fps.count()
    levels = 0
    while levels < LEVELS and n >> levels > SHARD:
        levels += 1
    sample = [r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()]
    tree = spark.sparkContext.broadcast(ShardTree(_bits(pa.array(sample, pa.binary())), levels))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, bits, own = batch["fp"], _bits(batch["fp"]), np.zeros(batch.num_rows, np.int32)
            for shard, at in tree.value.visits(bits, 0):
                own[at] = shard
                yield columns(shard=pa.array(np.full(len(at), shard, np.int32)), fp=values.take(pa.array(at)), member=pa.array(np.ones(len(at), bool)))
            for shard, at in tree.value.visits(bits, radius):
                at = at[own[at] <= shard]  # of two shards, the one with the larger number compares
                yield columns(shard=pa.array(np.full(len(at), shard, np.int32)), fp=values.take(pa.array(at)), member=pa.array(np.zeros(len(at), bool)))

    sent = stored(fps.select("fp").mapInArrow(send, "shard int, fp binary, member boolean"), "visits")
    loads = sent.groupBy("shard").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("q"))
    loads = stored(loads.select("shard", F.ceil(F.col("m") / (2 * SHARD)).cast("int").alias("m_parts"), F.ceil(F.col("q") / SHARD).cast("int").alias("q_parts")), "shard-loads")
    dealt = sent.join(F.broadcast(loads), "shard")  # at most 2 ** LEVELS rows
    part = lambda parts: F.pmod(F.xxhash64("fp"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    members = dealt.where("member").where("q_parts > 0").withColumn("m_part", part("m_parts")).withColumn("q_part", every("q_parts"))
    queries = dealt.where(~F.col("member")).where("m_parts > 0").withColumn("q_part", part("q_parts")).withColumn("m_part", every("m_parts"))
    keys, take = ("shard", "m_part", "q_part"), ("shard", "m_part", "q_part", "fp")

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        a, b = near_forest(_bits(left["fp"]), _bits(right["q_fp"]), radius)
        return pa.table({c: pa.array([r.tobytes() for r in rows], pa.binary()) for c, rows in (("a", a), ("b", b))})

    asking = queries.select(*(F.col(c).alias(f"q_{c}") for c in take))  # names of its own: both come from one table
    return members.select(*take).groupBy(*keys).cogroup(asking.groupBy(*(f"q_{c}" for c in keys))).applyInArrow(link, "a binary, b binary")


def groups_by_minima(rows: DataFrame, radius: int) -> DataFrame:
    """comp, fp: groups of sets (fp, print, minima) that share a minimum and whose fingerprints link them there.

    Two sets of shingles with similarity s share one of n minima with
    probability 1 - (1 - s) ** n. A group is named by its members, so the same
    group under several minima is one. Keys with more fingerprints than a task
    holds are taken out and linked by near_edges instead, all of them together.
    """
    keyed = stored(rows.select("fp", "print", F.posexplode("minima").alias("slot", "least")), "minima")
    counts = keyed.groupBy("slot", "least").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = stored(counts, "shared-minima")
    several = lookup_join(keyed, counts.where(F.col("n") <= SHARD).drop("n"), ["slot", "least"], "left_semi", deal=["fp"], counts=counts)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fps, prints = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            labels = near_labels(np.frombuffer(b"".join(prints), "<u8").reshape(len(prints), -1), radius) if prints else np.zeros(0, np.int64)
            order = np.argsort(labels, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
                if len(part) > 1:
                    members = sorted(fps[i] for i in part)
                    comp = xxhash.xxh128_digest(b"".join(members), SEED)
                    yield columns(comp=pa.array([comp] * len(members), pa.binary()), fp=pa.array(members, pa.binary()))

        for batch in batches:
            for *key, fp, own in zip(*(batch[c].to_pylist() for c in ("slot", "least", "fp", "print")), strict=True):
                if key != held:
                    yield from close()
                    held, fps, prints = key, [], []
                fps.append(fp)
                prints.append(own)
        yield from close()

    runs = several.repartition(shuffle_width(rows.sparkSession), "slot", "least").sortWithinPartitions("slot", "least")
    found = runs.mapInArrow(link, "comp binary, fp binary").distinct()
    crowded = counts.where(F.col("n") > SHARD).drop("n")
    if crowded.isEmpty():
        return found
    dense = stored(lookup_join(keyed, crowded, ["slot", "least"], "left_semi", deal=["fp"], counts=counts).select("fp", "print").distinct(), "dense")
    stars = star_components(near_edges(dense.select(F.col("print").alias("fp")).distinct(), radius))
    rooted = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    linked = lookup_join(dense.withColumnRenamed("print", "node"), stored(rooted, "dense-groups"), ["node"], deal=["fp"])
    return found.unionByName(linked.select(F.col("root").alias("comp"), "fp"))


def groups_by_distance(rows: DataFrame, radius: int) -> DataFrame:
    """comp, fp: groups of sets (fp, print) whose fingerprints near_edges links, over all shards; equal fingerprints are one node."""
    stars = star_components(near_edges(rows.select(F.col("print").alias("fp")).distinct(), radius))
    rooted = stored(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "close-groups")
    linked = lookup_join(rows.withColumnRenamed("print", "node"), rooted, ["node"], "left", deal=["fp"])
    return linked.select(F.coalesce("root", "node").alias("comp"), "fp")


def _first_order() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")


def named_groups(rows: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, row_id, fp, component_id, root_row of rows, whose classes (fp, first) the edges a, b link."""
    stars = star_components(edges)
    rooted = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    linked = classes.join(rooted, F.col("fp") == F.col("node"))
    groups = linked.groupBy("root").agg(F.min("first").alias("group_first")).withColumnRenamed("root", "of")
    groups = groups.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))  # a large group meets its first row in several tasks
    named = salted.join(groups, (F.col("root") == F.col("of")) & (F.col("salt") == F.col("of_salt"))).select(F.col("fp").alias("linked_fp"), "group_first")
    whole = classes.join(named, F.col("fp") == F.col("linked_fp"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("group_first", "first").alias("head"))
    joined = lookup_join(rows, stored(whole, "groups").withColumnRenamed("class_fp", "fp"), ["fp"], deal=["row_id"])  # copies share a fingerprint
    return joined.select("doc_id", "row_id", "fp", F.col("head.doc_id").alias("component_id"), F.col("head.row_id").alias("root_row"))


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4, bits: int = 64) -> DataFrame:
    """doc_id, row_id, fp, component_id, root_row of every row.

    Texts whose fingerprints differ in at most radius bits are linked; linked
    groups are joined. component_id is the smallest doc_id of the group, null if
    no row of it has one; root_row is the row that stands for the group (the
    smallest doc_id, rows without one last, then reading order). Null texts and
    texts without words have fingerprint zero and are linked like any other;
    texts with fewer words are one shingle. Repeated rows give one row each;
    other columns are ignored; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, words, bits), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min(_first_order()).alias("first")), "classes")
    return named_groups(rows, classes, near_edges(classes, radius))


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets of at least the similarity, so many first elements of each in any common order share one."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def finder_radius(similarity: float, bits: int) -> int:
    """Six deviations beyond the mean distance of fingerprints of equally large sets of this similarity."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(bits, math.ceil(bits * share + 6 * math.sqrt(bits * share * (1 - share))))


def shingle_set(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes in order, and where each stands first among the 128-bit hashes."""
    return np.unique(np.ascontiguousarray(hashes).view("<u8")[:, 0], return_index=True)


def set_rows(docs: DataFrame, place: str, words: int, similarity: float, minima: int) -> DataFrame:
    """doc_id, row_id (the column place), fp (digest of the shingle set), print (its fingerprint), size, minima (over FEW shingles), few (the whole set, where it may be similar to one of at most FEW)."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {"fp": [], "print": [], "size": [], "minima": [], "few": []}
        for text in batch["text"].to_pylist():
            hashes = shingle_hashes(text, words, 128)
            own, at = shingle_set(hashes)
            n = len(own)
            out["fp"].append(xxhash.xxh128_digest(own.tobytes(), SEED))
            out["print"].append(majority(hashes[at]))
            out["size"].append(n)
            out["minima"].append(shingle_minima(hashes[at], minima) if n > FEW else [])
            out["few"].append(own.view(np.int64).tolist() if n * similarity <= FEW + 1e-9 else [])
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return columns(doc_id=batch["doc_id"], row_id=batch["row_id"], **{c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(place).alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, part, "doc_id long, row_id long, fp binary, print binary, size long, minima array<bigint>, few array<bigint>")


def groups_by_rare_shingle(classes: DataFrame, similarity: float) -> DataFrame:
    """comp, fp: groups of small sets (few) that share one of the first shingles of each, rarest first.

    Two sets of at least the similarity share one of their first prefix_length
    elements in any common order; here the order is the shingles' frequency
    among these sets, so a common opening line is in a prefix only where little
    else is. Shingles of one set only count as rarest and need no group. Of
    shingles with the same sets one is kept.
    """
    keyed = stored(classes.where(F.size("few") > 0).select("fp", "size", F.explode("few").alias("shingle")), "few")
    counts = stored(keyed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-shingles")
    shared = lookup_join(keyed, counts, ["shingle"], deal=["fp"], counts=counts)
    kept = shared.groupBy("fp", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s"))  # at most FEW / similarity shingles
    n = F.col("size")
    prefix = n - F.ceil(n * F.lit(similarity) - F.lit(1e-9)) + 1 - (n - F.size("s"))
    ahead = stored(kept.where(prefix > 0).select("fp", F.explode(F.slice("s", F.lit(1), prefix.cast("int"))).alias("x")).select("fp", F.col("x.shingle").alias("shingle")), "prefixes")
    members = F.xxhash64("fp")
    same = ahead.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(members).alias("x"), F.sum(members.cast("decimal(20,0)")).alias("s")).where("n > 1")
    chosen = stored(same.groupBy("n", "x", "s").agg(F.min("shingle").alias("shingle")).select("shingle", "n"), "rare-shingles")
    found = lookup_join(ahead, chosen.drop("n"), ["shingle"], deal=["fp"], counts=chosen)
    return found.select(F.unhex(F.hex("shingle")).alias("comp"), "fp")


def candidate_groups(classes: DataFrame, similarity: float, bits: int = 128) -> DataFrame:
    """comp, fp, size, row_id: similar sets meet in some group comp; a set may be in several.

    All sets meet whose fingerprints the vantage-point shards link at CLOSE bits.
    Beyond that, sets of more than FEW shingles meet by fingerprints that share a
    minimum and lie within the finder's radius; smaller ones, and those up to
    FEW / similarity, by a shared rare shingle, which misses none.
    """
    close = groups_by_distance(classes.select("fp", "print"), CLOSE * bits // 64)
    many = groups_by_minima(classes.where(F.col("size") > FEW).select("fp", "print", "minima"), finder_radius(similarity, bits))
    found = stored(close.unionByName(many).unionByName(groups_by_rare_shingle(classes, similarity)), "candidate-groups")
    nodes = classes.select("fp", "size", F.col("first.row_id").alias("row_id"))
    return lookup_join(found, nodes, ["fp"], deal=["comp"])


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of all pairs of sets with at least this Jaccard similarity; prefix filter in order of frequency, then counts."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((rank[ids], owner))  # owners keep their stretches
    inside = np.arange(len(ids)) - (ends - sizes)[owner] < np.array([prefix_length(int(n), similarity) for n in sizes])[owner]
    picked = order[inside & (counts[ids[order]] > 1)]
    token, holder = ids[picked], owner[picked]
    by_token = np.argsort(token, kind="stable")
    postings, first = holder[by_token], np.searchsorted(token[by_token], np.arange(len(counts) + 1))
    own_first = np.searchsorted(holder, np.arange(len(sets) + 1))
    label, members, edges = np.arange(len(sets)), {i: [i] for i in range(len(sets))}, []
    mark = np.zeros(len(counts), bool)
    for i in range(len(sets)):
        lists = [postings[first[t] : first[t + 1]] for t in token[own_first[i] : own_first[i + 1]].tolist()]
        if not lists:
            continue
        near = np.unique(np.concatenate(lists))
        near = near[(near < i) & (label[near] != label[i])]
        near = near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]) - 1e-9]
        mark[ids[ends[i] - sizes[i] : ends[i]]] = True
        while len(near):
            j, near = int(near[0]), near[1:]
            shared = int(np.count_nonzero(mark[ids[ends[j] - sizes[j] : ends[j]]]))
            if shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9:
                edges.append((i, j))
                a, b = sorted((int(label[i]), int(label[j])), key=lambda x: len(members[x]))
                label[members[a]] = b
                members[b] += members.pop(a)
                near = near[label[near] != b]
        mark[ids[ends[i] - sizes[i] : ends[i]]] = False
    return edges


def similar_edges(docs: DataFrame, place: str, found: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: forests of the pairs of fp in each group of found whose shingle sets have the similarity.

    A text's set is made once and sent to each of its groups. A group's sets
    meet in one task; of a group with more than WORK shingles, every two parts
    meet.
    """
    found = stored(found, "grouped")
    loads = found.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / WORK).cast("int").alias("parts")).where("n > 1")
    dealt = lookup_join(found, stored(loads.drop("n"), "group-loads"), ["comp"], deal=["fp"]).withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    dealt = stored(dealt.groupBy("fp", F.col("row_id").alias("of_row")).agg(F.collect_list(F.struct("comp", "parts", "own")).alias("of")), "candidates")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [shingle_set(shingle_hashes(t, words, 128))[0].tobytes() for t in batch["text"].to_pylist()]
        return columns(fp=batch["fp"], of=batch["of"], shingles=pa.array(out, pa.binary()))

    texts = docs.select(F.col(place).alias("at_row"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(few(dealt.select(F.col("of_row").alias("at_row"))), "at_row", "left_semi")  # candidates only
    held = map_rows(texts.join(dealt, F.col("at_row") == F.col("of_row")).select("fp", "of", "text"), sets, "fp binary, of array<struct<comp: binary, parts: int, own: int>>, shingles binary")
    held = held.select("fp", F.explode("of").alias("o"), "shingles").select("fp", "o.*", "shingles")
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("comp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "shingles")
    keys = ("comp", "low", "high")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fps, own = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            edges = similar_forest(own, similarity) if len(own) > 1 else []
            if edges:
                yield columns(**{c: pa.array([fps[e[k]] for e in edges], pa.binary()) for k, c in enumerate("ab")})

        for batch in batches:
            for *key, fp, shingles in zip(*(batch[c].to_pylist() for c in (*keys, "fp", "shingles")), strict=True):
                if key != held:
                    yield from close()
                    held, fps, own = key, [], []
                fps.append(fp)
                own.append(np.frombuffer(shingles, "<u8"))
        yield from close()

    return pairs.repartition(shuffle_width(docs.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(link, "a binary, b binary")


def set_classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct set, with the first of its rows."""
    return rows.groupBy("fp").agg(F.min(_first_order()).alias("first"), *(F.first(c).alias(c) for c in ("print", "size", "minima", "few")))


def similar_groups(docs: DataFrame, place: str, words: int, similarity: float, bits: int = 128, minima: int = 10) -> DataFrame:
    """Like near_groups, but texts are linked whose sets of shingles have at least this Jaccard similarity.

    row_id is docs' column place; docs is read twice, so place must be a stored
    column. Texts without words are linked with each other.
    """
    rows = stored(set_rows(docs, place, words, similarity, minima), "shingle-sets")
    classes = stored(set_classes(rows), "classes")
    return named_groups(rows, classes, similar_edges(docs, place, candidate_groups(classes, similarity, bits), words, similarity))


def keep_representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 128, minima: int = 10) -> DataFrame:
    """Rows of docs, all columns, one of each group of texts whose sets of shingles have at least the Jaccard similarity.

    Fingerprints and shared shingles find the pairs (candidate_groups), the sets
    decide. Of pairs with similarity 0.8 and over FEW shingles, one in ten
    million shares none of ten minima, and about as few lie beyond the radius;
    smaller texts are found without loss.
    """
    place = "__row_id"
    placed = with_places(docs, place)  # a row's place differs between readings with other splits
    kept = similar_groups(placed, place, words, similarity, bits, minima)
    copies = stored(kept.where(F.col("row_id") != F.col("root_row")).select(F.col("row_id").alias(place)), "near-copies")
    return placed.join(few(copies), place, "left_anti").drop(place)
