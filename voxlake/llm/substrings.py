"""Passages that repeat across documents: seeds on winnowed anchors, extended both ways.

Of the word shingles of every window of `length` words the one with the least
hash (the last of equals) is the window's anchor. The choice depends on the
window's words alone, so documents that share a window share its anchor at the
same place in it. Documents meet on equal anchors. Each class of occurrences is
extended word by word against its first document's occurrence; whatever windows
that settles are done, and the rest of the class parts by the first word that
differs, on the left or on the right, and meets again. No two occurrences are
ever paired but with their class's first, so a class of m costs m rows a round.
Classes that fit a task go through all rounds there; larger ones are dealt over
all tasks for a round and come back as smaller classes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.shared import columns, map_rows, slices, stored
from voxlake.operators.skew import heavy_keys, lookup_join

#: Words of a window, and words of a shingle.
LENGTH = 50
#: Text is split into words in runs of so many bytes; windows are judged in runs of so many words.
RUN, BLOCK = 1 << 20, 1 << 16
#: Classes with more occurrences than this, and than their share of a partition, are extended by all tasks.
HEAVY = 32_768
#: Words remembered with their hash in a process, and the longest such word in bytes.
KNOWN, LONGEST = 300_000, 64

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """Words between bytes 20 and 09 to 0D, in runs of about RUN bytes."""
    at = 0
    while at < len(text):
        stop = _SPACE.search(text, at + RUN)
        end = stop.start() if stop else len(text)
        yield text[at:end].split()
        at = end


class _Hashes(dict):
    """XXH64 of a word, never zero; short words are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) or 1
        if len(word) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = value
        return value


_HASHES = _Hashes()


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(BLOCK + 4096, _BASE), _powers(BLOCK + 4096, pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def anchors(words: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, lo, hi of each anchor: the windows that start lo to hi words before place chose it."""
    k = length // 2
    span = length - k + 1
    found: list[tuple] = []
    for at in range(0, len(words) - length + 1, BLOCK):
        part = words[at : at + BLOCK + length - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)], dtype=np.uint64)])
        grams = mixed((sums[k:] - sums[:-k]) * _DOWN[: len(part) - k + 1])
        windows = np.lib.stride_tricks.sliding_window_view(grams, span)
        chosen = np.arange(span - 1, len(grams)) - windows[:, ::-1].argmin(1)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([first[1:], [len(chosen)]]) - 1
        place = chosen[first]
        found.append((grams[place], place + at, place - last, place - first))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tag(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def hashes_and_digest(text: bytes) -> tuple[np.ndarray, bytes]:
    runs, sha = [], hashlib.sha256()
    for words in word_runs(text):
        if words:
            sha.update((b" " if runs else b"") + b" ".join(words))
            runs.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(runs) if runs else np.zeros(0, np.uint64), sha.digest()


def digest_of(text: bytes, gone: np.ndarray | None = None) -> bytes:
    """SHA-256 of the words, but those marked as gone, joined by one space."""
    sha, at, first = hashlib.sha256(), 0, True
    for words in word_runs(text):
        kept = words if gone is None else [w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g]
        at += len(words)
        if kept:
            sha.update((b"" if first else b" ") + b" ".join(kept))
            first = False
    return sha.digest()


_SUMMARY = "doc_id long, tag long, n_words long, digest binary, grams array<bigint>, places array<int>, los array<int>, his array<int>"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text as bytes; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def summaries(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Words, digest and anchors of every document; tag is the first part of the digest."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        tags, counts, digests, found = [], [], [], []
        for text in batch["text"].to_pylist():
            words, digest = hashes_and_digest(text)
            tags.append(_tag(digest))
            counts.append(len(words))
            digests.append(digest)
            found.append(anchors(words, length))
        grams, places, los, his = zip(*found, strict=True) if found else ([], [], [], [])
        return columns(
            doc_id=batch["doc_id"], tag=pa.array(tags, pa.int64()), n_words=pa.array(counts, pa.int64()), digest=pa.array(digests, pa.binary()),
            grams=_lists([g.view(np.int64) for g in grams], pa.int64()), places=_lists(list(places), pa.int32()), los=_lists(list(los), pa.int32()), his=_lists(list(his), pa.int32()),
        )

    return map_rows(_texts(docs), part, _SUMMARY)


_SEED = "class long, doc_id long, tag long, place int, lo int, hi int, context binary"


def _contexts(words: np.ndarray, places: np.ndarray, los: np.ndarray, his: np.ndarray, length: int) -> np.ndarray:
    """For each anchor the word hashes before it, nearest first, and those behind it; zero where none is needed."""
    k = length // 2
    side = length - k
    steps = np.arange(side)
    left, right = places[:, None] - 1 - steps, places[:, None] + k + steps
    need_left, need_right = steps < his[:, None], steps < side - los[:, None]
    take = lambda at, need: np.where(need, words[np.where(need, at, 0)], np.uint64(0))
    return np.concatenate([take(left, need_left), take(right, need_right)], axis=1)


def seeds(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """One row for each anchor occurrence in wanted (doc_id, tag, marks), with its context."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                words, digest = hashes_and_digest(row["text"])
                if _tag(digest) != row["tag"]:
                    continue  # another text of the same doc_id
                marks = row["marks"]
                for at in range(0, len(marks), 4096):
                    part = marks[at : at + 4096]
                    of = lambda name: np.array([m[name] for m in part], np.int64)  # noqa: B023, E731
                    places, los, his = of("place"), of("lo"), of("hi")
                    context = _contexts(words, places, los, his, length)
                    yield columns(**{
                        "class": pa.array(of("gram"), pa.int64()), "doc_id": pa.array([row["doc_id"]] * len(part), pa.int64()), "tag": pa.array([row["tag"]] * len(part), pa.int64()),
                        "place": pa.array(places, pa.int32()), "lo": pa.array(los, pa.int32()), "hi": pa.array(his, pa.int32()), "context": pa.array([c.tobytes() for c in context], pa.binary()),
                    })

    texts = _texts(docs).where(F.col("doc_id").isNotNull())
    return lookup_join(texts, wanted, ["doc_id"]).select("doc_id", "text", "tag", "marks").mapInArrow(run, _SEED)


class Occurrences:
    """Arrays of equal length: class, document, tag, place, open windows lo to hi, context."""

    NAMES = ("class", "doc_id", "tag", "place", "lo", "hi")

    def __init__(self, columns_: dict[str, np.ndarray], context: np.ndarray):
        self.columns, self.context = columns_, context

    @classmethod
    def of(cls, batch: pa.RecordBatch, length: int, context: str = "context") -> Occurrences:
        words = np.frombuffer(b"".join(batch[context].to_pylist()), np.uint64).reshape(batch.num_rows, 2 * (length - length // 2))
        return cls({n: batch[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in cls.NAMES}, words)

    def __len__(self) -> int:
        return len(self.context)

    def take(self, at: np.ndarray) -> Occurrences:
        return Occurrences({n: c[at] for n, c in self.columns.items()}, self.context[at])

    def leads(self) -> np.ndarray:
        """For each occurrence the first one of its class: smallest document, then place."""
        order = np.lexsort([self.columns[n] for n in ("place", "tag", "doc_id", "class")])
        group = self.columns["class"][order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        out = np.empty(len(order), np.int64)
        out[order] = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        return out


def extend(own: Occurrences, lead: np.ndarray, source: np.ndarray, length: int) -> tuple[tuple, Occurrences]:
    """Extend each occurrence against its class's first, given by its context and document.

    Returns (index, first, last) of the spans whose windows that document, a
    smaller one, has as well, and the windows left, in classes that share one
    more word on the left or on the right.
    """
    side = length - length // 2
    equal, context = own.context == lead, own.context
    reach = lambda same: np.where(same.all(1), side, (~same).argmax(1))
    left, right = reach(equal[:, :side]), reach(equal[:, side:])
    group, place, lo, hi = (own.columns[n] for n in ("class", "place", "lo", "hi"))
    least, most = np.maximum(side - right, lo), np.minimum(left, hi)  # windows that the lead settles
    span = np.flatnonzero((least <= most) & (source < own.columns["doc_id"]))
    right_hi, left_lo = np.minimum(np.minimum(hi, left), side - right - 1), np.maximum(lo, left + 1)
    go_right, go_left = np.flatnonzero(lo <= right_hi), np.flatnonzero(left_lo <= hi)
    sums = lambda words: np.cumsum(words * _UP[:side], axis=1, dtype=np.uint64)
    key = lambda at, sign, words, upto: mixed(mixed(group[at].view(np.uint64) ^ np.uint64(sign)) + mixed(sums(words)[np.arange(len(at)), upto] + upto.astype(np.uint64))).view(np.int64)
    open_right, open_left = own.take(go_right), own.take(go_left)
    open_right.columns |= {"class": key(go_right, 0x14057B7EF767814F, context[go_right, side:], right[go_right]), "hi": right_hi[go_right]}
    open_left.columns |= {"class": key(go_left, 0x5851F42D4C957F2D, context[go_left, :side], left[go_left]), "lo": left_lo[go_left]}
    rest = Occurrences({n: np.concatenate([open_right.columns[n], open_left.columns[n]]) for n in own.NAMES}, np.concatenate([open_right.context, open_left.context]))
    return (span, place[span] - most[span], place[span] - least[span] + length), rest


_SPAN = "doc_id long, tag long, first long, last long, source long"


def _span_rows(own: Occurrences, spans: tuple, source: np.ndarray) -> dict[str, pa.Array]:
    at, first, last = spans
    return {"doc_id": pa.array(own.columns["doc_id"][at]), "tag": pa.array(own.columns["tag"][at]), "first": pa.array(first), "last": pa.array(last), "source": pa.array(source[at])}


def settle_light(rows: DataFrame, length: int) -> DataFrame:
    """Spans of all classes of rows: a task holds whole classes, some thousand rows at a time."""

    def settled(own: Occurrences) -> Iterator[pa.RecordBatch]:
        while len(own):
            lead = own.leads()
            source = own.columns["doc_id"][lead]
            spans, rest = extend(own, own.context[lead], source, length)
            if len(spans[0]):
                yield columns(**_span_rows(own, spans, source))
            own = rest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in slices(batches, 8192):  # sorted by class
            group = batch["class"].to_numpy()
            last = int(np.searchsorted(group == group[-1], True))  # where the last class begins
            if held and (last or group[0] != held[-1]["class"][-1].as_py()):
                head = np.flatnonzero(group != held[-1]["class"][-1].as_py())
                cut = int(head[0]) if len(head) else batch.num_rows
                yield from settled(_joined([*held, batch.slice(0, max(cut, last))], length))
                held = [batch.slice(max(cut, last))]
            else:
                held.append(batch)
        if held:
            yield from settled(_joined(held, length))

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, "class").sortWithinPartitions("class").mapInArrow(run, _SPAN)


def _joined(parts: list[pa.RecordBatch], length: int) -> Occurrences:
    parts = [p for p in parts if p.num_rows]
    if not parts:
        return Occurrences({n: np.zeros(0, np.int64) for n in Occurrences.NAMES}, np.zeros((0, 2 * (length - length // 2)), np.uint64))
    return Occurrences.of(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], length)


def extend_heavy(rows: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """One round for classes with many rows: spans (done) and open rows in their next classes.

    classes is (class, source, lead), bounded by skew.SHARE rows for each shuffle partition.
    """

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, source = Occurrences.of(batch, length), batch["source"].to_numpy()
        spans, rest = extend(own, Occurrences.of(batch, length, "lead").context, source, length)
        n, m = len(spans[0]), len(rest)
        done = _span_rows(own, spans, source)
        nulls = lambda k, kind: pa.nulls(k, kind)
        whole = lambda name, kind: pa.concat_arrays([done[name].cast(kind) if name in done else nulls(n, kind), pa.array(rest.columns[name], kind) if name in rest.columns else nulls(m, kind)])
        return columns(
            done=pa.array(np.repeat([True, False], [n, m])), **{"class": whole("class", pa.int64())}, doc_id=whole("doc_id", pa.int64()), tag=whole("tag", pa.int64()),
            place=whole("place", pa.int32()), lo=whole("lo", pa.int32()), hi=whole("hi", pa.int32()),
            context=pa.concat_arrays([nulls(n, pa.binary()), pa.array([c.tobytes() for c in rest.context], pa.binary())]),
            **{name: whole(name, pa.int64()) for name in ("first", "last", "source")},
        )

    met = rows.join(F.broadcast(classes), "class").select(*Occurrences.NAMES, "context", "source", "lead")
    return map_rows(met, part, f"done boolean, {_SEED}, first long, last long, source long", rows=8192)


def _judged(docs: DataFrame, length: int) -> DataFrame:
    """Summaries, written, with the smallest doc_id of equal word sequences as keep_id."""
    rows = stored(summaries(docs, length), "summaries")
    firsts = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    names = ["doc_id", "tag", "n_words", "digest"]
    return stored(lookup_join(rows, stored(firsts, "firsts"), ["digest"], "left", deal=["doc_id", "tag"]).select(*names, "keep_id", "grams", "places", "los", "his"), "judged")


def _spans(docs: DataFrame, judged: DataFrame, length: int) -> DataFrame:
    """doc_id, tag, first, last, source: pieces of repeats in first documents of their text."""
    spark = docs.sparkSession
    marks = F.explode(F.arrays_zip("grams", "places", "los", "his"))
    reps = judged.where(F.col("doc_id") == F.col("keep_id")).select("doc_id", "tag", marks.alias("m"))
    marks = stored(reps.select(F.col("m.grams").alias("gram"), "doc_id", "tag", F.col("m.places").alias("place"), F.col("m.los").alias("lo"), F.col("m.his").alias("hi")), "anchors")
    shared = marks.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("gram")
    met = lookup_join(marks, stored(shared, "shared-anchors"), ["gram"], "left_semi", deal=["doc_id", "place"])
    wanted = stored(met.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("gram", "place", "lo", "hi")).alias("marks")), "wanted")
    rows = stored(seeds(docs, wanted, length), "seeds")
    spans = spark.createDataFrame([], _SPAN)
    while True:  # a round leaves only classes of many rows, without their first
        heavy = spark.createDataFrame(heavy_keys(rows, ["class"], HEAVY), "key long, salts long").drop("salts")
        keyed = rows.withColumn("key", F.xxhash64("class"))
        light = keyed.join(F.broadcast(heavy), "key", "left_anti").drop("key")
        spans = spans.unionByName(stored(settle_light(light, length), "spans"))
        if heavy.isEmpty():
            return spans
        rows = keyed.join(F.broadcast(heavy), "key", "left_semi").drop("key")
        lead = F.min(F.struct("doc_id", "tag", "place", "context")).alias("lead")
        classes = stored(rows.groupBy("class").agg(lead).select("class", F.col("lead.doc_id").alias("source"), F.col("lead.context").alias("lead")), "leads")
        done = stored(extend_heavy(rows, classes, length), "extended")
        spans = spans.unionByName(done.where("done").select("doc_id", "tag", "first", "last", "source"))
        rows = done.where(~F.col("done")).select(*Occurrences.NAMES, "context")


def _merged(spans: list[dict]) -> list[tuple[int, int, int]]:
    """first, last, source of the maximal runs of overlapping spans."""
    out: list[list[int]] = []
    for first, last, source in sorted((s["first"], s["last"], s["source"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1], out[-1][2] = max(last, out[-1][1]), min(source, out[-1][2])
        else:
            out.append([first, last, source])
    return [tuple(x) for x in out]


def _by_document(spans: DataFrame) -> DataFrame:
    return spans.distinct().groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "last", "source")).alias("spans"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, first_word, last_word, source: maximal repeats of at least length words.

    Word first_word to last_word (from 0) of the document are covered by windows
    whose words also start in a document with a smaller doc_id; source is the
    smallest such document met. A text equal word for word to that of a smaller
    doc_id is one repeat. Texts are whole; null counts as empty; rows without
    doc_id neither repeat nor are repeated; rows that share a doc_id do not
    repeat each other; other columns are ignored; an empty table gives no rows.
    Words are compared by 64-bit hashes.
    """
    judged = _judged(docs, length)
    copies = judged.where((F.col("doc_id") > F.col("keep_id")) & (F.col("n_words") >= length))
    copies = copies.select("doc_id", F.lit(0).cast("long").alias("first_word"), (F.col("n_words") - 1).alias("last_word"), F.col("keep_id").alias("source")).distinct()

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, *m) for d, spans in zip(batch["doc_id"].to_pylist(), batch["spans"].to_pylist(), strict=True) for m in _merged(spans)]
        doc, first, last, source = zip(*rows, strict=True) if rows else ([], [], [], [])
        return columns(doc_id=pa.array(doc, pa.int64()), first_word=pa.array(first, pa.int64()), last_word=pa.array([x - 1 for x in last], pa.int64()), source=pa.array(source, pa.int64()))

    found = map_rows(_by_document(_spans(docs, judged, length)).drop("tag"), part, "doc_id long, first_word long, last_word long, source long")
    return found.unionByName(copies)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; cases as in repeats.

    Each word under a repeat goes; repeats are judged on the input. kept_sha256
    is that of the words left, joined by one space.
    """
    judged = _judged(docs, length)
    spans = stored(_by_document(_spans(docs, judged, length)), "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = []
            for row in batch.to_pylist():
                if _tag(digest_of(row["text"])) == row["tag"]:
                    gone = np.zeros(sum(map(len, word_runs(row["text"]))), bool)
                    for first, last, _ in _merged(row["spans"]):
                        gone[first:last] = True
                    found.append((row["doc_id"], row["tag"], int(gone.sum()), digest_of(row["text"], gone)))
            doc, tag, n, digest = zip(*found, strict=True) if found else ([], [], [], [])
            yield columns(doc_id=pa.array(doc, pa.int64()), tag=pa.array(tag, pa.int64()), gone=pa.array(n, pa.int64()), left=pa.array(digest, pa.binary()))

    texts = _texts(docs).where(F.col("doc_id").isNotNull())
    cut = lookup_join(texts, spans, ["doc_id"]).select("doc_id", "text", "tag", "spans").mapInArrow(run, "doc_id long, tag long, gone long, left binary")
    cut = stored(cut.dropDuplicates(["doc_id", "tag"]), "cut")
    rows = judged.select("doc_id", "tag", "n_words", "digest", "keep_id")
    copy = (F.col("doc_id") > F.col("keep_id")) & (F.col("n_words") >= length)
    empty = F.unhex(F.lit(hashlib.sha256().hexdigest()))
    return rows.join(cut, ["doc_id", "tag"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, empty).otherwise(F.coalesce("left", "digest")))).alias("kept_sha256"),
    )
