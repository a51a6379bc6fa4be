"""Two tokenizers over the same texts: groups of tokens, links between them, counts of id pairs.

Byte offsets where tokens of both sides end cut a text into groups. A byte range
of a text yields a fragment: an open prefix up to its first cut, closed groups
with their links, an open suffix behind its last cut. Fragments compose
associatively, so those of a very long text are made by many tasks and joined in
a tree; a short text is one range.

A pair's count is the number of documents that hold it linked. Documents stand in
blocks with a dictionary of the block's pairs; only dictionaries are exchanged to
count pairs, and each block gets the counts of its own pairs back.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.bpe import BYTES, UNUSUAL, bulk
from voxlake.llm.shared import columns, slices, stored
from voxlake.runtime import spread

#: Characters of a text that one task tokenizes at a time, and bytes of a fragment's range.
SEGMENT, RANGE = 1 << 16, 1 << 14
#: Fragments of 2 ** FAN neighbours are composed by one task at each level of the tree.
FAN = 3
#: Distinct pairs of a block's dictionary: indexes then take two bytes.
PAIRS = 1 << 16
#: Bytes of words remembered with their ids in a process.
KNOWN = 96 << 20
#: Words whose characters every library takes alike, without white space at their ends.
PLAIN = re.compile(f"(?=\\S){UNUSUAL.pattern.replace('[^', '[', 1)}*(?<=\\S)")

#: A space between two other characters: no token of either side reaches across it.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def _definitions(byte_level: str, pieces: str) -> tuple[str, str]:
    import public_tokenizers

    return tuple(x if os.path.isabs(x) else public_tokenizers.path(x) for x in (byte_level, pieces))


class Side:
    """One vocabulary: bytes, byte length and printed forms of each id."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.length = np.array([len(e) for e in entries], np.int64)
        self.inner = np.array([f"{i}," for i in range(len(entries))], object)

    def printed(self, mark: str) -> np.ndarray:
        return np.array([f"{i}{mark}" for i in range(len(self.entries))], object)


class Pair:
    """Both tokenizers. A word, with the space before it, has the same ids in every text."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        size = self.first.get_vocab_size()
        self.special = special = {t.content for t in self.first.get_added_tokens_decoder().values()}
        with open(byte_level, encoding="utf-8") as file:
            self.bulk = bulk(file.read())
        texts = [self.first.id_to_token(i) for i in range(size)]
        self.a = Side([b"" if t is None else t.encode() if t in special else bytes(map(BYTES.__getitem__, t)) for t in texts])
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        ids = range(self.second.get_piece_size())
        as_bytes = lambda i, p: bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
        texts = [self.second.id_to_piece(i) for i in ids]
        if any("▁" in p.lstrip("▁") for p in texts):
            raise ValueError("a piece reaches across a space: texts cannot be tokenized word by word")
        self.b = Side([as_bytes(i, p) for i, p in zip(ids, texts, strict=True)])
        self.a_end, self.b_end = self.a.printed("|"), self.b.printed(";")
        self.n_b = len(texts)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.held, self.bytes = [np.zeros(0, np.int64), np.zeros(0, np.int64)], 0
        self.starts, self.sound = [np.zeros(1, np.int64), np.zeros(1, np.int64)], np.zeros(0, bool)

    def learn(self, words: Iterable[str]) -> None:
        """Tokenize words not met before: plain ones in one run, as tokens end where words do, others one by one."""
        new = [w for w in dict.fromkeys(words) if w not in self.codes]
        if not new:
            return
        easy, hard = [], []
        for w in new:
            (easy if PLAIN.fullmatch(w) else hard).append(w)
        if any(s in w for s in self.special for w in easy if "<" in w):
            hard += [w for w in easy if any(s in w for s in self.special)]
            easy = [w for w in easy if not any(s in w for s in self.special)]
        parts = [self._run(easy)] if easy else []
        if parts == [None]:
            parts, hard, easy = [], [*easy, *hard], []
        if hard:
            parts.append(self._each(hard))
        (a, a_ends), (b, b_ends) = (_chained([x[k] for x in parts]) for k in (0, 1))
        sound = np.concatenate([x[2] for x in parts])
        self.codes.update(zip([*easy, *hard], range(len(self.codes), len(self.codes) + len(new)), strict=True))
        for k, (flat, ends) in enumerate(((a, a_ends), (b, b_ends))):
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + ends])
            self.held[k] = np.concatenate([self.held[k], flat])
        self.sound = np.concatenate([self.sound, sound])
        self.bytes += sum(map(len, new)) + 200 * len(new)

    def _run(self, words: list[str]) -> tuple | None:
        """Ids of both sides with each word's end; None if any token reaches across words."""
        spaced = " " + " ".join(words)
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)) + 1)
        a = self.bulk.ids[np.frombuffer(array("I", self.bulk.tiktoken.encode_ordinary(spaced)), np.uint32)].astype(np.int64)
        b = np.array(self.second.encode(spaced[1:]), np.int64)
        out = []
        for side, ids in ((self.a, a), (self.b, b)):
            stops = np.cumsum(side.length[ids])
            at = np.searchsorted(stops, ends)
            if len(stops) <= at[-1] or (stops[at] != ends).any() or b"".join([side.entries[i] for i in ids.tolist()]) != spaced.encode():
                return None
            out.append((ids, at + 1))
        return *out, np.ones(len(words), bool)

    def _each(self, words: list[str]) -> tuple:
        spaced = [" " + w for w in words]
        found = [[self.first.encode(s, add_special_tokens=False).ids for s in spaced], self.second.encode(words)]
        whole = [s.encode("utf-8", "surrogatepass") for s in spaced]
        joins = lambda side, ids: b"".join([side.entries[i] for i in ids])
        sound = [joins(self.a, x) == w and joins(self.b, y) == w for x, y, w in zip(*found, whole, strict=True)]
        flat = [(np.fromiter(chain.from_iterable(ids), np.int64), np.cumsum([len(x) for x in ids])) for ids in found]
        return *flat, np.array(sound, bool)

    def tokens(self, texts: list[list[str]]) -> list[Tokens]:
        """Of each text, given as words: ids of both sides and whether both join to the text."""
        if self.bytes > KNOWN:
            self.forget()
        self.learn(chain.from_iterable(texts))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(texts)), np.int64)
        bounds = np.cumsum([0, *map(len, texts)])
        sound = np.concatenate([[0], np.cumsum(~self.sound[codes])]) if len(codes) else np.zeros(1, np.int64)
        flat, at = [], []
        for held, starts in zip(self.held, self.starts, strict=True):
            lengths = starts[codes + 1] - starts[codes]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            flat.append(held[np.repeat(starts[codes] - ends[:-1], lengths) + np.arange(ends[-1])])
            at.append(ends[bounds])
        out = []
        for i in range(len(texts)):
            good = sound[bounds[i + 1]] == sound[bounds[i]]
            out.append(Tokens(*(flat[k][at[k][i] : at[k][i + 1]] if good else np.zeros(0, np.int64) for k in (0, 1)), bool(good)))
        return out


def _chained(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of ids one behind the other, with the ends of their words."""
    before = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([ends + n for (_, ends), n in zip(parts, before, strict=False)])


@dataclass
class Tokens:
    a: np.ndarray
    b: np.ndarray
    sound: bool = True


@functools.lru_cache(maxsize=2)
def pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


def union(*parts: np.ndarray) -> np.ndarray:
    """Distinct values in order; quick where the parts are sorted."""
    values = np.concatenate(parts)
    values.sort(kind="stable")
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def words_of(text: str) -> list[str]:
    return SAFE.split(text) if text else []


def linked(p: Pair, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs of tokens whose byte ranges overlap, and the byte where each overlap ends.

    Between two neighbouring ends of either side lies one token of each side, and
    each overlapping pair has one such stretch.
    """
    ends = union(a_ends, b_ends)
    return a[np.searchsorted(a_ends, ends)] * p.n_b + b[np.searchsorted(b_ends, ends)], ends


def print_groups(p: Pair, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> np.ndarray:
    """Printed tokens in order: each group's a, then its b; groups are numbered from 0 and end with a semicolon."""
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    out = np.empty(len(a) + len(b), object)
    last = lambda group: np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, bool)
    at = np.arange(len(a)) + np.searchsorted(b_group, np.arange(n))[a_group]
    out[at] = np.where(last(a_group), p.a_end[a], p.a.inner[a])
    at = np.arange(len(b)) + np.searchsorted(a_group, np.arange(n), "right")[b_group]
    out[at] = np.where(last(b_group), p.b_end[b], p.b.inner[b])
    return out


@dataclass
class Fragment:
    """A byte range of a text. Without a cut all its tokens are in the prefix."""

    pre_a: np.ndarray
    pre_b: np.ndarray
    cut: bool = False
    suf_a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    suf_b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n_groups: int = 0
    text: str = ""  # closed groups, each with a semicolon behind it
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n_a: int = 0
    n_b: int = 0


def fragment(p: Pair, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The tokens that end in a byte range, with their ends counted from one place."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(cuts):
        return Fragment(a, b, n_a=len(a), n_b=len(b))
    (a0, a1), (b0, b1) = ((int(np.searchsorted(e, cuts[0], "right")), int(np.searchsorted(e, cuts[-1], "right"))) for e in (a_ends, b_ends))
    inner = [x[lo:hi] for x, lo, hi in ((a, a0, a1), (b, b0, b1), (a_ends, a0, a1), (b_ends, b0, b1))]
    text = "".join(print_groups(p, *inner[:2], *(np.searchsorted(cuts[1:], e) for e in inner[2:])).tolist())
    return Fragment(a[:a0], b[:b0], True, a[a1:], b[b1:], len(cuts) - 1, text, linked(p, *inner)[0], len(a), len(b))


def closed(p: Pair, a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray]:
    """One group that begins and ends with cuts."""
    text = f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))};"
    return text, linked(p, a, b, np.cumsum(p.a.length[a]), np.cumsum(p.b.length[b]))[0]


def compose(p: Pair, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    join = lambda u, v: np.concatenate([u, v])
    n = {"n_a": x.n_a + y.n_a, "n_b": x.n_b + y.n_b}
    if not x.cut:
        return Fragment(join(x.pre_a, y.pre_a), join(x.pre_b, y.pre_b), y.cut, y.suf_a, y.suf_b, y.n_groups, y.text, y.pairs, **n)
    a, b = join(x.suf_a, y.pre_a), join(x.suf_b, y.pre_b)
    if not y.cut:
        return Fragment(x.pre_a, x.pre_b, True, a, b, x.n_groups, x.text, x.pairs, **n)
    text, pairs = closed(p, a, b)
    return Fragment(x.pre_a, x.pre_b, True, y.suf_a, y.suf_b, x.n_groups + 1 + y.n_groups, x.text + text + y.text, np.concatenate([x.pairs, pairs, y.pairs]), **n)


def folded(p: Pair, parts: list[Fragment]) -> Fragment:
    """Neighbours composed two by two, so that no text is copied more than log n times."""
    while len(parts) > 1:
        parts = [compose(p, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def whole(p: Pair, f: Fragment) -> tuple[str, int, np.ndarray]:
    """Groups printed, their number and all links of a whole text: its start and end are cuts."""
    if len(f.suf_a) or len(f.suf_b) or not f.cut:
        raise ValueError("not a whole text")
    text, pairs = closed(p, f.pre_a, f.pre_b)
    return (text + f.text)[:-1], 1 + f.n_groups, np.concatenate([pairs, f.pairs])


def ranges(p: Pair, t: Tokens) -> Iterator[Fragment]:
    """Fragments of RANGE bytes each; a token belongs to the range in which it ends."""
    ends = [np.cumsum(s.length[x]) for s, x in ((p.a, t.a), (p.b, t.b))]
    for at in range(0, int(ends[0][-1]) if len(ends[0]) else 0, RANGE):
        (a0, a1), (b0, b1) = ((int(np.searchsorted(e, at, "right")), int(np.searchsorted(e, at + RANGE, "right"))) for e in ends)
        yield fragment(p, t.a[a0:a1], t.b[b0:b1], ends[0][a0:a1], ends[1][b0:b1])


@dataclass
class Aligned:
    """Documents of a slice: per document counts and digest, and its distinct pairs."""

    doc_id: list
    counts: np.ndarray  # n_a, n_b, n_groups, n_links by document
    digest: list[str]
    bounds: np.ndarray  # of each document's distinct pairs
    pairs: np.ndarray
    times: np.ndarray


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def align(p: Pair, doc_ids: list, texts: list[str]) -> Aligned:
    """Short texts: each is one range that starts and ends with a cut, so a slice of them is one stream."""
    tokens = p.tokens([words_of(t) for t in texts])
    a, b = np.concatenate([t.a for t in tokens]), np.concatenate([t.b for t in tokens])
    a_at, b_at = np.cumsum([0, *(len(t.a) for t in tokens)]), np.cumsum([0, *(len(t.b) for t in tokens)])
    a_ends, b_ends = np.cumsum(p.a.length[a]), np.cumsum(p.b.length[b])
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    printed = print_groups(p, a, b, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends))
    stops = np.concatenate([[0], a_ends])[a_at]  # bytes before each document
    groups = np.diff(np.searchsorted(cuts, stops, "right"))
    pairs, ends = linked(p, a, b, a_ends, b_ends)
    doc = np.searchsorted(stops[1:], ends)
    space = len(p.a.entries) * p.n_b
    keys, times = np.unique(doc * space + pairs, return_counts=True)
    digest = [_sha("".join(printed[a_at[i] + b_at[i] : a_at[i + 1] + b_at[i + 1]].tolist())[:-1]) if a_at[i + 1] > a_at[i] else "" for i in range(len(texts))]
    counts = np.stack([np.diff(a_at), np.diff(b_at), groups, np.bincount(doc, minlength=len(texts))])
    return Aligned(doc_ids, counts, digest, np.searchsorted(keys // space, np.arange(len(texts) + 1)), keys % space, times)


_ROW = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, places binary, times binary, pairs array<bigint>, docs array<bigint>"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


class Blocks:
    """Slices of documents put together until their dictionary of pairs is full."""

    def __init__(self, prefix: int):
        self.next, self.held, self.known = prefix, [], np.zeros(0, np.int64)

    def add(self, part: Aligned) -> Iterator[pa.RecordBatch]:
        own = union(part.pairs)
        both = union(self.known, own)
        if self.held and len(both) > PAIRS:
            yield from self.close()
            both = own
        self.held.append(part)
        self.known = both

    def close(self) -> Iterator[pa.RecordBatch]:
        """The block's documents, and a row with its pairs and the number of its documents that hold each."""
        docs, kind = np.zeros(len(self.known), np.int64), np.uint16 if len(self.known) <= PAIRS else np.uint32
        for part in self.held:
            places = np.searchsorted(self.known, part.pairs)
            docs += np.bincount(places, minlength=len(docs))
            n, cut = len(part.doc_id), part.bounds
            packed, times = places.astype(kind), [part.times[cut[i] : cut[i + 1]] for i in range(n)]
            values = {
                "block": pa.array([self.next] * n, pa.int64()), "doc_id": pa.array(part.doc_id, pa.int64()),
                **{c: pa.array(x) for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), part.counts, strict=True)},
                "groups_sha256": pa.array(part.digest, pa.string()), "n_pairs": pa.array(np.diff(cut), pa.int32()),
                "places": pa.array([packed[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary()),
                "times": pa.array([t.astype(np.uint8 if not len(t) or t.max() < 256 else np.uint32).tobytes() for t in times], pa.binary()),
                "pairs": pa.nulls(n, pa.list_(pa.int64())), "docs": pa.nulls(n, pa.list_(pa.int64())),
            }
            yield columns(**{c: values[c] for c in _NAMES})
        if len(self.known):
            kinds = {"groups_sha256": pa.string(), "n_pairs": pa.int32(), "places": pa.binary(), "times": pa.binary()}
            values = {c: pa.nulls(1, kinds.get(c, pa.int64())) for c in _NAMES} | {"block": pa.array([self.next]), "pairs": pa.array([self.known]), "docs": pa.array([docs])}
            yield columns(**values)
        self.next, self.held, self.known = self.next + 2, [], np.zeros(0, np.int64)


def _block_rows(parts: Iterable[Aligned], odd: int) -> Iterator[pa.RecordBatch]:
    blocks = Blocks((TaskContext.get().partitionId() << 32) + odd)
    for part in parts:
        yield from blocks.add(part)
    yield from blocks.close()


def _short_rows(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(*paths)
        parts = (align(p, s["doc_id"].to_pylist(), s["text"].to_pylist()) for s in slices(batches, 128))
        yield from _block_rows(parts, 0)

    return docs.where(F.length("text") <= SEGMENT).mapInArrow(run, _ROW)


_FRAGMENT = (
    "row_id long, doc_id long, place long, sound boolean, n_a long, n_b long, n_groups long, cut boolean, text string, "
    "pairs array<bigint>, pre_a array<bigint>, pre_b array<bigint>, suf_a array<bigint>, suf_b array<bigint>"
)
_ARRAYS = ("pairs", "pre_a", "pre_b", "suf_a", "suf_b")


def _pack(rows: list[tuple[int, int | None, int, bool, Fragment]]) -> dict[str, pa.Array]:
    row_id, doc_id, place, sound, f = zip(*rows, strict=True) if rows else ([],) * 5
    lists = {c: pa.array([getattr(x, c) for x in f], pa.list_(pa.int64())) for c in _ARRAYS}
    return {
        "row_id": pa.array(row_id, pa.int64()), "doc_id": pa.array(doc_id, pa.int64()), "place": pa.array(place, pa.int64()), "sound": pa.array(sound, pa.bool_()),
        **{c: pa.array([getattr(x, c) for x in f], pa.int64()) for c in ("n_a", "n_b", "n_groups")},
        "cut": pa.array([x.cut for x in f], pa.bool_()), "text": pa.array([x.text for x in f], pa.string()), **lists,
    }


def _unpack(table: pa.Table) -> list[Fragment]:
    held = {c: [np.array(x, np.int64) for x in table[c].to_pylist()] for c in _ARRAYS}
    plain = {c: table[c].to_pylist() for c in ("cut", "n_groups", "text", "n_a", "n_b")}
    return [Fragment(**{c: v[i] for c, v in (held | plain).items()}) for i in range(table.num_rows)]


#: Fragments of one segment are numbered below this.
_PER_SEGMENT = 20


def _long_rows(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Texts of over SEGMENT characters: segments, fragments, then the tree."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for s in slices(batches, 1) for r in s.to_pylist()):
            at, n, text = 0, 0, row["text"]
            while at < len(text):
                stop = SAFE.search(text, at + SEGMENT)
                end = stop.start() if stop else len(text)
                yield columns(row_id=pa.array([row["row_id"]]), doc_id=pa.array([row["doc_id"]], pa.int64()), segment=pa.array([n]), text=pa.array([text[at:end]]))
                at, n = end + 1, n + 1  # the space belongs to both sides' first token behind it

    def fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(*paths)
        for row in (r for s in slices(batches, 1) for r in s.to_pylist()):
            t = p.tokens([words_of(row["text"])])[0]
            found = list(ranges(p, t)) or [Fragment(t.a, t.b)]
            yield columns(**_pack([(row["row_id"], row["doc_id"], (row["segment"] << _PER_SEGMENT) + i, t.sound, f) for i, f in enumerate(found)]))

    def composed(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        first = group.slice(0, 1).to_pylist()[0]
        sound = all(group["sound"].to_pylist())
        f = folded(pair(*paths), _unpack(group)) if sound else Fragment(*(np.zeros(0, np.int64),) * 2)
        return pa.table(_pack([(first["row_id"], first["doc_id"], first["place"], sound, f)]))

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(*paths)

        def parts() -> Iterator[Aligned]:
            for s in slices(batches, 1):
                f, row = _unpack(pa.Table.from_batches([s]))[0], s.select(["doc_id", "sound"]).to_pylist()[0]
                text, n, pairs = whole(p, f) if row["sound"] else ("", 0, np.zeros(0, np.int64))
                keys, times = np.unique(pairs, return_counts=True)
                counts = np.array([[f.n_a], [f.n_b], [n], [len(pairs)]], np.int64)
                yield Aligned([row["doc_id"]], counts, [_sha(text) if row["sound"] else ""], np.array([0, len(keys)]), keys, times)

        yield from _block_rows(parts(), 1)

    long = docs.where(F.length("text") > SEGMENT).withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "doc_id", "text")
    segments = stored(long.mapInArrow(cut, "row_id long, doc_id long, segment long, text string"), "segments")
    now = stored(spread(segments, "row_id", "segment").mapInArrow(fragments, _FRAGMENT), "fragments")
    most, shift = segments.agg(F.max("segment")).first()[0] or 0, 0
    while True:  # one round for each level of the tree
        key = F.shiftright("place", _PER_SEGMENT + shift).alias("key")
        now = stored(now.groupBy("row_id", key).applyInArrow(composed, _FRAGMENT), "composed")
        if not most >> shift:
            return now.mapInArrow(finished, _ROW)
        shift += FAN


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_documents(docs: DataFrame, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> tuple[DataFrame, DataFrame]:
    """(blocks of documents with their pairs, counts of pairs: pair, a, b, docs, best).

    best: no pair of the same a is in more documents. Both are written tables.
    Texts that are null, empty, or whose tokens do not join to a space and the
    text have no tokens. Texts are whole at any length; repeated rows and rows
    without doc_id are documents of their own; other columns are ignored; an
    empty table gives empty tables.
    """
    paths = _definitions(byte_level, pieces)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = stored(_short_rows(texts, paths).unionByName(_long_rows(texts, paths)), "aligned")
    held = rows.where(F.col("pairs").isNotNull()).select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counts = stored(held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("docs")), "pair-counts")
    n_b = pair(*paths).n_b
    counts = counts.withColumn("a", F.expr(f"pair div {n_b}")).withColumn("b", F.col("pair") % n_b)
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return rows, stored(counts.join(most, "a").select("pair", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-table")


def alignment(docs: DataFrame, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; cases as in aligned_documents."""
    rows, table = aligned_documents(docs, byte_level, pieces)
    own = rows.where(F.col("pairs").isNotNull()).select(F.col("block").alias("of"), F.explode("pairs").alias("own"))
    own = own.join(table, F.col("own") == F.col("pair")).select("of", "pair", F.col("docs").alias("held"), "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        docs_of, best_of = right["held"].to_numpy()[order], right["best"].to_numpy()[order].astype(bool)
        best, total = [], []
        for n, places, times in zip(left["n_pairs"].to_pylist(), left["places"].to_pylist(), left["times"].to_pylist(), strict=True):
            at, t = (np.frombuffer(x, f"<u{len(x) // n}") if n else np.zeros(0, np.int64) for x in (places, times))
            t = t.astype(np.int64)
            best.append(int(t[best_of[at]].sum()) if n else 0)
            total.append(int((t * docs_of[at]).sum()) if n else 0)
        kept = {c: left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table({**kept, "n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": left["groups_sha256"]})

    left = rows.where(F.col("pairs").isNull()).drop("pairs", "docs")
    return left.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(score, _RESULT)
