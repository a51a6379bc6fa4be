"""Order-preserving packing into windows by dynamic programming.

Documents in doc_id order form one token stream. Windows of at most WINDOW
tokens are cut at document ends, sentence ends or, inside long stretches without
either, at set distances. The cost of a plan is its padding plus a penalty for
each cut inside a document and a small one for each sequence. For a cut i

    cost(i) = penalty(i) + EACH + WINDOW - at(i) + min(cost(j) + at(j))

over the cuts j at most WINDOW before i: a sliding minimum, kept in a monotone
queue. Windows whose length is a power of two need no padding.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from voxlake.llm.bpe import codec, encoded
from voxlake.llm.shared import columns, doc_texts, shuffle_width, slices, tokenizer_json

WINDOW, END = 4096, 2
_END = np.array([END], "<u4")
#: Costs in tokens: each sequence, a cut at a sentence end, a cut elsewhere; distance of the latter; smallest power of two tried inside the stream.
EACH, SENTENCE, INSIDE, GAP, LEAST_POWER = 64, 12, 48, 96, 256
#: Tokens planned at a time; the open window is carried over.
BLOCK = 1 << 20
#: Candidates, arrays of ids and pieces that are Python objects at a time: a block may hold a million documents of one token.
STEP = 1 << 14


def sentence_ends(definition: str) -> np.ndarray:
    """By id: whether the token ends a word that consists of marks and has one of . ! ?"""
    c = codec(definition)
    suffix = c.bpe.suffix
    flags = np.zeros(len(c.by_id), bool)
    for token, text in enumerate(c.by_id):
        core = text[: -len(suffix)] if suffix and text.endswith(suffix) else text if not suffix else ""
        flags[token] = bool(core) and not any(x.isalnum() for x in core) and any(x in ".!?" for x in core)
    return flags


def plan(at: np.ndarray, penalty: np.ndarray, final: bool) -> list[int]:
    """Cut places of the cheapest plan. at: ascending candidates, at[0] = 0.

    final: the last candidate is the end of the stream, and a short last window
    may be split into powers of two; else the plan ends at the cheapest
    candidate of the last window, and the rest stays open.
    """
    n = len(at)
    cost, back = array("d", bytes(8 * n)), array("q", bytes(8 * n))
    queue: deque[tuple[float, int, int]] = deque()  # cost and place together, place, number
    powers = [1 << k for k in range(LEAST_POWER.bit_length() - 1, WINDOW.bit_length() - 1)]
    value, place, i = 0.0, 0, 0
    for low in range(1, n, STEP):
        block, hits = at[low : low + STEP], {}  # by number: candidates a power of two before
        for p in powers:
            before = np.searchsorted(at, block - p)
            found = np.flatnonzero(at[before] == block - p)
            for k, j in zip((found + low).tolist(), before[found].tolist(), strict=True):
                hits.setdefault(k, []).append(j)
        for here, extra in zip(block.tolist(), penalty[low : low + STEP].tolist(), strict=True):
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, place, i))
            while queue[0][1] < here - WINDOW:
                queue.popleft()
            best, _, j = queue[0]
            best += WINDOW - here
            i += 1
            for k in hits.get(i, ()):
                if cost[k] < best:
                    best, j = cost[k], k
            best += EACH + extra
            cost[i], back[i] = best, j
            value, place = best + here, here
    end, tail = n - 1, []
    last_place = int(at[-1])
    low = int(np.searchsorted(at, last_place - WINDOW))
    if final:
        def closing(j: int) -> tuple[float, float]:
            rest = last_place - int(at[j])
            return WINDOW - rest + EACH, rest.bit_count() * (EACH + INSIDE) - INSIDE

        last = min(range(low, n - 1), key=lambda j: cost[j] + min(closing(j)))
        rest = last_place - int(at[last])
        if closing(last)[1] < closing(last)[0]:
            spot = int(at[last])
            for k in range(WINDOW.bit_length() - 1, -1, -1):
                if rest >> k & 1:
                    spot += 1 << k
                    tail.append(spot)
        else:
            tail.append(last_place)
        end = last
    else:
        end = min(range(max(1, low), n), key=lambda j: (cost[j], -j))
    cuts = []
    while end:
        cuts.append(int(at[end]))
        end = back[end]
    return cuts[::-1] + tail


class Stream:
    """Documents of one partition in order; plans and emits whole windows."""

    def __init__(self, definition: str, first_sequence: int):
        self.flags = sentence_ends(definition)
        self.sequence = first_sequence
        self.ids = np.zeros(0, "<u4")  # not yet packed
        self.doc_ids: list[int | None] = []
        self.begins, self.sizes = array("q"), array("q")  # within ids (may be negative), tokens
        self.parts: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.begins.append(len(self.ids) + self.n_waiting)
        self.sizes.append(len(ids) + 1)
        self.waiting += [ids, _END]
        self.n_waiting += len(ids) + 1
        if len(self.waiting) >= STEP:
            self.parts.append(np.concatenate(self.waiting))
            self.waiting = []

    def flush(self, final: bool) -> Iterator[tuple]:
        """Pieces of all windows that are closed now; to be read to the end before more is added."""
        self.ids = np.concatenate([self.ids, *self.parts, *self.waiting])
        self.parts, self.waiting, self.n_waiting = [], [], 0
        if not len(self.ids):
            return
        begins, sizes = np.array(self.begins), np.array(self.sizes)
        ends = begins + sizes
        cuts = plan(*self._candidates(ends), final)
        d, start = 0, 0
        data = memoryview(self.ids.tobytes())
        end = self.begins[0] + self.sizes[0]
        for cut in cuts:
            offset = 0
            while start < cut:
                while end <= start:
                    d += 1
                    end = self.begins[d] + self.sizes[d]
                begin, stop = self.begins[d], min(cut, end)
                yield self.doc_ids[d], start - begin, stop - start, zlib.crc32(data[4 * start : 4 * stop]), self.sizes[d], self.sequence, offset
                offset += stop - start
                start = stop
            self.sequence += 1
        self.ids = self.ids[start:]
        done = int(np.searchsorted(ends, start, "right"))
        del self.doc_ids[:done], self.sizes[:done]
        self.begins = array("q", (begins[done:] - start).tobytes())

    def _candidates(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sentences = np.flatnonzero(self.flags[np.minimum(self.ids, len(self.flags) - 1)]) + 1
        natural = np.union1d(sentences, ends)
        before = np.concatenate([[0], natural[:-1]])
        wide = np.flatnonzero(natural - before > GAP)
        inner = [np.arange(before[i] + GAP, natural[i], GAP) for i in wide]
        at = np.union1d(natural, np.concatenate(inner)) if inner else natural
        penalty = np.full(len(at), INSIDE, np.float64)
        penalty[np.searchsorted(at, sentences)] = SENTENCE
        penalty[np.searchsorted(at, ends)] = 0
        return np.concatenate([[0], at]).astype(np.int64), np.concatenate([[0], penalty])


_PIECES = (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Documents are range-partitioned by doc_id; each partition is one stream with
    sequence ids of its own range. A null or empty text is the end id alone.
    Rows without doc_id come first; repeated rows are packed as often as they
    stand. Other columns are ignored; an empty table gives no rows. Longer
    documents than a window are cut into several pieces.
    """
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(definition.value, TaskContext.get().partitionId() << 40)

        def closed(final: bool) -> Iterator[pa.RecordBatch]:
            for pieces in batched(stream.flush(final), STEP):
                values = zip(*pieces, strict=True)
                yield columns(**{name: pa.array(v, kind) for (name, kind), v in zip(_PIECES, values, strict=True)})

        for part in slices(batches, 64):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                stream.add(doc_id, encoded(definition.value, text))
                if stream.n_waiting >= BLOCK:
                    yield from closed(False)
        yield from closed(True)

    rows = doc_texts(docs).repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
