"""Files of token ids: frequency ranks in byte-aligned variable-length codes.

A file holds the ids of consecutive documents. Its ids are ranked by their
frequency in it; a rank takes one to four bytes. The lengths stand apart, two
bits each, four to a control byte, so that a table over the 256 control bytes
and one running sum give every code's place, and numpy decodes without a loop.

Layout (little-endian): magic, counts (documents, tokens, distinct ids, data
bytes), first token of the partition's stream, doc ids (int64), null flags
(bytes), tokens per document (int64), ids by rank (uint32), control bytes, data.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.bpe import encoded
from voxlake.llm.shared import columns, doc_texts, shuffle_width, slices, stored, tokenizer_json
from voxlake.runtime import fresh_dir

MAGIC, HEADER, END = b"VXIDS001", struct.Struct("<8s5Q"), 2
#: Tokens after which a file is closed at the next document end.
FILE_TOKENS = 4_000_000
#: By control byte: the lengths of its four codes.
LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)


def encode_codes(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of unsigned 32-bit values."""
    v = values.astype("<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[: len(v)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode_codes(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values again."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for i in range(1, 4):
        more = lengths > i
        if not more.any():
            break
        out[more] |= padded[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


@dataclass
class IdFile:
    """One file's content."""

    start: int
    doc_ids: list
    counts: np.ndarray
    ids: np.ndarray

    def to_bytes(self) -> bytes:
        frequency = np.bincount(self.ids)
        by_rank = np.argsort(-frequency, kind="stable")[: np.count_nonzero(frequency)]
        rank = np.zeros(len(frequency), np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        control, data = encode_codes(rank[self.ids])
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        head = HEADER.pack(MAGIC, len(self.doc_ids), len(self.ids), len(by_rank), len(data), self.start)
        return b"".join([head, np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), known.tobytes(), self.counts.astype("<i8").tobytes(), by_rank.astype("<u4").tobytes(), control, data])

    @classmethod
    def from_bytes(cls, content: bytes) -> IdFile:
        magic, docs, tokens, distinct, size, start = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        doc_ids, known, counts, by_rank = take("<i8", docs), take("u1", docs), take("<i8", docs), take("<u4", distinct)
        control = take("u1", -(-tokens // 4))
        ranks = decode_codes(control, take("u1", size), tokens)
        return cls(start, [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist(), strict=True)], counts, by_rank[ranks])


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def write_ids(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the stored list of files.

    folder: a folder that all executors share. Columns: partition, number, path,
    docs, tokens. A file gets a name of its own in each attempt and its final
    place only when it is whole; the list has those of the attempts that
    counted, so lost executors and repeated tasks do no harm. A null or empty
    text is the end id alone; rows without doc_id come first; repeated rows are
    written as often as they stand; other columns are ignored.
    """
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        system, root = _file_system(folder)
        end = np.array([END], "<u4")
        doc_ids, blobs, size, start, number = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, blobs, size, start, number
            counts = np.array([len(b) + 1 for b in blobs[::2]], np.int64)
            content = IdFile(start, doc_ids, counts, np.concatenate(blobs)).to_bytes()
            name = f"{root}/part-{partition:06d}-{number:04d}-{uuid.uuid4().hex}.ids"
            system.create_dir(root, recursive=True)
            with system.open_output_stream(name + ".open") as out:
                out.write(content)
            system.move(name + ".open", name)
            row = columns(partition=pa.array([partition], pa.int32()), number=pa.array([number], pa.int32()), path=pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), docs=pa.array([len(doc_ids)], pa.int64()), tokens=pa.array([size], pa.int64()))
            start, number, doc_ids, blobs, size = start + size, number + 1, [], [], 0
            return row

        for part in slices(batches, 64):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = encoded(definition.value, text)
                doc_ids.append(doc_id)
                blobs += [ids, end]
                size += len(ids) + 1
                if size >= file_tokens:
                    yield close()
        if doc_ids:
            yield close()

    rows = doc_texts(docs).repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(run, "partition int, number int, path string, docs long, tokens long"), "id-files")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, ids of every document, read from the listed files.

    start counts the ids of all documents before it. Only one total for each
    partition of the write reaches the driver.
    """
    return _from_files(files, "doc_id long, start long, ids array<int>", lambda ids: {"ids": pa.array(ids, pa.list_(pa.int32()))})


def id_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the listed files."""
    return _from_files(files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())})


def _from_files(files: DataFrame, schema: str, make) -> DataFrame:
    totals = dict(files.groupBy("partition").agg(F.sum("tokens").alias("n")).collect())
    before, running = {}, 0
    for partition in sorted(totals):
        before[partition], running = running, running + totals[partition]
    first = files.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for partition, path in zip(part["partition"].to_pylist(), part["path"].to_pylist(), strict=True):
                system, place = _file_system(path)
                with system.open_input_stream(place) as source:
                    file = IdFile.from_bytes(source.read())
                ends = np.cumsum(file.counts)
                for at in range(0, len(ends), 2048):
                    some = slice(at, at + 2048)
                    begins = ends[some] - file.counts[some]
                    ids = [file.ids[b:e] for b, e in zip(begins.tolist(), ends[some].tolist(), strict=True)]
                    yield columns(doc_id=pa.array(file.doc_ids[some], pa.int64()), start=pa.array(begins + file.start + first.value[partition]), **make(ids))

    return files.select("partition", "path").repartition(shuffle_width(files.sparkSession)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write all documents to a new shared folder and return what the files say of each."""
    return id_digests(write_ids(docs, fresh_dir(docs.sparkSession, "ids"), tokenizer))
