"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded; learned filters slide over windows of WIDTH bytes
at every second byte. Windows are max-pooled in blocks, two neighbouring blocks
form a chunk, so chunks overlap by half and cover the whole text. A hidden layer
reads each chunk's pooled filters and its fill; the mean and the maximum of the
hidden values over all chunks are combined into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.shared import columns, doc_texts, map_rows, stored

WIDTH, STRIDE, BLOCK = 8, 2, 64
#: Bytes of texts that are laid out at a time, some 150 bytes of memory each; whole blocks.
PART = 2048 * STRIDE * BLOCK
THRESHOLD = 0.7


@dataclass(frozen=True)
class Training:
    """Bounds of the sample that the network is fitted on, and the fit's settings."""

    rows_per_class: int = 3000
    bytes: int = 16_000_000
    epochs: int = 6
    least_steps: int = 700
    batch: int = 24
    rate: float = 0.004
    filters: int = 32
    embed: int = 4
    hidden: int = 16
    seed: int = 42


def _layout(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Padded bytes of a batch, the windows past a text's end, blocks and chunks.

    At least WIDTH zero bytes follow each text, if need be in a block more that
    holds no window, so no window reads the next text.
    """
    span = STRIDE * BLOCK
    lengths = np.array([max(1, len(t)) for t in texts])
    windows = -(-lengths // STRIDE)
    blocks = -(-windows // BLOCK)
    laid = -(-(lengths + WIDTH) // span)
    data = b"".join(t.ljust(n * span, b"\0") for t, n in zip(texts, laid.tolist(), strict=True)) + bytes(WIDTH)
    first = np.cumsum(laid) - laid
    total = int(laid.sum())
    doc = np.repeat(np.arange(len(texts)), laid)
    filled = np.clip(windows[doc] - BLOCK * (np.arange(total) - first[doc]), 0, BLOCK)
    chunks = np.maximum(1, blocks - 1)
    chunk_doc = np.repeat(np.arange(len(texts)), chunks)
    left = first[chunk_doc] + np.arange(len(chunk_doc)) - (np.cumsum(chunks) - chunks)[chunk_doc]
    right = np.minimum(left + 1, (first + blocks - 1)[chunk_doc])
    fill = (filled[left] + np.where(right > left, filled[right], 0)) / (2 * BLOCK)
    return {"bytes": np.frombuffer(data, np.uint8), "filled": filled, "left": left, "right": right, "fill": fill.astype(np.float32), "doc": chunk_doc, "starts": np.cumsum(chunks) - chunks, "chunks": chunks}


class ByteNet:
    """Parameters, scores and gradients."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, t: Training) -> ByteNet:
        rng = np.random.default_rng(t.seed)
        normal = lambda *shape, by=1.0: (rng.normal(size=shape) * by).astype(np.float32)
        return cls({
            "embed": normal(256, t.embed), "filters": normal(WIDTH * t.embed, t.filters, by=(WIDTH * t.embed) ** -0.5), "shift": np.zeros(t.filters, np.float32),
            "hidden": normal(t.filters + 1, t.hidden, by=t.filters**-0.5), "bias": np.zeros(t.hidden, np.float32),
            "out": normal(2 * t.hidden, by=0.1), "prior": np.zeros(1, np.float32),
        })

    def _forward(self, texts: list[bytes], places: bool) -> dict[str, np.ndarray]:
        p, x = self.p, _layout(texts)
        cells = p["embed"][x["bytes"]]
        n, d = len(x["filled"]) * BLOCK, cells.shape[1]
        rows = np.lib.stride_tricks.as_strided(cells, (n, WIDTH * d), (STRIDE * cells.strides[0], cells.strides[1]))
        maps = (np.ascontiguousarray(rows) @ p["filters"]).reshape(-1, BLOCK, p["filters"].shape[1])
        for b in np.flatnonzero(x["filled"] < BLOCK):
            maps[b, x["filled"][b]:] = -1e9
        if places:
            x["at"] = maps.argmax(1)
        top = maps.max(1)
        pooled = np.maximum(top[x["left"]], top[x["right"]]) + p["shift"]
        if places:
            x["block"] = np.where(top[x["left"]] >= top[x["right"]], x["left"][:, None], x["right"][:, None])
        x["pooled"] = np.concatenate([np.maximum(pooled, 0), np.log(x["fill"])[:, None]], 1)
        x["act"] = np.maximum(x["pooled"] @ p["hidden"] + p["bias"], 0)
        mean = np.add.reduceat(x["act"], x["starts"], 0) / x["chunks"][:, None]
        x["high"] = np.maximum.reduceat(x["act"], x["starts"], 0)
        x["summary"] = np.concatenate([mean, x["high"]], 1)
        x["logit"] = x["summary"] @ p["out"] + p["prior"][0]
        return x

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; texts are laid out together up to PART bytes, a longer one is worked through in runs of blocks."""
        logits, group, size = np.zeros(len(texts)), [], 0
        for i, text in enumerate([*texts, None]):
            if group and (text is None or size + len(text) > PART):
                logits[group] = self._forward([texts[k] for k in group], False)["logit"]
                group, size = [], 0
            if text is not None and len(text) > PART:
                logits[i] = self._long(text)
            elif text is not None:
                group.append(i)
                size += len(text)
        return 1 / (1 + np.exp(-logits))

    def _long(self, text: bytes) -> float:
        """The logit of one text, holding a run of blocks and the sums and maxima of the chunks so far."""
        p, span, run = self.p, STRIDE * BLOCK, PART // (STRIDE * BLOCK)
        windows = -(-len(text) // STRIDE)
        blocks = -(-windows // BLOCK)
        total, high, last = np.zeros(p["bias"].shape[0]), None, None
        for at in range(0, blocks, run):
            n = min(run, blocks - at)
            data = text[at * span : (at + n) * span + WIDTH].ljust(n * span + WIDTH, b"\0")
            cells = p["embed"][np.frombuffer(data, np.uint8)]
            d = cells.shape[1]
            rows = np.lib.stride_tricks.as_strided(cells, (n * BLOCK, WIDTH * d), (STRIDE * cells.strides[0], cells.strides[1]))
            maps = (np.ascontiguousarray(rows) @ p["filters"]).reshape(n, BLOCK, -1)
            filled = np.clip(windows - BLOCK * (at + np.arange(n)), 0, BLOCK)
            for b in np.flatnonzero(filled < BLOCK):
                maps[b, filled[b]:] = -1e9
            top = maps.max(1)
            if last is not None:
                top, filled = np.concatenate([last[0], top]), np.concatenate([last[1], filled])
            last = top[-1:], filled[-1:]
            if len(top) < 2:
                continue
            fill = ((filled[:-1] + filled[1:]) / (2 * BLOCK)).astype(np.float32)
            pooled = np.maximum(np.maximum(top[:-1], top[1:]) + p["shift"], 0)
            act = np.maximum(np.concatenate([pooled, np.log(fill)[:, None]], 1) @ p["hidden"] + p["bias"], 0)
            total += act.sum(0, dtype=np.float64)
            high = act.max(0) if high is None else np.maximum(high, act.max(0))
        summary = np.concatenate([total / (blocks - 1), high])
        return float(summary @ p["out"] + p["prior"][0])

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, self._forward(texts, True)
        err = ((1 / (1 + np.exp(-x["logit"])) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": x["summary"].T @ err, "prior": err.sum(keepdims=True)}
        h = p["bias"].shape[0]
        doc, act = x["doc"], x["act"]
        of_doc = err[:, None] * p["out"][None, :]
        back = of_doc[doc, :h] / x["chunks"][doc, None] + of_doc[doc, h:] * (act == x["high"][doc])
        back *= act > 0
        g["hidden"], g["bias"] = x["pooled"].T @ back, back.sum(0)
        f = p["shift"].shape[0]
        back = (back @ p["hidden"].T)[:, :f] * (x["pooled"][:, :f] > 0)
        g["shift"] = back.sum(0)
        at = STRIDE * (x["block"] * BLOCK + x["at"][x["block"], np.arange(f)])
        seen = x["bytes"][at[:, :, None] + np.arange(WIDTH)]
        d = p["embed"].shape[1]
        g["filters"] = np.einsum("cf,cfk->kf", back, p["embed"][seen].reshape(*at.shape, -1), optimize=True)
        into = (back[:, :, None] * p["filters"].T[None]).reshape(-1, d)
        g["embed"] = np.stack([np.bincount(seen.ravel(), into[:, k], 256) for k in range(d)], 1).astype(np.float32)
        return g


def fit(texts: list[bytes], labels: list[int], t: Training) -> ByteNet:
    """Adam on the weighted log loss; classes weigh as much as the square root of their share."""
    net, rng = ByteNet.fresh(t), np.random.default_rng(t.seed)
    y = np.array(labels, np.float32)
    if not len(y):
        return net
    ones = max(1, int(y.sum()))
    zeros = max(1, len(y) - ones)
    weight = np.where(y > 0, (len(y) / ones) ** 0.5, (len(y) / zeros) ** 0.5).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    batches = -(-len(y) // t.batch)
    epochs = max(t.epochs, -(-t.least_steps // batches))
    steps, total = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), t.batch):
            pick = order[at : at + t.batch]
            steps += 1
            rate = t.rate * (1 - 0.95 * steps / total)
            for k, g in net.gradients([texts[i] for i in pick], y[pick], weight[pick]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.p[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    return net


def held_out(doc_id: F.Column = None) -> F.Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2. False without an id."""
    column = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of a bounded sample, in hash order of doc_id.

    At most rows_per_class ids of each class, and whole texts while their sum
    stays within half of the bytes for each class. Only these reach the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    known = stored(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"), "labelled")
    order = F.xxhash64("doc_id")
    first = [known.where(F.col("quality") == quality).orderBy(order, "doc_id").limit(t.rows_per_class) for quality in (0, 1)]
    ids = [tuple(r) for r in first[0].unionByName(first[1]).select("doc_id", "quality").collect()]  # 2 * rows_per_class at most
    if not ids:
        return [], []
    picked = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, quality int"))
    least = F.min(F.struct(F.octet_length("text").alias("size"), "text")).alias("t")  # of a repeated id one row
    found = stored(doc_texts(docs).join(picked, "doc_id").groupBy("doc_id", "quality").agg(least).select("doc_id", "quality", "t.*"), "labelled-texts")
    chosen: list[int] = []
    for quality in (0, 1):
        room = t.bytes // 2
        for row in found.where(F.col("quality") == quality).select("doc_id", "size").orderBy(order, "doc_id").collect():
            if row["size"] <= room:
                room -= row["size"]
                chosen.append(row["doc_id"])
    rows = found.where(F.col("doc_id").isin(chosen)).select("doc_id", "quality", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"].encode() for r in rows], [r["quality"] for r in rows]


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> ByteNet:
    return fit(*training_sample(docs, labels, t), t)


def score_documents(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, score of every whole text.

    Null counts as empty, and an empty text has a score. Without any usable
    label the network is its random start, whose scores are near one half.
    Repeated rows and rows without doc_id give one row each; other columns are
    ignored; an empty table gives no rows.
    """
    params = docs.sparkSession.sparkContext.broadcast(net.p)  # fixed size, under 100 KB

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = ByteNet(params.value).scores([t.encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()])
        return columns(doc_id=batch["doc_id"], score=pa.array(scores))

    return map_rows(doc_texts(docs), part, "doc_id long, score double")


def judged(docs: DataFrame, net: ByteNet, threshold: float = THRESHOLD) -> DataFrame:
    """Scores with the fold and the decision."""
    return score_documents(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: ByteNet, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, whose text is not rejected; no join, so repeated rows stay apart."""
    params = docs.sparkSession.sparkContext.broadcast(net.p)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        values = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        return pd.Series(ByteNet(params.value).scores(values), dtype="float64")

    return docs.where(score("text") >= threshold)
