"""Batch scoring with a user-supplied function, and prediction rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions import arrays as A
from voxlake.functions.columns import blank_to_null, file_stem
from voxlake.functions.residues import label_name, property_type


def score_samples(
    samples: DataFrame, scorer: Callable, task: str = "residue_identity",
    embeddings: bool = False, batch: int = 64,
) -> DataFrame:
    """Add ``logits`` (and ``embedding``) from ``scorer(block) -> matrix``.

    ``samples`` has ``x`` and ``shape``; equal shapes are batched together.
    With ``embeddings`` the scorer returns (logits, embeddings).
    """
    names = samples.columns
    at_x, at_shape = names.index("x"), names.index("shape")
    kept = [i for i, n in enumerate(names) if n not in ("x", "shape")]
    schema = samples.drop("x", "shape").schema.add("logits", T.ArrayType(T.FloatType()))
    if embeddings:
        schema = schema.add("embedding", T.ArrayType(T.FloatType()))

    def as_lists(matrix: np.ndarray) -> pa.Array:
        matrix = np.asarray(matrix, dtype=np.float32)
        matrix = matrix.reshape(len(matrix), -1)
        ends = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                shapes = part.column(at_shape).to_pylist()
                for shape in sorted({tuple(s) for s in shapes}):
                    rows = part.take(pa.array([i for i, s in enumerate(shapes) if tuple(s) == shape]))
                    flat = np.asarray(rows.column(at_x).flatten())
                    result = scorer(flat.reshape(rows.num_rows, *shape))
                    extra = list(result) if embeddings else [result]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(i) for i in kept] + [as_lists(m) for m in extra],
                        names=[names[i] for i in kept] + ["logits", "embedding"][: len(extra)],
                    )

    out = samples.mapInArrow(run, schema)
    if task == "regression":
        return out.withColumn("prediction", F.get("logits", F.lit(0)).cast("double"))
    return out


def with_predictions(scored: DataFrame, k: int = 5) -> DataFrame:
    """Add predicted, confidence, entropy and the top-k positions."""
    probs = scored.withColumn("probs", A.softmax(F.col("logits")))
    return probs.withColumns({
        "predicted": A.argmax(F.col("logits")),
        "top": A.top_indices(F.col("logits"), k),
        "confidence": F.array_max("probs"),
        "entropy": A.entropy(F.col("probs")),
    })


def format_site(path: Column) -> Column:
    """'chain:number:RES', else the example id, else part of the file name."""
    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))

    stem = file_stem(path)
    full = (text("chain_id") != "") & (text("res_no") != "") & (text("res_name") != "")
    tail = F.when(F.instr(stem, "__") > 0, F.regexp_replace(stem, "^.*?__", "")).otherwise(stem)
    return F.when(
        full, F.concat_ws(":", text("chain_id"), text("res_no"), F.upper(text("res_name")))
    ).otherwise(F.coalesce(F.nullif(text("example_id"), F.lit("")), tail))


def structure_name(path: Column) -> Column:
    stem = file_stem(path)
    parent = F.coalesce(F.element_at(F.split(F.concat(F.lit("/"), path), "/"), -2), F.lit(""))
    given = F.trim(F.coalesce(F.col("structure_id").cast("string"), F.lit("")))
    return F.coalesce(
        F.nullif(given, F.lit("")),
        F.when(F.instr(stem, "__") > 0, F.substring_index(stem, "__", 1)),
        blank_to_null(F.trim(parent)),
        stem,
    )


def prediction_rows(predicted: DataFrame, path: Column) -> DataFrame:
    """Report rows of predictions; ``label`` may be NULL."""
    actual = F.when(F.col("label").isNull(), "").otherwise(label_name(F.col("label")))
    return predicted.select(
        structure_name(path).alias("structure_name"),
        format_site(path).alias("site"),
        label_name(F.col("predicted")).alias("predicted"),
        actual.alias("actual"),
        property_type(label_name(F.col("predicted"))).alias("predicted_type"),
        F.when(actual == "", "Unknown").otherwise(property_type(actual)).alias("actual_type"),
        "entropy",
        F.col("predicted").alias("predicted_index"),
        F.col("label").alias("actual_index"),
        "confidence",
        F.transform("top", lambda i: F.struct(
            i.alias("idx"), label_name(i).alias("label"), F.get("probs", i).alias("prob")
        )).alias("topk"),
    )
