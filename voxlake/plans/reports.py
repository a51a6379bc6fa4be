"""Evaluation, prediction and accessibility reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.operators import access, metrics, scoring, stats
from voxlake.operators.surface import exposed_points, residue_areas
from voxlake.runtime import cut_lineage
from voxlake.sources.sinks import augmented_columns, report_table, write_csv, write_predictions, write_report, write_report_tables
from voxlake.sources.structures import discover_structures, first_files, parse_atoms, structure_lines


def evaluate(samples: DataFrame, norm: DataFrame, scorer: Callable, task: str,
             classes: int | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Samples -> normalised -> scored -> one row of metrics."""
    scored = scoring.score_samples(stats.normalize(samples, norm, 1e-12), scorer, task)
    if task == "regression":
        rows = scored.select(F.col("label").cast("double").alias("label"), F.col("prediction").alias("predicted"))
    else:
        rows = scoring.with_predictions(scored, classes or 1)
    return metrics.evaluate(cut_lineage(rows), names, task, classes)


def predict(samples: DataFrame, norm: DataFrame, scorer: Callable, k: int = 5,
            embeddings: bool = False) -> DataFrame:
    """Prediction rows of normalised samples; ``sample_path`` names them."""
    scored = scoring.score_samples(stats.normalize(samples, norm, 1e-6), scorer, embeddings=embeddings)
    return scoring.prediction_rows(scoring.with_predictions(scored, k), F.col("sample_path"))


def prediction_reports(
    predictions: DataFrame, order: str, normalise: str = "row", bins: int = 10, max_confusions: int | None = 50,
    out: str | None = None, output_probs: bool = False,
) -> dict[str, DataFrame]:
    """Every table of the prediction report, each one aggregation.

    The predictions are written once, so a lazy input is not scored again for
    each table. ``max_confusions`` None lists every confusion. ``out`` names a
    folder for the predictions and every table as CSV.
    """
    if out is not None:
        predictions = cut_lineage(predictions)
        write_predictions(predictions, f"{out.rstrip('/')}/predictions", output_probs)
    labelled = cut_lineage(predictions.where("actual <> ''").withColumn(
        "correct", F.col("predicted") == F.col("actual")
    ))
    cells = metrics.confusion(labelled, K.REPORT_NAMES)
    kinds = metrics.confusion(labelled, K.TYPE_NAMES, "actual_type", "predicted_type")
    support = metrics.class_support(labelled)
    tables = {
        "confusion": metrics.normalize_confusion(cells, normalise),
        "type_confusion": metrics.normalize_confusion(kinds, normalise),
        "per_class": metrics.per_class_metrics(labelled),
        "confusions": metrics.common_confusions(labelled, order, max_confusions),
        "calibration": metrics.calibration_bins(labelled, bins),
        "confidence_histogram": metrics.confidence_histogram(labelled),
        "entropy_histogram": metrics.entropy_histogram(labelled),
        "entropy_summary": metrics.entropy_summary(labelled),
        "support": support,
        "support_range": metrics.support_range(support),
        "accuracy_by_type": metrics.accuracy_by_type(labelled),
        "type_accuracy": metrics.type_accuracy(labelled),
    }
    if out is not None:
        write_report_tables(tables, out)
    return tables


def annotate_sasa(
    predictions: DataFrame, manifest: DataFrame, scores: DataFrame, kind: str = "relative",
    field: str = "total", strict: bool = False, binning: str = "equal_width", bins: int = 10,
    custom: Sequence[float] | None = None, cache: DataFrame | None = None, structures: DataFrame | None = None,
    out: str | None = None,
) -> dict[str, DataFrame]:
    """Annotated predictions, bins, groups and the match summary.

    ``out`` names a folder for the augmented predictions, bins and groups as CSV
    and the summary as JSON.

    With a ``cache`` only the requested residues it lacks are taken from
    ``scores``; ``new_scores`` is what to append to the cache. With
    ``structures`` (structure_id) the summary counts those without a file.
    """
    matched = cut_lineage(access.match_predictions(predictions, manifest, strict))
    wanted = access.requested_residues(matched)
    if cache is not None:
        fresh = access.reduce_to_requested(scores, access.missing_from_cache(wanted, cache))
        known = access.reduce_to_requested(cache, wanted).unionByName(fresh)
    else:
        fresh = known = access.reduce_to_requested(scores, wanted)
    annotated = cut_lineage(access.annotate(matched, known, kind, field))
    usable = annotated.where("sasa_selected is not null and trim(actual) <> ''")
    edges = access.bin_edges(usable, "sasa_selected", binning, bins, custom)
    groups = access.correctness_groups(usable)
    tables = {
        "annotated": annotated, "new_scores": fresh, "edges": edges,
        "bins": access.binned_accuracy(usable, edges), "groups": access.group_summary(groups),
        "summary": access.match_summary(annotated, structures),
    }
    if out is not None:
        folder = out.rstrip("/")
        write_csv(report_table(augmented_columns(annotated, predictions.columns, access.ADDED)), f"{folder}/predictions")
        write_report_tables({name: tables[name] for name in ("bins", "groups")}, folder)
        write_report(tables["summary"], f"{folder}/summary")
    return tables


def annotate_sasa_files(
    predictions: DataFrame, manifest: DataFrame, folder: str, glob: str = "*.pdb", points: int = 92, **options: object,
) -> dict[str, DataFrame]:
    """``annotate_sasa`` from a structure folder: only requested structures are measured."""
    files = first_files(discover_structures(predictions.sparkSession, folder, glob))
    matched = access.match_predictions(predictions, manifest, bool(options.get("strict", False)))
    wanted = access.requested_residues(matched).select("structure_id").distinct()
    atoms = cut_lineage(parse_atoms(structure_lines(files.join(wanted, "structure_id", "left_semi"))))
    scores = residue_areas(exposed_points(atoms, ["structure_id", "line_no"], points)).withColumn("res_no", F.col("res_no").cast("string"))
    return annotate_sasa(predictions, manifest, cut_lineage(scores), structures=files.select("structure_id"), **options)
