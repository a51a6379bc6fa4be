"""Solvent accessibility: matching, annotation, bins and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.columns import edge_bin
from voxlake.functions.residues import three_letter
from voxlake.operators.ranking import exact_quantiles
from voxlake.operators.skew import lookup_join

SASA_KEY = ["structure_id", "chain_id", "res_no", "res_name"]
# Names of the ten measures, kind then field.
MEASURES = {
    ("absolute", "total"): "abs_total", ("absolute", "sidechain"): "abs_sidechain",
    ("absolute", "mainchain"): "abs_mainchain", ("absolute", "polar"): "abs_polar",
    ("absolute", "apolar"): "abs_apolar", ("relative", "total"): "rel_total",
    ("relative", "sidechain"): "rel_sidechain", ("relative", "mainchain"): "rel_mainchain",
    ("relative", "polar"): "rel_polar", ("relative", "apolar"): "rel_apolar",
}
ADDED = ["chain_id", "res_no", "res_name", "sasa_abs_total", "sasa_rel_total",
         "sasa_selected", "sasa_kind", "sasa_field"]


def parse_site(site: Column) -> Column:
    """(chain_id, res_no, res_name) of 'a:b:c'; anything else gives NULL."""
    parts = F.split(F.coalesce(site, F.lit("")), ":")
    names = ["chain_id", "res_no", "res_name"]
    return F.when(F.size(parts) == 3, F.struct(
        *[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)]
    ))


def topk_labels(text: Column) -> Column:
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\\|"), lambda t: F.trim(t) != "")
    return F.transform(kept, lambda t: three_letter(t, "title"))


def measure(kind: str, field: str) -> str:
    return MEASURES[(kind, field)]


def match_predictions(
    predictions: DataFrame, manifest: DataFrame, strict: bool = False, order: str = "row_no"
) -> DataFrame:
    """Add status, warning and the matched manifest residue to predictions.

    The manifest is reduced to one row per key before each join: the last
    exact duplicate wins, and the fallback knows how many candidates share the
    three-part key. A prediction therefore never multiplies. Predictions of one
    residue, or with an unreadable site, are dealt over tasks.
    """
    def text(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))

    rows = manifest.select(
        F.col(order).alias("_o"), text("structure_id").alias("_s"), text("chain_id").alias("_c"),
        text("res_no").alias("_n"), three_letter(F.col("res_name")).alias("_r"),
    )
    exact = rows.groupBy("_s", "_c", "_n", "_r").agg(F.max("_o").alias("_exact"))
    loose = rows.groupBy("_s", "_c", "_n").agg(
        F.count("*").alias("_candidates"), F.first("_r").alias("_only")
    )
    site = parse_site(F.col("site"))
    keyed = predictions.withColumn("_site", site).withColumns({
        "_s": text("structure_name"), "_c": F.col("_site.chain_id"), "_n": F.col("_site.res_no"),
        "_r": F.when(F.col("_site").isNotNull(), three_letter(F.col("_site.res_name"))),
    })
    # the finer key is never heavier than the coarser one, whose counts say which to deal out
    full = lookup_join(keyed, exact, ["_s", "_c", "_n", "_r"], "left")
    joined = lookup_join(full, loose, ["_s", "_c", "_n"], "left", deal=keyed.columns, counts=keyed.groupBy("_s", "_c", "_n").agg(F.count("*").alias("n")))
    is_exact = F.col("_exact").isNotNull()
    alone = F.coalesce(F.col("_candidates") == 1, F.lit(False))
    status = (
        F.when(F.col("_site").isNull(), "invalid_site")
        .when(is_exact, "exact")
        .when(F.lit(strict), "strict_failed")
        .when(alone, "fallback")
        .when(F.col("_candidates") > 1, "ambiguous")
        .otherwise("no_match")
    )
    matched = F.col("status").isin("exact", "fallback")
    out = joined.withColumn("status", status).withColumns({
        "warning": (F.col("status") == "fallback") & (F.col("_only") != F.col("_r")),
        "chain_id": F.col("_c"), "res_no": F.col("_n"),
        "res_name": F.when(F.col("status") == "fallback", F.col("_only")).otherwise(F.col("_r")),
        "matched": matched,
    })
    return out.drop("_site", "_s", "_c", "_n", "_r", "_exact", "_candidates", "_only")


def requested_residues(matched: DataFrame) -> DataFrame:
    """Distinct residues that need a value."""
    return matched.where("matched").select(
        F.trim("structure_name").alias("structure_id"), "chain_id", "res_no", "res_name"
    ).distinct()


#: Buckets of a score cache unless told otherwise.
BUCKETS = 64


def write_cache(scores: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Scores as a table in buckets of their residue key, sorted inside; returns the table."""
    scores.write.mode("overwrite").option("path", path).bucketBy(buckets, *SASA_KEY).sortBy(*SASA_KEY).saveAsTable(name)
    return scores.sparkSession.table(name)


def missing_from_cache(requested: DataFrame, cache: DataFrame, buckets: int | None = None) -> DataFrame:
    """Requested residues that the cache lacks.

    With ``buckets``, the number of a bucketed cache, the requested residues are
    dealt into the same buckets and the cache is joined where it lies: of its
    files only key columns are read and nothing of it is exchanged.
    """
    if buckets is not None:
        requested = requested.repartition(buckets, *SASA_KEY)
        return requested.join(cache.select(*SASA_KEY).hint("merge"), SASA_KEY, "left_anti")
    return requested.join(cache.select(*SASA_KEY), SASA_KEY, "left_anti")


def reduce_to_requested(scores: DataFrame, requested: DataFrame) -> DataFrame:
    return scores.join(requested, SASA_KEY, "left_semi")


def annotate(matched: DataFrame, scores: DataFrame, kind: str, field: str) -> DataFrame:
    """Add the accessibility columns to matched predictions."""
    values = F.struct(F.col("abs_total").alias("a"), F.col("rel_total").alias("r"), F.col(measure(kind, field)).alias("m"))
    one = scores.groupBy(*SASA_KEY).agg(F.max(values).alias("_v")).select(  # of repeated scores the largest
        F.col("structure_id").alias("_s"), "chain_id", "res_no", "res_name",
        F.col("_v.a").alias("sasa_abs_total"), F.col("_v.r").alias("sasa_rel_total"), F.col("_v.m").alias("sasa_selected"))
    keyed = matched.withColumn("_s", F.when(F.col("matched"), F.trim("structure_name")))
    joined = keyed.join(one, ["_s", "chain_id", "res_no", "res_name"], "left").drop("_s")
    return joined.withColumns({"sasa_kind": F.lit(kind), "sasa_field": F.lit(field)})


def match_summary(annotated: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """One row of match and score counters."""
    counts = annotated.agg(
        F.count("*").alias("total_prediction_rows"),
        F.count_if("matched").alias("matched_residues"),
        F.count_if(~F.col("matched")).alias("unmatched_residues"),
        F.count("sasa_selected").alias("residues_scored"),
        F.count_if("warning").alias("fallback_warnings"),
    )
    lacking = requested_residues(
        annotated.where("matched and sasa_selected is null")
    ).agg(F.count("*").alias("missing_residues_reported"))
    out = counts.crossJoin(F.broadcast(lacking))  # one row each
    if structures is None:
        return out
    absent = (
        annotated.where("matched").select(F.trim("structure_name").alias("structure_id")).distinct()
        .join(structures.select("structure_id"), "structure_id", "left_anti")
        .agg(F.count("*").alias("missing_pdb_files"))
    )
    return out.crossJoin(F.broadcast(absent))  # one row each


def _nudged(low: Column, high: Column) -> Column:
    eps = F.when(low == 0, F.lit(1e-6)).otherwise(F.abs(low) * 1e-6)
    return F.array(low - eps, high + eps)


def bin_edges(
    df: DataFrame, value: str, mode: str, bins: int = 10, custom: Sequence[float] | None = None
) -> DataFrame:
    """One row with the array ``edges``."""
    if mode == "custom":
        if custom is None or len(custom) < 2 or any(b <= a for a, b in zip(custom, custom[1:])):
            raise ValueError("custom edges must be at least two strictly increasing numbers")
        return df.sparkSession.createDataFrame([(list(map(float, custom)),)], "edges array<double>")
    if bins < 1:
        raise ValueError("the number of bins must be positive")
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    close = F.abs(hi - lo) <= F.lit(1e-9) * F.greatest(F.abs(lo), F.abs(hi))
    if mode == "equal_width":
        span = df.where(F.col(value).isNotNull()).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        step = (hi - lo) / F.lit(float(bins))
        even = F.concat(
            F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: lo + i * step), F.array(hi)
        )
    elif mode == "equal_frequency":
        qs = [i * (1.0 / bins) for i in range(bins)] + [1.0]
        cuts = exact_quantiles(df, [], value, qs).agg(
            F.array_sort(F.collect_set("quantile")).alias("cuts")  # bins + 1 numbers
        )
        span = cuts.select("cuts", F.array_min("cuts").alias("lo"), F.array_max("cuts").alias("hi"))
        even = F.when(F.size("cuts") < 2, _nudged(lo, hi)).otherwise(F.col("cuts"))
    else:
        raise ValueError(f"unknown binning mode {mode!r}")
    span = span.where("lo is not null")
    return span.select(F.when(close, _nudged(lo, hi)).otherwise(even).alias("edges"))


def binned_accuracy(df: DataFrame, edges: DataFrame, value: str = "sasa_selected") -> DataFrame:
    """Top-1/3/5 accuracy per bin; empty bins are rows with NULL accuracy.

    ``df`` has actual, predicted and topk (array of names). Values above the
    last edge fall into the last bin, values below the first are left out.
    """
    actual = three_letter(F.col("actual"), "title")
    rows = df.where(F.col(value).isNotNull() & (actual != ""))
    last = F.size("edges") - 2
    # one row of bins + 1 numbers
    placed = rows.crossJoin(F.broadcast(edges)).select(
        F.least(edge_bin(F.col(value), F.col("edges")) - 1, last).alias("bin_index"),
        (three_letter(F.col("predicted"), "title") == actual).cast("int").alias("top1"),
        *[F.array_contains(F.slice("topk", 1, k), actual).cast("int").alias(f"top{k}") for k in (3, 5)],
    ).where("bin_index >= 0")
    counts = placed.groupBy("bin_index").agg(
        F.count("*").alias("support"),
        *[F.avg(f"top{k}").alias(f"top{k}_accuracy") for k in (1, 3, 5)],
    )
    frame = edges.select(F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("bin_index", "bin_left"), "edges")
    frame = frame.select(
        "bin_index", "bin_left", F.get("edges", F.col("bin_index") + 1).alias("bin_right")
    )
    return frame.join(counts, "bin_index", "left").na.fill(0, ["support"])


def correctness_groups(df: DataFrame, value: str = "sasa_selected") -> DataFrame:
    """Each row three times, once per k: (grp, value)."""
    actual = three_letter(F.col("actual"), "title")
    rows = df.where(F.col(value).isNotNull() & (actual != ""))
    flags = {
        "Top1": three_letter(F.col("predicted"), "title") == actual,
        "Top3": F.array_contains(F.slice("topk", 1, 3), actual),
        "Top5": F.array_contains(F.slice("topk", 1, 5), actual),
    }
    names = F.array(*[
        F.concat(F.lit(f"{n} "), F.when(f, "Correct").otherwise("Incorrect")) for n, f in flags.items()
    ])
    return rows.select(F.explode(names).alias("grp"), F.col(value).cast("double").alias("value"))


def group_summary(groups: DataFrame) -> DataFrame:
    """Box-plot numbers per group: n, mean, min, quartiles, max."""
    q = exact_quantiles(groups, ["grp"], "value", [0.25, 0.5, 0.75])
    wide = q.groupBy("grp").agg(*[
        F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n)
        for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    ])
    base = groups.groupBy("grp").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )
    return base.join(wide, "grp")
