"""Classification, calibration and regression metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.functions.columns import edge_bin
from voxlake.functions.residues import canonical_name, residue_group
from voxlake.operators.ranking import exact_quantiles, running_totals


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0)))


def _share(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("int")), F.lit(0.0))


def _keep(names: Sequence, column: str) -> Column:
    return F.col(column).isin(list(names))


def accuracy(df: DataFrame, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.agg(_share(F.col(actual) == F.col(predicted)).alias("accuracy"))


def topk_accuracy(df: DataFrame, ks: Sequence[int], classes: int) -> DataFrame:
    """One column per k; unlabelled rows do not count, none gives 0."""
    return df.where("label is not null").agg(*[
        F.coalesce(F.avg(F.array_contains(
            F.slice("top", 1, max(1, min(k, classes))), F.col("label").cast("int")
        ).cast("int")), F.lit(0.0)).alias(f"top{k}")
        for k in ks
    ])


def confusion(
    df: DataFrame, names: Sequence, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """(actual, predicted, n) for the whole square of classes."""
    spark = df.sparkSession
    kind = "int" if isinstance(names[0], int) else "string"
    square = spark.createDataFrame(
        [(a, p) for a in names for p in names], f"actual {kind}, predicted {kind}"
    )
    counts = (
        df.where(_keep(names, actual) & _keep(names, predicted))
        .groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
        .agg(F.count("*").alias("n"))
    )
    return square.join(counts, ["actual", "predicted"], "left").na.fill(0, ["n"])


def normalize_confusion(cells: DataFrame, mode: str) -> DataFrame:
    """Share of each cell; the table is classes squared, so windows are tiny."""
    over = {
        "row": Window.partitionBy("actual"), "column": Window.partitionBy("predicted"),
        "all": Window.partitionBy(F.lit(0)),
    }
    if mode == "none":
        return cells.withColumn("share", F.col("n").cast("double"))
    if mode not in over:
        raise ValueError(f"unknown normalisation {mode!r}")
    return cells.withColumn("share", _ratio(F.col("n"), F.sum("n").over(over[mode])))


def balanced_accuracy(cells: DataFrame) -> DataFrame:
    """Mean recall over all classes; one without rows counts 0."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    recalls = cells.groupBy("actual").agg(_ratio(hit, F.sum("n")).alias("recall"))
    return recalls.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("balanced_accuracy"))


def group_accuracy(df: DataFrame, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    """Agreement of residue groups among rows where both labels have one."""
    a, p = residue_group(F.col(actual)), residue_group(F.col(predicted))
    return df.where(a.isNotNull() & p.isNotNull()).agg(_share(a == p).alias("residue_group_accuracy"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    error = F.col(predicted) - F.col(actual)
    return df.agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def _class_scores(df: DataFrame, classes: int) -> DataFrame:
    """Rows and positives per (class, distinct score)."""
    if classes == 2:
        long = df.select(F.lit(1).alias("cls"), F.get("probs", F.lit(1)).alias("score"), "label")
    else:
        long = df.select(F.posexplode("probs").alias("cls", "score"), "label")
    return long.groupBy("cls", "score").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == F.col("cls")).alias("pos")
    )


def auroc_per_class(df: DataFrame, classes: int) -> DataFrame:
    """(cls, auroc) by rank sums; tied scores share their mean rank."""
    ranked = running_totals(_class_scores(df, classes), ["cls"], "score", ["n"])
    mean_rank = F.col("cum_n") - (F.col("n") - 1) / 2.0
    sums = ranked.groupBy("cls").agg(
        F.sum(F.col("pos") * mean_rank).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n")
    )
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    value = (F.col("ranks") - p * (p + 1) / 2.0) / F.nullif(p * q, F.lit(0.0))
    return sums.select("cls", value.alias("auroc"))


def average_precision_per_class(df: DataFrame, classes: int) -> DataFrame:
    """(cls, prauc): precision weighted by the recall steps, ties at once."""
    ranked = running_totals(_class_scores(df, classes), ["cls"], "score", ["n", "pos"], descending=True)
    return ranked.groupBy("cls").agg(
        F.coalesce(
            F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.nullif(F.sum("pos"), F.lit(0)),
            F.lit(0.0),
        ).alias("prauc")
    )


def auroc(df: DataFrame, classes: int) -> DataFrame:
    """Macro mean; NULL when a class has no positives or no negatives."""
    per = auroc_per_class(df, classes)
    whole = F.count("auroc") == F.count("*")
    return per.agg(F.when(whole, F.avg("auroc")).alias("auroc"))


def prauc(df: DataFrame, classes: int) -> DataFrame:
    return average_precision_per_class(df, classes).agg(F.avg("prauc").alias("prauc"))


def evaluate(
    df: DataFrame, metrics: Sequence[str] | None, task: str, classes: int | None = None,
) -> DataFrame:
    """One row with the requested metrics (confusion as an array of rows)."""
    if metrics is None:
        metrics = (["mse", "mae", "rmse"] if task == "regression"
                   else ["accuracy", "balanced_accuracy", "top5", "confusion"])
    wanted = [m.strip().lower() for m in metrics if m.strip()]
    parts = [df.agg(F.lit(task).alias("task"), F.count("*").alias("num_examples"))]
    errors = [m for m in wanted if m in ("mae", "mse", "rmse")]
    if errors:
        parts.append(regression_metrics(df, "label", "predicted").select(*errors))
    for m in wanted:
        if m in errors:
            continue
        known = m in ("accuracy", "balanced_accuracy", "confusion", "auroc", "prauc",
                      "residue_group_accuracy") or (m.startswith("top") and m[3:].isdigit())
        if not known:
            raise ValueError(f"unsupported metric {m!r}")
        if task == "regression":
            raise ValueError(f"metric {m!r} is for classification tasks only")
        if classes is None and m not in ("accuracy", "residue_group_accuracy"):
            raise ValueError(f"metric {m!r} needs the number of classes")
        if m == "accuracy":
            parts.append(accuracy(df))
        elif m == "residue_group_accuracy":
            parts.append(group_accuracy(df))
        elif m.startswith("top"):
            parts.append(topk_accuracy(df, [int(m[3:])], classes))
        elif m == "auroc":
            parts.append(auroc(df, classes))
        elif m == "prauc":
            parts.append(prauc(df, classes))
        else:
            cells = confusion(df, list(range(classes)), "label", "predicted")
            if m == "balanced_accuracy":
                parts.append(balanced_accuracy(cells))
            else:
                parts.append(cells.agg(F.array_sort(
                    F.collect_list(F.struct("actual", "predicted", "n"))
                ).alias("confusion")))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def per_class_metrics(
    df: DataFrame, names: Sequence[str] = tuple(K.REPORT_NAMES), averages: bool = True
) -> DataFrame:
    """Precision, recall and F1 per class, plus macro and weighted means.

    Rows whose actual class is not listed count nowhere.
    """
    spark = df.sparkSession
    counts = df.where(_keep(names, "actual")).groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    # One pass over the counts: each pair adds to its actual and its predicted class.
    hit = F.col("actual") == F.col("predicted")
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("actual").alias("c"), F.col("n").alias("support"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("bigint").alias("support"),
                 F.lit(0).cast("bigint").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("c").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    listed = spark.createDataFrame([(n,) for n in names], "c string")
    rows = listed.join(sums, "c", "left").na.fill(0).withColumn("fn", F.col("support") - F.col("tp"))
    rows = rows.withColumns({
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _ratio(F.col("tp"), F.col("support")),
    }).withColumn("f1", _ratio(
        2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
    ))
    table = rows.select(
        F.col("c").alias("amino_acid"), "support", F.col("tp").alias("true_positive"),
        F.col("fp").alias("false_positive"), F.col("fn").alias("false_negative"),
        "precision", "recall", "f1",
    )
    if not averages:
        return table
    blank = F.lit(None).cast("bigint")
    empty = [blank.alias(c) for c in ("support", "true_positive", "false_positive", "false_negative")]
    scores = ["precision", "recall", "f1"]
    macro = table.agg(*[F.avg(c).alias(c) for c in scores]).select(
        F.lit("__macro_avg__").alias("amino_acid"), *empty, *scores
    )
    weighted = table.agg(
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores]
    ).select(F.lit("__weighted_avg__").alias("amino_acid"), *empty, *scores)
    return table.unionByName(macro).unionByName(weighted)


def common_confusions(df: DataFrame, order: str, limit: int | None = 50) -> DataFrame:
    """Most frequent wrong pairs; equal counts by first appearance."""
    pairs = df.where("actual <> predicted").groupBy("actual", "predicted").agg(
        F.count("*").alias("n"), F.min(order).alias("_first")
    )
    top = pairs.orderBy(F.desc("n"), "_first")
    if limit is not None:  # None: all pairs
        top = top.limit(limit)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "_first"))
    return top.select(rank.alias("rank"), "actual", "predicted", "n")


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins on [0, 1]; every bin is a row, an empty one holds zeros."""
    if bins <= 0:
        raise ValueError("the number of bins must be positive")
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]).cast("array<double>")
    stats = df.groupBy(edge_bin(F.col("confidence"), inner).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("correct").cast("int")).alias("empirical_accuracy"),
    )
    frame = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, bin_lower double, bin_upper double"
    )
    return frame.join(stats, "bin", "left").na.fill(0).na.fill(0.0)


def entropy_summary(df: DataFrame) -> DataFrame:
    """One row of eleven statistics; without rows they are NaN."""
    def mean_where(column: str, flag: Column) -> Column:
        return F.avg(F.when(flag, F.col(column)))

    ok = F.col("correct")
    stats = df.agg(
        F.count("*").cast("double").alias("num_samples"),
        F.avg("entropy").alias("mean_entropy"), F.stddev_pop("entropy").alias("std_entropy"),
        F.min("entropy").alias("min_entropy"), F.max("entropy").alias("max_entropy"),
        F.avg("confidence").alias("mean_confidence"),
        mean_where("entropy", ok).alias("mean_entropy_correct"),
        mean_where("entropy", ~ok).alias("mean_entropy_incorrect"),
        mean_where("confidence", ok).alias("mean_confidence_correct"),
        mean_where("confidence", ~ok).alias("mean_confidence_incorrect"),
    )
    median = exact_quantiles(df, [], "entropy", [0.5]).agg(F.max("quantile").alias("median_entropy"))
    both = stats.crossJoin(F.broadcast(median))  # one row each
    nan = F.lit(float("nan"))
    return both.select(*[F.coalesce(F.col(c), nan).alias(c) for c in both.columns])


def _series(df: DataFrame) -> DataFrame:
    """Each row once in 'all' and once in its correctness series."""
    names = F.array(F.lit("all"), F.when(F.col("correct"), "correct").otherwise("incorrect"))
    return df.withColumn("series", F.explode(names))


def _filled_bins(df: DataFrame, counts: DataFrame, bins: int) -> DataFrame:
    frame = df.sparkSession.createDataFrame(
        [(s, i) for s in ("all", "correct", "incorrect") for i in range(bins)], "series string, bin int"
    )
    return frame.join(counts, ["series", "bin"], "left").na.fill(0, ["n"])


def confidence_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """(series, bin, n) on [0, 1]; the last bin is closed."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(bins)], F.lit(1.0))
    binned = _series(df.where("confidence between 0 and 1")).groupBy(
        "series", F.least(edge_bin(F.col("confidence"), edges), F.lit(bins)).alias("_b")
    ).agg(F.count("*").alias("n")).select("series", (F.col("_b") - 1).alias("bin"), "n")
    return _filled_bins(df, binned, bins)


def entropy_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """(series, bin, n); each series is binned over its own range."""
    rows = _series(df)
    ranges = rows.groupBy("series").agg(F.min("entropy").alias("lo"), F.max("entropy").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(  # at most three rows
        "series",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    edges = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.col("lo") + i * step),
        F.array("hi"),
    )
    ranges = ranges.withColumn("edges", edges).drop("lo", "hi")
    counts = rows.join(F.broadcast(ranges), "series").groupBy(
        "series", F.least(edge_bin(F.col("entropy"), F.col("edges")), F.lit(bins)).alias("_b")
    ).agg(F.count("*").alias("n")).select("series", (F.col("_b") - 1).alias("bin"), "n")
    return _filled_bins(df, counts, bins)


def class_support(df: DataFrame, names: Sequence[str] = tuple(K.REPORT_NAMES)) -> DataFrame:
    listed = df.sparkSession.createDataFrame([(n,) for n in names], "amino_acid string")
    counts = df.groupBy(canonical_name(F.col("actual")).alias("amino_acid")).agg(F.count("*").alias("support"))
    return listed.join(counts, "amino_acid", "left").na.fill(0)


def support_range(support: DataFrame) -> DataFrame:
    return support.agg(F.min("support").alias("min_support"), F.max("support").alias("max_support"))


def accuracy_by_type(df: DataFrame) -> DataFrame:
    """Support and accuracy per property type; unlisted types are Unknown."""
    def known(c: str) -> Column:
        return F.when(F.col(c).isin(K.TYPE_NAMES), F.col(c)).otherwise("Unknown")

    counts = df.groupBy(known("actual_type").alias("amino_acid_type")).agg(
        F.count("*").alias("support"),
        F.count_if(known("actual_type") == known("predicted_type")).alias("correct"),
    )
    listed = df.sparkSession.createDataFrame([(t,) for t in K.TYPE_NAMES], "amino_acid_type string")
    filled = listed.join(counts, "amino_acid_type", "left").na.fill(0)
    return filled.withColumn("accuracy", _ratio(F.col("correct"), F.col("support")))


def type_accuracy(df: DataFrame) -> DataFrame:
    """Overall agreement of property types; NaN without labelled rows."""
    return df.where("actual <> ''").agg(
        F.coalesce(F.avg((F.col("actual_type") == F.col("predicted_type")).cast("int")),
                   F.lit(float("nan"))).alias("type_accuracy")
    )
