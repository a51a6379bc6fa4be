"""Checks of scoring, classification metrics and prediction reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.catalog import views as V
from voxlake.functions.residues import label_name, normalize_label, parse_label
from voxlake.operators import metrics as M
from voxlake.operators.embeddings import embedding_sample, principal_variances
from voxlake.operators.scoring import format_site, score_samples, structure_name, with_predictions
from voxlake.runtime import cut_lineage

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


S = V.with_sql(V.SCORED)
P = V.with_sql(V.PREDICTIONS)


def scored(spark, d):
    return with_predictions(V.scored(spark, d), 5)


@query("scored_rows", S + "SELECT example_id, label, predicted, round(confidence, 6) AS confidence, round(entropy, 6) AS entropy, (SELECT string_agg(cls, '|' ORDER BY rnk) FROM ranked r WHERE r.example_id = s.example_id AND rnk <= 5) AS top FROM scored_rows s")
def scored_rows(spark, d):
    return V.rounded(scored(spark, d).select(
        "example_id", "label", "predicted", "confidence", "entropy", F.concat_ws("|", F.transform("top", lambda i: i.cast("string"))).alias("top")
    ), 6, "confidence", "entropy")


@query("accuracy", S + "SELECT round(avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy FROM scored")
def accuracy(spark, d):
    return V.rounded(M.accuracy(scored(spark, d)), 6, "accuracy")


@query("topk_accuracy", S + "SELECT " + ", ".join(f"round(sum(CAST(cls = label AND rnk <= {k} AS INTEGER)) / CAST(count(DISTINCT example_id) AS DOUBLE), 6) AS top{k}" for k in (1, 3, 5)) + " FROM ranked")
def topk_accuracy(spark, d):
    return V.rounded(M.topk_accuracy(scored(spark, d), [1, 3, 5], 20), 6, "top1", "top3", "top5")


@query("confusion_ids", S + "SELECT a AS actual, p AS predicted, count(example_id) AS n FROM unnest(range(20)) AS x(a) CROSS JOIN unnest(range(20)) AS y(p) LEFT JOIN scored ON label = a AND predicted = p GROUP BY 1, 2")
def confusion_ids(spark, d):
    return M.confusion(scored(spark, d), list(range(20)), "label", "predicted")


@query("balanced_accuracy", S + ", r AS (SELECT c, coalesce(avg(CAST(predicted = c AS INTEGER)), 0) AS recall FROM unnest(range(20)) AS u(c) LEFT JOIN scored ON label = c GROUP BY 1) SELECT round(avg(recall), 6) AS balanced_accuracy FROM r")
def balanced_accuracy(spark, d):
    cells = M.confusion(scored(spark, d), list(range(20)), "label", "predicted")
    return V.rounded(M.balanced_accuracy(cells), 6, "balanced_accuracy")


_GROUPS = V.sql_list([K.GROUP_OF[i] for i in range(20)])


@query("residue_group_accuracy", S + f"SELECT round(avg(CAST({_GROUPS}[label + 1] = {_GROUPS}[predicted + 1] AS INTEGER)), 6) AS residue_group_accuracy FROM scored")
def group_accuracy(spark, d):
    return V.rounded(M.group_accuracy(scored(spark, d)), 6, "residue_group_accuracy")


AUC = S + """,
long AS (SELECT c - 1 AS cls, probs[c] AS score, CAST(label = c - 1 AS INTEGER) AS pos FROM scored, unnest(range(1, 21)) AS u(c)),
r AS (SELECT cls, score, pos, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0e0 AS rk FROM long),
a AS (SELECT cls, (sum(pos * rk) - sum(pos) * (sum(pos) + 1) / 2.0e0) / (sum(pos) * CAST(count(*) - sum(pos) AS DOUBLE)) AS auroc FROM r GROUP BY 1)
"""
AP = S + """,
long AS (SELECT c - 1 AS cls, probs[c] AS score, CAST(label = c - 1 AS INTEGER) AS pos FROM scored, unnest(range(1, 21)) AS u(c)),
t AS (SELECT cls, score, sum(pos) AS pos, count(*) AS n FROM long GROUP BY 1, 2),
c AS (SELECT cls, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM t WINDOW w AS (PARTITION BY cls ORDER BY score DESC)),
a AS (SELECT cls, coalesce(sum(pos * cp / CAST(cn AS DOUBLE)) / nullif(sum(pos), 0), 0) AS prauc FROM c GROUP BY 1)
"""


@query("auroc_per_class", AUC + "SELECT CAST(cls AS INTEGER) AS cls, round(auroc, 6) AS auroc FROM a")
def auroc_per_class(spark, d):
    return V.rounded(M.auroc_per_class(scored(spark, d), 20), 6, "auroc")


@query("auroc", AUC + "SELECT round(avg(auroc), 6) AS auroc FROM a")
def auroc(spark, d):
    return V.rounded(M.auroc(scored(spark, d), 20), 6, "auroc")


@query("average_precision", AP + "SELECT round(avg(prauc), 6) AS prauc FROM a")
def average_precision(spark, d):
    return V.rounded(M.prauc(scored(spark, d), 20), 6, "prauc")


def regression_rows(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1000.0).alias("predicted"))


@query("regression_metrics", "SELECT round(avg(abs(l_quantity * 1000 - l_extendedprice)), 3) AS mae, round(avg(power(l_quantity * 1000 - l_extendedprice, 2)), 0) AS mse, round(sqrt(avg(power(l_quantity * 1000 - l_extendedprice, 2))), 3) AS rmse FROM lineitem")
def regression_metrics(spark, d):
    m = M.regression_metrics(regression_rows(spark, d), "label", "predicted")
    return m.select(F.round("mae", 3).alias("mae"), F.round("mse", 0).alias("mse"), F.round("rmse", 3).alias("rmse"))


@query("evaluation_report", S + ", t AS (SELECT count(*) AS num_examples, round(avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy FROM scored) SELECT 'residue_identity' AS task, num_examples, accuracy, (SELECT round(sum(CAST(cls = label AND rnk <= 5 AS INTEGER)) / CAST(count(DISTINCT example_id) AS DOUBLE), 6) FROM ranked) AS top5 FROM t")
def evaluation_report(spark, d):
    r = M.evaluate(cut_lineage(scored(spark, d)), ["accuracy", "top5"], "residue_identity", 20)
    return V.rounded(r, 6, "accuracy", "top5")


WHOLE_REPORT = {"accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "topk_accuracy": "top3", "auroc": "auroc", "average_precision": "prauc"}


@query("whole_evaluation", "SELECT 'residue_identity' AS task, " + ", ".join(WHOLE_REPORT.values())
       + ", (SELECT CAST(sum(n) AS BIGINT) FROM (" + SQL["confusion_ids"] + ")) AS num_examples FROM "
       + " CROSS JOIN ".join(f"({SQL[name]}) AS {name}_row" for name in WHOLE_REPORT))
def whole_evaluation(spark, d):
    r = M.evaluate(cut_lineage(scored(spark, d)), ["accuracy", "balanced_accuracy", "top3", "auroc", "prauc", "confusion"], "residue_identity", 20)
    counted = F.aggregate("confusion", F.lit(0).cast("bigint"), lambda t, c: t + c["n"])
    return V.rounded(r.select("task", *WHOLE_REPORT.values(), counted.alias("num_examples")), 6, *WHOLE_REPORT.values())


@query("regression_report", "SELECT 'regression' AS task, (SELECT count(*) FROM lineitem) AS num_examples, * FROM (" + SQL["regression_metrics"] + ")")
def regression_report(spark, d):
    r = M.evaluate(regression_rows(spark, d), None, "regression")
    return r.select("task", "num_examples", F.round("mae", 3).alias("mae"), F.round("mse", 0).alias("mse"), F.round("rmse", 3).alias("rmse"))


@query("site_names", """
WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN ' S' || o_custkey || ' ' WHEN o_orderkey % 3 = 1 THEN '' END AS sid,
                  'f' || (o_custkey % 10) AS folder, CASE WHEN o_orderkey % 5 = 0 THEN 'm' || o_custkey || '__x__' || o_orderkey ELSE 'n' || o_orderkey END AS stem FROM orders)
SELECT o_orderkey,
       CASE WHEN o_orderkey % 4 <> 0 THEN 'A:' || (o_custkey % 50) || ':GLY' WHEN o_orderkey % 8 = 0 THEN 'e' || o_orderkey
            WHEN o_orderkey % 5 = 0 THEN 'x__' || o_orderkey ELSE stem END AS site,
       CASE WHEN o_orderkey % 3 = 0 THEN 'S' || o_custkey WHEN o_orderkey % 5 = 0 THEN 'm' || o_custkey ELSE folder END AS structure_name FROM p""")
def site_names(spark, d):
    o = V.table(spark, d, "orders")
    path = F.expr("""concat('/data/f', o_custkey % 10, '/',
        CASE WHEN o_orderkey % 5 = 0 THEN concat('m', o_custkey, '__x__', o_orderkey) ELSE concat('n', o_orderkey) END, '.npz')""")
    named = o.select(
        "o_orderkey", path.alias("path"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat(' S', o_custkey, ' ') WHEN o_orderkey % 3 = 1 THEN '' END").alias("structure_id"),
        F.lit(" A ").alias("chain_id"), (F.col("o_custkey") % 50).alias("res_no"),
        F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN 'gly' END").alias("res_name"),
        F.expr("CASE WHEN o_orderkey % 8 = 0 THEN concat('e', o_orderkey) ELSE '' END").alias("example_id"))
    return named.select("o_orderkey", format_site(F.col("path")).alias("site"), structure_name(F.col("path")).alias("structure_name"))


def fixed_scorer(block):
    """Channel sums of each sample, repeated: a stand-in for a model."""
    sums = block.reshape(len(block), block.shape[1], -1).astype(np.float64).sum(axis=2)
    return np.concatenate([sums, -sums], axis=1)


@query("batch_scores", V.with_sql(V.CELLS) + ", s AS (SELECT vec_id, ch, sum(v) AS v FROM cells GROUP BY 1, 2) SELECT vec_id AS sample_path, round(max(v) FILTER (ch = 0), 2) AS first, round(-max(v) FILTER (ch = 3), 2) AS last FROM s GROUP BY 1")
def batch_scores(spark, d):
    s = score_samples(V.samples(spark, d), fixed_scorer)
    return s.select("sample_path", F.round(F.get("logits", F.lit(0)).cast("double"), 2).alias("first"),
                    F.round(F.get("logits", F.lit(7)).cast("double"), 2).alias("last"))


# ---- prediction reports ----------------------------------------------------

@query("confusion_names", P + f"SELECT a AS actual, p AS predicted, count(predicted) AS n FROM unnest({V.TITLES}) AS x(a) CROSS JOIN unnest({V.TITLES}) AS y(p) LEFT JOIN preds ON actual = a AND predicted = p GROUP BY 1, 2")
def confusion_names(spark, d):
    return M.confusion(V.predictions(spark, d), K.REPORT_NAMES)


_TYPES = V.sql_list(K.TYPE_NAMES)
CELLS_SQL = P + f""",
cells AS (SELECT a AS actual, p AS predicted, count(actual_type) AS n FROM unnest({_TYPES}) AS x(a) CROSS JOIN unnest({_TYPES}) AS y(p)
          LEFT JOIN preds ON actual_type = a AND predicted_type = p GROUP BY 1, 2)
"""


@query("type_confusion_shares", CELLS_SQL + "SELECT actual, predicted, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 6) AS by_row, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY predicted), 0), 0), 6) AS by_column, round(n / sum(n) OVER (), 6) AS by_all FROM cells")
def type_confusion_shares(spark, d):
    cells = M.confusion(V.predictions(spark, d), K.TYPE_NAMES, "actual_type", "predicted_type")
    out = cells
    for mode, name in (("row", "by_row"), ("column", "by_column"), ("all", "by_all")):
        out = M.normalize_confusion(out, mode).withColumnRenamed("share", name)
    return V.rounded(out, 6, "by_row", "by_column", "by_all")


PER = P + f""",
c AS (SELECT aa AS amino_acid, count(*) FILTER (actual = aa) AS support, count(*) FILTER (actual = aa AND predicted = aa) AS tp,
             count(*) FILTER (predicted = aa AND actual <> aa) AS fp FROM unnest({V.TITLES}) AS u(aa), preds GROUP BY 1),
q AS (SELECT *, support - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q),
u AS (
  SELECT amino_acid, support, tp AS true_positive, fp AS false_positive, fn AS false_negative, precision, recall, f1 FROM f
  UNION ALL SELECT '__macro_avg__', -1, -1, -1, -1, avg(precision), avg(recall), avg(f1) FROM f
  UNION ALL SELECT '__weighted_avg__', -1, -1, -1, -1, sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM f)
SELECT amino_acid, support, true_positive, false_positive, false_negative, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM u"""


@query("per_class_metrics", PER)
def per_class_metrics(spark, d):
    table = M.per_class_metrics(V.predictions(spark, d))
    filled = table.na.fill(-1, ["support", "true_positive", "false_positive", "false_negative"])
    return V.rounded(filled, 6, "precision", "recall", "f1")


@query("common_confusions", P + ", c AS (SELECT actual, predicted, count(*) AS n, min(row_no) AS f FROM preds WHERE actual <> predicted GROUP BY 1, 2) SELECT * FROM (SELECT row_number() OVER (ORDER BY n DESC, f) AS rank, actual, predicted, n FROM c) WHERE rank <= 50")
def common_confusions(spark, d):
    return M.common_confusions(V.predictions(spark, d), "row_no")


_EDGES = "[" + ", ".join(repr(i * 0.1) + "e0" for i in range(1, 10)) + "]"


@query("calibration_bins", P + f""",
b AS (SELECT len(list_filter({_EDGES}, lambda e: e <= confidence)) AS bin, confidence, CAST(correct AS INTEGER) AS ok FROM preds)
SELECT CAST(i AS INTEGER) AS bin, round(i * 0.1e0, 6) AS bin_lower, round(CASE WHEN i = 9 THEN 1.0e0 ELSE (i + 1) * 0.1e0 END, 6) AS bin_upper,
       count(confidence) AS n, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, round(coalesce(avg(ok), 0), 6) AS empirical_accuracy
FROM unnest(range(10)) AS u(i) LEFT JOIN b ON bin = i GROUP BY i""")
def calibration_bins(spark, d):
    return V.rounded(M.calibration_bins(V.predictions(spark, d), 10), 6, "bin_lower", "bin_upper", "mean_confidence", "empirical_accuracy")


ENTROPY = P + """
SELECT CAST(count(*) AS DOUBLE) AS num_samples, round(avg(entropy), 6) AS mean_entropy, round(stddev_pop(entropy), 6) AS std_entropy,
       round(min(entropy), 6) AS min_entropy, round(max(entropy), 6) AS max_entropy, round(avg(confidence), 6) AS mean_confidence,
       round(avg(entropy) FILTER (correct), 6) AS mean_entropy_correct, round(avg(entropy) FILTER (NOT correct), 6) AS mean_entropy_incorrect,
       round(avg(confidence) FILTER (correct), 6) AS mean_confidence_correct,
       round(avg(confidence) FILTER (NOT correct), 6) AS mean_confidence_incorrect, round(quantile_cont(entropy, 0.5), 6) AS median_entropy FROM preds"""


@query("entropy_summary", ENTROPY)
def entropy_summary(spark, d):
    s = M.entropy_summary(V.predictions(spark, d))
    return V.rounded(s, 6, *s.columns)


SERIES = P + """,
series AS (SELECT 'all' AS series, * FROM preds UNION ALL SELECT CASE WHEN correct THEN 'correct' ELSE 'incorrect' END, * FROM preds),
frame AS (SELECT s AS series, CAST(i AS INTEGER) AS bin FROM unnest(['all', 'correct', 'incorrect']) AS a(s) CROSS JOIN unnest(range({bins})) AS b(i)),
"""


@query("confidence_histogram", SERIES.format(bins=20) + """
h AS (SELECT series, least(len(list_filter([i * 0.05e0 FOR i IN range(20)], lambda e: e <= confidence)) - 1, 19) AS bin, count(*) AS n
      FROM series WHERE confidence BETWEEN 0 AND 1 GROUP BY 1, 2)
SELECT f.series, f.bin, coalesce(n, 0) AS n FROM frame f LEFT JOIN h ON h.series = f.series AND h.bin = f.bin""")
def confidence_histogram(spark, d):
    return M.confidence_histogram(V.predictions(spark, d))


@query("entropy_histogram", SERIES.format(bins=30) + """
r AS (SELECT series, min(entropy) AS lo, max(entropy) AS hi FROM series GROUP BY 1),
e AS (SELECT series, [lo + i * ((hi - lo) / 30.0e0) FOR i IN range(30)] AS edges FROM r),
h AS (SELECT s.series, len(list_filter(edges, lambda e: e <= entropy)) - 1 AS bin, count(*) AS n FROM series s JOIN e ON e.series = s.series GROUP BY 1, 2)
SELECT f.series, f.bin, coalesce(n, 0) AS n FROM frame f LEFT JOIN h ON h.series = f.series AND h.bin = f.bin""")
def entropy_histogram(spark, d):
    return M.entropy_histogram(V.predictions(spark, d))


@query("class_support", P + f"SELECT aa AS amino_acid, count(actual) AS support FROM unnest({V.TITLES}) AS u(aa) LEFT JOIN preds ON actual = aa GROUP BY 1")
def class_support(spark, d):
    return M.class_support(V.predictions(spark, d))


@query("support_range", P + ", c AS (SELECT count(*) AS n FROM preds GROUP BY actual) SELECT min(n) AS min_support, max(n) AS max_support FROM c")
def support_range(spark, d):
    return M.support_range(M.class_support(V.predictions(spark, d)))


@query("accuracy_by_type", P + f"SELECT t AS amino_acid_type, count(actual_type) AS support, count(*) FILTER (actual_type = predicted_type) AS correct, round(coalesce(avg(CAST(actual_type = predicted_type AS INTEGER)), 0), 6) AS accuracy FROM unnest({_TYPES}) AS u(t) LEFT JOIN preds ON actual_type = t GROUP BY 1")
def accuracy_by_type(spark, d):
    return V.rounded(M.accuracy_by_type(V.predictions(spark, d)), 6, "accuracy")


@query("type_accuracy", P + "SELECT round(avg(CAST(actual_type = predicted_type AS INTEGER)), 6) AS type_accuracy FROM preds")
def type_accuracy(spark, d):
    return V.rounded(M.type_accuracy(V.predictions(spark, d)), 6, "type_accuracy")


@query("label_forms", f"""
SELECT l_partkey, l_linenumber, CASE l_linenumber WHEN 4 THEN CAST(l_partkey % 20 AS INTEGER) WHEN 5 THEN -1 WHEN 6 THEN -1 ELSE CAST(l_partkey % 20 AS INTEGER) END AS label,
       CASE l_linenumber WHEN 5 THEN '' WHEN 6 THEN 'Unk' ELSE {V.TITLES}[CAST(l_partkey % 20 AS INTEGER) + 1] END AS name
FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem)""")
def label_forms(spark, d):
    li = V.table(spark, d, "lineitem").select("l_partkey", "l_linenumber").distinct()
    code = F.expr("cast(l_partkey % 20 as int)")
    raw = (
        F.when(F.col("l_linenumber") == 4, code.cast("string")).when(F.col("l_linenumber") == 5, " ")
        .when(F.col("l_linenumber") == 6, "UNK").when(F.col("l_linenumber") == 7, V.pick(list(K.ONE_LETTER), code))
        .when(F.col("l_linenumber") == 1, F.lower(V.pick(K.RESIDUES, code))).otherwise(label_name(code))
    )
    return li.select("l_partkey", "l_linenumber", F.coalesce(parse_label(raw), F.lit(-1)).alias("label"), normalize_label(raw).alias("name"))


@query("sampled_embeddings", f"SELECT vec_id FROM (SELECT vec_id, {V.rank_sql(1337, ['vec_id'])} AS rnk FROM embeddings) WHERE rnk <= 300")
def sampled_embeddings(spark, d):
    return embedding_sample(V.table(spark, d, "embeddings"), ["vec_id"], 300).select("vec_id")


# Two halves of a vector summed up: the eigenvalues of a 2 x 2 covariance have a closed form.
@query("principal_variances", """
WITH h AS (SELECT list_sum([CAST(x AS DOUBLE) FOR x IN embedding[1:32]]) AS a, list_sum([CAST(x AS DOUBLE) FOR x IN embedding[33:64]]) AS b FROM embeddings),
c AS (SELECT var_samp(a) AS p, var_samp(b) AS q, covar_samp(a, b) AS r FROM h)
SELECT round((p + q) / 2 + sqrt(((p - q) / 2) * ((p - q) / 2) + r * r), 6) AS var1, round((p + q) / 2 - sqrt(((p - q) / 2) * ((p - q) / 2) + r * r), 6) AS var2 FROM c""")
def variances(spark, d):
    half = lambda start: F.aggregate(F.slice("embedding", start, 32), F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    e = V.table(spark, d, "embeddings").select(F.array(half(1), half(33)).alias("vec"))
    return V.rounded(principal_variances(e, "vec", 2), 6, "var1", "var2")
