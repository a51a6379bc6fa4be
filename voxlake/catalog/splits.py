"""Checks of signatures, clusters, splits, leakage, statistics and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.catalog import views as V
from voxlake.functions.sequences import scaffold_signature, sequence_identity
from voxlake.operators import leakage, sampling, stats
from voxlake.operators.clusters import leader_clusters
from voxlake.operators.ranking import exact_quantiles
from voxlake.operators.splits import assign_splits, group_records
from voxlake.operators.voxels import VoxelConfig
from voxlake.runtime import cut_lineage
from voxlake.sources.samples import shard_gaps

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


_CLASS = "regexp_replace(sequence, '[^AVILMFWYSTNQCGPKRHDE]', '#', 'g')"
_FROM = "".join(K.SCAFFOLD_CLASSES.values())
_TO = "".join(c * len(a) for c, a in K.SCAFFOLD_CLASSES.items())
# DuckDB's patterns know no back references: each class collapses on its own.
_RUNS = f"translate({_CLASS}, '{_FROM}#', '{_TO}U')"
for _c in "HPSCU":
    _RUNS = f"regexp_replace({_RUNS}, '{_c}+', '{_c}', 'g')"
SIGNED = V.SEQUENCES + f""",
signed AS (
  SELECT structure_id, pdb_path, sequence, CAST((length(sequence) // 25) * 25 AS VARCHAR) AS bin,
         left({_RUNS}, 40) AS runs FROM seqs),
grouped AS (SELECT structure_id, pdb_path, bin || '_' || left(sha1(bin || '|' || runs), 10) AS group_id FROM signed)"""


@query("scaffold_signatures", V.with_sql(SIGNED) + "SELECT structure_id, group_id FROM grouped")
def scaffold_signatures(spark, d):
    return V.sequences(spark, d).select("structure_id", scaffold_signature(F.col("sequence")).alias("group_id"))


@query("sequence_identities", V.with_sql(V.SEQUENCES) + """,
pairs AS (SELECT a.pdb_path, a.sequence AS s, b.sequence AS t, least(length(a.sequence), length(b.sequence)) AS m,
                 greatest(length(a.sequence), length(b.sequence)) AS w
          FROM seqs a JOIN seqs b ON CAST(b.pdb_path AS BIGINT) = CAST(a.pdb_path AS BIGINT) + 1)
SELECT pdb_path, round(CASE WHEN w = 0 THEN 1.0e0 ELSE (m - hamming(left(s, m), left(t, m))) / CAST(w AS DOUBLE) END, 6) AS identity
FROM pairs""")
def sequence_identities(spark, d):
    s = V.sequences(spark, d)
    after = s.select(
        F.lpad((F.col("pdb_path").cast("bigint") - 1).cast("string"), 12, "0").alias("pdb_path"),
        F.col("sequence").alias("other"))
    return s.join(after, "pdb_path").select(
        "pdb_path", F.round(sequence_identity(F.col("sequence"), F.col("other")), 6).alias("identity"))


LEADERS = V.SEQUENCES + """,
uniq AS MATERIALIZED (SELECT sequence, min(pdb_path) AS ord FROM seqs GROUP BY 1),
pos AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord) AS i, length(sequence) AS len FROM uniq),
edges AS MATERIALIZED (
  SELECT b.i AS i, list(a.i ORDER BY a.i) AS near FROM pos a JOIN pos b ON a.i < b.i
    AND least(a.len, b.len) >= 0.4e0 * greatest(a.len, b.len) - 1e-6
  WHERE CASE WHEN greatest(a.len, b.len) = 0 THEN 1.0e0 ELSE
    (least(a.len, b.len) - hamming(left(a.sequence, least(a.len, b.len)), left(b.sequence, least(a.len, b.len))))
    / CAST(greatest(a.len, b.len) AS DOUBLE) END >= 0.4e0
  GROUP BY 1),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders, CAST(NULL AS BIGINT) AS mine
  UNION ALL
  SELECT w.i + 1,
         CASE WHEN list_has_any(coalesce(e.near, CAST([] AS BIGINT[])), w.leaders) THEN w.leaders ELSE list_append(w.leaders, w.i + 1) END,
         coalesce(list_min(list_intersect(e.near, w.leaders)), w.i + 1)
  FROM walk w LEFT JOIN edges e ON e.i = w.i + 1
  WHERE w.i < (SELECT max(i) FROM pos)),
clustered AS (
  SELECT s.structure_id, s.pdb_path, l.ord AS leader
  FROM seqs s JOIN pos p ON p.sequence = s.sequence JOIN walk w ON w.i = p.i JOIN pos l ON l.i = w.mine)"""


@query("leader_clusters", V.with_recursive(LEADERS) + "SELECT structure_id, leader FROM clustered")
def leader_cluster_rows(spark, d):
    return leader_clusters(V.sequences(spark, d), 0.4).select("structure_id", "leader")


def fold_sql(source: str, group: str, seed: int, n: str) -> str:
    """The greedy assignment as a walk over all ordered groups."""
    return f""",
sizes AS (SELECT {group} AS g, count(*) AS size FROM {source} GROUP BY 1),
ordered AS (SELECT g, size, row_number() OVER (ORDER BY size DESC, {V.hash_sql(seed, ['g'])}, g) AS i FROM sizes),
total AS (SELECT {n} AS n),
goal AS (SELECT CAST(round_even(0.8e0 * n, 0) AS BIGINT) AS t1, CAST(round_even(0.1e0 * n, 0) AS BIGINT) AS t2, n FROM total),
fold AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, '' AS split
  UNION ALL
  SELECT o.i, CASE WHEN s = 'train' THEN a + size ELSE a END, CASE WHEN s = 'val' THEN b + size ELSE b END,
         CASE WHEN s = 'test' THEN c + size ELSE c END, s
  FROM (SELECT o.i, o.size, a, b, c,
               CASE WHEN (a - t1, a, 1) < (b - t2, b, 2) AND (a - t1, a, 1) < (c - (n - t1 - t2), c, 3) THEN 'train'
                    WHEN (b - t2, b, 2) < (c - (n - t1 - t2), c, 3) THEN 'val' ELSE 'test' END AS s
        FROM fold f JOIN ordered o ON o.i = f.i + 1, goal) o)
SELECT x.structure_id, f.split FROM {source} x JOIN ordered o ON o.g = x.{group} JOIN fold f ON f.i = o.i"""


def split_of(grouped, seed):
    return assign_splits(grouped, seed=seed).select("structure_id", "split")


@query("random_split", V.with_recursive(V.SEQUENCES) + fold_sql("seqs", "pdb_path", 1, "(SELECT count(*) FROM seqs)"))
def random_split(spark, d):
    return split_of(group_records(V.sequences(spark, d), "random"), 1)


@query("scaffold_split", V.with_recursive(SIGNED) + fold_sql("grouped", "group_id", 2, "(SELECT count(*) FROM grouped)"))
def scaffold_split(spark, d):
    return split_of(group_records(V.sequences(spark, d), "scaffold"), 2)


@query("cluster_split", V.with_recursive(LEADERS) + fold_sql("clustered", "leader", 0, "(SELECT count(*) FROM clustered)"))
def cluster_split(spark, d):
    return split_of(group_records(V.sequences(spark, d), "sequence-cluster", 0.4), 0)


def _counted(sql: str) -> str:
    at = sql.rindex("SELECT x.structure_id")
    return sql[:at].rstrip() + ", chosen AS (" + sql[at:] + ") SELECT split, count(*) AS n FROM chosen GROUP BY 1"


_ORDERS = "groups AS (SELECT o_orderkey AS structure_id, CAST(o_custkey AS VARCHAR) AS group_id FROM orders)"


@query("chain_split_sizes", V.with_recursive(_ORDERS) + _counted(fold_sql("groups", "group_id", 4, "(SELECT count(*) FROM groups)")))
def chain_split_sizes(spark, d):
    """Group sizes per split over many groups (orders grouped by customer)."""
    o = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("structure_id"), F.col("o_custkey").cast("string").alias("group_id"))
    return assign_splits(o, seed=4).groupBy("split").agg(F.count("*").alias("n"))


LEAK = V.with_sql(V.SPLIT_ROWS)


@query("leakage_report", LEAK + """,
k AS (SELECT sequence_hash, lang, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b,
             count(*) FILTER (split = 'test') AS c FROM split_rows GROUP BY 1, 2)
SELECT CAST(sum(greatest(a - 1, 0)) AS BIGINT) AS dup_train, CAST(sum(greatest(b - 1, 0)) AS BIGINT) AS dup_val,
       CAST(sum(greatest(c - 1, 0)) AS BIGINT) AS dup_test, count(*) FILTER (a > 0 AND b > 0) AS overlap_train__val,
       count(*) FILTER (a > 0 AND c > 0) AS overlap_train__test, count(*) FILTER (b > 0 AND c > 0) AS overlap_val__test,
       sum(greatest(a - 1, 0) + greatest(b - 1, 0) + greatest(c - 1, 0)) > 0
         OR count(*) FILTER ((a > 0 AND b > 0) OR (a > 0 AND c > 0) OR (b > 0 AND c > 0)) > 0 AS has_issues FROM k""")
def leakage_row(spark, d):
    return leakage.leakage_report(V.split_rows(spark, d), ["sequence_hash", "lang"])


@query("split_duplicates", LEAK + "SELECT split, count(*) AS n_rows, count(DISTINCT sequence_hash) AS distinct_keys, count(*) - count(DISTINCT sequence_hash) AS duplicates FROM split_rows GROUP BY 1")
def split_duplicates(spark, d):
    return leakage.duplicates_per_split(V.split_rows(spark, d), ["sequence_hash"])


@query("split_overlaps", LEAK + ", k AS (SELECT DISTINCT sequence_hash, split FROM split_rows) SELECT a.split AS left_split, b.split AS right_split, count(*) AS n FROM k a JOIN k b ON a.sequence_hash = b.sequence_hash AND a.split < b.split GROUP BY 1, 2")
def split_overlaps(spark, d):
    return leakage.overlap_pairs(V.split_rows(spark, d), ["sequence_hash"])


@query("shared_keys", LEAK + "SELECT sequence_hash FROM split_rows WHERE split = 'train' INTERSECT SELECT sequence_hash FROM split_rows WHERE split = 'test'")
def shared_keys(spark, d):
    return leakage.shared_keys(V.split_rows(spark, d), "sequence_hash", "train", "test")


FAMILIES = """
fam AS (SELECT DISTINCT l_suppkey AS id, p_brand || '-' || p_size AS family FROM lineitem JOIN part ON l_partkey = p_partkey),
mem AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 < 8 THEN 'train' WHEN s_suppkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM supplier)"""


@query("family_leakage", V.with_sql(FAMILIES) + "SELECT family, count(DISTINCT CASE WHEN split = 'train' THEN id END) AS n_train, count(DISTINCT CASE WHEN split = 'test' THEN id END) AS n_test FROM fam JOIN mem USING (id) GROUP BY 1 HAVING n_train > 0 AND n_test > 0")
def family_leakage(spark, d):
    li, part = V.table(spark, d, "lineitem"), V.table(spark, d, "part")
    fam = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("id"), F.concat_ws("-", "p_brand", "p_size").alias("family"))
    mem = V.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.expr("CASE WHEN s_suppkey % 10 < 8 THEN 'train' WHEN s_suppkey % 10 = 8 THEN 'val' ELSE 'test' END").alias("split"))
    return leakage.shared_families(mem, fam, "train", "test")


# ---- statistics ------------------------------------------------------------

def stat(source: str, group: str, floor: str) -> str:
    head = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return (f"SELECT {head}round(avg(v), 6) AS mean, round({floor}, 6) AS std FROM {source}{tail}")


POP = "greatest(sqrt(greatest(sum(v * v) / count(*) - avg(v) * avg(v), 0)), 1e-6)"


@query("global_stats", V.with_sql(V.CELLS) + stat("cells", "", POP))
def global_stats(spark, d):
    return V.rounded(stats.global_stats(V.samples(spark, d)), 6, "mean", "std")


@query("channel_stats", V.with_sql(V.CELLS) + stat("cells", "ch", POP))
def channel_stats(spark, d):
    return V.rounded(stats.channel_stats(V.samples(spark, d), 4), 6, "mean", "std")


@query("voxelwise_stats", V.with_sql(V.CELLS) + stat("cells", "cell", "sqrt(greatest(sum(v * v) / count(*) - avg(v) * avg(v), 1e-12))"))
def voxelwise_stats(spark, d):
    return V.rounded(stats.voxelwise_stats(V.samples(spark, d)), 6, "mean", "std")


@query("part_means", V.with_sql(V.CELLS) + ", m AS (SELECT part, cell, avg(v) AS v FROM cells GROUP BY 1, 2) SELECT cell, round(avg(v), 6) AS mean FROM m GROUP BY 1")
def part_means(spark, d):
    return V.rounded(stats.mean_of_part_means(V.samples(spark, d), "part"), 6, "mean")


@query("sparse_channel_stats", V.with_sql(V.BOXED) + """,
n AS (SELECT count(*) * 8000.0e0 AS n FROM (SELECT DISTINCT structure_id, chain_id, res_no, res_name FROM voxels))
SELECT ch, round(sum(v) / any_value(n), 9) AS mean, round(sqrt(sum(v * v) / any_value(n) - (sum(v) / any_value(n)) * (sum(v) / any_value(n))), 9) AS std
FROM voxels, n GROUP BY ch""")
def sparse_channel_stats(spark, d):
    from voxlake.catalog.voxels import counted
    from voxlake.operators.residues import RESIDUE_KEY
    cells = cut_lineage(counted(spark, d, VoxelConfig(template="backbone")))
    n = cells.select(*RESIDUE_KEY).distinct().agg(F.count("*").alias("n_samples"))
    return V.rounded(stats.sparse_channel_stats(cells, n, 8000), 9, "mean", "std")


@query("normalized_samples", V.with_sql(V.CELLS) + f""",
s AS (SELECT ch, avg(v) AS mean, {POP} AS std FROM cells GROUP BY 1),
z AS (SELECT vec_id, (v - mean) / std AS z FROM cells JOIN s USING (ch))
SELECT vec_id AS sample_path, round(sum(z), 3) AS total, round(sum(z * z), 2) AS energy FROM z GROUP BY 1""")
def normalized_samples(spark, d):
    x = V.samples(spark, d)
    row = stats.stats_row(stats.channel_stats(x, 4), "ch", "per-channel", 0, 0)
    z = stats.normalize(x, row)
    return z.select(
        "sample_path",
        F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 3).alias("total"),
        F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v), 2).alias("energy"))


@query("mean_centred_samples", V.with_sql(V.CELLS) + ", m AS (SELECT cell, avg(v) AS mean FROM cells GROUP BY 1) SELECT vec_id AS sample_path, round(sum(v - mean), 4) AS total FROM cells JOIN m USING (cell) GROUP BY 1")
def mean_centred_samples(spark, d):
    x = V.samples(spark, d)
    listed = stats.voxelwise_stats(x).agg(F.array_sort(F.collect_list(F.struct("cell", "mean"))).alias("m")).first()["m"]
    z = stats.center_on_mean(x, [r["mean"] for r in listed])
    return z.select("sample_path", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("class_weights", V.with_sql(V.CLASSES) + """,
c AS (SELECT label, count(*) AS n FROM classes GROUP BY 1)
SELECT CAST(i AS BIGINT) AS label, coalesce(n, 0) AS n,
       round(coalesce((SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * n AS DOUBLE), 0), 6) AS weight
FROM unnest(range((SELECT max(label) FROM c) + 1)) AS u(i) LEFT JOIN c ON label = i""")
def class_weights(spark, d):
    return V.rounded(stats.class_weights(V.classes(spark, d)), 6, "weight")


# ---- sampling --------------------------------------------------------------

KEY = ", ".join(V.CLASS_KEY)


@query("sampled_rows", V.with_sql(V.CLASSES) + f", r AS (SELECT *, {V.rank_sql(1337, V.CLASS_KEY)} AS rnk FROM classes) SELECT {KEY} FROM r WHERE rnk <= 5000")
def sampled_rows(spark, d):
    return sampling.sample_n(V.classes(spark, d), 5000, V.CLASS_KEY, 1337).select(*V.CLASS_KEY)


@query("downsampled_classes", V.with_sql(V.CLASSES) + f", r AS (SELECT *, {V.rank_sql(7, V.CLASS_KEY, 'label')} AS rnk FROM classes) SELECT label, {KEY} FROM r WHERE rnk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM classes GROUP BY label))")
def downsampled_classes(spark, d):
    return sampling.balance(V.classes(spark, d), "downsample", "label", V.CLASS_KEY, 7).select("label", *V.CLASS_KEY)


@query("stratified_split", V.with_sql(V.CLASSES) + f", r AS (SELECT *, {V.rank_sql(9, V.CLASS_KEY, 'label')} AS rnk, count(*) OVER (PARTITION BY label) AS n FROM classes) SELECT label, {KEY}, CASE WHEN rnk <= round_even(n * 0.05e0, 0) THEN 'val' ELSE 'train' END AS split FROM r")
def stratified_split(spark, d):
    return sampling.stratified_split(V.classes(spark, d), "label", V.CLASS_KEY, 0.05, 9).select("label", *V.CLASS_KEY, "split")


@query("prepared_dataset", V.with_sql(V.CLASSES) + f""",
r AS (SELECT *, {V.rank_sql(5, V.CLASS_KEY, 'label')} AS rnk FROM classes),
b AS (SELECT * FROM r WHERE rnk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM classes GROUP BY label))),
s AS (SELECT *, {V.rank_sql(5, V.CLASS_KEY, 'label')} AS pos, count(*) OVER (PARTITION BY label) AS n FROM b)
SELECT label, CASE WHEN pos <= round_even(n * 0.05e0, 0) THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM s GROUP BY 1, 2""")
def prepared_dataset(spark, d):
    even = sampling.balance(V.classes(spark, d), "downsample", "label", V.CLASS_KEY, 5)
    rows = sampling.stratified_split(cut_lineage(even), "label", V.CLASS_KEY, 0.05, 5)
    return rows.groupBy("label", "split").agg(F.count("*").alias("n"))


@query("split_sizes", V.with_sql(V.SPLIT_ROWS) + "SELECT split, count(*) AS n FROM split_rows GROUP BY 1")
def split_sizes(spark, d):
    return stats.split_sizes(V.split_rows(spark, d))


@query("exact_quantiles", " UNION ALL ".join(
    f"SELECT l_returnflag, {q}e0 AS q, round(quantile_cont(l_extendedprice, {q}), 6) AS quantile FROM lineitem GROUP BY 1"
    for q in (0.0, 0.25, 0.5, 0.9, 1.0)))
def quantiles(spark, d):
    q = exact_quantiles(V.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.25, 0.5, 0.9, 1.0])
    return V.rounded(q, 6, "quantile")


SHARD_FILES = """
groups AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'val' ELSE 'test' END AS split, l_suppkey AS shard, CAST((l_linenumber - 1) % 3 + 1 AS INTEGER) AS part, count(*) AS n
  FROM lineitem GROUP BY ALL),
files AS (
  SELECT split, shard, part, CASE WHEN (shard + part) % 19 <> 0 THEN n END AS nx, CASE WHEN (shard * part) % 17 <> 0 THEN n + CASE WHEN shard % 13 = 0 THEN 1 ELSE 0 END END AS ny
  FROM groups),
expected AS (SELECT * FROM (SELECT DISTINCT split, shard FROM files WHERE nx IS NOT NULL OR ny IS NOT NULL) CROSS JOIN (VALUES (1), (2), (3)) AS p(part))"""


@query("shard_gaps", V.with_sql(SHARD_FILES) + """
SELECT * FROM (
  SELECT e.split, e.part, e.shard, CASE WHEN nx IS NULL AND ny IS NULL THEN 'no files' WHEN nx IS NULL THEN 'no X file' WHEN ny IS NULL THEN 'no y file'
         WHEN nx <> ny THEN nx || ' samples, ' || ny || ' labels' END AS problem
  FROM expected e LEFT JOIN files f ON e.split = f.split AND e.part = f.part AND e.shard = f.shard) WHERE problem IS NOT NULL""")
def shard_completeness(spark, d):
    split = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "val").otherwise("test")
    groups = V.table(spark, d, "lineitem").groupBy(
        split.alias("split"), F.col("l_suppkey").alias("shard"), F.expr("cast((l_linenumber - 1) % 3 + 1 as int)").alias("part")).agg(F.count("*").alias("n"))
    x = groups.where("(shard + part) % 19 <> 0").select(F.lit("X").alias("kind"), "split", "shard", "part", "n")
    y = groups.where("(shard * part) % 17 <> 0").select(
        F.lit("y").alias("kind"), "split", "shard", "part", (F.col("n") + F.expr("CASE WHEN shard % 13 = 0 THEN 1 ELSE 0 END")).alias("n"))
    return shard_gaps(x.unionByName(y), ["train", "val", "test"], [1, 2, 3])
