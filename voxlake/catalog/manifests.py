"""Checks of manifest validation, repair, activity and accessibility."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from voxlake import constants as K
from voxlake.catalog import views as V
from voxlake.functions.columns import (
    bin_labels, config_fingerprint, file_stem, labels_match, parse_example_name, resolve_path,
)
from voxlake.operators import access, activity, quality
from voxlake.operators.residues import residues_from_atoms
from voxlake.operators.voxels import VoxelConfig
from voxlake.plans.checks import manifest_fields, repair_summary, repaired_rows, salvaged_sources, validate_manifest
from voxlake.plans.voxels import build_activity
from voxlake.runtime import cut_lineage, fresh_dir, landed
from voxlake.sources.arrays import named_payload, write_file
from voxlake.sources.sinks import write_csv
from voxlake.streaming.incremental import append_ledgers, ledgers, reconcile_accessions, run_incremental

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


HEADER = ["example_id", "structure_id", "chain_id", "res_no", "res_name", "label", "sample_path", "task", "channel_scheme"]

def lines_frame(spark, d):
    """One manifest line per line item; arithmetic rules break some of them."""
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").distinct()
    res = V.pick(K.RESIDUES, F.expr("l_orderkey % 20"))
    stem = F.concat(F.lit("S"), "l_suppkey", F.lit("_"), "l_returnflag", F.lit("_"), F.expr("l_orderkey % 500"), F.lit("_"), res)
    path = F.when(F.expr("l_orderkey % 97 = 0"), "").when(F.expr("l_orderkey % 89 = 0"), F.concat(stem, F.lit(".txt"))).otherwise(
        F.concat(F.lit("v/S"), "l_suppkey", F.lit("/"), stem, F.lit(".npz")))
    label = F.when(F.expr("l_orderkey % 83 = 0"), "").otherwise(F.expr("cast(l_partkey % 20 as string)"))
    fields = F.concat_ws(",", stem, F.concat(F.lit("S"), "l_suppkey"), "l_returnflag", F.expr("cast(l_orderkey % 500 as string)"),
                         res, label, path, F.lit("residue_identity"), F.lit("element4"))
    line = F.when(F.expr("l_orderkey % 79 = 0"), F.concat(fields, F.lit(","), fields)).when(
        F.expr("l_orderkey % 73 = 0"), F.lit("broken")).when(F.expr("l_orderkey % 67 = 0"), F.lit("")).otherwise(fields)
    return li.select(F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").alias("row_no"), line.alias("line"),
                     *[c for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])


def field_rows(spark, d):
    return quality.with_fields(lines_frame(spark, d)).select("row_no", "fields")


def checked_rows(spark, d):
    return quality.check_rows(field_rows(spark, d), HEADER)


MANIFEST = f"""
li AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem),
m0 AS (SELECT *, {{'l_orderkey': l_orderkey, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_linenumber': l_linenumber, 'l_returnflag': l_returnflag}} AS row_no, {V.RES}[CAST(l_orderkey % 20 AS INTEGER) + 1] AS res_name,
              'S' || l_suppkey AS structure_id, l_returnflag AS chain_id, CAST(l_orderkey % 500 AS VARCHAR) AS res_no FROM li),
m1 AS (SELECT *, structure_id || '_' || chain_id || '_' || res_no || '_' || res_name AS example_id,
              CASE WHEN l_orderkey % 83 = 0 THEN '' ELSE CAST(l_partkey % 20 AS VARCHAR) END AS label FROM m0),
man AS (SELECT *, CASE WHEN l_orderkey % 97 = 0 THEN '' WHEN l_orderkey % 89 = 0 THEN example_id || '.txt'
                       ELSE 'v/' || structure_id || '/' || example_id || '.npz' END AS path,
               l_orderkey % 79 = 0 AS merged, l_orderkey % 79 <> 0 AND (l_orderkey % 73 = 0 OR l_orderkey % 67 = 0) AS broken FROM m1),
errs AS (
  SELECT row_no, 'corrupted_row' AS code FROM man WHERE merged OR broken
  UNION ALL SELECT row_no, CASE WHEN path = '' THEN 'empty_path' ELSE 'bad_path_extension' END FROM man
    WHERE NOT merged AND NOT broken AND (path = '' OR NOT ends_with(path, '.npz'))
  UNION ALL SELECT row_no, 'empty_label' FROM man WHERE NOT merged AND NOT broken AND label = ''),
clean AS (SELECT * FROM man WHERE NOT merged AND NOT broken AND label <> '' AND ends_with(path, '.npz')),
dups AS (
  SELECT row_no, 'duplicate_path' AS code FROM (SELECT row_no, row_number() OVER (PARTITION BY path ORDER BY row_no) AS r FROM clean) WHERE r > 1
  UNION ALL SELECT row_no, 'duplicate_example_id' FROM (SELECT row_no, row_number() OVER (PARTITION BY example_id ORDER BY row_no) AS r FROM clean) WHERE r > 1
  UNION ALL SELECT row_no, 'duplicate_residue_key' FROM (SELECT row_no, row_number() OVER (PARTITION BY structure_id, chain_id, res_no, res_name ORDER BY row_no) AS r FROM clean) WHERE r > 1),
listing AS (SELECT DISTINCT '/root/' || path AS path FROM clean WHERE l_suppkey % 11 <> 0)"""
MAN = V.with_sql(MANIFEST)
_ROWCOLS = "row_no.l_orderkey AS l_orderkey, row_no.l_partkey AS l_partkey, row_no.l_suppkey AS l_suppkey, row_no.l_linenumber AS l_linenumber"


def keyed(df):
    return df.select(*[F.col(f"row_no.{c}").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], "code")


@query("manifest_row_errors", MAN + f"SELECT {_ROWCOLS}, code FROM errs")
def manifest_row_errors(spark, d):
    return keyed(quality.row_errors(checked_rows(spark, d)))


@query("manifest_duplicates", MAN + f"SELECT {_ROWCOLS}, code FROM dups")
def manifest_duplicates(spark, d):
    return keyed(quality.duplicate_errors(checked_rows(spark, d)))


@query("merged_row_hints", MAN + "SELECT count(*) FILTER (merged) AS wider, count(*) FILTER (merged AND ends_with(path, '.npz')) AS several, count(*) FILTER (merged) AS embedded FROM man")
def merged_row_hints(spark, d):
    bad = field_rows(spark, d).where(F.size("fields") != len(HEADER))
    hints = bad.withColumn("h", quality.merge_hints(len(HEADER)))
    return hints.agg(
        F.count_if(F.array_contains("h", "more columns than the header")).alias("wider"),
        F.count_if(F.array_contains("h", "several sample paths")).alias("several"),
        F.count_if(F.array_contains("h", "embedded example id")).alias("embedded"))


def listing(spark, d):
    return listed(checked_rows(spark, d))


def listed(checked):
    c = checked.where(F.size("errors") == 0).where("row_no.l_suppkey % 11 <> 0")
    return c.select(resolve_path(F.col("path"), "/root").alias("path")).distinct()


@query("missing_files", MAN + f"SELECT {_ROWCOLS}, 'missing_file' AS code FROM clean WHERE l_suppkey % 11 = 0")
def missing_files(spark, d):
    return keyed(quality.missing_files(checked_rows(spark, d), listing(spark, d), "/root"))


def payload(files):
    """What an import of the listed files would have found."""
    n = F.regexp_extract("path", "/S(\\d+)/", 1).cast("bigint")
    number = F.regexp_extract("path", "_(\\d+)_[A-Z]+\\.npz", 1).cast("bigint")
    shape = F.when(number % 7 == 0, F.array(*map(F.lit, (3, 20, 20, 20)))).when(
        number % 11 == 0, F.array(*map(F.lit, (4, 10, 10, 10)))).when(
        number % 13 == 0, F.array(*map(F.lit, (20, 20)))).otherwise(F.array(*map(F.lit, (4, 20, 20, 20))))
    return files.select(
        "path", F.when(n % 17 == 0, "bad zip").alias("read_error"), (n % 13 != 0).alias("has_x"), (n % 7 != 0).alias("has_y"),
        shape.alias("raw_shape"), F.lit(None).cast("array<int>").alias("shape"), F.lit(None).cast("array<float>").alias("x"),
        (number % 20).cast("double").alias("y"))


PAYLOAD = MAN.rstrip() + """,
pay AS (
  SELECT row_no, label, l_suppkey AS n, CAST(res_no AS BIGINT) AS k FROM clean WHERE l_suppkey % 11 <> 0),
bad AS (
  SELECT row_no, 'unreadable_file' AS code FROM pay WHERE n % 17 = 0
  UNION ALL SELECT row_no, 'npz_missing_x' FROM pay WHERE n % 17 <> 0 AND n % 13 = 0
  UNION ALL SELECT row_no, 'shape_mismatch' FROM pay WHERE n % 17 <> 0 AND n % 13 <> 0 AND (k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0)
  UNION ALL SELECT row_no, 'npz_missing_y' FROM pay WHERE n % 17 <> 0 AND n % 13 <> 0 AND n % 7 = 0
  UNION ALL SELECT row_no, 'label_mismatch' FROM pay WHERE n % 17 <> 0 AND n % 13 <> 0 AND n % 7 <> 0 AND CAST(label AS BIGINT) <> k % 20)
"""


def payload_problems(spark, d):
    return quality.payload_errors(checked_rows(spark, d), payload(listing(spark, d)), "/root", "residue_identity", 4, 20)


@query("payload_errors", PAYLOAD + f"SELECT {_ROWCOLS}, code FROM bad")
def payload_errors(spark, d):
    return keyed(payload_problems(spark, d))


def written_archives(spark, d):
    """One archive for each supplier, written by tasks; some lack an array, some are no archive."""
    folder = fresh_dir(spark, "archives")
    s = V.table(spark, d, "supplier").select(F.concat(F.lit(f"{folder}/S"), "s_suppkey", F.lit(".npz")).alias("path"), "s_suppkey", "s_nationkey")

    def write(batches):
        for pdf in batches:
            for path, key, nation in zip(pdf["path"], pdf["s_suppkey"], pdf["s_nationkey"]):
                parts = {"x": np.full((4, 2, 2, 2 + key % 2), key, np.float32), "y": np.int64(nation)}
                for name, every in (("x", 7), ("y", 5)):
                    if key % every == 0:
                        del parts[name]
                data = io.BytesIO()
                np.savez(data, **parts)
                write_file(path, b"no archive" if key % 11 == 0 else data.getvalue())
            yield pdf[["path"]]

    return s.mapInPandas(write, "path string")


@query("archive_flags", """
SELECT s_suppkey, s_suppkey % 11 = 0 AS unreadable, s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AS has_x, s_suppkey % 11 <> 0 AND s_suppkey % 5 <> 0 AS has_y,
  CASE WHEN s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 THEN 4 * 2 * 2 * (2 + s_suppkey % 2) ELSE 0 END AS cells, CASE WHEN s_suppkey % 11 <> 0 AND s_suppkey % 5 <> 0 THEN CAST(s_nationkey AS DOUBLE) END AS y
FROM supplier""")
def archive_flags(spark, d):
    """What the importer finds in files of real bytes, by the names of a table."""
    named = cut_lineage(written_archives(spark, d))
    found = named_payload(named).withColumn("s_suppkey", F.regexp_extract("path", "/S(\\d+)\\.npz$", 1).cast("bigint"))
    cells = F.aggregate(F.coalesce("raw_shape", F.array().cast("array<int>")), F.lit(1).cast("bigint"), lambda a, b: a * b)
    return found.select("s_suppkey", F.col("read_error").isNotNull().alias("unreadable"), "has_x", "has_y",
                        F.when(F.col("has_x"), cells).otherwise(F.lit(0)).alias("cells"), "y")


_COUNTS = ", ".join(f"count(*) FILTER (code = '{c}') AS {n}" for n, c in quality.COUNTERS.items())


@query("validation_summary", PAYLOAD + f", e AS (SELECT code FROM errs UNION ALL SELECT code FROM dups UNION ALL SELECT 'missing_file' FROM clean WHERE l_suppkey % 11 = 0 UNION ALL SELECT code FROM bad), c AS (SELECT {_COUNTS}, count(*) = 0 AS validation_passed FROM e) SELECT (SELECT count(*) FROM man) AS total_rows_scanned, (SELECT count(*) FROM clean) AS rows_validated, c.* FROM c")
def validation_summary(spark, d):
    checked = landed(checked_rows(spark, d).drop("fields"), "checked-rows")
    files = landed(listed(checked), "listing")
    errors = (
        quality.row_errors(checked).unionByName(quality.duplicate_errors(checked))
        .unionByName(quality.missing_files(checked, files, "/root"))
        .unionByName(quality.payload_errors(checked, payload(files), "/root", "residue_identity", 4, 20)))
    return quality.validation_summary(checked, errors)


@query("salvaged_rows", MAN + """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(part AS INTEGER) AS part,
  path AS sample_path, example_id, CASE WHEN merged THEN '' ELSE res_name END AS res_name
FROM man, LATERAL (SELECT unnest(range(CASE WHEN merged THEN CASE WHEN ends_with(path, '.npz') THEN 2 ELSE 0 END ELSE 1 END)) AS part) p
WHERE NOT broken""")
def salvaged_rows(spark, d):
    s = quality.salvaged(field_rows(spark, d), HEADER)
    return s.select(*[F.col(f"row_no.{c}").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                    "part", "sample_path", "example_id", "res_name")


@query("salvage_counters", MAN + "SELECT count(*) FILTER (merged AND ends_with(path, '.npz')) AS concatenated, count(*) FILTER (broken OR (merged AND NOT ends_with(path, '.npz'))) AS parse_failures FROM man")
def salvage_counters(spark, d):
    s = quality.salvage_rows(field_rows(spark, d), HEADER)
    return s.agg(F.count_if("concatenated").alias("concatenated"), F.count_if("parse_failure").alias("parse_failures"))


@query("disk_metadata", MAN + "SELECT DISTINCT example_id, structure_id, chain_id, res_no, res_name, '/root/' || path AS sample_path FROM clean WHERE l_suppkey % 11 <> 0")
def disk_metadata(spark, d):
    rows = quality.disk_rows(listing(spark, d), "/root/v", "residue_identity", "element4")
    return rows.select("example_id", "structure_id", "chain_id", "res_no", "res_name", "sample_path")


@query("example_names", MAN + "SELECT DISTINCT example_id, chain_id, res_no, res_name FROM clean")
def example_names(spark, d):
    c = checked_rows(spark, d).where(F.size("errors") == 0).select(file_stem(F.col("path")).alias("example_id")).distinct()
    return c.withColumn("m", parse_example_name(F.col("example_id"))).select("example_id", "m.chain_id", "m.res_no", "m.res_name")


PREFER = MAN.rstrip() + """,
u AS (SELECT path AS sample_path, example_id, label, row_no, l_suppkey % 3 = 0 AS disk, l_suppkey % 5 = 0 AS val,
             6 + CAST(label <> '' AS INTEGER) AS score FROM man WHERE NOT merged AND NOT broken AND path <> ''),
p AS (SELECT *, min(row_no) OVER (PARTITION BY sample_path) AS pos, row_number() OVER (PARTITION BY sample_path ORDER BY val DESC, disk DESC, score DESC, row_no) AS r FROM u),
q AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY val DESC, disk DESC, score DESC, pos) AS k FROM p WHERE r = 1)
SELECT sample_path, example_id, label FROM q WHERE k = 1"""


@query("preferred_rows", PREFER)
def preferred_rows(spark, d):
    c = quality.salvaged(field_rows(spark, d).where(F.size("fields") == len(HEADER)), HEADER).drop("part")
    rows = c.withColumns({
        "source": F.when(F.expr("row_no.l_suppkey % 3 = 0"), "disk").otherwise("manifest"),
        "validated": F.expr("row_no.l_suppkey % 5 = 0"), "pos": F.col("row_no")}).drop("row_no")
    return quality.preferred_rows(rows).select("sample_path", "example_id", "label")


@query("canonical_rows", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(CAST(trunc(l_quantity / 4) AS BIGINT) AS VARCHAR) END AS label, CASE WHEN l_linenumber = 5 THEN '' ELSE CAST(l_orderkey % 50 AS VARCHAR) END AS res_no, l_linenumber <> 3 AS valid FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)")
def canonical_rows(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    raw = li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise((F.col("l_quantity") / 4).cast("string")).alias("label"),
        F.when(F.col("l_linenumber") == 5, " ").otherwise(F.expr("concat(l_orderkey % 50, '.0')")).alias("res_no"),
        *[F.lit("a\nb").alias(c) for c in HEADER if c not in ("label", "res_no")])
    out = quality.canonical_rows(raw, "residue_identity", "element4")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "label", "res_no", "valid")


@query("label_equality", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 20 = l_suppkey % 20 AS same_class, abs(l_tax - l_discount) <= 1e-8 + 1e-5 * abs(l_discount) AS same_value FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax, l_discount FROM lineitem)")
def label_equality(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_discount").distinct()
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        labels_match(F.expr("concat(l_partkey % 20, '.0')"), F.expr("cast(l_suppkey % 20 as double)"), "residue_identity").alias("same_class"),
        labels_match(F.col("l_tax").cast("string"), F.col("l_discount"), "regression").alias("same_value"))


TEXT_HEADER = ["sample_path", "label", "example_id", "note"]


def manifest_text(spark, d):
    """A manifest of several files, each with its header; notes hold line breaks, commas and quotes."""
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").distinct()
    stem = F.concat_ws("_", F.concat(F.lit("S"), "l_orderkey"), "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    note = F.expr("CASE l_partkey % 4 WHEN 0 THEN concat('two\\nlines ', l_suppkey) WHEN 1 THEN 'said \"a, b\"\\n' WHEN 2 THEN concat('x', l_suppkey) ELSE '\\n\\n\"' END")
    rows = li.select(F.concat(stem, F.lit(".npz")).alias("sample_path"), F.when(F.expr("l_orderkey % 83 = 0"), "").otherwise(F.expr("cast(l_partkey % 20 as string)")).alias("label"), stem.alias("example_id"), note.alias("note"))
    path = fresh_dir(spark, "manifest")
    files = max(5, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write_csv(rows.repartition(files, "example_id"), path)
    return path


TEXT = """
WITH li AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem),
t AS (SELECT 'S' || l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber || '_' || l_returnflag AS example_id, CASE WHEN l_orderkey % 83 = 0 THEN '' ELSE CAST(l_partkey % 20 AS VARCHAR) END AS label,
             CASE l_partkey % 4 WHEN 0 THEN 'two' || chr(10) || 'lines ' || l_suppkey WHEN 1 THEN 'said "a, b"' || chr(10) WHEN 2 THEN 'x' || l_suppkey ELSE chr(10) || chr(10) || '"' END AS note FROM li)
"""


@query("manifest_records", TEXT + "SELECT example_id || '.npz' AS sample_path, label, example_id, note FROM t")
def manifest_records(spark, d):
    """Records of manifest text with line breaks in quotes, as fields."""
    header, rows = manifest_fields(spark, manifest_text(spark, d))
    return rows.select(*[F.get("fields", F.lit(header.index(c))).alias(c) for c in TEXT_HEADER])


@query("text_validation", TEXT + "SELECT count(*) AS total_rows_scanned, count(*) FILTER (label <> '') AS rows_validated, 0 AS corrupted_rows, count(*) FILTER (label = '') AS empty_labels FROM t")
def text_validation(spark, d):
    """The validation job over manifest text of several files."""
    summary, errors = validate_manifest(spark, manifest_text(spark, d), "/none", check_files=False)
    empty = errors.agg(F.count_if(F.col("code") == "empty_label").alias("empty_labels"))
    return summary.select("total_rows_scanned", "rows_validated", "corrupted_rows").crossJoin(F.broadcast(empty))  # one row each


REPAIR = MAN.rstrip() + """,
old AS (SELECT example_id, path, row_no FROM man WHERE NOT merged AND NOT broken
        UNION ALL SELECT example_id, path, row_no FROM man, (SELECT unnest([1, 2])) WHERE merged AND ends_with(path, '.npz')),
disk AS (SELECT DISTINCT example_id, '/root/' || path AS path FROM clean WHERE l_suppkey % 11 <> 0),
named AS (SELECT example_id FROM old WHERE path <> '' UNION ALL SELECT example_id FROM disk),
n AS (SELECT (SELECT count(*) FROM disk) AS disk, (SELECT count(*) FROM old) AS salvaged, (SELECT count(*) FROM named) AS named,
             (SELECT count(DISTINCT example_id) FROM named) AS kept, (SELECT count(*) FILTER (merged AND ends_with(path, '.npz')) FROM man) AS joined,
             (SELECT count(*) FILTER (broken OR (merged AND NOT ends_with(path, '.npz'))) FROM man) AS failed)
SELECT disk AS files_discovered_on_disk, disk AS rows_recovered_from_disk, salvaged AS rows_salvaged_from_manifest, named - kept AS duplicates_removed,
       kept - disk AS invalid_files_skipped, disk AS rows_written, 0 AS rows_missing_metadata, joined AS likely_concatenated_rows_detected, failed AS parse_failures FROM n"""


@query("repair_counters", REPAIR)
def repair_counters(spark, d):
    """The nine counters of a repair, observed in the two jobs that land its rows."""
    files = landed(listing(spark, d), "listed-files")
    found = quality.salvage_rows(field_rows(spark, d), HEADER)
    merged, counted = salvaged_sources(found, quality.disk_rows(files, "/root/v", "residue_identity", "element4"))
    _, ends = repaired_rows(merged, files, "residue_identity", "element4", dedupe=True)
    return spark.createDataFrame([repair_summary(counted, ends, True)])


# ---- activity --------------------------------------------------------------

def activity_input(spark, d):
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").alias("row_no"), F.expr("concat('S', o_orderkey % 120)").alias("structure_id"),
        F.expr("CASE WHEN c_nationkey % 3 = 0 THEN 'A' WHEN c_nationkey % 3 = 1 THEN 'N' END").alias("chain_id"),
        F.expr("CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE cast(o_custkey % 50 as string) END").alias("res_no"),
        F.col("o_orderpriority").alias("mutation"), (F.col("o_totalprice") / 1000.0).cast("string").alias("activity_value"))


ACTIVITY = """
act AS (
  SELECT o_orderkey AS row_no, 'S' || (o_orderkey % 120) AS structure_id,
         CASE WHEN c_nationkey % 3 = 0 THEN 'A' WHEN c_nationkey % 3 = 1 THEN 'N' END AS chain,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS INTEGER) END AS pos,
         row_number() OVER (PARTITION BY o_orderkey % 120 ORDER BY o_orderkey) - 1 AS ordinal
  FROM orders JOIN customer ON o_custkey = c_custkey),
hits AS (
  SELECT a.row_no, any_value(a.structure_id) AS structure_id, any_value(a.ordinal) AS ordinal, count(r.res_no) AS n, any_value(r.chain_id) AS chain_id,
         any_value(r.res_no) AS res_no, any_value(r.res_name) AS res_name
  FROM act a LEFT JOIN (SELECT DISTINCT structure_id, chain_id, res_no, res_name FROM atoms) r
    ON r.structure_id = a.structure_id AND r.res_no = a.pos AND (a.chain IS NULL OR r.chain_id = a.chain)
  GROUP BY 1),
judged AS (
  SELECT h.*, CASE WHEN s_suppkey IS NULL THEN 'missing_structure' WHEN n <> 1 THEN 'missing_residue' END AS skip
  FROM hits h LEFT JOIN supplier ON 'S' || s_suppkey = h.structure_id)"""


def structures(spark, d):
    return V.table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("structure_id"))


def matched_activity(spark, d):
    rows = activity.with_ordinals(activity.activity_rows(activity_input(spark, d)))
    known = activity.match_structures(rows, structures(spark, d))
    return activity.match_residues(known, residues_from_atoms(V.atoms(spark, d)))


@query("activity_sites", V.with_sql(V.ATOMS, ACTIVITY) + "SELECT row_no, structure_id || '_' || chain_id || '_' || res_no || '_' || ordinal AS example_id, res_name FROM judged WHERE skip IS NULL")
def activity_sites(spark, d):
    return activity.site_examples(matched_activity(spark, d)).select("row_no", "example_id", "res_name")


@query("activity_skips", V.with_sql(V.ATOMS, ACTIVITY) + "SELECT skip, count(*) AS n FROM judged WHERE skip IS NOT NULL GROUP BY 1")
def activity_skips(spark, d):
    return matched_activity(spark, d).where("skip is not null").groupBy("skip").agg(F.count("*").alias("n"))


@query("activity_values", "SELECT o_orderkey AS row_no, 'S' || (o_orderkey % 120) AS structure_id, CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_custkey % 50 AS INTEGER) ELSE -1 END AS res_no, o_orderpriority AS mutation, round(CAST(o_totalprice AS DOUBLE) / 1000, 6) AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def activity_values(spark, d):
    rows = activity.activity_rows(activity_input(spark, d))
    return V.rounded(rows.select("row_no", "structure_id", F.coalesce("res_no", F.lit(-1)).alias("res_no"), "mutation", "value"), 6, "value")


BUILT = V.with_sql(V.BOXED, ACTIVITY) + """,
sums AS (SELECT structure_id, chain_id, res_no, res_name, CAST(sum(v) AS BIGINT) AS atoms FROM voxels GROUP BY ALL)
SELECT j.row_no, j.structure_id || '_' || j.chain_id || '_' || j.res_no || '_' || j.ordinal AS example_id, atoms
FROM judged j JOIN sums s ON s.structure_id = j.structure_id AND s.chain_id = j.chain_id AND s.res_no = j.res_no AND s.res_name = j.res_name
WHERE skip IS NULL"""


@query("activity_examples", BUILT)
def activity_examples(spark, d):
    s = structures(spark, d)
    built = build_activity(V.atoms(spark, d), s, activity_input(spark, d), VoxelConfig(template="backbone"))
    return built.packed.select("row_no", "example_id", F.col("atom_count").cast("bigint").alias("atoms"))


# ---- accessibility ---------------------------------------------------------

def site_predictions(spark, d):
    """Predictions whose sites match a manifest exactly, loosely or not."""
    o = V.table(spark, d, "orders")
    res = V.pick(K.RESIDUES, F.expr("(o_orderkey % 23 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 20"))
    site = F.when(F.expr("o_orderkey % 41 = 0"), "no site").otherwise(
        F.concat_ws(":", F.lit("A"), F.expr("cast(o_orderkey % 23 as string)"), res))
    return o.select(
        F.col("o_orderkey").alias("pred"), F.expr("concat('S', o_custkey % 30)").alias("structure_name"), site.alias("site"),
        V.pick(K.TITLE_NAMES, F.expr("o_orderkey % 20")).alias("actual"),
        V.pick(K.TITLE_NAMES, F.expr("(o_orderkey + o_custkey % 3) % 20")).alias("predicted"),
        F.array(*[V.pick(K.TITLE_NAMES, F.expr(f"(o_orderkey + (o_custkey + {i} * 2) % 7) % 20")) for i in range(5)]).alias("topk"))


def site_table(spark, d):
    s = V.table(spark, d, "customer")
    return s.select(
        F.col("c_custkey").alias("row_no"), F.expr("concat('S', c_custkey % 25)").alias("structure_id"), F.lit("A").alias("chain_id"),
        F.expr("cast(c_nationkey % 23 as string)").alias("res_no"), F.lower(V.pick(K.RESIDUES, F.expr("c_nationkey % 20"))).alias("res_name")
    )  # structures S25 to S29 of the predictions have no row here


ACCESS = f"""
pred AS (
  SELECT o_orderkey AS pred, 'S' || (o_custkey % 30) AS s, CAST(o_orderkey % 23 AS VARCHAR) AS n,
         {V.RES}[CAST((o_orderkey % 23 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 20 AS INTEGER) + 1] AS r,
         o_orderkey % 41 = 0 AS invalid, {V.TITLES}[CAST(o_orderkey % 20 AS INTEGER) + 1] AS actual,
         {V.TITLES}[CAST((o_orderkey + o_custkey % 3) % 20 AS INTEGER) + 1] AS predicted,
         [{', '.join(f"{V.TITLES}[CAST((o_orderkey + (o_custkey + {i} * 2) % 7) % 20 AS INTEGER) + 1]" for i in range(5))}] AS topk
  FROM orders),
man AS (
  SELECT c_custkey AS row_no, 'S' || (c_custkey % 25) AS s, CAST(c_nationkey % 23 AS VARCHAR) AS n,
         {V.RES}[CAST(c_nationkey % 20 AS INTEGER) + 1] AS r FROM customer),
loose AS (SELECT s, n, count(*) AS k, any_value(r) AS lone FROM man GROUP BY 1, 2),
status AS (
  SELECT p.*, CASE WHEN invalid THEN 'invalid_site' WHEN e.s IS NOT NULL THEN 'exact' WHEN k = 1 THEN 'fallback'
                   WHEN k > 1 THEN 'ambiguous' ELSE 'no_match' END AS status, lone
  FROM pred p LEFT JOIN (SELECT DISTINCT s, n, r FROM man) e ON e.s = p.s AND e.n = p.n AND e.r = p.r
       LEFT JOIN loose l ON l.s = p.s AND l.n = p.n),
matched AS (SELECT *, CASE WHEN status = 'fallback' THEN lone ELSE r END AS res_name, status IN ('exact', 'fallback') AS ok,
                   status = 'fallback' AND lone <> r AS warning FROM status),
score AS (SELECT 'S' || (s_suppkey % 30) AS s, CAST(s_nationkey % 23 AS VARCHAR) AS n, {V.RES}[CAST(s_nationkey % 20 AS INTEGER) + 1] AS r,
                 max(s_acctbal) AS total FROM supplier GROUP BY ALL),
final AS (SELECT m.*, total FROM matched m LEFT JOIN score c ON m.ok AND c.s = m.s AND c.n = m.n AND c.r = m.res_name)"""
ACC = V.with_sql(ACCESS)


def matched_predictions(spark, d):
    return access.match_predictions(site_predictions(spark, d), site_table(spark, d))


def score_table(spark, d):
    s = V.table(spark, d, "supplier")
    keyed_scores = s.groupBy(
        F.expr("concat('S', s_suppkey % 30)").alias("structure_id"), F.lit("A").alias("chain_id"),
        F.expr("cast(s_nationkey % 23 as string)").alias("res_no"), V.pick(K.RESIDUES, F.expr("s_nationkey % 20")).alias("res_name")
    ).agg(F.max("s_acctbal").alias("abs_total"))
    return keyed_scores.withColumn("rel_total", F.col("abs_total") / 250.0)


def annotated(spark, d):
    return access.annotate(matched_predictions(spark, d), score_table(spark, d), "absolute", "total")


@query("matched_predictions", ACC + "SELECT pred, status, coalesce(warning, false) AS warning, CASE WHEN invalid THEN NULL ELSE res_name END AS res_name FROM matched")
def matched_prediction_rows(spark, d):
    return matched_predictions(spark, d).select("pred", "status", F.coalesce("warning", F.lit(False)).alias("warning"), "res_name")


@query("annotated_predictions", ACC + "SELECT pred, round(total, 2) AS sasa_selected FROM final")
def annotated_predictions(spark, d):
    return V.rounded(annotated(spark, d).select("pred", "sasa_selected"), 2, "sasa_selected")


@query("missing_scores", ACC + "SELECT DISTINCT s AS structure_id, n AS res_no, res_name FROM final WHERE ok AND total IS NULL")
def missing_scores(spark, d):
    """Against a bucketed cache, which is joined where it lies."""
    wanted = access.requested_residues(matched_predictions(spark, d))
    path = fresh_dir(spark, "cache")
    cache = access.write_cache(score_table(spark, d), path.split("/")[-1].replace("-", "_"), path, 8)
    return access.missing_from_cache(wanted, cache, 8).select("structure_id", "res_no", "res_name")


@query("requested_scores", ACC + "SELECT DISTINCT s AS structure_id, n AS res_no, res_name, round(total, 2) AS abs_total FROM final WHERE ok AND total IS NOT NULL")
def requested_scores(spark, d):
    wanted = access.requested_residues(matched_predictions(spark, d))
    kept = access.reduce_to_requested(score_table(spark, d), wanted)
    return V.rounded(kept.select("structure_id", "res_no", "res_name", "abs_total"), 2, "abs_total")


@query("match_summary", ACC + """SELECT count(*) AS total_prediction_rows, count(*) FILTER (ok) AS matched_residues, count(*) FILTER (NOT ok) AS unmatched_residues,
  count(total) AS residues_scored, count(*) FILTER (warning) AS fallback_warnings,
  (SELECT count(*) FROM (SELECT DISTINCT s, n, res_name FROM final WHERE ok AND total IS NULL)) AS missing_residues_reported FROM final""")
def match_summary(spark, d):
    return access.match_summary(cut_lineage(annotated(spark, d)))


def measured(spark, d):
    li = V.table(spark, d, "lineitem")
    named = V.pick(K.TITLE_NAMES, F.expr("l_partkey % 20"))
    guess = V.pick(K.TITLE_NAMES, F.expr("(l_partkey + CASE WHEN l_linenumber <= 3 THEN 0 ELSE 1 END) % 20"))
    return li.select(
        F.col("l_extendedprice").alias("sasa_selected"), named.alias("actual"), guess.alias("predicted"),
        F.array(*[V.pick(K.TITLE_NAMES, F.expr(f"(l_partkey + (l_linenumber + {i}) % 7) % 20")) for i in range(5)]).alias("topk"))


MEASURED = f"""
meas AS (
  SELECT l_extendedprice AS v, l_linenumber <= 3 AS h1, list_contains([(l_linenumber + i) % 7 FOR i IN range(3)], 0) AS h3,
         list_contains([(l_linenumber + i) % 7 FOR i IN range(5)], 0) AS h5 FROM lineitem),
span AS (SELECT min(v) AS lo, max(v) AS hi FROM meas)"""


def binned_sql(edges: str) -> str:
    return V.with_sql(MEASURED) + f""",
e AS ({edges}),
b AS (SELECT least(len(list_filter(edges, lambda x: x <= v)) - 1, len(edges) - 2) AS bin_index, h1, h3, h5 FROM meas, e),
c AS (SELECT bin_index, count(*) AS support, avg(CAST(h1 AS INTEGER)) AS a1, avg(CAST(h3 AS INTEGER)) AS a3, avg(CAST(h5 AS INTEGER)) AS a5 FROM b WHERE bin_index >= 0 GROUP BY 1),
f AS (SELECT CAST(i AS INTEGER) AS bin_index, edges[i + 1] AS bin_left, edges[i + 2] AS bin_right FROM e, LATERAL (SELECT unnest(range(len(edges) - 1)) AS i) x)
SELECT f.bin_index, round(bin_left, 4) AS bin_left, round(bin_right, 4) AS bin_right, coalesce(support, 0) AS support,
       round(a1, 6) AS top1_accuracy, round(a3, 6) AS top3_accuracy, round(a5, 6) AS top5_accuracy
FROM f LEFT JOIN c ON c.bin_index = f.bin_index"""


def binned(spark, d, mode, bins=10, custom=None):
    m = measured(spark, d)
    out = access.binned_accuracy(m, access.bin_edges(m, "sasa_selected", mode, bins, custom))
    out = V.rounded(out, 4, "bin_left", "bin_right")
    return V.rounded(out, 6, "top1_accuracy", "top3_accuracy", "top5_accuracy")


@query("equal_width_bins", binned_sql("SELECT list_append([lo + i * ((hi - lo) / 10.0e0) FOR i IN range(10)], hi) AS edges FROM span"))
def equal_width_bins(spark, d):
    return binned(spark, d, "equal_width")


@query("equal_frequency_bins", binned_sql("SELECT list_distinct(list_sort([" + ", ".join(f"quantile_cont(v, {i / 10})" for i in range(11)) + "])) AS edges FROM meas").replace("list_distinct(list_sort(", "list_sort(list_distinct("))
def equal_frequency_bins(spark, d):
    return binned(spark, d, "equal_frequency")


@query("custom_bins", binned_sql("SELECT [20000.0e0, 40000.0e0, 50000.0e0, 90000.0e0] AS edges"))
def custom_bins(spark, d):
    return binned(spark, d, "custom", custom=[20000.0, 40000.0, 50000.0, 90000.0])


@query("bin_labels", "SELECT s_suppkey, printf('[%.2f, %.2f)', s_acctbal, s_acctbal + 1000) AS text FROM supplier")
def bin_label_rows(spark, d):
    s = V.table(spark, d, "supplier")
    return s.select("s_suppkey", F.get(bin_labels(F.array("s_acctbal", F.col("s_acctbal") + 1000)), F.lit(0)).alias("text"))


@query("correctness_groups", V.with_sql(MEASURED) + """,
g AS (SELECT unnest(['Top1 ' || CASE WHEN h1 THEN 'Correct' ELSE 'Incorrect' END, 'Top3 ' || CASE WHEN h3 THEN 'Correct' ELSE 'Incorrect' END,
                     'Top5 ' || CASE WHEN h5 THEN 'Correct' ELSE 'Incorrect' END]) AS grp, v FROM meas)
SELECT grp, count(*) AS n, round(avg(v), 4) AS mean, round(min(v), 4) AS low, round(max(v), 4) AS high, round(quantile_cont(v, 0.25), 4) AS q1,
       round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3 FROM g GROUP BY 1""")
def correctness_groups(spark, d):
    s = access.group_summary(access.correctness_groups(measured(spark, d)))
    return V.rounded(s, 4, "mean", "low", "high", "q1", "median", "q3")


@query("topk_labels", """
WITH parts AS (SELECT o_orderkey, str_split(upper(o_orderpriority) || '| ' || lower(o_orderstatus) || 'la |  ||x' || o_custkey, '|') AS p FROM orders)
SELECT o_orderkey, array_to_string([upper(left(trim(t), 1)) || lower(substr(trim(t), 2, 2)) FOR t IN p IF trim(t) <> ''], '|') AS labels FROM parts""")
def topk_label_rows(spark, d):
    text = F.concat(F.upper("o_orderpriority"), F.lit("| "), F.lower("o_orderstatus"), F.lit("la |  ||x"), F.col("o_custkey").cast("string"))
    return V.table(spark, d, "orders").select("o_orderkey", F.array_join(access.topk_labels(text), "|").alias("labels"))


# ---- incremental -----------------------------------------------------------

@query("config_fingerprints", "SELECT p_size, left(sha256('{\"box\":\"' || p_size || '\",\"scheme\":\"element4\"}'), 16) AS tag FROM (SELECT DISTINCT p_size FROM part)")
def config_fingerprints(spark, d):
    p = V.table(spark, d, "part").select("p_size").distinct()
    return p.select("p_size", config_fingerprint({"scheme": "element4", "box": F.col("p_size")}).alias("tag"))


@query("reconciled_accessions", "SELECT CAST(c_custkey AS VARCHAR) AS accession, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS landed FROM customer")
def reconciled_accessions(spark, d):
    wanted = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("accession"))
    files = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("/in/AF-"), "o_custkey", F.lit("-F1-model_v6.pdb")).alias("path"))
    landed, missing = reconcile_accessions(wanted, files)
    return landed.withColumn("landed", F.lit(True)).unionByName(missing.withColumn("landed", F.lit(False)))


@query("accession_ledgers", """
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS accession, c_nationkey >= 12 AS late,
                  EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS f,
                  EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('F', 'O')) AS fo FROM customer)
SELECT accession, CAST(CASE WHEN f AND NOT late THEN 0 WHEN fo THEN 1 END AS BIGINT) AS batch FROM c""")
def accession_ledgers(spark, d):
    """Two batches of accessions, the first run twice; what it could not get is asked for again in the second."""
    out = fresh_dir(spark, "ledgers")
    wanted = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("accession"), (F.col("c_nationkey") >= 12).alias("late"))
    listed = V.table(spark, d, "orders").select("o_orderstatus", F.concat(F.lit("/in/AF-"), "o_custkey", F.lit("-F1-model_v6.pdb")).alias("path"))
    first = wanted.where(~F.col("late")), listed.where("o_orderstatus = 'F'"), 0
    for rows, files, batch in (first, first, (wanted.where("late"), listed.where("o_orderstatus in ('F', 'O')"), 1)):
        append_ledgers(rows, files, batch, out)
    got, missing = ledgers(spark, out)
    return got.unionByName(missing.withColumn("batch", F.lit(None).cast("bigint")))


@query("incremental_structures", "SELECT 'S' || l_suppkey AS structure_id, count(*) AS n_rows FROM lineitem GROUP BY 1")
def incremental_structures(spark, d):
    """Two streaming runs over the same rows: the second finds nothing new."""
    out = fresh_dir(spark, "incremental")
    source = V.table(spark, d, "lineitem")
    totals = source.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("structure_id")).agg(F.count("*").alias("n_rows"))
    totals.withColumn("pdb_path", F.col("structure_id")).write.parquet(f"{out}/in")
    build = lambda rows: rows.select("structure_id", "n_rows")
    tag = None
    for _ in range(2):
        stream = spark.readStream.schema("structure_id string, n_rows bigint, pdb_path string").parquet(f"{out}/in")
        tag = run_incremental(spark, stream, out, {"box": 20}, build)
    return spark.read.parquet(f"{out}/samples").where(F.col("fingerprint") == tag).select("structure_id", "n_rows")
