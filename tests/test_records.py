"""Records with quoted line breaks, over many splits and files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from voxlake.constants import SITE_FIELDS
from voxlake.functions.columns import ManifestError
from voxlake.operators import quality
from voxlake.plans import checks
from voxlake.sources.records import ends_inside, read_records
from voxlake.sources.sinks import write_csv


def parsed(spark, path):
    rows = quality.with_fields(read_records(spark, path)).orderBy("row_no").collect()
    return [r["fields"] for r in rows]


@pytest.mark.parametrize("seed", [0, 2])
def test_records_equal_a_sequential_reader(spark, tmp_path, seed):
    rnd = random.Random(seed)
    words = ["a", "", "x,y", 'say ""', "two\nlines", "\n\n", '"', "z" * 50, ',"', "end\n"]
    files = []
    for k in range(3):
        rows = [[rnd.choice(words) for _ in range(rnd.randrange(2, 6))] for _ in range(rnd.randrange(1, 120))]
        out = io.StringIO()
        csv.writer(out, quoting=rnd.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator="\n").writerows(rows)
        (tmp_path / f"part-{k}.csv").write_text(out.getvalue())
        files += list(csv.reader(io.StringIO(out.getvalue(), newline="")))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = parsed(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep[0])
        spark.conf.set("spark.sql.files.openCostInBytes", keep[1])
    assert got == files


def test_state_of_a_line():
    assert ends_inside('a,"b', False) and not ends_inside('a,"b', True)
    assert not ends_inside('5" wide,b', False) and ends_inside('say ""x', True)
    assert not ends_inside('"a""",b', False) and ends_inside('",", "",","', False) == ends_inside('",", "",","', False)


def sites(spark, n):
    return spark.range(n).select(*[
        {"sample_path": F.format_string("S1/S1_A_%d_ALA.npz", "id"), "res_no": F.col("id").cast("string"), "label": F.lit("0"),
         "example_id": F.format_string("S1_A_%d_ALA", "id")}.get(c, F.lit("x")).alias(c) for c in SITE_FIELDS])


def test_manifest_of_several_parts_validates(spark, tmp_path):
    path = str(tmp_path / "sites")
    write_csv(sites(spark, 6).repartition(3), path)
    summary, errors = checks.validate_manifest(spark, path, str(tmp_path), check_files=False, report=str(tmp_path / "report"))
    assert errors.collect() == []
    row = summary.first()
    assert row["total_rows_scanned"] == row["rows_validated"] == 6 and row["validation_passed"]
    report = spark.read.json(str(tmp_path / "report")).first()
    assert report["error_count"] == 0 and report["error_limit"] == quality.ERROR_LIMIT


def test_manifest_with_line_breaks_is_repaired(spark, tmp_path):
    root = tmp_path / "root"
    (root / "S1").mkdir(parents=True)
    for k in range(6):
        (root / "S1" / f"S1_A_{k}_ALA.npz").write_bytes(b"")
    path = str(tmp_path / "sites")
    broken = sites(spark, 6).withColumn("structure_id", F.lit("S\n1")).withColumn("sample_path", F.concat(F.lit(f"{root}/"), "sample_path"))
    write_csv(broken.repartition(3), path)
    rows, summary = checks.repair_manifest(spark, str(root), str(tmp_path / "out"), "residue_identity", "element4", manifest=path, dedupe=True)
    got = summary.first()
    assert got["rows_salvaged_from_manifest"] == 6 and got["parse_failures"] == 0 and got["rows_written"] == 6
    assert checks.validate_manifest(spark, str(tmp_path / "out"), str(root), check_files=False)[0].first()["total_rows_scanned"] == 6
    assert rows.count() == 6


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample_path,label\nx.npz,1\n")
    (tmp_path / "b.csv").write_text("label,sample_path\n1,x.npz\n")
    with pytest.raises(ManifestError):
        checks.manifest_fields(spark, str(tmp_path))


def test_lines_are_read_back_by_column(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"x\ny"\n')
    rows = read_records(spark, str(tmp_path / "m.csv"))
    assert sorted(r["line"] for r in rows.collect()) == ['1,"x\ny"', "a,b"]
    assert "FileScan parquet" in rows._jdf.queryExecution().toString()
