from pyspark.sql import functions as F

from voxlake.catalog import manifests
from voxlake.functions.columns import number_in, sanitize
from voxlake.operators.quality import duplicate_errors

TEXTS = ["", " ", "5", " 5 ", "\t5\n", "+5", "-7", "5.0", ".5", "5.", "1e3", "1E400", "NaN", "nan", "Infinity", "-inf", "1d", "1f", "0x10", "x", "A", "1_0", "99999999999", "9223372036854775808", "--5", "5 5", "٥", None]


def test_numbers_are_those_of_a_try_cast(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for kind in ("int", "bigint", "double"):
        for r in rows.select("t", number_in(F.col("t"), kind).alias("got"), F.col("t").try_cast(kind).alias("want")).collect():
            assert repr(r["got"]) == repr(r["want"]), (kind, r)
    clean = spark.createDataFrame([(" a\r\nb\n",)], "t string").select(sanitize(F.col("t")).alias("t")).first()["t"]
    assert clean == "a  b"


def test_later_rows_of_a_key_are_duplicates(spark):
    rows = [(i, "p" if i % 3 else f"q{i}", f"e{i // 2}", "S", "A", str(i), "ALA", []) for i in range(9)] + [(9, "p", "e0", "S", "A", "1", "ALA", ["bad"])]
    checked = spark.createDataFrame(rows, "row_no long, path string, example_id string, structure_id string, chain_id string, res_no string, res_name string, errors array<string>")
    got = sorted((r["row_no"], r["code"]) for r in duplicate_errors(checked).collect())
    assert got == sorted([(i, "duplicate_path") for i in (2, 4, 5, 7, 8)] + [(i, "duplicate_example_id") for i in (1, 3, 5, 7)])


def test_manifest_files_grow_with_the_partitions(spark, tmp_path):
    spark.range(64).selectExpr("id l_orderkey", "id l_partkey", "id l_suppkey", "1 l_linenumber", "'A' l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    path = manifests.manifest_text(spark, str(tmp_path))
    assert spark.read.text(path).select("_metadata.file_path").distinct().count() > 5
