"""Sources and sinks: ragged yearly CSVs, unreadable file, caps, lookups."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from leadtime.sources import files as S
from leadtime.sources.sinks import write_table


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_union_by_name_ragged_and_bad_file(spark):
    d = tempfile.mkdtemp(prefix="lt-csv-")
    _write(os.path.join(d, "FY2021-cases-a.csv"), "a,b\n1,2\n3,4\n")
    _write(os.path.join(d, "FY2022-cases-b.csv"), "b,a\n20,10\n")           # same columns, other order
    _write(os.path.join(d, "FY2023-cases-c.csv"), "a,b,c\n5,6,7\n")         # extra column
    _write(os.path.join(d, "FY2024-cases-d.csv"), "")                        # unreadable: no header
    df = S.scan_multi_file_union(spark, os.path.join(d, "FY*-cases-*.csv"))
    got = sorted((r.fiscal_year, r.a, r.b, r.c) for r in df.collect())
    assert got == [("2021", "1", "2", None), ("2021", "3", "4", None), ("2022", "10", "20", None),
                   ("2023", "5", "6", "7")]


def test_caps_and_head(spark):
    df = spark.createDataFrame([("g1", f"k{i}") for i in range(50)] + [("g2", "x")], "g string, k string")
    capped = S.sample_capped_per_group(df, "g", 10, "k")
    counts = {r.g: r["count"] for r in capped.groupBy("g").count().collect()}
    assert counts == {"g1": 10, "g2": 1}
    assert S.scan_random_cap(df, 7, "k").count() == 7
    assert [r.k for r in S.scan_head(df, 3, "k").collect()] == ["k0", "k1", "k10"]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1", "x"), ("2.5", "3"), (None, "4")], "n string, m string")
    out = S.coerce_numeric_columns(df)
    assert dict(out.dtypes) == {"n": "double", "m": "string"}


def test_lookups_and_write(spark):
    d = tempfile.mkdtemp(prefix="lt-lk-")
    _write(os.path.join(d, "status.csv"), "code,label\n1,a\n2,b\n")
    lk = S.load_lookups(spark, d, ["status.csv", "origin.csv"])
    assert list(lk) == ["status.csv"]
    assert S.lookup_counts(lk).first()["rows"] == 2
    out = os.path.join(tempfile.mkdtemp(prefix="lt-w-"), "t")
    assert write_table(spark.range(5).withColumn("p", F.col("id") % 2), out, partition_by="p").first()["rows"] == 5


def test_capped_sample_exact_on_both_paths(spark):
    from leadtime.functions.keys import hash_order
    rows = [("hot", f"k{i}") for i in range(3000)] + [("mid", f"m{i}") for i in range(40)] + [("cold", "c0")]
    df = spark.createDataFrame(rows, "g string, k string")
    h = df.withColumn("_h", hash_order("k", "42")).collect()
    want = {}
    for g in ("hot", "mid", "cold"):
        ks = sorted((r._h, r.k) for r in h if r.g == g)[:25]
        want[g] = sorted(k for _, k in ks)
    for margin in (0.1, -0.9):                      # -0.9 starves the threshold: exact fallback path
        out = S.sample_capped_per_group(df, "g", 25, "k", margin=margin).collect()
        got = {g: sorted(r.k for r in out if r.g == g) for g in ("hot", "mid", "cold")}
        assert got == want


def test_random_cap_large_path_equals_small_path(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(400)], "k string")
    small = sorted(r.k for r in S.scan_random_cap(df, 150, "k").collect())
    large = sorted(r.k for r in S.scan_random_cap(df, 150, "k", margin=-3).collect())  # no row is under the threshold
    assert small == large and len(small) == 150


def test_file_without_table_is_listed_and_storage_errors_raise(spark, tmp_path):
    _write(tmp_path / "FY2021-a.csv", "a,b\n1,2\n")
    _write(tmp_path / "FY2022-b.csv", "")
    _write(tmp_path / "FY2023-c.csv", "\n\n")
    got = S.skipped_files(spark, str(tmp_path / "FY*.csv")).collect()
    assert [(r.path.split("/")[-1], r.reason) for r in got] == [("FY2022-b.csv", "no header line"), ("FY2023-c.csv", "no header line")]
    with pytest.raises(Exception, match="FileNotFound|does not exist"):
        S.scan_multi_file_union(spark, [str(tmp_path / "FY2024-gone.csv")])


def test_tag_is_read_from_the_file_name(spark, tmp_path):
    d = tmp_path / "FY1999-old"
    d.mkdir()
    _write(d / "FY2021-x-1.csv", "a\n1\n")
    _write(d / "plain.csv", "a\n2\n")
    _write(d / "part-0000.csv", "a\n3\n")
    got = {r.a: r.fiscal_year for r in S.scan_multi_file_union(spark, [str(p) for p in sorted(d.iterdir())]).collect()}
    assert got == {"1": "2021", "2": None, "3": "1999"}


def test_null_groups_and_null_keys_stay(spark):
    rows = [(None, f"k{i}") for i in range(30)] + [("g", "x"), (None, None)]
    df = spark.createDataFrame(rows, "g string, k string")
    assert S.sample_capped_per_group(df, "g", 100, "k").count() == 32
    capped = S.sample_capped_per_group(df, "g", 5, "k").collect()
    assert sorted(str(r.g) for r in capped) == ["None"] * 5 + ["g"]
    assert S.scan_random_cap(df, 100, "k").count() == 32 and S.scan_random_cap(df, 10, "k").count() == 10


def test_random_cap_is_one_order_for_every_size(spark):
    from leadtime.functions.keys import hash_order
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    want = [r.k for r in df.withColumn("h", hash_order("k", "42")).orderBy("h", "k").limit(50).collect()]
    assert sorted(r.k for r in S.scan_random_cap(df, 50, "k").collect()) == sorted(want)


def test_lookup_names_are_exact(spark, tmp_path):
    _write(tmp_path / "status.csv", "code\n1\n")
    _write(tmp_path / "status_old.csv", "code\n2\n3\n")
    assert S.load_lookups(spark, str(tmp_path), ["status"])["status"].count() == 1


def test_nan_is_missing_on_ingest(spark):
    df = spark.createDataFrame([("NaN",), ("1.5",)], "n string")
    assert sorted(str(r.n) for r in S.coerce_numeric_columns(df).collect()) == ["1.5", "None"]
