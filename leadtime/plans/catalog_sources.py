"""Registered checks for sources and sinks (§2.1).

Source checks first write files that Spark derives from the driver tables (yearly CSV files
with differing headers, lookup CSVs) into the shared scratch folder, then read them back with
the operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..roles import cases, read_table
from ..session import scratch_path
from ..sources import files as S
from ..sources.sinks import write_table
from .registry import kept_valid, register, valid
from .catalog_stats import _hash_sql


def yearly_files(spark, sf) -> str:
    """One CSV folder per fiscal year named FY<year>-cases.csv; odd years use another column
    order and an extra column and lack ``region`` (ragged headers)."""
    root = scratch_path(spark, "yearly")
    v = kept_valid(spark, sf, "case_id", "office", "region", "status", "fiscal_year")
    years = [r[0] for r in v.select("fiscal_year").distinct().collect()]   # a handful of values
    for y in years:
        part = v.filter(F.col("fiscal_year") == y)
        if y % 2 == 0:
            part = part.select("case_id", "office", "region", "status")
        else:
            part = part.select("status", "case_id", F.lit("x").alias("extra"), "office")
        part.write.mode("overwrite").option("header", True).csv(f"{root}/FY{y}-cases.csv")
    return root


@register("scan_multi_file_union", """
SELECT case_id, CAST(fiscal_year AS VARCHAR) AS fiscal_year, office,
       CASE WHEN fiscal_year % 2 = 0 THEN region END AS region, status,
       CASE WHEN fiscal_year % 2 = 1 THEN 'x' END AS extra FROM valid""")
def q_multi_union(spark, sf):
    root = yearly_files(spark, sf)
    return S.scan_multi_file_union(spark, f"{root}/FY*-cases.csv").select(
        "case_id", "fiscal_year", "office", "region", "status", "extra")


@register("sample_capped_per_group", f"""
SELECT case_id, fiscal_year FROM (
  SELECT case_id, fiscal_year, row_number() OVER (PARTITION BY fiscal_year ORDER BY {_hash_sql('case_id')}, case_id) AS rn
  FROM valid) WHERE rn <= 2000""")
def q_capped(spark, sf):
    return S.sample_capped_per_group(valid(spark, sf).select("case_id", "fiscal_year"), "fiscal_year", 2000, "case_id")


@register("scan_random_cap", f"SELECT case_id FROM valid ORDER BY {_hash_sql('case_id')}, case_id LIMIT 5000")
def q_random_cap(spark, sf):
    return S.scan_random_cap(valid(spark, sf).select("case_id"), 5000, "case_id")


@register("scan_head", "SELECT case_id, office FROM cases ORDER BY case_id LIMIT 1000", ctes=("cases",))
def q_head(spark, sf):
    return S.scan_head(cases(spark, sf).select("case_id", "office"), 1000, "case_id")


@register("load_lookups", """
SELECT 'nation.csv' AS lookup, count(*) AS rows FROM nation UNION ALL SELECT 'region.csv', count(*) FROM region
UNION ALL SELECT 'supplier.csv', count(*) FROM supplier""", ctes=())
def q_lookups(spark, sf):
    root = scratch_path(spark, "lookups")
    for t in ("nation", "region", "supplier"):
        read_table(spark, sf, t).write.mode("overwrite").option("header", True).csv(f"{root}/{t}.csv")
    lk = S.load_lookups(spark, root, ["status.csv", "nation.csv", "region.csv", "origin.csv", "supplier.csv"])
    return S.lookup_counts(lk)


@register("scan_pruned_columns", """
SELECT office, dense_rank() OVER (ORDER BY office) - 1 AS code FROM (
  SELECT DISTINCT office FROM cases WHERE office IS NOT NULL AND submit_ts IS NOT NULL)""", ctes=("cases",))
def q_pruned(spark, sf):
    return S.scan_pruned_columns(cases(spark, sf), "office", "submit_ts")


@register("coerce_numeric_columns", """
SELECT case_id, CASE WHEN priority = '4-NOT SPECIFIED' THEN 'X' || CAST(case_no AS VARCHAR) ELSE CAST(case_no AS VARCHAR) END AS case_text,
       CAST(CAST(quantity AS VARCHAR) AS DOUBLE) AS qty_text FROM cases""", ctes=("cases",))
def q_coerce(spark, sf):
    c = cases(spark, sf).select(
        "case_id",
        F.when(F.col("priority") == "4-NOT SPECIFIED", F.concat(F.lit("X"), F.col("case_no").cast("string")))
         .otherwise(F.col("case_no").cast("string")).alias("case_text"),
        F.col("quantity").cast("string").alias("qty_text"))
    return S.coerce_numeric_columns(c, ["case_text", "qty_text"])


@register("write_table", "SELECT count(*) AS rows FROM valid")
def q_write(spark, sf):
    path = scratch_path(spark, "written")
    return write_table(valid(spark, sf), path, "parquet", partition_by="fiscal_year")
