"""Data-quality profile and describe tables (§2.5, part).

Per-column statistics are fused into one aggregation and then unpivoted to one row per column.
Per-value counts (top-5 values) use a salted two-stage top-k so that a column with billions of
distinct values is never ranked inside a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .quantiles import quantiles
from .stats import nan_to_null, numeric_columns, percentile, salt_count, string_columns


def missing_by_column(df: DataFrame) -> DataFrame:
    """Count and percent of missing values (null or NaN) per column, only columns with some, by count desc."""
    cols = df.columns
    df = nan_to_null(df)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    long = wide.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("missing")) for i, c in enumerate(cols)])).alias("s"))
    return (long.select("s.column", "s.missing",
                        (F.col("s.missing") * F.lit(100.0) / F.col("_rows")).alias("missing_pct"))
                .filter(F.col("missing") > 0).orderBy(F.desc("missing"), "column"))


def numeric_describe(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max per numeric column; NaN is missing.  One pass for the moments;
    quartiles are exact and distributed (``exact=False``: sketches in that one pass)."""
    cols = cols or numeric_columns(df)
    df = nan_to_null(df)
    probs = (0.25, 0.5, 0.75)
    structs = []
    for c in cols:
        x = F.col(c).cast("double")
        q = [] if exact else [percentile(x, F.array(*[F.lit(p) for p in probs]), exact).alias("q")]
        structs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                                F.stddev_samp(x).alias("std"), F.min(x).alias("min"), *q, F.max(x).alias("max")))
    long = df.agg(F.array(*structs).alias("a")).select(F.inline("a"))
    if exact:  # one row a column on both sides
        long = long.join(quantiles(df, {c: F.col(c) for c in cols}, probs).select("column", "q"), "column", "left")
    return long.select("column", "count", "mean", "std", "min",
                       *[F.col("q")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))], "max")


def value_counts_top_k(df: DataFrame, cols, k: int = 5, salt_buckets: int | None = None) -> DataFrame:
    """(column, value, count, rank) for the k most frequent values per column (ties: value asc)
    plus the per-column distinct count.

    Stage 1 counts (column, value) with map-side combining; stage 2 keeps the top k inside
    (column, hash(value) % salt_buckets) sub-groups; stage 3 ranks at most k*salt_buckets
    candidates per column.  Exact, and no task ever sorts a whole column.
    """
    salt_buckets = salt_buckets or salt_count(df.sparkSession, 256)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("s")) \
        .select("s.column", "s.value").filter(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    order = [F.desc("count"), F.asc("value")]
    w1 = Window.partitionBy("column", F.pmod(F.xxhash64("value"), F.lit(salt_buckets))).orderBy(*order)
    cand = counts.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy("column").orderBy(*order)
    top = cand.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k).drop("_r")
    return top.join(distinct, "column")


def categorical_top5(df: DataFrame, max_cols: int | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values of every string column, or of the first ``max_cols``."""
    cols = string_columns(df)[:max_cols]
    return value_counts_top_k(df, cols, k)


def quality_duplicates(df: DataFrame) -> DataFrame:
    """Fully duplicated rows (first occurrence not counted) and their percent.

    Exact, but cheap when duplicates are rare: a 64-bit hash of every row is counted first
    (an 8-byte shuffle with map-side combining); only rows whose hash occurs more than once
    are compared on all columns.  Unique hashes cannot be duplicates, so nothing is missed.
    """
    cols = df.columns
    h = df.withColumn("_rh", F.xxhash64(*[F.col(c) for c in cols]))
    per_hash = h.groupBy("_rh").agg(F.count(F.lit(1)).alias("_hn"))
    total = per_hash.agg(F.sum("_hn").cast("long").alias("rows"))
    cand = per_hash.filter(F.col("_hn") > 1).select("_rh")
    dups = (h.join(cand, "_rh", "left_semi").groupBy("_rh", *cols).agg(F.count(F.lit(1)).alias("_n"))
              .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates")))
    n = total.select("rows").scalar()
    return dups.select("duplicates", n.alias("rows"),
                       (F.col("duplicates") * F.lit(100.0) / n).alias("duplicate_pct"))


def _atomic(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]


# Relative standard error of the distinct-count sketch, and how many of it a column must be under the limit to
# be left uncounted.
SKETCH_ERROR = 0.02
SKETCH_MARGIN = 7


def quality_screen(df: DataFrame, target: str | None = None) -> dict:
    """One scan, one row to the driver: rows, columns with a single value, negative targets and estimated distinct
    counts of the string columns."""
    cols, texts = _atomic(df), string_columns(df)
    at = {c: f"`{c}`" for c in df.columns}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[((F.count(at[c]) > 0) & (F.min(at[c]) == F.max(at[c]))).alias(f"k{i}") for i, c in enumerate(cols)],
        *[F.approx_count_distinct(at[c], SKETCH_ERROR).alias(f"d{i}") for i, c in enumerate(texts)],
        (F.count_if(F.col(at[target]) < 0) if target in df.columns else F.lit(0)).alias("negative")).first()
    return {"rows": row["rows"], "negative": row["negative"], "constant": [c for i, c in enumerate(cols) if row[f"k{i}"]],
            "distinct": {c: row[f"d{i}"] for i, c in enumerate(texts)}}


def quality_constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct non-null value (min = max, count > 0)."""
    cols = _atomic(df)
    wide = df.agg(F.array(*[F.struct(F.lit(c).alias("column"),
                                     ((F.count(c) > 0) & (F.min(c) == F.max(c))).alias("constant"))
                            for c in cols]).alias("a"))
    return wide.select(F.explode("a").alias("s")).filter("s.constant").select("s.column")


def quality_high_cardinality(df: DataFrame, ratio: float = 0.9, screen: dict | None = None) -> DataFrame:
    """String columns whose distinct count exceeds ratio * rows.

    A sketch of all columns in one scan leaves out those far below the limit (``SKETCH_MARGIN`` standard errors); exact
    counts of the others decide, in one more scan (values counted with map-side combining).
    """
    screen = screen or quality_screen(df)
    limit = ratio * screen["rows"]
    cols = [c for c, n in screen["distinct"].items() if n * (1 + SKETCH_MARGIN * SKETCH_ERROR) >= limit]
    empty = df.sparkSession.createDataFrame([], "column string, distinct long, rows long")
    if not cols:
        return empty
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in cols])).alias("s")) \
               .groupBy("s.column", "s.value").agg(F.count(F.lit(1)).alias("n"))
    counts = values.groupBy("column").agg(F.count("value").alias("distinct"), F.sum("n").alias("rows"))
    return counts.filter(F.col("distinct") > F.lit(ratio) * F.col("rows"))


def quality_negative_target(df: DataFrame, target: str = "lead_days") -> DataFrame:
    return df.agg(F.count_if(F.col(target) < 0).alias("negative"))


def quality_report(df: DataFrame, target: str = "lead_days") -> DataFrame:
    """Issue rows (check, value, message) from the four checks; checks with nothing found give no row.

    One scan screens all checks but duplicates; only duplicates and the columns that the screen leaves open are
    counted exactly.
    """
    screen = quality_screen(df, target)
    dup = quality_duplicates(df).filter(F.col("duplicates") > 0).select(
        F.lit("duplicates").alias("check"), F.col("duplicates").cast("string").alias("value"),
        F.format_string("%d duplicate rows (%.2f%%)", "duplicates", "duplicate_pct").alias("message"))
    const = df.sparkSession.createDataFrame(
        [("constant_column", c, f"column {c} has a single value") for c in screen["constant"]], "check string, value string, message string")
    high = quality_high_cardinality(df, screen=screen).select(
        F.lit("high_cardinality").alias("check"), F.col("column").alias("value"),
        F.format_string("column %s has %d distinct values", "column", "distinct").alias("message"))
    parts = [dup, const, high]
    if screen["negative"]:
        parts.append(df.sparkSession.createDataFrame(
            [("negative_target", str(screen["negative"]), f"{screen['negative']} rows with negative target")], "check string, value string, message string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_raw_columns(df: DataFrame, order_key: str, n: int = 1000) -> DataFrame:
    """The columns of a raw file in order: (position from 1, column, type, filled), ``filled`` the values that are there in
    the first n rows by order key."""
    head = df.orderBy(order_key).limit(n)
    one = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type"),
                    F.count(F.col(f"`{name}`")).alias("filled")) for i, (name, kind) in enumerate(df.dtypes, 1)]
    return head.agg(F.array(*one).alias("a")).select(F.inline("a"))


def profile_raw_file(df: DataFrame, order_key: str, status: str = "status", n: int = 1000) -> DataFrame:
    """First n rows by order key: row count, column count and value counts of ``status``."""
    head = df.orderBy(order_key).limit(n)
    return head.groupBy(status).agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(len(df.columns)).alias("columns"), status, "count")
