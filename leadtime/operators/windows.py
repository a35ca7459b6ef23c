"""Window-shaped computations (§2.7).

Windows without PARTITION BY run only over aggregated tables (one row per model, per error
bin, per partition); row-level global order uses the range-partitioned row index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import ntile_from_index, with_row_index


def rank_models(metrics: DataFrame, by: str = "mae", name: str = "model", ascending: bool = True) -> DataFrame:
    """1-based rank over the metrics table (one row per model), ties broken by model name."""
    order = F.asc(by) if ascending else F.desc(by)
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(order, F.asc(name))))


def cumulative_error_curve(df: DataFrame, err: str = "abs_error", step: float = 0.1, keys=()) -> DataFrame:
    """Share of rows with |error| <= each 0.1-day bin edge (running sum over the bin table)."""
    keys = list(keys)
    b = (F.ceil(F.abs(F.col(err).cast("double")) / F.lit(step)) * F.lit(step))
    bins = df.filter(F.col(err).isNotNull()).groupBy(*keys, F.round(b, 6).alias("error_le")) \
             .agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*keys).orderBy("error_le") if keys else Window.orderBy("error_le")
    tot = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return bins.select(*keys, "error_le", "count",
                       (F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.lit(100.0)
                        / F.sum("count").over(tot)).alias("cum_pct"))


def contiguous_folds(df: DataFrame, order_cols, k: int = 5, name: str = "fold") -> DataFrame:
    """k contiguous blocks in ``order_cols`` order, the first n % k one row larger (= ntile(k)).

    Computed from the exact global row index (range partition + offsets), never from a
    single-partition window over all rows.
    """
    idx = with_row_index(df, order_cols, "_idx")           # reads a materialised table
    n = idx.select(F.count(F.lit(1)).alias("n")).scalar()
    return idx.withColumn(name, ntile_from_index(F.col("_idx"), n, k)).drop("_idx")
