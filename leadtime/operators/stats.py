"""Fused-aggregate helpers shared by the operators.

* ``one_pass``: many statistics in a single ``agg`` (one scan, partial aggregation map-side).
* ``to_long``: one-row wide statistics -> (column, value) rows via ``unpivot``.
* ``scalar``: a one-row aggregate used as a scalar subquery (executed once, no join at all).
* ``with_row_index``: exact global 0-based position in a sort order without a single-partition
  window: range-partitioned sort, per-partition counts (a table with one row per partition)
  and an offset join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType, StringType

from ..session import cut_lineage


def one_pass(df: DataFrame, exprs: dict) -> DataFrame:
    """Single aggregation pass; returns one row with one column per name."""
    return df.agg(*[e.alias(k) for k, e in exprs.items()])


def to_long(df: DataFrame, ids, values, var: str = "column", val: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), var, val)


def scalar(agg_df: DataFrame, name: str) -> Column:
    """Column for one value of a one-row aggregate, as a scalar subquery."""
    return agg_df.select(name).scalar()


def scalars(agg_df: DataFrame, *names: str) -> list[Column]:
    """Several values of a one-row aggregate through ONE scalar subquery (a struct), so the
    aggregate runs once however many of its values the outer query uses."""
    names = names or tuple(agg_df.columns)
    sub = agg_df.select(F.struct(*[F.col(n) for n in names]).alias("_s")).scalar()
    return [sub.getField(n) for n in names]


def median(c, exact: bool = True, accuracy: int = 10000) -> Column:
    """Interpolated median (exact) or t-digest-style approximate for very large groups."""
    c = F.col(c) if isinstance(c, str) else c
    return F.median(c) if exact else F.percentile_approx(c, 0.5, accuracy).cast("double")


def percentile(c, p, exact: bool = True, accuracy: int = 10000) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if exact:
        return F.percentile(c, p)
    return F.percentile_approx(c.cast("double"), p, accuracy)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Int/long/float/double/decimal columns; booleans are not numbers here."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
            and f.name not in ex]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in ex]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of float and double columns becomes null: missing is null everywhere in this library."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in cols}) if cols else df


def with_row_index(df: DataFrame, order_cols, name: str = "row_idx", checkpoint: bool = True) -> DataFrame:
    """Global 0-based row position by ``order_cols`` (which must identify rows uniquely).

    ``orderBy`` range-partitions and sorts; each partition then numbers its rows locally
    (``monotonically_increasing_id`` = partition id << 33 | position).  The per-partition row
    counts are a table with one row per partition, so the running offset over it is cheap;
    it is broadcast back.  The tagged table is checkpointed so both uses see the same ids even
    if a task is re-run on another executor.
    """
    tagged = (df.orderBy(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        tagged = cut_lineage(tagged)
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("long"))
                  .drop("_pid", "_mid", "_first", "_off"))


def ntile_from_index(idx: Column, n: Column, k: int) -> Column:
    """Same block sizes as ``ntile(k)``: the first n % k blocks get one extra row (1-based)."""
    q = F.floor(n / F.lit(k)).cast("long")
    rem = n - q * F.lit(k)
    big = rem * (q + F.lit(1))
    return F.when(idx < big, F.floor(idx / (q + F.lit(1))) + F.lit(1)) \
            .otherwise(rem + F.floor((idx - big) / F.greatest(q, F.lit(1))) + F.lit(1)).cast("int")


def salt_count(spark, floor: int = 64) -> int:
    """Salt buckets for two-stage top-n: at least one sub-group per shuffle partition, so the
    first-stage window work spreads over all tasks however large one group is."""
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        parts = floor
    return max(floor, parts)


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int, salt_col: str | None = None,
                    salt_buckets: int | None = None, rank_name: str = "rank") -> DataFrame:
    """Exact top-n rows per group without ranking a whole group inside one task.

    Stage 1 keeps the top n inside (group, salt) sub-groups, stage 2 ranks the at most
    n * salt_buckets survivors of each group.  ``order_cols`` must order rows uniquely.
    """
    salt_buckets = salt_buckets or salt_count(df.sparkSession)
    group_cols = list(group_cols)
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in ([salt_col] if salt_col else df.columns))), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group_cols, salt).orderBy(*order_cols)
    cand = df.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_r1")
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return cand.withColumn(rank_name, F.row_number().over(w2)).filter(F.col(rank_name) <= n)
