"""Exact interpolated quantiles without a task that sees a whole column or group.

1. Values are counted by (column, group, value) with map-side combining, so a value that a third of all rows
   hold is a few rows.
2. The counts are range-partitioned by (column, group, value): a column or group of any size is spread over
   many partitions.  The table is written once to the shared folder.
3. Each partition's count of a column and group (a small table: one row a group, and one more for every
   partition border it crosses) gives its offset, hence the partitions that hold the two neighbouring ranks of
   every probability.
4. Only inside those partitions are running counts taken, and the values at the ranks picked.

Interpolation is linear between the neighbouring ranks, as of SQL's ``percentile_cont``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def value_counts(df: DataFrame, values: dict[str, Column], groups=()) -> DataFrame:
    """(groups..., column, value, n) over the rows where the value is not null or NaN."""
    one = [F.struct(F.lit(name).alias("column"), F.col(f"_{i}").alias("value")) for i, name in enumerate(values)]
    wide = df.select(*groups, *[e.cast("double").alias(f"_{i}") for i, e in enumerate(values.values())])
    long = wide.select(*groups, F.inline(F.array(*one))) if len(one) > 1 else \
        wide.select(*groups, F.lit(next(iter(values))).alias("column"), F.col("_0").alias("value"))
    return (long.where(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy(*groups, "column", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def quantiles(df: DataFrame, values: dict[str, Column], probs, groups=()) -> DataFrame:
    """(groups..., column, n, q): for each named expression the number of its values and the array of its
    quantiles, in the order of ``probs``.

    Null and NaN values are left out; a column (or a group's column) without a value has no row.  A null group
    is a group.
    """
    groups, probs = list(groups), [float(p) for p in probs]
    keys = [f"_g{i}" for i in range(len(groups))] + ["column"]
    src = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
                    *[e.alias(f"_v{i}") for i, e in enumerate(values.values())])
    counts = value_counts(src, {name: F.col(f"_v{i}") for i, name in enumerate(values)}, keys[:-1])
    ranged = cut_lineage(counts.repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id()), "quantiles")

    pieces = ranged.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumns({"_off": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                                 "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    # The ranks wanted of each piece: position p * (n - 1) lies between the ranks floor and ceil.
    at = [F.lit(p) * (F.col("_all") - 1) for p in probs]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank"), w.alias("weight"))
                      for i, x in enumerate(at)
                      for r, w in ((F.floor(x), F.lit(1.0) - (x - F.floor(x))), (F.floor(x) + 1, x - F.floor(x)))])
    here = F.filter(ranks, lambda r: (r["weight"] > 0) & (r["rank"] >= F.col("_off")) & (r["rank"] < F.col("_off") + F.col("_n")))
    wanted = placed.withColumn("_want", here).where(F.size("_want") > 0).select(
        *[F.col(k).alias(f"_k{k}") for k in keys], F.col("_part").alias("_p"), "_off", "_all", "_want")

    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k{k}"))
    upto = Window.partitionBy(*keys, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.join(wanted, same).withColumn("_end", F.col("_off") + F.sum("n").over(upto))
    hit = F.filter("_want", lambda r: (r["rank"] >= F.col("_end") - F.col("n")) & (r["rank"] < F.col("_end")))
    picked = running.select(*keys, "_all", "value", F.explode(hit).alias("_hit"))
    one = picked.groupBy(*keys, F.col("_all").alias("n")).agg(
        *[F.sum(F.when(F.col("_hit.i") == i, F.col("value") * F.col("_hit.weight"))).alias(f"_q{i}") for i in range(len(probs))])
    return one.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)], "column", "n",
                      F.array(*[F.col(f"_q{i}") for i in range(len(probs))]).alias("q"))


def column_quantiles(df: DataFrame, values: dict[str, Column], probs) -> DataFrame:
    """One row: for each name the array of its quantiles (null where it has no value)."""
    q = quantiles(df, values, probs)
    return q.agg(*[F.max(F.when(F.col("column") == name, F.col("q"))).alias(name) for name in values])
