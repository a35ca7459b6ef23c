"""Join helpers (§2.4).

Aggregates joined back to cases have one row per key.  Whether that side is broadcast is left
to Spark's size check (``autoBroadcastJoinThreshold``, re-evaluated by AQE on the actual
shuffle size), with a sort-merge join beyond it; an explicit broadcast is used only for
tables whose row count has a fixed bound (top-N lists, calendar domains, one-row scalars).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_back(df: DataFrame, table: DataFrame, key, how: str = "left") -> DataFrame:
    return df.join(table, key, how)


def map_lookup(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, value: str, out: str,
               default: Column | str | None = "self") -> DataFrame:
    """Dictionary map through a lookup table; missing -> the key itself ('self'), a Column, or null."""
    lk = lookup.select(F.col(lookup_key).alias("_lk"), F.col(value).alias("_lv"))
    j = df.join(lk, df[key] == lk["_lk"], "left")
    if isinstance(default, str) and default == "self":
        v = F.coalesce(F.col("_lv"), F.col(key).cast(lookup.schema[value].dataType))
    elif default is None:
        v = F.col("_lv")
    else:
        v = F.coalesce(F.col("_lv"), default)
    return j.withColumn(out, v).drop("_lk", "_lv")


def join_inner_known(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str) -> DataFrame:
    """Map then drop unmatched rows = inner join on the code table."""
    return df.join(lookup.withColumnRenamed(lookup_key, key), key, "inner")


# Last-resort office statistics when neither the office nor a global row exists.
FALLBACK_CONSTANTS = {
    "office_mean_days": 580.0, "office_median_days": 580.0, "office_std_days": 98.0,
    "office_volume": 1000.0, "office_approval_rate": 0.75, "office_ap_rate": 0.10,
    "office_refusal_rate": 0.15, "office_221g_rate": 0.05,
}


def join_fallback_global(df: DataFrame, key: str, stats: DataFrame, stats_key: str, global_row: DataFrame | None,
                         constants: dict = FALLBACK_CONSTANTS) -> DataFrame:
    """Left join of per-key statistics; a missing key takes the global row (a one-row table used
    through scalar subqueries), and a statistic still missing takes the constant."""
    cols = [c for c in constants if c in stats.columns]
    s = stats.select(F.col(stats_key).alias("_sk"), *[F.col(c).alias(f"_s_{c}") for c in cols])
    j = df.join(s, df[key] == s["_sk"], "left")
    out = {}
    for c in cols:
        parts = [F.col(f"_s_{c}").cast("double")]
        if global_row is not None and c in global_row.columns:
            parts.append(global_row.select(F.col(c).cast("double")).scalar())
        parts.append(F.lit(float(constants[c])))
        out[c] = F.coalesce(*parts)
    out["office_known"] = F.col("_sk").isNotNull()
    return j.withColumns(out).drop("_sk", *[f"_s_{c}" for c in cols])


def semi_top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is among the n most frequent keys (ties by key); the list has <= n rows."""
    top = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.desc("_n"), F.asc(key)).limit(n).select(key))
    return df.join(F.broadcast(top), key, "left_semi")
