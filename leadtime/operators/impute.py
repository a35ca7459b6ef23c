"""Missing-value rules (§2.3).

Two small driver round-trips decide *which* columns need work (a one-row frame of null counts
and approximate distinct counts); the data itself never leaves the executors.  Fill values are
computed in one aggregation per kind and applied with ``fillna`` / ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .stats import nan_to_null, numeric_columns, percentile, string_columns

UNKNOWN = "Unknown"


def null_counts(df: DataFrame, cols=None) -> dict:
    cols = list(cols if cols is not None else df.columns)
    if not cols:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return row.asDict()


def impute_report(df: DataFrame) -> DataFrame:
    """Total cells that are null or NaN (one pass)."""
    df = nan_to_null(df)
    expr = F.lit(0).cast("long")
    for c in df.columns:
        expr = expr + F.count_if(F.col(c).isNull())
    return df.agg(expr.alias("null_cells"), F.count(F.lit(1)).alias("rows"))


def categorical_fill_values(df: DataFrame, cols=None, threshold: int = 50) -> dict:
    """Fill value per string column that has nulls: mode if < threshold distinct values
    (ties -> smallest value; all null -> 'Unknown'), else 'Unknown'.

    The HyperLogLog pre-pass settles clearly high-cardinality columns without an exact count;
    only columns under twice the threshold get an exact distinct count (a set of < ~100 values)
    and an exact mode.
    """
    cols = [c for c in (cols or string_columns(df))]
    if not cols:
        return {}
    pre = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(cols)],
                 *[F.approx_count_distinct(c).alias(f"a_{i}") for i, c in enumerate(cols)]).first()
    need = [(i, c) for i, c in enumerate(cols) if pre[f"n_{i}"] > 0]
    fills = {c: UNKNOWN for i, c in need if pre[f"a_{i}"] > 2 * threshold}
    exact = [(i, c) for i, c in need if c not in fills]
    if exact:
        row = df.agg(*[F.size(F.collect_set(c)).alias(f"d_{i}") for i, c in exact],
                     *[F.mode(F.col(c), True).alias(f"m_{i}") for i, c in exact]).first()
        for i, c in exact:
            nd, mode = row[f"d_{i}"], row[f"m_{i}"]
            fills[c] = mode if (nd < threshold and mode is not None) else UNKNOWN
    return fills


def impute_categorical(df: DataFrame, cols=None, threshold: int = 50) -> DataFrame:
    fills = categorical_fill_values(df, cols, threshold)
    return df.fillna(fills) if fills else df


def numeric_fill_values(df: DataFrame, cols=None, exclude=(), exact: bool = True) -> dict:
    """Median (linear interpolation) of each numeric column that has nulls; NaN is null."""
    df = nan_to_null(df)
    cols = [c for c in (cols or numeric_columns(df, exclude)) if c not in set(exclude)]
    nulls = null_counts(df, cols)
    need = [c for c in cols if nulls.get(c, 0) > 0]
    if not need:
        return {}
    if exact:
        found = quantiles(df, {c: F.col(c) for c in need}, (0.5,)).collect()  # one row a column
        medians = {row["column"]: row["q"][0] for row in found}
    else:
        medians = df.agg(*[percentile(F.col(c).cast("double"), 0.5, exact).alias(c) for c in need]).first().asDict()
    return {c: medians[c] for c in need if medians.get(c) is not None}


def impute_numeric_median(df: DataFrame, cols=None, exclude=("lead_days",), exact: bool = True) -> DataFrame:
    """Fill nulls with the column median; filled columns become double (a fractional median
    must not be truncated); NaN is null."""
    df = nan_to_null(df)
    fills = numeric_fill_values(df, cols, exclude, exact)
    if not fills:
        return df
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fills.items()})


def impute_missing(df: DataFrame, target: str = "lead_days", threshold: int = 50, exact: bool = True) -> DataFrame:
    """Categorical rule first, then numeric medians (target excluded)."""
    return impute_numeric_median(impute_categorical(df, None, threshold), None, (target,), exact)


def impute_constant(df: DataFrame, cols=("employer", "naics", "state", "city"), value: str = UNKNOWN,
                    numeric_exclude=(), exact: bool = True) -> DataFrame:
    """Named string columns -> constant, then numeric medians."""
    present = [c for c in cols if c in df.columns]
    out = df.fillna({c: value for c in present}) if present else df
    return impute_numeric_median(out, None, numeric_exclude, exact)
