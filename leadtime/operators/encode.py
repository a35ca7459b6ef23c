"""Categorical encoders (§2.3): one-hot for few levels, sorted label codes for many.

Label codes for id-like columns are assigned without collecting the distinct values: the
distinct set is range-partitioned and numbered with per-partition offsets, then joined back
(broadcast only when the runtime size check allows it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import string_columns, with_row_index

# String columns that hold dates and are never encoded.
DATE_COLUMNS = ("submit_date", "status_date", "second_date")
NULL_TOKEN = "nan"


def levels(df: DataFrame, col: str, limit: int) -> list | None:
    """Sorted distinct non-null values if there are at most ``limit`` of them, else None."""
    vals = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(vals) > limit:
        return None
    return sorted(r[0] for r in vals)


def encode_one_hot(df: DataFrame, col: str, lvls: list | None = None, drop_first: bool = True,
                   max_levels: int = 10_000) -> DataFrame:
    """k-1 boolean columns ``col_<level>`` (alphabetically first level dropped); source dropped.
    A null value is false in every column.  More than ``max_levels`` levels raise ValueError: as many
    columns are no table; use ``encode_label``."""
    if lvls is None:
        lvls = levels(df, col, max_levels)
        if lvls is None:
            raise ValueError(f"column {col!r} has more than {max_levels} levels; use encode_label")
    keep = lvls[1:] if drop_first else lvls
    new = {f"{col}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)) for v in keep}
    return df.withColumns(new).drop(col) if new else df.drop(col)


def label_codes(df: DataFrame, col: str, null_token: str | None = NULL_TOKEN) -> DataFrame:
    """(value, code) with code = position of the value among sorted distinct strings (0-based)."""
    v = F.col(col).cast("string")
    if null_token is not None:
        v = F.coalesce(v, F.lit(null_token))
    distinct = df.select(v.alias("value")).filter(F.col("value").isNotNull()).distinct()
    return with_row_index(distinct, ["value"], "code")


def apply_codes(df: DataFrame, col: str, codes: DataFrame, out: str | None = None,
                null_token: str | None = NULL_TOKEN, default: int | None = None) -> DataFrame:
    out = out or col
    v = F.col(col).cast("string")
    if null_token is not None:
        v = F.coalesce(v, F.lit(null_token))
    keyed = df.withColumn("_lbl_key", v)
    joined = keyed.join(codes.withColumnRenamed("value", "_lbl_key").withColumnRenamed("code", "_lbl_code"),
                        "_lbl_key", "left")
    code = F.col("_lbl_code") if default is None else F.coalesce(F.col("_lbl_code"), F.lit(default).cast("long"))
    return joined.withColumn(out, code).drop("_lbl_key", "_lbl_code")


def encode_label(df: DataFrame, col: str) -> DataFrame:
    return apply_codes(df, col, label_codes(df, col), col)


def few_levels(df: DataFrame, cols, limit: int) -> dict:
    """{col: sorted levels} for the columns with at most ``limit`` distinct non-null values.

    One HyperLogLog pass over all columns rules out the many-valued ones without a shuffle of
    their values; one exact ``collect_set`` pass (sets bounded by twice the limit) settles the rest.
    """
    cols = list(cols)
    if not cols:
        return {}
    pre = df.agg(*[F.approx_count_distinct(c).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    small = [(i, c) for i, c in enumerate(cols) if pre[f"a{i}"] <= 2 * limit]
    if not small:
        return {}
    sets = df.agg(*[F.collect_set(c).alias(f"s{i}") for i, c in small]).first()
    return {c: sorted(sets[f"s{i}"]) for i, c in small if len(sets[f"s{i}"]) <= limit}


def encode_auto(df: DataFrame, cols=None, threshold: int = 10, exclude=DATE_COLUMNS) -> tuple[DataFrame, dict]:
    """Per string column: <= threshold distinct -> one-hot, else label codes.

    Returns the encoded frame and the fitted encoders {col: ("onehot", levels) | ("label", codes)}.
    """
    cols = [c for c in (cols or string_columns(df)) if c not in set(exclude)]
    few = few_levels(df, cols, threshold)
    fitted = {}
    out = df
    for c in cols:
        if c in few:
            fitted[c] = ("onehot", few[c])
            out = encode_one_hot(out, c, few[c])
        else:
            codes = label_codes(df, c)
            fitted[c] = ("label", codes)
            out = apply_codes(out, c, codes, c)
    return out, fitted


def encode_apply_default(df: DataFrame, col: str, codes: DataFrame, out: str | None = None, default: int = 0) -> DataFrame:
    """Apply saved codes to new rows: key trimmed and upper-cased, unknown -> default (0)."""
    key = F.upper(F.trim(F.col(col).cast("string")))
    tmp = df.withColumn("_enc_in", key)
    res = apply_codes(tmp, "_enc_in", codes, out or f"{col}_code", None, default)
    return res.drop("_enc_in")
