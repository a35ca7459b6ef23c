"""Row filters and table-level cleaning rules (§2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..roles import present
from .quantiles import column_quantiles
from .stats import median, one_pass, percentile, scalars

# Columns that leak the outcome (known only after processing) or the target.
LEAKAGE_COLS = (
    "case_id",
    "issued", "ap", "ready", "refused", "refused_221g", "in_transit", "transfer", "nvc", "potential_ap",
    "is_issued", "is_refused", "is_ap", "is_ready", "is_refused_221g",
    "deviation_from_office", "fiscal_year_mean_days", "complexity_score",
    "status",
)
# Prefixes of one-hot columns of an outcome, which leak as the outcome does.
LEAKAGE_PREFIXES = ("status_",)


def lead_time_summary(df: DataFrame, target: str = "lead_days", exact: bool = True) -> DataFrame:
    t = F.col(target).cast("double")
    return one_pass(df, {"mean": F.avg(t), "median": median(t, exact), "min": F.min(t), "max": F.max(t),
                         "missing": F.count_if(F.col(target).isNull()), "rows": F.count(F.lit(1))})


def drop_missing_target(df: DataFrame, target: str = "lead_days") -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def iqr_bounds(df: DataFrame, col: str, k: float = 3.0, exact: bool = True) -> DataFrame:
    """One-row table: q1, q3, lower, upper (linear-interpolated quartiles)."""
    x = F.col(col).cast("double")
    q = column_quantiles(df, {"_q": x}, (0.25, 0.75)) if exact else \
        one_pass(df, {"_q": percentile(x, F.array(F.lit(0.25), F.lit(0.75)), exact)})
    q = q.select(F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - F.lit(k) * iqr).alias("lower"), (F.col("q3") + F.lit(k) * iqr).alias("upper"))


def outliers_iqr(df: DataFrame, col: str = "lead_days", k: float = 3.0, exact: bool = True) -> DataFrame:
    """Keep Q1 - k*IQR <= x <= Q3 + k*IQR; null x is dropped.  Bounds are scalar subqueries."""
    b = iqr_bounds(df, col, k, exact)
    x = F.col(col).cast("double")
    lower, upper = scalars(b, "lower", "upper")
    return df.filter((x >= lower) & (x <= upper))


def outliers_zscore(df: DataFrame, col: str = "lead_days", k: float = 3.0) -> DataFrame:
    """Keep |x - mean| / std_samp < k (strict); std 0 or null -> every row dropped."""
    x = F.col(col).cast("double")
    s = one_pass(df, {"m": F.avg(x), "s": F.stddev_samp(x)})
    m, sd = scalars(s, "m", "s")
    z = F.abs(F.try_divide(x - m, sd))
    return df.filter(z < F.lit(k))


def outlier_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Removed rows and percent removed (two counts, as scalar subqueries)."""
    n0 = before.select(F.count(F.lit(1)).alias("n")).scalar()
    n1 = after.select(F.count(F.lit(1)).alias("n")).scalar()
    return before.sparkSession.range(1).select(
        n0.alias("rows_before"), n1.alias("rows_after"), (n0 - n1).alias("removed"),
        F.try_divide((n0 - n1) * F.lit(100.0), n0).alias("removed_pct"))


def drop_columns_present(df: DataFrame, names=LEAKAGE_COLS, prefixes=LEAKAGE_PREFIXES) -> DataFrame:
    """Without the named columns and the boolean (one-hot) columns that begin with one of ``prefixes``."""
    hot = [f.name for f in df.schema.fields if isinstance(f.dataType, BooleanType) and f.name.startswith(tuple(prefixes))]
    return df.drop(*present(df, names), *hot)


def select_numeric(df: DataFrame, keep=()) -> DataFrame:
    """Keep int/long/float/double/decimal columns (booleans, strings, dates dropped)."""
    cols = [f.name for f in df.schema.fields
            if (isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)) or f.name in keep]
    return df.select(*cols)


# ---------------------------------------------------------------------------------------------
# Request validation (one error map per row) and routing to valid / quarantine.
# Error messages of each rule.
ERR_REQUIRED = "Required field."
ERR_DATE_MISSING = "Required field (YYYY-MM-DD)."
ERR_DATE_FORMAT = "Must be YYYY-MM-DD format."
ERR_CASE_NO = "Must be a positive integer."
DEFAULT_CASE_NUMBER = 1000


def validate_requests(df: DataFrame, office: str = "office", submit_date: str = "submit_date",
                      case_number: str = "case_number") -> DataFrame:
    """Adds ``office_code`` (trimmed, upper), ``submit_dt`` (date), ``case_no`` (whole number of up to 38
    digits, null -> 1000) and ``errors`` (map field -> message, empty when the request is valid).

    A string case number must be an integer literal ('3.7' and 'abc' are errors); a numeric one
    is truncated toward zero.
    """
    code = F.upper(F.trim(F.coalesce(F.col(office).cast("string"), F.lit(""))))
    d_raw = F.trim(F.coalesce(F.col(submit_date).cast("string"), F.lit("")))
    parsed = F.when(d_raw.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(d_raw, "yyyy-M-d"))
    n_field = dict(df.dtypes).get(case_number, "string")
    if n_field == "string":
        n_txt = F.trim(F.col(case_number))
        n_int = F.when(F.col(case_number).isNull(), F.lit(DEFAULT_CASE_NUMBER).cast("decimal(38,0)")) \
                 .when(n_txt.rlike(r"^[+-]?0*[0-9]{1,38}$"), n_txt.try_cast("decimal(38,0)"))
    else:
        n_int = F.coalesce(F.col(case_number).try_cast("long"), F.lit(DEFAULT_CASE_NUMBER)).cast("decimal(38,0)")
    keys = F.array(F.lit("office"), F.lit("submit_date"), F.lit("case_number"))
    vals = F.array(
        F.when(code == "", F.lit(ERR_REQUIRED)),
        F.when(d_raw == "", F.lit(ERR_DATE_MISSING)).when(parsed.isNull(), F.lit(ERR_DATE_FORMAT)),
        F.when(n_int.isNull() | (n_int < 1), F.lit(ERR_CASE_NO)),
    )
    errors = F.map_filter(F.map_from_arrays(keys, vals), lambda k, v: v.isNotNull())
    return df.withColumns({"office_code": code, "submit_dt": parsed, "case_no": n_int, "errors": errors})


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size("errors") == 0
    return validated.filter(ok), validated.filter(~ok)


# Outcome segments of the stacked breakdown, in drawing order.
OUTCOME_SEGMENTS = (("Issued", "approval_rate_pct"), ("Admin. Processing", "ap_rate_pct"),
                    ("Refused", "refusal_rate_pct"), ("Refused 221g", "refusal_221g_pct"))


def outcome_breakdown(profile: DataFrame, key: str = "office") -> DataFrame:
    """Long table (key, pos, segment, pct, left): left = running sum of the previous segments.

    The window is partitioned by office over 4 rows each, so no task holds more than 4 rows
    per office.
    """
    stack = ", ".join(f"{i}, '{lbl}', CAST({c} AS DOUBLE)" for i, (lbl, c) in enumerate(OUTCOME_SEGMENTS))
    long = profile.select(key, F.expr(f"stack({len(OUTCOME_SEGMENTS)}, {stack}) AS (pos, segment, pct)"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return long.withColumn("left", F.coalesce(F.sum("pct").over(w), F.lit(0.0)))
