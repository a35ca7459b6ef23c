"""Date and duration expressions (all built-in Spark SQL functions, codegen-friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import ROLES, CaseRoles, present

DAY_MICROS = 86_400_000_000

# Formats tried in order when parsing date strings; the first that parses wins.
# One letter takes one or two digits; brackets are optional parts (fraction, zone).
DEFAULT_TS_FORMATS = (
    "yyyy-M-d H:m:s[.SSSSSSSSS][ ][XXX]",
    "yyyy-M-d'T'H:m:s[.SSSSSSSSS][XXX]",
    "yyyy-M-d H:m",
    "yyyy-M-d'T'H:m[XXX]",
    "yyyy-M-d",
    "M/d/yyyy H:m:s",
    "M/d/yyyy",
    "d-MMM-yy",
    "d-MMM-yyyy",
)

# Period of each calendar part for the sin/cos encoding.
CYCLICAL_PERIODS = {"month": 12, "day_of_week": 7, "quarter": 4, "day_of_year": 365}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_dates_coerce(c, formats=DEFAULT_TS_FORMATS) -> Column:
    """String -> timestamp_ntz; a value no format parses becomes null (never raises).

    A value with a zone is read as that moment's wall clock in the session zone.
    """
    c = F.trim(_col(c))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def unparsed_dates(df: DataFrame, cols, formats=DEFAULT_TS_FORMATS) -> DataFrame:
    """(column, values, unparsed): how many non-null values no format parses, in one pass.  Rows with such
    a value have no duration and leave with ``drop_missing_target``."""
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("values"),
                                F.count_if(F.col(c).isNotNull() & parse_dates_coerce(c, formats).isNull()).alias("unparsed"))
                       for c in cols])
    return df.agg(counts.alias("a")).select(F.explode("a").alias("s")).select("s.*")


def duration_micros(start, end) -> Column:
    """Microseconds from start to end.  For wall-clock (timestamp_ntz) values the difference
    does not depend on the session time zone (no DST hour appears or disappears)."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def raw_days(submit, status) -> Column:
    """Whole days from submit to status, floored: -12 h gives -1."""
    return F.floor(duration_micros(submit, status) / F.lit(DAY_MICROS)).cast("long")


def lead_time_days(submit, status) -> Column:
    """Whole days from submit to status, floored (-12 h -> -1), negative -> null."""
    days = raw_days(submit, status)
    return F.when(days >= 0, days)


def with_lead_days(df: DataFrame, roles: CaseRoles = ROLES) -> DataFrame:
    return df.withColumn(roles.target, lead_time_days(roles.submit_ts, roles.status_ts))


def fiscal_year_of_date(c) -> Column:
    """Fiscal year starting in October: year + 1 for months 10..12."""
    c = _col(c)
    return F.year(c) + (F.month(c) >= 10).cast("int")


def calendar_features(df: DataFrame, ts_col: str, prefix: str = "submit") -> DataFrame:
    """year, month, quarter, day of week (Mon=0) and day of year of a timestamp."""
    c = F.col(ts_col)
    return df.withColumns({
        f"{prefix}_year": F.year(c),
        f"{prefix}_month": F.month(c),
        f"{prefix}_quarter": F.quarter(c),
        f"{prefix}_day_of_week": F.weekday(c),
        f"{prefix}_day_of_year": F.dayofyear(c),
    })


def cyclical_encoding(df: DataFrame, prefix: str = "submit", periods: dict = CYCLICAL_PERIODS) -> DataFrame:
    """sin/cos(2*pi*x/period) for each calendar part present; absent parts are skipped."""
    out = {}
    for part, period in periods.items():
        name = f"{prefix}_{part}"
        if name in df.columns:
            angle = F.lit(2 * math.pi) * F.col(name) / F.lit(float(period))
            out[f"{name}_sin"] = F.sin(angle)
            out[f"{name}_cos"] = F.cos(angle)
    return df.withColumns(out) if out else df


def completion_dates(submit_date, **offsets) -> dict:
    """submit date + int(days) for each named offset column (truncation toward zero)."""
    d = _col(submit_date).cast("date")
    return {name: F.date_add(d, _col(c).cast("int")) for name, c in offsets.items()}


def drop_date_columns(df: DataFrame, roles: CaseRoles = ROLES, extra=()) -> DataFrame:
    return df.drop(*present(df, [roles.submit_ts, roles.status_ts, *extra]))
