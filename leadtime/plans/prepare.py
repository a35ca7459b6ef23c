"""Case preparation plans: raw cases -> valid cases -> processed table.

Everything is one lazy DataFrame chain; Catalyst prunes columns down to the scan and pushes
the target's not-null filter below the calendar projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_features, fiscal_year_of_date, lead_time_days
from ..functions.flags import binary_flags, case_number_numeric
from ..roles import ROLES, CaseRoles


def valid_cases(df: DataFrame, roles: CaseRoles = ROLES, derive_fiscal_year: bool = True) -> DataFrame:
    """lead days (floor rule, negatives -> null), drop missing target, calendar parts, int flags."""
    out = df.withColumn(roles.target, lead_time_days(roles.submit_ts, roles.status_ts))
    out = out.filter(F.col(roles.target).isNotNull())
    out = calendar_features(out, roles.submit_ts, roles.calendar_prefix)
    if derive_fiscal_year and roles.fiscal_year not in df.columns:
        out = out.withColumn(roles.fiscal_year, fiscal_year_of_date(roles.submit_ts))
    out = binary_flags(out, roles)
    if roles.case_no in df.columns:
        out = out.withColumn("case_number", case_number_numeric(roles.case_no))
    return out


# DuckDB twin of ``valid_cases`` over the ``cases`` CTE (used by the oracle queries).
VALID_SQL = """
valid AS (
  SELECT * EXCLUDE (raw_days), raw_days AS lead_days,
         CAST(year(submit_ts) AS INTEGER) AS submit_year,
         CAST(month(submit_ts) AS INTEGER) AS submit_month,
         CAST(quarter(submit_ts) AS INTEGER) AS submit_quarter,
         CAST(isodow(submit_ts) - 1 AS INTEGER) AS submit_day_of_week,
         CAST(dayofyear(submit_ts) AS INTEGER) AS submit_day_of_year,
         CAST(year(submit_ts) + CAST(month(submit_ts) >= 10 AS INTEGER) AS INTEGER) AS fiscal_year,
         issued AS is_issued, ap AS is_ap, refused AS is_refused,
         refused_221g AS is_refused_221g, ready AS is_ready,
         CAST(case_no AS DOUBLE) AS case_number
  FROM (SELECT *, CAST(floor(epoch(status_ts - submit_ts) / 86400) AS BIGINT) AS raw_days FROM cases)
  WHERE raw_days >= 0
)"""


def process_valid(valid: DataFrame, roles: CaseRoles = ROLES, outlier_k: float = 3.0, exact: bool = True,
                  onehot_max: int = 10, impute_threshold: int = 50, keep=("case_id",)) -> DataFrame:
    """Impute (mode / 'Unknown' / median) -> drop date columns -> encode (one-hot up to 10
    levels, sorted label codes above) -> IQR trim of the target, over a valid-case table.

    Encoding runs before trimming, as in the reference, so codes cover levels the trim removes.
    """
    from ..functions.dates import drop_date_columns
    from ..operators.clean import outliers_iqr
    from ..operators.encode import encode_auto
    from ..operators.impute import impute_missing

    out = impute_missing(valid, roles.target, impute_threshold, exact)
    out = drop_date_columns(out, roles)
    strings = [c for c, t in out.dtypes if t == "string" and c not in keep]
    out, _ = encode_auto(out, strings, onehot_max)
    return outliers_iqr(out, roles.target, outlier_k, exact)


def process_cases(df: DataFrame, roles: CaseRoles = ROLES, **kw) -> DataFrame:
    """The whole preparation plan from raw cases.

    The valid-case table is written once to the shared checkpoint folder: the imputation and
    encoding steps each need a metadata pass (null counts, distinct estimates, levels), and
    without the cut every pass would recompute the raw joins.
    """
    from ..session import cut_lineage
    return process_valid(cut_lineage(valid_cases(df, roles), "valid"), roles, **kw)


def process_petitions(df: DataFrame, employer: str = "employer", state: str = "state", onehot_max: int = 10,
                      keep=("petition_id",), strict: bool = False) -> DataFrame:
    """Employer-petition preparation in the reference order: flags -> per-employer and per-state
    counts (taken before any null is filled, so a null key gets a null count, which the median
    fill then replaces) -> constant 'Unknown' for the named text columns and medians for numbers
    -> encoding (one-hot up to 10 levels, label codes above)."""
    from ..functions.flags import approval_denial_flags
    from ..operators.aggregates import key_counts
    from ..operators.encode import encode_auto
    from ..operators.impute import impute_constant
    from ..session import cut_lineage

    out = approval_denial_flags(df, strict=strict)
    out = key_counts(out, employer, "employer_count")
    out = key_counts(out, state, "state_count")
    out = cut_lineage(out, "petitions")
    out = impute_constant(out, numeric_exclude=keep)
    strings = [c for c, t in out.dtypes if t == "string" and c not in keep]
    out, _ = encode_auto(out, strings, onehot_max)
    return out
