"""Flag, score and label expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import BooleanType

from ..roles import ROLES, CaseRoles

# Weight of each outcome flag in the complexity score.
COMPLEXITY_WEIGHTS = {"is_ap": 3, "is_refused_221g": 2, "is_refused": 2, "potential_ap": 1}

# Static peak months and seasonal indices used when no learned index exists.
PEAK_MONTHS = (10, 11, 12, 1)
STATIC_MONTH_INDEX = (1.2, 0.9)       # (peak month, other month)
STATIC_QUARTER_INDEX = (1.1, 0.95)    # (quarter 1 or 4, other quarter)
PEAK_INDEX_THRESHOLD = 1.1

# Speed labels and their colours; band half-width in standard deviations.
SPEED_LABELS = (("Fast", "green"), ("Normal", "orange"), ("Slow", "red"))
SPEED_BAND_SD = 0.5
DAYS_PER_MONTH = 30.44


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binary_flags(df: DataFrame, roles: CaseRoles = ROLES) -> DataFrame:
    """For each raw flag present: null or NaN -> 0, cast to int (truncating, as astype(int))."""
    cols = {new: F.coalesce(F.nanvl(F.col(raw).cast("double"), F.lit(0.0)), F.lit(0.0)).cast("int")
            for raw, new in roles.flags.items() if raw in df.columns}
    return df.withColumns(cols) if cols else df


def case_number_numeric(c) -> Column:
    """Numeric coerce: unparsable -> null."""
    return F.col(c).cast("string").try_cast("double") if isinstance(c, str) else c.cast("string").try_cast("double")


def complexity_score(df: DataFrame, weights: dict = COMPLEXITY_WEIGHTS, name: str = "complexity_score") -> DataFrame:
    """Sum of weight * coalesce(flag, 0) over the flags present (absent flags skipped)."""
    terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
             for c, w in weights.items() if c in df.columns]
    expr = F.lit(0.0)
    for t in terms:
        expr = expr + t
    return df.withColumn(name, expr)


def _is_one(c: str) -> Column:
    return F.coalesce(F.col(c) == 1, F.lit(False))


def _int_flag(c: str, strict: bool) -> Column:
    v = F.col(c).cast("int")
    if not strict:
        return v
    return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null value in flag column {c}")).cast("int")).otherwise(v)


def approval_denial_flags(df: DataFrame, ia="ia", id_="id", ca="ca", cd="cd", strict: bool = False) -> DataFrame:
    """Initial/continuing approval/denial as ints; approved = IA or CA, denied = ID or CD.

    ``strict=True`` fails the job on a null flag (an integer cast of a missing value is an
    error in the reference); the default keeps null as null.
    """
    return df.withColumns({
        "is_initial_approval": _int_flag(ia, strict),
        "is_initial_denial": _int_flag(id_, strict),
        "is_continuing_approval": _int_flag(ca, strict),
        "is_continuing_denial": _int_flag(cd, strict),
        "is_approved": (_is_one(ia) | _is_one(ca)).cast("int"),
        "is_denied": (_is_one(id_) | _is_one(cd)).cast("int"),
    })


def decode_onehot(df: DataFrame, prefix: str, baseline: str | None = None, levels: list | None = None) -> Column:
    """Level name from k-1 one-hot bool columns ``prefix_<level>``: those of ``levels``, by default all
    boolean columns with the prefix (a timestamp ``status_ts`` is no level of ``status``).

    ``baseline=None`` reproduces arg-max decoding: a row of the dropped level (all false)
    reads as the first remaining level.  Pass the dropped level's name to decode it properly.
    """
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, BooleanType) and f.name.startswith(prefix + "_")
            and (levels is None or f.name[len(prefix) + 1:] in levels)]
    if not cols:
        return F.lit(baseline)
    levels = [c[len(prefix) + 1:] for c in cols]
    fallback = F.lit(levels[0] if baseline is None else baseline)
    return F.coalesce(*[F.when(F.col(c), F.lit(v)) for c, v in zip(cols, levels)], fallback)


def peak_season_flag(index_col="seasonal_index_month", threshold: float = PEAK_INDEX_THRESHOLD) -> Column:
    return F.coalesce(_col(index_col) > F.lit(threshold), F.lit(False)).cast("int")


def peak_season_static(month_col, quarter_col) -> dict:
    m, q = _col(month_col), _col(quarter_col)
    peak = m.isin(*PEAK_MONTHS)
    return {
        "is_peak_season": peak.cast("int"),
        "seasonal_index_month": F.when(peak, F.lit(STATIC_MONTH_INDEX[0])).otherwise(F.lit(STATIC_MONTH_INDEX[1])),
        "seasonal_index_quarter": F.when(q.isin(1, 4), F.lit(STATIC_QUARTER_INDEX[0]))
                                   .otherwise(F.lit(STATIC_QUARTER_INDEX[1])),
    }


def speed_category(pred, mean, std) -> dict:
    """Fast below mean - 0.5 sd, Slow above mean + 0.5 sd, else Normal (with colour)."""
    p, m, s = _col(pred), _col(mean), _col(std)
    lo, hi = m - F.lit(SPEED_BAND_SD) * s, m + F.lit(SPEED_BAND_SD) * s
    (fast, fast_c), (normal, normal_c), (slow, slow_c) = SPEED_LABELS
    cat = F.when(p < lo, F.lit(fast)).when(p > hi, F.lit(slow)).otherwise(F.lit(normal))
    color = F.when(p < lo, F.lit(fast_c)).when(p > hi, F.lit(slow_c)).otherwise(F.lit(normal_c))
    return {"category": cat, "category_color": color}


def prediction_interval(pred, rmse, half_even: bool = True) -> dict:
    """Clip at 0; lower = max(0, p - rmse), upper = p + rmse; months = p / 30.44; 1 decimal."""
    rnd = F.bround if half_even else F.round
    p = F.greatest(_col(pred).cast("double"), F.lit(0.0))
    r = _col(rmse) if not isinstance(rmse, (int, float)) else F.lit(float(rmse))
    return {
        "predicted_days": rnd(p, 1),
        "lower_bound": rnd(F.greatest(p - r, F.lit(0.0)), 1),
        "upper_bound": rnd(p + r, 1),
        "predicted_months": rnd(p / F.lit(DAYS_PER_MONTH), 1),
    }


# Advice tags, in the order they are listed, and their thresholds (in percent).
ADVICE_TAGS = ("peak_season", "high_ap_rate", "high_refusal_rate", "slow", "fast")
ADVICE_FALLBACK = "typical"
ADVICE_AP_PCT = 15.0
ADVICE_REFUSAL_PCT = 20.0


def advice_tags(peak, ap_pct, refusal_pct, category) -> Column:
    """0..n advice tags; the single tag 'typical' when none applies."""
    peak_t, ap_t, ref_t, slow_t, fast_t = ADVICE_TAGS
    tags = F.array_compact(F.array(
        F.when(_col(peak).cast("boolean"), F.lit(peak_t)),
        F.when(_col(ap_pct) > F.lit(ADVICE_AP_PCT), F.lit(ap_t)),
        F.when(_col(refusal_pct) > F.lit(ADVICE_REFUSAL_PCT), F.lit(ref_t)),
        F.when(_col(category) == "Slow", F.lit(slow_t)),
        F.when(_col(category) == "Fast", F.lit(fast_t)),
    ))
    return F.when(F.size(tags) == 0, F.array(F.lit(ADVICE_FALLBACK))).otherwise(tags)


def deviation_from_office(target="lead_days", office_mean="office_mean_days") -> Column:
    return _col(target).cast("double") - _col(office_mean)
