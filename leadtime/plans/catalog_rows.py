"""Registered checks for row-level expressions and filters (§2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import flags as FL
from ..operators import aggregates as agg
from ..operators import clean as C
from ..operators.encode import encode_one_hot
from ..roles import ROLES, cases
from .registry import petition_table, r, register, valid
from .catalog_queries import MIN_SAMPLES, office_stats_sql

# --- inputs with text dates / nullable flags, derived from the case table -------------------
# The raw text varies per row (a rule on the order priority) so that every parse branch and
# the null rules are exercised; all rows are kept.


def raw_text_cases(spark, sf):
    c = cases(spark, sf)
    p = F.col("priority")
    sub = (F.when(p == "1-URGENT", F.date_format("submit_ts", "yyyy-MM-dd"))
             .when(p == "2-HIGH", F.date_format("submit_ts", "MM/dd/yyyy"))
             .when(p == "3-MEDIUM", F.lit("not-a-date"))
             .otherwise(F.date_format("submit_ts", "yyyy-MM-dd HH:mm:ss")))
    return c.withColumns({
        "submit_text": sub,
        "case_text": F.when(p == "4-NOT SPECIFIED", F.concat(F.lit("X"), F.col("case_no").cast("string")))
                      .otherwise(F.col("case_no").cast("string")),
        "issued_raw": F.when(p != "5-LOW", F.col("issued").cast("double")),
        "ap_raw": F.when(p != "1-URGENT", F.col("ap").cast("double")),
    })


RAW_TEXT_SQL = """
, raw AS (
  SELECT *,
    CASE WHEN priority = '1-URGENT' THEN strftime(submit_ts, '%Y-%m-%d')
         WHEN priority = '2-HIGH' THEN strftime(submit_ts, '%m/%d/%Y')
         WHEN priority = '3-MEDIUM' THEN 'not-a-date'
         ELSE strftime(submit_ts, '%Y-%m-%d %H:%M:%S') END AS submit_text,
    CASE WHEN priority = '4-NOT SPECIFIED' THEN 'X' || CAST(case_no AS VARCHAR) ELSE CAST(case_no AS VARCHAR) END AS case_text,
    CASE WHEN priority <> '5-LOW' THEN CAST(issued AS DOUBLE) END AS issued_raw,
    CASE WHEN priority <> '1-URGENT' THEN CAST(ap AS DOUBLE) END AS ap_raw
  FROM cases)"""


@register("parse_dates_coerce", RAW_TEXT_SQL + """
SELECT case_id, CAST(coalesce(try_strptime(submit_text, '%Y-%m-%d %H:%M:%S'), try_strptime(submit_text, '%Y-%m-%d'),
                              try_strptime(submit_text, '%m/%d/%Y')) AS TIMESTAMP) AS submit_parsed
FROM raw""")
def q_parse_dates(spark, sf):
    return raw_text_cases(spark, sf).select("case_id", D.parse_dates_coerce("submit_text").alias("submit_parsed"))


@register("lead_time_days", """
SELECT case_id, CASE WHEN d >= 0 THEN d END AS lead_days
FROM (SELECT case_id, CAST(floor(epoch(status_ts - submit_ts) / 86400) AS BIGINT) AS d FROM cases)""")
def q_lead_days(spark, sf):
    return cases(spark, sf).select("case_id", D.lead_time_days("submit_ts", "status_ts").alias("lead_days"))


@register("lead_time_summary", f"""
, d AS (SELECT CASE WHEN x >= 0 THEN x END AS lead_days
        FROM (SELECT CAST(floor(epoch(status_ts - submit_ts) / 86400) AS BIGINT) AS x FROM cases))
SELECT {r('avg(CAST(lead_days AS DOUBLE))', 'mean')}, {r('median(CAST(lead_days AS DOUBLE))', 'median')},
       CAST(min(lead_days) AS DOUBLE) AS min, CAST(max(lead_days) AS DOUBLE) AS max,
       count(*) FILTER (WHERE lead_days IS NULL) AS missing, count(*) AS rows FROM d""")
def q_lead_summary(spark, sf):
    return C.lead_time_summary(D.with_lead_days(cases(spark, sf)))


@register("drop_missing_target", "SELECT case_id, lead_days FROM valid")
def q_drop_missing(spark, sf):
    return C.drop_missing_target(D.with_lead_days(cases(spark, sf))).select("case_id", "lead_days")


@register("calendar_features", """
SELECT case_id, submit_year, submit_month, submit_quarter, submit_day_of_week, submit_day_of_year FROM valid""")
def q_calendar(spark, sf):
    return D.calendar_features(cases(spark, sf), "submit_ts").filter(
        D.lead_time_days("submit_ts", "status_ts").isNotNull()).select(
        "case_id", "submit_year", "submit_month", "submit_quarter", "submit_day_of_week", "submit_day_of_year")


@register("fiscal_year_of_date", "SELECT case_id, fiscal_year FROM valid")
def q_fiscal_year(spark, sf):
    return valid(spark, sf).select("case_id", D.fiscal_year_of_date("submit_ts").alias("fiscal_year"))


@register("binary_flags", RAW_TEXT_SQL + """
SELECT case_id, CAST(coalesce(issued_raw, 0) AS INTEGER) AS is_issued, CAST(coalesce(ap_raw, 0) AS INTEGER) AS is_ap,
       refused AS is_refused, refused_221g AS is_refused_221g, ready AS is_ready FROM raw""")
def q_binary_flags(spark, sf):
    roles = ROLES.with_(flags={"issued_raw": "is_issued", "ap_raw": "is_ap", "refused": "is_refused",
                               "refused_221g": "is_refused_221g", "ready": "is_ready"})
    return FL.binary_flags(raw_text_cases(spark, sf), roles).select(
        "case_id", "is_issued", "is_ap", "is_refused", "is_refused_221g", "is_ready")


@register("case_number_numeric", RAW_TEXT_SQL + "SELECT case_id, TRY_CAST(case_text AS DOUBLE) AS case_number FROM raw")
def q_case_number(spark, sf):
    return raw_text_cases(spark, sf).select("case_id", FL.case_number_numeric("case_text").alias("case_number"))


@register("outliers_iqr", """
, b AS (SELECT quantile_cont(CAST(lead_days AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(lead_days AS DOUBLE), 0.75) AS q3 FROM valid)
SELECT case_id, lead_days FROM valid, b
WHERE lead_days >= q1 - 1.5 * (q3 - q1) AND lead_days <= q3 + 1.5 * (q3 - q1)""")
def q_outliers_iqr(spark, sf):
    # k = 1.5 here (the reference default 3 keeps every row of the driver data)
    return C.outliers_iqr(valid(spark, sf), "lead_days", 1.5).select("case_id", "lead_days")


@register("outliers_zscore", """
, s AS (SELECT avg(CAST(lead_days AS DOUBLE)) AS m, stddev_samp(CAST(lead_days AS DOUBLE)) AS sd FROM valid)
SELECT case_id, lead_days FROM valid, s WHERE abs((lead_days - m) / sd) < 2""")
def q_outliers_z(spark, sf):
    return C.outliers_zscore(valid(spark, sf), "lead_days", 2.0).select("case_id", "lead_days")


@register("outlier_report", """
, b AS (SELECT quantile_cont(CAST(lead_days AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(lead_days AS DOUBLE), 0.75) AS q3 FROM valid)
SELECT (SELECT count(*) FROM valid) AS rows_before, count(*) AS rows_after,
       (SELECT count(*) FROM valid) - count(*) AS removed,
       round(((SELECT count(*) FROM valid) - count(*)) * 100.0 / (SELECT count(*) FROM valid), 6) AS removed_pct
FROM valid, b WHERE lead_days >= q1 - 0.5 * (q3 - q1) AND lead_days <= q3 + 0.5 * (q3 - q1)""")
def q_outlier_report(spark, sf):
    v = valid(spark, sf)
    return C.outlier_report(v, C.outliers_iqr(v, "lead_days", 0.5))


@register("drop_columns_present", """
SELECT case_no, submit_ts, status_ts, office, office_id, region, status, employer, quantity, amount, discount,
       order_total, priority, lead_days, submit_year, submit_month, submit_quarter, submit_day_of_week,
       submit_day_of_year, fiscal_year, case_number FROM valid""".replace(" status,", ""))
def q_drop_columns(spark, sf):
    return C.drop_columns_present(valid(spark, sf))


@register("select_numeric", """
SELECT case_no, office_id, issued, ap, refused, refused_221g, ready, employer, quantity, amount, discount, order_total,
       lead_days, submit_year, submit_month, submit_quarter, submit_day_of_week, submit_day_of_year, fiscal_year,
       is_issued, is_ap, is_refused, is_refused_221g, is_ready, case_number FROM valid""")
def q_select_numeric(spark, sf):
    return C.select_numeric(valid(spark, sf))


@register("cyclical_encoding", "SELECT case_id, " + ", ".join(
    f"{r(f'{fn}(2 * pi() * {c} / {p})', f'{c}_{fn}')}"
    for c, p in (("submit_month", 12), ("submit_day_of_week", 7), ("submit_quarter", 4), ("submit_day_of_year", 365))
    for fn in ("sin", "cos")) + " FROM valid")
def q_cyclical(spark, sf):
    out = D.cyclical_encoding(valid(spark, sf), "submit")
    return out.select("case_id", *[f"submit_{p}_{fn}" for p in ("month", "day_of_week", "quarter", "day_of_year")
                                   for fn in ("sin", "cos")])


@register("complexity_score", """
SELECT case_id, CAST(3 * is_ap + 2 * is_refused_221g + 2 * is_refused AS DOUBLE) AS complexity_score FROM valid""")
def q_complexity(spark, sf):
    return FL.complexity_score(valid(spark, sf)).select("case_id", "complexity_score")


@register("approval_denial_flags", """
SELECT petition_id, ia AS is_initial_approval, id AS is_initial_denial, ca AS is_continuing_approval,
       cd AS is_continuing_denial, CAST(coalesce(ia = 1, false) OR coalesce(ca = 1, false) AS INTEGER) AS is_approved,
       CAST(coalesce(id = 1, false) OR coalesce(cd = 1, false) AS INTEGER) AS is_denied FROM petitions""",
          ctes=("petitions",))
def q_approval(spark, sf):
    return FL.approval_denial_flags(petition_table(spark, sf)).select(
        "petition_id", "is_initial_approval", "is_initial_denial", "is_continuing_approval", "is_continuing_denial",
        "is_approved", "is_denied")


@register("decode_onehot", """
SELECT case_id, CASE WHEN status = 'N' THEN 'N' WHEN status = 'R' THEN 'R' ELSE 'N' END AS status_decoded,
       status AS status_decoded_baseline FROM valid""")
def q_decode(spark, sf):
    oh = encode_one_hot(valid(spark, sf).select("case_id", "status"), "status", ["A", "N", "R"])
    return oh.select("case_id", FL.decode_onehot(oh, "status").alias("status_decoded"),
                     FL.decode_onehot(oh, "status", baseline="A").alias("status_decoded_baseline"))


_SEASON_SQL = """
, g AS (SELECT avg(CAST(lead_days AS DOUBLE)) AS gm FROM valid)
, mi AS (SELECT submit_month, avg(CAST(lead_days AS DOUBLE)) / (SELECT gm FROM g) AS seasonal_index_month
         FROM valid GROUP BY submit_month)
, qi AS (SELECT submit_quarter, avg(CAST(lead_days AS DOUBLE)) / (SELECT gm FROM g) AS seasonal_index_quarter
         FROM valid GROUP BY submit_quarter)"""


@register("peak_season_flag", _SEASON_SQL + f"""
SELECT case_id, {r('seasonal_index_month', 'seasonal_index_month')},
       CAST(coalesce(seasonal_index_month > 1.02, false) AS INTEGER) AS is_peak_season
FROM valid LEFT JOIN mi USING (submit_month)""")
def q_peak_flag(spark, sf):
    # threshold 1.02: the learned monthly index of the driver data stays below the default 1.1
    v = valid(spark, sf)
    idx = agg.seasonal_index(v, "submit_month")
    return v.join(idx, "submit_month", "left").select(
        "case_id", "seasonal_index_month", FL.peak_season_flag("seasonal_index_month", 1.02).alias("is_peak_season"))


@register("peak_season_static", """
SELECT case_id, CAST(submit_month IN (10, 11, 12, 1) AS INTEGER) AS is_peak_season,
       CAST(CASE WHEN submit_month IN (10, 11, 12, 1) THEN 1.2 ELSE 0.9 END AS DOUBLE) AS seasonal_index_month,
       CAST(CASE WHEN submit_quarter IN (1, 4) THEN 1.1 ELSE 0.95 END AS DOUBLE) AS seasonal_index_quarter FROM valid""")
def q_peak_static(spark, sf):
    return valid(spark, sf).select("case_id", *[v.alias(k) for k, v in
                                               FL.peak_season_static("submit_month", "submit_quarter").items()])


_FLOORED_SQL = f"""
, s AS ({office_stats_sql(rnd=False)})
, m AS (SELECT median(office_mean_days) AS mm, median(office_median_days) AS md, median(office_std_days) AS ms FROM s)
, fs AS (SELECT office, CASE WHEN office_volume < {MIN_SAMPLES} THEN mm ELSE office_mean_days END AS office_mean_days,
                CASE WHEN office_volume < {MIN_SAMPLES} THEN md ELSE office_median_days END AS office_median_days,
                CASE WHEN office_volume < {MIN_SAMPLES} THEN ms ELSE office_std_days END AS office_std_days,
                office_volume, office_approval_rate, office_ap_rate, office_refusal_rate, office_221g_rate
         FROM s, m)"""


def floored_stats(v):
    return agg.office_stats_floored(agg.office_stats(v), MIN_SAMPLES)


@register("deviation_from_office", _FLOORED_SQL + f"""
SELECT case_id, {r('CAST(lead_days AS DOUBLE) - office_mean_days', 'deviation_from_office')}
FROM valid JOIN fs USING (office)""")
def q_deviation(spark, sf):
    v = valid(spark, sf)
    return v.join(floored_stats(v), "office", "left").select(
        "case_id", FL.deviation_from_office().alias("deviation_from_office"))


@register("speed_category", _FLOORED_SQL + """
SELECT case_id,
  CASE WHEN lead_days < office_mean_days - 0.5 * office_std_days THEN 'Fast'
       WHEN lead_days > office_mean_days + 0.5 * office_std_days THEN 'Slow' ELSE 'Normal' END AS category,
  CASE WHEN lead_days < office_mean_days - 0.5 * office_std_days THEN 'green'
       WHEN lead_days > office_mean_days + 0.5 * office_std_days THEN 'red' ELSE 'orange' END AS category_color
FROM valid JOIN fs USING (office)""")
def q_speed(spark, sf):
    v = valid(spark, sf)
    j = v.join(floored_stats(v), "office", "left")
    return j.select("case_id", *[c.alias(k) for k, c in
                                 FL.speed_category("lead_days", "office_mean_days", "office_std_days").items()])


_INTERVAL_SQL = """
, iv AS (SELECT case_id, submit_ts, greatest(office_median_days, 0.0) AS p, office_std_days AS e FROM valid JOIN fs USING (office))"""


@register("prediction_interval", _FLOORED_SQL + _INTERVAL_SQL + """
SELECT case_id, round_even(p, 1) AS predicted_days, round_even(greatest(p - e, 0.0), 1) AS lower_bound,
       round_even(p + e, 1) AS upper_bound, round_even(p / 30.44, 1) AS predicted_months FROM iv""")
def q_interval(spark, sf):
    v = valid(spark, sf)
    j = v.join(floored_stats(v), "office", "left")
    return j.select("case_id", *[c.alias(k) for k, c in
                                 FL.prediction_interval("office_median_days", F.col("office_std_days")).items()])


@register("completion_dates", _FLOORED_SQL + _INTERVAL_SQL + """
SELECT case_id, CAST(submit_ts AS DATE) + CAST(trunc(greatest(p - e, 0.0)) AS INTEGER) AS date_low,
       CAST(submit_ts AS DATE) + CAST(trunc(p) AS INTEGER) AS date_mid,
       CAST(submit_ts AS DATE) + CAST(trunc(p + e) AS INTEGER) AS date_high FROM iv""")
def q_completion(spark, sf):
    v = valid(spark, sf)
    j = v.join(floored_stats(v), "office", "left")
    p = F.greatest(F.col("office_median_days"), F.lit(0.0))
    e = F.col("office_std_days")
    d = D.completion_dates("submit_ts", date_low=F.greatest(p - e, F.lit(0.0)), date_mid=p, date_high=p + e)
    return j.select("case_id", *[c.alias(k) for k, c in d.items()])


@register("advice_tags", _FLOORED_SQL + """
, t AS (SELECT case_id, list_filter([
          CASE WHEN submit_month IN (10, 11, 12, 1) THEN 'peak_season' END,
          CASE WHEN office_ap_rate * 100 > 15 THEN 'high_ap_rate' END,
          CASE WHEN office_refusal_rate * 100 > 20 THEN 'high_refusal_rate' END,
          CASE WHEN lead_days > office_mean_days + 0.5 * office_std_days THEN 'slow' END,
          CASE WHEN lead_days < office_mean_days - 0.5 * office_std_days THEN 'fast' END], lambda x: x IS NOT NULL) AS tags
        FROM valid JOIN fs USING (office))
SELECT case_id, CASE WHEN len(tags) = 0 THEN 'typical' ELSE array_to_string(tags, ',') END AS tags FROM t""")
def q_advice(spark, sf):
    v = valid(spark, sf)
    j = v.join(floored_stats(v), "office", "left")
    cat = FL.speed_category("lead_days", "office_mean_days", "office_std_days")["category"]
    tags = FL.advice_tags(F.col("submit_month").isin(*FL.PEAK_MONTHS), F.col("office_ap_rate") * 100,
                          F.col("office_refusal_rate") * 100, cat)
    return j.select("case_id", F.array_join(tags, ",").alias("tags"))


@register("validate_requests", """
, req AS (SELECT case_id,
    CASE WHEN status = 'R' THEN '  ' ELSE '  ' || lower(office) || ' ' END AS office_in,
    CASE WHEN priority = '2-HIGH' THEN 'not-a-date' WHEN priority = '3-MEDIUM' THEN NULL
         ELSE strftime(submit_ts, '%Y-%m-%d') END AS date_in,
    CASE WHEN priority = '4-NOT SPECIFIED' THEN NULL WHEN status = 'A' AND ready = 1 THEN '0'
         WHEN status = 'N' AND ready = 1 THEN '3.7' ELSE CAST(case_no AS VARCHAR) END AS num_in
  FROM cases)
, v AS (SELECT case_id, upper(trim(office_in)) AS office_code,
          CASE WHEN regexp_full_match(trim(date_in), '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN TRY_CAST(trim(date_in) AS DATE) END AS submit_dt,
          CASE WHEN num_in IS NULL THEN 1000 WHEN regexp_full_match(trim(num_in), '[+-]?[0-9]{1,18}') THEN CAST(trim(num_in) AS BIGINT) END AS case_no,
          date_in
        FROM req)
SELECT case_id, office_code, submit_dt, case_no,
  CASE WHEN office_code = '' THEN 'Required field.' END AS err_office,
  CASE WHEN coalesce(trim(date_in), '') = '' THEN 'Required field (YYYY-MM-DD).'
       WHEN submit_dt IS NULL THEN 'Must be YYYY-MM-DD format.' END AS err_submit_date,
  CASE WHEN case_no IS NULL OR case_no < 1 THEN 'Must be a positive integer.' END AS err_case_number
FROM v""", ctes=("cases",))
def q_validate(spark, sf):
    c = cases(spark, sf)
    req = c.select(
        "case_id",
        F.when(F.col("status") == "R", F.lit("  ")).otherwise(F.concat(F.lit("  "), F.lower("office"), F.lit(" "))).alias("office_in"),
        F.when(F.col("priority") == "2-HIGH", F.lit("not-a-date")).when(F.col("priority") == "3-MEDIUM", F.lit(None))
         .otherwise(F.date_format("submit_ts", "yyyy-MM-dd")).alias("date_in"),
        F.when(F.col("priority") == "4-NOT SPECIFIED", F.lit(None))
         .when((F.col("status") == "A") & (F.col("ready") == 1), F.lit("0"))
         .when((F.col("status") == "N") & (F.col("ready") == 1), F.lit("3.7"))
         .otherwise(F.col("case_no").cast("string")).alias("num_in"))
    v = C.validate_requests(req, "office_in", "date_in", "num_in")
    return v.select("case_id", "office_code", "submit_dt", F.col("case_no").cast("long").alias("case_no"),
                    F.col("errors")["office"].alias("err_office"), F.col("errors")["submit_date"].alias("err_submit_date"),
                    F.col("errors")["case_number"].alias("err_case_number"))


_PROFILE_SQL = _FLOORED_SQL + """
, prof AS (SELECT office, round_even(office_approval_rate * 100, 1) AS approval_rate_pct, round_even(office_ap_rate * 100, 1) AS ap_rate_pct,
                  round_even(office_refusal_rate * 100, 1) AS refusal_rate_pct, round_even(office_221g_rate * 100, 1) AS refusal_221g_pct FROM fs)"""


@register("outcome_breakdown", _PROFILE_SQL + f"""
, long AS (SELECT office, 0 AS pos, 'Issued' AS segment, approval_rate_pct AS pct FROM prof
     UNION ALL SELECT office, 1, 'Admin. Processing', ap_rate_pct FROM prof
     UNION ALL SELECT office, 2, 'Refused', refusal_rate_pct FROM prof
     UNION ALL SELECT office, 3, 'Refused 221g', refusal_221g_pct FROM prof)
SELECT office, pos, segment, {r('pct', 'pct')},
  {r('coalesce(sum(pct) OVER (PARTITION BY office ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)', 'left')}
FROM long""")
def q_outcome(spark, sf):
    from .score import office_profile
    prof = office_profile(floored_stats(valid(spark, sf)))
    return C.outcome_breakdown(prof, "office")
