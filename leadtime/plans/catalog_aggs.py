"""Registered checks for aggregations, chart tables and joins (§2.4, §2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.flags import approval_denial_flags, complexity_score
from ..operators import aggregates as agg
from ..operators import charts as CH
from ..operators import joins as J
from ..operators.encode import label_codes, encode_apply_default
from ..roles import ROLES
from .registry import petition_table, r, register, valid
from .catalog_queries import MIN_SAMPLES
from .catalog_rows import _FLOORED_SQL, _SEASON_SQL, floored_stats
from .features import FiscalYearTrend, SeasonalIndex
from .score import list_offices, office_profile

D = "CAST(lead_days AS DOUBLE)"


@register("seasonal_index_month", _SEASON_SQL + f"""
SELECT submit_month, {r('seasonal_index_month', 'seasonal_index_month')} FROM mi""")
def q_si_month(spark, sf):
    return agg.seasonal_index(valid(spark, sf), "submit_month", ROLES, "seasonal_index_month")


@register("seasonal_index_quarter", _SEASON_SQL + f"""
SELECT submit_quarter, {r('seasonal_index_quarter', 'seasonal_index_quarter')} FROM qi""")
def q_si_quarter(spark, sf):
    return agg.seasonal_index(valid(spark, sf), "submit_quarter", ROLES, "seasonal_index_quarter")


@register("join_agg_back_month", _SEASON_SQL + f"""
SELECT case_id, {r('seasonal_index_month', 'seasonal_index_month')} FROM valid LEFT JOIN mi USING (submit_month)""")
def q_join_month(spark, sf):
    v = valid(spark, sf)
    return SeasonalIndex().fit(v).transform(v).select("case_id", "seasonal_index_month")


@register("join_agg_back_quarter", _SEASON_SQL + f"""
SELECT case_id, {r('seasonal_index_quarter', 'seasonal_index_quarter')} FROM valid LEFT JOIN qi USING (submit_quarter)""")
def q_join_quarter(spark, sf):
    v = valid(spark, sf)
    return SeasonalIndex().fit(v).transform(v).select("case_id", "seasonal_index_quarter")


_OFFICE_COLS = ("office_mean_days", "office_median_days", "office_std_days", "office_approval_rate",
                "office_ap_rate", "office_refusal_rate", "office_221g_rate")


@register("join_office_stats", _FLOORED_SQL + "SELECT case_id, office_volume, " + ", ".join(
    r(c, c) for c in _OFFICE_COLS) + " FROM valid LEFT JOIN fs USING (office)")
def q_join_office(spark, sf):
    v = valid(spark, sf)
    return J.join_back(v, floored_stats(v), "office").select("case_id", "office_volume", *_OFFICE_COLS)


_FY_SQL = f"""
, fy AS (SELECT fiscal_year, avg({D}) AS fiscal_year_mean_days FROM valid GROUP BY fiscal_year)
, fyi AS (SELECT fiscal_year, fiscal_year_mean_days,
                 CAST(dense_rank() OVER (ORDER BY fiscal_year) - 1 AS DOUBLE) / greatest(count(*) OVER () - 1, 1) AS fiscal_year_index
          FROM fy)"""


@register("fiscal_year_trend", _FY_SQL + f"""
SELECT fiscal_year, {r('fiscal_year_mean_days', 'fiscal_year_mean_days')}, {r('fiscal_year_index', 'fiscal_year_index')} FROM fyi""")
def q_fy_trend(spark, sf):
    return agg.fiscal_year_trend(valid(spark, sf))


@register("join_fiscal_year_mean", _FY_SQL + f"""
SELECT case_id, {r('fiscal_year_mean_days', 'fiscal_year_mean_days')}, {r('fiscal_year_index', 'fiscal_year_index')}
FROM valid LEFT JOIN fyi USING (fiscal_year)""")
def q_join_fy(spark, sf):
    v = valid(spark, sf)
    return FiscalYearTrend().fit(v).transform(v).select("case_id", "fiscal_year_mean_days", "fiscal_year_index")


@register("employer_counts", """
SELECT petition_id, CASE WHEN employer IS NOT NULL THEN count(*) OVER (PARTITION BY employer) END AS employer_count
FROM petitions""", ctes=("petitions",))
def q_employer_counts(spark, sf):
    return agg.key_counts(petition_table(spark, sf), "employer", "employer_count").select("petition_id", "employer_count")


@register("state_counts", """
SELECT petition_id, CASE WHEN state IS NOT NULL THEN count(*) OVER (PARTITION BY state) END AS state_count
FROM petitions""", ctes=("petitions",))
def q_state_counts(spark, sf):
    return agg.key_counts(petition_table(spark, sf), "state", "state_count").select("petition_id", "state_count")


@register("distribution_summary", f"""
SELECT count({D}) AS count, {r(f'avg({D})', 'mean')}, {r(f'stddev_samp({D})', 'std')}, min({D}) AS min,
  {r(f'quantile_cont({D}, 0.10)', 'p10')}, {r(f'quantile_cont({D}, 0.25)', 'p25')}, {r(f'quantile_cont({D}, 0.50)', 'p50')},
  {r(f'quantile_cont({D}, 0.75)', 'p75')}, {r(f'quantile_cont({D}, 0.90)', 'p90')}, {r(f'quantile_cont({D}, 0.95)', 'p95')},
  {r(f'quantile_cont({D}, 0.99)', 'p99')}, max({D}) AS max FROM valid""")
def q_dist(spark, sf):
    return agg.distribution_summary(valid(spark, sf), "lead_days")


@register("skew_kurtosis", f"""
, m AS (SELECT avg({D}) AS mu FROM valid)
, c AS (SELECT avg(power({D} - mu, 2)) AS m2, avg(power({D} - mu, 3)) AS m3, avg(power({D} - mu, 4)) AS m4 FROM valid, m)
SELECT {r('m3 / power(m2, 1.5)', 'skewness')}, {r('m4 / (m2 * m2) - 3', 'kurtosis')} FROM c""")
def q_skew(spark, sf):
    return agg.skew_kurtosis(valid(spark, sf), "lead_days")


@register("histogram", f"""
, mm AS (SELECT min({D}) AS lo, max({D}) AS hi FROM valid)
, b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor(({D} - lo) * 60.0 / (hi - lo)) AS BIGINT) + 1, 60) END AS bin
        FROM valid, mm)
, c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin)
SELECT d.bin, {r('lo + (d.bin - 1) * ((hi - lo) / 60.0)', 'bin_lo')}, {r('lo + d.bin * ((hi - lo) / 60.0)', 'bin_hi')},
       coalesce(cnt, 0) AS count
FROM (SELECT range AS bin FROM range(1, 61)) d LEFT JOIN c USING (bin), mm""")
def q_hist(spark, sf):
    return CH.histogram(valid(spark, sf), "lead_days", 60)


@register("kde_curve", f"""
, st AS (SELECT min({D}) AS lo, max({D}) AS hi, count(*) AS n, stddev_samp({D}) * power(CAST(count(*) AS DOUBLE), -0.2) AS h FROM valid)
, vc AS (SELECT {D} AS x, count(*) AS w FROM valid GROUP BY 1)
, g AS (SELECT range AS i FROM range(0, 200))
, p AS (SELECT i, lo + (hi - lo) * i / 199.0 AS gx, sum(w * exp(-0.5 * ((lo + (hi - lo) * i / 199.0 - x) / h) * ((lo + (hi - lo) * i / 199.0 - x) / h))) AS s, n, h
        FROM g, vc, st GROUP BY i, lo, hi, n, h)
SELECT CAST(i AS INTEGER) AS i, {r('gx', 'x')}, round(s / (n * h * sqrt(2 * pi())), 12) AS density FROM p""")
def q_kde(spark, sf):
    out = CH.kde_curve(valid(spark, sf), "lead_days", 200)
    return out.withColumn("density", F.round("density", 12))


@register("kde_curve_by_group", f"""
, st AS (SELECT region, min(amount) AS lo, max(amount) AS hi, count(*) AS n, stddev_samp(amount) * power(CAST(count(*) AS DOUBLE), -0.2) AS h
         FROM (SELECT region, CAST(amount AS DOUBLE) AS amount FROM valid WHERE amount IS NOT NULL AND region IS NOT NULL) GROUP BY region HAVING max(amount) > min(amount))
, p AS (SELECT region, (CAST(amount AS DOUBLE) - lo) * 1023.0 / (hi - lo) AS spot FROM valid JOIN st USING (region) WHERE amount IS NOT NULL)
, q AS (SELECT region, CAST(least(floor(spot), 1022) AS INTEGER) AS b, spot - least(floor(spot), 1022) AS f FROM p)
, w AS (SELECT region, b, sum(w) AS w FROM (SELECT region, b, sum(1 - f) AS w FROM q GROUP BY ALL UNION ALL SELECT region, b + 1, sum(f) FROM q GROUP BY ALL) GROUP BY ALL)
, g AS (SELECT range AS i FROM range(0, 200))
, c AS (SELECT region, i, lo + (hi - lo) * i / 199.0 AS x, n, h, sum(w * exp(-0.5 * power((lo + (hi - lo) * i / 199.0 - (lo + (hi - lo) * b / 1023.0)) / h, 2))) AS s
        FROM w JOIN st USING (region), g GROUP BY region, i, lo, hi, n, h)
SELECT region, CAST(i AS INTEGER) AS i, {r('x', 'x')}, round(s / (n * h * sqrt(2 * pi())), 12) AS density FROM c""")
def q_kde_group(spark, sf):
    return CH.kde_binned(valid(spark, sf), "amount", 200, 1024, "region").withColumn("density", F.round("density", 12))


@register("box_stats", f"""
, q AS (SELECT quantile_cont({D}, 0.25) AS q1, quantile_cont({D}, 0.5) AS med, quantile_cont({D}, 0.75) AS q3 FROM valid)
SELECT {r('q1', 'q1')}, {r('med', 'median')}, {r('q3', 'q3')},
  min({D}) FILTER (WHERE {D} >= q1 - 1.5 * (q3 - q1)) AS whisker_lo, max({D}) FILTER (WHERE {D} <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
  count(*) FILTER (WHERE {D} < q1 - 1.5 * (q3 - q1) OR {D} > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
FROM valid, q GROUP BY q1, med, q3""")
def q_box(spark, sf):
    return CH.box_stats(valid(spark, sf), "lead_days")


@register("box_stats_by_group", f"""
, q AS (SELECT region, quantile_cont({D}, 0.25) AS q1, quantile_cont({D}, 0.5) AS med, quantile_cont({D}, 0.75) AS q3
        FROM valid WHERE region IS NOT NULL GROUP BY region)
SELECT region, {r('q1', 'q1')}, {r('med', 'median')}, {r('q3', 'q3')},
  min({D}) FILTER (WHERE {D} >= q1 - 1.5 * (q3 - q1)) AS whisker_lo, max({D}) FILTER (WHERE {D} <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
  count(*) FILTER (WHERE {D} < q1 - 1.5 * (q3 - q1) OR {D} > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
FROM valid JOIN q USING (region) GROUP BY region, q1, med, q3""")
def q_box_group(spark, sf):
    return CH.box_stats_by_group(valid(spark, sf), "region", "lead_days")


@register("status_distribution", """
SELECT status, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
FROM valid WHERE status IS NOT NULL GROUP BY status""")
def q_status(spark, sf):
    return agg.status_distribution(valid(spark, sf), "status")


@register("median_by_status", f"SELECT status, {r(f'median({D})', 'median_days')} FROM valid WHERE status IS NOT NULL GROUP BY status")
def q_median_status(spark, sf):
    return agg.median_by(valid(spark, sf), "status").orderBy(F.desc("median_days"))


@register("monthly_pattern", f"""
, a AS (SELECT submit_month, median({D}) AS md, avg({D}) AS mn, count(lead_days) AS cnt FROM valid GROUP BY submit_month)
SELECT CAST(m.range AS INTEGER) AS submit_month, {r('md', 'median_days')}, {r('mn', 'mean_days')}, cnt AS count
FROM range(1, 13) m LEFT JOIN a ON a.submit_month = m.range""")
def q_monthly(spark, sf):
    return agg.monthly_pattern(valid(spark, sf))


@register("quarterly_pattern", f"""
SELECT submit_quarter, {r(f'median({D})', 'median_days')} FROM valid WHERE submit_quarter IS NOT NULL GROUP BY submit_quarter""")
def q_quarterly(spark, sf):
    return agg.quarterly_pattern(valid(spark, sf))


@register("day_of_week_pattern", f"""
, a AS (SELECT submit_day_of_week, median({D}) AS md FROM valid GROUP BY submit_day_of_week)
SELECT CAST(d.range AS INTEGER) AS submit_day_of_week, {r('md', 'median_days')}
FROM range(0, 7) d LEFT JOIN a ON a.submit_day_of_week = d.range""")
def q_dow(spark, sf):
    return agg.day_of_week_pattern(valid(spark, sf))


@register("fiscal_year_pattern", f"""
SELECT fiscal_year, {r(f'median({D})', 'median_days')}, count(*) AS count FROM valid GROUP BY fiscal_year""")
def q_fy_pattern(spark, sf):
    return agg.fiscal_year_pattern(valid(spark, sf))


@register("region_stats", f"""
SELECT region, {r(f'avg({D})', 'mean_days')}, {r(f'median({D})', 'median_days')}, count({D}) AS count
FROM valid WHERE region IS NOT NULL GROUP BY region""")
def q_region(spark, sf):
    return agg.region_stats(valid(spark, sf), "region")


@register("ap_rate_top", f"""
SELECT office, {r('avg(CAST(is_ap AS DOUBLE))', 'ap_rate')}, count(is_ap) AS count FROM valid
WHERE office IS NOT NULL GROUP BY office HAVING count(is_ap) >= {MIN_SAMPLES}
ORDER BY avg(CAST(is_ap AS DOUBLE)) DESC, office LIMIT 15""")
def q_ap_rate(spark, sf):
    return agg.ap_rate_top(valid(spark, sf), ROLES, "is_ap", MIN_SAMPLES, 15)


@register("seasonal_index_bands", _SEASON_SQL + f"""
SELECT CAST(m.range AS INTEGER) AS submit_month, {r('seasonal_index_month', 'seasonal_index_month')},
  CASE WHEN seasonal_index_month > 1.05 THEN 'slower' WHEN seasonal_index_month < 0.95 THEN 'faster' ELSE 'average' END AS band
FROM range(1, 13) m LEFT JOIN mi ON mi.submit_month = m.range""")
def q_bands(spark, sf):
    v = valid(spark, sf)
    eng = SeasonalIndex().fit(v).transform(v)
    return agg.seasonal_index_bands(eng)


@register("office_approval_vs_mean", f"""
SELECT office, {r(f'avg({D})', 'mean_days')}, {r('avg(CAST(is_issued AS DOUBLE))', 'approval_rate')}, count(*) AS volume,
       {r('2.0 * sqrt(CAST(count(*) AS DOUBLE))', 'bubble_size')}
FROM valid WHERE office IS NOT NULL GROUP BY office HAVING count(*) >= {MIN_SAMPLES}""")
def q_office_approval(spark, sf):
    return agg.office_approval_vs_mean(valid(spark, sf), ROLES, MIN_SAMPLES)


@register("complexity_vs_lead", f"""
SELECT CAST(3 * is_ap + 2 * is_refused_221g + 2 * is_refused AS DOUBLE) AS complexity_score,
       {r(f'avg({D})', 'mean_days')}, {r(f'median({D})', 'median_days')}, count({D}) AS count
FROM valid GROUP BY 1""")
def q_complexity_lead(spark, sf):
    return agg.complexity_vs_lead(complexity_score(valid(spark, sf)))


@register("h1b_summary", """
SELECT count(*) AS rows,
  round(avg(CAST(coalesce(ia = 1, false) OR coalesce(ca = 1, false) AS DOUBLE)) * 100.0, 6) AS approval_pct,
  round(avg(CAST(coalesce(id = 1, false) OR coalesce(cd = 1, false) AS DOUBLE)) * 100.0, 6) AS denial_pct,
  min(fiscal_year) AS min_fiscal_year, max(fiscal_year) AS max_fiscal_year FROM petitions""", ctes=("petitions",))
def q_h1b_summary(spark, sf):
    return agg.petition_summary(approval_denial_flags(petition_table(spark, sf)))


_ENG_OFFICE_SQL = _FLOORED_SQL + ", eng AS (SELECT * FROM valid LEFT JOIN fs USING (office))"


@register("global_office_defaults", _ENG_OFFICE_SQL + "\nSELECT " + ", ".join(
    r(f"avg(CAST({c} AS DOUBLE))", c) for c in ("office_mean_days", "office_median_days", "office_std_days",
                                                 "office_volume", "office_approval_rate", "office_ap_rate",
                                                 "office_refusal_rate", "office_221g_rate"))
          + ", min(fiscal_year) AS fy_min, max(fiscal_year) AS fy_max FROM eng")
def q_global_defaults(spark, sf):
    v = valid(spark, sf)
    return agg.global_office_defaults(J.join_back(v, floored_stats(v), "office"))


@register("office_profile", _FLOORED_SQL + """
SELECT office, round_even(office_mean_days, 1) AS mean_processing_days, round_even(office_median_days, 1) AS median_processing_days,
  round_even(office_std_days, 1) AS std_processing_days, CAST(office_volume AS INTEGER) AS total_cases,
  round_even(office_approval_rate * 100, 1) AS approval_rate_pct, round_even(office_ap_rate * 100, 1) AS ap_rate_pct,
  round_even(office_refusal_rate * 100, 1) AS refusal_rate_pct, round_even(office_221g_rate * 100, 1) AS refusal_221g_pct FROM fs""")
def q_office_profile(spark, sf):
    return office_profile(floored_stats(valid(spark, sf)))


_LABELS_SQL = """
, labels AS (SELECT n_name AS code, lower(n_name) || ' office' AS label FROM nation WHERE n_regionkey <> 0)"""


def _labels(spark, sf):
    from ..roles import read_table
    n = read_table(spark, sf, "nation")
    return n.filter(F.col("n_regionkey") != 0).select(F.col("n_name").alias("code"),
                                                     F.concat(F.lower("n_name"), F.lit(" office")).alias("label"))


@register("list_offices", _FLOORED_SQL + _LABELS_SQL + """
SELECT office AS code, coalesce(label, office) AS label, round_even(office_mean_days, 1) AS mean_days,
       round_even(office_approval_rate * 100, 1) AS approval_rate_pct
FROM fs LEFT JOIN labels ON fs.office = labels.code""", ctes=("cases", "valid"))
def q_list_offices(spark, sf):
    return list_offices(floored_stats(valid(spark, sf)), "office", _labels(spark, sf))


@register("map_lookup", _LABELS_SQL + """
SELECT case_id, coalesce(label, office) AS office_label FROM valid LEFT JOIN labels ON valid.office = labels.code""")
def q_map_lookup(spark, sf):
    return J.map_lookup(valid(spark, sf), "office", _labels(spark, sf), "code", "label", "office_label") \
            .select("case_id", "office_label")


@register("join_inner_known_codes", _LABELS_SQL + """
SELECT case_id, label FROM valid JOIN labels ON valid.office = labels.code""")
def q_inner_known(spark, sf):
    return J.join_inner_known(valid(spark, sf), "office", _labels(spark, sf), "code").select("case_id", "label")


_KNOWN_SQL = """
, known AS (SELECT * FROM fs WHERE office IN (SELECT n_name FROM nation WHERE n_regionkey <> 1))
, gstats AS (SELECT avg(office_mean_days) AS g_mean, avg(office_std_days) AS g_std FROM valid JOIN fs USING (office))"""


@register("join_fallback_global", _FLOORED_SQL + _KNOWN_SQL + f"""
SELECT case_id, {r('coalesce(k.office_mean_days, g_mean, 580.0)', 'office_mean_days')},
       {r('coalesce(k.office_std_days, g_std, 98.0)', 'office_std_days')},
       {r('coalesce(CAST(k.office_volume AS DOUBLE), 1000.0)', 'office_volume')},
       k.office IS NOT NULL AS office_known
FROM valid LEFT JOIN known k USING (office), gstats""")
def q_fallback(spark, sf):
    from ..roles import read_table
    v = valid(spark, sf)
    st = floored_stats(v)
    keep = read_table(spark, sf, "nation").filter(F.col("n_regionkey") != 1).select(F.col("n_name").alias("office"))
    known = st.join(keep, "office", "left_semi")
    eng = J.join_back(v, st, "office")
    glob = eng.agg(F.avg("office_mean_days").alias("office_mean_days"), F.avg("office_std_days").alias("office_std_days"))
    out = J.join_fallback_global(v.select("case_id", "office"), "office", known, "office", glob)
    return out.select("case_id", "office_mean_days", "office_std_days", "office_volume", "office_known")


@register("semi_top_n", """
, top AS (SELECT office FROM valid WHERE office IS NOT NULL GROUP BY office ORDER BY count(*) DESC, office LIMIT 10)
SELECT case_id, office FROM valid WHERE office IN (SELECT office FROM top)""")
def q_semi(spark, sf):
    return J.semi_top_n(valid(spark, sf), "office", 10).select("case_id", "office")


@register("encode_apply_default", _LABELS_SQL + """
, codes AS (SELECT code AS value, row_number() OVER (ORDER BY code) - 1 AS code FROM labels)
SELECT case_id, coalesce(codes.code, 0) AS office_code
FROM valid LEFT JOIN codes ON upper(trim(lower(valid.office))) = codes.value""")
def q_apply_default(spark, sf):
    codes = label_codes(_labels(spark, sf), "code")
    req = valid(spark, sf).select("case_id", F.lower("office").alias("office_in"))
    return encode_apply_default(req, "office_in", codes, "office_code", 0).select("case_id", "office_code")
