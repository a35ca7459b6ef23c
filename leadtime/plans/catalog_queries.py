"""Registered queries, grouped as in the operator inventory (aggregations first)."""

from __future__ import annotations

from ..operators import aggregates as agg
from ..roles import ROLES
from .registry import register, r, valid

# Parameters of the test binding: 25 offices with 296..3,172 valid rows at sf0.01, so 500 makes
# the low-volume branches fire (the reference defaults 30/50 would never trigger).
MIN_SAMPLES = 500



def office_stats_sql(source: str = "valid", rnd: bool = True) -> str:
    def x(e, a):
        return r(e, a) if rnd else f"{e} AS {a}"
    return f"""
SELECT office, {x('avg(CAST(lead_days AS DOUBLE))', 'office_mean_days')},
       {x('median(CAST(lead_days AS DOUBLE))', 'office_median_days')},
       {x('stddev_samp(CAST(lead_days AS DOUBLE))', 'office_std_days')},
       count(lead_days) AS office_volume,
       {x('avg(CAST(is_issued AS DOUBLE))', 'office_approval_rate')},
       {x('avg(CAST(is_ap AS DOUBLE))', 'office_ap_rate')},
       {x('avg(CAST(is_refused AS DOUBLE))', 'office_refusal_rate')},
       {x('avg(CAST(is_refused_221g AS DOUBLE))', 'office_221g_rate')}
FROM {source} WHERE office IS NOT NULL GROUP BY office"""


_OFFICE_STATS_SQL = office_stats_sql()


@register("office_stats", _OFFICE_STATS_SQL)
def q_office_stats(spark, sf):
    return agg.office_stats(valid(spark, sf))


@register("office_stats_floored", f"""
, s AS ({office_stats_sql(rnd=False)})
, m AS (SELECT median(office_mean_days) AS mm, median(office_median_days) AS md, median(office_std_days) AS ms FROM s)
SELECT office,
  {r(f'CASE WHEN office_volume < {MIN_SAMPLES} THEN mm ELSE office_mean_days END', 'office_mean_days')},
  {r(f'CASE WHEN office_volume < {MIN_SAMPLES} THEN md ELSE office_median_days END', 'office_median_days')},
  {r(f'CASE WHEN office_volume < {MIN_SAMPLES} THEN ms ELSE office_std_days END', 'office_std_days')},
  office_volume, {r('office_approval_rate', 'office_approval_rate')}, {r('office_ap_rate', 'office_ap_rate')},
  {r('office_refusal_rate', 'office_refusal_rate')}, {r('office_221g_rate', 'office_221g_rate')}
FROM s, m""")
def q_office_stats_floored(spark, sf):
    return agg.office_stats_floored(agg.office_stats(valid(spark, sf)), MIN_SAMPLES)


@register("top_office_volume", """
SELECT office, count(*) AS volume FROM valid WHERE office IS NOT NULL
GROUP BY office ORDER BY volume DESC, office LIMIT 20""")
def q_top_office_volume(spark, sf):
    return agg.top_office_volume(valid(spark, sf), ROLES, 20)


@register("top_office_median", f"""
, top AS (SELECT office FROM valid WHERE office IS NOT NULL GROUP BY office ORDER BY count(*) DESC, office LIMIT 20)
SELECT office, {r('median(CAST(lead_days AS DOUBLE))', 'median_days')}, count(*) AS volume
FROM valid WHERE office IN (SELECT office FROM top) GROUP BY office""")
def q_top_office_median(spark, sf):
    return agg.top_office_median(valid(spark, sf), ROLES, 20)
