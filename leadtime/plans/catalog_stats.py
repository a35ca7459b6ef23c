"""Registered checks for correlations (§2.6), windows (§2.7) and evaluation tables (§2.12, SQL part).

Evaluation tables run over the predictions of closed-form predictors (global mean, office
mean/median, month mean), so Spark and DuckDB see identical predictions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as CR
from ..operators import windows as W
from ..operators.charts import numeric_hist_grid
from ..operators.joins import join_back
from ..session import cut_lineage
from .registry import FEATURE_INPUT, kept_valid, r, register, valid
from .catalog_rows import _FLOORED_SQL, floored_stats
from .metrics import error_distribution, model_scorecard, regression_metrics, residual_points, residual_table, train_test_split

# Numeric columns of the correlation input (one with nulls, one constant).
CORR_COLS = ("lead_days", "quantity", "amount_n", "discount", "order_total", "submit_month", "submit_day_of_week",
             "submit_day_of_year", "case_number", "is_ap", "is_refused", "const_zero")


def corr_input(spark, sf):
    v = valid(spark, sf)
    return v.select("case_id", "lead_days", "quantity",
                    F.when(F.col("status") == "R", F.lit(None)).otherwise(F.col("amount")).alias("amount_n"),
                    "discount", "order_total", "submit_month", "submit_day_of_week", "submit_day_of_year",
                    "case_number", "is_ap", "is_refused", F.lit(0).alias("const_zero"))


CORR_SQL = """
, ci AS (SELECT case_id, lead_days, quantity, CASE WHEN status = 'R' THEN NULL ELSE amount END AS amount_n, discount,
                order_total, submit_month, submit_day_of_week, submit_day_of_year, case_number, is_ap, is_refused,
                0 AS const_zero FROM valid)"""


def pearson_sql(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER (WHERE {both}) * "
            f"stddev_pop({y}) FILTER (WHERE {both}), 0)")


_TC_SQL = CORR_SQL + """
, tc AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {pearson_sql(c, 'lead_days')} AS corr FROM ci"
                                  for c in CORR_COLS) + ")"


@register("corr_with_target_abs", _TC_SQL + f"""
SELECT feature, {r('abs(corr)', 'abs_corr')} FROM tc WHERE corr IS NOT NULL ORDER BY abs(corr) DESC, feature LIMIT 15""")
def q_corr_abs(spark, sf):
    return CR.corr_with_target_abs(corr_input(spark, sf).drop("case_id"))


@register("corr_with_target_signed", _TC_SQL + f"""
SELECT feature, {r('corr', 'corr')} FROM tc WHERE corr IS NOT NULL AND feature <> 'lead_days'
ORDER BY abs(corr) DESC, feature LIMIT 15""")
def q_corr_signed(spark, sf):
    return CR.corr_with_target_signed(corr_input(spark, sf).drop("case_id"))


_PAIRS = [(a, b) for a in CORR_COLS for b in CORR_COLS if a != b]


@register("corr_matrix", _TC_SQL + """
, rk AS (SELECT feature, row_number() OVER (ORDER BY abs(corr) DESC, feature) AS pos FROM tc WHERE corr IS NOT NULL)
, pr AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS row, '{b}' AS col, {pearson_sql(a, b)} AS corr FROM ci"
                                  for a, b in _PAIRS) + f""")
SELECT pr.row, pr.col, {r('pr.corr', 'corr')} FROM pr JOIN rk a ON pr.row = a.feature JOIN rk b ON pr.col = b.feature
WHERE a.pos > b.pos AND a.pos <= 25 AND b.pos <= 25""")
def q_corr_matrix(spark, sf):
    return CR.corr_matrix(cut_lineage(corr_input(spark, sf).drop("case_id"), "corr"), "lead_days", 25)


_ENG_SQL = _FLOORED_SQL + """
, g AS (SELECT avg(CAST(lead_days AS DOUBLE)) AS gm FROM valid)
, mi AS (SELECT submit_month, avg(CAST(lead_days AS DOUBLE)) / (SELECT gm FROM g) AS seasonal_index_month FROM valid GROUP BY 1)
, qi AS (SELECT submit_quarter, avg(CAST(lead_days AS DOUBLE)) / (SELECT gm FROM g) AS seasonal_index_quarter FROM valid GROUP BY 1)
, fy AS (SELECT fiscal_year, avg(CAST(lead_days AS DOUBLE)) AS fiscal_year_mean_days FROM valid GROUP BY fiscal_year)
, fyi AS (SELECT fiscal_year, CAST(dense_rank() OVER (ORDER BY fiscal_year) - 1 AS DOUBLE) / greatest(count(*) OVER () - 1, 1)
                 AS fiscal_year_index FROM fy)
, eng AS (SELECT valid.*, seasonal_index_month, seasonal_index_quarter,
                 CAST(coalesce(seasonal_index_month > 1.1, false) AS INTEGER) AS is_peak_season,
                 office_mean_days, office_median_days, office_std_days, office_volume, office_approval_rate,
                 office_ap_rate, office_refusal_rate, office_221g_rate, fiscal_year_index, CAST(3 * is_ap + 2 * is_refused_221g + 2 * is_refused AS DOUBLE) AS complexity_score
          FROM valid LEFT JOIN mi USING (submit_month) LEFT JOIN qi USING (submit_quarter)
               LEFT JOIN fs USING (office) LEFT JOIN fyi USING (fiscal_year))"""


# What the engineered features alone are made from: no keys, which are most of the bytes of a case.
ENGINEERED_INPUT = ("office", "lead_days", "fiscal_year", "submit_month", "submit_quarter", "is_issued", "is_ap", "is_refused",
                    "is_refused_221g")


def engineered(spark, sf, columns=FEATURE_INPUT):
    from .features import engineer_features
    out, _ = engineer_features(kept_valid(spark, sf, *columns), min_samples=500)
    return out


@register("corr_engineered", _ENG_SQL + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round({pearson_sql(c, 'lead_days')}, 6) AS corr FROM eng" for c in CR.ENGINEERED_FEATURES))
def q_corr_eng(spark, sf):
    return CR.corr_engineered(engineered(spark, sf, ENGINEERED_INPUT))


def _hash_sql(key: str, salt: str = "42") -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8))::BIGINT"


@register("scatter_fit_top_features", _TC_SQL + """
, rk AS (SELECT feature, row_number() OVER (ORDER BY abs(corr) DESC, feature) AS pos FROM tc
         WHERE corr IS NOT NULL AND feature <> 'lead_days')
, fits AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, regr_slope(CAST(lead_days AS DOUBLE), CAST({c} AS DOUBLE)) AS slope,
         regr_intercept(CAST(lead_days AS DOUBLE), CAST({c} AS DOUBLE)) AS intercept,
         CAST(min({c}) AS DOUBLE) AS x_min, CAST(max({c}) AS DOUBLE) AS x_max, count(*) AS n
       FROM ci WHERE {c} IS NOT NULL AND lead_days IS NOT NULL"""
    for c in CORR_COLS if c != "lead_days") + f""")
SELECT fits.feature, {r('slope', 'slope', 4)}, {r('intercept', 'intercept', 4)}, x_min, x_max, n
FROM fits JOIN rk USING (feature) WHERE pos <= 6""")
def q_scatter_fit(spark, sf):
    out = CR.scatter_fit_top_features(corr_input(spark, sf), "lead_days", 6)
    return out.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 4)})


@register("scatter_matrix_sample", _TC_SQL + """
, rk AS (SELECT feature, row_number() OVER (ORDER BY abs(corr) DESC, feature) AS pos FROM tc
         WHERE corr IS NOT NULL AND feature <> 'lead_days')
, feats AS (SELECT feature FROM rk WHERE pos <= 4)
, base AS (SELECT * FROM ci WHERE """ + " AND ".join(
    f"({c} IS NOT NULL OR '{c}' NOT IN (SELECT feature FROM feats))" for c in CORR_COLS) + """ AND lead_days IS NOT NULL)
, s AS (SELECT * FROM base ORDER BY """ + _hash_sql("case_id") + """, case_id LIMIT 500)
, long AS (""" + " UNION ALL ".join(f"SELECT case_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM s"
                                    for c in CORR_COLS) + """)
SELECT case_id, feature, round(value, 6) AS value FROM long
WHERE feature = 'lead_days' OR feature IN (SELECT feature FROM feats)""")
def q_scatter_matrix(spark, sf):
    s = CR.scatter_matrix_sample(corr_input(spark, sf), "case_id", "lead_days", 4, 500)
    cols = [c for c in s.columns if c != "case_id"]
    return s.select("case_id", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                                   for c in cols])).alias("t")).select("case_id", "t.feature", "t.value")


@register("numeric_hist_grid", CORR_SQL + """
, ok AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {i} AS pos FROM ci HAVING count(DISTINCT {c}) > 10 AND stddev_samp(CAST({c} AS DOUBLE)) > 0"
    for i, c in enumerate(CORR_COLS) if c != "lead_days") + """)
, chosen AS (SELECT "column" FROM ok ORDER BY pos LIMIT 16)
, long AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS column, CAST({c} AS DOUBLE) AS x FROM ci"
                                    for c in CORR_COLS if c != "lead_days") + """)
, l2 AS (SELECT * FROM long WHERE x IS NOT NULL AND "column" IN (SELECT "column" FROM chosen))
, mm AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM l2 GROUP BY "column")
, b AS (SELECT "column", lo, hi, CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((x - lo) * 40.0 / (hi - lo)) AS BIGINT) + 1, 40) END AS bin
        FROM l2 JOIN mm USING ("column"))
SELECT "column", bin, round(lo + (bin - 1) * ((hi - lo) / 40.0), 6) AS bin_lo, round(lo + bin * ((hi - lo) / 40.0), 6) AS bin_hi,
       count(*) AS count FROM b GROUP BY "column", lo, hi, bin""")
def q_hist_grid(spark, sf):
    return numeric_hist_grid(cut_lineage(corr_input(spark, sf).drop("case_id"), "hist"), "lead_days", 40, 16)


# --- closed-form predictions table -------------------------------------------------------------

def predictions(spark, sf, keys=("case_id",)):
    """Four predictions a case, from one pass over the cases.  The lookups are written first: only then does Spark know that
    they are small, and does not deal the cases by office and month, few keys for any number of cases.  Tables that
    name no case need no ``keys``, which are most of the bytes that are written."""
    v = kept_valid(spark, sf, *keys, "office", "lead_days", "submit_month")
    j = join_back(v, cut_lineage(floored_stats(v), "offices"), "office")
    gm = v.agg(F.avg(F.col("lead_days").cast("double")).alias("g")).scalar()
    mi = v.groupBy("submit_month").agg(F.avg(F.col("lead_days").cast("double")).alias("month_mean"))
    j = join_back(j, cut_lineage(mi, "months"), "submit_month")
    models = (("global_mean", gm), ("office_mean", F.col("office_mean_days")), ("office_median", F.col("office_median_days")),
              ("month_mean", F.col("month_mean")))
    rows = F.array(*[F.struct(F.lit(name).alias("model"), e.alias("prediction")) for name, e in models])
    long = j.select(*keys, "office", F.col("lead_days").cast("double").alias("label"), F.inline(rows))
    return long.select("model", *keys, "office", "label", "prediction")


PRED_SQL = _FLOORED_SQL + """
, mm AS (SELECT submit_month, avg(CAST(lead_days AS DOUBLE)) AS month_mean FROM valid GROUP BY 1)
, j AS (SELECT * FROM valid LEFT JOIN fs USING (office) LEFT JOIN mm USING (submit_month))
, preds AS (
  SELECT 'global_mean' AS model, case_id, office, CAST(lead_days AS DOUBLE) AS label,
         (SELECT avg(CAST(lead_days AS DOUBLE)) FROM valid) AS prediction FROM j
  UNION ALL SELECT 'office_mean', case_id, office, CAST(lead_days AS DOUBLE), office_mean_days FROM j
  UNION ALL SELECT 'office_median', case_id, office, CAST(lead_days AS DOUBLE), office_median_days FROM j
  UNION ALL SELECT 'month_mean', case_id, office, CAST(lead_days AS DOUBLE), month_mean FROM j)"""

_METRICS_BODY = """
  count(*) AS n, avg(abs(label - prediction)) AS mae, sqrt(avg((label - prediction) * (label - prediction))) AS rmse,
  1.0 - sum((label - prediction) * (label - prediction)) / nullif(var_pop(label) * count(label), 0) AS r2,
  avg(abs(label - prediction) / greatest(abs(label), 1.0)) * 100.0 AS mape"""


@register("regression_metrics", PRED_SQL + f"""
, mt AS (SELECT model, {_METRICS_BODY} FROM preds GROUP BY model)
SELECT model, n, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('r2', 'r2')}, {r('mape', 'mape')} FROM mt""")
def q_metrics(spark, sf):
    return regression_metrics(predictions(spark, sf, ()))


@register("regression_metrics_by_office", PRED_SQL + f"""
, mt AS (SELECT model, office, {_METRICS_BODY} FROM preds GROUP BY model, office)
SELECT model, office, n, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('r2', 'r2')}, {r('mape', 'mape')} FROM mt""")
def q_metrics_office(spark, sf):
    return regression_metrics(predictions(spark, sf, ()), group=("model", "office"))


@register("rank_models", PRED_SQL + f"""
, mt AS (SELECT model, {_METRICS_BODY} FROM preds GROUP BY model)
SELECT model, {r('mae', 'mae')}, CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS rank FROM mt""")
def q_rank(spark, sf):
    return W.rank_models(regression_metrics(predictions(spark, sf, ()))).select("model", "mae", "rank")


@register("model_scorecard", PRED_SQL + f"""
, mt AS (SELECT model, {_METRICS_BODY} FROM preds GROUP BY model)
SELECT model, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('r2', 'r2')}, {r('mape', 'mape')},
  {r('(max(mae) OVER () - mae) / (max(mae) OVER () - min(mae) OVER () + 1e-9)', 'mae_score')},
  {r('(max(rmse) OVER () - rmse) / (max(rmse) OVER () - min(rmse) OVER () + 1e-9)', 'rmse_score')},
  {r('(r2 - min(r2) OVER ()) / (max(r2) OVER () - min(r2) OVER () + 1e-9)', 'r2_score')},
  {r('(max(mape) OVER () - mape) / (max(mape) OVER () - min(mape) OVER () + 1e-9)', 'mape_score')} FROM mt""")
def q_scorecard(spark, sf):
    return model_scorecard(regression_metrics(predictions(spark, sf, ())))


@register("error_distribution", PRED_SQL + f"""
SELECT model, {r('quantile_cont(abs(label - prediction), 0.5)', 'abs_err_p50')},
  {r('quantile_cont(abs(label - prediction), 0.75)', 'abs_err_p75')}, {r('quantile_cont(abs(label - prediction), 0.9)', 'abs_err_p90')},
  {r('avg(CAST(abs(label - prediction) <= 7 AS DOUBLE)) * 100.0', 'within_7d_pct')},
  {r('avg(CAST(abs(label - prediction) <= 14 AS DOUBLE)) * 100.0', 'within_14d_pct')},
  {r('avg(CAST(abs(label - prediction) <= 30 AS DOUBLE)) * 100.0', 'within_30d_pct')}
FROM preds GROUP BY model""")
def q_err_dist(spark, sf):
    return error_distribution(predictions(spark, sf, ()))


@register("residual_table", PRED_SQL + """
, rs AS (SELECT label - prediction AS x FROM preds WHERE model = 'office_mean')
, rmm AS (SELECT min(x) AS lo, max(x) AS hi FROM rs)
, b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((x - lo) * 50.0 / (hi - lo)) AS BIGINT) + 1, 50) END AS bin FROM rs, rmm)
, c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin)
SELECT d.bin, round(lo + (d.bin - 1) * ((hi - lo) / 50.0), 6) AS bin_lo, round(lo + d.bin * ((hi - lo) / 50.0), 6) AS bin_hi,
       coalesce(cnt, 0) AS count FROM (SELECT range AS bin FROM range(1, 51)) d LEFT JOIN c USING (bin), rmm""")
def q_residual(spark, sf):
    return residual_table(predictions(spark, sf, ()).filter(F.col("model") == "office_mean"))


@register("residual_points", PRED_SQL + f"""
SELECT case_id, {r('label', 'label')}, {r('prediction', 'prediction')}, {r('label - prediction', 'residual')} FROM preds
WHERE model = 'office_mean' ORDER BY {_hash_sql('case_id')}, case_id LIMIT 3000""")
def q_residual_points(spark, sf):
    return residual_points(predictions(spark, sf).filter(F.col("model") == "office_mean"), "case_id", 3000)


@register("cumulative_error_curve", PRED_SQL + """
, e AS (SELECT model, round(ceil(abs(label - prediction) / 0.1) * 0.1, 6) AS error_le, count(*) AS count FROM preds GROUP BY 1, 2)
SELECT model, error_le, count,
  round(sum(count) OVER (PARTITION BY model ORDER BY error_le ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100.0
        / sum(count) OVER (PARTITION BY model), 6) AS cum_pct FROM e""")
def q_cum_err(spark, sf):
    p = predictions(spark, sf, ()).withColumn("abs_error", F.abs(F.col("label") - F.col("prediction")))
    return W.cumulative_error_curve(p, "abs_error", 0.1, keys=("model",))


@register("contiguous_folds", "SELECT case_id, CAST(ntile(5) OVER (ORDER BY case_id) AS INTEGER) AS fold FROM valid")
def q_folds(spark, sf):
    return W.contiguous_folds(valid(spark, sf).select("case_id"), ["case_id"], 5)


@register("train_test_split", f"""
SELECT case_id, CASE WHEN {_hash_sql('case_id', '')} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM valid""")
def q_split(spark, sf):
    v = valid(spark, sf).select("case_id")
    tr, te = train_test_split(v, "case_id")
    return tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
