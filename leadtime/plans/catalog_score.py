"""Registered checks for batch scoring (§2.13) and the scoring stream (§2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import split_label
from ..operators import aggregates as agg
from ..operators.joins import join_back
from ..roles import cases, read_table
from ..session import cut_lineage, scratch_path
from . import models as M
from .registry import FEATURE_INPUT, kept_valid, register
from .catalog_stats import _hash_sql
from .metrics import regression_metrics, split_sides


def scoring_cases(spark, sf):
    """The valid cases that scorer and requests are made from, written once with their side of the split.  Only requests
    (the test side) carry an id and the columns that a request is made from; training cases have nulls there."""
    asked = F.col("case_id").isNotNull()
    return kept_valid(spark, cases(spark, sf, named=lambda key: split_label(key) == "test"), *FEATURE_INPUT,
                      *[F.when(asked, F.col(c)).alias(c) for c in ("submit_ts", "status", "priority")],
                      F.when(asked, F.lit("test")).otherwise(F.lit("train")).alias("_side"))


def requests_from_cases(spark, sf, v=None):
    """One request per test case: office code in lower case with spaces, ISO submit date, case number as
    text.  Some name an office that training lacks, some lie after the training years, some are invalid."""
    _, te = split_sides(scoring_cases(spark, sf) if v is None else v, "case_id")
    office = F.when(F.col("priority") == "3-MEDIUM", F.concat(F.lit("new "), F.lower("office"))).otherwise(F.lower("office"))
    date = F.when(F.col("priority") == "4-NOT SPECIFIED", F.add_months(F.to_date("submit_ts"), 240)).otherwise(F.to_date("submit_ts"))
    return te.select(
        "case_id",
        F.when(F.col("status") == "R", F.lit(" ")).otherwise(F.concat(F.lit(" "), office)).alias("office"),
        F.when(F.col("priority") == "2-HIGH", F.lit("not-a-date")).otherwise(F.date_format(date, "yyyy-MM-dd")).alias("submit_date"),
        F.col("case_no").cast("string").alias("case_number"))


def scoring_setup(spark, sf, one_feature: bool = False, v=None):
    """Fit a linear scorer (on all features, or on the one that the oracles can follow) on the training
    split; serve statistics fitted on train, with the row-weighted mean over training rows for
    unknown offices."""
    from .catalog_ml import ONE, ONE_SPECS, training_tables
    v = scoring_cases(spark, sf) if v is None else v
    # The scorer reads no keys, and the one-feature scorer one feature: no more is written.
    fm, _, tr, te, fmodels = training_tables(spark, sf, v, ("label", *(ONE if one_feature else M.FEATURES)))
    spec = ONE_SPECS[0]
    features = list(ONE) if one_feature else fm.features
    model = M.build_estimator(spec, features, tr).fit(tr)
    met = regression_metrics(model.transform(te).select(F.lit(spec.name).alias("model"), "label", "prediction")).first()
    seasonal, office_m, fy_m = fmodels
    stats = office_m.tables["office"]
    tr_v, _ = split_sides(v, "case_id")
    # One row, read by a scalar subquery for each of its columns.
    glob = cut_lineage(agg.global_office_defaults(join_back(tr_v.select("office", "fiscal_year"), stats, "office", "inner")), "defaults")
    return dict(model=model, office_stats=stats, global_row=glob, codes=fm.office_codes, rmse=met["rmse"],
                model_name=spec.name, mae=met["mae"], r2=met["r2"], features=features,
                seasonal_model=seasonal, fy_model=fy_m, fills=fm.fills)


def office_labels(spark, sf):
    """A label for some offices, as a lookup file would give."""
    n = read_table(spark, sf, "nation")
    return n.where("n_regionkey <> 0").select(F.col("n_name").alias("code"), F.concat(F.lower("n_name"), F.lit(" office")).alias("label"))


_STAT_NAMES = (("office_mean_days", "mean_processing_days", 1), ("office_median_days", "median_processing_days", 1),
               ("office_std_days", "std_processing_days", 1), ("office_volume", "total_cases", None),
               ("office_approval_rate", "approval_rate_pct", 100), ("office_ap_rate", "ap_rate_pct", 100),
               ("office_refusal_rate", "refusal_rate_pct", 100), ("office_221g_rate", "refusal_221g_pct", 100))


def _scoring_sql() -> str:
    from .catalog_ml import ONE_PREDS_SQL
    served = ", ".join(f"coalesce(CAST(fs.{c} AS DOUBLE), gl.{c}) AS {c}" for c, _, _ in _STAT_NAMES)
    glob = ", ".join(f"avg(CAST(fs.{c} AS DOUBLE)) AS {c}" for c, _, _ in _STAT_NAMES)
    return ONE_PREDS_SQL + f"""
, mi AS (SELECT submit_month, avg(CAST(lead_days AS DOUBLE)) / (SELECT avg(CAST(lead_days AS DOUBLE)) FROM tr) AS idx FROM tr GROUP BY 1)
, gl AS (SELECT {glob} FROM tr JOIN fs USING (office))
, req AS (SELECT case_id, status = 'R' AS no_office, priority = '2-HIGH' AS no_date, case_no < 1 AS no_number,
    upper(CASE WHEN priority = '3-MEDIUM' THEN 'new ' || office ELSE office END) AS office_key,
    CAST(CASE WHEN priority = '4-NOT SPECIFIED' THEN CAST(submit_ts AS DATE) + INTERVAL 240 MONTH ELSE CAST(submit_ts AS DATE) END AS DATE) AS d
  FROM valid WHERE NOT {_hash_sql('case_id', '')} % 100 < 80)
, sv AS (SELECT req.*, fs.office IS NOT NULL AS office_known, {served}, coalesce(mi.idx, 1.0) > 1.1 AS is_peak_season
  FROM req LEFT JOIN fs ON fs.office = req.office_key LEFT JOIN mi ON mi.submit_month = month(d), gl WHERE NOT no_office AND NOT no_date AND NOT no_number)
, pr AS (SELECT sv.*, greatest(fit.my + fit.b * (sv.office_mean_days - fit.mx), 0) AS p FROM sv, fit)
, sc AS (SELECT pr.*, coalesce(lower(n_name) || ' office', office_key) AS office_label, mt.rmse, mt.mae, mt.r2
  FROM pr LEFT JOIN nation ON n_name = office_key AND n_regionkey <> 0, mt WHERE mt.model = 'linear')"""


_SCORED = """case_id, office_key, office_label, office_known, round_even(p, 1) AS predicted_days,
  round_even(greatest(p - rmse, 0), 1) AS lower_bound, round_even(p + rmse, 1) AS upper_bound, round_even(p / 30.44, 1) AS predicted_months,
  CASE WHEN p < office_mean_days - 0.5 * office_std_days THEN 'Fast' WHEN p > office_mean_days + 0.5 * office_std_days THEN 'Slow' ELSE 'Normal' END AS category"""


def _score_cases(spark, sf, one_feature):
    from .score import score_requests
    v = scoring_cases(spark, sf)
    scored, _ = score_requests(requests_from_cases(spark, sf, v), **scoring_setup(spark, sf, one_feature, v), labels=office_labels(spark, sf))
    return scored.select("case_id", "office_key", "office_label", "office_known", "predicted_days", "lower_bound", "upper_bound",
                         "predicted_months", "category", "category_color", "office_stats.*", "submit_date_iso",
                         "model_name", "model_mae_days", "model_r2", "is_peak_season")


@register("score_cases")
def q_score_cases(spark, sf):
    return _score_cases(spark, sf, False)


@register("score_cases_one", _scoring_sql() + f"""
SELECT {_SCORED},
  CASE WHEN p < office_mean_days - 0.5 * office_std_days THEN 'green' WHEN p > office_mean_days + 0.5 * office_std_days THEN 'red' ELSE 'orange' END AS category_color,
  {', '.join(f"CAST(trunc({c}) AS INTEGER) AS {n}" if k is None else f"round_even({c} * {k}, 1) AS {n}" for c, n, k in _STAT_NAMES)},
  strftime(d, '%Y-%m-%d') AS submit_date_iso, 'linear' AS model_name, round_even(mae, 1) AS model_mae_days, round_even(r2, 4) AS model_r2,
  is_peak_season FROM sc""")
def q_score_cases_one(spark, sf):
    return _score_cases(spark, sf, True)


@register("score_quarantine", _scoring_sql() + """
SELECT case_id, CASE WHEN no_office THEN 'Required field.' END AS err_office,
       CASE WHEN no_date THEN 'Must be YYYY-MM-DD format.' END AS err_submit_date,
       CASE WHEN no_number THEN 'Must be a positive integer.' END AS err_case_number FROM req WHERE no_office OR no_date OR no_number""")
def q_quarantine(spark, sf):
    """Requests that scoring refuses, with the reasons."""
    from .score import score_requests
    v = scoring_cases(spark, sf)
    _, bad = score_requests(requests_from_cases(spark, sf, v), **scoring_setup(spark, sf, True, v), labels=office_labels(spark, sf))
    return bad.select("case_id", F.col("errors")["office"].alias("err_office"), F.col("errors")["submit_date"].alias("err_submit_date"),
                      F.col("errors")["case_number"].alias("err_case_number"))


def _score_stream(spark, sf, one_feature):
    from ..streaming import read_scored, score_stream
    src, out, ckpt = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    v = scoring_cases(spark, sf)
    reqs = requests_from_cases(spark, sf, v)
    # requests arrive as several files; the stream picks them up two files per micro-batch
    reqs.repartition(4, "case_id").write.mode("overwrite").parquet(src)
    q = score_stream(spark, src, reqs.schema, out, ckpt, available_now=True,
                     max_files_per_trigger=2, **scoring_setup(spark, sf, one_feature, v), labels=office_labels(spark, sf))
    q.awaitTermination()
    return read_scored(spark, out).select("case_id", "office_key", "office_label", "office_known", "predicted_days", "lower_bound",
                                          "upper_bound", "predicted_months", "category")


@register("score_stream")
def q_score_stream(spark, sf):
    return _score_stream(spark, sf, False)


@register("score_stream_one", _scoring_sql() + f"\nSELECT {_SCORED} FROM sc")
def q_score_stream_one(spark, sf):
    return _score_stream(spark, sf, True)
