"""Registered checks for the Spark ML plans (§2.12), scoring (§2.13) and model reports.

Learner outputs on all features are checked by row count (rows-only) and invariants in the tests; the
linear learners on one feature by value; the feature matrix has a SQL oracle over its row count and
per-feature means.  Learner sizes are the QUICK presets (the reference
presets are in ``models.REFERENCE_SPECS``), so the checks stay short at sf0.01 while every
fit still reads all training rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import split_label
from ..session import cut_lineage, scratch_path
from . import models as M
from .registry import FEATURE_INPUT, kept_valid, r, register, valid
from .catalog_rows import _FLOORED_SQL, MIN_SAMPLES
from .catalog_stats import _ENG_SQL, _METRICS_BODY, _hash_sql, engineered
from .features import case_stages, engineer_features
from .metrics import regression_metrics, split_sides, train_test_split


def training_tables(spark, sf, v=None, columns=None):
    """Split first, fit the aggregate features on the training rows only, then build the
    feature matrix; checkpointed once because every learner below re-reads it.  ``v``: valid cases that
    the caller has written already, maybe with their ``_side`` and then without keys; ``columns``: those of the matrix
    that the caller reads, all by default."""
    v = kept_valid(spark, sf, *FEATURE_INPUT) if v is None else v
    key, side = ("_side", F.col("_side")) if "_side" in v.columns else ("case_id", split_label("case_id"))
    tr_v, _ = split_sides(v, "case_id")
    eng, fmodels = engineer_features(v, fit_on=tr_v, min_samples=500)
    fm = M.feature_matrix(eng, key, features=M.FEATURES, fit_rows=lambda x: split_sides(x, "case_id")[0])
    # The side is written too: every pass of every fit would otherwise hash the keys of all rows.
    wanted = [c for c in fm.data.columns if c != "_side" and (columns is None or c in columns)]
    kept = cut_lineage(fm.data.select(*wanted, side.alias("_side")))
    tr, te = (x.drop("_side") for x in split_sides(kept, "case_id"))
    return fm, kept.drop("_side"), tr, te, fmodels


_CYC = (("submit_month", 12), ("submit_day_of_week", 7), ("submit_quarter", 4), ("submit_day_of_year", 365))


@register("feature_matrix", _ENG_SQL + """
, fm AS (SELECT *, dense_rank() OVER (ORDER BY office) - 1 AS office_code, """ + ", ".join(
    f"{fn}(2 * pi() * {c} / {p}) AS {c}_{fn}" for c, p in _CYC for fn in ("sin", "cos")) + """ FROM eng)
SELECT count(*) AS rows, """ + ", ".join(r(f"avg(CAST({c} AS DOUBLE))", c) for c in M.FEATURES) + " FROM fm")
def q_feature_matrix(spark, sf):
    fm = M.feature_matrix(engineered(spark, sf), "case_id", features=M.FEATURES)
    return fm.data.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in fm.features])


@register("impute_feature_matrix", _ENG_SQL + """
, fm AS (SELECT *, CASE WHEN submit_day_of_week = 6 THEN NULL ELSE office_std_days END AS std_holes FROM eng)
SELECT count(*) AS rows, """ + r("avg(coalesce(std_holes, (SELECT quantile_cont(std_holes, 0.5) FROM fm)))", "std_holes")
          + " FROM fm")
def q_impute_fm(spark, sf):
    eng = engineered(spark, sf).withColumn(
        "std_holes", F.when(F.col("submit_day_of_week") == 6, F.lit(None)).otherwise(F.col("office_std_days")))
    fm = M.feature_matrix(eng, "case_id", features=["std_holes"])
    return fm.data.agg(F.count(F.lit(1)).alias("rows"), F.avg("std_holes").alias("std_holes"))


# Every learner is fitted on all features.  The linear ones are besides checked value by value on one
# feature, under keys that end in _one, where their fits have closed forms: least squares; ridge, whose
# slope shrinks by S / (S + alpha) over the standardised feature's sum of squares S; lasso, whose
# standardised slope is soft-thresholded.
ONE = ("office_mean_days",)
ONE_SPECS = (M.ModelSpec("linear", "linear", {}, True), M.ModelSpec("ridge", "ridge", {"alpha": 1.0}, True),
             M.ModelSpec("lasso", "lasso", {"alpha": 0.5, "maxIter": 5000}, True))
ALL_SPECS = (*ONE_SPECS, *M.QUICK_SPECS[3:])
TRAIN_SQL = f"""
, tr AS (SELECT * FROM valid WHERE {_hash_sql('case_id', '')} % 100 < 80)
""" + _FLOORED_SQL.replace("FROM valid", "FROM tr") + f"""
, xy AS (SELECT case_id, CAST(lead_days AS DOUBLE) AS label, office_mean_days AS x, {_hash_sql('case_id', '')} % 100 < 80 AS train
         FROM valid LEFT JOIN fs USING (office))"""
_FIT_SQL = """count(*) AS n, avg(x) AS mx, avg(label) AS my, coalesce(covar_pop(label, x) / nullif(var_pop(x), 0), 0) AS b,
  coalesce(covar_pop(label, x) / nullif(stddev_samp(x), 0), 0) AS c, coalesce(nullif(stddev_samp(x), 0), 1) AS s"""
_SLOPES = {"linear": "b", "ridge": "b * (n - 1) / (n - 1 + 1.0)",
           "lasso": "sign(c) * greatest(abs(c) - 0.5, 0) * n / (n - 1) / s"}
ONE_PREDS_SQL = TRAIN_SQL + f"""
, fit AS (SELECT {_FIT_SQL} FROM xy WHERE train)
, preds AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS model, case_id, label, my + {e} * (x - mx) AS prediction FROM xy, fit WHERE NOT train"
                                     for m, e in _SLOPES.items()) + f""")
, mt AS (SELECT model, {_METRICS_BODY} FROM preds GROUP BY model)"""
_MT = f"n, {r('mae', 'mae', 4)}, {r('rmse', 'rmse', 4)}, {r('r2', 'r2')}, {r('mape', 'mape', 4)}"


def _rounded_metrics(met):
    return met.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "mape")})


def _fit(spec_name, one_feature=False):
    def q(spark, sf):
        fm, _, tr, te, _ = training_tables(spark, sf)
        spec = next(s for s in ALL_SPECS if s.name == spec_name)
        model = M.build_estimator(spec, list(ONE) if one_feature else fm.features, tr).fit(tr)
        preds = model.transform(te).select(F.lit(spec.name).alias("model"), "case_id", "label", "prediction")
        return _rounded_metrics(regression_metrics(preds))
    q.__doc__ = f"Fit the {spec_name} spec on the train split, metrics on the test split."
    return q


for _key, _spec in (("fit_linear", "linear"), ("fit_ridge", "ridge"), ("fit_lasso", "lasso"),
                    ("fit_random_forest", "random_forest"), ("fit_randomized_forest", "randomized_forest"),
                    ("fit_gbt", "gradient_boosting")):
    register(_key)(_fit(_spec))
    if _spec in _SLOPES:
        register(f"{_key}_one", ONE_PREDS_SQL + f"\nSELECT model, {_MT} FROM mt WHERE model = '{_spec}'")(_fit(_spec, True))


@register("compare_models")
def q_compare(spark, sf):
    fm, _, tr, te, _ = training_tables(spark, sf)
    met, _, _ = M.compare_models(tr, te, fm.features, "case_id", ALL_SPECS)
    return met


@register("compare_models_one", ONE_PREDS_SQL + f"""
SELECT model, {_MT}, CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS rank FROM mt""")
def q_compare_one(spark, sf):
    # seconds of training are no result that another engine could repeat
    _, _, tr, te, _ = training_tables(spark, sf)
    met, _, _ = M.compare_models(tr, te, list(ONE), "case_id", ONE_SPECS)
    return _rounded_metrics(met.drop("train_seconds"))


@register("compare_all_models")
def q_compare_all(spark, sf):
    fm, _, tr, te, _ = training_tables(spark, sf)
    met, _, _ = M.compare_models(tr, te, fm.features, "case_id", M.QUICK_SPECS)
    return met


_CV_SPECS = (M.ModelSpec("random_forest", "rf", {"numTrees": 8, "minInstancesPerNode": 5, "maxDepth": 6}),
             M.ModelSpec("randomized_forest", "xrf", {"numTrees": 8, "minInstancesPerNode": 5, "maxDepth": 6}),
             M.ModelSpec("gradient_boosting", "gbt", {"maxIter": 8, "stepSize": 0.1, "maxDepth": 4}))


@register("cross_validate")
def q_cv(spark, sf):
    fm, data, _, _, _ = training_tables(spark, sf)
    summary, _ = M.cross_validate(data, fm.features, "case_id", (*ONE_SPECS, *_CV_SPECS), k=5)
    return summary


@register("cross_validate_one", TRAIN_SQL + f"""
, fo AS (SELECT *, ntile(5) OVER (ORDER BY case_id) AS fold FROM xy)
, fit AS (SELECT k.range AS held, {_FIT_SQL} FROM fo, range(1, 6) k WHERE fold <> k.range GROUP BY 1)
, preds AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS model, fold, label, my + {e} * (x - mx) AS prediction FROM fo JOIN fit ON held = fold"
                                     for m, e in list(_SLOPES.items())[:2]) + f""")
, mt AS (SELECT model, fold, {_METRICS_BODY} FROM preds GROUP BY model, fold)
SELECT model, {', '.join(r(f'avg({c})', f'cv_{c}_mean', 4) for c in ('mae', 'rmse', 'r2'))},
  {', '.join(r(f'stddev_pop({c})', f'cv_{c}_std', 4) for c in ('mae', 'rmse', 'r2'))}, count(*) AS folds FROM mt GROUP BY model""")
def q_cv_one(spark, sf):
    _, data, _, _, _ = training_tables(spark, sf)
    summary, _ = M.cross_validate(data, list(ONE), "case_id", ONE_SPECS[:2], k=5)
    return summary.withColumns({c: F.round(c, 4) for c in summary.columns if c.startswith("cv_")})


def _refit_sql(folds: int) -> str:
    """Office means learned without each fold, and the fits on them: (fold, label, prediction) of ridge and least squares."""
    out = f", fo AS (SELECT *, ntile({folds}) OVER (ORDER BY case_id) AS fold FROM valid)"
    for k in range(1, folds + 1):
        part = _FLOORED_SQL.replace("FROM valid", f"FROM tr{k}").replace(", s AS (", f", s{k} AS (").replace(", m AS (", f", m{k} AS (")
        part = part.replace(", fs AS (", f", fs{k} AS (").replace("FROM s, m)", f"FROM s{k}, m{k})").replace(" FROM s)", f" FROM s{k})")
        out += f"""
, tr{k} AS (SELECT * FROM fo WHERE fold <> {k})
{part}
, xy{k} AS (SELECT fold, CAST(lead_days AS DOUBLE) AS label, office_mean_days AS x FROM fo LEFT JOIN fs{k} USING (office))
, fit{k} AS (SELECT {_FIT_SQL} FROM xy{k} WHERE fold <> {k})"""
    rows = [f"SELECT '{m}' AS model, fold, label, my + {e} * (x - mx) AS prediction FROM xy{k}, fit{k} WHERE fold = {k}"
            for k in range(1, folds + 1) for m, e in list(_SLOPES.items())[:2]]
    return out + "\n, preds AS (" + " UNION ALL ".join(rows) + ")"


@register("cross_validate_refitted_one", _refit_sql(3) + f"""
, mt AS (SELECT model, fold, {_METRICS_BODY} FROM preds GROUP BY model, fold)
SELECT model, {', '.join(r(f'avg({c})', f'cv_{c}_mean', 4) for c in ('mae', 'rmse', 'r2'))},
  {', '.join(r(f'stddev_pop({c})', f'cv_{c}_std', 4) for c in ('mae', 'rmse', 'r2'))}, count(*) AS folds FROM mt GROUP BY model""")
def q_cv_refitted_one(spark, sf):
    """Office means learned anew in each of three folds."""
    summary, _ = M.cross_validate_refitted(cut_lineage(valid(spark, sf), "valid"), case_stages(ONE, min_samples=MIN_SAMPLES), list(ONE),
                                           "case_id", ONE_SPECS[:2], k=3)
    return summary.withColumns({c: F.round(c, 4) for c in summary.columns if c.startswith("cv_")})


@register("cross_validate_refitted")
def q_cv_refitted(spark, sf):
    """All 29 features, learned anew in each of five folds."""
    summary, _ = M.cross_validate_refitted(cut_lineage(valid(spark, sf), "valid"), case_stages(M.FEATURES, min_samples=500), list(M.FEATURES),
                                           "case_id", ONE_SPECS, k=5)
    return summary


@register("stacking_refitted")
def q_stacking_refitted(spark, sf):
    tr, te = train_test_split(kept_valid(spark, sf, *FEATURE_INPUT), "case_id")
    met, _ = M.stacking_refitted(tr, te, case_stages(M.FEATURES, min_samples=500), list(M.FEATURES), "case_id",
                                 (M.QUICK_SPECS[0], _CV_SPECS[1]), k=3, alpha=10.0)
    return met


@register("cross_validate_trees")
def q_cv_trees(spark, sf):
    fm, data, _, _, _ = training_tables(spark, sf)
    summary, _ = M.cross_validate(data, fm.features, "case_id", _CV_SPECS, k=5)
    return summary


@register("cross_validate_sampled")
def q_cv_sampled(spark, sf):
    fm, data, _, _, _ = training_tables(spark, sf)
    summary, _ = M.cross_validate_sampled(data, fm.features, "case_id", _CV_SPECS[1:], pct=30, k=3)
    return summary


_QUICK_FOREST_SPACE = {"numTrees": [4, 8], "maxDepth": [3, 5], "minInstancesPerNode": [1, 5]}
_QUICK_RANDOMIZED_SPACE = {"numTrees": [4, 8], "maxDepth": [8, 12], "minInstancesPerNode": M.Ints(3, 9), "minInstancesToSplit": M.Ints(2, 19)}
_QUICK_BOOST_SPACE = {"maxIter": [4, 8], "stepSize": [0.05, 0.1], "maxDepth": [3, 4]}


@register("random_search")
def q_search(spark, sf):
    fm, _, tr, _, _ = training_tables(spark, sf)
    res, _, _ = M.random_search(tr, fm.features, "case_id", _CV_SPECS[0], _QUICK_FOREST_SPACE, n_draws=4, k=3)
    return res


@register("random_search_subsample")
def q_search_sub(spark, sf):
    fm, _, tr, _, _ = training_tables(spark, sf)
    res, _, _ = M.random_search(tr, fm.features, "case_id", _CV_SPECS[2], _QUICK_BOOST_SPACE, n_draws=3, k=3,
                                subsample_pct=40)
    return res


@register("cross_validate_top")
def q_cv_top(spark, sf):
    """The three models with the least hold-out error, cross-validated on five folds."""
    fm, data, tr, te, _ = training_tables(spark, sf)
    specs = (*ONE_SPECS, *_CV_SPECS)
    met, _, _ = M.compare_models(tr, te, fm.features, "case_id", specs)
    summary, _ = M.cross_validate_top(met, data, fm.features, "case_id", specs, 3, 5)
    return summary


@register("tuned_holdout")
def q_tuned(spark, sf):
    """The best draw of a search, refitted on the training side, on the test side."""
    fm, _, tr, te, _ = training_tables(spark, sf)
    _, best, _ = M.random_search(tr, fm.features, "case_id", _CV_SPECS[1], _QUICK_RANDOMIZED_SPACE, n_draws=3, k=3)
    return regression_metrics(best.transform(te).select(F.lit("tuned").alias("model"), "case_id", "label", "prediction"))


@register("stacking")
def q_stacking(spark, sf):
    fm, _, tr, te, _ = training_tables(spark, sf)
    bases = (M.QUICK_SPECS[0], _CV_SPECS[0], _CV_SPECS[2])
    met, _ = M.stacking(tr, te, fm.features, "case_id", bases, k=3, alpha=10.0)
    return met


@register("feature_importance")
def q_importance(spark, sf):
    fm, _, tr, _, _ = training_tables(spark, sf)
    m = M.build_estimator(_CV_SPECS[0], fm.features, tr).fit(tr)
    return M.feature_importance(m, fm.features, 20)


_CURVE_SIZES = (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 1.0)


@register("learning_curve")
def q_learning(spark, sf):
    fm, data, _, _, _ = training_tables(spark, sf)
    return M.learning_curve(data, fm.features, "case_id", ONE_SPECS[0], sizes=_CURVE_SIZES, k=3)


@register("learning_curve_one", TRAIN_SQL + f"""
, hb AS (SELECT *, {_hash_sql('case_id', 'lc')} % 1000 AS b, {_hash_sql('case_id', 'fold')} % 3 AS f FROM xy)
, sz AS (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in _CURVE_SIZES)}]) AS size)
, su AS (SELECT size, k.range AS held, label, x, f FROM hb, sz, range(0, 3) k WHERE b < CAST(round(size * 1000) AS BIGINT))
, fit AS (SELECT size, held, {_FIT_SQL} FROM su WHERE f <> held GROUP BY 1, 2)
, mt AS (SELECT size, held, f = held AS cv, avg(abs(label - (my + b * (x - mx)))) AS mae, count(*) AS n
         FROM su JOIN fit USING (size, held) GROUP BY 1, 2, 3)
SELECT size, {', '.join(r(f"{fn}(CASE WHEN {cond} THEN {c} END)", f"{m}_{c2}", 4) for m, cond in (('train', 'NOT cv'), ('cv', 'cv'))
                         for fn, c, c2 in (('avg', 'mae', 'mae_mean'), ('stddev_pop', 'mae', 'mae_std'), ('avg', 'n', 'rows')))}
FROM mt GROUP BY size""")
def q_learning_one(spark, sf):
    _, data, _, _, _ = training_tables(spark, sf)
    out = M.learning_curve(data, list(ONE), "case_id", ONE_SPECS[0], sizes=_CURVE_SIZES, k=3)
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c != "size"})


def _report(spark, train, test, features, timed):
    from ..sources.sinks import write_model_report
    met, fitted, _ = M.compare_models(train, test, list(features), "case_id", ONE_SPECS[:2])
    best = met.orderBy("rank").first()["model"]
    path = scratch_path(spark, "model-report")
    write_model_report(fitted[best], met if timed else met.drop("train_seconds"), features, path)
    return spark.read.json(f"{path}/report")


@register("write_model_report")
def q_report(spark, sf):
    fm, _, tr, te, _ = training_tables(spark, sf)
    return _report(spark, tr, te, fm.features, True)


@register("write_model_report_one", ONE_PREDS_SQL + f"""
SELECT model, n, {r('mae', 'mae', 4)}, {r('rmse', 'rmse', 4)}, {r('r2', 'r2', 4)}, {r('mape', 'mape', 4)},
       row_number() OVER (ORDER BY mae, model) AS rank, '["office_mean_days"]' AS features FROM mt WHERE model <> 'lasso'""")
def q_report_one(spark, sf):
    _, _, tr, te, _ = training_tables(spark, sf)
    return _report(spark, tr, te, ONE, False)


@register("training_report_one", ONE_PREDS_SQL + f"""
, fo AS (SELECT *, ntile(5) OVER (ORDER BY case_id) AS fold FROM xy)
, cfit AS (SELECT k.range AS held, {_FIT_SQL} FROM fo, range(1, 6) k WHERE fold <> k.range GROUP BY 1)
, cp AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS model, fold, label, my + {e} * (x - mx) AS prediction FROM fo JOIN cfit ON held = fold"
                                  for m, e in _SLOPES.items()) + f""")
, cm AS (SELECT model, fold, {_METRICS_BODY} FROM cp GROUP BY model, fold)
, rk AS (SELECT *, row_number() OVER (ORDER BY mae, model) AS rank FROM mt)
""" + " UNION ALL ".join([f"SELECT 'holdout' AS part, model, CAST(rank AS INTEGER) AS rank, '{c}' AS measure, {r(c, 'value', 4)} FROM rk" for c in ("mae", "rmse", "r2", "mape")]
                         + [f"SELECT 'cv', model, 0, 'cv_{c}_{k}', {r(f'{fn}({c})', 'value', 4)} FROM cm GROUP BY model"
                            for c in ("mae", "rmse", "r2") for k, fn in (("mean", "avg"), ("std", "stddev_pop"))]))
def q_training_report_one(spark, sf):
    """Hold-out and fold rows of the report, as read back."""
    from ..sources.sinks import report_rows, write_training_report
    _, data, tr, te, _ = training_tables(spark, sf)
    met, fitted, _ = M.compare_models(tr, te, list(ONE), "case_id", ONE_SPECS)
    cv, _ = M.cross_validate(data, list(ONE), "case_id", ONE_SPECS, k=5)
    best = met.orderBy("rank").first()["model"]
    return write_training_report(fitted[best], report_rows(met, cv), ONE, scratch_path(spark, "report")).drop("params").fillna(0, ["rank"])


@register("training_report")
def q_training_report(spark, sf):
    """The whole report on 29 features: ranking, folds of the best three, search and tuned model."""
    from ..sources.sinks import report_rows, write_training_report
    fm, data, tr, te, _ = training_tables(spark, sf)
    specs = (*ONE_SPECS, _CV_SPECS[1])
    met, _, _ = M.compare_models(tr, te, fm.features, "case_id", specs)
    met = cut_lineage(met, "ranking")
    cv, _ = M.cross_validate_top(met, data, fm.features, "case_id", specs, 3, 5)
    search, best, _ = M.random_search(tr, fm.features, "case_id", _CV_SPECS[1], _QUICK_RANDOMIZED_SPACE, n_draws=3, k=3)
    tuned = regression_metrics(best.transform(te).select(F.lit("tuned").alias("model"), "case_id", "label", "prediction"))
    return write_training_report(best, report_rows(met, cv, tuned, search), fm.features, scratch_path(spark, "report"))


# Oracle for the sf0.01 data: no nulls to impute, 25 offices -> sorted codes, region / status /
# priority (5 / 3 / 5 levels) -> one-hot without their first level, IQR trim with k = 3.
_PROCESS_SQL = """
, enc AS (SELECT * EXCLUDE (submit_ts, status_ts, office, region, status, priority),
    dense_rank() OVER (ORDER BY office) - 1 AS office,
    region = 'AMERICA' AS region_AMERICA, region = 'ASIA' AS region_ASIA, region = 'EUROPE' AS region_EUROPE,
    region = 'MIDDLE EAST' AS "region_MIDDLE EAST", status = 'N' AS status_N, status = 'R' AS status_R,
    priority = '2-HIGH' AS "priority_2-HIGH", priority = '3-MEDIUM' AS "priority_3-MEDIUM",
    priority = '4-NOT SPECIFIED' AS "priority_4-NOT SPECIFIED", priority = '5-LOW' AS "priority_5-LOW" FROM valid)
, b AS (SELECT quantile_cont(CAST(lead_days AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(lead_days AS DOUBLE), 0.75) AS q3
        FROM enc)
SELECT enc.* FROM enc, b WHERE lead_days >= q1 - 3 * (q3 - q1) AND lead_days <= q3 + 3 * (q3 - q1)"""


@register("process_cases", _PROCESS_SQL)
def q_process(spark, sf):
    from ..roles import cases
    from .prepare import process_cases
    return process_cases(cases(spark, sf))
