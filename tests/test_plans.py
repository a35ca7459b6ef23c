"""Plans over the driver tables: fit/transform leakage, scoring invariants, stream = batch."""

import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from leadtime.plans import models as M
from leadtime.plans.features import OfficeStats, SeasonalIndex
from leadtime.plans.metrics import regression_metrics, train_test_split
from leadtime.plans.prepare import process_cases, valid_cases
from leadtime.roles import cases


def test_fit_uses_train_rows_only(spark, sf):
    v = valid_cases(cases(spark, sf))
    tr, te = train_test_split(v, "case_id")
    m1 = OfficeStats(min_samples=5).fit(tr)
    changed = te.withColumn("lead_days", F.col("lead_days") + 1000)     # altering test rows ...
    # The split is by key, so the training side of the altered table is what a fit may see.
    m2 = OfficeStats(min_samples=5).fit(train_test_split(tr.unionByName(changed), "case_id")[0])
    every = OfficeStats(min_samples=5).fit(tr.unionByName(changed))
    def rounded(rows):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    a = rounded(m1.tables["office"].collect())
    b = rounded(m2.tables["office"].collect())
    assert a == b                                                       # ... leaves the fitted table alone
    assert rounded(every.tables["office"].collect()) != a               # a fit on all rows would have seen them


def test_seasonal_index_weighted_by_rows(spark, sf):
    v = valid_cases(cases(spark, sf))
    t = SeasonalIndex().fit(v).tables["month"]
    g = v.agg(F.avg("lead_days")).first()[0]
    m = v.groupBy("submit_month").agg(F.avg("lead_days").alias("m")).collect()
    want = {r.submit_month: r.m / g for r in m}
    got = {r.submit_month: r.seasonal_index_month for r in t.collect()}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_process_cases_has_no_nulls(spark, sf):
    out = process_cases(cases(spark, sf))
    nulls = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first().asDict()
    assert out.count() > 0 and sum(nulls.values()) == 0
    n_offices = valid_cases(cases(spark, sf)).select("office").distinct().count()
    if n_offices > 10:                                                           # many levels -> label code
        assert dict(out.dtypes)["office"] == "bigint"
    else:                                                                        # few levels -> k-1 one-hot
        assert sum(c.startswith("office_") and c != "office_id" for c in out.columns) == n_offices - 1
    assert [c for c in out.columns if c.startswith("status_")] == ["status_N", "status_R"]


def test_metrics_closed_form(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 3.0), ("m", 5.0, 4.0)], "model string, label double, prediction double")
    r = regression_metrics(df).first()
    assert abs(r.mae - 2 / 3) < 1e-12 and abs(r.rmse - (2 / 3) ** 0.5) < 1e-12
    assert abs(r.r2 - (1 - 2 / 8)) < 1e-12


def test_scoring_invariants_and_stream_equals_batch(spark, sf):
    from leadtime.plans.catalog_score import requests_from_cases, scoring_setup
    from leadtime.plans.score import score_requests
    from leadtime.streaming import read_scored, score_stream
    kw = scoring_setup(spark, sf)
    reqs = requests_from_cases(spark, sf)
    scored, bad = score_requests(reqs, **kw)
    rows = scored.collect()
    assert rows and bad.count() > 0
    for r in rows:
        assert r.predicted_days >= 0 and r.lower_bound <= r.predicted_days <= r.upper_bound
        assert r.category in ("Fast", "Normal", "Slow")
        assert r.predicted_months == round(r.predicted_days / 30.44, 1) or abs(r.predicted_months - r.predicted_days / 30.44) <= 0.05 + 0.05 / 30.44 + 1e-9
        assert len(r.features_used) == len(M.FEATURES)
    d = tempfile.mkdtemp(prefix="lt-stream-")
    reqs.repartition(3).write.parquet(f"{d}/in")
    q = score_stream(spark, f"{d}/in", reqs.schema, f"{d}/out", f"{d}/ckpt", max_files_per_trigger=1, **kw)
    q.awaitTermination()
    cols = ["case_id", "predicted_days", "lower_bound", "upper_bound", "category", "office_key"]
    s = sorted(tuple(r) for r in read_scored(spark, f"{d}/out").select(*cols).collect())
    b = sorted(tuple(r) for r in scored.select(*cols).collect())
    assert s == b


def test_unknown_office_falls_back(spark, sf):
    from leadtime.plans.catalog_score import scoring_setup
    from leadtime.plans.score import score_requests
    kw = scoring_setup(spark, sf)
    known = valid_cases(cases(spark, sf)).select("office").orderBy("office").first()[0]
    req = spark.createDataFrame([("ZZZ", "2024-11-01", "5"), (f" {known.lower()} ", "2024-06-01", None)],
                                "office string, submit_date string, case_number string")
    out = {r.office_key: r for r in score_requests(req, **kw)[0].collect()}
    assert out["ZZZ"].office_known is False and out[known].office_known is True
    assert out["ZZZ"].office_stats.total_cases is not None


def test_list_offices_sorted_with_fields(spark, sf):
    from leadtime.operators import aggregates as agg
    from leadtime.plans.score import list_offices
    v = valid_cases(cases(spark, sf))
    last = v.agg(F.max("office")).first()[0]
    labels = spark.createDataFrame([(last, "AAA first")], "code string, label string")
    rows = list_offices(agg.office_stats_floored(agg.office_stats(v), 30), "office", labels).collect()
    assert rows and rows[0].label == "AAA first" and rows[0].code == last
    assert [r.label for r in rows] == sorted(r.label for r in rows)
    assert all(set(r.asDict()) == {"code", "label", "mean_days", "approval_rate_pct"} for r in rows)
    assert all(r.label == r.code for r in rows if r.code != last)          # unknown label -> code itself


def test_static_peak_months_and_response_fields(spark, sf):
    from leadtime.plans.catalog_score import scoring_setup
    from leadtime.plans.score import score_requests
    kw = scoring_setup(spark, sf)
    kw.update(seasonal_model=None, fy_model=None, fy_min=1995, fy_max=2002)      # the reference's serving rules
    req = spark.createDataFrame([("X1", "2024-11-01", "1"), ("X1", "2024-06-01", "1")],
                                "office string, submit_date string, case_number string")
    out = {r.submit_date: r for r in score_requests(req, **kw)[0].collect()}
    assert out["2024-11-01"].is_peak_season is True and out["2024-06-01"].is_peak_season is False
    need = {"predicted_days", "lower_bound", "upper_bound", "predicted_months", "category", "category_color",
            "office_key", "office_stats", "submit_date_iso", "model_name", "model_mae_days", "model_r2",
            "is_peak_season", "features_used"}
    assert need <= set(out["2024-11-01"].asDict())


def test_cv_top_and_linear_search_skip(spark, sf):
    from leadtime.plans.catalog_ml import training_tables
    fm, data, tr, te, _ = training_tables(spark, sf)
    specs = (M.ModelSpec("linear", "linear", {}, True),
             M.ModelSpec("gbt_tiny", "gbt", {"maxIter": 3, "maxDepth": 3}),
             M.ModelSpec("rf_tiny", "rf", {"numTrees": 3, "maxDepth": 3}))
    met, _, _ = M.compare_models(tr, te, fm.features, "case_id", specs)
    summary, per_fold = M.cross_validate_top(met, data, fm.features, "case_id", specs, top_n=2, k=3)
    assert summary.count() == 2 and per_fold.count() == 6
    res, model, best = M.random_search(tr, fm.features, "case_id", specs[0])
    assert res.count() == 0 and best == {} and model is not None


def test_scoring_bundle_roundtrip(spark, sf, tmp_path):
    from leadtime.plans.catalog_score import requests_from_cases, scoring_setup
    from leadtime.plans.score import load_scoring_bundle, save_scoring_bundle, score_requests
    kw = scoring_setup(spark, sf)
    meta = {k: kw[k] for k in ("rmse", "model_name", "mae", "r2")}
    meta["features"] = list(kw["features"])
    path = str(tmp_path / "bundle")
    save_scoring_bundle(path, kw["model"], kw["codes"], kw["office_stats"], kw["global_row"],
                        {"seasonal_model": kw["seasonal_model"], "fy_model": kw["fy_model"]}, meta)
    back = load_scoring_bundle(spark, path)
    reqs = requests_from_cases(spark, sf)
    cols = ["case_id", "predicted_days", "category", "office_key"]
    a = sorted(tuple(r) for r in score_requests(reqs, **kw)[0].select(*cols).collect())
    b = sorted(tuple(r) for r in score_requests(reqs, **back)[0].select(*cols).collect())
    assert a == b


def test_new_years_labels_and_missing_bundle_parts(spark, sf, tmp_path):
    from leadtime.plans.catalog_score import scoring_setup
    from leadtime.plans.features import FiscalYearTrend
    from leadtime.plans.score import load_scoring_bundle, save_scoring_bundle, score_requests
    v = valid_cases(cases(spark, sf))
    trend = FiscalYearTrend().fit(v)
    lo, hi = v.agg(F.min("fiscal_year"), F.max("fiscal_year")).first()
    later = spark.createDataFrame([(hi,), (hi + 2,)], "fiscal_year int")
    got = {r.fiscal_year: r.fiscal_year_index for r in trend.transform(later).collect()}
    assert got[hi] == 1.0 and abs(got[hi + 2] - (hi + 2 - lo) / (hi - lo)) < 1e-12
    kw = scoring_setup(spark, sf)
    office = kw["office_stats"].select("office").first()[0]
    labels = spark.createDataFrame([(office, "Main office")], "code string, label string")
    reqs = spark.createDataFrame([(office.lower(), "2031-02-03", "5"), ("nowhere", "2031-02-03", None), ("x", "no", "1")],
                                 "office string, submit_date string, case_number string")
    scored, bad = score_requests(reqs, **kw, labels=labels)
    rows = {r.office_key: r for r in scored.collect()}
    assert rows[office].office_label == "Main office" and rows["NOWHERE"].office_label == "NOWHERE"
    assert rows[office].office_known and not rows["NOWHERE"].office_known and bad.count() == 1
    path = str(tmp_path / "bundle")
    meta = {k: kw[k] for k in ("rmse", "model_name", "mae", "r2")} | {"features": list(kw["features"])}
    save_scoring_bundle(path, kw["model"], kw["codes"], kw["office_stats"], kw["global_row"], {"fy_model": kw["fy_model"]}, meta, kw["fills"], labels)
    back = load_scoring_bundle(spark, path)
    assert back["seasonal_model"] is None and back["fy_model"] is not None and back["labels"].count() == 1
    import shutil
    shutil.rmtree(f"{path}/features/fy_model")
    with pytest.raises(Exception):
        load_scoring_bundle(spark, path)


def test_search_ranges_are_drawn_within_bounds(spark):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    for learner, space in ((RandomForestRegressor(), M.FOREST_SPACE), (RandomForestRegressor(), M.RANDOMIZED_SPACE),
                           (GBTRegressor(), M.BOOST_SPACE), (GBTRegressor(), M.BOOSTED_SPACE)):
        maps = M.draw_param_maps(learner, space, 40)
        assert maps == M.draw_param_maps(learner, space, 40) and len({str(m) for m in maps}) > 30
        for m in maps:
            for p, v in m.items():
                r = space[p.name]
                assert v in r if isinstance(r, list) else r.low <= float(v) <= r.high
    assert M.SPACES["rf"][1] == 30 and M.SPACES["gbt"][1] == 20


def test_registered_scoring_and_stream_serve_all_features(spark, sf):
    import __spark_entry__ as E
    qs = E.queries()
    b = {r.case_id: r for r in qs["score_cases"](spark, sf).collect()}
    s = {r.case_id: r for r in qs["score_stream"](spark, sf).collect()}
    one = {r.case_id: r for r in qs["score_cases_one"](spark, sf).collect()}
    assert b and set(b) == set(s) == set(one)
    for k, r in s.items():
        assert all(getattr(r, c) == getattr(b[k], c) for c in ("office_key", "office_label", "office_known"))
        assert all(abs(getattr(r, c) - getattr(b[k], c)) <= 0.11 for c in ("predicted_days", "lower_bound", "upper_bound"))
    by_office = {}
    for k in b:
        by_office.setdefault(b[k].office_key, []).append(k)
    several = [v for v in by_office.values() if len(v) > 2]
    # One feature gives each office one prediction; with all of them dates and case numbers count too.
    assert several and all(len({one[k].predicted_days for k in v}) == 1 for v in several)
    assert all(len({b[k].predicted_days for k in v}) > 1 for v in several)


def test_registered_fits_and_report_use_all_features(spark, sf):
    import json

    import numpy as np

    import __spark_entry__ as E
    from leadtime.plans.catalog_ml import training_tables
    qs, oracle = E.queries(), E.oracle_sql()
    fm, _, tr, te, _ = training_tables(spark, sf)
    (x, y), (tx, ty) = ((d[list(fm.features)].to_numpy(), d["label"].to_numpy()) for d in (tr.toPandas(), te.toPandas()))
    mean, std = x.mean(0), x.std(0, ddof=1)
    std[std == 0] = 1
    z, tz, at = (x - mean) / std, (tx - mean) / std, y.mean()
    slopes = {"fit_linear": np.linalg.lstsq(z, y - at, rcond=1e-9)[0],
              "fit_ridge": np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - at))}
    for key, w in slopes.items():
        got = qs[key](spark, sf).first()
        assert got.n == len(ty) and abs(got.mae - abs(ty - at - tz @ w).mean()) < 0.01 * got.mae
        one = qs[f"{key}_one"](spark, sf).first()
        assert (got.mae, got.rmse) != (one.mae, one.rmse)
    report = qs["write_model_report"](spark, sf).collect()
    assert {r.model for r in report} == {"linear", "ridge"}
    assert all(json.loads(r.features) == list(fm.features) and len(fm.features) == len(M.FEATURES) for r in report)
    for key in (*slopes, "fit_lasso", "compare_models", "cross_validate", "learning_curve", "write_model_report", "score_cases", "score_stream"):
        assert key not in oracle and f"{key}_one" in oracle


def test_registered_curve_folds_and_comparison_cover_all_learners(spark, sf):
    import __spark_entry__ as E
    qs = E.queries()
    names = {"linear", "ridge", "lasso", "random_forest", "randomized_forest", "gradient_boosting"}
    assert {r.model for r in qs["compare_models"](spark, sf).collect()} == names
    cv = qs["cross_validate"](spark, sf).collect()
    assert {r.model for r in cv} == names and all(r.folds == 5 for r in cv)
    curve = {r["size"]: r for r in qs["learning_curve"](spark, sf).collect()}
    one = {r["size"]: r for r in qs["learning_curve_one"](spark, sf).collect()}
    assert set(curve) == set(one) and len(curve) == 8 and all(curve[k].train_mae_mean != one[k].train_mae_mean for k in one)


def _cases_for_stages(spark, sf):
    from leadtime.session import cut_lineage
    return cut_lineage(valid_cases(cases(spark, sf)), "valid")


def test_feature_stages_save_load_and_serve_unseen_rows(spark, sf, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from leadtime.plans.features import case_stages
    v = _cases_for_stages(spark, sf)
    offices = [r.office for r in v.select("office").distinct().orderBy("office").collect()]
    tr, te = v.filter(F.col("office") != offices[0]), v.filter(F.col("office") == offices[0])   # an office no row of training has
    pipe = Pipeline(stages=case_stages(M.FEATURES, min_samples=20))
    pipe.write().overwrite().save(f"{tmp_path}/p")
    fitted = Pipeline.load(f"{tmp_path}/p").fit(tr)
    fitted.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    a, b = (m.transform(te).orderBy("case_id").collect() for m in (pipe.fit(tr), again))
    assert a == b and a[0].asDict().keys() == {"case_id", "label", *M.FEATURES}
    assert all(x is not None for r in a for x in r) and {r.office_code for r in a} == {0.0}
    assert te.drop("lead_days").limit(1).count() == 1 and "label" not in again.transform(te.drop("lead_days")).columns
    assert again.stages[1].tables["office"].count() == len(offices) - 1


def test_folds_do_not_see_held_out_rows(spark, sf):
    """Altered targets of the held-out rows change their labels and nothing else of the fold."""
    from leadtime.plans.features import case_stages
    v = _cases_for_stages(spark, sf)
    stages = case_stages(M.FEATURES, min_samples=20)
    placed = M._folds_by_position(v, "case_id", 3)
    held = [r.case_id for r in placed.filter("fold = 2").select("case_id").collect()]
    changed = v.withColumn("lead_days", F.when(F.col("case_id").isin(held), F.col("lead_days") + 500).otherwise(F.col("lead_days")))
    for (f, tr, te), (_, tr2, te2) in zip(M.refitted_folds(v, stages, "case_id", 3), M.refitted_folds(changed, stages, "case_id", 3), strict=True):
        if f == 2:
            key = lambda t: sorted(t.drop("label").collect())
            assert key(tr) == key(tr2) and key(te) == key(te2)
            assert sorted(tr.select("label").collect()) == sorted(tr2.select("label").collect())
            assert te.agg(F.sum("label")).first()[0] + 500 * len(held) == pytest.approx(te2.agg(F.sum("label")).first()[0])
        else:
            assert sorted(tr.select("office_mean_days").distinct().collect()) != sorted(tr2.select("office_mean_days").distinct().collect())


def _small_matrix(spark, n=120):
    return spark.range(n).select((F.col("id") % 40).cast("string").alias("case_id"), (F.col("id") * 1.0).alias("a"),
                                 (F.hash("id") % 7).cast("double").alias("b")).withColumn("label", F.col("a") * 2 + F.col("b"))


def test_stacking_keeps_rows_that_share_a_key(spark):
    df = _small_matrix(spark)
    met, preds = M.stacking(df, df, ["a", "b"], "case_id", M.QUICK_SPECS[:2], k=3, alpha=1.0)
    assert preds.count() == 120 and met.first()["n"] == 120
    assert met.first()["mae"] < 3


def test_search_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    df = _small_matrix(spark).withColumn("case_id", F.col("a").cast("string"))
    spec = M.ModelSpec("x", "xrf", {})
    space = {"numTrees": [2, 3], "minInstancesPerNode": M.Ints(1, 9)}
    state = f"{tmp_path}/search"
    fits = []
    real = M.build_estimator

    def counted(*a, **kw):
        pipe = real(*a, **kw)
        fit = pipe.copy

        def copy(extra=None):
            fits.append(extra)
            if len(fits) == 5 and not (tmp_path / "went-on").exists():
                raise RuntimeError("lost")
            return fit(extra)
        pipe.copy = copy
        return pipe
    monkeypatch.setattr(M, "build_estimator", counted)
    args = (df, ["a", "b"], "case_id", spec, space)
    with pytest.raises(RuntimeError):
        M.random_search(*args, n_draws=3, k=2, parallelism=1, state=state)
    (tmp_path / "went-on").touch()
    before = len(fits)
    res, _, best = M.random_search(*args, n_draws=3, k=2, parallelism=1, state=state)
    assert len(fits) - before == 1 + 1                     # the lost run and the refit of the best
    monkeypatch.setattr(M, "build_estimator", real)
    fresh, _, best2 = M.random_search(*args, n_draws=3, k=2, parallelism=2)
    rows = lambda t: sorted((r.draw, r.params, round(r.cv_mae, 9), r.folds) for r in t.collect())
    assert rows(res) == rows(fresh) and len(rows(res)) == 3
    assert {p.name: v for p, v in best.items()} == {p.name: v for p, v in best2.items()}
    with pytest.raises(ValueError, match="another search"):
        M.random_search(df, ["a", "b"], "case_id", spec, {"numTrees": [5]}, n_draws=3, k=2, state=state)
