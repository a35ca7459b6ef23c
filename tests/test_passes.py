"""Queries read the driver tables once, lookups do not deal the cases by few keys, and every row is kept."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadtime.functions.keys import split_label
from leadtime.operators.clean import outliers_iqr
from leadtime.plans import catalog_ml, catalog_score, catalog_sources, catalog_stats, models
from leadtime.plans.catalog import ORACLE, QUERIES
from leadtime.plans.metrics import train_test_split
from leadtime.plans.registry import FEATURE_INPUT, valid
from leadtime.roles import cases


def test_outliers_iqr_has_its_whole_range(spark, sf):
    want = outliers_iqr(valid(spark, sf), "lead_days", 1.5).select("case_id", "lead_days")
    got = QUERIES["outliers_iqr"](spark, sf)
    assert got.count() == want.count() > outliers_iqr(valid(spark, sf), "lead_days", 0.5).count()
    assert "1.5 * (q3 - q1)" in ORACLE["outliers_iqr"] and "0.5 * (q3 - q1)" not in ORACLE["outliers_iqr"]


@pytest.mark.parametrize("name", ["corr_matrix", "corr_engineered", "numeric_hist_grid", "impute_report", "feature_matrix",
                                  "impute_feature_matrix", "regression_metrics", "error_distribution", "score_cases_one"])
def test_the_last_pass_reads_written_rows(spark, sf, name):
    files = QUERIES[name](spark, sf).inputFiles()
    assert files and not any("lineitem.parquet" in f for f in files)


def test_yearly_files_and_scoring_join_the_driver_tables_once(spark, sf, monkeypatch):
    calls = []

    def counted(module):
        kept = module.kept_valid
        monkeypatch.setattr(module, "kept_valid", lambda *a: calls.append(module.__name__) or kept(*a))
        monkeypatch.setattr(module, "valid", None, raising=False)
    for module in (catalog_sources, catalog_score, catalog_ml):
        counted(module)
    rows = QUERIES["scan_multi_file_union"](spark, sf).count()
    assert len(calls) == 1 and rows == valid(spark, sf).count()
    calls.clear()
    QUERIES["score_cases"](spark, sf)
    assert calls == ["leadtime.plans.catalog_score"]


def test_correlations_of_engineered_features_keep_no_keys(spark, sf, monkeypatch):
    kept, wide = [], QUERIES["corr_engineered"](spark, sf).collect()
    write = catalog_stats.kept_valid
    monkeypatch.setattr(catalog_stats, "kept_valid", lambda *a: kept.append(write(*a)) or kept[-1])
    got = QUERIES["corr_engineered"](spark, sf)
    assert got.collect() == wide and len(wide) == 10
    assert len(kept) == 1 and not {"case_id", "case_no", "case_number"} & set(kept[0].columns)
    assert kept[0].count() == valid(spark, sf).count()


def test_predictions_do_not_deal_cases_by_office_or_month(spark, sf):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000b")
    try:
        plan = catalog_stats.predictions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(office" not in plan and "hashpartitioning(submit_month" not in plan
    n = valid(spark, sf).count()
    per = {r["model"]: r["n"] for r in catalog_stats.predictions(spark, sf).groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert per == {"global_mean": n, "office_mean": n, "office_median": n, "month_mean": n}


def test_sides_and_folds_are_read_not_computed(spark, sf, monkeypatch):
    """Passes of fits hash no keys, and number no rows."""
    fm, data, tr, te, _ = catalog_ml.training_tables(spark, sf)
    assert all("md5" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (tr, te))
    assert data.columns == tr.columns == te.columns == fm.data.columns
    sides = [{r["case_id"] for r in x.select("case_id").collect()} for x in train_test_split(data, "case_id")]
    assert [{r["case_id"] for r in x.select("case_id").collect()} for x in (tr, te)] == sides and all(sides)
    seen, build = [], models.build_estimator
    monkeypatch.setattr(models, "build_estimator", lambda spec, feats, train: seen.append(train) or build(spec, feats, train))
    spec = models.ModelSpec("rf", "rf", {"numTrees": 1, "maxDepth": 1})
    _, per_fold = models.cross_validate(data, fm.features, "case_id", [spec], k=2)
    assert len(seen) == 2 and not any("Join" in x._jdf.queryExecution().optimizedPlan().toString() for x in seen)
    assert sum(r["n"] for r in per_fold.collect()) == data.count()


@pytest.fixture()
def own_tables(spark, tmp_path):
    """Driver tables of a few rows: line items repeat, some lack a part or a line number, some end before they begin."""
    day = dt.datetime(1998, 1, 1)
    offices = ["ALPHA", "BETA", "GAMMA"]
    orders = [(o, o % 3, "FOP"[o % 3], 100.0 * o, day + dt.timedelta(days=37 * o), f"{o % 5 + 1}-P") for o in range(1, 25)]
    items = [(o[0], None if i == 2 else o[0] % 7, o[0] % 4, None if i == 3 else i, 5.0, 10.0, 0.1, 0.0, "ANR"[i % 3], "OF"[i % 2],
              o[4] + dt.timedelta(days=(13 * o[0] + 29 * i) % 90 - 5)) for o in orders for i in (1, 1, 2, 3, 4, 5)]
    for name, rows, schema in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                               "o_orderpriority string"),
            ("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
            ("supplier", [(s, f"s{s}", s % 3, 1.0) for s in range(4)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
            ("nation", [(n, offices[n], n % 2) for n in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
            ("region", [(0, "R0"), (1, "R1")], "r_regionkey int, r_name string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["rank_models", "regression_metrics", "error_distribution"])
def test_evaluation_tables_keep_no_keys_and_every_row(spark, own_tables, monkeypatch, name):
    kept, write, make = [], catalog_stats.kept_valid, catalog_stats.predictions
    monkeypatch.setattr(catalog_stats, "kept_valid", lambda *a: kept.append(write(*a)) or kept[-1])
    got = QUERIES[name](spark, own_tables).collect()
    assert len(kept) == 1 and kept[0].columns == ["office", "lead_days", "submit_month"]
    assert kept[0].count() == valid(spark, own_tables).count() > kept[0].distinct().count()
    monkeypatch.setattr(catalog_stats, "predictions", lambda spark, sf, keys=(): make(spark, sf))
    want = QUERIES[name](spark, own_tables).collect()
    assert "case_id" in kept[1].columns and sorted(got) == sorted(want) and got


@pytest.mark.parametrize("one_feature", [True, False])
def test_scorers_write_only_what_they_read(spark, own_tables, monkeypatch, one_feature):
    v = valid(spark, own_tables)
    _, whole, _, te, _ = catalog_ml.training_tables(spark, own_tables, v)
    written, write = [], catalog_ml.cut_lineage
    monkeypatch.setattr(catalog_ml, "cut_lineage", lambda *a: written.append(write(*a)) or written[-1])
    kw = catalog_score.scoring_setup(spark, own_tables, one_feature, v)
    features = ["office_mean_days"] if one_feature else list(models.FEATURES)
    assert len(written) == 1 and set(written[0].columns) == {"label", "_side", *features} and kw["features"] == features
    rows = written[0].select("label", *features)
    assert rows.exceptAll(whole.select(rows.columns)).isEmpty() and rows.count() == whole.count() == v.count()
    error = kw["model"].transform(te).agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
    assert kw["rmse"] == pytest.approx(error)


def test_scoring_cases_name_requests_only(spark, own_tables):
    """the side is decided before the join and written; ids that nobody reads are neither shuffled nor written."""
    both = train_test_split(valid(spark, own_tables), "case_id")
    v = catalog_score.scoring_cases(spark, own_tables)
    rest = [c for c in FEATURE_INPUT if c != "case_id"]
    for side, want in zip(("train", "test"), both, strict=True):
        got = v.where(F.col("_side") == side)
        assert sorted(got.select(*rest).collect()) == sorted(want.select(*rest).collect()) and not got.isEmpty()
    asked = ["case_id", "office", "submit_ts", "status", "priority"]
    assert sorted(v.where("_side = 'test'").select(*asked).collect()) == sorted(both[1].select(*asked).collect())
    assert v.where("_side = 'train'").agg(*[F.count(c) for c in asked]).first()[:] == (0, both[0].count(), 0, 0, 0)
    assert "md5" not in catalog_score.requests_from_cases(spark, own_tables, v)._jdf.queryExecution().optimizedPlan().toString()


def test_cases_without_id_shuffle_no_parts_of_it(spark, own_tables):
    whole = cases(spark, own_tables)
    some = cases(spark, own_tables, named=lambda key: split_label(key) == "test")
    rest = [c for c in whole.columns if c != "case_id"]
    assert some.columns == whole.columns and some.count() == whole.count()
    assert sorted(some.select(*rest).collect()) == sorted(whole.select(*rest).collect())
    ids = sorted(r[0] for r in train_test_split(whole, "case_id")[1].select("case_id").collect())
    assert sorted(r[0] for r in some.where("case_id IS NOT NULL").select("case_id").collect()) == ids and ids
    plan = some.select("case_id", "submit_ts")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("md5"), "the side is decided below the joins"


def rows_of(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


def test_a_written_side_gives_the_scorer_of_hashed_keys(spark, own_tables):
    by_side = catalog_score.scoring_setup(spark, own_tables, v=catalog_score.scoring_cases(spark, own_tables))
    by_key = catalog_score.scoring_setup(spark, own_tables, v=valid(spark, own_tables))
    for k in ("rmse", "mae", "r2"):
        assert by_side[k] == pytest.approx(by_key[k])
    assert by_side["features"] == by_key["features"] and by_side["fills"] == by_key["fills"]
    for k in ("office_stats", "global_row", "codes"):
        assert rows_of(by_side[k]) == rows_of(by_key[k]) != []
