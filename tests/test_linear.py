import numpy as np
import pytest
from pyspark.sql import functions as F

from leadtime.plans import linear as L
from leadtime.plans import models as M
from leadtime.plans.catalog_ml import ONE_SPECS, training_tables
from leadtime.plans.metrics import regression_metrics

SPECS = {s.name: s for s in ONE_SPECS}


@pytest.fixture(scope="module")
def tables(spark):
    fm, data, tr, te, _ = training_tables(spark, "/root/testdata/sf0.001")
    return fm.features, data, tr, te


def arrays(df, features):
    p = df.select(*features, "label").toPandas()
    return p[list(features)].to_numpy(float), p["label"].to_numpy(float)


def slow_fit(x, y, kind, alpha):
    """By the definitions, on whole arrays."""
    mean, sd = x.mean(0), x.std(0, ddof=1)
    sd = np.where(sd > 1e-9 * np.maximum(np.abs(mean), 1), sd, np.inf)
    z, my = (x - mean) / sd, y.mean()
    if kind == "linear":
        w = np.linalg.lstsq(z, y - my, rcond=1e-9)[0]
    elif kind == "ridge":
        w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - my))
    else:                                                       # proximal gradient, no coordinate descent
        w = v = np.zeros(z.shape[1])
        a, b, t = z.T @ z / len(y), z.T @ (y - my) / len(y), 1.0
        step = 1 / np.linalg.eigvalsh(a).max()
        for _ in range(60_000):
            g = v - step * (a @ v - b)
            new = np.sign(g) * np.maximum(np.abs(g) - step * alpha, 0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v = new + (t - 1) / t_new * (new - w)
            w, t = new, t_new
    return lambda q: my + ((q - mean) / sd) @ w


@pytest.mark.parametrize("name", ["linear", "ridge", "lasso"])
def test_all_features_agree_with_the_definition_and_with_spark_ml(tables, name):
    features, _, tr, te = tables
    assert len(features) == 29
    spec = SPECS[name]
    alpha = spec.params.get("alpha", 0.0)
    fit = L.fit_linear(tr, features, spec.kind, alpha)
    (x, y), (xt, yt) = arrays(tr, features), arrays(te, features)
    want = slow_fit(x, y, spec.kind, alpha)(xt)
    got = xt @ fit.coef + fit.intercept
    assert np.abs(got - want).max() < 1e-6 * np.abs(want).max()
    column = np.array(sorted(r[0] for r in te.select(fit.predicted()).collect()))
    assert np.allclose(column, np.sort(got), rtol=1e-9)
    ml = M.build_estimator(spec, features, tr).fit(tr).transform(te)
    theirs = regression_metrics(ml.withColumn("model", F.lit("m"))).first()
    assert theirs["mae"] == pytest.approx(np.abs(want - yt).mean(), rel=1e-4)
    assert theirs["rmse"] == pytest.approx(np.sqrt(((want - yt) ** 2).mean()), rel=1e-4)


def test_folds_equal_separate_fits(tables):
    features, data, _, _ = tables
    summary, per = M.cross_validate(data, features, "case_id", tuple(SPECS.values()), k=5)
    got = {(r["model"], r["fold"]): r for r in per.collect()}
    assert len(got) == 15
    ordered = data.orderBy("case_id").select(*features, "label").toPandas().to_numpy(float)
    blocks = np.array_split(np.arange(len(ordered)), 5)
    for name, spec in SPECS.items():
        for f, held in enumerate(blocks, 1):
            rest = np.setdiff1d(np.arange(len(ordered)), held)
            p = slow_fit(ordered[rest, :-1], ordered[rest, -1], spec.kind, spec.params.get("alpha", 0.0))(ordered[held, :-1])
            e = p - ordered[held, -1]
            r = got[name, f]
            y = ordered[held, -1]
            assert r["n"] == len(held)
            assert r["mae"] == pytest.approx(np.abs(e).mean(), rel=1e-6) and r["rmse"] == pytest.approx(np.sqrt((e * e).mean()), rel=1e-6)
            assert r["r2"] == pytest.approx(1 - (e * e).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-6, abs=1e-8)
            assert r["mape"] == pytest.approx(100 * (np.abs(e) / np.maximum(np.abs(y), 1)).mean(), rel=1e-6)
    assert {r["model"]: r["folds"] for r in summary.collect()} == dict.fromkeys(SPECS, 5)


def test_learning_curve_equals_separate_fits(tables):
    features, data, _, _ = tables
    sizes, k = (0.2, 0.6, 1.0), 3
    got = {r["size"]: r for r in M.learning_curve(data, features, "case_id", SPECS["ridge"], sizes, k).collect()}
    from leadtime.functions.keys import hash_bucket
    t = data.select(*features, "label", hash_bucket("case_id", 1000, "lc").alias("b"), hash_bucket("case_id", k, "fold").alias("f")).toPandas()
    for s in sizes:
        sub = t[t.b < round(s * 1000)]
        train, cv = [], []
        for f in range(k):
            a, b = sub[sub.f != f], sub[sub.f == f]
            model = slow_fit(a[list(features)].to_numpy(float), a["label"].to_numpy(float), "ridge", 1.0)
            train.append(np.abs(model(a[list(features)].to_numpy(float)) - a["label"]).mean())
            cv.append(np.abs(model(b[list(features)].to_numpy(float)) - b["label"]).mean())
        assert got[s]["train_mae_mean"] == pytest.approx(np.mean(train), rel=1e-6)
        assert got[s]["cv_mae_mean"] == pytest.approx(np.mean(cv), rel=1e-6)
        assert got[s]["cv_mae_std"] == pytest.approx(np.std(cv), rel=1e-5)
        assert got[s]["train_rows"] + got[s]["cv_rows"] == pytest.approx(len(sub))


def test_dependent_and_constant_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 200)
    rows = [(float(v), float(2 * v), 5.0, float(3 * v + 1)) for v in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double")
    fit = L.fit_linear(df, ["a", "b", "c"])
    assert fit.coef[2] == 0 and fit.coef[0] + 2 * fit.coef[1] == pytest.approx(3)
    assert df.select(F.max(F.abs(fit.predicted() - F.col("label")))).first()[0] < 1e-9
    with pytest.raises(Exception, match="null in a feature"):
        L.fit_linear(df.withColumn("a", F.lit(None).cast("double")), ["a"])
