"""Duration regressors on Spark ML (§2.12).

One long predictions table (model, fold, key, label, prediction) feeds every metric; fits are
Spark ML jobs over the whole training table (tree learners aggregate split statistics across
executors, linear learners run distributed normal-equation / L-BFGS / OWL-QN passes).  The
driver only loops over model specs, folds and parameter draws.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import hash_bucket
from ..operators.clean import LEAKAGE_COLS, drop_columns_present
from ..operators.encode import apply_codes, label_codes
from ..operators.impute import numeric_fill_values
from ..operators.stats import nan_to_null, numeric_columns, ntile_from_index, with_row_index
from ..operators.windows import contiguous_folds
from ..session import cut_lineage, scratch_path
from .extra_trees import DEEPEST, ArrayAssembler, ExtraTreesRegressor
from .linear import LINEAR_KINDS, fold_metrics, held_out_metrics, size_metrics
from .metrics import regression_metrics

# Training features in order (office is label-coded; the rest come from the
# prepared and engineered case table).
FEATURES = (
    "office_code", "fiscal_year", "case_no", "submit_year", "submit_month", "submit_quarter",
    "submit_day_of_week", "submit_day_of_year", "case_number", "seasonal_index_month", "seasonal_index_quarter",
    "is_peak_season", "office_mean_days", "office_median_days", "office_std_days", "office_volume",
    "office_approval_rate", "office_ap_rate", "office_refusal_rate", "office_221g_rate", "fiscal_year_index",
    "submit_month_sin", "submit_month_cos", "submit_day_of_week_sin", "submit_day_of_week_cos",
    "submit_quarter_sin", "submit_quarter_cos", "submit_day_of_year_sin", "submit_day_of_year_cos",
)


@dataclass
class FeatureMatrix:
    data: DataFrame            # key, label, feature columns (numeric, no nulls)
    features: list
    fills: dict                # median per feature, reused at scoring time
    office_codes: DataFrame | None = None


def feature_matrix(df: DataFrame, key: str, target: str = "lead_days", features=None, office: str | None = "office",
                   leakage=LEAKAGE_COLS, fit_rows=None) -> FeatureMatrix:
    """Drop leakage columns and rows without target, label-code the office, keep numeric
    features, fill remaining nulls with the column median; NaN is null.

    ``fit_rows`` (frame -> frame, e.g. the training side of a split by key) chooses the rows that codes
    and medians are learned from, all rows by default; an office that they lack has code 0.
    """
    fit_rows = fit_rows or (lambda x: x)
    out = drop_columns_present(nan_to_null(df), [c for c in leakage if c != key]).filter(F.col(target).isNotNull())
    codes = None
    if office and office in out.columns:
        # Written, so that Spark sees its size and need not deal the rows by office.
        codes = cut_lineage(label_codes(fit_rows(out), office), "codes")
        out = apply_codes(out, office, codes, "office_code", default=0)
    feats = list(features) if features else [c for c in numeric_columns(out, exclude=(target,)) if c != key]
    feats = [c for c in feats if c in out.columns]
    out = out.select(key, F.col(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in feats])
    fills = numeric_fill_values(fit_rows(out), feats)
    if fills:
        out = out.fillna(fills)
    return FeatureMatrix(out, feats, fills, codes)


# ---------------------------------------------------------------------------------------------
@dataclass
class ModelSpec:
    name: str
    kind: str                  # linear | ridge | lasso | rf | gbt | xrf
    params: dict = field(default_factory=dict)
    scale: bool = False


# Learner settings of the reference's model zoo (200 trees, leaf 5, ...).
REFERENCE_SPECS = (
    ModelSpec("linear", "linear", {}, True),
    ModelSpec("ridge", "ridge", {"alpha": 1.0}, True),
    ModelSpec("lasso", "lasso", {"alpha": 0.5, "maxIter": 5000}, True),
    ModelSpec("random_forest", "rf", {"numTrees": 200, "minInstancesPerNode": 5, "maxDepth": 30}),
    ModelSpec("randomized_forest", "xrf", {"numTrees": 200, "minInstancesPerNode": 5, "maxDepth": DEEPEST}),
    ModelSpec("gradient_boosting", "gbt", {"maxIter": 200, "stepSize": 0.1, "maxDepth": 5}),
)
# Boosted presets standing in for the gradient-boosting libraries' settings.
BOOSTED_SPECS = (
    ModelSpec("boosted_a", "gbt", {"maxIter": 400, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8,
                                   "featureSubsetStrategy": "0.8"}),
    ModelSpec("boosted_b", "gbt", {"maxIter": 400, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8}),
)
# Small settings for checks on small data.
QUICK_SPECS = (
    ModelSpec("linear", "linear", {}, True),
    ModelSpec("ridge", "ridge", {"alpha": 1.0}, True),
    ModelSpec("lasso", "lasso", {"alpha": 0.5, "maxIter": 200}, True),
    ModelSpec("random_forest", "rf", {"numTrees": 12, "minInstancesPerNode": 5, "maxDepth": 8}),
    ModelSpec("randomized_forest", "xrf", {"numTrees": 12, "minInstancesPerNode": 5, "maxDepth": 8}),
    ModelSpec("gradient_boosting", "gbt", {"maxIter": 15, "stepSize": 0.1, "maxDepth": 5}),
)


def _label_stats(df: DataFrame) -> tuple[int, float]:
    row = df.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("s")).first()
    return int(row["n"]), float(row["s"] or 0.0)


def build_estimator(spec: ModelSpec, features, train: DataFrame | None = None, seed: int = 42):
    """Pipeline(assembler [, scaler], learner) for one spec."""
    if spec.kind == "xrf":
        stages = [ArrayAssembler(inputCols=list(features), outputCol="raw_features")]
    else:
        stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="error")]
    fcol = "raw_features"
    if spec.scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
        fcol = "features"
    p = dict(spec.params)
    if spec.kind == "linear":
        learner = LinearRegression(featuresCol=fcol, regParam=0.0, solver="normal")
    elif spec.kind == "ridge":
        # L2 of alpha on the sum of squares == Spark's regParam * n / std_pop(label) (labels are
        # standardised internally by the normal solver).
        n, sy = _label_stats(train) if train is not None else (1, 1.0)
        reg = p.get("alpha", 1.0) * (sy if sy > 0 else 1.0) / max(n, 1)
        learner = LinearRegression(featuresCol=fcol, regParam=reg, elasticNetParam=0.0, standardization=False,
                                   solver="normal")
    elif spec.kind == "lasso":
        learner = LinearRegression(featuresCol=fcol, regParam=p.get("alpha", 0.5), elasticNetParam=1.0,
                                   standardization=False, maxIter=p.get("maxIter", 100))
    elif spec.kind == "rf":
        learner = RandomForestRegressor(featureSubsetStrategy=p.get("featureSubsetStrategy", "all"), bootstrap=True,
                                        numTrees=p.get("numTrees", 100), minInstancesPerNode=p.get("minInstancesPerNode", 1),
                                        maxDepth=p.get("maxDepth", 10), seed=seed, featuresCol=fcol, maxBins=p.get("maxBins", 64))
    elif spec.kind == "xrf":
        learner = ExtraTreesRegressor(featureSubsetStrategy=p.get("featureSubsetStrategy", "all"),
                                      numTrees=p.get("numTrees", 100), minInstancesPerNode=p.get("minInstancesPerNode", 1),
                                      minInstancesToSplit=p.get("minInstancesToSplit", 2),
                                      maxDepth=p.get("maxDepth", DEEPEST), seed=seed, featuresCol=fcol)
    elif spec.kind == "gbt":
        learner = GBTRegressor(featuresCol=fcol, maxIter=p.get("maxIter", 100), stepSize=p.get("stepSize", 0.1),
                               maxDepth=p.get("maxDepth", 5), subsamplingRate=p.get("subsamplingRate", 1.0),
                               featureSubsetStrategy=p.get("featureSubsetStrategy", "all"), seed=seed,
                               maxBins=p.get("maxBins", 64))
    else:
        raise ValueError(f"unknown model kind {spec.kind}")
    return Pipeline(stages=stages + [learner])


def _pred_rows(model: PipelineModel, df: DataFrame, name: str, key: str, fold=None) -> DataFrame:
    out = model.transform(df).select(F.lit(name).alias("model"), key, "label", F.col("prediction").cast("double"))
    return out.withColumn("fold", F.lit(fold).cast("int")) if fold is not None else out


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_models(train: DataFrame, test: DataFrame, features, key: str, specs=QUICK_SPECS,
                   rank_by: str = "mae") -> tuple[DataFrame, dict, DataFrame]:
    """Fit every spec on train, score test; metrics (one row per model, with train seconds and
    rank by MAE), fitted models, and the long predictions table."""
    spark = train.sparkSession
    fitted, times, preds = {}, [], []
    for spec in specs:
        t0 = time.time()
        m = build_estimator(spec, features, train).fit(train)
        times.append((spec.name, round(time.time() - t0, 2)))
        fitted[spec.name] = m
        preds.append(_pred_rows(m, test, spec.name, key))
    long = _union(preds)
    met = regression_metrics(long)
    tt = spark.createDataFrame(times, "model string, train_seconds double")
    from ..operators.windows import rank_models
    met = rank_models(met.join(F.broadcast(tt), "model"), rank_by)
    return met, fitted, long


def cross_validate(df: DataFrame, features, key: str, specs, k: int = 5, order_key: str | None = None,
                   fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """k contiguous folds (ntile order of ``order_key``); per spec and fold: fit on the other
    folds, score the held-out fold.  Returns per-model mean/std(pop) of MAE, RMSE, R2 over folds,
    and the per-fold metrics.  Linear learners of all folds take two passes together (``linear``);
    other learners are fitted fold by fold."""
    flat = [s for s in specs if s.kind in LINEAR_KINDS]
    folded = df if fold_col in df.columns else contiguous_folds(df, [order_key or key], k, fold_col)
    if len(flat) < len(specs):
        folded = cut_lineage(folded, "folds")  # so that no fit numbers the rows anew
    tables = [fold_metrics(folded, features, flat, F.col(fold_col), range(1, k + 1))] if flat else []
    preds = []
    for spec in [s for s in specs if s.kind not in LINEAR_KINDS]:
        fit = fold_fits(build_estimator(spec, features, folded), folded, fold_col) if spec.kind == "xrf" else None
        for f in range(1, k + 1):
            tr = folded.filter(F.col(fold_col) != f)
            te = folded.filter(F.col(fold_col) == f)
            m = fit(f) if fit else build_estimator(spec, features, tr).fit(tr)
            preds.append(_pred_rows(m, te, spec.name, key, f))
    if preds:
        tables.append(regression_metrics(_union(preds), group=("model", "fold")))
    per_fold = _union(tables)
    return _fold_summary(per_fold), per_fold


def fold_fits(pipe: Pipeline, folded: DataFrame, fold_col: str = "fold") -> Callable[..., PipelineModel]:
    """A function (fold, parameters) -> ``pipe`` fitted with them on the rows of the other folds; on all for None.

    Randomised trees read the rows in a form of their own, which is written once for all these fits.
    """
    if not isinstance(pipe.getStages()[-1], ExtraTreesRegressor):
        return lambda fold, params=None: pipe.copy(params).fit(folded if fold is None else folded.where(F.col(fold_col) != fold))
    front = pipe.getStages()[:-1]      # learn nothing
    coded = pipe.getStages()[-1].code(PipelineModel(front).transform(folded), fold_col)
    return lambda fold, params=None: PipelineModel([*front, pipe.copy(params).getStages()[-1].fit_coded(coded, fold)])


def refitted_folds(cases: DataFrame, stages: list, key: str, k: int):
    """(fold, training matrix, held-out matrix) for k contiguous folds of a case table by ``key``.

    ``stages`` (see ``features.case_stages``) are fitted on the training side of each fold alone, so a held-out row never
    reaches a lookup table, code or fill that its own prediction uses.  Each matrix is written once.
    """
    placed = cut_lineage(_folds_by_position(cases, key, k), "folds")
    for f in range(1, k + 1):
        inside, held = placed.filter(F.col("fold") != f).drop("fold"), placed.filter(F.col("fold") == f).drop("fold")
        fitted = Pipeline(stages=stages).fit(inside)
        yield f, cut_lineage(fitted.transform(inside), "train"), cut_lineage(fitted.transform(held), "held")


def cross_validate_refitted(cases: DataFrame, stages: list, features, key: str, specs, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """``cross_validate`` from the case table, with the features fitted anew in every fold."""
    flat = [s for s in specs if s.kind in LINEAR_KINDS]
    tables, preds = [], []
    for f, tr, te in refitted_folds(cases, stages, key, k):
        if flat:
            tables.append(held_out_metrics(tr, te, features, flat).withColumn("fold", F.lit(f)))
        for spec in [s for s in specs if s.kind not in LINEAR_KINDS]:
            preds.append(_pred_rows(build_estimator(spec, features, tr).fit(tr), te, spec.name, key, f))
    if preds:
        tables.append(regression_metrics(_union(preds), group=("model", "fold")))
    per_fold = _union(tables)
    return _fold_summary(per_fold), per_fold


def _fold_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("model").agg(
        *[F.avg(c).alias(f"cv_{c}_mean") for c in ("mae", "rmse", "r2")],
        *[F.stddev_pop(c).alias(f"cv_{c}_std") for c in ("mae", "rmse", "r2")],
        F.count(F.lit(1)).alias("folds"))


def cross_validate_top(metrics: DataFrame, df: DataFrame, features, key: str, specs, top_n: int = 3, k: int = 5,
                       order_key: str | None = None):
    """Cross-validate the top_n specs by hold-out rank (a metrics table from compare_models)."""
    names = [r["model"] for r in metrics.orderBy("rank").select("model").limit(top_n).collect()]
    chosen = [s for n in names for s in specs if s.name == n]
    return cross_validate(df, features, key, chosen, k, order_key)


def hash_sample(df: DataFrame, key: str, pct: int, salt: str = "sample") -> DataFrame:
    """Deterministic pct% sample without replacement (hash bucket < pct)."""
    return df.filter(hash_bucket(key, 100, salt) < F.lit(pct))


def cross_validate_sampled(df: DataFrame, features, key: str, specs, pct: int = 30, k: int = 3):
    return cross_validate(hash_sample(df, key, pct), features, key, specs, k)


@dataclass(frozen=True)
class Ints:
    """A whole number from ``low`` to ``high``, both included, all equally likely."""

    low: int
    high: int


@dataclass(frozen=True)
class Floats:
    """A number between ``low`` and ``high``, all equally likely."""

    low: float
    high: float
    as_text: bool = False      # featureSubsetStrategy takes a share as text


# Search distributions (forest, randomised forest, boosting, boosted presets) and draws of
# each.  For Spark's own forests unlimited depth and depths over 30 are 30, the deepest they build; a minimum
# number of rows to split and penalties on leaf weights have no counterpart in them.
FOREST_SPACE = {"numTrees": Ints(100, 599), "maxDepth": [30, 10, 20, 30, 30], "minInstancesPerNode": Ints(1, 9),
                "featureSubsetStrategy": ["sqrt", "log2", "0.5", "0.7", "all"], "bootstrap": [True, False]}
RANDOMIZED_SPACE = {"numTrees": Ints(100, 599), "maxDepth": [DEEPEST, 10, 20, 30], "minInstancesPerNode": Ints(1, 9),
                    "minInstancesToSplit": Ints(2, 19), "featureSubsetStrategy": ["sqrt", "log2", "0.5", "0.7"]}
BOOST_SPACE = {"maxIter": Ints(100, 499), "stepSize": Floats(0.01, 0.31), "maxDepth": Ints(3, 7),
               "subsamplingRate": Floats(0.6, 1.0), "minInstancesPerNode": Ints(1, 19)}
BOOSTED_SPACE = {"maxIter": Ints(200, 799), "stepSize": Floats(0.01, 0.16), "maxDepth": Ints(3, 9),
                 "subsamplingRate": Floats(0.6, 1.0), "featureSubsetStrategy": Floats(0.5, 1.0, True),
                 "minInstancesPerNode": Ints(1, 19)}
SPACES = {"rf": (FOREST_SPACE, 30), "xrf": (RANDOMIZED_SPACE, 30), "gbt": (BOOST_SPACE, 20)}


def _draw(rnd: random.Random, values):
    if isinstance(values, Ints):
        return rnd.randint(values.low, values.high)
    if isinstance(values, Floats):
        x = rnd.uniform(values.low, values.high)
        return f"{x:.4f}" if values.as_text else x
    return rnd.choice(values)


def draw_param_maps(learner, space: dict, n: int, seed: int = 42) -> list:
    """n parameter maps drawn (with a seeded generator) from the ranges and value lists of ``space``."""
    rnd = random.Random(seed)
    maps = []
    for _ in range(n):
        pm = {}
        for name, values in sorted(space.items()):
            if learner.hasParam(name):
                pm[learner.getParam(name)] = _draw(rnd, values)
        maps.append(pm)
    return maps


def random_search(train: DataFrame, features, key: str, spec: ModelSpec, space: dict | None = None, n_draws: int | None = None,
                  k: int = 5, seed: int = 42, parallelism: int = 2, subsample_pct: int | None = None,
                  state: str | None = None):
    """Randomised search (by default over the learner's usual ranges and number of draws) with contiguous-fold
    CV scored by MAE; best draw refit on the whole of
    ``train``.  With ``subsample_pct`` the search runs on a hash sample and the refit on all.

    Every (draw, fold) is fitted once, and its metrics are written as a row of their own under the folder ``state``
    (by default a scratch folder).  A search that is started again with the same folder and arguments goes on
    with what is missing; a folder of another search is an error.
    """
    if spec.kind in ("linear", "ridge", "lasso"):
        # nothing to tune: the reference skips the search and keeps the plain fit
        empty = train.sparkSession.createDataFrame([], "draw int, params string, cv_mae double, cv_mae_std double")
        return empty, build_estimator(spec, features, train).fit(train), {}
    usual, draws = SPACES[spec.kind]
    space, n_draws = space or usual, n_draws or draws
    search_df = hash_sample(train, key, subsample_pct) if subsample_pct else train
    folded = cut_lineage(contiguous_folds(search_df, [key], k, "fold"), "folds")
    pipe = build_estimator(spec, features, search_df)
    maps = draw_param_maps(pipe.getStages()[-1], space, n_draws, seed)
    named = [json.dumps({p.name: v for p, v in sorted(m.items(), key=lambda x: x[0].name)}) for m in maps]
    spark, state = train.sparkSession, state or scratch_path(train.sparkSession, "search")

    fit = fold_fits(pipe, folded)

    def run(draw: int, fold: int) -> None:
        model = fit(fold, maps[draw])
        preds = _pred_rows(model, folded.where(F.col("fold") == fold), spec.name, key)
        row = regression_metrics(preds).select(F.lit(draw).alias("draw"), F.lit(fold).alias("fold"), F.lit(named[draw]).alias("params"),
                                               "n", "mae", "rmse", "r2", "mape")
        row.coalesce(1).write.mode("overwrite").parquet(f"{state}/{_run_name(draw, fold)}")

    runs = [(d, f) for d in range(len(maps)) for f in range(1, k + 1)]
    done = _finished_runs(spark, state)
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(lambda r: run(*r), [r for r in runs if _run_name(*r) not in done]))
    rows = spark.read.parquet(*[f"{state}/{_run_name(*r)}" for r in runs])
    found = rows.groupBy("draw", "params").agg(
        F.avg("mae").alias("cv_mae"), F.stddev_pop("mae").alias("cv_mae_std"), F.avg("rmse").alias("cv_rmse"), F.avg("r2").alias("cv_r2"),
        F.count("*").alias("folds"))
    scores = {r["draw"]: r for r in found.collect()}   # one row a draw
    if len(scores) != len(maps) or any(scores[i]["params"] != named[i] for i in scores):
        raise ValueError(f"{state} holds the runs of another search")
    best_i = min(scores, key=lambda i: (scores[i]["cv_mae"], i))
    return found, pipe.copy(maps[best_i]).fit(train) if subsample_pct else fit(None, maps[best_i]), maps[best_i]


def _run_name(draw: int, fold: int) -> str:
    return f"draw-{draw}-fold-{fold}"


def _finished_runs(spark: SparkSession, state: str) -> set[str]:
    """Names of the runs below ``state`` that were written to their end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(state)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {n for n in names if fs.exists(hadoop.Path(f"{state}/{n}/_SUCCESS"))}


def stacking(train: DataFrame, test: DataFrame, features, key: str, base_specs, k: int = 3, alpha: float = 10.0):
    """Out-of-fold predictions of the base learners (k contiguous folds) train a standardised
    ridge meta-learner; bases are refit on all of train for the test predictions.

    Out-of-fold predictions are one long table (row position, label, model, prediction), pivoted by position,
    so rows that share a key stay apart and nothing is joined.
    """
    placed = cut_lineage(_folds_by_position(train, key, k), "folds")
    parts = []
    for spec in base_specs:
        for f in range(1, k + 1):
            tr, te = placed.filter(F.col("fold") != f), placed.filter(F.col("fold") == f)
            m = build_estimator(spec, features, tr).fit(tr)
            parts.append(m.transform(te).select("position", "label", F.lit(spec.name).alias("model"), "prediction"))
    meta_cols = [f"p_{s.name}" for s in base_specs]
    meta_in = cut_lineage(_union(parts).groupBy("position", "label").agg(
        *[F.max(F.when(F.col("model") == s.name, F.col("prediction"))).alias(c) for s, c in zip(base_specs, meta_cols, strict=True)]), "stack")
    meta_spec = ModelSpec("stack_meta", "ridge", {"alpha": alpha}, True)
    meta = build_estimator(meta_spec, meta_cols, meta_in).fit(meta_in)
    test_in = test.select(key, "label", *features)
    for spec in base_specs:
        test_in = _with_prediction(test_in, build_estimator(spec, features, train).fit(train), f"p_{spec.name}")
    preds = meta.transform(test_in).select(F.lit("stacking").alias("model"), key, "label", F.col("prediction").cast("double"))
    return regression_metrics(preds), preds


def stacking_refitted(cases: DataFrame, test_cases: DataFrame, stages: list, features, key: str, base_specs, k: int = 3,
                      alpha: float = 10.0):
    """``stacking`` from the case table: the features of out-of-fold predictions are fitted anew in every fold."""
    names = [f"p_{s.name}" for s in base_specs]
    parts = []
    for _, tr, te in refitted_folds(cases, stages, key, k):
        out = te
        for spec, name in zip(base_specs, names, strict=True):
            out = _with_prediction(out, build_estimator(spec, features, tr).fit(tr), name)
        parts.append(out.select(key, "label", *names))
    meta_in = cut_lineage(_union(parts), "stack")
    meta = build_estimator(ModelSpec("stack_meta", "ridge", {"alpha": alpha}, True), names, meta_in).fit(meta_in)
    fitted = Pipeline(stages=stages).fit(cases)
    train, test = cut_lineage(fitted.transform(cases), "train"), fitted.transform(test_cases)
    for spec, name in zip(base_specs, names, strict=True):
        test = _with_prediction(test, build_estimator(spec, features, train).fit(train), name)
    preds = meta.transform(test).select(F.lit("stacking").alias("model"), key, "label", F.col("prediction").cast("double"))
    return regression_metrics(preds), preds


def _with_prediction(df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", name).drop("raw_features", "features")


def _folds_by_position(df: DataFrame, key: str, k: int) -> DataFrame:
    """``df`` with its row position in the order of ``key`` and the contiguous fold of the position."""
    idx = with_row_index(df, [key], "position")
    n = idx.select(F.count(F.lit(1)).alias("n")).scalar()
    return idx.withColumn("fold", ntile_from_index(F.col("position"), n, k))


def feature_importance(model: PipelineModel, features, top_n: int = 20) -> DataFrame:
    """Tree importances, or |coefficient| for linear learners; top-N by value."""
    learner = model.stages[-1]
    if hasattr(learner, "featureImportances"):
        vals = learner.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in learner.coefficients.toArray().tolist()]
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(features, vals), key=lambda t: (-t[1], t[0]))[:top_n]
    return spark.createDataFrame([(f, float(v)) for f, v in rows], "feature string, importance double")


def learning_curve(df: DataFrame, features, key: str, spec: ModelSpec, sizes=(0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 1.0),
                   k: int = 3) -> DataFrame:
    """Train vs CV MAE (mean, std over k hash folds) on nested hash-prefix samples.  A linear learner takes two
    passes for all sizes and folds (``linear``); others are fitted for each."""
    base = df.withColumn("_b", hash_bucket(key, 1000, "lc")).withColumn("_f", hash_bucket(key, k, "fold"))
    base = cut_lineage(base)
    if spec.kind in LINEAR_KINDS:
        return _linear_curve(base, features, spec, sorted(sizes), k)
    rows = []
    for s in sizes:
        sub = base.filter(F.col("_b") < F.lit(int(round(s * 1000))))
        parts = []
        for f in range(k):
            tr, te = sub.filter(F.col("_f") != f), sub.filter(F.col("_f") == f)
            m = build_estimator(spec, features, tr).fit(tr)
            parts.append(_pred_rows(m, tr, "train", key, f).withColumn("size", F.lit(s)))
            parts.append(_pred_rows(m, te, "cv", key, f).withColumn("size", F.lit(s)))
        rows.append(_union(parts))
    long = _union(rows)
    per = regression_metrics(long, group=("size", "model", "fold"))
    return (per.groupBy("size").pivot("model", ["train", "cv"]).agg(F.avg("mae").alias("mae_mean"),
                                                                    F.stddev_pop("mae").alias("mae_std"),
                                                                    F.avg("n").alias("rows"))
               .orderBy("size"))


def _linear_curve(base: DataFrame, features, spec: ModelSpec, sizes, k: int) -> DataFrame:
    step = F.lit(len(sizes))
    for i in reversed(range(len(sizes))):
        step = F.when(F.col("_b") < F.lit(int(round(sizes[i] * 1000))), F.lit(i)).otherwise(step)
    per = size_metrics(base, features, spec, step, len(sizes), F.col("_f"), k)
    names = F.array(*[F.lit(float(s)) for s in sizes])
    return (per.withColumn("model", F.when(F.col("cv"), "cv").otherwise("train"))
            .groupBy(F.get(names, F.col("step")).alias("size")).pivot("model", ["train", "cv"])
            .agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), F.avg("n").alias("rows")).orderBy("size"))
