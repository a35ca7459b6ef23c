"""Model-evaluation tables over a long predictions table (model, [group...], label, prediction).

All metrics for all models (and optional sub-groups such as office or fold) come from one
aggregation; nothing is collected per model.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_order, split_label
from ..operators.charts import histogram
from ..operators.quantiles import quantiles
from ..operators.stats import percentile


def train_test_split(df: DataFrame, key: str, train_pct: int = 80, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Hash split on a row key: stable across partitionings, re-runs and engines."""
    lab = split_label(key, train_pct, salt)
    return df.filter(lab == "train"), df.filter(lab == "test")


def split_sides(df: DataFrame, key: str, side: str = "_side") -> tuple[DataFrame, DataFrame]:
    """Training and test rows by the column ``side`` where the split was written, else by the hash of the key."""
    if side not in df.columns:
        return train_test_split(df, key)
    return df.filter(F.col(side) == "train"), df.filter(F.col(side) == "test")


def regression_metrics(preds: DataFrame, label: str = "label", prediction: str = "prediction",
                       group=("model",)) -> DataFrame:
    """MAE, RMSE, R2 (null when the label is constant) and MAPE with denominator max(|y|, 1)."""
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    e = y - p
    return preds.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        (F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1.0))) * F.lit(100.0)).alias("mape"),
    )


def error_distribution(preds: DataFrame, label: str = "label", prediction: str = "prediction", group=("model",),
                       tolerances=(7, 14, 30), exact: bool = True) -> DataFrame:
    """P50/P75/P90 of |error| and % of rows within each tolerance (days)."""
    ae = F.abs(F.col(label).cast("double") - F.col(prediction).cast("double"))
    probs = (0.5, 0.75, 0.9)
    within = [(F.avg((ae <= F.lit(float(t))).cast("double")) * F.lit(100.0)).alias(f"within_{t}d_pct")
              for t in tolerances]
    if exact:
        q = quantiles(preds, {"error": ae}, probs, group)
        names = [f"_group{i}" for i in range(len(group))]
        both = preds.groupBy(*group).agg(*within).join(
            q.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("q").alias("_q")),
            reduce(and_, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names, strict=True)]), "left")
    else:
        both = preds.groupBy(*group).agg(percentile(ae, F.array(*[F.lit(p) for p in probs]), exact).alias("_q"), *within)
    return both.select(
        *group, F.col("_q")[0].alias("abs_err_p50"), F.col("_q")[1].alias("abs_err_p75"), F.col("_q")[2].alias("abs_err_p90"),
        *[f"within_{t}d_pct" for t in tolerances])


def residual_table(preds: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 50) -> DataFrame:
    """Histogram (50 equal-width bins) of residual = y - prediction for one model's predictions."""
    res = preds.withColumn("residual", F.col(label).cast("double") - F.col(prediction).cast("double"))
    return histogram(res, "residual", bins)


def residual_points(preds: DataFrame, key: str, n: int = 3000, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A hash sample of (label, prediction, residual) rows, for the residual and actual-against-predicted plots."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rows = preds.select(key, y.alias("label"), p.alias("prediction"), (y - p).alias("residual"))
    return rows.withColumn("_h", hash_order(key, "42")).orderBy("_h", key).limit(n).drop("_h")


def model_scorecard(metrics: DataFrame, name: str = "model") -> DataFrame:
    """Min-max normalised metrics over the models (higher = better): MAE/RMSE/MAPE inverted,
    R2 direct, +1e-9 in each denominator.  Windows run over the metrics table (one row per model)."""
    w = Window.partitionBy(F.lit(1))
    out = metrics
    for c in ("mae", "rmse", "mape"):
        out = out.withColumn(f"{c}_score", (F.max(c).over(w) - F.col(c)) / (F.max(c).over(w) - F.min(c).over(w) + F.lit(1e-9)))
    out = out.withColumn("r2_score", (F.col("r2") - F.min("r2").over(w)) / (F.max("r2").over(w) - F.min("r2").over(w) + F.lit(1e-9)))
    return out.select(name, "mae", "rmse", "r2", "mape", "mae_score", "rmse_score", "r2_score", "mape_score")
