"""Table and model-report writers (§2.1)."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite",
                header: bool = True) -> DataFrame:
    """Write with Spark's committer (task retries and lost executors are safe) and return the
    read-back row count as a one-row frame."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", header).csv(path)
        back = df.sparkSession.read.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)
        back = df.sparkSession.read.format(fmt).load(path)
    return back.agg(F.count(F.lit(1)).alias("rows"))


def write_model_report(model: PipelineModel, metrics: DataFrame, features, path: str, digits: int = 4) -> None:
    """Save the fitted pipeline, and one JSON report row per model (rounded metrics, rank,
    ordered feature list) next to it."""
    model.write().overwrite().save(f"{path}/model")
    cols = [c for c in ("mae", "rmse", "r2", "mape") if c in metrics.columns]
    rep = metrics.select(*[c for c in metrics.columns if c not in cols],
                         *[F.round(c, digits).alias(c) for c in cols],
                         F.lit(json.dumps(list(features))).alias("features"))
    rep.coalesce(1).write.mode("overwrite").json(f"{path}/report")


def report_rows(metrics: DataFrame, cv: DataFrame | None = None, tuned: DataFrame | None = None, search: DataFrame | None = None,
                digits: int = 4) -> DataFrame:
    """A whole training report as rows (part, model, rank, measure, value, params).

    Parts: ``holdout`` (metrics and rank of every model), ``cv`` (means and deviations over the folds), ``tuned`` (hold-out
    metrics of the tuned model) and ``search`` (every draw with its parameters, ranked by its error).
    """
    def long(df: DataFrame, part: str, measures, model, rank, params) -> DataFrame:
        values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), digits).alias("value")) for m in measures])
        return df.select(F.lit(part).alias("part"), model.alias("model"), rank.cast("int").alias("rank"), params.cast("string").alias("params"),
                         F.inline(values)).select("part", "model", "rank", "measure", "value", "params")
    none, usual = F.lit(None), ("mae", "rmse", "r2", "mape")
    out = long(metrics, "holdout", usual, F.col("model"), F.col("rank") if "rank" in metrics.columns else none, none)
    if cv is not None:
        out = out.unionByName(long(cv, "cv", [c for c in cv.columns if c.startswith("cv_")], F.col("model"), none, none))
    if tuned is not None:
        out = out.unionByName(long(tuned, "tuned", usual, F.col("model"), none, none))
    if search is not None:
        place = F.row_number().over(Window.orderBy("cv_mae", "draw"))  # one row a draw
        out = out.unionByName(long(search.withColumn("_rank", place), "search", ("cv_mae", "cv_mae_std"), F.concat(F.lit("draw "), "draw"),
                                   F.col("_rank"), F.col("params")))
    return out


def write_training_report(model: PipelineModel, rows: DataFrame, features, path: str) -> DataFrame:
    """Saves the fitted pipeline, its ordered features and the report rows; returns the rows as read back."""
    spark = rows.sparkSession
    model.write().overwrite().save(f"{path}/model")
    spark.range(1).select(F.lit(json.dumps(list(features))).alias("features")).coalesce(1).write.mode("overwrite").json(f"{path}/features")
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    return spark.read.schema(rows.schema).json(f"{path}/report")
