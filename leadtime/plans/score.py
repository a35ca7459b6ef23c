"""Batch scoring of requests (§2.13) and the office tables the scorer serves.

Requests are a DataFrame (one row per request); office statistics are joined with a left join
and a global-default fallback; the fitted Spark ML PipelineModel scores all rows in one pass.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cyclical_encoding
from ..functions.flags import (PEAK_MONTHS, STATIC_MONTH_INDEX, STATIC_QUARTER_INDEX, prediction_interval,
                               speed_category)
from ..operators.clean import split_valid, validate_requests
from ..operators.encode import encode_apply_default
from ..operators.joins import join_fallback_global, map_lookup


def office_profile(stats: DataFrame, key: str = "office") -> DataFrame:
    """Rounded office statistics as served with each prediction (rates in percent, 1 decimal,
    half-even as Python's round)."""
    b = F.bround
    return stats.select(
        key,
        b(F.col("office_mean_days"), 1).alias("mean_processing_days"),
        b(F.col("office_median_days"), 1).alias("median_processing_days"),
        b(F.col("office_std_days"), 1).alias("std_processing_days"),
        F.col("office_volume").cast("int").alias("total_cases"),
        b(F.col("office_approval_rate") * 100, 1).alias("approval_rate_pct"),
        b(F.col("office_ap_rate") * 100, 1).alias("ap_rate_pct"),
        b(F.col("office_refusal_rate") * 100, 1).alias("refusal_rate_pct"),
        b(F.col("office_221g_rate") * 100, 1).alias("refusal_221g_pct"),
    )


def list_offices(stats: DataFrame, key: str = "office", labels: DataFrame | None = None,
                 label_key: str = "code", label_col: str = "label") -> DataFrame:
    """One row per office: code, label (itself when unknown), mean days and approval % (1 dp),
    sorted by label."""
    base = stats.dropDuplicates([key])
    if labels is not None:
        base = map_lookup(base, key, labels, label_key, label_col, "label")
    else:
        base = base.withColumn("label", F.col(key))
    return base.select(F.col(key).alias("code"), "label",
                       F.bround(F.col("office_mean_days"), 1).alias("mean_days"),
                       F.bround(F.col("office_approval_rate") * 100, 1).alias("approval_rate_pct")) \
               .orderBy("label", "code")


def request_features(valid_req: DataFrame, office_stats: DataFrame, global_row: DataFrame | None,
                     codes: DataFrame | None, fy_min=None, fy_max=None, seasonal_model=None, fy_model=None,
                     fills: dict | None = None) -> DataFrame:
    """Feature row for each validated request, with the training feature names.

    Without fitted models the reference's serving rules apply: static peak months / indices and
    fiscal-year index (year - fy_min) / span.  Passing the fitted SeasonalIndexModel and
    FiscalYearTrendModel serves the same lookups the model was trained with.
    """
    d = F.col("submit_dt")
    m = F.month(d)
    q = F.quarter(d)
    fy = F.year(d) + (m >= 10).cast("int")
    out = valid_req.withColumnRenamed("office_code", "office_key").withColumns({
        "fiscal_year": fy, "submit_year": F.year(d), "submit_month": m, "submit_quarter": q,
        "submit_day_of_week": F.weekday(d), "submit_day_of_year": F.dayofyear(d),
        "case_number": F.col("case_no").cast("double"),
    })
    if seasonal_model is not None:
        out = seasonal_model.transform(out)
    else:
        peak = m.isin(*PEAK_MONTHS)
        out = out.withColumns({
            "is_peak_season": peak.cast("int"),
            "seasonal_index_month": F.when(peak, F.lit(STATIC_MONTH_INDEX[0])).otherwise(F.lit(STATIC_MONTH_INDEX[1])),
            "seasonal_index_quarter": F.when(q.isin(1, 4), F.lit(STATIC_QUARTER_INDEX[0]))
                                       .otherwise(F.lit(STATIC_QUARTER_INDEX[1])),
        })
    if fy_model is not None:
        out = fy_model.transform(out)
    else:
        span = F.greatest(F.lit(fy_max) - F.lit(fy_min), F.lit(1))
        out = out.withColumn("fiscal_year_index", (F.col("fiscal_year") - F.lit(fy_min)).cast("double") / span)
    out = cyclical_encoding(out, "submit")
    out = join_fallback_global(out, "office_key", office_stats, "office", global_row)
    if codes is not None:
        out = encode_apply_default(out, "office_key", codes, "office_code", 0)
    # A month or quarter that training never saw is an average one; what else is missing takes the
    # fill value of training.
    out = out.fillna(1.0, subset=["seasonal_index_month", "seasonal_index_quarter"])
    known = {c: v for c, v in (fills or {}).items() if c in out.columns}
    return out.fillna(known) if known else out


def score_requests(requests: DataFrame, model: PipelineModel, office_stats: DataFrame, global_row: DataFrame | None,
                   codes: DataFrame | None, rmse: float, model_name: str, mae: float, r2: float, features,
                   fy_min=None, fy_max=None, seasonal_model=None, fy_model=None, fills: dict | None = None,
                   labels: DataFrame | None = None, prediction_col: str = "prediction",
                   validated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate, build features, predict, add interval / category / office profile and label.

    ``labels`` (code, label) names offices; an office without a label is its own code.  ``validated`` is
    ``validate_requests(requests)`` where the caller has kept it.

    Returns (scored valid requests, quarantined requests with their error map).
    """
    ok, bad = split_valid(validated if validated is not None else validate_requests(requests))
    feats = request_features(ok, office_stats, global_row, codes, fy_min, fy_max, seasonal_model, fy_model, fills)
    if labels is not None:
        feats = map_lookup(feats, "office_key", labels, "code", "label", "office_label")
    else:
        feats = feats.withColumn("office_label", F.col("office_key"))
    pred = model.transform(feats)
    p = F.greatest(F.col(prediction_col), F.lit(0.0))
    iv = prediction_interval(prediction_col, rmse)
    cat = speed_category(p, "office_mean_days", "office_std_days")
    prof = F.struct(
        F.bround(F.col("office_mean_days"), 1).alias("mean_processing_days"),
        F.bround(F.col("office_median_days"), 1).alias("median_processing_days"),
        F.bround(F.col("office_std_days"), 1).alias("std_processing_days"),
        F.col("office_volume").cast("int").alias("total_cases"),
        F.bround(F.col("office_approval_rate") * 100, 1).alias("approval_rate_pct"),
        F.bround(F.col("office_ap_rate") * 100, 1).alias("ap_rate_pct"),
        F.bround(F.col("office_refusal_rate") * 100, 1).alias("refusal_rate_pct"),
        F.bround(F.col("office_221g_rate") * 100, 1).alias("refusal_221g_pct"))
    scored = pred.select(
        *requests.columns,
        *[e.alias(k) for k, e in iv.items()], *[e.alias(k) for k, e in cat.items()],
        "office_key", "office_label", "office_known", prof.alias("office_stats"),
        F.date_format("submit_dt", "yyyy-MM-dd").alias("submit_date_iso"),
        F.lit(model_name).alias("model_name"), F.bround(F.lit(float(mae)), 1).alias("model_mae_days"),
        F.bround(F.lit(float(r2)), 4).alias("model_r2"), (F.col("is_peak_season") == 1).alias("is_peak_season"),
        F.array(*[F.lit(f) for f in features]).alias("features_used"))
    return scored, bad


def save_scoring_bundle(path: str, model: PipelineModel, office_codes: DataFrame, office_stats: DataFrame,
                        global_row: DataFrame, feature_models: dict, meta: dict, fills: dict | None = None,
                        labels: DataFrame | None = None) -> None:
    """Everything serving needs, saved together so scoring never re-fits an encoder:
    the PipelineModel, the office code table, office statistics and global defaults, the fitted
    lookup models (seasonal / fiscal year), the fill values of training, office labels and metadata (rmse,
    mae, r2, model name, features, and which of the other parts there are)."""
    import json
    model.write().overwrite().save(f"{path}/model")
    office_codes.write.mode("overwrite").parquet(f"{path}/office_codes")
    office_stats.write.mode("overwrite").parquet(f"{path}/office_stats")
    global_row.write.mode("overwrite").parquet(f"{path}/global_row")
    for name, m in feature_models.items():
        m.save(f"{path}/features/{name}")
    if labels is not None:
        labels.write.mode("overwrite").parquet(f"{path}/labels")
    meta = {**meta, "feature_models": sorted(feature_models), "fills": fills or {}, "labels": labels is not None}
    spark = office_codes.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_scoring_bundle(spark, path: str) -> dict:
    """Keyword arguments for :func:`score_requests` / ``score_stream`` from a saved bundle."""
    import json
    from .features import FiscalYearTrendModel, SeasonalIndexModel
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    kw = dict(model=PipelineModel.load(f"{path}/model"), codes=spark.read.parquet(f"{path}/office_codes"),
              office_stats=spark.read.parquet(f"{path}/office_stats"), global_row=spark.read.parquet(f"{path}/global_row"),
              rmse=meta["rmse"], model_name=meta["model_name"], mae=meta["mae"], r2=meta["r2"],
              features=meta["features"])
    kw["fills"] = meta["fills"]
    kw["labels"] = spark.read.parquet(f"{path}/labels") if meta["labels"] else None
    # The metadata says which models were saved; a failing read of one is an error, never a reason
    # to serve the static rule instead.
    for name, cls in (("seasonal_model", SeasonalIndexModel), ("fy_model", FiscalYearTrendModel)):
        kw[name] = cls.load(f"{path}/features/{name}") if name in meta["feature_models"] else None
    return kw
