"""Historical-aggregate features as Spark ML Estimator/Model pairs (fit on train, apply anywhere).

Each model holds small lookup DataFrames (one row per month, quarter, office or year) and
applies them with left equi-joins; Spark broadcasts them when the runtime size check allows.
Estimators carry their settings as Params and save and load as other stages do, so a Pipeline can hold
them and refits them wherever it is fitted: on one side of a split, or in every fold.
:func:`engineer_features` without ``fit_on`` fits on all rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import cyclical_encoding
from ..functions.flags import PEAK_INDEX_THRESHOLD, complexity_score, deviation_from_office, peak_season_flag
from ..operators import aggregates as agg
from ..operators.encode import apply_codes, label_codes
from ..operators.quantiles import quantiles
from ..operators.stats import nan_to_null, scalars
from ..roles import ROLES, CaseRoles
from ..session import cut_lineage


class _HasRoles(Params):
    """The names of the columns, as JSON text."""

    rolesJson = Param(Params._dummy(), "rolesJson", "column names of the case table", TypeConverters.toString)

    @property
    def roles(self) -> CaseRoles:
        return CaseRoles(**json.loads(self.getOrDefault("rolesJson")))

    def _with_roles(self, roles: CaseRoles):
        return self._set(rolesJson=json.dumps(asdict(roles)))


class _Stage(Estimator, _HasRoles, DefaultParamsWritable, DefaultParamsReadable):
    """An estimator whose settings are all Params."""


class _LookupModel(Model, MLWritable, MLReadable):
    """Model whose state is a dict of small DataFrames plus JSON-able settings.

    Fitting is eager, as for Spark ML estimators: each lookup table (one row per month, quarter,
    year or office) is computed once and checkpointed into the shared checkpoint folder, so
    every later job reads the small table instead of re-aggregating the training rows.
    """

    def __init__(self, tables: dict | None = None, settings: dict | None = None, materialize: bool = True):
        super().__init__()
        self.tables = {k: (cut_lineage(v) if materialize else v) for k, v in (tables or {}).items()}
        self.settings = settings or {}

    def save(self, path: str) -> None:
        self.write().overwrite().save(path)

    def write(self) -> MLWriter:
        return _LookupWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LookupReader(cls)

    @classmethod
    def load(cls, *where):
        """From a path; a session before it is accepted and not needed."""
        return cls.read().load(where[-1])


class _LookupWriter(MLWriter):
    def __init__(self, model: _LookupModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, SparkSession.getActiveSession(), {"settings": m.settings, "tables": list(m.tables)})
        for name, t in m.tables.items():
            t.write.parquet(f"{path}/tables/{name}")


class _LookupReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _LookupModel:
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in meta["tables"]}
        model = self.cls(tables, meta["settings"], materialize=False)
        model._resetUid(meta["uid"])
        return model


class SeasonalIndexModel(_LookupModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.settings
        out = df
        if s["month"] in df.columns:
            out = out.join(self.tables["month"], s["month"], "left")
            out = out.withColumn("is_peak_season", peak_season_flag("seasonal_index_month", s["threshold"]))
        if s["quarter"] in df.columns:
            out = out.join(self.tables["quarter"], s["quarter"], "left")
        return out


class SeasonalIndex(_Stage):
    """seasonal_index_month/quarter = group mean target / global mean; peak flag = index > 1.1."""

    peakThreshold = Param(Params._dummy(), "peakThreshold", "index above which a month is peak season", TypeConverters.toFloat)

    def __init__(self, roles: CaseRoles = ROLES, threshold: float = PEAK_INDEX_THRESHOLD):
        super().__init__()
        self._with_roles(roles)._set(peakThreshold=threshold)

    @property
    def threshold(self) -> float:
        return self.getOrDefault("peakThreshold")

    def _fit(self, df: DataFrame) -> SeasonalIndexModel:
        """Month means, quarter means and the global mean in ONE aggregation (grouping sets:
        one scan of the training rows), materialised as one table of at most 17 rows."""
        r = self.roles
        keys = [k for k in (r.month, r.quarter) if k in df.columns]
        if not keys:
            return SeasonalIndexModel({}, {"month": r.month, "quarter": r.quarter, "threshold": self.threshold})
        t = F.col(r.target).cast("double")
        sets = [[k] for k in keys] + [[]]
        g = df.groupingSets(sets, *keys).agg(F.avg(t).alias("_mean"), F.grouping_id().alias("_gid"))
        g = cut_lineage(g, "seasonal")
        full = (1 << len(keys)) - 1                       # grouping id of the global () set
        glob = g.filter(F.col("_gid") == full).select("_mean").scalar()
        tables = {}
        for i, k in enumerate(keys):
            gid = full ^ (1 << (len(keys) - 1 - i))       # only key k grouped
            name = "month" if k == r.month else "quarter"
            tables[name] = (g.filter((F.col("_gid") == gid) & F.col(k).isNotNull())
                             .select(k, (F.col("_mean") / glob).alias(f"seasonal_index_{name}")))
        return SeasonalIndexModel(tables, {"month": r.month, "quarter": r.quarter, "threshold": self.threshold},
                                  materialize=False)


class OfficeStatsModel(_LookupModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.settings
        if s["office"] not in df.columns:
            return df
        out = df.join(self.tables["office"], s["office"], "left")
        if s["target"] in df.columns:
            out = out.withColumn("deviation_from_office", deviation_from_office(s["target"], "office_mean_days"))
        return out


class OfficeStats(_Stage):
    """Per-office mean/median/std/volume and outcome rates, low-volume offices floored."""

    minSamples = Param(Params._dummy(), "minSamples", "least cases of an office with its own figures", TypeConverters.toInt)
    exactMedian = Param(Params._dummy(), "exactMedian", "exact medians instead of sketches", TypeConverters.toBoolean)

    def __init__(self, roles: CaseRoles = ROLES, min_samples: int = 30, exact: bool = True):
        super().__init__()
        self._with_roles(roles)._set(minSamples=min_samples, exactMedian=exact)

    def _fit(self, df: DataFrame) -> OfficeStatsModel:
        stats = agg.office_stats_floored(agg.office_stats(df, self.roles, exact=self.getOrDefault("exactMedian")),
                                         self.getOrDefault("minSamples"))
        return OfficeStatsModel({"office": stats}, {"office": self.roles.office, "target": self.roles.target})


class FiscalYearTrendModel(_LookupModel):
    """A year that training had gets its index; any other lies on the line through the first and last."""

    def _transform(self, df: DataFrame) -> DataFrame:
        fy = self.settings["fiscal_year"]
        if fy not in df.columns:
            return df
        year = self.tables["year"]
        lo, hi = scalars(year.agg(F.min(fy).alias("lo"), F.max(fy).alias("hi")), "lo", "hi")
        line = (F.col(fy) - lo).cast("double") / F.greatest(hi - lo, F.lit(1))
        return df.join(year, fy, "left").withColumn("fiscal_year_index", F.coalesce("fiscal_year_index", line))


class FiscalYearTrend(_Stage):
    def __init__(self, roles: CaseRoles = ROLES):
        super().__init__()
        self._with_roles(roles)

    def _fit(self, df: DataFrame) -> FiscalYearTrendModel:
        return FiscalYearTrendModel({"year": agg.fiscal_year_trend(df, self.roles)},
                                    {"fiscal_year": self.roles.fiscal_year})


class RowFeatures(Transformer, _HasRoles, DefaultParamsWritable, DefaultParamsReadable):
    """Features of a row alone: complexity and the cyclical calendar parts."""

    def __init__(self, roles: CaseRoles = ROLES):
        super().__init__()
        self._with_roles(roles)

    def _transform(self, df: DataFrame) -> DataFrame:
        return cyclical_encoding(complexity_score(df), self.roles.calendar_prefix)


class CaseMatrixModel(_LookupModel):
    """Columns key, label (if the target is there) and the features, without nulls; an office that training lacked has
    code 0."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.settings
        out = nan_to_null(df)
        if "codes" in self.tables:
            out = apply_codes(out, s["office"], self.tables["codes"], "office_code", default=0)
        label = [F.col(s["target"]).cast("double").alias("label")] if s["target"] in out.columns else []
        out = out.select(s["key"], *label, *[F.col(c).cast("double").alias(c) for c in s["features"]])
        return out.fillna(s["fills"]) if s["fills"] else out


class CaseMatrix(_Stage):
    """Office codes and median fills, learned where the pipeline is fitted."""

    keyCol = Param(Params._dummy(), "keyCol", "row key that is kept", TypeConverters.toString)
    featureCols = Param(Params._dummy(), "featureCols", "features in order", TypeConverters.toListString)

    def __init__(self, key: str = "case_id", features=("office_code",), roles: CaseRoles = ROLES):
        super().__init__()
        self._with_roles(roles)._set(keyCol=key, featureCols=list(features))

    def _fit(self, df: DataFrame) -> CaseMatrixModel:
        r, feats = self.roles, self.getOrDefault("featureCols")
        tables = {"codes": label_codes(df, r.office)} if "office_code" in feats else {}
        model = CaseMatrixModel(tables, {"key": self.getOrDefault("keyCol"), "target": r.target, "office": r.office, "features": feats, "fills": {}})
        # The median of every feature: a held-out row may lack what no training row lacks.
        medians = quantiles(model.transform(df), {c: F.col(f"`{c}`") for c in feats}, (0.5,)).collect()  # one row a feature
        model.settings["fills"] = {m["column"]: m["q"][0] for m in medians}
        return model


def case_stages(features, key: str = "case_id", roles: CaseRoles = ROLES, min_samples: int = 30) -> list:
    """Stages from valid cases to a feature matrix; a learner's stages may follow."""
    return [SeasonalIndex(roles), OfficeStats(roles, min_samples), FiscalYearTrend(roles), RowFeatures(roles),
            CaseMatrix(key, features, roles)]


def engineer_features(df: DataFrame, roles: CaseRoles = ROLES, fit_on: DataFrame | None = None,
                      min_samples: int = 30, exact: bool = True) -> tuple[DataFrame, list]:
    """Seasonal -> office -> fiscal year -> complexity -> cyclical, fitted on ``fit_on``
    (defaults to ``df`` itself, the reference's fit-on-all behaviour)."""
    base = fit_on if fit_on is not None else df
    models = [SeasonalIndex(roles).fit(base), OfficeStats(roles, min_samples, exact).fit(base),
              FiscalYearTrend(roles).fit(base)]
    out = df
    for m in models:
        out = m.transform(out)
    out = complexity_score(out)
    out = cyclical_encoding(out, roles.calendar_prefix)
    return out, models
