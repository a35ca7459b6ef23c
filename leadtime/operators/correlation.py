"""Correlation and regression aggregates (§2.6).

Pearson correlation is pairwise-complete (rows where both values exist); a constant side gives null.  All
pairs of a table come from one pass of blocked cross-products (``moments``); the only driver round-trips are
the column means and the ranking of columns by |corr|, one row per numeric column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash_order
from .moments import correlation, pair_moments
from .stats import numeric_columns

# Engineered features whose correlation with the target is reported.
ENGINEERED_FEATURES = (
    "seasonal_index_month", "seasonal_index_quarter", "is_peak_season", "office_mean_days",
    "office_median_days", "office_std_days", "office_volume", "office_approval_rate",
    "fiscal_year_index", "complexity_score",
)


def pair_corr(df: DataFrame, pairs) -> DataFrame:
    """(row, col, corr) for each (x, y) column pair, null where no two rows have both values."""
    pairs = list(pairs)
    if not pairs:
        return df.sparkSession.createDataFrame([], "row string, col string, corr double")
    return pair_moments(df, pairs).select("row", "col", correlation().alias("corr"))


def by_strength() -> list[Column]:
    """Strongest first; what differs only by rounding goes by name."""
    return [F.desc(F.round(F.abs("corr"), 12)), F.asc("feature")]


def corr_with(df: DataFrame, target: str, cols=None) -> DataFrame:
    """(feature, corr) of every numeric column with the target."""
    cols = cols or numeric_columns(df)
    return pair_corr(df, [(c, target) for c in cols]).select(F.col("row").alias("feature"), "corr")


def corr_with_target_abs(df: DataFrame, target: str = "lead_days", top_n: int = 15) -> DataFrame:
    """|corr| with the target, target itself included (= 1), top-N by value (ties by name)."""
    c = corr_with(df, target).filter(F.col("corr").isNotNull())
    return c.orderBy(*by_strength()).select("feature", F.abs("corr").alias("abs_corr")).limit(top_n)


def corr_with_target_signed(df: DataFrame, target: str = "lead_days", top_n: int = 15) -> DataFrame:
    c = corr_with(df, target).filter((F.col("feature") != target) & F.col("corr").isNotNull())
    return c.orderBy(*by_strength()).limit(top_n)


def top_features(df: DataFrame, target: str, n: int, include_target: bool = False) -> list[str]:
    """Names of the n numeric columns most correlated (|r|) with the target."""
    c = corr_with(df, target).filter(F.col("corr").isNotNull())
    if not include_target:
        c = c.filter(F.col("feature") != target)
    rows = c.orderBy(*by_strength()).limit(n).collect()
    return [r["feature"] for r in rows]


def corr_matrix(df: DataFrame, target: str = "lead_days", max_cols: int | None = None) -> DataFrame:
    """Lower triangle (i > j) of the correlation matrix of all numeric columns, or of the max_cols most
    correlated with the target, after dropping zero-variance columns.  Long form (row, col, corr)."""
    cols = top_features(df, target, max_cols or len(df.columns), include_target=True)
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i)]
    return pair_corr(df, pairs)


def corr_engineered(df: DataFrame, target: str = "lead_days", features=ENGINEERED_FEATURES) -> DataFrame:
    cols = [c for c in features if c in df.columns]
    return corr_with(df, target, cols).orderBy(*by_strength())


def hash_sample(df: DataFrame, key: str, n: int, salt: str = "42") -> DataFrame:
    """n rows with the smallest md5-based order value: deterministic, engine-independent.
    A top-n by key, so at most n rows ever reach the final task."""
    return df.withColumn("_h", hash_order(key, salt)).orderBy("_h", key).limit(n).drop("_h")


def scatter_fit_top_features(df: DataFrame, target: str = "lead_days", top_n: int = 6) -> DataFrame:
    """Per top feature: OLS slope/intercept of target on feature, x-range and rows, over all rows with
    both values, all features in one aggregate.  ``scatter_points`` gives a drawing sample."""
    feats = top_features(df, target, top_n)
    y = F.col(target).cast("double")
    fits = []
    for f in feats:
        x = F.when(y.isNotNull(), F.col(f).cast("double"))
        fits.append(F.struct(F.lit(f).alias("feature"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                             F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.count(x).alias("n")))
    if not fits:
        return df.sparkSession.createDataFrame([], "feature string, slope double, intercept double, x_min double, x_max double, n long")
    return df.agg(F.array(*fits).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def scatter_points(df: DataFrame, key: str, feature: str, target: str = "lead_days", sample_n: int = 3000) -> DataFrame:
    """Points to draw: a hash sample of the rows with both values."""
    return hash_sample(df.filter(F.col(feature).isNotNull() & F.col(target).isNotNull()).select(key, feature, target), key, sample_n)


def scatter_matrix_sample(df: DataFrame, key: str, target: str = "lead_days", top_n: int = 4,
                          sample_n: int = 500) -> DataFrame:
    feats = top_features(df, target, top_n)
    cols = [target] + feats
    base = df.select(key, *cols).dropna(subset=cols)
    return hash_sample(base, key, sample_n)
