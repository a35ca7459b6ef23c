"""Group aggregates over cases (per office, month, quarter, year, status, region ...).

Every aggregate is a hash aggregate with map-side partial aggregation, so a key that holds a
third of all rows costs one partial buffer per task, not one task.  Exact medians keep a
value->count map per group (small for whole-day durations); ``exact=False`` switches to
``percentile_approx`` for continuous values at scale.  Dense domains (months 1..12, weekdays
0..6) are fixed-size ranges joined to the aggregate, so empty slots stay as nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..roles import ROLES, CaseRoles
from .stats import median, one_pass, percentile, scalar, scalars

# Office statistic columns in output order.
OFFICE_STAT_COLS = ("office_mean_days", "office_median_days", "office_std_days", "office_volume",
                    "office_approval_rate", "office_ap_rate", "office_refusal_rate", "office_221g_rate")
# Flag -> office rate column.
OFFICE_RATE_FLAGS = {"is_issued": "office_approval_rate", "is_ap": "office_ap_rate",
                     "is_refused": "office_refusal_rate", "is_refused_221g": "office_221g_rate"}


def _t(roles: CaseRoles):
    return F.col(roles.target).cast("double")


def seasonal_index(df: DataFrame, key: str, roles: CaseRoles = ROLES, name: str | None = None) -> DataFrame:
    """Group mean of the target / global mean over rows (not the mean of group means)."""
    name = name or f"seasonal_index_{key.split('_')[-1]}"
    glob = scalar(one_pass(df, {"g": F.avg(_t(roles))}), "g")
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.avg(_t(roles)).alias("_m"))
              .select(key, (F.col("_m") / glob).alias(name)))


def office_stats(df: DataFrame, roles: CaseRoles = ROLES, office: str | None = None,
                 exact: bool = True) -> DataFrame:
    """Per office: mean, median, sample std and count of the target; mean of each rate flag."""
    office = office or roles.office
    t = _t(roles)
    aggs = [F.avg(t).alias("office_mean_days"), median(t, exact).alias("office_median_days"),
            F.stddev_samp(t).alias("office_std_days"), F.count(t).alias("office_volume")]
    aggs += [F.avg(F.col(f).cast("double")).alias(n) for f, n in OFFICE_RATE_FLAGS.items() if f in df.columns]
    return df.filter(F.col(office).isNotNull()).groupBy(office).agg(*aggs)


def office_stats_floored(stats: DataFrame, min_samples: int = 30) -> DataFrame:
    """Offices with volume < min_samples take the median over offices of mean/median/std.

    The medians are over the (already aggregated) office table, computed once as scalar
    subqueries; std nulls (one-row offices) are skipped by the median.
    """
    cols = ("office_mean_days", "office_median_days", "office_std_days")
    meds = one_pass(stats, {c: F.median(c) for c in cols})
    low = F.col("office_volume") < F.lit(min_samples)
    return stats.withColumns({c: F.when(low, v).otherwise(F.col(c)) for c, v in zip(cols, scalars(meds, *cols))})


def fiscal_year_trend(df: DataFrame, roles: CaseRoles = ROLES) -> DataFrame:
    """Mean target per fiscal year; index = rank / (n - 1) over sorted years (n = 1 -> 0).

    The window runs over the per-year aggregate (one row per year), never over cases.
    """
    fy = roles.fiscal_year
    per = df.filter(F.col(fy).isNotNull()).groupBy(fy).agg(F.avg(_t(roles)).alias("fiscal_year_mean_days"))
    w = Window.orderBy(fy)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return per.select(fy, "fiscal_year_mean_days",
                      ((F.dense_rank().over(w) - 1) / F.greatest(n - 1, F.lit(1))).cast("double")
                      .alias("fiscal_year_index"))


def key_counts(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Rows per key mapped back to every row (null key -> null count).

    Aggregate + equi-join instead of ``count() over (partition by key)``: the aggregate is
    partially combined map-side, so a hot key never lands in one task; the join side has one
    row per key and is broadcast by the runtime size check when small.
    """
    name = name or f"{key}_count"
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, key, "left")


def distribution_summary(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """count, mean, std, min, P10/25/50/75/90/95/99, max of one column (one pass)."""
    c = F.col(col).cast("double")
    ps = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
    row = one_pass(df, {"count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c),
                        "_p": percentile(c, F.array(*[F.lit(p) for p in ps]), exact), "max": F.max(c)})
    names = ["p10", "p25", "p50", "p75", "p90", "p95", "p99"]
    return row.select("count", "mean", "std", "min", *[F.col("_p")[i].alias(n) for i, n in enumerate(names)], "max")


def skew_kurtosis(df: DataFrame, col: str) -> DataFrame:
    """Population skewness and excess kurtosis (biased moments)."""
    c = F.col(col).cast("double")
    return one_pass(df.filter(c.isNotNull()), {"skewness": F.skewness(c), "kurtosis": F.kurtosis(c)})


def status_distribution(df: DataFrame, status: str = "status") -> DataFrame:
    """Count and share (percent) per level; the share uses a window over the aggregate only."""
    agg = df.filter(F.col(status).isNotNull()).groupBy(status).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return agg.select(status, "count", (F.col("count") * F.lit(100.0) / total).alias("share_pct"))


def median_by(df: DataFrame, key: str, roles: CaseRoles = ROLES, exact: bool = True) -> DataFrame:
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(median(_t(roles), exact).alias("median_days")))


def _dense(spark: SparkSession, key: str, lo: int, hi: int) -> DataFrame:
    return spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(key))


def monthly_pattern(df: DataFrame, roles: CaseRoles = ROLES, exact: bool = True) -> DataFrame:
    """median, mean, count for every month 1..12; months without cases -> nulls."""
    m = roles.month
    agg = df.groupBy(m).agg(median(_t(roles), exact).alias("median_days"), F.avg(_t(roles)).alias("mean_days"),
                            F.count(_t(roles)).alias("count"))
    return _dense(df.sparkSession, m, 1, 12).join(F.broadcast(agg), m, "left")


def quarterly_pattern(df: DataFrame, roles: CaseRoles = ROLES, exact: bool = True) -> DataFrame:
    return median_by(df, roles.quarter, roles, exact)


def day_of_week_pattern(df: DataFrame, roles: CaseRoles = ROLES, exact: bool = True) -> DataFrame:
    """median for days 0..6 (Mon=0); days without cases -> null."""
    d = roles.day_of_week
    agg = median_by(df, d, roles, exact)
    return _dense(df.sparkSession, d, 0, 6).join(F.broadcast(agg), d, "left")


def fiscal_year_pattern(df: DataFrame, roles: CaseRoles = ROLES, exact: bool = True) -> DataFrame:
    fy = roles.fiscal_year
    return (df.filter(F.col(fy).isNotNull()).groupBy(fy)
              .agg(median(_t(roles), exact).alias("median_days"), F.count(F.lit(1)).alias("count"))
              .orderBy(fy))


def top_office_volume(df: DataFrame, roles: CaseRoles = ROLES, top_n: int = 20, office: str | None = None) -> DataFrame:
    """Top-N offices by row count (ties broken by office key)."""
    office = office or roles.office
    return (df.filter(F.col(office).isNotNull()).groupBy(office).agg(F.count(F.lit(1)).alias("volume"))
              .orderBy(F.desc("volume"), F.asc(office)).limit(top_n))


def top_office_median(df: DataFrame, roles: CaseRoles = ROLES, top_n: int = 20, office: str | None = None,
                      exact: bool = True) -> DataFrame:
    """Median target of the top-N offices by volume, sorted by median desc.

    The top-N list has at most N rows (a proven bound), so it is broadcast into a semi join.
    """
    office = office or roles.office
    top = top_office_volume(df, roles, top_n, office).select(office)
    sub = df.join(F.broadcast(top), office, "left_semi")
    return (sub.groupBy(office).agg(median(_t(roles), exact).alias("median_days"),
                                    F.count(F.lit(1)).alias("volume"))
               .orderBy(F.desc("median_days"), F.asc(office)))


def region_stats(df: DataFrame, region: str = "region", roles: CaseRoles = ROLES, exact: bool = True) -> DataFrame:
    t = _t(roles)
    return (df.filter(F.col(region).isNotNull()).groupBy(region)
              .agg(F.avg(t).alias("mean_days"), median(t, exact).alias("median_days"), F.count(t).alias("count"))
              .orderBy(F.desc("median_days"), F.asc(region)))


def ap_rate_top(df: DataFrame, roles: CaseRoles = ROLES, flag: str = "is_ap", min_count: int = 50,
                top_n: int = 15) -> DataFrame:
    """Mean of a flag and row count per office, HAVING count >= min_count, top-N by rate."""
    o = roles.office
    return (df.filter(F.col(o).isNotNull()).groupBy(o)
              .agg(F.avg(F.col(flag).cast("double")).alias("ap_rate"), F.count(F.col(flag)).alias("count"))
              .filter(F.col("count") >= min_count)
              .orderBy(F.desc("ap_rate"), F.asc(o)).limit(top_n))


def seasonal_index_bands(engineered: DataFrame, roles: CaseRoles = ROLES,
                         slower: float = 1.05, faster: float = 0.95) -> DataFrame:
    """Per month the (constant) learned index and a slower/faster/average band label."""
    m = roles.month
    agg = engineered.groupBy(m).agg(F.first("seasonal_index_month", ignorenulls=True).alias("seasonal_index_month"))
    band = (F.when(F.col("seasonal_index_month") > slower, F.lit("slower"))
             .when(F.col("seasonal_index_month") < faster, F.lit("faster")).otherwise(F.lit("average")))
    return _dense(engineered.sparkSession, m, 1, 12).join(F.broadcast(agg), m, "left").withColumn("band", band)


def office_approval_vs_mean(df: DataFrame, roles: CaseRoles = ROLES, min_volume: int = 50) -> DataFrame:
    o = roles.office
    return (df.filter(F.col(o).isNotNull()).groupBy(o)
              .agg(F.avg(_t(roles)).alias("mean_days"), F.avg(F.col("is_issued").cast("double")).alias("approval_rate"),
                   F.count(F.lit(1)).alias("volume"))
              .filter(F.col("volume") >= min_volume)
              .withColumn("bubble_size", F.lit(2.0) * F.sqrt(F.col("volume").cast("double"))))


def complexity_vs_lead(df: DataFrame, roles: CaseRoles = ROLES, exact: bool = True) -> DataFrame:
    t = _t(roles)
    return (df.groupBy("complexity_score")
              .agg(F.avg(t).alias("mean_days"), median(t, exact).alias("median_days"), F.count(t).alias("count")))


def petition_summary(df: DataFrame) -> DataFrame:
    """Approval %, denial %, min/max fiscal year of employer petitions."""
    return one_pass(df, {
        "rows": F.count(F.lit(1)),
        "approval_pct": F.avg(F.col("is_approved").cast("double")) * F.lit(100.0),
        "denial_pct": F.avg(F.col("is_denied").cast("double")) * F.lit(100.0),
        "min_fiscal_year": F.min("fiscal_year"),
        "max_fiscal_year": F.max("fiscal_year"),
    })


def global_office_defaults(engineered: DataFrame, roles: CaseRoles = ROLES) -> DataFrame:
    """Row-weighted mean of each office statistic over cases; min/max fiscal year."""
    exprs = {c: F.avg(F.col(c).cast("double")) for c in OFFICE_STAT_COLS if c in engineered.columns}
    exprs["fy_min"] = F.min(roles.fiscal_year)
    exprs["fy_max"] = F.max(roles.fiscal_year)
    return one_pass(engineered, exprs)
