"""Tables behind the distribution charts: histogram, KDE, box statistics (§2.5).

Bin and grid domains have a fixed size (n bins, g grid points) and are broadcast; everything
that grows with the data is aggregated with map-side combining.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import column_quantiles, quantiles
from .stats import one_pass, percentile, scalars

QUARTILES = (0.25, 0.5, 0.75)


def bin_index(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin 1..n over [lo, hi]; the maximum falls in bin n; lo = hi -> bin 1."""
    raw = F.floor(F.try_divide((x - lo) * F.lit(float(n)), hi - lo)).cast("long") + F.lit(1)
    return F.when(hi == lo, F.lit(1).cast("long")).otherwise(F.least(raw, F.lit(n).cast("long")))


def histogram(df: DataFrame, col: str, bins: int = 60) -> DataFrame:
    """(bin, lo, hi, count) for all n bins, empty bins included with count 0."""
    x = F.col(col).cast("double")
    mm = one_pass(df, {"lo": F.min(x), "hi": F.max(x)})
    lo, hi = scalars(mm, "lo", "hi")
    counts = (df.filter(x.isNotNull()).select(bin_index(x, lo, hi, bins).alias("bin"))
                .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    dom = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    w = (hi - lo) / F.lit(float(bins))
    return (dom.join(counts, "bin", "left")
               .select("bin", (lo + (F.col("bin") - 1) * w).alias("bin_lo"), (lo + F.col("bin") * w).alias("bin_hi"),
                       F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def kde_curve(df: DataFrame, col: str, grid: int = 200, key: str | None = None) -> DataFrame:
    """Gaussian KDE on ``grid`` points over [min, max] (per group when ``key`` is given).

    Bandwidth (Scott) h = std_samp * n^(-1/5).  Distinct values are counted first (day values
    collapse to a few thousand), then each (value, count) spreads over the grid by a generator
    and is summed with partial aggregation; no pairwise join of rows.
    """
    keys = [key] if key else []
    x = F.col(col).cast("double")
    base = df.filter(x.isNotNull()).select(*keys, x.alias("x"))
    st = base.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"),
                                 F.stddev_samp("x").alias("sd"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    vc = base.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("w"))
    if keys:
        j = vc.join(st, keys, "inner")
    else:
        j = vc.select("x", "w", *[v.alias(c) for c, v in zip(("lo", "hi", "n", "h"), scalars(st, "lo", "hi", "n", "h"))])
    g = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i")
    pts = j.select(*keys, "x", "w", "lo", "hi", "n", "h", g)
    gx = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(grid - 1))
    z = (gx - F.col("x")) / F.col("h")
    contrib = F.col("w") * F.exp(F.lit(-0.5) * z * z)
    dens = (pts.groupBy(*keys, "i").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"),
                                        F.first("h").alias("h"), F.sum(contrib).alias("_s")))
    return dens.select(*keys, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(grid - 1))).alias("x"),
                       (F.col("_s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def kde_binned(df: DataFrame, col: str, grid: int = 200, bins: int = 1024, key: str | None = None) -> DataFrame:
    """``kde_curve`` of a continuous column: each value is split over the two nearest of ``bins`` equally spaced points,
    in proportion to its nearness, and the points are smoothed.

    One aggregate over the rows, then bins x grid rows a group whatever the data.  With d the distance of two
    points and h the bandwidth, a density is off by d^2 / (20 h^3) at most (the kernel's curvature is at
    most 0.4 / h^3, and splitting a value moves its share by d^2 / 8 times that).  Null keys and values are left out;
    a group of one value only has no curve.
    """
    keys = [key] if key else []
    x = F.col(col).cast("double")
    base = df.filter(x.isNotNull() & (F.col(key).isNotNull() if key else F.lit(True))).select(*keys, x.alias("x"))
    st = base.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"),
                                 F.stddev_samp("x").alias("sd")).filter("hi > lo")
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    if keys:
        j = base.join(st, keys)
    else:
        j = base.select("x", *[v.alias(c) for c, v in zip(("lo", "hi", "n", "h"), scalars(st, "lo", "hi", "n", "h"))]).filter("lo is not null")
    at = (F.col("x") - F.col("lo")) * F.lit(float(bins - 1)) / (F.col("hi") - F.col("lo"))
    first = F.least(F.floor(at), F.lit(bins - 2)).cast("int")
    near = j.select(*keys, first.alias("b"), (at - first).alias("f")).groupBy(*keys, "b").agg(
        F.sum(F.lit(1.0) - F.col("f")).alias("w0"), F.sum("f").alias("w1"))
    points = near.select(*keys, F.explode(F.array(F.struct(F.col("b"), F.col("w0").alias("w")),
                                                  F.struct((F.col("b") + 1).alias("b"), F.col("w1").alias("w")))).alias("p")) \
                 .groupBy(*keys, F.col("p.b").alias("b")).agg(F.sum("p.w").alias("w"))
    full = points.join(st, keys) if keys else points.crossJoin(F.broadcast(st))  # st is one row
    step = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i")
    pts = full.select(*keys, "b", "w", "lo", "hi", "n", "h", step)
    width = F.col("hi") - F.col("lo")
    gx = F.col("lo") + width * F.col("i") / F.lit(float(grid - 1))
    z = (gx - (F.col("lo") + width * F.col("b") / F.lit(float(bins - 1)))) / F.col("h")
    total = pts.groupBy(*keys, "i", gx.alias("x"), "n", "h").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("s"))
    return total.select(*keys, "i", "x", (F.col("s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def box_stats(df: DataFrame, col: str, whisker: float = 1.5, exact: bool = True) -> DataFrame:
    """q1, median, q3, whiskers (most extreme values inside 1.5 IQR) and outlier count."""
    x = F.col(col).cast("double")
    q = column_quantiles(df, {"_q": x}, QUARTILES) if exact else \
        one_pass(df, {"_q": percentile(x, F.array(*[F.lit(p) for p in QUARTILES]), exact)})
    q = q.select(F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q1, med, q3 = scalars(q, "q1", "median", "q3")
    lo_f, hi_f = q1 - F.lit(whisker) * (q3 - q1), q3 + F.lit(whisker) * (q3 - q1)
    return df.filter(x.isNotNull()).agg(
        q1.alias("q1"), med.alias("median"), q3.alias("q3"),
        F.min(F.when(x >= lo_f, x)).alias("whisker_lo"), F.max(F.when(x <= hi_f, x)).alias("whisker_hi"),
        F.count_if((x < lo_f) | (x > hi_f)).alias("outliers"), F.count(x).alias("n"))


def box_stats_by_group(df: DataFrame, key: str, col: str, whisker: float = 1.5, exact: bool = True) -> DataFrame:
    """Box statistics per group; groups ordered by median desc.  Quartiles per group (one row each) are joined
    back by key (broadcast by the runtime size check when small)."""
    x = F.col(col).cast("double")
    base = df.filter(x.isNotNull() & F.col(key).isNotNull())
    q = quantiles(base, {"_q": x}, QUARTILES, [key]).withColumnRenamed("q", "_q") if exact else \
        base.groupBy(key).agg(percentile(x, F.array(*[F.lit(p) for p in QUARTILES]), exact).alias("_q"))
    q = q.select(key, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    j = base.select(key, x.alias("_x")).join(q, key)
    lo_f = F.col("q1") - F.lit(whisker) * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + F.lit(whisker) * (F.col("q3") - F.col("q1"))
    return (j.groupBy(key, "q1", "median", "q3").agg(
                F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_lo"),
                F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_hi"),
                F.count_if((F.col("_x") < lo_f) | (F.col("_x") > hi_f)).alias("outliers"),
                F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("median"), key))


def column_histograms(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """(column, bin, lo, hi, count) of the filled bins of each column between its least and greatest value.

    One pass for the ranges (one row), one for the counts: a task counts its rows in a (columns x bins) table
    and sends that, so no row is multiplied.  Null and NaN values are left out.
    """
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    there = [F.when(~F.isnan(e), e) for e in x]
    row = df.agg(*[f(e).alias(f"{n}{i}") for i, e in enumerate(there) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    lo, hi = (np.array([np.nan if row[f"{n}{i}"] is None else row[f"{n}{i}"] for i in range(len(cols))]) for n in ("lo", "hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(cols), bins), np.int64)
        for b in batches:
            for i in range(len(cols)):
                v = b.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                v = v[~np.isnan(v)]
                if not len(v):
                    continue
                at = np.zeros(len(v), np.int64) if hi[i] == lo[i] else np.minimum(
                    np.floor((v - lo[i]) * float(bins) / (hi[i] - lo[i])).astype(np.int64), bins - 1)
                counts[i] += np.bincount(at, minlength=bins)
        i, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k + 1), pa.array(counts[i, k])], ["i", "bin", "count"])

    parts = df.select(*[e.alias(f"c{i}") for i, e in enumerate(x)]).mapInArrow(run, "i int, bin long, count long")
    known = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))
                      for c, a, b in zip(cols, lo, hi, strict=True)])
    out = parts.groupBy("i", "bin").agg(F.sum("count").alias("count")).withColumn("of", F.get(known, F.col("i")))
    return out.select("of.column", "bin", "of.lo", "of.hi", "count")


def numeric_hist_grid(df: DataFrame, target: str = "lead_days", bins: int = 40, max_cols: int | None = None,
                      min_distinct: int = 10) -> DataFrame:
    """Histograms of the numeric columns (target excluded; the first ``max_cols`` of them if given) that have
    more than ``min_distinct`` distinct values and a positive std; long form (column, bin, lo, hi, count)."""
    from .stats import numeric_columns
    cols = [c for c in numeric_columns(df) if c != target]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, bin long, bin_lo double, bin_hi double, count long")
    pre = df.agg(*[F.approx_count_distinct(c).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    ok = [(i, c) for i, c in enumerate(cols) if (pre[f"s{i}"] or 0) > 0]
    sure = {c for i, c in ok if pre[f"a{i}"] > 2 * min_distinct}
    unsure = [(i, c) for i, c in ok if c not in sure]
    if unsure:
        row = df.agg(*[F.size(F.collect_set(c)).alias(f"d{i}") for i, c in unsure]).first()
        sure |= {c for i, c in unsure if row[f"d{i}"] > min_distinct}
    chosen = [c for c in cols if c in sure][:max_cols]
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, bin long, bin_lo double, bin_hi double, count long")
    counts = column_histograms(df, chosen, bins)
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return counts.select("column", "bin", (F.col("lo") + (F.col("bin") - 1) * w).alias("bin_lo"),
                         (F.col("lo") + F.col("bin") * w).alias("bin_hi"), F.col("count").cast("long"))
