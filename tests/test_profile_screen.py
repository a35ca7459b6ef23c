from pyspark.sql import functions as F

from leadtime.operators import charts, profile


def table(spark, n=3000):
    i = F.col("id")
    return spark.range(n).select(
        i.cast("string").alias("all"), (i % int(n * 0.91)).cast("string").alias("just_over"), (i % int(n * 0.89)).cast("string").alias("just_under"),
        (i % 7).cast("string").alias("few"), F.lit("x").alias("one"), F.when(i < 0, "y").alias("none"), (i - 5).alias("lead_days"))


def test_exact_counts_decide_what_the_sketch_leaves_open(spark):
    df = table(spark)
    got = {r["column"]: (r["distinct"], r["rows"]) for r in profile.quality_high_cardinality(df).collect()}
    assert got == {"all": (3000, 3000), "just_over": (2730, 3000)}
    screen = profile.quality_screen(df, "lead_days")
    assert screen["constant"] == ["one"] and screen["negative"] == 5 and screen["rows"] == 3000
    # columns far below the limit are settled by the sketch alone
    limit = 0.9 * 3000
    open_columns = [c for c, n in screen["distinct"].items() if n * (1 + profile.SKETCH_MARGIN * profile.SKETCH_ERROR) >= limit]
    assert set(open_columns) == {"all", "just_over", "just_under"}


def test_report_rows(spark):
    df = table(spark, 1000)
    rows = sorted((r["check"], r["value"], r["message"]) for r in profile.quality_report(df.unionByName(df.limit(3)), "lead_days").collect())
    assert [r[:2] for r in rows] == [("constant_column", "one"), ("duplicates", "3"), ("high_cardinality", "all"), ("high_cardinality", "just_over"),
                                     ("negative_target", rows[-1][1])]
    assert rows[1][2] == "3 duplicate rows (0.30%)" and rows[0][2] == "column one has a single value"
    assert profile.quality_report(df.where("false"), "lead_days").count() == 0


def test_raw_columns(spark):
    rows = profile.profile_raw_columns(table(spark, 50), "lead_days", 10).collect()
    assert [(r["position"], r["column"], r["type"], r["filled"]) for r in rows][-2:] == [(6, "none", "string", 0), (7, "lead_days", "bigint", 10)]


def test_histograms_and_binned_density(spark):
    df = spark.range(4000).select((F.rand(1) * 10).alias("x"), F.lit(2.0).alias("flat"), F.lit(float("nan")).alias("nan"), (F.col("id") % 2).alias("g"))
    got = charts.column_histograms(df, ["x", "flat", "nan"], 10).collect()
    assert sum(r["count"] for r in got if r["column"] == "x") == 4000 and len([r for r in got if r["column"] == "x"]) == 10
    assert [(r["bin"], r["count"]) for r in got if r["column"] == "flat"] == [(1, 4000)] and not [r for r in got if r["column"] == "nan"]
    exact = {r["i"]: r["density"] for r in charts.kde_curve(df, "x", 50).collect()}
    binned = {r["i"]: r["density"] for r in charts.kde_binned(df, "x", 50, 256).collect()}
    lo, hi, n, sd = df.agg(F.min("x"), F.max("x"), F.count("x"), F.stddev_samp("x")).first()
    h, d = sd * n ** -0.2, (hi - lo) / 255
    assert max(abs(exact[i] - binned[i]) for i in exact) <= d * d / (20 * h**3) and len(binned) == 50
    groups = charts.kde_binned(df, "x", 20, 128, "g").groupBy("g").count().collect()
    assert sorted(tuple(r) for r in groups) == [(0, 20), (1, 20)]
    assert charts.kde_binned(df, "flat").count() == 0
