import numpy as np
import pytest
from pyspark.sql import functions as F

from leadtime.operators import charts, clean, impute, profile
from leadtime.operators.quantiles import column_quantiles, quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_of_every_size_match_numpy(spark):
    rng = np.random.default_rng(1)
    # one group holds most rows, one value of it a third of them; others hold 1 to 3 rows
    rows = [("hot", float(v)) for v in np.where(rng.random(6000) < 0.33, 7.0, rng.normal(0, 50, 6000))]
    rows += [(f"g{i}", float(rng.integers(0, 9))) for i in range(40) for _ in range(1 + i % 3)] + [(None, 1.5), (None, 2.5), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r["g"]: r for r in quantiles(df, {"x": F.col("x")}, PROBS, ["g"]).collect()}
    want = {}
    for g, x in rows:
        if x is not None:
            want.setdefault(g, []).append(x)
    assert set(got) == set(want) and "nulls" not in got
    for g, xs in want.items():
        assert got[g]["n"] == len(xs)
        assert np.allclose(got[g]["q"], np.quantile(xs, PROBS), rtol=0, atol=1e-9), g


def test_columns_nulls_and_single_values(spark):
    df = spark.createDataFrame([(1.0, None, 5), (float("nan"), None, 5), (3.0, None, 5), (2.0, None, 5)], "a double, b double, c int")
    row = column_quantiles(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, (0.25, 0.5)).first()
    assert row["a"] == [1.5, 2.0] and row["b"] is None and row["c"] == [5.0, 5.0]
    assert column_quantiles(df.where("false"), {"a": F.col("a")}, (0.5,)).first()["a"] is None


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(-0.0,), (0.0,), (1.0,)], "x double")
    assert quantiles(df, {"x": F.col("x")}, (0.5,)).first()["q"] == [0.0]


def test_no_aggregate_holds_a_column(spark):
    """Values are dealt by range; what is left for one task is one row a column."""
    df = spark.range(5000).select((F.rand(3) * 1000).alias("x"), (F.col("id") % 3).alias("k"))
    for out in (profile.numeric_describe(df, ["x"]), charts.box_stats(df, "x"), charts.box_stats_by_group(df, "k", "x"),
                clean.outliers_iqr(df, "x", 1.5), quantiles(df, {"x": F.col("x")}, (0.5,))):
        text = plan_of(out)
        assert "percentile" not in text and "ObjectHashAggregate" not in text


def test_users_agree_with_percentile(spark):
    df = spark.range(4000).select((F.hash("id") % 977 / 7.0).alias("x"), (F.col("id") % 4).alias("k"))
    q1, q2, q3 = df.select(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    d = profile.numeric_describe(df, ["x"]).first()
    assert (d["p25"], d["p50"], d["p75"]) == pytest.approx((q1, q2, q3))
    b = charts.box_stats(df, "x").first()
    assert (b["q1"], b["median"], b["q3"]) == pytest.approx((q1, q2, q3))
    bounds = clean.iqr_bounds(df, "x", 0.5).first()
    assert (bounds["lower"], bounds["upper"]) == pytest.approx((q1 - 0.5 * (q3 - q1), q3 + 0.5 * (q3 - q1)))
    kept = clean.outliers_iqr(df, "x", 0.5).count()
    assert 0 < kept < 4000 and kept == df.where(F.col("x").between(bounds["lower"], bounds["upper"])).count()
    holes = df.withColumn("h", F.when(F.col("k") != 1, F.col("x")))
    assert impute.numeric_fill_values(holes, ["h"])["h"] == pytest.approx(holes.select(F.median("h")).first()[0])
    for r in charts.box_stats_by_group(df, "k", "x").collect():
        assert r["median"] == pytest.approx(df.where(F.col("k") == r["k"]).select(F.median("x")).first()[0])
