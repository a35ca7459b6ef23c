import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadtime.operators import correlation as C
from leadtime.operators import moments


def frame(spark, x, cols):
    return spark.createDataFrame(pd.DataFrame(x, columns=cols)).select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])


def test_200_columns_match_pandas(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 200)) @ rng.normal(0, 1, (200, 200)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(200)]
    df = frame(spark, x, cols)
    monkeypatch.setattr(moments, "BLOCK", 64)
    pairs = [(cols[i], cols[j]) for i in range(200) for j in range(i)]
    out = C.pair_corr(df, pairs)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = pd.DataFrame(x, columns=cols).corr()
    got = {(r["row"], r["col"]): r["corr"] for r in out.collect()}
    assert len(got) == len(pairs)
    assert max(abs(got[a, b] - want.loc[a, b]) for a, b in pairs) < 1e-9


def test_constant_empty_and_partly_constant_columns(spark):
    n = float("nan")
    x = np.array([[1, 0.1, n, 1, 5], [2, 0.1, n, 2, 5], [3, 0.1, n, 3, n], [4, 0.1, n, n, 7]])
    df = frame(spark, x, list("abcde"))
    got = {r["row"]: r["corr"] for r in C.pair_corr(df, [(c, "a") for c in "abcde"]).collect()}
    assert got["a"] == pytest.approx(1) and got["b"] is None and got["c"] is None and got["d"] == pytest.approx(1)
    only = {r["row"]: r["corr"] for r in C.pair_corr(df, [("e", "d")]).collect()}
    assert only["e"] is None          # e is 5 wherever both are there
    assert C.pair_corr(df, []).count() == 0


def test_strongest_first_ties_by_name(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("lead_days"), (F.col("id") * 2.0).alias("b"), (-F.col("id") * 3.0).alias("a"),
                                F.lit(4.0).alias("flat"))
    assert [r["feature"] for r in C.corr_with_target_abs(df).collect()] == ["a", "b", "lead_days"]
    assert [(r["feature"], round(r["corr"], 9)) for r in C.corr_with_target_signed(df).collect()] == [("a", -1.0), ("b", 1.0)]
    assert C.corr_matrix(df).count() == 3
