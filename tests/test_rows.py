"""Row-level rules on hand-made frames (floor days, flags, validation, intervals)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadtime.functions import dates as D
from leadtime.functions import flags as FL
from leadtime.operators import clean as C


def test_floor_days_rule(spark):
    t = dt.datetime(2024, 1, 10, 12, 0)
    rows = [(t, t - dt.timedelta(hours=12)), (t, t + dt.timedelta(hours=12)), (t, t + dt.timedelta(days=3, hours=23)),
            (None, t)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(D.lead_time_days("a", "b")).collect()]
    assert got == [None, 0, 3, None]      # -12 h floors to -1 -> null


def test_parse_dates_coerce(spark):
    df = spark.createDataFrame([("2024-01-05",), ("01/05/2024",), ("2024-01-05 10:00:00",), ("junk",), (None,)], "s string")
    got = [r[0] for r in df.select(D.parse_dates_coerce("s")).collect()]
    assert got[0] == dt.datetime(2024, 1, 5) and got[1] == dt.datetime(2024, 1, 5)
    assert got[2] == dt.datetime(2024, 1, 5, 10) and got[3] is None and got[4] is None


def test_calendar_and_fiscal_year(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 10, 7),), (dt.datetime(2024, 9, 30),)], "t timestamp_ntz")
    out = D.calendar_features(df, "t").withColumn("fy", D.fiscal_year_of_date("t")).collect()
    assert out[0]["submit_day_of_week"] == 0 and out[0]["fy"] == 2025 and out[1]["fy"] == 2024
    assert out[0]["submit_quarter"] == 4 and out[1]["submit_day_of_year"] == 274


def test_binary_flags_null_to_zero(spark):
    df = spark.createDataFrame([(1.0, None), (None, 0.0), (0.7, 1.0)], "issued double, ap double")
    out = FL.binary_flags(df).collect()
    assert [(r.is_issued, r.is_ap) for r in out] == [(1, 0), (0, 0), (0, 1)]


def test_decode_onehot_dropped_level(spark):
    df = spark.createDataFrame([(False, False), (True, False), (False, True)], "s_N boolean, s_R boolean")
    ref = [r[0] for r in df.select(FL.decode_onehot(df, "s")).collect()]
    fixed = [r[0] for r in df.select(FL.decode_onehot(df, "s", baseline="A")).collect()]
    assert ref == ["N", "N", "R"] and fixed == ["A", "N", "R"]


def test_validate_requests(spark):
    rows = [(" kgl ", "2024-06-15", "1234"), (None, "2024-06-15", None), ("ADD", "not-a-date", "5"),
            ("ADD", "2024-6-5", "0"), ("ADD", "", "abc"), ("ADD", "2024-02-30", "3.7")]
    df = spark.createDataFrame(rows, "office string, submit_date string, case_number string")
    out = C.validate_requests(df).collect()
    assert out[0].errors == {} and out[0].office_code == "KGL" and out[0].case_no == 1234
    assert out[1].errors == {"office": C.ERR_REQUIRED} and out[1].case_no == 1000
    assert out[2].errors == {"submit_date": C.ERR_DATE_FORMAT}
    assert out[3].errors == {"case_number": C.ERR_CASE_NO} and out[3].submit_dt == dt.date(2024, 6, 5)
    assert out[4].errors == {"submit_date": C.ERR_DATE_MISSING, "case_number": C.ERR_CASE_NO}
    assert set(out[5].errors) == {"submit_date", "case_number"}
    ok, bad = C.split_valid(C.validate_requests(df))
    assert ok.count() == 1 and bad.count() == 5


def test_prediction_interval_and_category(spark):
    df = spark.createDataFrame([(-5.0, 100.0, 20.0), (120.0, 100.0, 20.0), (100.0, 100.0, 20.0)], "p double, m double, s double")
    iv = FL.prediction_interval("p", 75.0)
    cat = FL.speed_category(F.greatest("p", F.lit(0.0)), "m", "s")
    out = df.select(*[c.alias(k) for k, c in {**iv, **cat}.items()]).collect()
    assert out[0].predicted_days == 0.0 and out[0].lower_bound == 0.0 and out[0].category == "Fast"
    assert out[1].upper_bound == 195.0 and out[1].category == "Slow" and out[1].category_color == "red"
    assert out[2].category == "Normal" and out[2].predicted_months == round(100 / 30.44, 1)


def test_advice_tags(spark):
    df = spark.createDataFrame([(True, 20.0, 5.0, "Slow"), (False, 1.0, 1.0, "Normal")], "p boolean, a double, r double, c string")
    out = [r[0] for r in df.select(FL.advice_tags("p", "a", "r", "c")).collect()]
    assert out == [["peak_season", "high_ap_rate", "slow"], ["typical"]]


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]] + [(None,)], "x double")
    kept = sorted(r.x for r in C.outliers_iqr(df, "x", 1.5).collect())
    assert kept == [float(x) for x in range(1, 10)]
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert C.outliers_zscore(const, "x", 3.0).count() == 0     # std 0 drops every row


def test_days_independent_of_session_zone(spark):
    t0, t1 = dt.datetime(2024, 3, 9, 12), dt.datetime(2024, 3, 10, 11, 30)     # crosses a US DST change
    df = spark.createDataFrame([(t0, t1)], "a timestamp_ntz, b timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert df.select(D.lead_time_days("a", "b")).first()[0] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dates_with_fractions_zones_and_single_digits(spark):
    texts = ["2020-01-05 10:11:12.123456", "2020-01-05T10:11:12Z", "2020-01-05T12:11:12+02:00", "1/5/2020", "2020-1-5", "05-Jan-20", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) for r in df.select(D.parse_dates_coerce("t")).collect()]
    assert got == ["2020-01-05 10:11:12.123456", "2020-01-05 10:11:12", "2020-01-05 10:11:12", *["2020-01-05 00:00:00"] * 3, "None", "None"]
    assert tuple(D.unparsed_dates(df, ["t"]).first()) == ("t", 7, 1)


def test_nan_flag_is_zero_and_timestamp_is_no_level(spark):
    from leadtime.functions import flags as FL
    from leadtime.roles import ROLES
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "raw double")
    out = FL.binary_flags(df, ROLES.with_(flags={"raw": "is_raw"}))
    assert [r.is_raw for r in out.collect()] == [0, 1, 0]
    hot = spark.sql("SELECT true AS status_N, false AS status_R, timestamp'2020-01-01' AS status_ts")
    assert hot.select(FL.decode_onehot(hot, "status").alias("s")).first().s == "N"


def test_too_many_levels_and_long_case_numbers(spark):
    from leadtime.operators import clean, encode
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 10 levels"):
        encode.encode_one_hot(df, "c", max_levels=10)
    req = spark.createDataFrame([("A", "2020-01-01", "1" * 19), ("A", "2020-01-01", "-1")], "office string, submit_date string, case_number string")
    assert [len(r.errors) for r in clean.validate_requests(req).collect()] == [0, 1]


def test_missing_counts_nan(spark):
    from leadtime.operators import impute, profile
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,), (None,)], "x double")
    assert profile.missing_by_column(df).first().missing == 2
    assert impute.impute_report(df).first().null_cells == 2
    assert sorted(r.x for r in impute.impute_numeric_median(df).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert profile.numeric_describe(df).first()["max"] == 3.0


def test_outcome_columns_leave_with_the_leakage_list(spark):
    from leadtime.operators.clean import drop_columns_present
    df = spark.sql("SELECT 1 AS x, 'A' AS status, true AS status_N, timestamp'2020-01-01' AS status_ts")
    assert drop_columns_present(df).columns == ["x", "status_ts"]
