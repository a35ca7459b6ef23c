"""Benchmark of the headline plans at one scale.

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default /root/testdata/sf0.1) and prints ONE JSON
line: {"metric", "value" (sum of warm seconds), "unit", "queries" (warm seconds per query: best
of two runs after the first), "cold" (first-run seconds), "sf", "cpus", "rows", "conf"}.

Like the reference pipeline, preparation ends at a disk boundary: ``prepare`` reads the driver
tables, writes the processed table and the valid-case table as parquet (shared scratch folder),
and the later stages read the valid-case table.  Every other stage is forced to completion with
a write to the no-op sink (every row and column computed, nothing collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leadtime.session import get_session, remove_scratch  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="leadtime-bench")

    from leadtime.operators import aggregates as agg
    from leadtime.operators import correlation as CR
    from leadtime.operators import profile as P
    from leadtime.operators.charts import histogram, kde_curve
    from leadtime.plans import models as M
    from leadtime.plans.features import engineer_features
    from leadtime.plans.metrics import train_test_split
    from leadtime.plans.prepare import process_valid, valid_cases
    from leadtime.roles import cases, petitions

    from leadtime.session import scratch_path
    tag = re.sub(r"[^0-9a-z.]", "", sf_dir.rstrip("/").split("/")[-1])
    processed_path = scratch_path(spark, f"bench-processed-{tag}")
    valid_path = scratch_path(spark, f"bench-valid-{tag}")

    def valid():
        return spark.read.parquet(valid_path)

    def q_prepare():
        valid_cases(cases(spark, sf_dir)).write.mode("overwrite").parquet(valid_path)
        process_valid(valid()).write.mode("overwrite").parquet(processed_path)

    def q_office_stats():
        v = valid()
        _run(agg.office_stats_floored(agg.office_stats(v), 30))
        _run(agg.top_office_median(v, top_n=20))

    def q_features():
        v = valid()
        tr, _ = train_test_split(v, "case_id")
        eng, _ = engineer_features(v, fit_on=tr)
        _run(eng)

    def q_patterns():
        v = valid()
        for df in (agg.monthly_pattern(v), agg.day_of_week_pattern(v), agg.fiscal_year_pattern(v),
                   agg.distribution_summary(v, "lead_days"), histogram(v, "lead_days", 60),
                   kde_curve(v, "lead_days", 200), agg.region_stats(v)):
            _run(df)

    def q_profile():
        v = valid()
        _run(P.missing_by_column(v))
        _run(P.numeric_describe(v.select("quantity", "amount", "discount", "lead_days", "submit_month")))
        _run(P.categorical_top5(v.select("case_id", "office", "region", "status", "priority")))

    def q_corr():
        v = valid().select("lead_days", "quantity", "amount", "discount", "order_total", "submit_month",
                           "submit_day_of_week", "submit_day_of_year", "case_number", "is_ap", "is_refused")
        _run(CR.corr_matrix(v, "lead_days", 25))

    def q_employer_counts():
        _run(agg.key_counts(petitions(spark, sf_dir), "employer"))

    def q_quality():
        _run(P.quality_report(valid(), "lead_days"))

    def q_train():
        v = valid()
        tr_v, _ = train_test_split(v, "case_id")
        eng, _ = engineer_features(v, fit_on=tr_v)
        fm = M.feature_matrix(eng, "case_id", features=M.FEATURES)
        data = fm.data.cache()
        tr, te = train_test_split(data, "case_id")
        specs = (M.ModelSpec("linear", "linear", {}, True),
                 M.ModelSpec("gradient_boosting", "gbt", {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5}))
        met, _, _ = M.compare_models(tr, te, fm.features, "case_id", specs)
        _run(met)
        data.unpersist()

    plan = [("prepare", q_prepare), ("office_stats", q_office_stats), ("features", q_features),
            ("patterns", q_patterns), ("profile", q_profile), ("quality", q_quality),
            ("corr_matrix", q_corr), ("employer_counts", q_employer_counts), ("train", q_train)]
    cold, warm = {}, {}
    for name, fn in plan:
        t0 = time.time()
        fn()
        cold[name] = round(time.time() - t0, 3)
        runs = []
        for _ in range(2):
            t0 = time.time()
            fn()
            runs.append(time.time() - t0)
        warm[name] = round(min(runs), 3)
    rows = {"cases": cases(spark, sf_dir).count(), "valid_cases": valid().count(),
            "processed_cases": spark.read.parquet(processed_path).count()}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    conf = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
                                           "spark.driver.memory")}
    print(json.dumps({"metric": "leadtime_headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "rows": rows,
                      "warm_rule": "best of 2 runs after a cold run", "conf": conf}))
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
