"""Registered checks for imputation, encoding and profiling (§2.3, §2.5 quality tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import raw_days
from ..operators import encode as E
from ..operators import impute as I
from ..operators import profile as P
from ..roles import cases
from ..session import cut_lineage
from .registry import petition_table, r, register, valid

# --- input with nulls made by fixed rules over the case table (all rows kept) ---------------


def holes(spark, sf):
    v = valid(spark, sf)
    return v.select(
        "case_id",
        F.when(F.col("submit_day_of_week") == 0, F.lit(None)).otherwise(F.col("office")).alias("office_n"),
        F.when((F.col("is_ap") == 1) & (F.col("submit_month") == 1), F.lit(None)).otherwise(F.col("region")).alias("region_n"),
        F.when(F.col("quantity") < 3, F.lit(None)).otherwise(F.col("case_id")).alias("id_n"),
        F.when(F.col("status") == "R", F.lit(None)).otherwise(F.col("quantity")).alias("quantity_n"),
        F.when(F.col("priority") == "1-URGENT", F.lit(None)).otherwise(F.col("submit_day_of_year")).alias("doy_n"),
    )


HOLES_SQL = """
, holes AS (SELECT case_id,
    CASE WHEN submit_day_of_week = 0 THEN NULL ELSE office END AS office_n,
    CASE WHEN is_ap = 1 AND submit_month = 1 THEN NULL ELSE region END AS region_n,
    CASE WHEN quantity < 3 THEN NULL ELSE case_id END AS id_n,
    CASE WHEN status = 'R' THEN NULL ELSE quantity END AS quantity_n,
    CASE WHEN priority = '1-URGENT' THEN NULL ELSE submit_day_of_year END AS doy_n
  FROM valid)"""


def _mode_sql(col: str) -> str:
    return (f"(SELECT min(v) FROM (SELECT {col} AS v, count(*) AS c FROM holes WHERE {col} IS NOT NULL GROUP BY 1) t "
            f"WHERE c = (SELECT max(c) FROM (SELECT count(*) AS c FROM holes WHERE {col} IS NOT NULL GROUP BY {col}) u))")


@register("impute_categorical", HOLES_SQL + f"""
SELECT case_id, coalesce(office_n, {_mode_sql('office_n')}) AS office_n, coalesce(region_n, {_mode_sql('region_n')}) AS region_n,
       coalesce(id_n, 'Unknown') AS id_n FROM holes""")
def q_impute_cat(spark, sf):
    h = holes(spark, sf).select("case_id", "office_n", "region_n", "id_n")
    return I.impute_categorical(h)


@register("impute_numeric_median", HOLES_SQL + """
SELECT case_id, coalesce(quantity_n, (SELECT quantile_cont(quantity_n, 0.5) FROM holes)) AS quantity_n,
       coalesce(CAST(doy_n AS DOUBLE), (SELECT quantile_cont(CAST(doy_n AS DOUBLE), 0.5) FROM holes)) AS doy_n FROM holes""")
def q_impute_num(spark, sf):
    h = holes(spark, sf).select("case_id", "quantity_n", "doy_n")
    return I.impute_numeric_median(h)


_IMPUTED_SQL = f"""
, imp AS (SELECT case_id, coalesce(office_n, {_mode_sql('office_n')}) AS office_n,
                 coalesce(region_n, {_mode_sql('region_n')}) AS region_n, coalesce(id_n, 'Unknown') AS id_n,
                 coalesce(quantity_n, (SELECT quantile_cont(quantity_n, 0.5) FROM holes)) AS quantity_n,
                 coalesce(CAST(doy_n AS DOUBLE), (SELECT quantile_cont(CAST(doy_n AS DOUBLE), 0.5) FROM holes)) AS doy_n
          FROM holes)"""


def _nulls_sql(t: str) -> str:
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ("case_id", "office_n", "region_n", "id_n",
                                                                      "quantity_n", "doy_n")) + f" FROM {t}"


@register("impute_report", HOLES_SQL + _IMPUTED_SQL + f"""
SELECT (SELECT {_nulls_sql('holes')}) AS null_cells_before, (SELECT {_nulls_sql('imp')}) AS null_cells_after,
       (SELECT count(*) FROM holes) AS rows""")
def q_impute_report(spark, sf):
    h = cut_lineage(holes(spark, sf), "holes")
    before = I.impute_report(h)
    after = I.impute_report(I.impute_missing(h, target="lead_days"))
    return before.select(F.col("null_cells").alias("null_cells_before"), "rows").select(
        "null_cells_before", after.select("null_cells").scalar().alias("null_cells_after"), "rows")


def holes_petitions(spark, sf):
    p = petition_table(spark, sf)
    return p.select(
        "petition_id",
        F.when(F.col("city").isin("1", "2"), F.lit(None)).otherwise(F.col("employer")).alias("employer"),
        F.when(F.col("naics") == "5-LOW", F.lit(None)).otherwise(F.col("state")).alias("state"),
        F.when(F.col("ia") == 1, F.lit(None)).otherwise(F.col("wage")).alias("wage"))


@register("impute_constant", """
, hp AS (SELECT petition_id, CASE WHEN city IN ('1', '2') THEN NULL ELSE employer END AS employer,
                CASE WHEN naics = '5-LOW' THEN NULL ELSE state END AS state,
                CASE WHEN ia = 1 THEN NULL ELSE wage END AS wage FROM petitions)
SELECT petition_id, coalesce(employer, 'Unknown') AS employer, coalesce(state, 'Unknown') AS state,
       coalesce(wage, (SELECT quantile_cont(wage, 0.5) FROM hp)) AS wage FROM hp""", ctes=("petitions",))
def q_impute_const(spark, sf):
    return I.impute_constant(holes_petitions(spark, sf), numeric_exclude=("petition_id",))


@register("encode_one_hot", """
SELECT case_id, status = 'N' AS status_N, status = 'R' AS status_R FROM valid""")
def q_onehot(spark, sf):
    return E.encode_one_hot(valid(spark, sf).select("case_id", "status"), "status")


@register("encode_label", """
SELECT case_id, dense_rank() OVER (ORDER BY office) - 1 AS office, dense_rank() OVER (ORDER BY case_id) - 1 AS case_code
FROM valid""")
def q_label(spark, sf):
    v = valid(spark, sf).select("case_id", "office", F.col("case_id").alias("case_code"))
    return E.encode_label(E.encode_label(v, "office"), "case_code")


@register("encode_auto", """
SELECT dense_rank() OVER (ORDER BY case_id) - 1 AS ref, dense_rank() OVER (ORDER BY office) - 1 AS office,
  region = 'AMERICA' AS region_AMERICA, region = 'ASIA' AS region_ASIA, region = 'EUROPE' AS region_EUROPE,
  region = 'MIDDLE EAST' AS "region_MIDDLE EAST", status = 'N' AS status_N, status = 'R' AS status_R,
  priority = '2-HIGH' AS "priority_2-HIGH", priority = '3-MEDIUM' AS "priority_3-MEDIUM",
  priority = '4-NOT SPECIFIED' AS "priority_4-NOT SPECIFIED", priority = '5-LOW' AS "priority_5-LOW" FROM valid""")
def q_auto(spark, sf):
    v = valid(spark, sf).select(F.col("case_id").alias("ref"), "office", "region", "status", "priority")
    out, _ = E.encode_auto(v)
    return out


@register("missing_by_column", HOLES_SQL + """
, m AS (SELECT 'case_id' AS "column", count(*) FILTER (WHERE case_id IS NULL) AS missing FROM holes
  UNION ALL SELECT 'office_n', count(*) FILTER (WHERE office_n IS NULL) FROM holes
  UNION ALL SELECT 'region_n', count(*) FILTER (WHERE region_n IS NULL) FROM holes
  UNION ALL SELECT 'id_n', count(*) FILTER (WHERE id_n IS NULL) FROM holes
  UNION ALL SELECT 'quantity_n', count(*) FILTER (WHERE quantity_n IS NULL) FROM holes
  UNION ALL SELECT 'doy_n', count(*) FILTER (WHERE doy_n IS NULL) FROM holes)
SELECT "column", missing, round(missing * 100.0 / (SELECT count(*) FROM holes), 6) AS missing_pct FROM m WHERE missing > 0""")
def q_missing(spark, sf):
    return P.missing_by_column(holes(spark, sf))


_DESCRIBE_COLS = ("quantity", "amount", "discount", "lead_days", "submit_month")


@register("numeric_describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, {r(f'avg(CAST({c} AS DOUBLE))', 'mean')},
       {r(f'stddev_samp(CAST({c} AS DOUBLE))', 'std')}, CAST(min({c}) AS DOUBLE) AS min,
       {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 'p25')}, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'p50')},
       {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 'p75')}, CAST(max({c}) AS DOUBLE) AS max FROM valid"""
    for c in _DESCRIBE_COLS))
def q_describe(spark, sf):
    return P.numeric_describe(valid(spark, sf).select(*_DESCRIBE_COLS))


_TOP5_COLS = ("case_id", "office", "region", "status", "priority")


@register("categorical_top5", """
, long AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value FROM valid" for c in _TOP5_COLS) + """)
, cnt AS (SELECT "column", value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY "column", value)
, d AS (SELECT "column", count(*) AS distinct FROM cnt GROUP BY "column")
, rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM cnt)
SELECT "column", value, count, rank, "distinct" FROM rk JOIN d USING ("column") WHERE rank <= 5""")
def q_top5(spark, sf):
    return P.categorical_top5(valid(spark, sf).select(*_TOP5_COLS))


@register("quality_duplicates", """
, g AS (SELECT count(*) AS n FROM valid GROUP BY office, region, status, submit_month)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS rows,
       round(sum(n - 1) * 100.0 / sum(n), 6) AS duplicate_pct FROM g""")
def q_dups(spark, sf):
    return P.quality_duplicates(valid(spark, sf).select("office", "region", "status", "submit_month"))


def const_input(spark, sf):
    return valid(spark, sf).select("office", "status", F.lit("x").alias("const_text"), F.lit(1).alias("const_one"),
                                   F.when(F.col("is_ap") == 2, F.lit(7)).alias("all_null"),
                                   F.when(F.col("status") == "R", F.lit(5)).alias("const_or_null"))


_CONST_SQL = """
, ci AS (SELECT office, status, 'x' AS const_text, 1 AS const_one, CASE WHEN is_ap = 2 THEN 7 END AS all_null,
                CASE WHEN status = 'R' THEN 5 END AS const_or_null FROM valid)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column FROM ci HAVING count({c}) > 0 AND min({c}) = max({c})"
    for c in ("office", "status", "const_text", "const_one", "all_null", "const_or_null"))


@register("quality_constant_columns", _CONST_SQL)
def q_const(spark, sf):
    return P.quality_constant_columns(const_input(spark, sf))


@register("quality_high_cardinality", """
SELECT 'case_id' AS column, count(DISTINCT case_id) AS distinct, count(*) AS rows FROM valid
HAVING count(DISTINCT case_id) > 0.9 * count(*)""")
def q_highcard(spark, sf):
    return P.quality_high_cardinality(valid(spark, sf).select("case_id", "office", "status"))


@register("quality_negative_target", """
SELECT count(*) FILTER (WHERE floor(epoch(status_ts - submit_ts) / 86400) < 0) AS negative FROM cases""", ctes=("cases",))
def q_negative(spark, sf):
    c = cases(spark, sf)
    return P.quality_negative_target(c.withColumn("raw_days", raw_days("submit_ts", "status_ts")), "raw_days")


@register("quality_report", """
, raw AS (SELECT case_id, office, status, CAST(floor(epoch(status_ts - submit_ts) / 86400) AS BIGINT) AS raw_days FROM cases)
, dup AS (SELECT CAST(sum(n - 1) AS BIGINT) AS d, sum(n) AS t FROM (SELECT count(*) AS n FROM raw GROUP BY case_id, office, status, raw_days))
SELECT 'duplicates' AS check, CAST(d AS VARCHAR) AS value, printf('%d duplicate rows (%.2f%%)', d, d * 100.0 / t) AS message FROM dup WHERE d > 0
UNION ALL
SELECT 'high_cardinality', 'case_id', printf('column %s has %d distinct values', 'case_id', count(DISTINCT case_id)) FROM raw
  HAVING count(DISTINCT case_id) > 0.9 * count(*)
UNION ALL
SELECT 'negative_target', CAST(count(*) AS VARCHAR), printf('%d rows with negative target', count(*)) FROM raw WHERE raw_days < 0
  HAVING count(*) > 0""", ctes=("cases",))
def q_quality(spark, sf):
    c = cases(spark, sf)
    return P.quality_report(c.select("case_id", "office", "status", raw_days("submit_ts", "status_ts").alias("raw_days")),
                            "raw_days")


@register("profile_raw_file", """
SELECT 19 AS columns, status, count(*) AS count FROM (SELECT status FROM cases ORDER BY case_id LIMIT 1000) GROUP BY status""",
          ctes=("cases",))
def q_profile_raw(spark, sf):
    return P.profile_raw_file(cases(spark, sf), "case_id", "status", 1000)


RAW_COLUMNS = ("case_id", "office", "status", "priority", "submit_ts", "status_ts")


@register("profile_raw_columns", ", head AS (SELECT * FROM cases ORDER BY case_id LIMIT 1000)\n" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column, {f"CAST(count({c}) AS BIGINT)"} AS filled FROM head"
    for i, c in enumerate(RAW_COLUMNS, 1)), ctes=("cases",))
def q_profile_columns(spark, sf):
    # the name of a type differs between engines
    return P.profile_raw_columns(cases(spark, sf).select(*RAW_COLUMNS), "case_id", 1000).drop("type")


# Oracle for the sf0.01 data: counts before filling, 'Unknown' for text, medians for numbers,
# employer (1,500 values) and city (25) -> sorted codes, state (5 + 'Unknown') and naics (5) -> one-hot.
_PETITIONS_PROCESS_SQL = """
, hp AS (SELECT petition_id, CASE WHEN city IN ('1', '2') THEN NULL ELSE employer END AS employer,
                CASE WHEN naics = '5-LOW' THEN NULL ELSE state END AS state,
                CASE WHEN ia = 1 THEN NULL ELSE wage END AS wage, city, naics, fiscal_year, ia, id, ca, cd FROM petitions)
, f AS (SELECT *, ia AS is_initial_approval, id AS is_initial_denial, ca AS is_continuing_approval,
               cd AS is_continuing_denial,
               CAST(coalesce(ia = 1, false) OR coalesce(ca = 1, false) AS INTEGER) AS is_approved,
               CAST(coalesce(id = 1, false) OR coalesce(cd = 1, false) AS INTEGER) AS is_denied,
               CASE WHEN employer IS NOT NULL THEN count(*) OVER (PARTITION BY employer) END AS employer_count,
               CASE WHEN state IS NOT NULL THEN count(*) OVER (PARTITION BY state) END AS state_count
        FROM hp)
, md AS (SELECT quantile_cont(wage, 0.5) AS mw, quantile_cont(CAST(employer_count AS DOUBLE), 0.5) AS me,
                quantile_cont(CAST(state_count AS DOUBLE), 0.5) AS ms FROM f)
, filled AS (SELECT f.* EXCLUDE (employer, state, wage, employer_count, state_count),
                    coalesce(employer, 'Unknown') AS employer, coalesce(state, 'Unknown') AS state,
                    coalesce(wage, mw) AS wage, coalesce(CAST(employer_count AS DOUBLE), me) AS employer_count,
                    coalesce(CAST(state_count AS DOUBLE), ms) AS state_count FROM f, md)
SELECT petition_id, fiscal_year, ia, id, ca, cd, is_initial_approval, is_initial_denial, is_continuing_approval,
       is_continuing_denial, is_approved, is_denied, round(wage, 6) AS wage, round(employer_count, 6) AS employer_count,
       round(state_count, 6) AS state_count,
       dense_rank() OVER (ORDER BY employer) - 1 AS employer, dense_rank() OVER (ORDER BY city) - 1 AS city,
       state = 'BUILDING' AS state_BUILDING, state = 'FURNITURE' AS state_FURNITURE, state = 'HOUSEHOLD' AS state_HOUSEHOLD,
       state = 'MACHINERY' AS state_MACHINERY, state = 'Unknown' AS state_Unknown,
       naics = '2-HIGH' AS "naics_2-HIGH", naics = '3-MEDIUM' AS "naics_3-MEDIUM",
       naics = '4-NOT SPECIFIED' AS "naics_4-NOT SPECIFIED", naics = '5-LOW' AS "naics_5-LOW"
FROM filled"""


@register("process_petitions", _PETITIONS_PROCESS_SQL, ctes=("petitions",))
def q_process_petitions(spark, sf):
    from .prepare import process_petitions
    return process_petitions(holes_petitions(spark, sf).join(
        petition_table(spark, sf).select("petition_id", "city", "naics", "fiscal_year", "ia", "id", "ca", "cd"),
        "petition_id"))
