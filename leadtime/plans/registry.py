"""Registered checks: one Spark query and one DuckDB oracle statement per operator ID.

Each query reads the driver tables through the ``cases`` / ``petitions`` bindings and runs the
operator over all rows.  Doubles are rounded to 6 decimals on both sides (summation order makes
the last bits differ between engines); everything else is compared as is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..roles import CASES_SQL, PETITIONS_SQL, ROLES, cases, petitions
from ..session import cut_lineage
from .prepare import VALID_SQL, valid_cases

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({f.name: F.round(F.col(f.name), digits) for f in df.schema.fields
                           if isinstance(f.dataType, (DoubleType, FloatType))})


def register(name: str, sql: str | None = None, ctes=("cases", "valid")):
    """Decorator: add a query under ``name`` and, if given, its oracle SQL with the CTEs."""
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[name] = with_ctes(sql, ctes)
        return fn
    return deco


_CTE = {"cases": CASES_SQL, "valid": VALID_SQL, "petitions": PETITIONS_SQL}


def with_ctes(body: str, ctes=("cases", "valid"), extra: str = "") -> str:
    parts = [_CTE[c] for c in ctes]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body) if parts else body


def r(expr: str, alias: str, digits: int = DIGITS) -> str:
    """SQL helper: round(expr, 6) AS alias."""
    return f"round({expr}, {digits}) AS {alias}"


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_cases(cases(spark, sf_dir), ROLES)


def kept_valid(spark: SparkSession, source: str | DataFrame, *columns) -> DataFrame:
    """Some columns of the valid cases, written once: for queries that pass over them several times, each of which would
    otherwise shuffle and join the driver tables anew.  ``source``: the folder of the tables, or cases made from them."""
    v = valid(spark, source) if isinstance(source, str) else valid_cases(source, ROLES)
    return cut_lineage(v.select(*columns), "valid")


# What the engineered features and the feature matrix are made from.
FEATURE_INPUT = ("case_id", "case_no", "case_number", "office", "lead_days", "fiscal_year", "submit_year", "submit_month", "submit_quarter",
                 "submit_day_of_week", "submit_day_of_year", "is_issued", "is_ap", "is_refused", "is_refused_221g")


def petition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return petitions(spark, sf_dir)
