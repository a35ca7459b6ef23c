"""Column roles and the table binding used by tests, the bench and ``__spark_entry__``.

Operators are generic over column names; ``CaseRoles`` carries the names so a user with other
data passes their own.  ``cases`` binds the driver's TPC-H-style tables to the case roles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



@dataclass(frozen=True)
class CaseRoles:
    case_id: str = "case_id"
    case_no: str = "case_no"
    submit_ts: str = "submit_ts"
    status_ts: str = "status_ts"
    office: str = "office"
    region: str = "region"
    status: str = "status"
    fiscal_year: str = "fiscal_year"
    target: str = "lead_days"
    # raw 0/1 outcome flags (nullable) -> derived int flags
    flags: dict = field(default_factory=lambda: {
        "issued": "is_issued",
        "ap": "is_ap",
        "refused": "is_refused",
        "refused_221g": "is_refused_221g",
        "ready": "is_ready",
    })
    calendar_prefix: str = "submit"

    def with_(self, **kw) -> "CaseRoles":
        return replace(self, **kw)

    @property
    def month(self) -> str:
        return f"{self.calendar_prefix}_month"

    @property
    def quarter(self) -> str:
        return f"{self.calendar_prefix}_quarter"

    @property
    def year(self) -> str:
        return f"{self.calendar_prefix}_year"

    @property
    def day_of_week(self) -> str:
        return f"{self.calendar_prefix}_day_of_week"

    @property
    def day_of_year(self) -> str:
        return f"{self.calendar_prefix}_day_of_year"


ROLES = CaseRoles()


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")


def present(df: DataFrame, names) -> list[str]:
    cols = set(df.columns)
    return [n for n in names if n in cols]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _flag(c: Column) -> Column:
    return c.cast("int")


def cases(spark: SparkSession, sf_dir: str, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """Case table over the driver tables (lineitem x orders x supplier x nation x region).

    Join order matters for the size checks: orders and supplier are joined as plain scans, so
    Spark's file-based size estimate decides between a broadcast (small) and a sort-merge join
    (both grow with the data; lineitem/orders is the one large-large join at scale).  nation and
    region have a fixed 25/5 rows and are broadcast explicitly as one 25-row geography table.

    ``named``: a condition on the case id, for callers that read the ids of some cases only.  The other cases
    get a null id.  It is decided on the line items alone, so the parts of an id that nobody reads are not shuffled.
    """
    li = read_table(spark, sf_dir, "lineitem")
    case_id = F.concat_ws(
        "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.col("l_shipdate").cast("date").cast("string"))
    if named is not None:
        li = li.withColumn("_named", named(case_id))
        li = li.withColumns({c: F.when(F.col("_named"), F.col(c)) for c in ("l_linenumber", "l_partkey")})
        case_id = F.when(F.col("_named"), case_id)
    o = read_table(spark, sf_dir, "orders")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(s, li.l_suppkey == s.s_suppkey)
           .join(F.broadcast(geo), F.col("s_nationkey") == geo.n_nationkey))
    return j.select(
        case_id.alias("case_id"),
        F.col("l_orderkey").alias("case_no"),
        F.col("o_orderdate").alias("submit_ts"),
        F.col("l_shipdate").alias("status_ts"),
        F.col("n_name").alias("office"),
        F.col("l_suppkey").alias("office_id"),
        F.col("r_name").alias("region"),
        F.col("l_returnflag").alias("status"),
        _flag(F.col("l_returnflag") == "N").alias("issued"),
        _flag(F.col("l_returnflag") == "A").alias("ap"),
        _flag(F.col("l_returnflag") == "R").alias("refused"),
        _flag(F.col("l_linestatus") == "O").alias("refused_221g"),
        _flag(F.col("o_orderstatus") == "F").alias("ready"),
        F.col("o_custkey").alias("employer"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_discount").alias("discount"),
        F.col("o_totalprice").alias("order_total"),
        F.col("o_orderpriority").alias("priority"),
    )


# Same binding in DuckDB SQL (kept next to the Spark version so both change together).
CASES_SQL = """
cases AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS case_id,
         l_orderkey AS case_no, o_orderdate AS submit_ts, l_shipdate AS status_ts,
         n_name AS office, l_suppkey AS office_id, r_name AS region, l_returnflag AS status,
         CAST(l_returnflag = 'N' AS INTEGER) AS issued,
         CAST(l_returnflag = 'A' AS INTEGER) AS ap,
         CAST(l_returnflag = 'R' AS INTEGER) AS refused,
         CAST(l_linestatus = 'O' AS INTEGER) AS refused_221g,
         CAST(o_orderstatus = 'F' AS INTEGER) AS ready,
         o_custkey AS employer, l_quantity AS quantity, l_extendedprice AS amount,
         l_discount AS discount, o_totalprice AS order_total, o_orderpriority AS priority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN supplier ON l_suppkey = s_suppkey
                JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey
)"""


def petitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employer-petition binding (orders x customer): one row per order.

    employer = customer key, state = market segment, fiscal year of the order date,
    initial/continuing approval/denial flags from order status and priority.
    """
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    d = F.col("o_orderdate")
    return j.select(
        F.col("o_orderkey").alias("petition_id"),
        F.col("c_name").alias("employer"),
        F.col("c_mktsegment").alias("state"),
        F.col("c_nationkey").cast("string").alias("city"),
        F.col("o_orderpriority").alias("naics"),
        (F.year(d) + (F.month(d) >= 10).cast("int")).alias("fiscal_year"),
        (F.col("o_orderstatus") == "F").cast("int").alias("ia"),
        (F.col("o_orderstatus") == "O").cast("int").alias("id"),
        (F.col("o_orderstatus") == "P").cast("int").alias("ca"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("cd"),
        F.col("o_totalprice").alias("wage"),
    )


PETITIONS_SQL = """
petitions AS (
  SELECT o_orderkey AS petition_id, c_name AS employer, c_mktsegment AS state,
         CAST(c_nationkey AS VARCHAR) AS city, o_orderpriority AS naics,
         CAST(year(o_orderdate) + CAST(month(o_orderdate) >= 10 AS INTEGER) AS INTEGER) AS fiscal_year,
         CAST(o_orderstatus = 'F' AS INTEGER) AS ia, CAST(o_orderstatus = 'O' AS INTEGER) AS id,
         CAST(o_orderstatus = 'P' AS INTEGER) AS ca, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS cd,
         o_totalprice AS wage
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
