"""Readers for yearly case files and lookup files (§2.1).

Files are read by Spark readers, never through the driver; the driver only lists file names
and reads each file's header line to group files whose columns agree (a single CSV reader over
files with different headers binds columns by position and silently swaps values).
"""

from __future__ import annotations

import csv
import logging
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_order
from ..operators.stats import nan_to_null, top_n_per_group, with_row_index

log = logging.getLogger(__name__)

# Default file-name pattern of yearly case files and the tag taken from it.
YEAR_FILE_GLOB = "FY*-*.csv"
YEAR_TAG_PATTERN = r"FY(\d+)-"


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob on any Hadoop file system (metadata only)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stats = fs.globStatus(hpath) or []
    out = []
    for st in stats:
        if st.isDirectory():
            for ch in fs.listStatus(st.getPath()):
                name = ch.getPath().getName()
                if ch.isFile() and not name.startswith(("_", ".")):
                    out.append(ch.getPath().toString())
        else:
            out.append(st.getPath().toString())
    return sorted(out)


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file on any Hadoop file system, decompressed by its suffix; no Spark job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    stream = hpath.getFileSystem(conf).open(hpath)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hpath)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            codec.createInputStream(stream) if codec else stream, "UTF-8")).readLine()
    finally:
        stream.close()


def _header(spark: SparkSession, path: str, sep: str) -> tuple[tuple | None, str | None]:
    """(column names, None), or (None, why the file holds no table).  A failing storage raises."""
    line = _first_line(spark, path)
    if line is None or not line.strip():
        return None, "no header line"
    if chr(0) in line:
        return None, "the header line is not text"
    names = next(csv.reader([line.lstrip("\ufeff")], delimiter=sep))
    names = [n.strip() or f"_c{i}" for i, n in enumerate(names)]
    return tuple(n if names.count(n) == 1 else f"{n}{i}" for i, n in enumerate(names)), None


def read_headers(spark: SparkSession, paths, sep: str = ",") -> tuple[dict[tuple, list[str]], list[tuple[str, str]]]:
    """Files by header, and (path, reason) of the files that hold no table."""
    groups: dict[tuple, list[str]] = {}
    skipped = []
    for p in paths:
        header, why = _header(spark, p, sep)
        if header is None:
            skipped.append((p, why))
        else:
            groups.setdefault(header, []).append(p)
    return groups, skipped


def skipped_files(spark: SparkSession, pattern_or_paths, sep: str = ",") -> DataFrame:
    """(path, reason) of the files that :func:`scan_multi_file_union` leaves out."""
    paths = pattern_or_paths if isinstance(pattern_or_paths, (list, tuple)) else list_files(spark, pattern_or_paths)
    return spark.createDataFrame(read_headers(spark, paths, sep)[1], "path string, reason string")


def _tag(tag_pattern: str):
    """The tag in the file's name; of a part file, the tag in the name of its folder."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    folder = F.try_element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-2))
    own = F.regexp_extract(name, tag_pattern, 1)
    return F.when(own != "", own).when(name.startswith("part-") & (F.regexp_extract(folder, tag_pattern, 1) != ""),
                                       F.regexp_extract(folder, tag_pattern, 1))


def scan_multi_file_union(spark: SparkSession, pattern_or_paths, tag_col: str = "fiscal_year",
                          tag_pattern: str = YEAR_TAG_PATTERN, sep: str = ",", tag_type: str = "string") -> DataFrame:
    """Read every file, tag rows with a value parsed from the file name, union by column name.

    Files are grouped by header, so the number of Spark readers equals the number of distinct
    headers (not files); all values are read as strings (types are decided later by
    ``coerce_numeric_columns``).  A file without a header line holds no table and is left out
    (:func:`skipped_files` lists those); a storage error raises.  A name without a tag gives null.
    """
    paths = pattern_or_paths if isinstance(pattern_or_paths, (list, tuple)) else list_files(spark, pattern_or_paths)
    groups, skipped = read_headers(spark, paths, sep)
    for p, why in skipped:
        log.warning("left out %s: %s", p, why)
    if not groups:
        raise FileNotFoundError(f"no readable files in {pattern_or_paths}")
    parts = []
    for header, files in groups.items():
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
        df = spark.read.option("header", True).option("sep", sep).schema(schema).csv(files)
        parts.append(df.withColumn(tag_col, _tag(tag_pattern).cast(tag_type)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sample_capped_per_group(df: DataFrame, group: str, n: int, key: str, seed: str = "42",
                            margin: float = 0.1) -> DataFrame:
    """At most n rows per group, the n smallest md5(key || seed) order values; groups with <= n
    rows are kept whole.  Deterministic and exact.  Null is a group like any other; a null key
    orders as the empty string.

    The order value is uniform on [0, 2^32), so a per-group threshold of about
    n / count * 2^32 (plus slack) preselects ~1.1 n candidates per group: the final ranking sees
    about n rows per group instead of the whole group.  A group whose candidates fall short of
    min(n, count) (vanishingly rare) is ranked with the exact salted top-n instead.
    """
    space = float(2 ** 32)
    h = df.withColumn("_h", hash_order(key, seed))
    same = h[group].eqNullSafe(F.col("_g"))
    counts = h.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_cnt"))            # one row per group
    want = F.least(F.col("_cnt"), F.lit(n))
    slack = F.lit(n * (1.0 + margin) + 10.0 * (n ** 0.5) + 10.0)
    thr = counts.select("_g", "_cnt", F.when(F.col("_cnt") <= n, F.lit(space))
                        .otherwise(F.least(F.lit(space), F.ceil(slack / F.col("_cnt") * F.lit(space)))).alias("_t"))
    cand = h.join(thr, same).filter(F.col("_h") < F.col("_t"))
    got = cand.groupBy("_g", "_cnt").agg(F.count(F.lit(1)).alias("_got"))
    # A group with a row has at least one candidate, so every group is in ``got``; rows all above
    # the threshold are caught by the difference to the groups that are.
    full = got.filter(F.col("_got") >= want).select(F.col("_g").alias("_f"), F.lit(True).alias("_ok"))
    short = counts.join(full, F.col("_g").eqNullSafe(F.col("_f")), "left").filter(F.col("_ok").isNull()).select("_g")
    w = Window.partitionBy(group).orderBy("_h", key)
    ok = (cand.drop("_g").join(short, F.col(group).eqNullSafe(F.col("_g")), "left_anti")
              .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
              .drop("_h", "_cnt", "_t", "_r"))
    fallback = top_n_per_group(h.join(short, same, "left_semi"), [group],
                               [F.col("_h"), F.col(key)], n, salt_col=key).drop("_h", "rank")
    return ok.unionByName(fallback.select(*ok.columns))


def scan_random_cap(df: DataFrame, n: int, key: str, seed: str = "42", margin: float = 0.1) -> DataFrame:
    """At most n rows of one table, the n smallest (md5(key || seed), key) order values; a null key
    orders as the empty string.

    One way for every n: the order value is uniform, so a threshold leaves about 1.1 n rows, which
    a range-partitioned sort numbers; no task holds n rows.  Should the threshold leave fewer
    than n (vanishingly rare), all rows are numbered.
    """
    h = df.withColumn("_h", hash_order(key, seed))
    total = h.count()
    space = 2 ** 32
    limit = min(space, math.ceil((n * (1.0 + margin) + 10.0 * n ** 0.5 + 10.0) / max(total, 1) * space))
    numbered = with_row_index(h.filter(F.col("_h") < limit), ["_h", key], "_i")
    if limit < space and numbered.filter(F.col("_i") == n - 1).isEmpty():
        numbered = with_row_index(h, ["_h", key], "_i")
    return numbered.filter(F.col("_i") < n).drop("_h", "_i")


def scan_head(df: DataFrame, n: int | None, order_key: str) -> DataFrame:
    """First n rows in ``order_key`` order (Spark tables have no inherent row order), or all."""
    return df if n is None else df.orderBy(order_key).limit(n)


def load_lookups(spark: SparkSession, folder: str, names, fmt: str = "csv") -> dict:
    """{name: DataFrame} for the lookup files that exist; missing ones are skipped.

    A name stands for exactly one file or folder: itself, with ``.<fmt>`` added if it has none.
    """
    out = {}
    for name in names:
        file = name if name.endswith(f".{fmt}") else f"{name}.{fmt}"
        found = list_files(spark, f"{folder.rstrip('/')}/{file}")
        if not found:
            log.info("lookup %s not found, skipped", name)
            continue
        r = spark.read.option("header", True)
        out[name] = r.csv(found) if fmt == "csv" else r.format(fmt).load(found)
    return out


def lookup_counts(lookups: dict) -> DataFrame:
    """(lookup, rows) for each loaded lookup table."""
    parts = [df.agg(F.lit(name).alias("lookup"), F.count(F.lit(1)).alias("rows")) for name, df in lookups.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_pruned_columns(df: DataFrame, key: str, other: str) -> DataFrame:
    """Two columns only (pruned at the scan), rows null in either dropped, distinct keys with
    their sorted position as code."""
    from ..operators.encode import label_codes
    base = df.select(key, other).dropna().select(key)
    return label_codes(base, key, null_token=None).withColumnRenamed("value", key)


def coerce_numeric_columns(df: DataFrame, cols=None) -> DataFrame:
    """String column -> double only if every non-null value parses as a number (one pass); the
    text NaN is a missing number."""
    from ..operators.stats import string_columns
    cols = cols or string_columns(df)
    if not cols:
        return df
    row = df.agg(*[(F.count(c) == F.count(F.col(c).try_cast("double"))).alias(f"ok{i}")
                   for i, c in enumerate(cols)]).first()
    good = [c for i, c in enumerate(cols) if row[f"ok{i}"]]
    return nan_to_null(df.withColumns({c: F.col(c).try_cast("double") for c in good})) if good else df
