"""Spark session and shared-storage helpers.

The library never creates a session behind the caller's back: operators take
DataFrames.  ``get_session`` is for scripts, tests and the bench.
"""

from __future__ import annotations

import os
import re
import shlex
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings every job wants: UTC (day arithmetic must not shift with the host zone),
# AQE for runtime join selection, partition coalescing and skew-join splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "leadtime", extra: dict | None = None) -> SparkSession:
    """A session for scripts.  Where the submit command names a master, that one is used; only without
    any does the session run on this machine, with shuffle partitions for its cores."""
    builder = SparkSession.builder.appName(app_name)
    conf = dict(BASE_CONF)
    named = master or SparkConf().get("spark.master", None) or _submitted_master()
    if named is None or named.startswith("local"):
        cpus = os.environ.get("BENCH_CPUS", "8")
        conf["spark.driver.memory"] = os.environ.get("LEADTIME_DRIVER_MEMORY", "8g")
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
        conf["spark.sql.files.minPartitionNum"] = cpus
        if named is None or master:
            builder = builder.master(master or f"local[{cpus}]")
    elif shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _submitted_master() -> str | None:
    """The master in the submit arguments of a Python process that starts its own JVM."""
    words = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    for i, w in enumerate(words):
        if w == "--master" and i + 1 < len(words):
            return words[i + 1]
        if w.startswith("--master="):
            return w.partition("=")[2]
    return None


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process on one machine (``local-cluster`` is not)."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without the setting: it gets a private folder.  On a cluster each
    executor would write to its own disk, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="leadtime-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint location; no two calls give the same."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/leadtime-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; call it when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{ensure_checkpoint_dir(spark).rstrip('/')}/leadtime-tables/{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)


def cut_lineage(df: DataFrame, name: str = "t", **options: str) -> DataFrame:
    """Materialise ``df`` as parquet in the shared checkpoint folder and read it back; ``options`` are those of the writer.

    Same guarantee as a reliable ``checkpoint()`` (the data lives in shared storage, so a lost
    executor never forces a recomputation of the lineage), but one job instead of two: Spark's
    eager checkpoint computes the plan once to count and again to write.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{name}")
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)
