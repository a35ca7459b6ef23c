"""Output folders that readers follow by manifest, so that a half-written or replayed write is never read.

Every write goes to a folder of its own under ``data``; only then is its manifest put in place under ``manifest``, by a
rename.  ``batch-N`` names the folder of batch N, a later manifest of the same batch replaces it, and ``compact-N``
names one folder with all batches up to N.  Readers take the last compaction and the batches after it.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def put_manifest(spark: SparkSession, root: str, name: str, entry: dict) -> None:
    """Puts a manifest in place; an older one of that name goes."""
    fs, path = _fs(spark, root)
    part, whole = path(f"{root}/manifest/.{name}-{uuid.uuid4().hex}"), path(f"{root}/manifest/{name}.json")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    fs.delete(whole, False)
    if not fs.rename(part, whole):
        raise OSError(f"manifest {name} could not be put in place")


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """The entries that make up the output: the last compaction, then the batches after it in order."""
    fs, path = _fs(spark, root)
    folder = path(f"{root}/manifest")
    found: dict[str, dict[int, str]] = {"batch": {}, "compact": {}}
    for s in fs.listStatus(folder) if fs.exists(folder) else []:
        m = re.fullmatch(r"(batch|compact)-(\d+)\.json", s.getPath().getName())
        if m:
            found[m[1]][int(m[2])] = s.getPath().toString()
    last = max(found["compact"], default=-1)
    names = ([found["compact"][last]] if last >= 0 else []) + [p for n, p in sorted(found["batch"].items()) if n > last]
    texts = {r["path"]: r["value"] for r in _texts(spark, names)} if names else {}
    return [json.loads(texts[n]) for n in names]


def _texts(spark: SparkSession, names: list[str]):
    from pyspark.sql import functions as F
    # one short row a manifest
    rows = spark.read.text(names, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()
    by_name = {n.rsplit("/", 1)[1]: n for n in names}
    return [{"path": by_name[r["path"].rsplit("/", 1)[1]], "value": r["value"]} for r in rows]


def write_batch(df: DataFrame, root: str, batch: int, partition_by: list[str], extra: dict | None = None) -> None:
    """One write of a batch, then its manifest."""
    data = f"{root}/data/batch-{batch}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(data)
    put_manifest(df.sparkSession, root, f"batch-{batch}", {"path": data, "batch": batch, "schema": df.schema.json(), **(extra or {})})


def read_batches(spark: SparkSession, root: str) -> DataFrame | None:
    """All rows that the manifests name; None before the first batch."""
    out = None
    for e in manifests(spark, root):
        # The schema as written: an empty batch has no file to tell it, and a folder name no type.
        part = spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(e["path"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def compact(spark: SparkSession, root: str, partition_by: list[str], files: int = 1) -> int:
    """Writes all batches to one folder of ``files`` files a partition value; returns the number of entries merged.

    Old folders stay for readers that have begun; ``remove_unread`` deletes them.
    """
    entries = manifests(spark, root)
    if len(entries) < 2:
        return 0
    data = f"{root}/data/compact-{uuid.uuid4().hex}"
    rows, last = read_batches(spark, root), entries[-1]
    rows.coalesce(files).write.partitionBy(*partition_by).parquet(data)
    put_manifest(spark, root, f"compact-{last['batch']}", {**last, "path": data, "schema": rows.schema.json()})
    return len(entries)


def remove_unread(spark: SparkSession, root: str) -> int:
    """Deletes data folders that no manifest in use names; returns their number.  No batch may be under way."""
    fs, path = _fs(spark, root)
    used = {e["path"].rstrip("/").rsplit("/", 1)[1] for e in manifests(spark, root)}
    gone = [s.getPath() for s in fs.listStatus(path(f"{root}/data")) if s.getPath().getName() not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
