import importlib
import json

import pytest
from pyspark.sql import functions as F

from leadtime.sources import manifest as M

S = importlib.import_module("leadtime.streaming.score_stream")   # the package's name of that is the function


def rows(spark, *values):
    return spark.createDataFrame([(v, v % 2 == 0, "x") for v in values], "v long, ok boolean, extra string")


def read(spark, root):
    return sorted(r.v for r in M.read_batches(spark, root).collect())


def test_half_written_and_replayed_batches_are_not_read(spark, tmp_path):
    root = str(tmp_path / "out")
    assert M.read_batches(spark, root) is None
    M.write_batch(rows(spark, 1, 2, 3), root, 0, ["ok"])
    rows(spark, 77).write.partitionBy("ok").parquet(f"{root}/data/batch-1-lost")          # a driver that was lost before its manifest
    (tmp_path / "out/manifest/.batch-1-half").write_text("{")                              # or while it wrote it
    assert read(spark, root) == [1, 2, 3]
    M.write_batch(rows(spark, 4), root, 1, ["ok"])
    M.write_batch(rows(spark, 4), root, 1, ["ok"])                                         # replayed
    M.write_batch(rows(spark).limit(0), root, 2, ["ok"])                                   # an empty batch
    assert read(spark, root) == [1, 2, 3, 4]
    assert dict(M.read_batches(spark, root).dtypes) == {"v": "bigint", "ok": "boolean", "extra": "string"}


def test_compaction_keeps_rows_and_later_batches(spark, tmp_path):
    root = str(tmp_path / "out")
    for b in range(4):
        M.write_batch(rows(spark, b, 10 + b).repartition(2), root, b, ["ok"])
    assert M.compact(spark, root, ["ok"]) == 4
    assert len(M.manifests(spark, root)) == 1 and read(spark, root) == [0, 1, 2, 3, 10, 11, 12, 13]
    M.write_batch(rows(spark, 99), root, 4, ["ok"])
    M.write_batch(rows(spark, 3, 13), root, 3, ["ok"])                                     # a replay of what was compacted
    assert read(spark, root) == [0, 1, 2, 3, 10, 11, 12, 13, 99]
    assert M.remove_unread(spark, root) == 5 and read(spark, root) == [0, 1, 2, 3, 10, 11, 12, 13, 99]
    assert M.compact(spark, root, ["ok"]) == 2 and M.compact(spark, root, ["ok"]) == 0
    assert len(list((tmp_path / "out").glob("data/*/*/*.parquet"))) < 12


def test_a_missing_manifest_is_an_error_not_an_empty_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_scored(spark, str(tmp_path))


def test_validation_runs_once_a_batch(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(S, "validate_requests", lambda b: calls.append(1) or b.withColumn("errors", F.when(F.col("v") < 0, "bad")))

    def scored(batch, validated, **kw):
        assert validated.storageLevel.useMemory
        return validated.where("errors is null").select("v", F.lit(1.0).alias("days")), validated.where("errors is not null").select("v", "errors")
    monkeypatch.setattr(S, "score_requests", scored)
    src = str(tmp_path / "in")
    spark.createDataFrame([(1,), (-2,), (3,)], "v long").write.parquet(src)
    S.score_stream(spark, src, "v long", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert len(calls) == 1
    assert sorted(map(tuple, S.read_scored(spark, str(tmp_path / "out")).collect())) == [(1, 1.0), (3, 1.0)]
    assert [tuple(r) for r in S.read_quarantine(spark, str(tmp_path / "out")).collect()] == [(-2, "bad")]
    entry = M.manifests(spark, str(tmp_path / "out"))[0]
    assert entry["scored"] == ["v", "days"] and json.loads(entry["schema"])["fields"]
