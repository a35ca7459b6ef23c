"""Structured Streaming scorer (§2.10): requests arriving as files are validated and scored.

The stream is stateless: each micro-batch goes through the same ``score_requests`` plan as a
batch call (stream-static joins against the office statistics, the fitted PipelineModel).
``foreachBatch`` validates a batch once and writes scored and quarantined rows together, partitioned by
validity, in one write; a manifest put in place after it names the folder.  Readers follow manifests, so a
half-written batch is never seen and a replayed one replaces itself; the checkpoint folder records
progress.  ``compact_sink`` merges the small files of many batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.clean import validate_requests
from ..plans.score import score_requests
from ..sources.manifest import compact, manifests, read_batches, write_batch


VALID = "request_valid"


def score_stream(spark: SparkSession, source_dir: str, schema: StructType | str, sink_dir: str, checkpoint_dir: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 trigger_interval: str = "10 seconds", **score_kw):
    """Start the scoring stream; with ``available_now`` it processes everything present and stops.

    ``score_kw`` are the arguments of :func:`leadtime.plans.score.score_requests` after the
    request frame (model, office statistics, codes, rmse, ...).  Returns the StreamingQuery.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    requests = reader.parquet(source_dir)

    def _batch(batch: DataFrame, batch_id: int) -> None:
        # The source is read and validated once for both outputs.
        validated = validate_requests(batch).persist()
        try:
            scored, bad = score_requests(batch, **score_kw, validated=validated)
            both = scored.withColumn(VALID, F.lit(True)).unionByName(bad.withColumn(VALID, F.lit(False)), allowMissingColumns=True)
            write_batch(both, sink_dir, batch_id, [VALID], {"scored": scored.columns, "quarantine": bad.columns})
        finally:
            validated.unpersist()

    w = requests.writeStream.foreachBatch(_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger_interval)
    return w.start()


def _read(spark: SparkSession, sink_dir: str, valid: bool, columns: str) -> DataFrame:
    rows, entries = read_batches(spark, sink_dir), manifests(spark, sink_dir)
    if rows is None:
        raise FileNotFoundError(f"no batch under {sink_dir}")
    return rows.where(F.col(VALID) == valid).select(*entries[-1][columns])


def read_scored(spark: SparkSession, sink_dir: str) -> DataFrame:
    return _read(spark, sink_dir, True, "scored")


def read_quarantine(spark: SparkSession, sink_dir: str) -> DataFrame:
    return _read(spark, sink_dir, False, "quarantine")


def compact_sink(spark: SparkSession, sink_dir: str, files: int = 1) -> int:
    """Merges all batches so far; returns how many there were."""
    return compact(spark, sink_dir, [VALID], files)
