"""Findings over a growing folder of sources: the batch operators on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspan.operators.anomaly import AnomalyPolicy, inspect_anomalies

SOURCE = "source_id string, text string"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Runs ``build`` on the sources (Parquet of source_id, text) that newly appear in ``folder``. A batch overwrites its own
    partition of ``out``, so one that is repeated after a failure leaves no second copy."""

    def write(batch: DataFrame, number: int) -> None:
        build(batch.select("source_id", "text")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SOURCE).parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def watch_anomalies(spark: SparkSession, folder: str, out: str, checkpoint: str, policy: AnomalyPolicy = AnomalyPolicy(), once: bool = True) -> StreamingQuery:
    """Anomaly findings of every new source."""
    return watch(spark, folder, out, checkpoint, lambda sources: inspect_anomalies(sources, policy), once)
