"""The extraction stage over a stream of requirement texts.

The stages hold no state between rows, so the batch expressions run unchanged under Structured
Streaming; each micro-batch appends its rows to the stage's log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reqloom.functions import scalars as S
from reqloom.operators.extract import extract
from reqloom.schema import INPUT


def requirements(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Texts from JSON Lines files as they arrive in a folder; idx must be in the rows, since a stream
    has no ordinal to fall back to."""
    rows = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.withColumn("idx", S.coerce_float(rows["idx"]).cast("bigint"))


def extraction_log(texts: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends extracted records to Parquet at target; exactly once by the sink's own log."""
    out = extract(texts).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
