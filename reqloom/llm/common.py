"""What the operators share: session set-up, shared-folder tables, batching."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes in an Arrow batch; they bound what a Python worker holds of long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Workers find this package, Arrow batches stay small, and the shuffle files of a finished
    action are removed as soon as it ends (its result is in a table by then)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    for key in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled"):
        spark.conf.set(key, "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reqloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: the lineage ends here and
    a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/reqloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["table_path"] = path
    return out


def discard(table: DataFrame) -> None:
    """Removes a table of `materialize` that no later step reads."""
    jvm, path = table.sparkSession._jvm, table.__dict__["table_path"]
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def as_binary_column(parts: list[bytes]):
    import pyarrow as pa

    return pa.array(parts, type=pa.binary())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
