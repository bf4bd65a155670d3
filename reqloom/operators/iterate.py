"""Tables between the phases of a query, semi-naive fixpoints and components over DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reqloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, its lineage ends here, a lost
    executor costs nothing of it, and later steps read the columns that they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/reqloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["table_path"] = path
    return out


def partitions(spark: SparkSession) -> int:
    """For rows that grow after they are dealt: the planner joins small partitions by what is shuffled, so
    the number is fixed, and large enough that a task's share stays small."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(table: DataFrame) -> None:
    """Removes a table of `checkpointed` that no later step reads."""
    jvm, path = table.sparkSession._jvm, table.__dict__["table_path"]
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000, compact: int = 8) -> DataFrame:
    """The least set that holds `start` and all that `step` derives; each round expands new rows only.

    What each round finds is a table of its own; every `compact` rounds they become one, so that neither
    the plan nor what is written grows with rounds times rows.
    """
    seen = fresh = checkpointed(start.distinct())
    for i in range(1, rounds + 1):
        fresh = checkpointed(step(fresh).distinct().join(seen, seen.columns, "left_anti").select(seen.columns))
        if fresh.isEmpty():
            return seen
        seen = seen.union(fresh) if i % compact else checkpointed(seen.union(fresh))
    raise RuntimeError("no fixpoint was reached")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(graph_id, node, least): each node of edges (graph_id, a, b), taken both ways, with the least node
    that it is connected with. Edges of a node with itself count for nothing.

    In turn each node hands its greater neighbours its least neighbour, and all its neighbours that least
    one; after a number of rounds that grows with the logarithm of the longest path every node points to
    the least one, however long the chains are.
    """
    link = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = checkpointed(edges.where("a != b").select("graph_id", *link("a", "b")).distinct(), "links")
    state = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("graph_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.where("v > u").join(least, ["graph_id", "u"]).select("graph_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        up = checkpointed(up, "links")
        discard(now)
        least = up.groupBy("graph_id", "u").agg(F.min("v").alias("m"))
        down = up.join(least, ["graph_id", "u"]).where("v != m").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(down.unionByName(least.select("graph_id", "u", F.col("m").alias("v"))).distinct(), "links")
        discard(up)
        before, state = state, _state(now)
        if before == state:
            ends = now.select("graph_id", F.col("v").alias("node"), F.col("v").alias("least")).distinct()
            return now.select("graph_id", F.col("u").alias("node"), F.col("v").alias("least")).unionByName(ends)
    raise RuntimeError("components did not settle")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("graph_id", "u", "v").cast("decimal(38,0)"))).first())
