"""Connected components of a link table, by alternating stars.

Large-star and small-star steps alternate until the links no longer change: each node then points
to the least node of its component. Every step is a grouped minimum and an equality join, so nothing
is gathered on the driver; the lineage ends in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(df: DataFrame, extra) -> DataFrame:
    return df.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", extra)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the nodes that have a link and the least node each one can reach.

    Self links and repeated links count once; rows with a null end are ignored; an empty table gives
    an empty result. Nodes without links are not listed (they are their own component).
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges = materialize(edges, "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large")
        discard(edges)
        least = _least(large, F.col("m"))
        small = (
            large.join(least, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = materialize(small, "small")
        discard(large)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
    ).first()
    return tuple(row)
