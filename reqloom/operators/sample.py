"""Stratified samples: length terciles, proportional allocation, hashed order, disjoint splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqloom.functions import text as X
from reqloom.operators.iterate import checkpointed


def with_stratum(df: DataFrame, text: str = "text", by: str = "lang") -> DataFrame:
    """df with length, bucket (by nearest-rank terciles over all rows) and stratum."""
    df = df.withColumn("length", F.length(F.coalesce(text, F.lit(""))))
    cuts = df.agg(F.expr("percentile_disc(0.33) WITHIN GROUP (ORDER BY length)").alias("p33"), F.expr("percentile_disc(0.66) WITHIN GROUP (ORDER BY length)").alias("p66"))
    bucket = X.length_bucket(F.col("length"), cuts.select("p33").scalar(), cuts.select("p66").scalar())
    return df.withColumn("bucket", bucket).withColumn("stratum", F.concat_ws("|", by, "bucket"))


def allocation(counts: DataFrame, size: int) -> DataFrame:
    """(stratum, n, share): whole shares of `size` by largest remainder, ties by name, never over n."""
    everything = Window.partitionBy()
    c = counts.withColumn("total", F.sum("n").over(everything)).withColumn("whole", F.floor(F.col("n") * size / F.col("total")))
    c = c.withColumn("rest", (F.col("n") * size) % F.col("total")).withColumn("left", F.lit(size) - F.sum("whole").over(everything))
    c = c.withColumn("turn", F.row_number().over(Window.orderBy(F.col("rest").desc(), "stratum")))
    share = F.when(F.col("total") <= size, F.col("n")).otherwise(F.least(F.col("n"), F.col("whole") + (F.col("turn") <= F.col("left")).cast("bigint")))
    return c.select("stratum", "n", share.cast("bigint").alias("share"))


def stratified(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """A sample of `size` rows with every stratum's share, in the order of a hash. Strata are ranked by
    hash prefix first, so a large one isn't sorted in one task."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    df = df.withColumn("h", h).withColumn("slot", F.substr("h", F.lit(1), F.lit(2)))
    counts = df.groupBy("stratum").agg(F.count("*").alias("n"))
    per = df.groupBy("stratum", "slot").agg(F.count("*").alias("m"))
    per = per.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("stratum").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy("stratum", "slot").orderBy("h", key))).join(per, ["stratum", "slot"])
    return ranked.join(allocation(counts, size).select("stratum", "share"), "stratum").where("before + rn <= share").drop("h", "slot", "rn", "before", "share")


def split(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """What the other part of a split may use."""
    return df.join(taken.select(key), key, "left_anti")


def manifest(pool: DataFrame, taken: DataFrame, key: str, size: int, length: str = "length") -> DataFrame:
    """(stratum, n_pool, n_wanted, n_taken, shortest, longest) of a sample of `size` rows of the pool."""
    mark = taken.select(key, F.lit(1).alias("__taken"))
    per = pool.join(mark, key, "left").groupBy("stratum").agg(F.count("*").alias("n_pool"), F.count("__taken").alias("n_taken"), F.min(length).alias("shortest"), F.max(length).alias("longest"))
    share = allocation(per.select("stratum", F.col("n_pool").alias("n")), size)
    return per.join(share.select("stratum", F.col("share").alias("n_wanted")), "stratum").select("stratum", "n_pool", "n_wanted", "n_taken", "shortest", "longest")


def cover_families(selected: DataFrame, pool: DataFrame, key: str, families: list[str], family: str = "family", stratum: str = "stratum") -> DataFrame:
    """Brings in the first pool row of each family that the sample lacks, for the last row of the most
    common family there. A loop over the list of families, of which there are a handful."""
    selected, pool = checkpointed(selected), checkpointed(pool)
    for f in families:
        if selected.where(F.col(family) == f).isEmpty():
            new = pool.where(F.col(family) == f).orderBy(key).limit(1)
            counts = selected.groupBy(family).count().where("count > 1").orderBy(F.col("count").desc(), family).limit(1)
            old = selected.join(counts, family, "left_semi").orderBy(F.col(key).desc()).limit(1)
            if not new.isEmpty() and not old.isEmpty():
                selected = checkpointed(selected.join(old.select(key), key, "left_anti").unionByName(new.select(selected.columns)))
    return selected
