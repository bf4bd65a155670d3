"""Joins and choices between the logs of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_passes(structures: DataFrame, constraints: DataFrame, on: tuple[str, ...] = ("idx", "req_idx"), order: str = "seq") -> DataFrame:
    """structures with `constraints`, the first entry of the other pass for the same requirement, and
    `status`: a requirement that the other pass lacks is failed, not an exception."""
    rest = [c for c in constraints.columns if c not in on]
    first = constraints.groupBy(*on).agg(F.min_by(F.struct(*rest), F.col(order)).alias("constraints"))
    out = structures.join(first, list(on), "left")
    return out.withColumn("status", F.when(F.col("constraints").isNull(), "failed").otherwise("ok"))


def chosen_path(asserted: Column, inferred: Column, inferred_exists: Column, source: str = "prefer_inferred") -> Column:
    """The graph that a measure reads; `prefer_inferred` takes the inferred one only where it exists."""
    a, i = F.nullif(asserted, F.lit("")), F.nullif(inferred, F.lit(""))
    if source == "asserted":
        return a
    if source == "inferred":
        return i
    if source != "prefer_inferred":
        raise ValueError(f"unknown graph source {source!r}")
    return F.when(i.isNotNull() & inferred_exists, i).otherwise(a)


def with_texts(rows: DataFrame, texts: DataFrame, text: str = "original_text") -> DataFrame:
    """rows with the text of their idx, empty where there is none; of several texts the least."""
    one = texts.groupBy("idx").agg(F.min(text).alias(text))
    return rows.join(one, "idx", "left").withColumn(text, F.coalesce(text, F.lit("")))


def markers(text: Column) -> Column:
    """Struct (quantity, requirement, linkage): what a graph's text mentions."""
    has = lambda *words: F.greatest(*[F.coalesce(text, F.lit("")).contains(w) for w in words], F.lit(False))
    return F.struct(
        has("qudt:QuantityValue", "http://qudt.org/schema/qudt/QuantityValue").alias("quantity"),
        has("example.org/req/", "VE_req", "Req_0").alias("requirement"),
        (has("RequirementSpecification") & has("requirementSatisfiedBy", "satisfiesRequirement")).alias("linkage"),
    )
