"""Scalar helpers: coercion, ratios, rounding, statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce_idx(raw: Column, fallback: Column) -> Column:
    """An integer in text, else the row's ordinal."""
    ok = F.regexp_like(raw, F.lit(r"^\s*[+-]?[0-9]+\s*$"))
    return F.coalesce(F.when(ok, F.trim(raw).try_cast("bigint")), fallback.cast("bigint"))


def coerce_float(raw: Column) -> Column:
    return F.trim(raw).try_cast("double")


def coerce_bool(raw: Column) -> Column:
    """Lenient booleans: true/1/yes and false/0/no; anything else is unknown."""
    low = F.lower(F.trim(raw.cast("string")))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null without a denominator."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def count_where(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1))).cast("bigint")


def nearest_rank(column: str, p: float) -> Column:
    """The ceil(p n)-th smallest value."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def stats(column: str) -> list[Column]:
    """Count, mean, population deviation, range and nearest-rank percentiles of the values >= 0."""
    v = f"CASE WHEN {column} >= 0 THEN {column} END"
    x = F.expr(v)
    return [
        F.count(x).cast("bigint").alias("n"),
        rounded(F.avg(x)).alias("mean"),
        rounded(F.stddev_pop(x)).alias("stdev"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v})").alias("p50"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {v})").alias("p95"),
    ]


def percent_text(c: Column, digits: int = 2) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f%%", c * 100))
