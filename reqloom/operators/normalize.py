"""Normalization of quantities: unit and kind by dimension joins, SI values, bounds.

The unit tables are dimensions of a fixed vocabulary; they are small enough to broadcast, and the engine
checks their size before it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqloom.functions import units as U


class Chooser:
    """Picks a kind among candidates: the only one, else the one whose name is in the text, else the
    first. A language model can take its place; results then are whatever it says."""

    def choose(self, candidates: Column, text: Column) -> Column:
        named = F.filter(candidates, lambda c: F.lower(text).contains(F.lower(F.regexp_extract(c, "[^/#]*$", 0))))
        return F.coalesce(F.get(named, F.lit(0)), F.get(candidates, F.lit(0)))


def kinds_of(rows: DataFrame, kinds: DataFrame, unit: str = "unit_iri") -> DataFrame:
    """rows with kind_candidates: the kinds of the unit, in the table's order, without repeats."""
    per = kinds.groupBy("unit").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"])).alias("kind_candidates"))
    return rows.join(per.withColumnRenamed("unit", unit), unit, "left").withColumn("kind_candidates", F.coalesce("kind_candidates", F.array().cast("array<string>")))


def known_kinds(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that the lookup knows; all of them if it knows none."""
    lookup = known.select("kind").distinct()
    each = rows.withColumn("__id", F.monotonically_increasing_id())
    hit = each.select("__id", F.posexplode("kind_candidates").alias("i", "kind")).join(lookup, "kind", "left_semi").groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "kind"))), lambda x: x["kind"]).alias("__k"))
    return each.join(hit, "__id", "left").withColumn("kind_candidates", F.coalesce("__k", "kind_candidates")).drop("__id", "__k")


def units_of_kind(kinds: DataFrame) -> DataFrame:
    """(kind, units): a kind's units in the table's order, without repeats."""
    ok = kinds.where("trim(code) != '' AND lower(trim(code)) != 'nan'")
    return ok.groupBy("kind").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"])).alias("units"))


def fallback(rows: DataFrame, kinds: DataFrame, unit: str = "unit", preferred: Column | None = None) -> DataFrame:
    """rows with fallback_kind and fallback_units by the upper-case code: the first kind of a preferred
    set, else the first; units of all rows that match."""
    per = kinds.withColumn("upper", F.upper("code")).groupBy("upper").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "code"))).alias("hits"))
    out = rows.withColumn("upper", F.upper(U.unit_code(F.col(unit)))).join(per, "upper", "left").drop("upper")
    wanted = F.col("hits") if preferred is None else F.concat(F.filter("hits", lambda h: F.array_contains(preferred, h["kind"])), F.col("hits"))
    return out.withColumn("fallback_kind", F.get(wanted, F.lit(0))["kind"]).withColumn("fallback_units", F.array_distinct(F.transform("hits", lambda h: h["code"]))).drop("hits")


def normalize(rows: DataFrame, units: DataFrame, kinds: DataFrame, strategy: str = "quantulum3", chooser: Chooser | None = None, text: str | None = None, defaults: DataFrame | None = None) -> DataFrame:
    """rows (operator, v1, v2, tol, unit, ...) with kind, best_unit, SI values and bounds; rows of units
    that aren't known drop (`unresolved` lists them).

    Of several kinds of a unit the first counts, or the one that `chooser` picks by the column `text`;
    `defaults` (unit, kind) goes before both. The strategy "pipeline" scales the tolerance to the SI unit,
    "quantulum3" leaves it as it is.
    """
    if strategy not in ("pipeline", "quantulum3"):
        raise ValueError(f"{strategy!r} needs a language model: give its choice as `chooser` to \"pipeline\"")
    rows = rows.withColumn("unit_iri", U.unit_iri(F.col("unit")))
    rows = fallback(kinds_of(rows, kinds), kinds)
    first = F.get("kind_candidates", F.lit(0))
    if chooser is not None:
        first = chooser.choose(F.col("kind_candidates"), F.coalesce(F.col(text), F.lit("")) if text else F.lit(""))
    if defaults is not None:
        rows = rows.join(defaults.select(F.col("unit").alias("unit_iri"), F.col("kind").alias("default_kind")), "unit_iri", "left")
        first = F.coalesce("default_kind", first)
    rows = rows.withColumn("first", first).withColumn("kind", F.coalesce("first", "fallback_kind")).withColumn("best_unit", F.when(F.col("first").isNotNull(), F.col("unit_iri")).otherwise(U.unit_iri(F.get("fallback_units", F.lit(0)))))
    rows = rows.where("kind IS NOT NULL AND best_unit IS NOT NULL")
    dim = units.join(U.si_units(units, kinds), "unit", "left").select(F.col("unit").alias("best_unit"), "multiplier", "shift", "si_unit")
    rows = rows.join(dim, "best_unit", "left")
    has = F.col("si_unit").isNotNull()
    for v, to in (("v1", "si_v1"), ("v2", "si_v2")):
        rows = rows.withColumn(to, U.to_si(F.col(v), F.col("multiplier"), F.col("shift"), has))
    tol = U.tolerance_si(F.col("tol"), F.col("multiplier"), has) if strategy == "pipeline" else F.col("tol")
    rows = rows.withColumn("si_unit", F.coalesce("si_unit", "best_unit")).withColumn("b", U.bounds(F.col("operator"), F.col("si_v1"), F.col("si_v2"), tol))
    return rows.select("*", F.col("b.lower").alias("lower"), F.col("b.upper").alias("upper"), F.col("b.lower_included").alias("lower_included"), F.col("b.upper_included").alias("upper_included")).drop("b", "kind_candidates", "fallback_kind", "fallback_units", "multiplier", "shift", "unit_iri", "first", "default_kind")


def unresolved(rows: DataFrame, normalized: DataFrame, key: tuple[str, ...] = ("idx", "req_idx", "constraint_idx", "seq")) -> DataFrame:
    """The rows that no unit or kind was found for, with status and reason."""
    on = [k for k in key if k in rows.columns]
    left = rows.join(normalized.select(on), on, "left_anti")
    reason = F.when(U.unit_iri(F.col("unit")).isNull(), "no unit").otherwise("unknown unit")
    return left.withColumn("status", F.lit("failed")).withColumn("reason", reason)


def last_wins(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The row of the highest sequence number for each key; a grouped maximum, so nothing is sorted."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*key, "r.*")


def context(attribute: Column, evidence: Column, value: Column, fallback_text: Column) -> Column:
    """`attribute: ... ; evidence: ... ; value: ...`, the fallback only if all three are empty."""
    part = lambda k, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(k + ": "), F.trim(c)))
    return F.coalesce(F.nullif(F.concat_ws(" ; ", part("attribute", attribute), part("evidence", evidence), part("value", value)), F.lit("")), fallback_text)


def brief(rows: DataFrame, most: int = 50) -> DataFrame:
    """(idx, line) bullets of the first rows of each record, and a note if there are more."""
    w = Window.partitionBy("idx").orderBy("req_idx", "constraint_idx")
    numbered = rows.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("idx")))
    line = F.concat(F.lit("- req "), F.col("req_idx").cast("string"), F.lit(" c "), F.col("constraint_idx").cast("string"), F.lit(": "), F.col("operator"), F.lit(" "), F.coalesce("unit", F.lit("?")))
    return numbered.where(F.col("rn") <= most).select("idx", "rn", line.alias("line"), (F.col("n") > most).alias("truncated"))


def nearest(vectors: DataFrame, query: Column, k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, place, vec_id, label, cosine): for each row of vectors (vec_id, label, embedding) that
    passes `query` the k other rows nearest by cosine (six digits, ties by id).

    Queries and rows are dealt to blocks, and every two blocks meet in a task, which gives away the k best
    of each of its queries only. Null vectors and those of length 0 are in no pair.
    """
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL AND exists(v, x -> x != 0) AND forall(v, x -> x IS NOT NULL)")
    n = v.count()
    row_blocks, query_blocks = -(-n // block) or 1, -(-v.where(query).count() // block) or 1
    at = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = v.select(at(row_blocks).alias("rb"), every(query_blocks).alias("qb"), "vec_id", "label", "v")
    queries = v.where(query).select(every(row_blocks).alias("rb"), at(query_blocks).alias("qb"), "vec_id", "v")

    def go(left, right):
        import numpy as np
        import pyarrow as pa

        unit = lambda t: (lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True)))(np.array(t["v"].to_pylist()))
        out = []
        if len(left) and len(right):
            ids, labels, mine = left["vec_id"].to_numpy(), left["label"].to_pylist(), right["vec_id"].to_pylist()
            cosines = np.round(unit(right) @ unit(left).T, 6)
            for q, row in zip(mine, cosines, strict=True):
                order = np.lexsort((ids, -row))
                out += [(q, int(ids[i]), labels[i], float(row[i])) for i in order[: k + 1] if ids[i] != q]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), left.schema.field("label").type, pa.float64()), strict=True)], ["query_id", "vec_id", "label", "cosine"])

    label = vectors.schema["label"].dataType.simpleString()
    met = rows.groupBy("rb", "qb").cogroup(queries.groupBy("rb", "qb")).applyInArrow(go, f"query_id long, vec_id long, label {label}, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id"))
    return met.select("query_id", place.alias("place"), "vec_id", "label", "cosine").where(F.col("place") <= k)


def pick_rows(found: DataFrame, rows: DataFrame, label: str = "label") -> DataFrame:
    """found with `picked`, the label in the first place of its query, joined to the rows of that label."""
    pick = found.where("place = 1").select("query_id", F.col(label).alias("picked"))
    return found.join(pick, "query_id").join(rows.withColumnRenamed(label, "picked"), "picked", "left")
