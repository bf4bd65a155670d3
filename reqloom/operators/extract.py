"""Rule-based extraction of records from requirement texts, as Column expressions.

Grammar is approximated: subject, action and object are the text before the modal word, the modal word
with the next one, and the rest. Extraction by language models is a hook (`Extractor`), never simulated.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions import text as X
from reqloom.schema import CONSTRAINT, MODALITIES, RECORD


class Extractor(Protocol):
    """Adds a column `record` (schema.RECORD) to a table of texts."""

    def extract(self, df: DataFrame, text: str, idx: str) -> DataFrame: ...


_MODAL = r"(?Ui)\b(?:" + "|".join(MODALITIES) + r")\b"


def structure(t: Column) -> Column:
    """Struct of subject, modality, condition, action and object."""
    none = X.make_span(t, F.lit(0), F.lit(0))

    def parts(p):
        cond, left = p["cond"], p["left"]
        # the modal word of the main clause: the first one after a condition that opens the text
        main = lambda found: F.get(F.filter(found, lambda m: m["start"] >= left), F.lit(0))
        modal, after = main(p["modals"]), main(p["afters"])
        start, end = F.coalesce(modal["start"], F.lit(0)), F.coalesce(after["end"], modal["end"], F.lit(0))
        subject = F.when(start > left, X.make_span(t, left, start - 1)).otherwise(none)
        action = F.when(modal.isNotNull(), X.make_span(t, start, end)).otherwise(none)
        rest = F.when(end < F.length(t), X.make_span(t, end + 1, F.length(t))).otherwise(none)
        return F.struct(subject.alias("subject"), X.modality(t).alias("modality"), cond.alias("condition"), action.alias("action"), rest.alias("object"))

    def with_left(cond):
        left = F.when(cond["present"] & (cond["start"] == 0), F.least(cond["end"] + 2, F.length(t))).otherwise(F.lit(0))
        return F.struct(X.matches(t, _MODAL).alias("modals"), X.matches(t, _MODAL + r"(?:\s+not)?\s+\w+").alias("afters"), cond.alias("cond"), left.alias("left"))

    return X.let(X.let(X.condition(t), with_left), parts)


def attribute(t: Column, start: Column) -> Column:
    """Of the word groups that stand before a modal word, the nearest one before the evidence."""
    before = X.clean_text(F.substr(t, F.lit(1), start))
    words = F.regexp_extract_all(before, F.lit(r"(?U)((?:\b(?:a|an|the)\s+)?\b[a-z]+)\s+(?:" + "|".join(MODALITIES) + r")\b"), F.lit(1))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("quantitative attribute"))


def _constraint(i: Column, op: Column, start: Column, end: Column, t: Column, snippet: Column, value: Column, ref: Column) -> Column:
    return F.struct(
        i.cast("int").alias("constraint_idx"), F.struct(F.concat(F.lit("g"), i.cast("string")).alias("group_id"), F.lit("AND").alias("relation")).alias("group"),
        F.struct(F.lit("object").alias("kind"), F.when(ref != "", ref).alias("ref")).alias("target"), X.make_span(t, start, end).alias("evidence"),
        F.struct(attribute(t, start).alias("name"), F.lit("quantity").alias("kind")).alias("attribute"), op.alias("operator"),
        F.struct(F.lit("quantity").alias("kind"), snippet.alias("raw_text"), value.alias("quantity"), F.lit(None).alias("enum"), F.lit(None).cast("boolean").alias("boolean"), F.lit(None).alias("ref")).alias("value"),
        F.lit(None).cast("int").alias("depends_on"), F.struct(F.lit(False).alias("negated"), F.lit(False).alias("preferred"), F.lit(False).alias("scope_all")).alias("qualifiers"),
    ).cast(CONSTRAINT)


def _value(op: Column, found: Column, snippet: Column) -> Column:
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    two = (op == "between") & (F.size(found) >= 2)
    return F.struct(first["value"].alias("v1"), F.when(two, second["value"]).alias("v2"), F.lit(None).cast("double").alias("tol"), X.unit_text(snippet, first["unit"]).alias("unit_text"))


def constraints(t: Column, ref: Column) -> Column:
    """Comparisons first, then bare quantities (operator eq) outside of them that aren't noise."""

    def comparison(m):
        snippet = X.sanitize_quantity(m["text"])
        return X.let(snippet, lambda s: F.struct(m["operator"].alias("operator"), m["start"].alias("start"), m["end"].alias("end"), s.alias("snippet"), X.quantities(s).alias("found")))

    compared = F.filter(F.transform(X.constraint_matches(t), comparison), lambda c: F.size(c["found"]) > 0)

    def bare(m):
        def judged(p):
            noisy = X.is_noise(t, m["start"], m["end"], m["text"], F.get(p["found"], F.lit(0))["unit"], False)
            return F.struct(F.when(~noisy, "eq").alias("operator"), m["start"].alias("start"), m["end"].alias("end"), p["snippet"].alias("snippet"), p["found"].alias("found"))

        return X.let(X.let(X.sanitize_quantity(m["text"]), lambda s: F.struct(s.alias("snippet"), X.quantities(s).alias("found"))), judged)

    def joined(compared):
        rest = F.filter(F.transform(X.matches(t, X.NUMBER + r"\s*" + X.UNIT_WORD), bare), lambda b: b["operator"].isNotNull() & (F.size(b["found"]) > 0))
        rest = F.filter(rest, lambda b: ~F.exists(compared, lambda c: X.overlaps(c, b)))
        return F.transform(F.concat(compared, rest), lambda c, i: _constraint(i, c["operator"], c["start"], c["end"], t, c["snippet"], _value(c["operator"], c["found"], c["snippet"]), ref))

    return X.let(compared, joined)


def extract(df: DataFrame, text: str = "original_text", idx: str = "idx", rank: int = 0) -> DataFrame:
    """df with status, reason and record; blank texts are skipped, not failed.

    The record has one requirement: the candidate of the given rank (clamped).
    """
    blank = F.coalesce(F.btrim(F.col(text), F.lit(" \n\t\r")), F.lit("")) == ""
    best = X.let(X.candidates(F.col(text)), lambda c: F.get(c, F.least(F.lit(max(rank, 0)), F.size(c) - 1)))

    def requirement(t):
        def of(s):
            return F.struct(F.lit(0).alias("req_idx"), s.alias("structure"), constraints(t, s["object"]["text"]).alias("constraints"), F.array().alias("references"), t.alias("raw_text"), F.lit(None).alias("normalized_quantities"))

        return X.let(structure(t), of)

    t = F.col("__t")
    record = F.struct(F.col(idx).cast("bigint").alias("idx"), F.lit(None).alias("source"), t.alias("original_text"), F.array(requirement(t)).alias("requirements")).cast(RECORD)
    # texts are few bytes and much work: they are dealt to all cores, however few splits their table has
    spark = df.sparkSession
    df = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    # one-element explodes: what stands above reads the record's fields without computing it anew for each
    out = df.withColumn("__t", F.explode(F.array(F.when(~blank, best)))).withColumn("record", F.explode(F.array(F.when(~blank, record)))).drop("__t")
    return out.withColumn("status", F.when(blank, "skipped").otherwise("ok")).withColumn("reason", F.when(blank, "missing_original_text"))


class RuleBasedExtractor:
    def __init__(self, rank: int = 0):
        self.rank = rank

    def extract(self, df: DataFrame, text: str = "original_text", idx: str = "idx") -> DataFrame:
        return extract(df, text, idx, self.rank)


def quantity_rows(df: DataFrame) -> DataFrame:
    """One row a quantity constraint that can be normalized: (idx, req_idx, constraint_idx, operator, v1,
    v2, tol, unit, attribute, subject, has_condition, evidence)."""
    r = df.where("status = 'ok'").select("idx", F.explode("record.requirements").alias("r")).select("idx", "r", F.explode("r.constraints").alias("c"))
    q = F.col("c.value.quantity")
    ok = (F.col("c.value.kind") == "quantity") & q["v1"].isNotNull() & (F.coalesce(q["unit_text"], F.lit("")) != "")
    return r.where(ok).select(
        "idx", "r.req_idx", "c.constraint_idx", "c.operator", q["v1"].alias("v1"), q["v2"].alias("v2"), q["tol"].alias("tol"), q["unit_text"].alias("unit"),
        F.col("c.attribute.name").alias("attribute"), F.col("r.structure.subject.text").alias("subject"), F.col("r.structure.condition.present").alias("has_condition"), F.col("c.evidence.text").alias("evidence"),
    )


def span_errors(df: DataFrame) -> DataFrame:
    """Constraints whose evidence isn't the text at its offsets."""
    r = df.where("status = 'ok'").select("idx", F.explode("record.requirements").alias("r")).select("idx", F.col("r.raw_text").alias("t"), F.explode("r.constraints").alias("c"))
    return r.where(F.expr("substring(t, c.evidence.start + 1, c.evidence.end - c.evidence.start) != c.evidence.text"))
