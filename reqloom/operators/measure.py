"""Batch reports: completion, fidelity, failures, latency, ground truth and annotator agreement.

All are one-pass conditional aggregates; percentiles are exact nearest ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions.scalars import count_where, ratio, rounded, stats

EXTERNAL = ("HTTP response code", "Could not load imported ontology", "UnloadableImportException", "OWLOntologyCreationIOException", "Connection", "timeout")


def is_external(reason: Column) -> Column:
    hit = F.lit(False)
    for x in EXTERNAL:
        hit = hit | F.coalesce(reason, F.lit("")).contains(x)
    return hit


def status_distribution(rows: DataFrame, status: str = "status", missing: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(status, F.lit(missing)).alias("status")).agg(F.count("*").alias("n"))


def latency(rows: DataFrame, by: str, seconds: str = "seconds") -> DataFrame:
    return rows.groupBy(by).agg(*stats(seconds))


def failures(rows: DataFrame) -> DataFrame:
    ok, failed = F.col("status") == "ok", F.col("status") == "failed"
    out = rows.agg(count_where(ok).alias("n_ok"), count_where(failed).alias("n_failed"), count_where(failed & is_external(F.col("reason"))).alias("n_external"))
    done = F.col("n_ok") + F.col("n_failed")
    return out.select("*", rounded(ratio(F.col("n_failed"), done)).alias("failed_rate"), rounded(ratio(F.col("n_external"), done)).alias("external_rate"))


def completion(extraction: DataFrame, normalization: DataFrame, grounding: DataFrame) -> DataFrame:
    """Success counts of the stages and rates on the previous stage's successes. grounding has the
    columns has_graph and has_inferred beside status."""
    n = lambda df, c="status = 'ok'": df.agg(count_where(F.expr(c)).alias("ok"), F.count("*").alias("n"))
    e, m, g = n(extraction), n(normalization), n(grounding, "status = 'ok' AND has_graph AND has_inferred")
    all_ = e.select(F.col("n").alias("n_input"), F.col("ok").alias("n_extracted")).withColumn("n_normalized", m.select("ok").scalar()).withColumn("n_end_to_end", g.select("ok").scalar())
    return all_.select("*", rounded(ratio(F.col("n_extracted"), F.col("n_input"))).alias("extraction_rate"), rounded(ratio(F.col("n_normalized"), F.col("n_extracted"))).alias("normalization_rate"), rounded(ratio(F.col("n_end_to_end"), F.col("n_input"))).alias("end_to_end_rate"))


def fidelity(rows: DataFrame) -> DataFrame:
    """rows: idx, n_constraints, constraint_idx, best_unit, si_unit - one for each normalized quantity."""
    valid = F.col("constraint_idx").between(0, F.col("n_constraints") - 1)
    unit = (F.trim(F.coalesce("best_unit", F.lit(""))) != "") | (F.trim(F.coalesce("si_unit", F.lit(""))) != "")
    out = rows.agg(F.count("*").alias("n"), count_where(valid).alias("n_valid"), count_where(unit).alias("n_with_unit"))
    return out.select("*", rounded(ratio(F.col("n_valid"), F.col("n"))).alias("index_integrity"), rounded(ratio(F.col("n_with_unit"), F.col("n"))).alias("unit_completeness"))


def bool_accuracy(c: Column) -> list[Column]:
    """Correct, judged and accuracy of a nullable boolean; nulls are neither."""
    return [count_where(c), F.count(c).cast("bigint"), rounded(ratio(count_where(c), F.count(c)))]


SLOTS = ("subject", "modality", "condition", "action", "object")


def slot_accuracies(rows: DataFrame, conditional: bool = False) -> DataFrame:
    """Accuracy of each structure slot; conditional: only rows whose decomposition was judged right."""
    if conditional:
        rows = rows.where("decomposition_error = false")
    pairs = ", ".join(f"'{s}', {s}_correct" for s in SLOTS)
    long = rows.select(F.expr(f"stack({len(SLOTS)}, {pairs}) AS (slot, ok)"))
    a, b, c = bool_accuracy(F.col("ok"))
    return long.groupBy("slot").agg(a.alias("correct"), b.alias("judged"), c.alias("accuracy"))


def macro_accuracy(slots: DataFrame) -> DataFrame:
    """The mean of the rounded accuracies that are known."""
    return slots.agg(F.count("accuracy").alias("n_slots"), rounded(F.avg(F.round("accuracy", 6))).alias("macro_accuracy"))


def quantity_quality(rows: DataFrame) -> DataFrame:
    """Precision over judged quantities, recall with the missing ones; parts only of true quantities."""
    true = F.col("is_true")
    parts = [x for k in ("operator", "value", "unit") for x in (count_where(true & F.col(f"{k}_correct")).alias(f"{k}_ok"), F.count(F.when(true, F.col(f"{k}_correct"))).alias(f"{k}_judged"))]
    out = rows.agg(count_where(true).alias("n_true"), F.count("is_true").alias("n_judged"), F.sum("n_missing").alias("n_missing"), *parts)
    return out.select("*", rounded(ratio(F.col("n_true"), F.col("n_judged"))).alias("precision"), rounded(ratio(F.col("n_true"), F.col("n_true") + F.col("n_missing"))).alias("recall"))


def claim_quality(predicted: DataFrame, missing: DataFrame) -> DataFrame:
    """predicted: supported (nullable boolean); missing: s, p, o of gold claims, blank ones ignored."""
    p = predicted.agg(count_where(F.col("supported")).alias("tp"), count_where(~F.col("supported")).alias("fp"), F.count("supported").alias("annotated"), F.count("*").alias("total"))
    filled = (F.trim("s") != "") & (F.trim("p") != "") & (F.trim("o") != "")
    both = p.withColumn("fn", missing.agg(count_where(filled)).scalar())
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return both.select("tp", "fp", "fn", "annotated", "total", rounded(precision).alias("precision"), rounded(recall).alias("recall"), rounded(F.when(precision + recall != 0, 2 * precision * recall / (precision + recall))).alias("f1"), rounded(ratio(F.col("annotated"), F.col("total"))).alias("coverage"))


# --- agreement -----------------------------------------------------------------------------------


def _items(ratings: DataFrame) -> DataFrame:
    known = ratings.where("rating IS NOT NULL")
    return known.groupBy("label", "item").agg(count_where(F.col("rating")).alias("t"), count_where(~F.col("rating")).alias("f"))


def agreement(ratings: DataFrame) -> DataFrame:
    """Pairwise agreement and Krippendorff's alpha (nominal, two values) of each label, in closed form.

    ratings: label, item, annotator, rating (nullable boolean), one row a rating.
    """
    n = F.col("t") + F.col("f")
    pair = lambda x: x * (x - 1) / 2
    many = n >= 2
    out = _items(ratings).groupBy("label").agg(
        F.count("*").alias("rated_items"), count_where(many).alias("items_with_2plus"), F.max(n).alias("max_raters"),
        F.sum(pair(F.col("t")) + pair(F.col("f"))).cast("bigint").alias("agreeing_pairs"), F.sum(pair(n)).cast("bigint").alias("total_pairs"),
        F.sum(F.when(many, n)).alias("pairable"), F.sum(F.when(many, F.col("t"))).alias("st"), F.sum(F.when(many, F.col("f"))).alias("sf"),
        F.sum(F.when(many, F.round(2 * F.col("t") * F.col("f") / (n - 1), 9))).alias("off"),
    )
    observed = F.col("off") / F.col("pairable")
    expected = 2.0 * F.col("st") * F.col("sf") / (F.col("pairable") * (F.col("pairable") - 1))
    alpha = F.when((F.col("pairable") > 1) & (expected != 0), 1 - observed / expected)
    return out.select("label", "rated_items", "items_with_2plus", "max_raters", "agreeing_pairs", "total_pairs", rounded(ratio(F.col("agreeing_pairs"), F.col("total_pairs"))).alias("agreement"), rounded(alpha).alias("alpha"))


def kappas(ratings: DataFrame) -> DataFrame:
    """Cohen's kappa of each pair of annotators that share items."""
    known = ratings.where("rating IS NOT NULL").select("label", "item", "annotator", F.col("rating").cast("int").alias("r"))
    a = known.select("label", "item", F.col("annotator").alias("a"), F.col("r").alias("ra"))
    b = known.select("label", "item", F.col("annotator").alias("b"), F.col("r").alias("rb"))
    per = a.join(b, ["label", "item"]).where("a < b").groupBy("label", "a", "b").agg(F.count("*").alias("n"), count_where(F.col("ra") == F.col("rb")).alias("same"), F.sum("ra").alias("ta"), F.sum("rb").alias("tb"))
    n, po = F.col("n"), F.col("same") / F.col("n")
    pe = (F.col("ta") * F.col("tb") + (n - F.col("ta")) * (n - F.col("tb"))) / (n * n)
    return per.select("label", "a", "b", "n", "same", F.when(pe != 1, rounded((po - pe) / (1 - pe))).alias("kappa"))


def kappa_summary(pairs: DataFrame) -> DataFrame:
    k = F.col("kappa")
    weight = F.when(k.isNotNull(), F.col("n"))
    return pairs.groupBy("label").agg(F.count("kappa").alias("pairs"), rounded(F.round(F.sum(k * F.col("n")), 6) / F.sum(weight)).alias("weighted_kappa"), F.min("kappa").alias("least"), F.max("kappa").alias("most"))


def annotator_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("label", "annotator").agg(F.count("rating").alias("rated"), count_where(F.col("rating")).alias("n_true"), count_where(~F.col("rating")).alias("n_false"))


def group_means(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count("*").alias("labels"), rounded(F.avg("agreement")).alias("mean_agreement"), rounded(F.avg("alpha")).alias("mean_alpha"))
