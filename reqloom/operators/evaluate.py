"""The four reports: a run's quality, its evaluation against ground truth, annotators' agreement and the
comparison of runs. Each is a dict of small tables by section; `sources.reports` writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqloom.functions import scalars as S
from reqloom.operators import graph as G
from reqloom.operators import measure as M


def run_figures(extraction: DataFrame, normalization: DataFrame, grounding: DataFrame, run_id: str, seconds: float | None = None) -> DataFrame:
    """One row for the history of runs. extraction: status, n_requirements, n_constraints; normalization:
    status, n_normalized; grounding: status, has_graph, has_inferred, reason."""
    done = M.completion(extraction, normalization, grounding)
    sums = extraction.agg(F.coalesce(F.sum("n_requirements"), F.lit(0)).alias("requirements"), F.coalesce(F.sum("n_constraints"), F.lit(0)).alias("quantity_constraints"))
    failed = M.failures(grounding)
    out = done.select(F.lit(run_id).alias("run_id"), "*")
    for df, names in ((sums, ("requirements", "quantity_constraints")), (failed, ("n_failed", "n_external", "failed_rate", "external_rate"))):
        for c in names:
            out = out.withColumn(c, df.select(c).scalar())
    out = out.withColumn("normalized", normalization.agg(F.coalesce(F.sum("n_normalized"), F.lit(0))).scalar())
    duration = F.lit(seconds).cast("double")
    return out.withColumn("coverage", S.rounded(S.ratio(F.col("normalized"), F.col("quantity_constraints")))).withColumn("duration", duration).withColumn("throughput", S.rounded(S.ratio(F.col("n_input") * 60, duration)))


def quality(stages: dict[str, DataFrame], figures: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """Sections of the quality report; stages: logs (status, seconds) by name."""
    one = lambda f: _stacked({k: f(v) for k, v in stages.items()}, "stage")
    return {
        "Summary": long(figures),
        "Latency": one(lambda df: df.agg(*S.stats("seconds"))),
        "Status distributions": one(M.status_distribution).orderBy("stage", "status"),
        "Robustness": robustness(history),
    }


def robustness(history: DataFrame, metrics: tuple[str, ...] = ("end_to_end_rate", "coverage", "failed_rate", "external_rate", "throughput")) -> DataFrame:
    """Spread of the runs' figures over the history."""
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    rows = history.select(F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, v)"))
    return rows.groupBy("metric").agg(F.count("v").alias("runs"), F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("metric")


def evaluation(judged: DataFrame, claims: DataFrame, missing: DataFrame, triples: DataFrame) -> dict[str, DataFrame]:
    """Sections of the evaluation report. judged: one row a record with decomposition_error,
    <slot>_correct, is_true, operator_correct, value_correct, unit_correct, n_missing."""
    e = F.col("decomposition_error")
    errors, n, rate = M.bool_accuracy(e)
    decomposition = judged.agg(S.count_where(~e).alias("correct"), errors.alias("errors"), n.alias("judged"), rate.alias("error_rate"), S.rounded(S.ratio(S.count_where(~e), F.count(e))).alias("accuracy"))
    checks = G.conformance(triples)
    graphs = triples.select("graph_id").distinct()
    bad = checks.select("graph_id").distinct().withColumn("bad", F.lit(1))
    passing = graphs.join(bad, "graph_id", "left").agg(F.count("*").alias("graphs"), S.count_where(F.col("bad").isNull()).alias("passing")).withColumn("passing_rate", S.rounded(S.ratio(F.col("passing"), F.col("graphs"))))

    def slots(conditional: bool) -> DataFrame:
        per = M.slot_accuracies(judged, conditional)
        macro = M.macro_accuracy(per).select(F.lit("macro").alias("slot"), F.lit(None).cast("bigint").alias("correct"), F.lit(None).cast("bigint").alias("judged"), F.col("macro_accuracy").alias("accuracy"))
        return per.unionByName(macro).orderBy(F.col("slot") == "macro", "slot")

    return {
        "Decomposition": long(decomposition),
        "Structure": slots(False),
        "Structure given a right decomposition": slots(True),
        "Quantities": long(M.quantity_quality(judged)),
        "Claims": long(M.claim_quality(claims, missing)),
        "Conformance": long(passing),
        "Violations by check": G.conformance_summary(checks, graphs).orderBy("check_id"),
    }


def agreement(ratings: DataFrame, level: str = "level") -> dict[str, DataFrame]:
    """Sections of the agreement report. ratings: level, label, item, annotator, rating; a level is a
    group of labels (requirements, quantities)."""
    out: dict[str, DataFrame] = {}
    for name in [r[0] for r in ratings.select(level).distinct().orderBy(level).limit(100).collect()]:
        mine = ratings.where(F.col(level).eqNullSafe(F.lit(name)))
        labels, pairs = M.agreement(mine), M.kappas(mine)
        out[f"{name}: all labels"] = long(M.group_means(labels))
        out[f"{name}: labels"] = labels.join(M.kappa_summary(pairs), "label", "left").orderBy("label")
        out[f"{name}: pairs of annotators"] = pairs.orderBy("label", "a", "b")
        out[f"{name}: ratings by annotator"] = M.annotator_counts(mine).orderBy("label", "annotator")
    return out


def comparison(history: DataFrame) -> dict[str, DataFrame]:
    """Runs side by side, best first; a history has as many rows as there were runs."""
    place = F.row_number().over(Window.orderBy(F.col("end_to_end_rate").desc_nulls_last(), "run_id"))
    return {"Runs": history.select(place.alias("place"), "run_id", "n_input", "n_extracted", "n_normalized", "n_end_to_end", "end_to_end_rate", "coverage", "failed_rate", "throughput").orderBy("place")}


def long(row: DataFrame) -> DataFrame:
    """(measure, value) from a table of one row."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in row.columns)
    return row.select(F.expr(f"stack({len(row.columns)}, {pairs}) AS (measure, value)"))


def _stacked(tables: dict[str, DataFrame], name: str) -> DataFrame:
    out = None
    for k, df in tables.items():
        df = df.select(F.lit(k).alias(name), "*")
        out = df if out is None else out.unionByName(df)
    return out
