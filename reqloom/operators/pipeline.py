"""The batch from requirement texts to graphs and reports: extraction, normalization, grounding by the
template, conformance. Each stage is a table; a row's failure is a status, not an exception."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions import scalars as S
from reqloom.functions import units as U
from reqloom.operators import evaluate as V
from reqloom.operators import extract as E
from reqloom.operators import graph as G
from reqloom.operators import normalize as N
from reqloom.schema import INPUT
from reqloom.sources import jsonio, qudt, rdf, reports
from reqloom.vocab import IOF


def with_idx(rows: DataFrame) -> DataFrame:
    """idx as a number; rows without one get a number of their own after all others."""
    spare = F.lit(1 << 40) + F.monotonically_increasing_id()
    return rows.withColumn("idx", S.coerce_idx(F.col("idx"), spare))


def graph_rows(normalized: DataFrame) -> DataFrame:
    """Normalized quantities as the template takes them."""
    return normalized.select(
        F.col("idx").alias("graph_id"), "req_idx", F.col("constraint_idx").alias("j"), "subject", "attribute", "has_condition", F.col("best_unit").alias("unit"), "kind",
        "lower", "upper", "lower_included", "upper_included", F.col("si_v1").alias("value"),
    )


def ground(extracted: DataFrame, normalized: DataFrame) -> DataFrame:
    """Triples of every record: its requirements and, where it has them, its quantities."""
    texts = extracted.where("status = 'ok'").select(F.col("idx").alias("graph_id"), F.transform("record.requirements", lambda r: r["raw_text"]).alias("texts"), "original_text")
    return G.insert(G.minimal(texts), G.instantiate(graph_rows(normalized)))


def run_batch(spark: SparkSession, source: str, target: str, limit: int | None = None, run_id: str = "run", qudt_file: str | None = None) -> dict[str, str]:
    """Reads JSON Lines of (idx, original_text); writes extraction, normalization, what of it found no unit
    and graphs below the target folder, keeps the run's figures in its history and returns the texts of
    the quality report and of the conformance of its graphs. Units come from the ontology file, if one is
    given, else from the built-in table."""
    began = time.time()
    rows = with_idx(jsonio.read_lines(spark, source, INPUT, limit))
    E.extract(rows).write.mode("overwrite").parquet(f"{target}/extraction")
    extracted = spark.read.parquet(f"{target}/extraction")
    units, kinds = qudt.read_graph(spark, qudt_file) if qudt_file else (U.units(spark), U.unit_kinds(spark))
    quantities = E.quantity_rows(extracted)
    N.normalize(quantities, units, kinds).write.mode("overwrite").parquet(f"{target}/normalization")
    normalized = spark.read.parquet(f"{target}/normalization")
    N.unresolved(quantities, normalized).write.mode("overwrite").parquet(f"{target}/unresolved")
    ground(extracted, normalized).write.mode("overwrite").parquet(f"{target}/triples")
    triples = spark.read.parquet(f"{target}/triples")
    rdf.write(triples, f"{target}/graphs")
    outcome = write_reasoned(triples, inferred, f"{target}/reasoned")
    logs = stage_logs(extracted, normalized, triples, outcome)
    figures = V.run_figures(logs["extraction"], logs["normalization"], logs["grounding"], run_id, round(time.time() - began, 3))
    jsonio.upsert(spark, figures, f"{target}/history", "run_id")
    history = spark.read.schema(figures.schema).json(f"{target}/history")
    checks = G.conformance_summary(G.conformance(triples), triples.select("graph_id"))
    return {"quality": reports.markdown("Quality report", V.quality(logs, history.where(F.col("run_id") == run_id), history)), "conformance": reports.markdown("Conformance", {"Checks": checks})}


def stage_logs(extracted: DataFrame, normalized: DataFrame, triples: DataFrame, outcome: str) -> dict[str, DataFrame]:
    """One log a stage, a row a record: a record that failed or was skipped in a stage is skipped in the
    next ones. outcome: what `write_reasoned` says of the graphs."""
    none, seconds = F.lit(None).cast("string"), F.lit(None).cast("double").alias("seconds")
    quantity = F.aggregate("record.requirements", F.lit(0), lambda s, r: s + F.size(F.filter(r["constraints"], lambda c: c["value"]["kind"] == "quantity")))
    e = extracted.select("idx", "status", "reason", F.coalesce(F.size("record.requirements"), F.lit(0)).cast("bigint").alias("n_requirements"), F.coalesce(quantity, F.lit(0)).cast("bigint").alias("n_constraints"), seconds)
    n = e.join(normalized.groupBy("idx").agg(F.count("*").alias("n_normalized")), "idx", "left").withColumn("n_normalized", F.coalesce("n_normalized", F.lit(0)))
    skipped = F.col("status") != "ok"
    failed = (F.col("n_constraints") > 0) & (F.col("n_normalized") == 0)
    status, reason = F.when(skipped, "skipped").when(failed, "failed").otherwise("ok"), F.when(skipped, F.concat(F.lit("extraction_"), "status")).when(failed, "no unit was found").otherwise(none)
    n = n.select("idx", status.alias("status"), reason.alias("reason"), "n_normalized", "seconds")
    has = triples.select(F.col("graph_id").alias("idx"), F.lit(True).alias("has_graph")).distinct()
    g = e.join(has, "idx", "left").withColumn("has_graph", F.coalesce("has_graph", F.lit(False)))
    g = g.select("idx", F.when(skipped, "skipped").when(F.col("has_graph"), "ok").otherwise("failed").alias("status"), F.when(skipped, F.concat(F.lit("extraction_"), "status")).alias("reason"), "has_graph", (F.col("has_graph") & F.lit(outcome == "inferred")).alias("has_inferred"), "seconds")
    return {"extraction": e, "normalization": n, "grounding": g}


#: Inverse properties of the template's graphs.
INVERSES = ((IOF + "requirementSatisfiedBy", IOF + "satisfiesRequirement"), (IOF + "hasContinuantPartAtAllTimes", IOF + "continuantPartOfAtAllTimes"))


def inferred(asserted: DataFrame) -> DataFrame:
    """What the inverse properties add."""
    return G.with_inverses(asserted, asserted.sparkSession.createDataFrame(list(INVERSES), "p string, q string"))


def write_reasoned(asserted: DataFrame, infer, path: str) -> str:
    """The reasoned artifact below path, or the asserted graph where inference fails: "inferred" or
    "asserted: <error>". `infer` gives the inferred triples of a table of triples."""
    try:
        G.reasoned_artifact(asserted, infer(asserted)).write.mode("overwrite").parquet(path)
        return "inferred"
    except Exception as e:  # the record keeps its own graph and the log says why
        asserted.select(G.KEY).write.mode("overwrite").parquet(path)
        return f"asserted: {type(e).__name__}"
