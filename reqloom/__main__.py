"""python -m reqloom COMMAND: the batch from requirement texts to graphs and reports, evaluation reports,
samples, and the files that annotators work on. `python -m reqloom COMMAND -h` tells the arguments.

On a cluster set spark.checkpoint.dir (spark-submit --conf) to a folder that all executors share.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom import config
from reqloom.functions import text as X
from reqloom.operators import evaluate, sample
from reqloom.operators.pipeline import run_batch
from reqloom.schema import INPUT, RECORD
from reqloom.sources import jsonio, rdf, reports


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    config.method(a.method, "rule-based")
    for name, text in run_batch(spark, a.input, a.output, a.limit, a.run_id, a.qudt).items():
        reports.save(spark, text, f"{a.output}/{name}.md")
        print(text)


def evaluated(spark: SparkSession, a: argparse.Namespace) -> None:
    """Folders below input: judged, claims, missing, triples (Parquet)."""
    t = {n: spark.read.parquet(f"{a.input}/{n}") for n in ("judged", "claims", "missing", "triples")}
    reports.save(spark, reports.markdown("Evaluation report", evaluate.evaluation(**t)), a.output)


def agreed(spark: SparkSession, a: argparse.Namespace) -> None:
    """One folder of JSON files (level, label, item, rating) for each annotator."""
    schema = T.StructType().add("level", T.StringType()).add("label", T.StringType()).add("item", T.StringType()).add("rating", T.BooleanType())
    good = bad = None
    for folder in jsonio.folders(spark, a.input, a.prefix):
        g, b = jsonio.scan_checked(spark, f"{a.input}/{folder}", schema)
        g = g.withColumn("annotator", F.lit(folder))
        good, bad = (g, b) if good is None else (good.unionByName(g), bad.unionByName(b))
    sections = evaluate.agreement(good.select("level", "label", "item", "annotator", "rating"))
    reports.save(spark, reports.markdown("Inter-annotator agreement", sections | {"Files left out": bad.orderBy("file")}), a.output)


def compared(spark: SparkSession, a: argparse.Namespace) -> None:
    reports.save(spark, reports.markdown("Comparison of runs", evaluate.comparison(spark.read.json(f"{a.input}/history"))), a.output)


def sampled(spark: SparkSession, a: argparse.Namespace) -> None:
    """Requirements with a number and a unit, by unit family and length; sample, rest and manifest."""
    rows = jsonio.read_lines(spark, a.input, INPUT).withColumn("tok", X.unit_tokens(F.col("original_text"))).where(X.has_number_and_unit(F.col("tok")))
    pool = sample.with_stratum(rows.withColumn("family", X.unit_family(F.col("tok"))).drop("tok"), "original_text", "family").drop("bucket")
    taken = sample.stratified(pool, "idx", a.size, a.seed)
    jsonio.overwrite(taken.select("idx", "original_text"), f"{a.output}/sample")
    jsonio.overwrite(sample.split(pool, taken, "idx").select("idx", "original_text"), f"{a.output}/rest")
    jsonio.overwrite(sample.manifest(pool, taken, "idx", a.size), f"{a.output}/manifest")


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = jsonio.read_lines(spark, a.input, RECORD).select("idx", F.lit(None).cast("int").alias("req_idx"), F.to_json(F.struct("*")).alias("record"))
    jsonio.overwrite(jsonio.split_files(rows.withColumn("ordinal", F.monotonically_increasing_id()), f"{a.output}/files"), f"{a.output}/manifest")


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    jsonio.overwrite(jsonio.merge_files(spark, a.input, T.StructType().add("idx", T.LongType()).add("req_idx", T.IntegerType()).add("record", T.StringType())), a.output)


def to_turtle(spark: SparkSession, a: argparse.Namespace) -> None:
    """RDF files of any syntax as lines of Turtle; a file that can't be read is an error."""
    files = rdf.read(spark, a.input, a.pattern).select(F.xxhash64("path").alias("graph_id"), "text")
    t = rdf.parse(files)
    bad = t.where("error IS NOT NULL").select("error").first()
    if bad:
        raise SystemExit(bad["error"])
    rdf.write(t.drop("error"), a.output)


COMMANDS = {"run": run, "evaluate": evaluated, "agreement": agreed, "compare": compared, "sample": sampled, "split": split, "merge": merge, "to-turtle": to_turtle}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="reqloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        c = commands.add_parser(name, help=(f.__doc__ or "").strip().split("\n")[0])
        c.add_argument("input")
        c.add_argument("output")
        if name == "run":
            c.add_argument("--limit", type=int)
            c.add_argument("--run-id", default="run")
            c.add_argument("--method", help="of extraction; without a language model rule-based")
            c.add_argument("--qudt", help="ontology file of units and quantity kinds")
        elif name == "sample":
            c.add_argument("--size", type=int, default=100)
            c.add_argument("--seed", type=int, default=42)
        elif name == "agreement":
            c.add_argument("--prefix", default="ground_truth_extraction_items")
        elif name == "to-turtle":
            c.add_argument("--pattern", default="*")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command](SparkSession.builder.appName("reqloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
