"""A corpus from raw documents to tokens: five stages, each written as a table before the next.

Every stage but the last returns the columns of its documents. Rows are told apart by all their columns,
so repeated ids are no trouble; rows that are equal in all columns count as copies of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm import bpe, mixing, secrets, simhash, toxicity
from reqloom.llm.common import materialize, partitions, prepare


def _row_key(docs: DataFrame) -> Column:
    """Orders rows by doc_id, nulls last; equal for rows that are equal."""
    return F.struct(F.col("doc_id").isNull().alias("x"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(*docs.columns).alias("h"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model grades as toxic go; it is fitted on the labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.predict(docs, model).where("NOT toxic").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 at least) the document of the least
    id stays. At 0.8 about 10 of 64 bits of a SimHash fingerprint differ, so the stage has wider
    fingerprints and an index of more segments than op6's query, and settles what it links on the exact
    sets of shingles."""
    keyed = docs.withColumn("__key", _row_key(docs))
    kept = materialize(simhash.near_groups(keyed, "__key").select(F.col("component").alias("__key")).distinct(), "kept")
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; n_chars follows the text. Each distinct text is scanned once."""
    findings, _ = secrets.scan(docs)
    held = secrets.findings_by_path(docs, materialize(findings, "findings"), name="__spans")
    text = secrets.redact(F.col("text"), F.col("__spans"))
    hit = F.size("__spans") > 0
    return held.withColumns({"text": text, "n_chars": F.when(hit, F.length(text).cast("long")).otherwise(F.col("n_chars"))}).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' shares, written in the order of the schedule's slots: a document comes once for each
    time that the mix takes it, with its first words only where the mix takes no more. What the mix takes
    no word of is left out. Files hold runs of slots, in order. Rows of null texts or of blanks only have
    no words and are left out; a null source is a source."""
    keyed = docs.withColumn("__key", _row_key(docs))
    taken = mixing.occurrences(keyed, "__key")[1].select(F.col("k0").alias("__key"), F.col("size").alias("__size"), F.col("words").alias("__words"), F.col("first_slot").alias("__slot"))
    taken = materialize(taken, "taken")
    out = keyed.dropDuplicates(["__key"]).join(taken, "__key")
    parts = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.col("__words") < F.col("__size")
    text = F.when(part, F.array_join(F.slice(parts, F.lit(1), F.col("__words").cast("int")), "")).otherwise(F.col("text"))
    out = out.withColumns({"text": text, "n_chars": F.when(part, F.length(text).cast("long")).otherwise(F.col("n_chars"))})
    slots, files = (taken.agg(F.max("__slot")).first()[0] or 0) + 1, partitions(spark)
    at = F.floor(F.col("__slot") * files / slots).cast("int")
    return out.repartitionById(files, at).sortWithinPartitions("__slot", "__key").select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding, as digests, for every document of the mix."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]
#: The toxicity model isn't SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
