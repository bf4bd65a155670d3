"""JSON Lines and JSON files: strict, optional and lenient scans; append, overwrite and upsert sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """A strict scan: blank lines are skipped, a bad line or one that isn't an object fails the job, a
    missing file is an error. `limit` takes the first of what is left of the lines, by file and place."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if limit is None:
        return df
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return df.select("*", *[c.alias(f"__{i}") for i, c in enumerate(place)]).orderBy("__0", "__1", "__2").limit(limit).drop("__0", "__1", "__2")


def exists(spark: SparkSession, path: str) -> bool:
    """Also for stores that only the engine reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A missing file has no rows."""
    return read_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def lenient(text: Column, schema: T.StructType) -> Column:
    """An object from text; null fields where it is missing, no object or no JSON."""
    return F.from_json(F.coalesce(text, F.lit("{}")), schema, {"mode": "PERMISSIVE"})


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, then new; rows without a key replace each other."""
    keys = new.select(F.col(key).alias("__k")).distinct()
    kept = old.join(keys, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str) -> None:
    """Rewrites the history at path: the new one is written whole beside it and then takes its place, so a
    crash at any moment leaves the old or the new rows, at path or beside it."""
    beside, gone = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not exists(spark, path):  # what a crash between the two renames has left
        for left in (beside, gone):
            if exists(spark, f"{left}/_SUCCESS") and not exists(spark, path):
                fs.rename(hadoop.Path(left), hadoop.Path(path))
    overwrite(upserted(read_optional(spark, path, new.schema), new, key), beside)
    fs.delete(hadoop.Path(gone), True)
    if exists(spark, path):
        fs.rename(hadoop.Path(path), hadoop.Path(gone))
    fs.rename(hadoop.Path(beside), hadoop.Path(path))
    fs.delete(hadoop.Path(gone), True)


def folders(spark: SparkSession, parent: str, prefix: str) -> list[str]:
    """Names of the folders below parent that begin with prefix, in order; an error if there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(parent)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []
    found = sorted(x for x in found if x.startswith(prefix))
    if not found:
        raise FileNotFoundError(f"no folder {prefix}* below {parent}")
    return found


def file_name(idx: Column, req_idx: Column, ordinal: Column) -> Column:
    """idx_00001_req_002.json; idx_00001_00007.json without req_idx; row_00007.json without both."""
    return (
        F.when(idx.isNotNull() & req_idx.isNotNull(), F.format_string("idx_%05d_req_%03d.json", idx, req_idx))
        .when(idx.isNotNull(), F.format_string("idx_%05d_%05d.json", idx, ordinal))
        .otherwise(F.format_string("row_%05d.json", ordinal))
    )


def split_files(df: DataFrame, path: str) -> DataFrame:
    """One folder file=<name> of JSON for each row; returns the manifest (file, idx, req_idx)."""
    named = df.withColumn("file", file_name(F.col("idx"), F.col("req_idx"), F.col("ordinal"))).drop("ordinal")
    named.write.mode("overwrite").partitionBy("file").json(path)
    return named.select("file", "idx", "req_idx")


def merge_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All JSON files below path but manifests, each one object, by (idx, req_idx)."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return df.where(F.col("_metadata.file_name") != "_manifest.json").select([f.name for f in schema]).orderBy("idx", "req_idx")


def scan_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with file and annotator, bad files): a file that is no JSON object is listed, not fatal.
    The annotator is the name of the file's folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    parsed = raw.withColumn("v", F.try_parse_json("text")).withColumn("ok", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    good = parsed.where("ok").select("file", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("annotator"), F.from_json("text", schema).alias("x")).select("file", "annotator", "x.*")
    return good, parsed.where("NOT ok").select("file")


def to_array(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: all rows as one JSON array, in order. For exports that people edit, so small ones."""
    keyed = F.struct(*order, F.to_json(F.struct(*df.columns)).alias("__j"))
    return df.agg(F.concat(F.lit("[\n  "), F.array_join(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["__j"]), ",\n  "), F.lit("\n]")).alias("json"))


def from_array(df: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    return df.select(F.explode(F.from_json(column, T.ArrayType(schema), {"mode": "FAILFAST"})).alias("x")).select("x.*")


def vis_items(html: Column, name: str, schema: T.StructType) -> Column:
    """The array behind `<name> = new vis.DataSet([...])` in a page; null if there is none."""
    found = F.regexp_extract(html, rf"(?s)\b{name}\s*=\s*new\s+vis\.DataSet\(\s*(\[.*?\])\s*\)", 1)
    return F.from_json(F.nullif(found, F.lit("")), T.ArrayType(schema))
