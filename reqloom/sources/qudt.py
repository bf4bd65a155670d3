"""The unit and quantity-kind dimensions from an ontology file or a lookup table.

Units keep what conversion needs; kinds come from the units' own statements and from the kinds' lists of
applicable units. `seq` is the order of IRIs, so that every choice of a first one is repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom import vocab as V
from reqloom.functions.text import local_name
from reqloom.sources import jsonio, rdf

SI_SYSTEM = "http://qudt.org/vocab/sou/SI"
UNIT_CLASSES = (V.QUDT + "Unit", V.QUDT + "DerivedUnit")


def units_of(t: DataFrame) -> DataFrame:
    """(code, unit, multiplier, shift, scaling_of, is_si, seq) from triples: all subjects that are typed as
    units or have a conversion multiplier or a scaling."""
    p, o = F.col("p"), F.col("o")
    first = lambda name, value: F.min(F.when(p == V.QUDT + name, value))
    per = t.groupBy(F.col("s").alias("unit")).agg(
        F.bool_or((p == V.TYPE) & o.isin(*UNIT_CLASSES)).alias("typed"), first("conversionMultiplier", o.try_cast("double")).alias("multiplier"),
        first("conversionOffset", o.try_cast("double")).alias("shift"), first("scalingOf", o).alias("scaling_of"),
        F.bool_or((p == V.QUDT + "applicableSystem") & (o == SI_SYSTEM)).alias("is_si"),
    )
    per = per.where("typed OR multiplier IS NOT NULL OR scaling_of IS NOT NULL")
    return per.select(local_name(F.col("unit")).alias("code"), "unit", "multiplier", "shift", "scaling_of", "is_si", _seq("unit"))


def kinds_of(t: DataFrame) -> DataFrame:
    """(unit, code, kind, kind_code, seq) from triples, both ways of saying it united."""
    own = t.where(F.col("p") == V.QUDT + "hasQuantityKind").select(F.col("s").alias("unit"), F.col("o").alias("kind"))
    listed = t.where(F.col("p") == V.QUDT + "applicableUnit").select(F.col("o").alias("unit"), F.col("s").alias("kind"))
    both = own.union(listed).distinct()
    return both.select("unit", local_name(F.col("unit")).alias("code"), "kind", local_name(F.col("kind")).alias("kind_code"), _seq("unit", "kind"))


def _seq(*order: str):
    # a vocabulary has some thousand units: one window orders it
    return (F.row_number().over(Window.orderBy(*order)) - 1).alias("seq")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(units, kinds) of an RDF file; a missing or broken one is an error."""
    if not jsonio.exists(spark, path):
        raise FileNotFoundError(path)
    text = spark.read.text(path, wholetext=True).select(F.lit(0).alias("graph_id"), F.col("value").alias("text"))
    t = rdf.parse(text)
    bad = t.where("error IS NOT NULL").select("error").first()
    if bad:
        raise ValueError(bad["error"])
    return units_of(t), kinds_of(t)


def read_lookup(spark: SparkSession, path: str, unit: str = "unit", kind: str = "quantitykind") -> DataFrame:
    """Kinds from a table of comma-separated values with a header: a unit and its kind in each row."""
    if not jsonio.exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.option("header", True).csv(path).select(F.trim(unit).alias("u"), F.trim(kind).alias("k")).where("u != '' AND k != ''").distinct()
    iri = lambda c, ns: F.when(F.col(c).rlike("^https?://"), F.col(c)).otherwise(F.concat(F.lit(ns), c))
    rows = rows.select(iri("u", V.UNIT).alias("unit"), iri("k", V.KIND).alias("kind")).distinct()
    return rows.select("unit", local_name(F.col("unit")).alias("code"), "kind", local_name(F.col("kind")).alias("kind_code"), _seq("unit", "kind"))


def si_members(rows: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    """rows whose unit belongs to the international system."""
    return rows.join(units.where("is_si").select(F.col("unit").alias(unit)), unit, "left_semi")
