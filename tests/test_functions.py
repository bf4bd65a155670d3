"""Literal cases of the scalar, unit and extraction functions."""

import pytest
from pyspark.sql import functions as F

from reqloom.functions import scalars as S
from reqloom.functions import text as X
from reqloom.functions import units as U
from reqloom.operators import extract as E
from reqloom.operators import measure as M


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in row.items()))
    return df.select(column.alias("v")).first()["v"]


def test_clean_text(spark):
    assert value(spark, X.clean_text(F.col("t")), t=" -a  b.,") == "a b"


def test_make_span_clamps(spark):
    s = value(spark, X.make_span(F.col("t"), F.lit(-3), F.lit(2)), t="abc")
    assert (s["text"], s["start"], s["end"]) == ("ab", 0, 2)
    s = value(spark, X.make_span(F.col("t"), F.lit(2), F.lit(1)), t="abc")
    assert (s["text"], s["start"], s["end"]) == ("", 2, 2)


def test_earlier_operator_shadows(spark):
    got = value(spark, X.constraint_matches(F.col("t")), t="the part has no more than 5 kg of mass")
    assert [m["operator"] for m in got] == ["le"]


@pytest.mark.parametrize(("t", "op", "v1", "unit"), [("The beam shall carry at least 12 kg.", "ge", 12.0, "kilogram"), ("The gap must be less than 3 mm.", "lt", 3.0, "millimetre"), ("The play is 4 cm or less.", "le", 4.0, "centimetre")])
def test_extraction(spark, t, op, v1, unit):
    df = E.extract(spark.createDataFrame([(1, t)], "idx bigint, original_text string"))
    c = df.first()["record"]["requirements"][0]["constraints"]
    assert [(x["operator"], x["value"]["quantity"]["v1"], x["value"]["quantity"]["unit_text"]) for x in c] == [(op, v1, unit)]
    assert E.span_errors(df).count() == 0


def test_blank_texts_are_skipped(spark):
    df = E.extract(spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "idx bigint, original_text string"))
    assert {(r["status"], r["reason"], r["record"]) for r in df.collect()} == {("skipped", "missing_original_text", None)}


@pytest.mark.parametrize("op", ["gt", "ge", "lt", "le", "eq", "neq", "between"])
@pytest.mark.parametrize("tol", [None, 0.5])
def test_bounds(spark, op, tol):
    b = spark.createDataFrame([(op, 4.0, 2.0 if op == "between" else None, tol)], "o string, a double, b double, t double").select(U.bounds(F.col("o"), F.col("a"), F.col("b"), F.col("t")).alias("x")).first()["x"]
    slack = tol or 0.0
    if op == "between":
        assert (b["lower"], b["upper"]) == (2.0, 4.0)
    else:
        assert b["lower"] == (None if op in ("lt", "le") else 4.0 - slack)
        assert b["upper"] == (None if op in ("gt", "ge") else 4.0 + slack)
    assert b["lower_included"] == (op not in ("gt", "lt", "le")) and b["upper_included"] == (op not in ("gt", "ge", "lt"))


def test_nearest_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double").agg(S.nearest_rank("v", 0.95).alias("a"), S.nearest_rank("v", 0.5).alias("b"))
    assert tuple(df.first()) == (10.0, 2.0)


def test_agreement_without_choice(spark):
    one = spark.createDataFrame([("x", 1, 0, True), ("x", 2, 0, True)], "label string, item int, annotator int, rating boolean")
    assert M.agreement(one).first()["alpha"] is None
    same = spark.createDataFrame([("x", 1, 0, True), ("x", 1, 1, True)], one.schema)
    assert M.kappas(same).first()["kappa"] is None
