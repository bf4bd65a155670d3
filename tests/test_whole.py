"""Queries over whole tables, where the ones with older SQL take a part."""

import re

from reqloom.plans import catalog


def test_t03_normalizes_all_turns(spark, small, tmp_path):
    def plain(text):
        t = f"3 {text} ## FR. 3.1.2 see 1.2.3 and Figure 7 SAFE MODE a. $x 5\\% ".replace("\\%", "%").replace("$", "")
        t = t.replace("Â±", "+-").replace("Ã‚Â±", "+-").replace("##", " ")
        for p in (r"\b(?:[A-Z]{1,3}\.)\s*\d+(?:\.\d+)+\b", r"\b\d+\.\d+(?:\.\d+)+\b", r"(?i)\bFigure\s+\d+\b", r"\b[A-Z]{2,}(?:\s+[A-Z]{2,})+\b", r"\b[a-zA-Z]\.\s+"):
            t = re.sub(p, " ", t)
        return re.sub(r"\s+", " ", re.sub(r"^\s*\d+\s+", "", t)).strip(" -:;,.\n\t")

    rows = [(r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    rows += [(-1, 0, "la función. Siguiente\nlínea b. fin " + "más texto " * 60 + "END OF TEXT 1.2.3"), (-1, 1, "a\n\nb\tFigure 3"), (-1, 2, None), (-1, 3, ""), (-1, 4, "no\u00a0break\u2003and é. x ÄB CD ÉÈ À. b"), (-1, 5, "١٢. ٣ Figure\u00a0٣ and \u3000 end\u2003")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["t"] for r in catalog.QUERIES["t03_normalize_text"](spark, str(tmp_path)).collect()}
    assert got == {(c, n): None if t is None else plain(t) for c, n, t in rows}


def test_t21_t24_take_all_turns(spark, small):
    """Turns of several lines and with backticks too; the SQL holds the texts."""
    c = spark.read.parquet(f"{small}/conversations.parquet")
    assert c.where(r"text LIKE '%\n%'").count() > 0
    for name in ("t21_t23_model_text", "t24_strip_examples"):
        assert catalog.QUERIES[name](spark, small).count() == c.count()


def test_g10_walks_all_edges(spark, small):
    from reqloom.plans.fixtures import frame

    orders, customers = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("orders", "customer"))
    want = orders.select("o_orderkey", "o_custkey").distinct().count() + customers.select("c_custkey", "c_nationkey").distinct().count()
    assert frame(spark, small, "graph_edges").count() == want


def test_clean_text_knows_all_blanks(spark):
    from pyspark.sql import functions as F

    from reqloom.functions import text as X

    texts = ["a  b", "x y　z", " -: lead", "é è", "a\x1fb"]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.clean_text(F.col("t")).alias("t")).collect()]
    assert got == [re.sub(r"\s+", " ", t).strip(" -:;,.\n\t") for t in texts]


def test_families_are_covered(spark):
    """A missing family's first pool row takes the place of the last row of the most common family."""
    from reqloom.operators.sample import cover_families

    pool = [(i, "s", f) for i, f in enumerate(["m", "m", "m", "m", "p", "m", "t", "p", "e"])]
    df = lambda rows: spark.createDataFrame(rows, "idx long, stratum string, family string")
    got = sorted(r["idx"] for r in cover_families(df(pool[:4]), df(pool), "idx", ["p", "e", "t", "x"]).collect())
    assert got == [0, 4, 6, 8]
    assert sorted(r["idx"] for r in cover_families(df(pool[4:5]), df(pool), "idx", ["e"]).collect()) == [4]  # nothing to give up
    assert cover_families(df([]), df([]), "idx", ["e"]).count() == 0


def test_family_cover_query(spark, small):
    got = [tuple(r) for r in catalog.QUERIES["y03_family_cover"](spark, small).select("idx", "family").collect()]
    from reqloom.plans.fixtures import frame
    from reqloom.functions import text as X
    from pyspark.sql import functions as F

    have = {r["f"] for r in frame(spark, small, "requirements").select(X.unit_family(X.unit_tokens(F.col("original_text"))).alias("f")).collect()}
    assert len(got) == 8 and {f for f, _ in X.FAMILIES} & have <= {f for _, f in got}


def test_structure_of_all_requirements(spark, small):
    """Subject, action and object of the eight sentence forms, and the attribute by which a value is meant."""
    from reqloom.plans.fixtures import frame

    nouns = {0: "bracket", 1: "housing", 2: "gap", 3: "response", 4: "load", 5: "width", 6: "play", 7: "cover"}
    form = {r["idx"]: r["template"] for r in frame(spark, small, "requirements").collect()}
    rows = catalog.QUERIES["t15_t16_structure"](spark, small).collect()
    assert len(rows) == sum(i % 97 != 0 for i in form)
    for r in rows:
        noun = "the " + nouns[form[r["idx"]]]
        assert r["subject"] == noun, r
        assert r["attribute"] == (None if form[r["idx"]] == 7 else noun), r


def test_nearest_against_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from reqloom.operators.normalize import nearest

    r = random.Random(4)
    rows = [(i, "ab"[i % 2], [r.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, "a", None), (80, "a", [0.0] * 5)]
    rows += [(100, "b", list(rows[0][2])), (101, "b", list(rows[0][2]))]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    have = {i: v for i, _, v in rows if v and any(v)}
    want = set()
    for q in have:
        if q % 20 == 0:
            best = sorted((-round(dot(have[q], v) / (dot(v, v) * dot(have[q], have[q])) ** 0.5, 6), i) for i, v in have.items() if i != q)[:10]
            want |= {(q, n + 1, i, round(-c, 6)) for n, (c, i) in enumerate(best)}
    for block in (7, 4096):
        df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
        assert {(x["query_id"], x["place"], x["vec_id"], round(x["cosine"], 6)) for x in nearest(df, F.col("vec_id") % 20 == 0, block=block).collect()} == want
