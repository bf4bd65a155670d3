"""Steps whose cost must grow with their input only: their results on odd rows, and what they must not do."""

import re

import pytest

from reqloom import vocab as V
from reqloom.plans import fixtures as X


@pytest.fixture
def odd(spark, tmp_path):
    """Orders and lines with nulls, repeated keys, negative numbers and many rows for one key."""
    orders = [(1, 105, "1-URGENT"), (1, 105, "2-HIGH"), (1, 205, "1-URGENT"), (2, None, "5-LOW"), (3, 7, None), (None, 7, "x"), (50, 7, "x"), (-4, -7, "x")]
    lines = [(o, p, s, n, q, f) for o in (1, 2, 3, 50, -4, 9) for p, s, n, q, f in ((7, 9, 1, 3.5, "A"), (7, 9, 1, 3.5, "A"), (8, 31, 1, 4.0, "R"), (None, None, 2, None, None), (6, 20, 3, 1.0, "N"), (5, 62, 4, 2.0, "A"), (-3, 1, 4, 2.0, "A"), (-10, 1, None, 2.0, "A"), (13, 18, None, 7.0, "N"))]
    lines += [(3, k % 40, k % 99, 6, float(k % 11), "ANR"[k % 3]) for k in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_triples_are_made_once(spark, odd):
    """The set is the one of the plain text, and no grouping has triples for its key."""
    want = X.expand("SELECT * FROM {triples}")
    tables = {n: spark.read.parquet(f"{odd}/{n}.parquet") for n in ("orders", "lineitem")}
    got = X.frame(spark, odd, "triples")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.sql(want, **tables).collect()))
    wide = [x for x in re.findall(r"Aggregate \[([^\]]*)\]", plan(got)) if "o_kind#" in x]
    assert len(wide) == 2 and "isnull(l_linenumber" in plan(got)  # lines without a number; units, at most seven a graph


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def triples(spark, rows):
    return spark.createDataFrame(rows, "graph_id long, s string, p string, o string, o_kind string")


def test_f01_enrich_lets_the_rest_pass(spark, small):
    """Only graphs' rows on marked nodes, units and kinds are dealt, none by all columns of a triple."""
    from reqloom.operators import graph as G

    t = triples(spark, [(1, "u", V.TYPE, V.QUDT + "Unit", "iri"), (1, "v", V.TYPE, V.QUDT + "QuantityValue", "iri"), (1, "v", V.QUDT + "numericValue", "9", "literal"), (1, "x", "p", "o", "iri"), (2, "w", V.TYPE, V.QUDT + "QuantityValue", "iri"), (2, "x", "p", "w", "iri"), (2, "y", "p", "o", "iri")])
    r = spark.createDataFrame([(1, "v", "u", "k", 1, None, True, None, 5), (1, "v", "u", "k", 1, None, True, None, 5)], "graph_id long, node string, unit string, kind string, lower int, upper int, lower_included boolean, upper_included boolean, value int")
    got = {tuple(x) for x in G.enrich(t, r).collect()}
    assert got == {(1, "x", "p", "o", "iri"), (2, "y", "p", "o", "iri"), (1, "v", V.TYPE, V.QUDT + "QuantityValue", "iri"), (1, "v", V.TYPE, V.IOF + "ValueExpression", "iri"), (1, "v", V.QUDT + "unit", "u", "iri"), (1, "v", V.QUDT + "minInclusive", "1", "literal"), (1, "u", V.TYPE, V.QUDT + "Unit", "iri"), (1, "u", V.QUDT + "hasQuantityKind", "k", "iri"), (1, "k", V.TYPE, V.QUDT + "QuantityKind", "iri")}
    assert len(got) == G.enrich(t, r).count()
    assert rest_passes(G.enrich(t, r))


def rest_passes(df):
    """Whether the first branch of the last union reaches its source without a grouping, and the end too."""
    head, tail = plan(df).split("Union", 1)
    return "Aggregate" not in head and "Aggregate" not in re.split(r"\n[:+]- (?=\w)", tail)[1]


@pytest.mark.parametrize("step", ["fix_design", "with_inverses", "inferred_domains", "inferred_properties", "fix_outputs", "chain"])
def test_f02_f05_f06_updates_let_the_rest_pass(spark, step):
    from reqloom.operators import graph as G

    t = triples(spark, [(1, "d", V.TYPE, V.IOF + "DesignSpecification", "iri"), (1, "d", V.IOF + "prescribes", "e", "iri"), (1, "e", V.TYPE, V.IOF + "PlannedProcess", "iri"), (1, "e", V.IOF + "hasSpecifiedOutput", "f", "iri"), (1, "d", V.IOF + "hasSpecifiedOutput", "e", "iri"), (1, "d", V.IOF + "hasSpecifiedOutput", "9", "literal"), (1, "x", "p", "_:y", "bnode"), (1, "y", "p", "3", "literal"), (None, None, "p", None, None)])
    pairs = lambda rows, names: spark.createDataFrame(rows, names)
    made, new, gone = {
        "fix_design": (lambda: G.fix_design(t), {(1, "d", V.TYPE, V.IOF + "PlanSpecification", "iri")}, {(1, "d", V.TYPE, V.IOF + "DesignSpecification", "iri")}),
        "with_inverses": (lambda: G.with_inverses(t, pairs([("p", "q"), ("q", "r")], "p string, q string")), {(1, "_:y", "q", "x", "iri"), (1, "x", "p", "_:y", "iri"), (1, "x", "r", "_:y", "iri")}, set()),
        "inferred_domains": (lambda: G.inferred_domains(t, pairs([("p", "C")], "p string, c string"), pairs([("p", "D")], "p string, c string")), {(1, "x", V.TYPE, "C", "iri"), (1, "y", V.TYPE, "C", "iri"), (1, "_:y", V.TYPE, "D", "iri"), (None, None, V.TYPE, "C", "iri")}, set()),
        "inferred_properties": (lambda: G.inferred_properties(t, pairs([("p", "q"), ("q", "r"), ("r", "q")], "child string, parent string")), {(g, s, q, o, k) for g, s, o, k in ((1, "x", "_:y", "bnode"), (1, "y", "3", "literal"), (None, None, None, None)) for q in "qr"}, set()),
        "fix_outputs": (lambda: G.fix_outputs(t), set(), {(1, "d", V.IOF + "hasSpecifiedOutput", "e", "iri"), (1, "d", V.IOF + "hasSpecifiedOutput", "9", "literal")}),
        "chain": (lambda: G.chain(t, V.IOF + "prescribes", V.IOF + "hasSpecifiedOutput", "c"), {(1, "d", "c", "f", "iri")}, set()),
    }[step]
    df = made()
    assert rows(df) == sorted(map(repr, ({tuple(r) for r in t.collect()} | new) - gone))
    assert rest_passes(df), plan(df)


def test_f07_f09_no_text_of_a_whole_graph(spark):
    """Pieces are bounded and hold each line once; the digest is that of the whole text."""
    from reqloom.sources import rdf

    t = triples(spark, [(g, f"s{i}", "p", f'a "{i}"\\\n é', "literal") for g in (1, None) for i in range(300)] + [(1, "_:b1", "p", "x y", "iri"), (1, "s", "p", "_:b1", "bnode"), (2, "s", "p", "o", "iri")])
    lines = rdf.to_lines(t)
    texts = {r["graph_id"]: r["text"] for r in rdf.to_text(t).collect()}
    import hashlib

    assert {tuple(r) for r in rdf.digests(lines).collect()} == {(g, x.count("\n") + 1, hashlib.md5(x.encode()).hexdigest()) for g, x in texts.items()}
    cut = rdf.pieces(lines, 100).collect()
    assert max(len(r["text"]) for r in cut) < 200
    assert sorted((repr(r["graph_id"]), x) for r in cut for x in r["text"].split("\n")) == sorted((repr(g), x) for g, text in texts.items() for x in text.split("\n"))


@pytest.mark.parametrize("text", ["<a> <b> <c> .\n\n<a> <b> \"x\" .\n_:q <b> _:r .", "@prefix x: <u:> .\n<a> <b> <c> .", "<a> <b> \"x\\ny\" .", "@prefix x: <u:> .\nx:a <b> <c> .", "<a> <b> \"x\"@en .\n<a> <b> 1 .", "@base <http://h/> .\n<a> <b> <c> .", "# n\n<a> <b> <c>, <d> ."])
def test_f09_plain_lines_parse_as_others_do(text):
    """A comment sends the same text through the tokens."""
    from reqloom.sources import rdf

    assert rdf.parse_turtle(text) == rdf.parse_turtle("# a comment\n" + text)


def test_f08_f10_parts_do_not_depend_on_the_chunks(spark):
    from reqloom.operators import graph as G
    from reqloom.operators.iterate import components

    import random

    r = random.Random(3)
    edges = [(g, f"n{r.randrange(60)}", f"n{r.randrange(60)}", False) for g in (1, 2, None) for _ in range(40)] + [(3, f"c{i:03}", f"c{i + 1:03}", i == 77) for i in range(150)]
    df = spark.createDataFrame(edges, "graph_id long, a string, b string, seed boolean").repartition(3)
    for chunk in (1, 7, 1 << 19):
        trees = G.forest(df, chunk).collect()
        joined = spark.createDataFrame([(x["graph_id"], x["node"], f"r{x['root']}") for x in trees], "graph_id long, a string, b string")
        least = {(x["graph_id"], x["node"]): x["least"] for x in components(joined).collect()}
        want = {(x["graph_id"], x["node"]): x["least"] for x in components(df).collect()}
        same = {}
        for k, v in want.items():
            assert same.setdefault((k[0], v), least[k]) == least[k]
        assert len({(k[0], v) for k, v in want.items()}) == len({(k[0], least[k]) for k in want})
        assert any(x["seed"] for x in trees)


def test_f08_parts_with_nulls_and_lone_nodes(spark):
    from reqloom.operators import graph as G

    t = triples(spark, [(1, "x:a", "p", "b", "iri"), (1, "c", "p", "d", "iri"), (1, "e", "p", "1", "literal"), (1, None, "p", "b", "iri"), (1, None, "p", "z", "iri"), (1, None, "p", "2", "literal"), (1, "x:f", "p", "3", "literal"), (1, "b", "p", None, "iri"), (2, "c", "p", "d", "iri"), (2, None, "p", "4", "literal"), (None, "c", "p", "x:a", "iri")])
    got = {(r["graph_id"], r["s"], r["o"]) for r in G.connected_part(t, "x:").collect()}
    assert got == {(1, "x:a", "b"), (1, None, "b"), (1, "x:f", "3"), (1, "b", None), (2, "c", "d"), (2, None, "4"), (None, "c", "x:a")}


def test_f12_g13_rows_are_dealt_not_triples(spark, small):
    """Triples are grouped where their graph's rows are: nothing is dealt by what a triple consists of."""
    from reqloom.plans import catalog

    text = catalog.QUERIES["g13_instantiate"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and not re.search(r"hashpartitioning\([^)]*\bo_kind#", text)


@pytest.mark.parametrize("name", ["x08_span_contract", "t08_t09_modality_condition", "t11_t17_constraints"])
def test_f24_f27_f28_texts_are_dealt_to_all_cores(spark, small, name):
    from reqloom.operators import extract as E

    one = spark.read.parquet(f"{small}/part.parquet").selectExpr("p_partkey AS idx", "'a beam shall hold 3 kg' AS original_text").coalesce(1)
    assert E.extract(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_f29_j07_looks_units_up_as_a_set(spark, small):
    """The plan reads a table of units; the lines, with all work on units, are behind it."""
    from reqloom.plans import catalog

    assert "l_partkey" not in plan(catalog.QUERIES["j07_upper_fallback"](spark, small))


@pytest.mark.parametrize("name", ["g01_g04_enrich", "a23_graphs_passing", "g08_patterns", "g10_connected_part", "r03_j16_inverses"])
def test_f05_f14_f18_no_table_of_triples_is_written(spark, small, monkeypatch, name):
    from reqloom.operators import graph as G
    from reqloom.operators import iterate
    from reqloom.plans import catalog

    written, real = [], iterate.checkpointed

    def spy(df, *a):
        written.append(set(df.columns))
        return real(df, *a)

    monkeypatch.setattr(G, "checkpointed", spy)
    monkeypatch.setattr(iterate, "checkpointed", spy)
    catalog.QUERIES[name](spark, small)
    assert not [c for c in written if {"s", "p", "o"} <= c]


@pytest.mark.parametrize("name", ["g14_abox", "p05_claim_rows", "a34_triple_counts", "a12_inference_delta", "g17_nodes_edges", "g15_abox_index", "u04_three_way"])
def test_f03_f04_f19_f21_f23_f26_f30_sets_are_not_grouped_again(spark, small, name):
    from reqloom.plans import catalog

    text = plan(catalog.QUERIES[name](spark, small))
    assert not re.search(r"Aggregate \[[^\]]*\bs#\d+, p#\d+, o#\d+\b(?!, o_kind)", text) and not re.search(r"Aggregate \[[^\]]*node#\d+, [^\]]*p#\d+", text)
    assert "FullOuter" not in text and "Expand" not in text
