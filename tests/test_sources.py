"""RDF texts, JSON files, graph operators on small cases and the batch."""

import json

import pytest

from reqloom import vocab as V
from reqloom.operators import graph as G
from reqloom.operators.pipeline import run_batch
from reqloom.schema import INPUT
from reqloom.sources import jsonio, rdf

TRIPLE = "graph_id bigint, s string, p string, o string, o_kind string"


def test_turtle():
    got = rdf.parse_turtle("""@prefix : <http://e/> . @base <http://b/> .
        # note
        :a a :C ; :p "x\\n\\u00e9"@en , 3, 1.5, true ; :q [ :r <rel> ] .
        <s> :list ( :x "y"^^:t ) . """)
    assert ("http://e/a", V.TYPE, "http://e/C", "iri", None, None) in got
    assert ("http://e/a", "http://e/p", "x\né", "literal", None, "en") in got
    assert ("http://e/a", "http://e/p", "1.5", "literal", V.XSD + "decimal", None) in got
    assert [x[2] for x in got if x[1] == "http://e/r"] == ["http://b/rel"]
    assert [x[2] for x in got if x[1] == V.RDF + "first"] == ["http://e/x", "y"]
    assert sum(x[1] == V.RDF + "rest" for x in got) == 2


@pytest.mark.parametrize("bad", ["a b c .", "<a> <b>", "<a> <b> \"open .", "@prefix x <y> .", "x:a x:b x:c ."])
def test_bad_turtle(bad):
    with pytest.raises(rdf.TurtleError):
        rdf.parse_turtle(bad)


def test_xml_and_sniffing():
    xml = f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="{V.RDF}" xmlns:e="http://e/"><e:C rdf:about="http://e/a"><e:p>t</e:p><e:q rdf:resource="http://e/b"/><e:r><e:D rdf:nodeID="n"/></e:r></e:C></rdf:RDF>"""
    got = rdf.parse_any(xml)
    assert ("http://e/a", V.TYPE, "http://e/C", "iri", None, None) in got and ("http://e/a", "http://e/r", "_:n", "bnode", None, None) in got
    assert rdf.parse_any("<C:\\a b\\x> <http://p> 1 .")[0][0] == "file:///C:/a%20b/x"


def test_parse_keeps_bad_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "<a> <b> <c> ."), (2, "nonsense <"), (3, None)], "graph_id bigint, text string")
    got = {(r["graph_id"], r["error"] is None) for r in rdf.parse(df).collect()}
    assert got == {(1, True), (2, False)}
    t = spark.createDataFrame([(1, "u:a", "u:p", 'x "\\ \n\t y', "literal"), (2, "u:a", "u:p", "_:b", "bnode")], TRIPLE)
    rdf.write(t, str(tmp_path / "g"))
    back = rdf.read(spark, str(tmp_path / "g"), "*.txt")
    assert back.count() == 2
    assert sorted((r["s"], r["o"]) for r in rdf.parse(rdf.to_text(t)).collect()) == [("u:a", "_:b"), ("u:a", 'x "\\ \n\t y')]


def test_jsonl(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"idx": "1", "original_text": "a"}\n\n{"idx": "2", "original_text": "b"}\n')
    assert jsonio.read_lines(spark, str(f), INPUT).count() == 2
    assert jsonio.read_lines(spark, str(f), INPUT, 1).count() == 1
    assert jsonio.read_optional(spark, str(tmp_path / "none"), INPUT).count() == 0
    f.write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        jsonio.read_lines(spark, str(f), INPUT).collect()


def test_upsert_and_arrays(spark, tmp_path):
    for run, n in (("a", 1), ("b", 2), ("a", 3)):
        jsonio.upsert(spark, spark.createDataFrame([(run, n)], "run_id string, n int"), str(tmp_path / "h"), "run_id")
    got = spark.read.json(str(tmp_path / "h"))
    assert sorted((r["run_id"], r["n"]) for r in got.collect()) == [("a", 3), ("b", 2)]
    text = jsonio.to_array(got, ["run_id"])
    assert [x["run_id"] for x in json.loads(text.first()["json"])] == ["a", "b"]
    assert jsonio.from_array(text, got.schema).count() == 2


def test_checked_scan(spark, tmp_path):
    for who, text in (("a1", '{"idx": 1}'), ("a2", "[1]"), ("a3", "{")):
        (tmp_path / who).mkdir()
        (tmp_path / who / "x.json").write_text(text)
    from pyspark.sql import types as T

    good, bad = jsonio.scan_checked(spark, str(tmp_path), T.StructType([T.StructField("idx", T.LongType())]))
    assert [(r["annotator"], r["idx"]) for r in good.collect()] == [("a1", 1)] and bad.count() == 2


def test_assign_nodes(spark):
    nodes = spark.createDataFrame([(1, "u#V2"), (1, "u#maxLoad"), (1, "u#zzz"), (2, "u#a"), (2, "u#b")], "graph_id long, node string")
    rows = spark.createDataFrame([(1, 2, "w"), (1, 7, "load of it"), (1, 9, "other"), (2, 5, "x")], "graph_id long, row long, label string")
    assert sorted(tuple(r) for r in G.assign_nodes(nodes, rows).collect()) == [(1, "u#V2", 2), (1, "u#maxLoad", 7), (1, "u#zzz", 9)]


def test_bounds_of_named_nodes(spark):
    n = V.REQ + "1#VE_req0_c1"
    t = spark.createDataFrame([(1, n, V.TYPE, V.QUDT + "QuantityValue", "iri"), (1, n, V.QUDT + "unit", "u:m", "iri"), (1, n, V.QUDT + "minInclusive", "1", "literal")], TRIPLE)
    expected = spark.createDataFrame([(1, 0, 1, 1.0, 2.0)], "graph_id long, req_idx int, constraint_idx int, lower double, upper double")
    assert {r["code"] for r in G.pattern_violations(t, expected).collect()} == {"missing_upper", "untyped_unit", "unit_without_kind"}


def test_connected_part_follows_both_directions(spark):
    rows = [(1, "x:1", "u:p", "x:2", "iri"), (1, "y:3", "u:p", "x:2", "iri"), (1, "y:9", "u:p", "y:8", "iri"), (1, "y:3", "u:n", "x:2", "literal"), (2, "y:1", "u:p", "y:2", "iri")]
    got = {(r["graph_id"], r["s"], r["o_kind"]) for r in G.connected_part(spark.createDataFrame(rows, TRIPLE), "x:").collect()}
    assert got == {(1, "x:1", "iri"), (1, "y:3", "iri"), (1, "y:3", "literal"), (2, "y:1", "iri")}


def test_empty_graphs(spark):
    t = spark.createDataFrame([], TRIPLE)
    assert G.conformance(t).count() == 0 and G.connected_part(t).count() == 0 and G.pattern_violations(t).count() == 0
    assert [r["violations"] for r in G.conformance_summary(G.conformance(t), t.select("graph_id")).collect()] == [0] * 6


LINES = [{"idx": 1, "original_text": "The beam shall carry at least 12 kg."}, {"idx": 2, "original_text": ""}, {"original_text": "The gap must be less than 3 mm."}, {"idx": 4, "original_text": "The signal shall be at least 50 Hz."}, {"idx": 5, "original_text": "The lid shall hold at least 3 furlongs."}]


def test_batch(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text("\n".join(map(json.dumps, LINES)))
    out = run_batch(spark, str(f), str(tmp_path / "out"))
    t = spark.read.parquet(str(tmp_path / "out/triples"))
    assert t.where(f"p = '{V.QUDT}unit'").count() == 3 and "| extraction | ok | 4 |" in out["quality"] and "C06" in out["conformance"]
    assert {r["o"] for r in t.where(f"p = '{V.QUDT}unit'").collect()} == {V.UNIT + u for u in ("KiloGM", "MilliM", "HZ")}
    assert [(r["idx"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out/unresolved")).collect()] == [(5, "unknown unit")]
    reasoned = spark.read.parquet(str(tmp_path / "out/reasoned"))
    assert reasoned.where(f"p = '{V.IOF}satisfiesRequirement'").count() == 3
    h = spark.read.json(str(tmp_path / "out/history")).first()
    assert (h["n_input"], h["n_extracted"], h["n_normalized"], h["n_end_to_end"], h["normalized"], h["quantity_constraints"]) == (5, 4, 3, 4, 3, 4)


def test_reasoning_that_fails_keeps_the_graph(spark, tmp_path):
    from reqloom.operators.pipeline import write_reasoned

    def broken(t):
        raise RuntimeError("no reasoner")

    t = spark.createDataFrame([(1, V.REQ + "1#a", "u:p", "u:b", "iri")], TRIPLE)
    assert write_reasoned(t, broken, str(tmp_path / "r")) == "asserted: RuntimeError"
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


UNITS = """@prefix qudt: <http://qudt.org/schema/qudt/> . @prefix unit: <http://qudt.org/vocab/unit/> . @prefix kind: <http://qudt.org/vocab/quantitykind/> . @prefix sou: <http://qudt.org/vocab/sou/> .
unit:FURLONG a qudt:Unit ; qudt:conversionMultiplier 201.168 ; qudt:hasQuantityKind kind:Length .
unit:M a qudt:Unit ; qudt:conversionMultiplier 1.0 ; qudt:applicableSystem sou:SI .
unit:DEG_C a qudt:DerivedUnit ; qudt:conversionMultiplier 1.0 ; qudt:conversionOffset 273.15 ; qudt:scalingOf unit:K .
kind:Length qudt:applicableUnit unit:M , unit:FURLONG . """


def test_units_of_an_ontology_file(spark, tmp_path):
    from reqloom.sources import qudt

    f = tmp_path / "units.ttl"
    f.write_text(UNITS)
    units, kinds = qudt.read_graph(spark, str(f))
    assert sorted((r["code"], r["multiplier"], r["shift"], r["scaling_of"], r["is_si"]) for r in units.collect()) == [("DEG_C", 1.0, 273.15, V.UNIT + "K", False), ("FURLONG", 201.168, None, None, False), ("M", 1.0, None, None, True)]
    assert sorted((r["code"], r["kind_code"]) for r in kinds.collect()) == [("FURLONG", "Length"), ("M", "Length")]
    lines = tmp_path / "in.jsonl"
    lines.write_text(json.dumps({"idx": 1, "original_text": "The lid shall hold at least 3 FURLONG."}))
    run_batch(spark, str(lines), str(tmp_path / "out"), qudt_file=str(f))
    n = spark.read.parquet(str(tmp_path / "out/normalization")).first()
    assert (n["best_unit"], n["si_unit"], round(n["si_v1"], 3), round(n["lower"], 3)) == (V.UNIT + "FURLONG", V.UNIT + "M", 603.504, 603.504)
    with pytest.raises(FileNotFoundError):
        qudt.read_graph(spark, str(tmp_path / "none.ttl"))
    f.write_text("nonsense <")
    with pytest.raises(ValueError):
        qudt.read_graph(spark, str(f))
    csv = tmp_path / "units.csv"
    csv.write_text("unit,quantitykind\nhttp://qudt.org/vocab/unit/M,Length\n FT ,Length\nX,\n")
    assert sorted((r["unit"], r["kind"]) for r in qudt.read_lookup(spark, str(csv)).collect()) == [(V.UNIT + "FT", V.KIND + "Length"), (V.UNIT + "M", V.KIND + "Length")]


def test_choice_of_a_kind(spark):
    from reqloom.functions import units as U
    from reqloom.operators import normalize as N

    rows = spark.createDataFrame([(1, "le", 5.0, None, 0.5, "m", "the distance to the wall"), (2, "eq", 5.0, None, 0.5, "mm", "x"), (3, "eq", 1.0, None, None, "m", "long")], "idx long, operator string, v1 double, v2 double, tol double, unit string, text string")
    got = {r["idx"]: r for r in N.normalize(rows, U.units(spark), U.unit_kinds(spark), "pipeline", N.Chooser(), "text").collect()}
    assert [got[i]["kind"].rsplit("/", 1)[1] for i in (1, 2, 3)] == ["Distance", "Length", "Length"]
    assert got[2]["lower"] == pytest.approx(0.0045) and got[2]["upper"] == pytest.approx(0.0055)  # the tolerance scales with the value
    plain = {r["idx"]: r for r in N.normalize(rows, U.units(spark), U.unit_kinds(spark)).collect()}
    assert plain[2]["lower"] == pytest.approx(0.005 - 0.5) and plain[1]["kind"].endswith("Length")
    with pytest.raises(ValueError):
        N.normalize(rows, U.units(spark), U.unit_kinds(spark), "zero-shot-llm")


def test_stage_and_method_names():
    from reqloom import config

    assert config.stage(" OpenAI ", " ") == config.Stage("openai", config.MODELS["openai"]) and config.stage("ollama", "m").local
    assert config.method("Few_Shot_LLM") == "few-shot-llm" and config.method() == "pipeline" and config.prompt_style("zero-shot-llm") == "zero_shot"
    for bad in (lambda: config.stage("x"), lambda: config.method("x")):
        with pytest.raises(ValueError):
            bad()


def test_history_survives_a_crash(spark, tmp_path):
    """The new history was written, and the crash came before it took the old one's place."""
    import os

    h = str(tmp_path / "h")
    jsonio.upsert(spark, spark.createDataFrame([("a", 1)], "run_id string, n int"), h, "run_id")
    os.rename(h, h + ".new")
    jsonio.upsert(spark, spark.createDataFrame([("b", 2)], "run_id string, n int"), h, "run_id")
    assert sorted((r["run_id"], r["n"]) for r in spark.read.json(h).collect()) == [("a", 1), ("b", 2)]
    assert sorted(os.listdir(tmp_path)) == ["h"]


def test_files_of_rows(spark, tmp_path):
    from pyspark.sql import types as T

    rows = spark.createDataFrame([(1, 2, 0, "x"), (3, None, 1, "y"), (None, None, 2, "z")], "idx long, req_idx int, ordinal long, t string")
    manifest = jsonio.split_files(rows, str(tmp_path / "s"))
    assert sorted(r["file"] for r in manifest.collect()) == ["idx_00001_req_002.json", "idx_00003_00001.json", "row_00002.json"]
    schema = T.StructType().add("idx", T.LongType()).add("req_idx", T.IntegerType()).add("t", T.StringType())
    assert sorted(r["t"] for r in jsonio.merge_files(spark, str(tmp_path / "s"), schema).collect()) == ["x", "y", "z"]
    (tmp_path / "many").mkdir()
    for i in (2, 1):
        (tmp_path / "many" / f"{i}.jsonl").write_text("\n".join(json.dumps({"idx": f"{i}-{j}"}) for j in range(3)))
    assert [r["idx"] for r in jsonio.read_lines(spark, str(tmp_path / "many"), INPUT, 4).collect()] == ["1-0", "1-1", "1-2", "2-0"]
    page = "<script>nodes = new vis.DataSet([{\"id\": 1}, {\"id\": 2}]);</script>"
    item = T.StructType().add("id", T.IntegerType())
    got = spark.createDataFrame([(page,), ("none",)], "h string").select(jsonio.vis_items(__import__("pyspark.sql.functions", fromlist=["col"]).col("h"), "nodes", item).alias("v")).collect()
    assert [None if r["v"] is None else [x["id"] for x in r["v"]] for r in got] == [[1, 2], None]
    for name in ("ground_b", "ground_a", "other"):
        (tmp_path / "dirs" / name).mkdir(parents=True)
    assert jsonio.folders(spark, str(tmp_path / "dirs"), "ground") == ["ground_a", "ground_b"]
    with pytest.raises(FileNotFoundError):
        jsonio.folders(spark, str(tmp_path / "dirs"), "none")


def test_labels_are_wrapped(spark):
    import textwrap

    from pyspark.sql import functions as F

    from reqloom.functions import text as X

    texts = ["", "one", "one two three four", "a bcdefghij kl", "abcdefghijklmnopqrstuvwxyz", "ab abcdefghijklmnopqrstuvwxyz x", "  spaced   out  text here "]
    for width in (5, 8, 12):
        got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.wrap(F.col("t"), width).alias("t")).collect()]
        assert got == [textwrap.fill(" ".join(t.split()), width) for t in texts]


def test_commands(spark, tmp_path):
    from reqloom.__main__ import main

    f = tmp_path / "in.jsonl"
    f.write_text("\n".join(map(json.dumps, LINES)))
    out = tmp_path / "out"
    main(["run", str(f), str(out), "--run-id", "r1"])
    main(["run", str(f), str(out), "--run-id", "r2", "--limit", "2"])
    main(["compare", str(out), str(tmp_path / "compare.md")])
    text = (tmp_path / "compare.md").read_text()
    assert "| r1 | 5 | 4 |" in text and "| r2 | 2 | 1 |" in text and "# Quality report" in (out / "quality.md").read_text()

    spark.createDataFrame([(1, False, True, True, False, True, None, True, True, True, False, 1), (2, True, False, True, True, True, True, False, None, None, None, 0)], "idx long, decomposition_error boolean, subject_correct boolean, modality_correct boolean, condition_correct boolean, action_correct boolean, object_correct boolean, is_true boolean, operator_correct boolean, value_correct boolean, unit_correct boolean, n_missing int").write.parquet(str(tmp_path / "e/judged"))
    spark.createDataFrame([(True,), (False,), (None,)], "supported boolean").write.parquet(str(tmp_path / "e/claims"))
    spark.createDataFrame([("a", "b", "c"), ("a", " ", "c")], "s string, p string, o string").write.parquet(str(tmp_path / "e/missing"))
    spark.read.parquet(str(out / "triples")).write.parquet(str(tmp_path / "e/triples"))
    main(["evaluate", str(tmp_path / "e"), str(tmp_path / "evaluation.md")])
    text = (tmp_path / "evaluation.md").read_text()
    for line in ("| error_rate | 0.5 |", "| subject | 1 | 2 | 0.5000 |", "| macro |", "| f1 | 0.5 |", "| precision | 0.5 |", "| C01 | error |"):
        assert line in text, line

    for who, ratings in (("ground_truth_extraction_items_a", (True, True, False)), ("ground_truth_extraction_items_b", (True, False, False))):
        (tmp_path / "iaa" / who).mkdir(parents=True)
        for i, r in enumerate(ratings):
            (tmp_path / "iaa" / who / f"{i}.json").write_text(json.dumps({"level": "requirement", "label": "subject", "item": str(i), "rating": r}))
    (tmp_path / "iaa" / who / "bad.json").write_text("[")
    main(["agreement", str(tmp_path / "iaa"), str(tmp_path / "iaa.md")])
    text = (tmp_path / "iaa.md").read_text()
    assert "| subject | 3 | 3 | 2 | 2 | 3 | 0.6667 |" in text and "bad.json" in text and "requirement: pairs of annotators" in text

    main(["sample", str(f), str(tmp_path / "sample"), "--size", "2"])
    taken, rest = spark.read.json(str(tmp_path / "sample/sample")), spark.read.json(str(tmp_path / "sample/rest"))
    assert taken.count() == 2 and rest.join(taken, "original_text").count() == 0
    (tmp_path / "rdf").mkdir()
    (tmp_path / "rdf/a.owl").write_text(f"<u:a> <{V.TYPE}> <u:B> .")
    main(["to-turtle", str(tmp_path / "rdf"), str(tmp_path / "ttl")])
    assert rdf.read(spark, str(tmp_path / "ttl"), "*.txt").count() == 1


def test_whole_files_are_read(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix e: <u:> .\ne:a e:b e:c .\n")
    (tmp_path / "b.json").write_text('{\n "idx": 4\n}\n')
    from pyspark.sql import types as T

    assert [r["s"] for r in rdf.parse(rdf.read(spark, str(tmp_path), "*.ttl").selectExpr("1L AS graph_id", "text")).collect()] == ["u:a"]
    good, bad = jsonio.scan_checked(spark, str(tmp_path), T.StructType().add("idx", T.LongType()))
    assert [r["idx"] for r in good.collect()] == [4] and bad.count() == 0
