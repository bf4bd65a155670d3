"""Queries over texts and quantities, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqloom.functions import text as X
from reqloom.functions import units as U
from reqloom.operators import extract as E
from reqloom.operators import normalize as N
from reqloom.operators import sample as P
from reqloom.operators.iterate import checkpointed
from reqloom.plans.fixtures import frame
from reqloom.vocab import KIND, UNIT

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def values(rows, names: str) -> str:
    """An inline table for DuckDB."""
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


UNITS_SQL = "(SELECT * FROM " + values([(c, UNIT + c, m, o, UNIT + s if s else None, si, i) for i, (c, m, o, s, si) in enumerate(U.UNITS)], "code, unit, multiplier, shift, scaling_of, is_si, seq") + ")"
KINDS_SQL = "(SELECT * FROM " + values([(UNIT + u, u, KIND + k, k, i) for i, (u, k) in enumerate(U.KINDS)], "unit, code, kind, kind_code, seq") + ")"
ALIAS_SQL = "(SELECT * FROM " + values(list(U.ALIASES.items()), "name, alias") + ")"

_WS = r"regexp_replace({}, '\s+', ' ', 'g')"
_CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'), ' -:;,.' || chr(10) || chr(9))"


@query("t01_clean_text", f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned FROM documents")
def t01(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("t02_make_span", "SELECT doc_id, substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS text, CAST(a AS INT) AS \"start\", CAST(b AS INT) AS \"end\" FROM (SELECT doc_id, text, greatest(0, doc_id % 7 - 2) AS a, greatest(greatest(0, doc_id % 7 - 2), doc_id % 23 - 4) AS b FROM documents)")
def t02(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", X.make_span(F.col("text"), (F.col("doc_id") % 7 - 2).cast("int"), (F.col("doc_id") % 23 - 4).cast("int")).alias("s")).select("doc_id", "s.*")


@query("t03_normalize_text")
def t03(spark, d):
    """All turns, whole texts. DuckDB's word boundaries know ASCII only, so a test holds it."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    raw = F.concat(F.lit("3 "), F.col("text"), F.lit(" ## FR. 3.1.2 see 1.2.3 and Figure 7 SAFE MODE a. $x 5\\% "))
    return t.select("conv_id", "turn", X.normalize_text(raw).alias("t"))


@query("t05_score_candidate", "SELECT idx, CAST(10 * (" + " + ".join(f"CAST(contains(l, '{w}') AS INT)" for w in ("shall", "must", "should", "may", "will", "is")) + ") + 3 * (" + " + ".join(f"CAST(contains(l, '{w}') AS INT)" for w in X.COMPARATORS) + ") AS INT) AS score, CAST(length(l) AS INT) AS length FROM (SELECT idx, lower(original_text) AS l FROM {requirements})")
def t05(spark, d):
    return frame(spark, d, "requirements").select("idx", X.score_candidate(F.col("original_text")).alias("s")).select("idx", "s.score", "s.length")


@query("t06_positive_comparatives", "SELECT idx, CASE WHEN template = 1 THEN replace(t, 'must weigh', 'must be at most') WHEN template = 3 THEN replace(t, 'should be', 'should be at least') ELSE t END AS t FROM (SELECT idx, template, original_text AS t FROM {requirements})")
def t06(spark, d):
    r = frame(spark, d, "requirements")
    t = F.when(F.col("template") == 1, F.replace("original_text", F.lit("must weigh"), F.lit("must NOT be  more than"))).when(F.col("template") == 3, F.replace("original_text", F.lit("should be"), F.lit("should be not less than"))).otherwise(F.col("original_text"))
    return r.select("idx", X.positive_comparatives(t).alias("t"))


@query("t07_candidates", "SELECT idx, CAST(CASE WHEN trim(t) = '' THEN 1 ELSE 3 END AS INT) AS n, CASE WHEN trim(t) = '' THEN 'Alpha one' ELSE trim(t) END AS best FROM (SELECT idx, original_text AS t FROM {requirements})")
def t07(spark, d):
    """Split, strip headings, rank; the requirement beats the heading."""
    c = frame(spark, d, "requirements").select("idx", X.candidates(F.concat(F.lit("Width Alpha one. "), F.col("original_text"))).alias("c"))
    return c.select("idx", F.size("c").alias("n"), F.get("c", F.lit(0)).alias("best"))


_KIND8 = "CASE template WHEN 0 THEN 'ge' WHEN 1 THEN 'le' WHEN 2 THEN 'between' WHEN 3 THEN 'lt' WHEN 4 THEN 'gt' WHEN 5 THEN 'eq' WHEN 6 THEN 'le' END"
_REQ = f"""(SELECT *, {_KIND8} AS operator, CASE WHEN idx % 11 = 0 THEN 'is' ELSE CASE template WHEN 0 THEN 'shall' WHEN 1 THEN 'must' WHEN 2 THEN 'shall' WHEN 3 THEN 'should' WHEN 4 THEN 'may' WHEN 5 THEN 'will' WHEN 6 THEN 'is' ELSE 'must' END END AS modality,
    CASE unit WHEN 'mm' THEN 'millimetre' WHEN 'cm' THEN 'centimetre' WHEN 'kg' THEN 'kilogram' WHEN 'kPa' THEN 'kilopascal' WHEN 'ms' THEN 'millisecond' ELSE 'percent' END AS unit_text FROM {{requirements}} WHERE idx % 97 <> 0)"""


@query("t08_t09_modality_condition", f"""SELECT idx, modality, idx % 11 = 0 AS present, CASE WHEN idx % 11 = 0 THEN 'when the engine is on' ELSE '' END AS condition, CAST(CASE WHEN idx % 11 = 0 THEN 21 ELSE 0 END AS INT) AS "end" FROM {_REQ}""")
def t08(spark, d):
    r = E.extract(frame(spark, d, "requirements")).where("status = 'ok'").select("idx", F.col("record.requirements")[0]["structure"].alias("s"))
    return r.select("idx", "s.modality", "s.condition.present", F.col("s.condition.text").alias("condition"), "s.condition.end")


_LEAD = "CASE template WHEN 0 THEN 'at least ' WHEN 1 THEN 'at most ' WHEN 2 THEN 'between ' WHEN 3 THEN 'less than ' WHEN 4 THEN 'greater than ' WHEN 5 THEN 'exactly ' ELSE '' END"


@query("t11_t17_constraints", f"""SELECT idx, CAST(0 AS INT) AS constraint_idx, 'g0' AS group_id, operator, CAST(p_size AS DOUBLE) AS v1, CASE WHEN template = 2 THEN CAST(p_size + 5 AS DOUBLE) END AS v2, unit_text,
    {_LEAD} || p_size || ' ' || unit || CASE template WHEN 2 THEN ' and ' || (p_size + 5) || ' ' || unit WHEN 6 THEN ' or less' ELSE '' END AS evidence FROM {_REQ} WHERE template <> 7""")
def t11(spark, d):
    """The text's template is the oracle."""
    r = E.extract(frame(spark, d, "requirements")).where("status = 'ok'").select("idx", F.explode(F.col("record.requirements")[0]["constraints"]).alias("c"))
    q = F.col("c.value.quantity")
    return r.select("idx", "c.constraint_idx", "c.group.group_id", "c.operator", q["v1"].alias("v1"), q["v2"].alias("v2"), q["unit_text"].alias("unit_text"), F.col("c.evidence.text").alias("evidence"))


@query("f02_t18_extraction_status", "SELECT CASE WHEN idx % 97 = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN idx % 97 = 0 THEN 'missing_original_text' ELSE '' END AS reason, count(*) AS n, CAST(sum(CASE WHEN idx % 97 <> 0 AND template <> 7 THEN 1 ELSE 0 END) AS BIGINT) AS constraints FROM {requirements} GROUP BY ALL")
def f02(spark, d):
    r = E.extract(frame(spark, d, "requirements"))
    n = F.coalesce(F.aggregate("record.requirements", F.lit(0), lambda s, x: s + F.size(x["constraints"])), F.lit(0)).cast("bigint")
    return r.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.sum(n).alias("constraints"))


@query("x08_span_contract", "SELECT count(*) AS wrong FROM {requirements} WHERE false")
def x08(spark, d):
    return E.span_errors(E.extract(frame(spark, d, "requirements"))).agg(F.count("*").alias("wrong"))


@query("t15_t16_structure")
def t15(spark, d):
    """Subject, action, object and attribute by the heuristic; no grammar in SQL, so a test holds it."""
    r = E.extract(frame(spark, d, "requirements")).where("status = 'ok'").select("idx", F.col("record.requirements")[0].alias("r"))
    return r.select("idx", F.col("r.structure.subject.text").alias("subject"), F.col("r.structure.action.text").alias("action"), F.col("r.structure.object.text").alias("object"), F.get("r.constraints", F.lit(0))["attribute"]["name"].alias("attribute"))


_TOK = "CASE unit WHEN 'mm' THEN 'm' WHEN 'cm' THEN 'm' WHEN 'kPa' THEN 'pa' WHEN 'ms' THEN 's' ELSE lower(unit) END"


@query("t19_t20_unit_tokens", f"""SELECT idx, CASE WHEN idx % 97 = 0 OR template = 7 THEN '' ELSE {_TOK} || CASE WHEN template = 2 THEN ',' || {_TOK} ELSE '' END END AS tokens, NOT (idx % 97 = 0 OR template = 7) AS has_unit,
    CASE WHEN idx % 97 = 0 OR template = 7 THEN 'other' WHEN unit = '%' THEN 'percent' WHEN unit = 'ms' THEN 'time_rate' ELSE 'mechanical_physical' END AS family FROM {{requirements}}""")
def t19(spark, d):
    r = frame(spark, d, "requirements").withColumn("tok", X.unit_tokens(F.col("original_text")))
    return r.select("idx", F.array_join("tok", ",").alias("tokens"), X.has_number_and_unit(F.col("tok")).alias("has_unit"), X.unit_family(F.col("tok")).alias("family"))


@query("f16_a32_unit_audit", """SELECT CASE WHEN idx % 97 = 0 OR template = 7 THEN 'no_quantity' WHEN unit = 'cm' THEN 'with_unit' ELSE 'without_unit' END AS status, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM {requirements} GROUP BY status""")
def f16(spark, d):
    """Every record is audited; those in which no quantity is found have a status of their own."""
    r = frame(spark, d, "requirements").withColumn("tok", X.unit_tokens(F.col("original_text")))
    status = F.when(F.size("tok") == 0, "no_quantity").when(F.lower("original_text").rlike(r"\d\s*cm\b"), "with_unit").otherwise("without_unit")
    return r.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("t21_t23_model_text", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text ELSE raw END AS unfenced, CASE turn % 3 WHEN 1 THEN text ELSE raw END AS unmarked, CASE WHEN turn % 3 = 2 THEN trim(substr(raw, 6), ' ' || chr(10) || chr(9)) END AS xml
    FROM (SELECT x.conv_id, x.turn, x.raw, trim(c.text, ' ' || chr(10) || chr(9) || chr(13)) AS text FROM {llm_text} x JOIN conversations c ON x.conv_id = c.conv_id AND x.turn = c.turn)""")
def t21(spark, d):
    t = frame(spark, d, "llm_text")
    return t.select("conv_id", "turn", X.strip_fence(F.col("raw")).alias("unfenced"), X.drop_language_lines(F.col("raw")).alias("unmarked"), X.xml_fragment(F.col("raw")).alias("xml"))


@query("t24_strip_examples", "SELECT conv_id, turn, 'Task.' || chr(10) || chr(10) || 'Now solve. ' || trim(text) || chr(10) AS t FROM conversations")
def t24(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    prompt = F.concat(F.lit("Task.\n\n\nExamples:\nx -> y\n\n"), F.lit("Now solve. "), F.col("text"))
    return c.select("conv_id", "turn", X.strip_examples(prompt, "Examples:", ("Now analyze", "Now solve.")).alias("t"))


@query("t25_t30_names", r"""SELECT o AS iri, regexp_extract(o, '[^#/]*$') AS name, array_to_string(list_filter(regexp_split_to_array(lower(regexp_extract(o, '[^#/]*$')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens, CAST(80 AS BIGINT) AS idx FROM (SELECT DISTINCT o FROM {triples} WHERE o_kind = 'iri')""")
def t25(spark, d):
    t = frame(spark, d, "SELECT DISTINCT o AS iri FROM {triples} WHERE o_kind = 'iri'")
    name = X.local_name(F.col("iri"))
    return t.select("iri", name.alias("name"), F.array_join(X.tokens(name), " ").alias("tokens"), X.idx_of_file(F.lit("idx_00080_req_001.json")).alias("idx"))


@query("t26_g12_prefixes", """SELECT conv_id, turn, '@prefix iof: <urn:iof> .' || chr(10) || '@prefix owl: <urn:owl> .' || chr(10) || 'x' AS bare, '@prefix owl: <urn:owl> .' || chr(10) || '@prefix iof: <urn:i> .' AS partly, '@base <http://e.org/' || conv_id || '#> .' || chr(10) || 'x' AS based, 'http://e.org/' || conv_id || '#' AS namespace FROM conversations""")
def t26(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    p = {"iof": "urn:iof", "owl": "urn:owl"}
    based = F.concat(F.lit("@base <http://e.org/"), F.col("conv_id").cast("string"), F.lit("#> .\nx"))
    return c.select("conv_id", "turn", X.ensure_prefixes(F.lit("x"), p).alias("bare"), X.ensure_prefixes(F.lit("@prefix iof: <urn:i> ."), p).alias("partly"), X.enforce_base(based, "http://other.org").alias("based"), X.namespace_of(based).alias("namespace"))


# --- units ---------------------------------------------------------------------------------------

_TOKENS = "SELECT DISTINCT unit AS tok FROM {quantities} UNION SELECT unit FROM {requirements} UNION SELECT * FROM (VALUES ('µm'), (' Mhz '), ('<http://qudt.org/vocab/unit/MilliM>'), ('N\\m'), ('NULL'), ('a\"b'), ('mA'), ('degree')) AS v(tok)"


def _code_sql(x: str) -> str:
    return f"coalesce((SELECT alias FROM {ALIAS_SQL} WHERE name = lower({x})), {x})"


_TOKENS_SQL = f"""(SELECT tok, {_code_sql("compact")} AS code, {_code_sql("inner_code")} AS inner_code FROM (SELECT tok, translate(trim(tok), 'µ' || ' ' || chr(92), 'u') AS compact,
    translate(replace(regexp_replace(trim(tok), '^<(.*)>$', '\\1'), '{UNIT}', ''), 'µ' || ' ' || chr(92), 'u') AS inner_code FROM ({_TOKENS})))"""


@query("q01_q02_unit_tokens", f"""SELECT tok, code, CASE WHEN inner_code IN ('', '?', 'NULL', 'NONE', 'NAN') OR regexp_matches(inner_code, '["''{{}}<>^|`]') THEN NULL ELSE '{UNIT}' || inner_code END AS iri FROM {_TOKENS_SQL}""".replace("{{}}", "\x01"))
def q01(spark, d):
    t = frame(spark, d, _TOKENS.replace("\\m", "\\\\m"))
    return t.select("tok", U.unit_token(F.col("tok")).alias("code"), U.unit_iri(F.col("tok")).alias("iri"))


SQL["q01_q02_unit_tokens"] = SQL["q01_q02_unit_tokens"].replace("\x01", "\\x7b\\x7d")


@query("q03_graph_iris", f"SELECT unit AS tok, '{UNIT}' || unit AS unit_iri, CASE WHEN unit = 'widget' THEN 'http://x/' || unit ELSE '{KIND}' || unit END AS kind_iri FROM (SELECT DISTINCT unit FROM {{quantities}})")
def q03(spark, d):
    t = frame(spark, d, "SELECT DISTINCT unit AS tok FROM {quantities}")
    kind = F.when(F.col("tok") == "widget", F.concat(F.lit("http://x/"), "tok")).otherwise(F.col("tok"))
    return t.select("tok", U.graph_iri(F.col("tok"), UNIT).alias("unit_iri"), U.graph_iri(kind, KIND).alias("kind_iri"))


_SI = f"""(SELECT unit, scaling_of AS si_unit, 'scaling' AS rule FROM {UNITS_SQL} WHERE scaling_of IS NOT NULL UNION ALL SELECT unit, si_unit, 'kind' FROM (
    SELECT a.unit, s.unit AS si_unit, row_number() OVER (PARTITION BY a.unit ORDER BY coalesce(abs(s.multiplier - 1), 'infinity'::DOUBLE), s.seq) AS rn FROM {KINDS_SQL} a JOIN {KINDS_SQL} b ON a.kind = b.kind JOIN {UNITS_SQL} s ON s.unit = b.unit AND s.is_si
    WHERE a.unit NOT IN (SELECT unit FROM {UNITS_SQL} WHERE scaling_of IS NOT NULL)) WHERE rn = 1)"""


@query("q04_j09_j10_si_units", f"SELECT * FROM {_SI}")
def q04(spark, d):
    return U.si_units(U.units(spark), U.unit_kinds(spark))


@query("j04_j06_kind_units", f"SELECT kind, string_agg(code, ',' ORDER BY seq) AS units FROM {KINDS_SQL} GROUP BY kind")
def j04(spark, d):
    return N.units_of_kind(U.unit_kinds(spark)).select("kind", F.array_join("units", ",").alias("units"))


@query("j05_known_kinds", f"""SELECT code, string_agg(kind_code, ',' ORDER BY seq) FILTER (WHERE known OR NOT any_known) AS kinds FROM (SELECT *, bool_or(known) OVER (PARTITION BY code) AS any_known FROM (SELECT *, kind_code IN ('Pressure', 'Distance') AS known FROM {KINDS_SQL})) GROUP BY code""")
def j05(spark, d):
    kinds = U.unit_kinds(spark)
    rows = N.kinds_of(kinds.select("code", F.col("unit").alias("unit_iri")).distinct(), kinds)
    got = N.known_kinds(rows, kinds.where("kind_code IN ('Pressure', 'Distance')"))
    return got.select("code", F.array_join(F.transform("kind_candidates", X.local_name), ",").alias("kinds"))


@query("j11_unit_properties", f"SELECT u.code, u.multiplier, u.shift, regexp_extract(u.scaling_of, '[^/]*$') AS scaling_of, count(k.kind) AS kinds FROM {UNITS_SQL} u LEFT JOIN {KINDS_SQL} k ON u.unit = k.unit GROUP BY ALL")
def j11(spark, d):
    u, k = U.units(spark), U.unit_kinds(spark)
    return u.join(k.select("unit", "kind"), "unit", "left").groupBy("code", "multiplier", "shift", X.local_name(F.col("scaling_of")).alias("scaling_of")).agg(F.count("kind").alias("kinds"))


_BOUNDS = """CASE WHEN operator IN ('gt', 'ge') THEN v - tol WHEN operator IN ('lt', 'le') THEN NULL WHEN two THEN least(v, w) ELSE v - tol END AS lower, CASE WHEN operator IN ('gt', 'ge') THEN NULL WHEN operator IN ('lt', 'le') THEN v + tol WHEN two THEN greatest(v, w) ELSE v + tol END AS upper,
    operator NOT IN ('gt', 'lt', 'le') AS lower_included, operator NOT IN ('gt', 'ge', 'lt') AS upper_included"""


@query("q07_bounds", f"SELECT idx, constraint_idx, seq, round(lower, 6) AS lower, round(upper, 6) AS upper, lower_included, upper_included FROM (SELECT idx, constraint_idx, seq, {_BOUNDS} FROM (SELECT *, v1 AS v, v2 AS w, operator = 'between' AND v2 IS NOT NULL AS two FROM {{quantities}}))")
def q07(spark, d):
    b = frame(spark, d, "quantities").select("idx", "constraint_idx", "seq", U.bounds(F.col("operator"), F.col("v1"), F.col("v2"), F.col("tol")).alias("b"))
    return b.select("idx", "constraint_idx", "seq", F.round("b.lower", 6).alias("lower"), F.round("b.upper", 6).alias("upper"), "b.lower_included", "b.upper_included")


_CODE = "CASE unit WHEN 'metre' THEN 'M' WHEN 'mm' THEN 'MilliM' WHEN 'kilogram' THEN 'KiloGM' WHEN 'pa' THEN 'PA' WHEN 'second' THEN 'SEC' END"
_FACTOR = "CASE unit WHEN 'mm' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END"
NORM_SQL = f"""(SELECT idx, req_idx, constraint_idx, seq, operator, code, si_code, v, w, kind, {_BOUNDS} FROM (SELECT *, {_CODE} AS code, CASE unit WHEN 'mm' THEN 'M' ELSE {_CODE} END AS si_code, v1 * {_FACTOR} AS v, v2 * {_FACTOR} AS w, operator = 'between' AND v2 IS NOT NULL AS two,
    CASE unit WHEN 'metre' THEN 'Length' WHEN 'mm' THEN 'Length' WHEN 'kilogram' THEN 'Mass' WHEN 'pa' THEN 'Pressure' WHEN 'second' THEN 'Time' END AS kind FROM {{quantities}} WHERE {_CODE} IS NOT NULL))"""


def normalized(spark, d):
    return N.normalize(frame(spark, d, "quantities"), U.units(spark), U.unit_kinds(spark))


@query("q11_q13_normalize", f"SELECT idx, req_idx, constraint_idx, seq, kind AS kind_code, code AS best_unit, si_code AS si_unit, round(v, 6) AS si_v1, round(w, 6) AS si_v2, round(lower, 6) AS lower, round(upper, 6) AS upper, lower_included, upper_included FROM {NORM_SQL}")
def q11(spark, d):
    """Unknown units drop; 'pa' resolves by the upper-case fallback."""
    n = normalized(spark, d).where("unit != 'kPa'")
    return n.select("idx", "req_idx", "constraint_idx", "seq", X.local_name(F.col("kind")).alias("kind_code"), X.local_name(F.col("best_unit")).alias("best_unit"), X.local_name(F.col("si_unit")).alias("si_unit"), *[F.round(c, 6).alias(c) for c in ("si_v1", "si_v2", "lower", "upper")], "lower_included", "upper_included")


@query("j07_upper_fallback", f"""SELECT r.unit, first(k.kind_code ORDER BY (k.kind_code <> 'Stress'), k.seq) AS kind, string_agg(DISTINCT k.code, ',') AS units FROM (SELECT DISTINCT unit FROM {{quantities}}) r JOIN {KINDS_SQL} k ON upper(k.code) = upper(CASE r.unit WHEN 'metre' THEN 'M' WHEN 'mm' THEN 'MilliM' WHEN 'kilogram' THEN 'KiloGM' WHEN 'second' THEN 'SEC' ELSE r.unit END) GROUP BY r.unit""")
def j07(spark, d):
    kinds = U.unit_kinds(spark)
    # a table, since the planner would else look up the code of each quantity's unit before the units are a set
    rows = N.fallback(checkpointed(frame(spark, d, "SELECT DISTINCT unit FROM {quantities}"), "units"), kinds, preferred=F.array(F.lit(KIND + "Stress")))
    return rows.where("fallback_kind IS NOT NULL").select("unit", X.local_name(F.col("fallback_kind")).alias("kind"), F.array_join("fallback_units", ",").alias("units"))


@query("j01_w02_last_wins", "SELECT idx, req_idx, constraint_idx, seq, operator, unit, v1 FROM (SELECT *, max(seq) OVER (PARTITION BY idx, req_idx, constraint_idx) AS m FROM {quantities}) WHERE seq = m")
def j01(spark, d):
    q = frame(spark, d, "quantities")
    return N.last_wins(q, ["idx", "req_idx", "constraint_idx"]).select("idx", "req_idx", "constraint_idx", "seq", "operator", "unit", "v1")


@query("p04_extraction_template", f"""SELECT q.idx, q.req_idx, string_agg(q.constraint_idx || ':' || q.operator || ':' || coalesce(n.si_code, '?'), ',' ORDER BY q.constraint_idx, q.operator) AS constraints, count(*) AS n, count(n.si_code) AS n_normalized FROM (SELECT * FROM (SELECT *, max(seq) OVER (PARTITION BY idx, constraint_idx) AS m FROM {{quantities}}) WHERE seq = m) q
    LEFT JOIN (SELECT * FROM {NORM_SQL} WHERE code <> 'x') n ON n.idx = q.idx AND n.constraint_idx = q.constraint_idx AND n.seq = q.seq WHERE q.unit <> 'kPa' GROUP BY q.idx, q.req_idx""")
def p04(spark, d):
    """Constraints of each requirement joined to their normalization."""
    q = N.last_wins(frame(spark, d, "quantities"), ["idx", "req_idx", "constraint_idx"]).where("unit != 'kPa'")
    n = normalized(spark, d).select("idx", "constraint_idx", "seq", X.local_name(F.col("si_unit")).alias("si"))
    j = q.join(n, ["idx", "constraint_idx", "seq"], "left")
    one = F.struct("constraint_idx", "operator", F.concat_ws(":", F.col("constraint_idx").cast("string"), "operator", F.coalesce("si", F.lit("?"))).alias("t"))
    return j.groupBy("idx", "req_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), ",").alias("constraints"), F.count("*").alias("n"), F.count("si").alias("n_normalized"))


@query("p03_p14_flatten", "SELECT idx, req_idx, constraint_idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY req_idx, constraint_idx, seq) - 1 AS BIGINT) AS dense, CASE WHEN constraint_idx < 5 THEN 'attr' || constraint_idx END AS attribute, unit FROM {quantities}")
def p03(spark, d):
    """Positional lookup of each quantity's constraint, null beyond the end; dense renumbering."""
    from pyspark.sql import Window

    q = frame(spark, d, "quantities")
    names = F.array(*[F.lit(f"attr{i}") for i in range(5)])
    w = Window.partitionBy("idx").orderBy("req_idx", "constraint_idx", "seq")
    return q.select("idx", "req_idx", "constraint_idx", (F.row_number().over(w) - 1).cast("bigint").alias("dense"), F.get(names, F.col("constraint_idx")).alias("attribute"), "unit")


@query("p08_context", "SELECT idx, constraint_idx, seq, CASE constraint_idx % 4 WHEN 0 THEN 'attribute: a ; evidence: ' || operator || ' ; value: ' || unit WHEN 1 THEN 'evidence: ' || operator WHEN 2 THEN 'value: ' || unit ELSE 'text ' || idx END AS context FROM {quantities}")
def p08(spark, d):
    m = F.col("constraint_idx") % 4
    e = N.context(F.when(m == 0, "a"), F.when(m.isin(0, 1), F.col("operator")).otherwise(" "), F.when(m.isin(0, 2), F.col("unit")), F.concat(F.lit("text "), F.col("idx").cast("string")))
    return frame(spark, d, "quantities").select("idx", "constraint_idx", "seq", e.alias("context"))


@query("p09_o06_brief", "SELECT idx, CAST(rn AS INT) AS rn, '- req ' || req_idx || ' c ' || constraint_idx || ': ' || operator || ' ' || unit AS line, n > 3 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY req_idx, constraint_idx) AS rn, count(*) OVER (PARTITION BY idx) AS n FROM (SELECT * FROM (SELECT *, max(seq) OVER (PARTITION BY idx, constraint_idx) AS m FROM {quantities}) WHERE seq = m)) WHERE rn <= 3")
def p09(spark, d):
    return N.brief(N.last_wins(frame(spark, d, "quantities"), ["idx", "req_idx", "constraint_idx"]), 3)


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query("j08_o03_nearest", f"""WITH v AS (SELECT vec_id, label, embedding, sqrt({_DOT.format('embedding', 'embedding')}) AS n FROM embeddings),
    c AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round({_DOT.format('v.embedding', 'q.embedding')} / (v.n * q.n), 6) AS cosine FROM v, v q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND v.n > 0 AND q.n > 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INT) AS place FROM c QUALIFY place <= 10),
    pick AS (SELECT query_id, label AS picked FROM r WHERE place = 1), n AS (SELECT label, count(*) AS n_rows FROM embeddings GROUP BY label)
    SELECT r.query_id, place, vec_id, r.label, cosine, picked, n_rows FROM r JOIN pick USING (query_id) LEFT JOIN n ON n.label = picked""")
def j08(spark, d):
    """All vectors whose id is divisible by 20 search all others: the ten nearest, the pick among them,
    and how many rows the pick leads to."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    found = N.nearest(v, F.col("vec_id") % 20 == 0)
    return N.pick_rows(found, v.groupBy("label").agg(F.count("*").alias("n_rows")))


# --- sampling ------------------------------------------------------------------------------------

_STRATA = """(SELECT *, lang || '|' || bucket AS stratum FROM (SELECT doc_id, lang, length(text) AS length, CASE WHEN length(text) <= p33 THEN 'short' WHEN length(text) <= p66 THEN 'medium' ELSE 'long' END AS bucket FROM documents,
    (SELECT quantile_disc(length(text), 0.33) AS p33, quantile_disc(length(text), 0.66) AS p66 FROM documents)))"""
_ALLOC = f"""(SELECT stratum, n, CAST(CASE WHEN total <= 200 THEN n ELSE least(n, whole + CASE WHEN turn <= open_ THEN 1 ELSE 0 END) END AS BIGINT) AS share FROM (SELECT *, row_number() OVER (ORDER BY rest DESC, stratum) AS turn, 200 - sum(whole) OVER () AS open_ FROM (
    SELECT stratum, n, total, (n * 200) // total AS whole, (n * 200) % total AS rest FROM (SELECT stratum, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM {_STRATA} GROUP BY stratum))))"""


@query("w07_a31_strata", f"SELECT stratum, count(*) AS n, min(length) AS shortest, max(length) AS longest FROM {_STRATA} GROUP BY stratum")
def w07(spark, d):
    s = P.with_stratum(spark.read.parquet(f"{d}/documents.parquet"))
    return s.groupBy("stratum").agg(F.count("*").alias("n"), F.min("length").cast("bigint").alias("shortest"), F.max("length").cast("bigint").alias("longest"))


@query("y01_allocation", f"SELECT * FROM {_ALLOC}")
def y01(spark, d):
    return P.allocation(P.with_stratum(spark.read.parquet(f"{d}/documents.parquet")).groupBy("stratum").agg(F.count("*").alias("n")), 200)


_SAMPLE = f"(SELECT doc_id, s.stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM {_STRATA}) s JOIN {_ALLOC} a ON s.stratum = a.stratum WHERE rn <= share)"


@query("y02_stratified_sample", f"SELECT doc_id, stratum FROM {_SAMPLE}")
def y02(spark, d):
    return P.stratified(P.with_stratum(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "stratum"), "doc_id", 200)


@query("u06_y04_split", f"SELECT stratum, count(*) AS n_rest FROM {_STRATA} WHERE doc_id NOT IN (SELECT doc_id FROM {_SAMPLE}) GROUP BY stratum")
def u06(spark, d):
    s = P.with_stratum(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "stratum")
    return P.split(s, P.stratified(s, "doc_id", 200), "doc_id").groupBy("stratum").agg(F.count("*").alias("n_rest"))


@query("y03_family_cover")
def y03(spark, d):
    """The stratified sample of all requirements, repaired so that each family that the table has is in
    it. A loop over families, so SQL has no counterpart; a test holds it."""
    r = frame(spark, d, "requirements").select("idx", F.col("template").cast("string").alias("stratum"), X.unit_family(X.unit_tokens(F.col("original_text"))).alias("family"))
    return P.cover_families(P.stratified(r, "idx", 8), r, "idx", [name for name, _ in X.FAMILIES])
