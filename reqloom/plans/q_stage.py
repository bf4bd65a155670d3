"""Queries over stage logs, runs, labels and ratings, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqloom.functions import scalars as S
from reqloom.operators import measure as M
from reqloom.plans.fixtures import frame

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_PCT = "quantile_disc({v}, {p})"
_STATS = """count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdev, min(v) AS least, max(v) AS most, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95"""
_EXTERNAL = "(" + " OR ".join(f"contains(coalesce(reason, ''), '{x}')" for x in M.EXTERNAL) + ")"


@query("p01_idx_coercion", r"SELECT idx, CASE WHEN regexp_full_match(raw_idx, '\s*[+-]?[0-9]+\s*') THEN CAST(trim(raw_idx) AS BIGINT) ELSE idx END AS coerced FROM {stage_rows}")
def p01(spark, d):
    return frame(spark, d, "stage_rows").select("idx", S.coerce_idx(F.col("raw_idx"), F.col("idx")).alias("coerced"))


@query("p02_float_coercion", "SELECT idx, TRY_CAST(trim(raw_idx) AS DOUBLE) AS value FROM {stage_rows}")
def p02(spark, d):
    return frame(spark, d, "stage_rows").select("idx", S.coerce_float(F.col("raw_idx")).alias("value"))


@query("a01_status_distribution", "SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM {stage_rows} GROUP BY ALL")
def a01(spark, d):
    return M.status_distribution(frame(spark, d, "stage_rows"))


@query("a02_a03_nested_counts", "SELECT sum(n_constraints) AS constraints, sum(n_normalized) AS normalized, sum(CASE WHEN status = 'ok' THEN n_constraints END) AS ok_constraints, sum(CASE WHEN status = 'ok' THEN n_normalized END) AS ok_normalized, round(CASE WHEN sum(n_constraints) <> 0 THEN CAST(sum(n_normalized) AS DOUBLE) / sum(n_constraints) END, 6) AS coverage, round(CASE WHEN sum(CASE WHEN status = 'ok' THEN n_constraints END) <> 0 THEN CAST(sum(CASE WHEN status = 'ok' THEN n_normalized END) AS DOUBLE) / sum(CASE WHEN status = 'ok' THEN n_constraints END) END, 6) AS normalized_over_extracted FROM {stage_rows}")
def a02(spark, d):
    """Counts of nested arrays and both coverage definitions."""
    rows = frame(spark, d, "stage_rows").withColumn("c", F.array_repeat(F.lit("quantity"), F.col("n_constraints").cast("int"))).withColumn("q", F.array_repeat(F.lit(1), F.col("n_normalized").cast("int")))
    n, m, ok = F.size(F.filter("c", lambda k: k == "quantity")).cast("bigint"), F.size("q").cast("bigint"), F.col("status") == "ok"
    out = rows.agg(F.sum(n).alias("constraints"), F.sum(m).alias("normalized"), F.sum(F.when(ok, n)).alias("ok_constraints"), F.sum(F.when(ok, m)).alias("ok_normalized"))
    return out.select("*", S.rounded(S.ratio(F.col("normalized"), F.col("constraints"))).alias("coverage"), S.rounded(S.ratio(F.col("ok_normalized"), F.col("ok_constraints"))).alias("normalized_over_extracted"))


@query("a06_a07_latency", f"SELECT status, {_STATS} FROM (SELECT status, CASE WHEN seconds >= 0 THEN seconds END AS v FROM {{stage_rows}}) GROUP BY status")
def a06(spark, d):
    return M.latency(frame(spark, d, "stage_rows"), "status")


@query("a08_completion", """SELECT e.n AS n_input, e.ok AS n_extracted, m.ok AS n_normalized, g.ok AS n_end_to_end, round(CAST(e.ok AS DOUBLE) / e.n, 6) AS extraction_rate,
    round(CAST(m.ok AS DOUBLE) / e.ok, 6) AS normalization_rate, round(CAST(g.ok AS DOUBLE) / e.n, 6) AS end_to_end_rate
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok FROM {stage_rows}) e,
    (SELECT count(*) FILTER (WHERE status = 'ok' AND n_normalized > 0) AS ok FROM {stage_rows}) m,
    (SELECT count(*) FILTER (WHERE status = 'ok' AND n_normalized > 0 AND idx % 3 <> 0 AND idx % 5 <> 0) AS ok FROM {stage_rows}) g""")
def a08(spark, d):
    rows = frame(spark, d, "stage_rows")
    norm = rows.withColumn("status", F.when((F.col("status") == "ok") & (F.col("n_normalized") > 0), "ok").when(F.col("status") == "ok", "failed").otherwise("skipped"))
    return M.completion(rows, norm, norm.withColumn("has_graph", F.col("idx") % 3 != 0).withColumn("has_inferred", F.col("idx") % 5 != 0))


@query("a09_fidelity", """SELECT count(*) AS n, count(*) FILTER (WHERE constraint_idx BETWEEN 0 AND 5) AS n_valid, count(*) FILTER (WHERE unit <> 'widget') AS n_with_unit,
    round(CAST(count(*) FILTER (WHERE constraint_idx BETWEEN 0 AND 5) AS DOUBLE) / count(*), 6) AS index_integrity, round(CAST(count(*) FILTER (WHERE unit <> 'widget') AS DOUBLE) / count(*), 6) AS unit_completeness FROM {quantities}""")
def a09(spark, d):
    q = frame(spark, d, "quantities")
    return M.fidelity(q.select(F.lit(6).alias("n_constraints"), "constraint_idx", F.lit(" ").alias("best_unit"), F.when(F.col("unit") != "widget", F.col("unit")).alias("si_unit")))


@query("a10_hallucination", """SELECT count(*) AS graphs_without_quantities, count(*) FILTER (WHERE mentions) AS hallucinated, round(CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE mentions) AS DOUBLE) / count(*) END, 6) AS rate,
    coalesce(string_agg(CASE WHEN mentions THEN CAST(idx AS VARCHAR) END, ',' ORDER BY idx), '') AS idx_list
    FROM (SELECT idx, idx % 35 = 0 AS mentions FROM {stage_rows} WHERE n_constraints = 0 AND status = 'ok')""")
def a10(spark, d):
    rows = frame(spark, d, "stage_rows").where("n_constraints = 0 AND status = 'ok'")
    text = F.when(F.col("idx") % 35 == 0, F.lit("x a qudt:QuantityValue .")).otherwise(F.lit("x a iof:Thing ."))
    hit = rows.select("idx", text.contains("QuantityValue").alias("m"))
    out = hit.agg(F.count("*").alias("graphs_without_quantities"), S.count_where(F.col("m")).alias("hallucinated"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("m"), F.col("idx")))).cast("array<string>"), ",").alias("idx_list"))
    return out.select("graphs_without_quantities", "hallucinated", S.rounded(S.ratio(F.col("hallucinated"), F.col("graphs_without_quantities"))).alias("rate"), "idx_list")


@query("a11_uniqueness", "SELECT count(*) AS files, count(DISTINCT sha256(text)) AS distinct_files, round(CAST(count(DISTINCT sha256(text)) AS DOUBLE) / count(*), 6) AS uniqueness FROM documents")
def a11(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").agg(F.count("*").alias("files"), F.countDistinct(F.sha2("text", 256)).alias("distinct_files"))
    return t.select("*", S.rounded(S.ratio(F.col("distinct_files"), F.col("files"))).alias("uniqueness"))


@query("a12_inference_delta", f"""SELECT graph_kind, {_STATS} FROM (SELECT kind AS graph_kind, CASE WHEN v >= 0 THEN v END AS v FROM (
    SELECT graph_id, unnest(['asserted', 'inferred', 'delta']) AS kind, unnest([a, b, b - a]) AS v FROM (
    SELECT graph_id, count(*) AS a, count(*) FILTER (WHERE p <> 'http://qudt.org/schema/qudt/unit') + CASE WHEN graph_id % 2 = 0 THEN 100 ELSE 0 END AS b FROM {{triples}} GROUP BY graph_id))) GROUP BY graph_kind""")
def a12(spark, d):
    """Triple counts of asserted and inferred graphs and their difference; negative ones drop."""
    from reqloom.operators.graph import triple_counts

    t = frame(spark, d, "triples")
    a = triple_counts(t, once=True).withColumnRenamed("n_triples", "a")
    b = triple_counts(t.where("p != 'http://qudt.org/schema/qudt/unit'"), once=True).select("graph_id", (F.col("n_triples") + F.when(F.col("graph_id") % 2 == 0, 100).otherwise(0)).alias("b"))
    long = a.join(b, "graph_id").select(F.expr("stack(3, 'asserted', a, 'inferred', b, 'delta', b - a) AS (graph_kind, v)"))
    return long.groupBy("graph_kind").agg(*S.stats("v"))


@query("a13_failures", f"""SELECT *, round(CASE WHEN n_ok + n_failed <> 0 THEN CAST(n_failed AS DOUBLE) / (n_ok + n_failed) END, 6) AS failed_rate, round(CASE WHEN n_ok + n_failed <> 0 THEN CAST(n_external AS DOUBLE) / (n_ok + n_failed) END, 6) AS external_rate
    FROM (SELECT count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'failed' AND {_EXTERNAL}) AS n_external FROM {{stage_rows}})""")
def a13(spark, d):
    return M.failures(frame(spark, d, "stage_rows"))


@query("a14_a15_run_history", f"""WITH runs AS (SELECT run_id, count(*) AS records, round(sum(seconds), 4) AS duration, round(CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) / count(*), 6) AS failed_rate FROM {{stage_rows}} GROUP BY run_id),
    long AS (SELECT unnest(['throughput', 'duration', 'failed_rate']) AS metric, unnest([round(records * 60 / duration, 6), duration, failed_rate]) AS v FROM runs)
    SELECT metric, count(v) AS n, round(avg(v), 4) AS mean, min(v) AS least, max(v) AS most, quantile_disc(v, 0.5) AS p50 FROM long GROUP BY metric""")
def a14(spark, d):
    """Throughput of each run and the spread of run metrics over the history."""
    rows = frame(spark, d, "stage_rows")
    runs = rows.groupBy("run_id").agg(F.count("*").alias("records"), F.round(F.sum("seconds"), 4).alias("duration"), S.rounded(S.ratio(S.count_where(F.col("status") == "failed"), F.count("*"))).alias("failed_rate"))
    runs = runs.withColumn("throughput", F.round(F.col("records") * 60 / F.col("duration"), 6))
    long = runs.select(F.expr("stack(3, 'throughput', throughput, 'duration', duration, 'failed_rate', failed_rate) AS (metric, v)"))
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), S.nearest_rank("v", 0.5).alias("p50"))


@query("j19_run_comparison", """SELECT run_id, count(*) AS records, round(CAST(count(*) FILTER (WHERE status = 'ok') AS DOUBLE) / count(*), 6) AS ok_rate, CAST(sum(n_normalized) AS BIGINT) AS normalized,
    quantile_disc(CASE WHEN seconds >= 0 THEN seconds END, 0.95) AS p95, row_number() OVER (ORDER BY CAST(count(*) FILTER (WHERE status = 'ok') AS DOUBLE) / count(*) DESC, run_id) AS place FROM {stage_rows} GROUP BY run_id""")
def j19(spark, d):
    """Runs side by side, best first; one row a run is ranked."""
    from pyspark.sql import Window

    rate = S.ratio(S.count_where(F.col("status") == "ok"), F.count("*"))
    runs = frame(spark, d, "stage_rows").groupBy("run_id").agg(F.count("*").alias("records"), rate.alias("rate"), F.sum("n_normalized").cast("bigint").alias("normalized"), S.nearest_rank("CASE WHEN seconds >= 0 THEN seconds END", 0.95).alias("p95"))
    place = F.row_number().over(Window.orderBy(F.col("rate").desc(), "run_id")).cast("bigint")
    return runs.select("run_id", "records", S.rounded(F.col("rate")).alias("ok_rate"), "normalized", "p95", place.alias("place"))


@query("a24_automatic_summary", """SELECT count(*) AS records, count(*) FILTER (WHERE status = 'ok') AS n_ok, sum(n_normalized) AS normalized,
    quantile_disc(CASE WHEN status = 'ok' AND seconds >= 0 THEN seconds END, 0.95) AS p95_ok, quantile_disc(CASE WHEN seconds >= 0 THEN seconds END, 0.95) AS p95_all FROM {stage_rows}""")
def a24(spark, d):
    ok = "CASE WHEN status = 'ok' AND seconds >= 0 THEN seconds END"
    return frame(spark, d, "stage_rows").agg(F.count("*").alias("records"), S.count_where(F.col("status") == "ok").alias("n_ok"), F.sum("n_normalized").alias("normalized"), S.nearest_rank(ok, 0.95).alias("p95_ok"), S.nearest_rank("CASE WHEN seconds >= 0 THEN seconds END", 0.95).alias("p95_all"))


@query("f02_f07_status_cascade", f"""SELECT stage, status, coalesce(reason, '') AS reason, count(*) AS n FROM (
    SELECT 'normalization' AS stage, CASE WHEN coalesce(status, '') <> 'ok' THEN 'skipped' WHEN n_normalized = 0 THEN 'failed' ELSE 'ok' END AS status,
      CASE WHEN coalesce(status, '') <> 'ok' THEN 'extraction_' || coalesce(status, 'unknown') WHEN n_normalized = 0 THEN 'no quantity' END AS reason FROM {{stage_rows}}
    UNION ALL SELECT 'extraction', CASE WHEN {_EXTERNAL} THEN 'external' ELSE coalesce(status, 'unknown') END, NULL FROM {{stage_rows}}) GROUP BY ALL""")
def f02(spark, d):
    """A failed stage is failed there and skipped downstream: columns, not exceptions."""
    rows = frame(spark, d, "stage_rows")
    ok = F.coalesce(F.col("status"), F.lit("")) == "ok"
    norm = rows.select(F.lit("normalization").alias("stage"), F.when(~ok, "skipped").when(F.col("n_normalized") == 0, "failed").otherwise("ok").alias("status"), F.when(~ok, F.concat(F.lit("extraction_"), F.coalesce("status", F.lit("unknown")))).when(F.col("n_normalized") == 0, "no quantity").alias("reason"))
    ext = rows.select(F.lit("extraction").alias("stage"), F.when(M.is_external(F.col("reason")), "external").otherwise(F.coalesce("status", F.lit("unknown"))).alias("status"), F.lit(None).cast("string").alias("reason"))
    return norm.unionByName(ext).groupBy("stage", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


# --- ground truth --------------------------------------------------------------------------------

_SLOTS = " UNION ALL ".join(f"SELECT '{s}' AS slot, {s}_correct AS ok, decomposition_error AS e FROM {{gt_labels}}" for s in M.SLOTS)
_ACC = "count(*) FILTER (WHERE ok) AS correct, count(ok) AS judged, round(CASE WHEN count(ok) > 0 THEN CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(ok) END, 6) AS accuracy"


@query("a16_a17_slot_accuracy", f"SELECT slot, {_ACC} FROM ({_SLOTS}) GROUP BY slot")
def a16(spark, d):
    return M.slot_accuracies(frame(spark, d, "gt_labels"))


@query("a17_macro_accuracy", f"SELECT count(accuracy) AS n_slots, round(avg(accuracy), 6) AS macro_accuracy FROM (SELECT slot, {_ACC} FROM ({_SLOTS}) GROUP BY slot)")
def a17(spark, d):
    return M.macro_accuracy(M.slot_accuracies(frame(spark, d, "gt_labels")))


@query("a18_conditional_accuracy", f"SELECT slot, {_ACC} FROM ({_SLOTS}) WHERE e = false GROUP BY slot")
def a18(spark, d):
    return M.slot_accuracies(frame(spark, d, "gt_labels"), conditional=True)


@query("a19_decomposition", """SELECT count(*) FILTER (WHERE decomposition_error) AS errors, count(decomposition_error) AS judged, round(CASE WHEN count(decomposition_error) > 0 THEN CAST(count(*) FILTER (WHERE decomposition_error) AS DOUBLE) / count(decomposition_error) END, 6) AS error_rate,
    round(CASE WHEN count(decomposition_error) > 0 THEN CAST(count(*) FILTER (WHERE NOT decomposition_error) AS DOUBLE) / count(decomposition_error) END, 6) AS accuracy FROM {gt_labels}""")
def a19(spark, d):
    e = F.col("decomposition_error")
    errors, judged, rate = M.bool_accuracy(e)
    return frame(spark, d, "gt_labels").agg(errors.alias("errors"), judged.alias("judged"), rate.alias("error_rate"), S.rounded(S.ratio(S.count_where(~e), F.count(e))).alias("accuracy"))


_PARTS = ", ".join(f"count(*) FILTER (WHERE is_true AND {k}_correct) AS {k}_ok, count(CASE WHEN is_true THEN {k}_correct END) AS {k}_judged" for k in ("operator", "value", "unit"))


@query("a20_quantity_quality", f"""SELECT *, round(CASE WHEN n_judged <> 0 THEN CAST(n_true AS DOUBLE) / n_judged END, 6) AS precision, round(CASE WHEN n_true + n_missing <> 0 THEN CAST(n_true AS DOUBLE) / (n_true + n_missing) END, 6) AS recall
    FROM (SELECT count(*) FILTER (WHERE is_true) AS n_true, count(is_true) AS n_judged, CAST(sum(n_missing) AS BIGINT) AS n_missing, {_PARTS} FROM {{gt_labels}})""")
def a20(spark, d):
    return M.quantity_quality(frame(spark, d, "gt_labels"))


@query("a21_claim_quality", """WITH x AS (SELECT count(*) FILTER (WHERE supported) AS tp, count(*) FILTER (WHERE NOT supported) AS fp, count(supported) AS annotated, count(*) AS total FROM {claims}),
    y AS (SELECT count(*) AS fn FROM {claims} WHERE idx % 17 = 0 AND length(o) % 10 <> 3), z AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS p, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS r FROM x, y)
    SELECT tp, fp, fn, annotated, total, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) END, 6) AS f1, round(CAST(annotated AS DOUBLE) / nullif(total, 0), 6) AS coverage FROM z""")
def a21(spark, d):
    c = frame(spark, d, "claims")
    missing = c.where("idx % 17 = 0").withColumn("o", F.when(F.length("o") % 10 == 3, " ").otherwise(F.col("o")))
    return M.claim_quality(c, missing)


@query("a35_row_patterns", """SELECT count(*) AS rows_judged, count(*) FILTER (WHERE s) AS all_slots, count(*) FILTER (WHERE s AND q) AS slots_and_quantities FROM (
    SELECT subject_correct AND modality_correct AND condition_correct AND action_correct AND object_correct AS s, is_true AND value_correct AS q FROM {gt_labels} WHERE decomposition_error IS NOT NULL)""")
def a35(spark, d):
    slots = F.lit(True)
    for s in M.SLOTS:
        slots = slots & F.col(f"{s}_correct")
    return frame(spark, d, "gt_labels").where("decomposition_error IS NOT NULL").agg(F.count("*").alias("rows_judged"), S.count_where(slots).alias("all_slots"), S.count_where(slots & F.col("is_true") & F.col("value_correct")).alias("slots_and_quantities"))


# --- agreement -----------------------------------------------------------------------------------

_ITEMS = "SELECT label, item, count(*) FILTER (WHERE rating) AS t, count(*) FILTER (WHERE NOT rating) AS f FROM {ratings} WHERE rating IS NOT NULL GROUP BY label, item"
_AGREE = f"""SELECT label, rated_items, items_with_2plus, max_raters, agreeing_pairs, total_pairs, round(CASE WHEN total_pairs <> 0 THEN CAST(agreeing_pairs AS DOUBLE) / total_pairs END, 6) AS agreement,
    round(CASE WHEN pairable > 1 AND st * sf <> 0 THEN 1 - (off / pairable) / (2.0 * st * sf / (CAST(pairable AS DOUBLE) * (pairable - 1))) END, 6) AS alpha
    FROM (SELECT label, count(*) AS rated_items, count(*) FILTER (WHERE t + f >= 2) AS items_with_2plus, max(t + f) AS max_raters, CAST(sum(t * (t - 1) // 2 + f * (f - 1) // 2) AS BIGINT) AS agreeing_pairs, CAST(sum((t + f) * (t + f - 1) // 2) AS BIGINT) AS total_pairs,
      CAST(sum(t + f) FILTER (WHERE t + f >= 2) AS DOUBLE) AS pairable, CAST(sum(t) FILTER (WHERE t + f >= 2) AS DOUBLE) AS st, CAST(sum(f) FILTER (WHERE t + f >= 2) AS DOUBLE) AS sf, sum(round(CAST(2 * t * f AS DOUBLE) / (t + f - 1), 9)) FILTER (WHERE t + f >= 2) AS off FROM ({_ITEMS}) GROUP BY label)"""
_KAPPA = """SELECT label, a, b, n, same, CASE WHEN pe <> 1 THEN round((CAST(same AS DOUBLE) / n - pe) / (1 - pe), 6) END AS kappa FROM (
    SELECT *, CAST(ta * tb + (n - ta) * (n - tb) AS DOUBLE) / (n * n) AS pe FROM (SELECT x.label, x.annotator AS a, y.annotator AS b, count(*) AS n, count(*) FILTER (WHERE x.rating = y.rating) AS same, CAST(sum(CAST(x.rating AS INT)) AS BIGINT) AS ta, CAST(sum(CAST(y.rating AS INT)) AS BIGINT) AS tb
    FROM {ratings} x JOIN {ratings} y ON x.label = y.label AND x.item = y.item AND x.annotator < y.annotator WHERE x.rating IS NOT NULL AND y.rating IS NOT NULL GROUP BY ALL))"""


@query("a25_a26_agreement", _AGREE)
def a25(spark, d):
    return M.agreement(frame(spark, d, "ratings"))


@query("a27_j17_kappa", _KAPPA)
def a27(spark, d):
    return M.kappas(frame(spark, d, "ratings"))


@query("a28_kappa_summary", f"SELECT label, count(kappa) AS pairs, round(round(sum(kappa * n), 6) / sum(CASE WHEN kappa IS NOT NULL THEN n END), 6) AS weighted_kappa, min(kappa) AS least, max(kappa) AS most FROM ({_KAPPA}) GROUP BY label")
def a28(spark, d):
    return M.kappa_summary(M.kappas(frame(spark, d, "ratings")))


@query("a29_annotator_counts", "SELECT label, annotator, count(rating) AS rated, count(*) FILTER (WHERE rating) AS n_true, count(*) FILTER (WHERE NOT rating) AS n_false FROM {ratings} GROUP BY ALL")
def a29(spark, d):
    return M.annotator_counts(frame(spark, d, "ratings"))


@query("a30_group_means", f"SELECT count(*) AS labels, round(avg(agreement), 6) AS mean_agreement, round(avg(alpha), 6) AS mean_alpha FROM ({_AGREE})")
def a30(spark, d):
    return M.group_means(M.agreement(frame(spark, d, "ratings")))


@query("t28_percent_text", """SELECT label, CASE WHEN a IS NULL THEN 'n/a' ELSE printf('%.2f%%', a * 100) END AS two_places, CASE WHEN a IS NULL THEN 'n/a' ELSE printf('%.1f%%', a * 100) END AS one_place FROM (SELECT label, CASE WHEN label <> 'view' THEN CAST(count(*) FILTER (WHERE rating) AS DOUBLE) / 4096 END AS a FROM {ratings} GROUP BY label)""")
def t28(spark, d):
    a = frame(spark, d, "ratings").groupBy("label").agg(F.when(F.col("label") != "view", S.count_where(F.col("rating")) / F.lit(4096.0)).alias("a"))
    return a.select("label", S.percent_text(F.col("a")).alias("two_places"), S.percent_text(F.col("a"), 1).alias("one_place"))
