"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every document is addressed by the SHA-256 of its content. The ledger holds the
(blob, rule version) pairs that have been scanned. A scan takes the unseen pairs only, each blob once
however many paths hold it, and joins its findings back to all paths. Regular expressions run in the
JVM; offsets come from the lengths of the pieces between matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The rules of the base, in their order, then further token formats.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def lengths_of(text: Column, rule: Rule, rank: int) -> Column:
    """Struct (rank, gaps, wholes, groups) of a rule's leftmost non-overlapping matches: the lengths in
    code points of what stands before each match, of the match and of the group that counts. Null for a
    text without a match."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else whole
    size = lambda x: F.length(x)
    one = F.struct(
        F.lit(rank).alias("rank"), F.transform(F.split(text, rule.pattern, -1), size).alias("gaps"),
        F.transform(whole, size).alias("wholes"), F.transform(group, size).alias("groups"),
    )
    return F.when(text.rlike(rule.pattern), one)


def spans_of(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) from rows (blob, found array of `lengths_of`), blobs with spans only.

    A match is a row of numbers here, and its place the sum of what stands before it: a text of many
    matches costs a sort of its rows, never a growing array.
    """
    each = found.select("blob", F.explode("found").alias("f")).select("blob", "f.rank", F.posexplode(F.arrays_zip("f.wholes", "f.groups", "f.gaps")).alias("i", "m"))
    each = each.where("m.wholes IS NOT NULL").repartition("blob")  # one dealing for the sums and for the spans
    upto = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gaps") + F.col("m.wholes")).over(upto).cast("int")
    each = each.select("blob", "rank", end.alias("end"), F.col("m.wholes").alias("n"), F.col("m.groups").alias("g"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rank") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.col("n")).alias("start"), "rank", kind.alias("kind"), "end")
    return each.where(F.col("g") >= least).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def address(text: Column) -> Column:
    return F.sha2(text, 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(new findings, new ledger rows) of a table of versions.

    versions: one row for each historical version, the content in `text` (null: empty); further columns
    are ignored. ledger: (blob, rules) rows that were scanned, `rules` being the sorted rule versions;
    None: nothing was. Findings: (blob, spans), one row for each blob with a match of a rule that the
    ledger did not have for it; spans are sorted. New ledger rows: (blob, rules) for every blob scanned
    now, with or without a match. Both come from a table of the scan, which is made once.
    """
    blobs = versions.select(text_or_empty(text).alias("t")).withColumn("blob", address(F.col("t")))
    distinct = blobs.groupBy("blob").agg(F.first("t").alias("t"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = distinct.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        todo = distinct.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0)
    each = [F.when(F.array_contains("todo", r.key), lengths_of(F.col("t"), r, i)) for i, r in enumerate(rules)]
    found = materialize(todo.select("blob", F.array_sort("todo").alias("rules"), F.array_compact(F.array(*each)).alias("found")), "scanned")
    return spans_of(found, rules), found.select("blob", "rules")


def follow(versions: DataFrame, history: tuple[tuple[Rule, ...], ...], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) of one scan after another, by ever newer rule sets: each scan takes only the
    pairs of blob and rule version that no earlier one had, and all findings are united."""
    findings = ledger = None
    for rules in history:
        got, seen = scan(versions, ledger, rules, text)
        findings, ledger = (got, seen) if findings is None else (findings.unionByName(got), ledger.unionByName(seen))
    return findings, ledger


def findings_by_path(versions: DataFrame, findings: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """versions with the spans of their blob; rows without findings have an empty array.

    findings may come from many scans: a blob's spans are united. A blob that very many paths hold is a
    skewed key of a left join, which the engine splits on the versions' side.
    """
    versions = versions.drop(name) if name in versions.columns else versions
    per_blob = findings.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias(name))
    held = versions.withColumn("__blob", address(text_or_empty(text)))
    return held.join(per_blob.withColumnRenamed("blob", "__blob"), "__blob", "left").drop("__blob").withColumn(name, F.coalesce(name, F.array().cast(SPANS)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with every span replaced by the mask; overlapping or touching spans count as one. A null
    text stays null. What is kept are the pieces before each span that starts after all earlier ends, and
    what stands after the last end."""
    def step(acc, s):
        new = (s["start"] > acc["at"]) | acc["first"]
        cut = F.struct(acc["at"].alias("a"), s["start"].alias("b"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.lit(False).alias("first"), F.when(new, F.concat(acc["cuts"], F.array(cut))).otherwise(acc["cuts"]).alias("cuts"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(True).alias("first"), F.array().cast("array<struct<a:int,b:int>>").alias("cuts"))
    done = F.aggregate(spans, zero, step)
    pieces = F.transform(done["cuts"], lambda c: F.concat(F.substring(text, c["a"] + 1, c["b"] - c["a"]), F.lit(mask)))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, done["at"] + 1, F.length(text))))


def report(docs: DataFrame, findings: DataFrame) -> DataFrame:
    base = [r.kind for r in BASE]
    ids = docs.select("doc_id", text_or_empty().alias("text"))
    got = findings_by_path(ids, findings).drop("text")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in base],
        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Two scans of all documents: by the base rules, then by all rules. The ledger of the first keeps the
    second to the pairs that are new, and the findings of both are joined back to every document."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    findings, _ = follow(docs, (BASE, RULES))
    return report(docs, materialize(findings, "findings"))


def _sql_spans(rule: Rule, rank: int) -> str:
    pattern, group = rule.pattern.replace("'", "''"), rule.group
    whole = f"regexp_extract_all(t, '{pattern}', 0)"
    part = f"regexp_extract_all(t, '{pattern}', {group})"
    return f"""
      SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, i,
             list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS start_at,
             length(whole[i]) AS n, part[i] AS part
      FROM (SELECT doc_id, whole, part, gaps, unnest(range(1, len(whole) + 1)) AS i
            FROM (SELECT doc_id, {whole} AS whole, {part} AS part, string_split_regex(t, '{pattern}') AS gaps FROM docs))
      WHERE length(part[i]) >= {rule.least}"""


def sql() -> str:
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({' UNION ALL '.join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
    spans AS (SELECT doc_id, kind, rank, CAST(start_at AS BIGINT) AS s, kind || ':' || CAST(start_at AS BIGINT) || ':' || CAST(start_at + n AS BIGINT) AS w FROM found),
    per AS (SELECT doc_id,
        count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(w, ',' ORDER BY s, rank) FILTER (WHERE kind IN ({base})) AS base, string_agg(w, ',' ORDER BY s, rank) AS spans
      FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs d LEFT JOIN per USING (doc_id)"""
