"""URL filters by a weighted vocabulary.

An Aho-Corasick automaton counts strict and soft terms in a lower-cased url; a term counts where no
letter or digit touches it. One strict term, or several distinct soft ones, reject the url. Host and
path rules come first: the longest rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, read


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case. `least`: so many distinct soft terms reject."""

    strict: tuple[str, ...] = field(default=("porn", "xxx", "hentai", "escort", "escorts", "nudes", "camgirl", "camgirls", "viagra", "cialis", "jackpot-slots"))
    soft: tuple[str, ...] = field(default=("adult", "bet", "bets", "betting", "bonus", "casino", "cam", "dating", "free", "gambling", "loan", "loans", "nude", "pills", "poker", "sex", "sexy", "slots", "win"))
    least: int = 2


VOCABULARY = Vocabulary()


@lru_cache(maxsize=8)
def automaton(vocabulary: Vocabulary):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in vocabulary.soft:
        a.add_word(t, (t, False))
    for t in vocabulary.strict:
        a.add_word(t, (t, True))
    a.make_automaton()
    return a


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def hits(url: str, vocabulary: Vocabulary = VOCABULARY) -> tuple[int, int]:
    """(strict occurrences, distinct soft terms) in a url; only a-z and 0-9 at an end hinder a match."""
    s = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url) if not url.islower() else url
    strict, soft = 0, set()
    for end, (term, is_strict) in automaton(vocabulary).iter(s):
        start = end - len(term) + 1
        if (start == 0 or not _word(s[start - 1])) and (end + 1 == len(s) or not _word(s[end + 1])):
            if is_strict:
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def with_hits(df: DataFrame, url: str = "url", vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """df with n_strict and n_soft (int); a null url has no hits."""
    prepare(df.sparkSession)
    df = df.drop("n_strict", "n_soft")
    at, schema = df.columns.index(url), T.StructType([*df.schema.fields, T.StructField("n_strict", T.IntegerType()), T.StructField("n_soft", T.IntegerType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [hits(u or "", vocabulary) for u in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.int32()), pa.array([y for _, y in got], pa.int32())], schema.names)

    return df.mapInArrow(go, schema)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both are empty without `://`."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return _lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_for(host: Column, path: Column, rules: tuple[HostRule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. Ties: the first one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge(df: DataFrame, url: str = "url", rules: tuple[HostRule, ...] = RULES, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """df with host, path, n_strict, n_soft, rule and verdict (allow or block). A null url is allowed."""
    df = with_hits(df.drop("host", "path", "rule", "verdict"), url, vocabulary)
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path}).withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    method = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= vocabulary.least), "block").otherwise("allow")
    return df.withColumn("rule", F.col("__rule.rule")).withColumn("verdict", F.coalesce(F.col("__rule.verdict"), method)).drop("__rule")


def op7_urlfilter(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def sql() -> str:
    def term(t: str) -> str:
        return f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"

    def count(t: str) -> str:
        return f"len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){'[^a-z0-9]{2}'.join(t.split('-'))}([^a-z0-9]|$)'))"

    strict = " + ".join(count(t) for t in VOCABULARY.strict)
    soft = " + ".join(term(t) for t in VOCABULARY.soft)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in rules]
    return f"""
    WITH a AS (SELECT page_id, {lower.format("coalesce(url, '')")} AS u,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, u, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
    c AS (SELECT page_id, u, {lower.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
    d AS (SELECT page_id, host, path, CAST({strict} AS INT) AS n_strict, CAST({soft} AS INT) AS n_soft,
        CASE {' '.join(f"WHEN {w} THEN '{r.name}'" for w, r in fits)} END AS rule,
        CASE {' '.join(f"WHEN {w} THEN '{r.verdict}'" for w, r in fits)} END AS ruled FROM c)
    SELECT page_id, host, path, rule, n_strict, n_soft,
        coalesce(ruled, CASE WHEN n_strict > 0 OR n_soft >= {VOCABULARY.least} THEN 'block' ELSE 'allow' END) AS verdict FROM d"""
