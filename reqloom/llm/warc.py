"""WARC Merkle fixity audit, in DataFrame functions; files are read by Arrow.

A WARC file is a row of records at ascending offsets. A record's digest is the SHA-256 of its bytes;
the leaf of an offset range is the SHA-256 of its records' `offset:length:digest` lines, an inner node
that of its children's. A file's tree is as high as its own length wants it. Two replicas are compared
root by root; only children of nodes that differ are looked at, level by level, until the ranges and then
the records that differ are left.

No group holds more than the records of one offset range or FANOUT children, and no task sums a file:
offsets come from sums over runs of records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, read

#: Bytes in a leaf's range; children of a node; least levels above the leaves; records in a built file.
RANGE, FANOUT, LEVELS, FILE_RECORDS = 65536, 16, 3, 512


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A resource record as text; null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def layout(pages: DataFrame, keep: tuple[str, ...] = (), file_records: int = FILE_RECORDS) -> DataFrame:
    """(page_id, *keep, file_id, at, length, digest): the records of pages in files of a run of page ids.

    Records without a page_id go by their digest to files -1, -2, ... of about `file_records` each.
    Records stand by page_id, then digest; equal ones follow each other. A page_id that many records have
    is summed in runs of equal beginnings of the digest, so no task holds all of it.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    held = pages.select("page_id", *keep, F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    held = materialize(held, "records")
    files = max(1, -(-held.where("page_id IS NULL").count() // file_records))  # a number only
    lone = -1 - F.pmod(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"), F.lit(files))
    held = held.withColumn("file_id", F.coalesce(F.floor(F.col("page_id") / file_records), lone).cast("long")).withColumn("run", F.substring("digest", 1, 2))
    per = held.groupBy("file_id", "page_id", "run").agg(F.sum("length").alias("n"))
    before = Window.partitionBy("file_id").orderBy("page_id", "run").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("file_id").alias("f2"), F.col("page_id").alias("p2"), F.col("run").alias("r2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file_id", "page_id", "run").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("within", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    out = held.join(per, (F.col("file_id") == F.col("f2")) & F.col("page_id").eqNullSafe(F.col("p2")) & (F.col("run") == F.col("r2")))
    return out.select("page_id", *keep, "file_id", "length", "digest", (F.col("base") + F.col("within")).alias("at"))


def records_in(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """(offset, length, digest) of a file's records. What can't be read as a record is one, to the file's
    end, so that an audit finds it."""
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        size = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", raw[at:head]) if head >= 0 and raw.startswith(b"WARC/", at) else None
        end = min(len(raw), head + 4 + int(size[1]) + 4) if size else len(raw)
        yield at, end - at, hashlib.sha256(raw[at:end]).hexdigest()
        at = end


def read_files(spark: SparkSession, path: str, pattern: str = "*.warc") -> DataFrame:
    """(file_id string, at, length, digest) of the plain WARC files below path, as `audit` takes them; an
    empty file has no records. A file is in one task, which holds it (a file of the usual 1 GB, say)."""
    files = prepare(spark).read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(name, *r) for r in records_in(raw.as_py() or b"")]
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file_id", "at", "length", "digest"])

    return files.select(F.regexp_extract("path", r"[^/]*$", 0).alias("file_id"), "content").mapInArrow(go, "file_id string, at long, length long, digest string")


def heights(a: DataFrame, b: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT, least: int = LEVELS) -> DataFrame:
    """(file_id, ha, hb, h): the levels above the leaves that each replica's file wants, and the greater.

    A file has LEVELS levels, or as many more as bring its ranges to one root.
    """
    def of(df: DataFrame, name: str) -> DataFrame:
        last = df.groupBy("file_id").agg(F.max("at").alias("last"))
        leaves, want = F.floor(F.col("last") / range_bytes) + 1, F.lit(least)
        for n in range(least, 40):
            if fanout**n >= 1 << 62:
                break
            want = F.when(leaves > F.lit(fanout**n).cast("long"), n + 1).otherwise(want)
        return last.select("file_id", want.alias(name))

    both = of(a, "ha").join(of(b, "hb"), "file_id", "full_outer")
    return both.withColumn("h", F.greatest(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))))


def tree(records: DataFrame, height: DataFrame, own: str, range_bytes: int = RANGE, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """([leaves, ..., top], roots) as (file_id, node, hash) tables of records (file_id, at, length,
    digest). Levels go up to the file's h; its root is its only node at the height `own`."""
    line = F.concat_ws(":", F.lpad(F.col("at").cast("string"), 20, "0"), F.col("length").cast("string"), "digest")
    level = records.groupBy("file_id", F.floor(F.col("at") / range_bytes).alias("node")).agg(_sealed(line))
    out, roots = [materialize(level, "leaves")], None
    top = height.agg(F.max("h")).first()[0] or 0
    for n in range(1, top + 1):
        line = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "hash")
        below = out[-1] if n <= LEVELS else out[-1].join(height.where(F.col("h") >= n).select("file_id"), "file_id", "left_semi")
        out.append(materialize(below.groupBy("file_id", F.floor(F.col("node") / fanout).alias("up")).agg(_sealed(line)).withColumnRenamed("up", "node"), "nodes"))
        if n >= LEVELS:
            mine = out[-1].join(height.where(F.col(own) == n).select("file_id"), "file_id", "left_semi").select("file_id", "hash")
            roots = mine if roots is None else roots.unionByName(mine)
    return out, roots if roots is not None else out[0].select("file_id", "hash").limit(0)


def _sealed(line: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash")


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.withColumnRenamed("hash", "ha"), b.withColumnRenamed("hash", "hb")
    return x.join(y, ["file_id", "node"], "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file_id", "node")


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(roots, faults) of two replicas, each (file_id, at, length, digest).

    roots: (file_id, root, replica_root), null where a replica lacks the file. faults: (file_id, at,
    status) for each record that is corrupt (another digest or length at the offset), missing (only in
    a) or extra (only in b). Equal replicas, and empty ones, have no faults. Records that stand at one
    offset of one file are compared as a whole.
    """
    prepare(a.sparkSession)
    one = lambda df: df.groupBy("file_id", "at").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("length").cast("string"), "digest"))), ",").alias("digest"), F.sum("length").alias("length"))
    a, b = one(a), one(b)
    height = materialize(heights(a, b, range_bytes, fanout), "heights")
    (ta, ra), (tb, rb) = tree(a, height, "ha", range_bytes, fanout), tree(b, height, "hb", range_bytes, fanout)
    roots = ra.withColumnRenamed("hash", "root").join(rb.withColumnRenamed("hash", "replica_root"), "file_id", "full_outer")
    bad = None
    for n in range(len(ta) - 1, -1, -1):
        whole = height.where(F.col("h") == n).select("file_id")
        parents = bad.withColumnRenamed("node", "up") if bad is not None else None

        def looked_at(df: DataFrame, n=n, whole=whole, parents=parents) -> DataFrame:
            """The top nodes of the files that are so high, and the children of nodes that differ."""
            out = df.join(whole, "file_id", "left_semi") if n >= LEVELS or parents is None else None
            if parents is None:
                return out
            child = df.withColumn("up", F.floor(F.col("node") / fanout)).join(parents, ["file_id", "up"], "left_semi").drop("up")
            return child if out is None else out.unionByName(child)

        bad = materialize(_differing(looked_at(ta[n]), looked_at(tb[n])), "differing")
    ranges = bad.withColumnRenamed("node", "leaf")
    inside = lambda df: df.withColumn("leaf", F.floor(F.col("at") / range_bytes)).join(ranges, ["file_id", "leaf"], "left_semi").select("file_id", "at", "length", "digest")
    x = inside(a).withColumnsRenamed({"length": "la", "digest": "da"})
    y = inside(b).withColumnsRenamed({"length": "lb", "digest": "db"})
    both = x.join(y, ["file_id", "at"], "full_outer")
    status = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").when(~F.col("da").eqNullSafe(F.col("db")), "corrupt")
    return roots, both.withColumn("status", status).where("status IS NOT NULL").select("file_id", "at", "status")


def damaged(pages: DataFrame) -> DataFrame:
    """pages with replica_length and replica_digest, as the second replica of the query has them: a byte
    of every 97th page is another, every 211th page is lost (null)."""
    text = F.coalesce(F.col("html"), F.lit(""))
    hit = F.when((F.pmod("page_id", F.lit(97)) == 5) & (F.length(text) > 0), F.concat(F.lit("\x00"), F.substr(text, F.lit(2)))).otherwise(text)
    bad = record(F.col("page_id"), F.col("url"), hit)
    lost = F.coalesce(F.pmod("page_id", F.lit(211)) == 7, F.lit(False))
    return pages.withColumn("replica_length", F.when(~lost, F.octet_length(bad).cast("long"))).withColumn("replica_digest", F.when(~lost, F.sha2(bad, 256)))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Each page's record, its place and digest, its file's roots in both replicas and the verdict."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    both = materialize(layout(damaged(pages), ("replica_length", "replica_digest")), "records")
    built = both.drop("replica_length", "replica_digest")
    # a replica is read at the offsets of the index
    replica = both.where("replica_digest IS NOT NULL").select("file_id", "at", F.col("replica_length").alias("length"), F.col("replica_digest").alias("digest"))
    roots, faults = audit(built.select("file_id", "at", "length", "digest"), replica)
    out = built.join(roots, "file_id", "left").join(faults, ["file_id", "at"], "left")
    return out.select(
        "page_id", "file_id", F.col("at").alias("record_offset"), F.col("length").alias("record_length"), F.col("digest").alias("record_sha256"),
        "root", "replica_root", F.coalesce("status", F.lit("intact")).alias("status"),
    )


def sql() -> str:
    def rec(html: str) -> str:
        return f"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
          || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: '
          || strlen({html}) || chr(13) || chr(10) || chr(13) || chr(10) || {html} || chr(13) || chr(10) || chr(13) || chr(10)"""

    def up(name: str, below: str, columns: str = "file_id, {} AS node") -> str:
        return f"{name} AS (SELECT file_id, node // {FANOUT} AS node, sha256(string_agg(lpad(CAST(node AS VARCHAR), 20, '0') || ':' || hash, chr(10) ORDER BY node)) AS hash FROM {below} GROUP BY ALL)"

    def side(s: str, table: str) -> str:
        leaf = f"{s}0 AS (SELECT file_id, record_offset // {RANGE} AS node, sha256(string_agg(lpad(CAST(record_offset AS VARCHAR), 20, '0') || ':' || n || ':' || n || ':' || digest, chr(10) ORDER BY record_offset)) AS hash FROM {table} GROUP BY ALL)"
        return ", ".join([leaf, *[up(f"{s}{i}", f"{s}{i - 1}") for i in range(1, LEVELS + 1)]])

    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS h,
        CASE WHEN page_id % 97 = 5 AND length(coalesce(html, '')) > 0 THEN chr(0) || substr(html, 2) ELSE coalesce(html, '') END AS h2 FROM pages),
    r AS (SELECT page_id, page_id // {FILE_RECORDS} AS file_id, {rec('h')} AS ra, {rec('h2')} AS rb FROM p),
    l AS (SELECT page_id, file_id, strlen(ra) AS n, sha256(ra) AS digest, sha256(rb) AS digest_b, strlen(rb) AS nb FROM r),
    a AS (SELECT page_id, file_id, n, digest, digest_b, nb, CAST(coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset FROM l),
    b AS (SELECT page_id, file_id, nb AS n, digest_b AS digest, record_offset FROM a WHERE page_id % 211 <> 7),
    {side('ta', 'a')}, {side('tb', 'b')}
    SELECT page_id, a.file_id, record_offset, CAST(n AS BIGINT) AS record_length, digest AS record_sha256, x.hash AS root, y.hash AS replica_root,
        CASE WHEN page_id % 211 = 7 THEN 'missing' WHEN digest <> digest_b THEN 'corrupt' ELSE 'intact' END AS status
    FROM a LEFT JOIN ta{LEVELS} x ON a.file_id = x.file_id LEFT JOIN tb{LEVELS} y ON a.file_id = y.file_id"""
