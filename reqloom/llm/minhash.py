"""Document fingerprints by MinHash.

Universal hash functions h(x) = (a x + b mod 2^64) >> 32 stand for permutations of the shingles'
universe; numpy takes the least value of each over all word shingles of a text. A fingerprint keeps
the low 16 bits of each minimum. Likeness of two fingerprints is the share of equal entries, which
estimates the Jaccard index of the shingle sets. `classes` and `groups` join bands of the signature in
Spark, verify the exact Jaccard index and close the links to groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, mix64, partitions, prepare, text_or_empty
from .components import connected_components

#: Words in a shingle; hash functions; rows of a band (32 bands: a pair at 0.8 is missed once in 10^7).
WORDS, PERMUTATIONS, BAND_ROWS, SIMILARITY = 5, 128, 4, 0.8
SEED = 20240607
#: Shingles hashed at once; bounds the working memory of one text.
CHUNK = 512


def family(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


class Shingler:
    """Hashes of word shingles; words split at Unicode white space, their hashes are remembered."""

    def __init__(self, words: int = WORDS, keep: int = 500_000):
        self.n, self.keep, self.known = words, keep, {}

    def words(self, text: str) -> np.ndarray:
        words, known = text.split(), self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """32-bit shingle hashes as uint64; a text of fewer words is one shingle, an empty one none."""
        n = min(self.n, len(h))
        if not n:
            return h
        m = np.uint64(0x9E3779B97F4A7C15)
        x = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            x = x * m + h[i : len(h) - n + 1 + i]
        return mix64(x) >> np.uint64(32)

    def set_of(self, text: str | None, lower: bool = False) -> np.ndarray:
        """The text's different shingles, sorted."""
        return np.unique(self.shingles(self.words((text or "").lower() if lower else text or "")))


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least hash for each function, as uint32; all ones for no shingle."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    rows, shift = a[:, None], np.uint64(32)
    for i in range(0, len(x), CHUNK):
        h = rows * x[None, i : i + CHUNK]
        h += b[:, None]
        np.minimum(least, (h.min(axis=1, initial=0xFFFFFFFFFFFFFFFF) >> shift).astype(np.uint32), out=least)
    return least


def packed(signature: np.ndarray) -> bytes:
    return (signature & np.uint32(0xFFFF)).astype(">u2").tobytes()


def hexed(signature: np.ndarray) -> str:
    return packed(signature).hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean((x & np.uint32(0xFFFF)) == (y & np.uint32(0xFFFF))))


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", permutations: int = PERMUTATIONS) -> DataFrame:
    """df with the text's fingerprint (4 hex digits for each function); a null text counts as empty."""
    prepare(df.sparkSession)
    df = df.drop(name) if name in df.columns else df
    at, schema = df.columns.index(text), T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, (a, b) = Shingler(), family(permutations)
        for x in batches:
            out = [hexed(minima(s.shingles(s.words(t or "")), a, b)) for t in x.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out, pa.string())], schema.names)

    return df.mapInArrow(go, schema)


#: Texts of one band that are compared as pairs; larger bands are settled in one task.
PAIRED = 8


def span(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (positions) that span the groups of the sets' pairs at or over the similarity. Each step takes
    one set and counts what it shares with all others, so a dense group costs one pass."""
    size = np.array([len(x) for x in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    held = np.zeros(int(at.max()) + 1, bool)
    open_, links = np.arange(len(sets)), []
    while len(open_):
        queue, open_ = [int(open_[0])], open_[1:]
        where, first = None, 0
        while queue and len(open_):
            i = queue.pop()
            if where is None or len(open_) < first // 2:  # only what is still open is counted
                first, counted = len(open_), open_
                where = np.concatenate([at[start[j] : start[j + 1]] for j in counted.tolist()])
                begin = np.r_[0, np.cumsum(size[counted])[:-1]]
            held[at[start[i] : start[i + 1]]] = True
            n = np.add.reduceat(held[where], begin, dtype=np.int64)
            held[at[start[i] : start[i + 1]]] = False
            near = counted[n >= similarity * (size[counted] + size[i] - n)]
            near = near[np.isin(near, open_)]
            if len(near):
                links += [(i, j) for j in near.tolist()]
                queue += near.tolist()
                open_ = np.setdiff1d(open_, near)
    return links


def bands_of(m: np.ndarray, band_rows: int = BAND_ROWS) -> list[int]:
    return [xxhash.xxh64_intdigest(m[i : i + band_rows].tobytes(), i) - (1 << 63) for i in range(0, len(m), band_rows)]


def packed_bands(fingerprint: Column, set_id_: Column, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS) -> Column:
    """Bands of a packed fingerprint. They have the low half of each minimum, so texts that agree in a band
    of whole minima agree here; the exact sets judge the few that meet by chance. None for the empty set."""
    cut = [F.xxhash64(F.lit(i), F.substring(fingerprint, 2 * i + 1, 2 * band_rows)) for i in range(0, permutations, band_rows)]
    return F.when(set_id_ == F.lit(set_id(np.zeros(0, np.uint64))), F.array().cast("array<bigint>")).otherwise(F.array(*cut))


def set_id(x: np.ndarray) -> bytes:
    """Names a set of shingles (sorted, unique)."""
    return xxhash.xxh3_128_digest(x.astype(np.uint32).tobytes())


def links_of(signed: DataFrame, sets_of, similarity: float = SIMILARITY) -> tuple[DataFrame, list[DataFrame]]:
    """(links, tables that they are read from). Links (a, b) that span the groups of near copies among signed (id, bands).

    Ids that agree in a whole band are candidates. Bands of up to PAIRED ids are compared as pairs, larger
    ones in one task each, so no join grows with the square of a band; each link is verified on the exact
    sets, which `sets_of` gives (ids -> (id, set)) for what has met only.
    """
    spark = signed.sparkSession
    keyed = signed.select("id", "bands").dropDuplicates(["id"]).select("id", F.explode("bands").alias("band"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the small bands; (id, band) for each id of a large one."""
        band, ids = None, []

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["a", "b", "band"])

        def settled() -> list:
            if len(ids) > PAIRED:
                return [(i, None, band) for i in ids]
            return [(min(p, q), max(p, q), None) for i, p in enumerate(ids) for q in ids[:i]]

        for x in batches:
            rows = []
            for k, i in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                if k != band:
                    rows += settled()
                    band, ids = k, []
                ids.append(i)
            if rows:
                yield out(rows)
        rows = settled()
        if rows:
            yield out(rows)

    met = keyed.select("band", "id").repartition(partitions(spark), "band").sortWithinPartitions("band").mapInArrow(meet, "a binary, b binary, band long")
    met = materialize(met, "met")
    pairs = materialize(met.where("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    large = met.where("b IS NULL").select(F.col("a").alias("id"), "band")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(large.select("id")).distinct(), "wanted")
    sets = materialize(sets_of(wanted), "sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    keep.append(False)
                    continue
                n = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(n >= similarity * (len(p) + len(q) - n))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, ids, held = None, [], []

        def links() -> pa.RecordBatch:
            got = span(held, similarity) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[p[j]] for p in got], pa.binary()) for j in (0, 1)], ["a", "b"])

        for x in batches:
            for k, i, g in zip(*[c.to_pylist() for c in x.columns], strict=True):
                if k != band:
                    yield links()
                    band, ids, held = k, [], []
                ids.append(i)
                held.append(np.frombuffer(g, np.uint32))
        yield links()

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    found = both.select("a", "b", "sa", "sb").mapInArrow(verify, "a binary, b binary")
    if not large.isEmpty():
        dealt = large.join(sets, "id").select("band", "id", "set").repartition(partitions(spark), "band").sortWithinPartitions("band")
        found = found.unionByName(dealt.mapInArrow(spanned, "a binary, b binary"))
    return found, [met, pairs, wanted, sets]


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS, lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """(signed, names): signed (k, id, bands), a table of one row for each row of df, id naming the text's shingle set; names
    as `named_classes` has them. The exact sets are made again for the texts that meet in a band, so none are kept for all.
    """
    held = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, (a, b) = Shingler(), family(permutations)
        for x in batches:
            sets = [s.set_of(t, lower) for t in x.column(1).to_pylist()]
            bands = [bands_of(minima(g, a, b), band_rows) if len(g) else [] for g in sets]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(map(set_id, sets), pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["k", "id", "bands"])

    signed = materialize(held.mapInArrow(sign, T.StructType([held.schema["k"], T.StructField("id", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])), "signed")
    return signed, named_classes(held, signed, similarity, lower)


def named_classes(held: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, lower: bool = False) -> DataFrame:
    """(id, class_id), the least key of the id's group of near copies, for ids that have a link or several
    rows; all others are a class of their own key. held: (k, t); signed: (k, id, bands)."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler()
        for x in batches:
            sets = [s.set_of(t, lower) for t in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.binary()), pa.array([g.astype(np.uint32).tobytes() for g in sets], pa.binary())], ["id", "set"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        keys = materialize(signed.select("id", "k").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("k").alias("k")).select(F.col("k").alias("w")).distinct(), "keys")
        texts = held.join(keys, F.col("k").eqNullSafe(F.col("w")), "left_semi").select("t")
        return texts.mapInArrow(again, "id binary, set binary").join(wanted, "id", "left_semi").dropDuplicates(["id"])

    links, tables = links_of(signed, sets_of, similarity)
    group = connected_components(links).withColumnRenamed("node", "id")
    for t in tables:
        discard(t)
    each = signed.groupBy("id").agg(F.min("k").alias("least"), F.count("*").alias("n"))
    named = materialize(each.join(group, "id", "left").where("n > 1 OR component IS NOT NULL").select("id", F.coalesce("component", "id").alias("c"), "least"), "named")
    least = named.groupBy("c").agg(F.min("least").alias("class_id"))
    names = materialize(named.join(least, "c").select("id", "class_id"), "classes")
    discard(named)
    return names


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS, lower: bool = True) -> DataFrame:
    """(key, component): for each row the least key of its group of near copies.

    Texts are compared in lower case unless `lower` is false. Those that agree in a whole band are
    candidates and each link is verified on the exact shingle sets. Texts of equal sets (those without
    words among them) are one. A row of a null key never names its group, unless no other key is there.
    Repeated rows stay.
    """
    prepare(df.sparkSession)
    signed, names = classes(df, key, text, similarity, permutations, band_rows, lower)
    return signed.select("k", "id").join(names, "id", "left").select(F.col("k").alias(key), F.coalesce("class_id", "k").alias("component"))


def with_next(df: DataFrame, order: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """Rows (block, ahead, order, text) such that each block holds a stretch of the order and, with
    ahead = true, the row after it; the last block is followed by the first row of all.

    Blocks are bounded by approximate quantiles of the order column, so no task sorts the table. Ties
    stand in one block. Nulls come first. The only rows that travel twice are the first of each block.
    """
    spark = prepare(df.sparkSession)
    n = blocks or partitions(spark)
    held = df.select(F.col(order).alias("o"), text_or_empty(text).alias("t"))
    cuts = held.agg(F.percentile_approx("o", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    table = F.array(*[F.lit(x).cast("long") for x in cuts]) if cuts else F.array(F.lit(0).cast("long"))
    size, step = len(cuts), []
    p = 1
    while p <= max(size, 1):
        step.append(p)
        p *= 2
    o = F.col("o")
    block = F.aggregate(
        F.array(*[F.lit(x) for x in reversed(step)]), F.lit(0),
        lambda at, s: F.when((at + s <= size) & (F.get(table, at + s - 1) <= o), at + s).otherwise(at),
    )
    held = held.withColumn("block", F.when(o.isNull(), 0).otherwise(block) if cuts else F.lit(0))
    #: At most n rows, n being the parameter above.
    first = held.groupBy("block").agg(F.min("o").alias("o"), F.max(F.col("o").isNull()).alias("null")).orderBy("block").collect()
    turn = {first[i]["block"]: first[i - 1]["block"] for i in range(len(first))}
    firsts = [(r["block"], None if r["null"] else r["o"], turn[r["block"]]) for r in first]
    ahead = F.array()
    if firsts:  # arrays by block; as constants they take no room in the plan's code
        at = {b: (v, to) for b, v, to in firsts}
        hit = F.lit([at.get(b, (None, -1))[1] for b in range(max(at) + 1)])
        least = F.array(*[F.lit(at.get(b, (None, -1))[0]).cast("long") for b in range(max(at) + 1)])
        ahead = F.when(o.eqNullSafe(F.get(least, F.col("block"))), F.array(F.struct(F.get(hit, F.col("block")).alias("block"), F.lit(True).alias("ahead")))).otherwise(F.array().cast("array<struct<block:int,ahead:boolean>>"))
    both = F.concat(F.array(F.struct(F.col("block"), F.lit(False).alias("ahead"))), ahead) if firsts else F.array(F.struct(F.col("block"), F.lit(False).alias("ahead")))
    return held.select(F.explode(both).alias("p"), "o", "t").select("p.block", "p.ahead", "o", "t").repartition(n, "block").sortWithinPartitions("block", "ahead", "o", "t")


def edited(text: str, following: str) -> str:
    """The last quarter of the text (rounded down) replaced by as much of the start of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare_next(df: DataFrame, order: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS) -> DataFrame:
    """(order, set_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    every row; set_id names the text's set of shingles.

    A null text is empty. Rows of equal order follow each other by their texts; null orders come first.
    A table of one row is followed by itself. Texts without shingles have equal fingerprints, so their
    likeness is 1. The shingles that a text and its edited text begin with are hashed once for both.
    """
    return in_hex(compared(df, order, text, permutations))


def in_hex(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def compared(df: DataFrame, order: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS) -> DataFrame:
    """`compare_next` with digests and fingerprints as bytes, in which form they are kept and dealt."""
    schema = "o long, set_id binary, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, (a, b) = Shingler(), family(permutations)
        held = None  # (block, order, text, shingles) that waits for the next row
        waiting = None  # the same row's outcome, but for the likeness to the next one
        for x in batches:
            out: list[tuple] = []

            def finish(t: str, out=out) -> None:
                """What the row that waits has of its own and of its edited text."""
                nonlocal waiting
                _, o, own, h = held
                e = edited(own, t)
                g = s.shingles(s.words(e))
                n = min(len(h), len(g))
                same = int(np.argmin(np.r_[h[:n] == g[:n], False]))
                common = minima(h[:same], a, b)
                sig = np.minimum(common, minima(h[same:], a, b))
                esig = np.minimum(common, minima(g[same:], a, b))
                digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest()
                settle(sig, out)
                waiting = (o, set_id(np.unique(h)), len(own), digest, packed(sig), packed(esig), likeness(sig, esig)), sig

            def settle(sig: np.ndarray | None, out: list) -> None:
                nonlocal waiting
                if waiting is not None:
                    out.append((*waiting[0], likeness(waiting[1], sig)))
                waiting = None

            for block, ahead, o, t in zip(*[c.to_pylist() for c in x.columns], strict=True):
                if ahead and (held is None or held[0] != block):
                    continue  # a further row of the same order as the one that was ahead
                h = s.shingles(s.words(t))
                if held is not None and held[0] == block:
                    finish(t)
                if ahead:
                    settle(minima(h, a, b), out)
                held = None if ahead else (block, o, t, h)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return with_next(df, order, text).mapInArrow(go, schema).withColumnRenamed("o", order)


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and edited texts, and each text's class of near copies (class_id): bands
    of the signatures joined, exact Jaccard of 0.8 and over, closed to groups. Each text is hashed once:
    the fingerprints are a table, and the bands are cut from it."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    out = materialize(compared(docs), "compared")
    names = compared_classes(docs, out)
    out = out.join(names.withColumnRenamed("id", "set_id"), "set_id", "left")
    return in_hex(out.drop("set_id").withColumn("class_id", F.coalesce("class_id", "doc_id")))


def compared_classes(df: DataFrame, out: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """`named_classes` of df from its table of `compared`."""
    signed = out.select(F.col(order).alias("k"), F.col("set_id").alias("id"), packed_bands(F.col("fingerprint"), F.col("set_id")).alias("bands"))
    return named_classes(df.select(F.col(order).alias("k"), F.col(text).alias("t")), signed)
