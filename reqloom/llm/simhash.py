"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 hashes of a text's word
shingles. Fingerprints that differ in at most `distance` bits are linked. With s segments, s over
distance / 2, one segment differs in at most one bit; so each segment is indexed once with every single
bit as a wildcard, and two linked fingerprints share a variant. Variants are dealt by equality; within
one, links are verified by the Hamming distance and only a spanning forest leaves the task.

`groups` links by that distance. `near_groups` links by the exact Jaccard index of the shingle sets: at
0.8 about 10 of 64 bits differ, so its fingerprints are wider, its segments shorter and more, and only the
bits of the closest votes are wildcards; what the fingerprints link is settled on the exact sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, mix64, partitions, prepare
from .components import connected_components
from .minhash import Shingler, set_id, span

WORDS, DISTANCE, SEED = 4, 4, 42
#: Rows of one variant that a task compares at once; larger variants are split once more.
GROUP = 65536


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text as an unsigned integer; null or without words: 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = min(words, len(parts))
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(parts) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", words: int = WORDS) -> DataFrame:
    """df with the fingerprint of each whole text as a signed long."""
    prepare(df.sparkSession)
    df = df.drop(name) if name in df.columns else df
    at, schema = df.columns.index(text), T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x, words) for x in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], schema.names)

    return df.mapInArrow(go, schema)


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs in at most one bit."""
    n = distance // 2 + 1
    cut = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (positions) that span the groups among fp. Each step takes one fingerprint and compares it
    with those that no group has reached yet, so a dense group costs one pass and a scattered one half
    of its pairs; nothing but the rest is held."""
    left, links = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = _popcount(fp[left] ^ fp[i]) <= distance
            if near.any():
                hit = left[near]
                links += [(i, j) for j in hit.tolist()]
                queue += hit.tolist()
                left = left[~near]
    return links


def links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (a, b) between different fingerprints (column `fp`, signed longs, no repeats) whose groups
    are the groups of all pairs within the distance; every link is verified.

    One variant may hold so many fingerprints that a task should not hold them: such variants (over
    `group` rows) are refined by the variants of a second segment in which such a pair differs by at
    most two bits, which keeps every link.
    """
    spark = fps.sparkSession
    cut = segments(distance)
    variants = []
    fp = F.col("fp")
    for s, (a, n) in enumerate(cut):
        part = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        for w in range(n):
            tag = (a + w) << 34
            variants.append(part.bitwiseAND(F.lit(((1 << n) - 1) ^ (1 << w)).cast("long")).bitwiseOR(F.lit(tag).cast("long")))
    # a small table turns into one of 64 times its rows
    keyed = fps.repartition(partitions(spark)).select("fp", F.explode(F.array(*variants)).alias("key"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[start, len(key)])
            small = np.repeat((size > 1) & (size <= 16), size)
            sk, sx = key[small], x[small]
            d = 1
            while len(sk) > d:  # neighbours at each distance within the small variants
                same = sk[:-d] == sk[d:]
                if not same.any():
                    break
                near = same & (_popcount(sx[:-d] ^ sx[d:]) <= distance)
                a.append(sx[:-d][near])
                b.append(sx[d:][near])
                d += 1
            for i, n in zip(start[size > 16].tolist(), size[size > 16].tolist(), strict=True):
                part = x[i : i + n]
                got = forest(part, distance)
                if got:
                    at = np.array(got)
                    a.append(part[at[:, 0]])
                    b.append(part[at[:, 1]])
            pairs = np.stack([np.concatenate(a), np.concatenate(b)], axis=1) if a else np.zeros((0, 2), np.uint64)
            pairs = np.unique(np.sort(pairs.view(np.int64), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for r in batches:
            key = np.concatenate([held_key, r.column(0).to_numpy()])
            x = np.concatenate([held_fp, r.column(1).to_numpy().view(np.uint64)])
            cut_at = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut_at > 200_000 or (cut_at and len(key) > 400_000):
                yield found(key[:cut_at], x[:cut_at])
                key, x = key[cut_at:], x[cut_at:]
            held_key, held_fp = key, x
        if len(held_key):
            yield found(held_key, held_fp)

    def linked(table: DataFrame) -> DataFrame:
        return table.select("key", "fp").repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(go, "a long, b long")

    large = materialize(keyed.groupBy("key").count().where(F.col("count") > group).select("key"), "hot") if group else None
    if large is None or large.isEmpty():
        return linked(keyed).distinct()
    hot = keyed.join(large, "key", "left_semi")
    return linked(keyed.join(large, "key", "left_anti")).unionByName(linked(_refined(hot, cut, distance))).distinct()


def _refined(hot: DataFrame, cut: list[tuple[int, int]], distance: int) -> DataFrame:
    """Each row once for every way to leave two bits out of one of the segments outside its variant's:
    a linked pair differs there in at most distance bits over len(cut) - 1 segments, so in one of them
    by at most `distance // (len(cut) - 1)` (two, for the defaults)."""
    import itertools

    out = []
    fp, bit = F.col("fp"), F.shiftrightunsigned(F.col("key"), 34)
    spare = distance // max(1, len(cut) - 1)
    for a, n in cut:
        for left_out in itertools.combinations(range(n), spare):
            mask = (1 << n) - 1
            for w in left_out:
                mask ^= 1 << w
            part = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit(mask).cast("long"))
            out.append(F.when(~bit.between(a, a + n - 1), F.xxhash64("key", F.lit(a), F.lit(mask).cast("long"), part)))
    return hot.select("fp", F.explode(F.array_compact(F.array(*out))).alias("key"))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """(key, fp, component): for each row its fingerprint and the least key of its group.

    Rows of equal fingerprints (null and empty texts among them) are linked. A row of a null key is in
    its group but never names it, unless no other key is there. Repeated rows stay.
    """
    rows = materialize(with_fingerprint(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", "fp", words).select("k", "fp"), "fingerprints")
    each = rows.groupBy("fp").agg(F.min("k").alias("least"))
    linked = connected_components(links(each.select("fp"), distance))
    named = each.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    named = materialize(named.select("fp", "group", "least"), "named")
    names = named.groupBy("group").agg(F.min("least").alias("component"))
    return rows.join(named.select("fp", "group").join(names, "group").drop("group"), "fp").select(F.col("k").alias(key), "fp", "component")


#: For `near_groups`: words of a shingle, least Jaccard index, and the share of links at that index that no
#: segment may find. BIT is how often a bit differs at 0.8 in the worst case, one of five shingles less.
NEAR_WORDS, SIMILARITY, MISSED, BIT = 5, 0.8, 1e-4, 0.1875
#: Bits that two fingerprints are compared by (unrelated ones come within `reach` of it once in 10^11), at
#: however many segments.
WIDTH = 256
#: Segments that are indexed at once; bounds the shuffle. Fingerprints of one variant that a task compares
#: as a square.
ROUND, SQUARE = 8, 512


def index_size(n: int) -> tuple[int, int, int]:
    """(bits of a segment, wildcards in it, segments) for n fingerprints: a variant holds about 128 unrelated
    ones at most, and segments are added until a link at 0.8 is found but for MISSED."""
    bits = max(8, math.ceil(math.log2(max(n, 1))) - 7)
    match = (1 - BIT) ** bits + bits * BIT * (1 - BIT) ** (bits - 1)  # at most one bit differs
    return bits, (bits + 1) // 2, math.ceil(math.log(MISSED) / math.log(1 - 0.86 * match))  # 0.86: and is a wildcard on both sides


def reach(width: int = WIDTH) -> int:
    """Bits of `width` in which a linked pair may differ: the worst case's mean and 4.2 deviations."""
    return math.floor(BIT * width + 4.2 * math.sqrt(BIT * (1 - BIT) * width))


def wide(shingles: np.ndarray, bits: int, wildcards: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, wildcards) of a set of shingle hashes, as packed bits. A bit is 1 if over half of the
    shingles set it; the wildcards of a segment are its bits of the closest votes."""
    words = -(-max(WIDTH, bits * parts) // 64)
    salt = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(shingles), 255):  # as many votes as a byte can count
        h = mix64((shingles[i : i + 255, None] + salt) * np.uint64(0xD6E8FEB86659FD93))
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    margin = np.abs(2 * counts[: bits * parts] - len(shingles)).reshape(parts, bits)
    mask = np.zeros((parts, bits), bool)
    np.put_along_axis(mask, np.argsort(margin, axis=1, kind="stable")[:, :wildcards], True, axis=1)
    return np.packbits(2 * counts > len(shingles)), np.packbits(mask.reshape(-1))


def variants(fp: np.ndarray, mask: np.ndarray, bits: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every variant of the segments first to last of the rows of fp and mask (packed bits)."""
    cut = lambda x: np.unpackbits(x, axis=1)[:, first * bits : last * bits].reshape(len(x), -1, bits)
    on = cut(fp).astype(np.int64) << np.arange(bits)
    row, part, at = np.nonzero(cut(mask))
    rest = on.sum(axis=2)[row, part] - on[row, part, at]
    return row, ((part + first) * bits + at << 44) | rest


def rounds(parts: int) -> list[tuple[int, int]]:
    """(first, last) of the segments that are indexed at once: one segment, then ROUND at most."""
    n = math.ceil((parts - 1) / ROUND)
    cut = [0, *(1 + (parts - 1) * i // n for i in range(n)), parts] if n else [0, parts]
    return list(zip(cut, cut[1:], strict=False))


def near_pairs(fp: np.ndarray, distance: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) within the distance among the rows of fp (words), one fewer than labels at most:
    with the rows of one label taken as linked they span the groups of all such pairs. `forest` for
    fingerprints of several words, some of them in one group beforehand."""
    n, links = len(fp), []
    names, label = np.unique(label, return_inverse=True)
    if len(names) == 1:
        return links
    if n <= SQUARE:
        far = np.zeros((n, n), np.int32)
        for w in fp.T:
            far += np.bitwise_count(w[:, None] ^ w)
        a, b = np.nonzero(np.triu((far <= distance) & (label[:, None] != label), 1))
        if len(a) <= 2 * n:
            up = list(range(len(names)))

            def root(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = root(label[i]), root(label[j])
                if x != y:
                    up[max(x, y)] = min(x, y)
                    links.append((i, j))
            return links
    left = np.arange(n)
    while len(left):
        same = label[left] == label[left[0]]
        queue, left = left[same].tolist(), left[~same]
        for i in queue:  # grows as it goes
            if not len(left):
                break
            near = left[np.bitwise_count(fp[left] ^ fp[i]).sum(axis=1, dtype=np.int32) <= distance]
            if len(near):
                hit, first = np.unique(label[near], return_index=True)
                links += [(i, j) for j in near[first].tolist()]
                same = np.isin(label[left], hit)
                queue += left[same].tolist()
                left = left[~same]
    return links


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = NEAR_WORDS, lower: bool = True) -> DataFrame:
    """(key, component): for each row the least key of its group of near copies, texts whose shingle sets
    have a Jaccard index of `similarity` (0.8 at least) and over, closed to groups.

    Texts are compared in lower case unless `lower` is false. Each different set has one fingerprint;
    those that share a variant and differ in at most `reach` bits form rough groups, and each rough group is
    settled by its exact sets in one task. Rough groups grow by a few segments at a time, and what is in one
    already is not linked again. Texts of equal sets (those without words among them) are one. A
    row of a null key never names its group, unless no other key is there. Repeated rows stay.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the index is made for a similarity of {SIMILARITY} and over")
    spark = prepare(df.sparkSession)
    held = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    bits, wildcards, parts = index_size(held.count())
    distance = reach(WIDTH)
    shingled = lambda s, t: np.unique(s.shingles(s.words((t or "").lower() if lower else t or "")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(words)
        for x in batches:
            ids, fps, masks = [], [], []
            for t in x.column(1).to_pylist():
                g = shingled(s, t)
                fp, mask = wide(g, bits, wildcards, parts) if len(g) else (None, None)
                ids.append(set_id(g))
                fps.append(fp if fp is None else fp.tobytes())
                masks.append(mask if mask is None else mask.tobytes())
            yield pa.RecordBatch.from_arrays([x.column(0), *[pa.array(c, pa.binary()) for c in (ids, fps, masks)]], ["k", "id", "fp", "mask"])

    binary = [T.StructField(c, T.BinaryType()) for c in ("id", "fp", "mask")]
    signed = materialize(held.mapInArrow(sign, T.StructType([held.schema["k"], *binary])), "signed")
    each = signed.groupBy("id").agg(F.min("k").alias("least"), F.count("*").alias("rows"), F.min("fp").alias("fp"), F.min("mask").alias("mask"))
    each = materialize(each.withColumn("n", F.monotonically_increasing_id()), "sets")
    names = [f"w{i}" for i in range(WIDTH // 64)]

    def deal(first: int, last: int):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                fp = np.frombuffer(b"".join(x.column(2).to_pylist()), np.uint8).reshape(len(x), -1)
                mask = np.frombuffer(b"".join(x.column(3).to_pylist()), np.uint8).reshape(len(x), -1)
                row, at = variants(fp, mask, bits, first, last)
                w = fp.view(np.int64)
                held = [pa.array(x.column(c).to_numpy()[row]) for c in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(at), *held, *[pa.array(w[row, i]) for i in range(len(names))]], ["key", "n", "label", *names])

        return go

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(x: np.ndarray) -> pa.RecordBatch:
            out = []
            start = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]])
            for i, j in zip(start.tolist(), [*start[1:].tolist(), len(x)], strict=True):
                got = near_pairs(x[i:j, 3:].view(np.uint64), distance, x[i:j, 2]) if j - i > 1 else []
                if got:
                    out.append(x[i:j, 1][np.array(got)])
            pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        waiting, size = [], 0  # rows whose last variant may go on; joined once they are many
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns], axis=1)
            if not len(x):
                continue
            waiting.append(x)
            size += len(x)
            if size >= 16384 and waiting[0][0, 0] != x[-1, 0]:
                x = np.concatenate(waiting)
                cut = int(np.searchsorted(x[:, 0], x[-1, 0]))
                yield found(x[:cut])
                waiting, size = [x[cut:].copy()], len(x) - cut
        if waiting:
            yield found(np.concatenate(waiting))

    schema = "key long, n long, label long, " + ", ".join(f"{w} long" for w in names)
    rough = materialize(each.select(F.col("n").alias("node"), F.col("n").alias("component")).limit(0), "rough")
    for first, last in rounds(parts):
        # what earlier segments have grouped is not linked again: each variant would span a large group anew
        labelled = each.where("fp IS NOT NULL").join(rough.withColumnRenamed("node", "n"), "n", "left")
        labelled = labelled.select("n", F.coalesce("component", "n").alias("label"), "fp", "mask")
        # a small table turns into one of many times its rows
        keyed = labelled.repartition(partitions(spark)).mapInArrow(deal(first, last), schema)
        dealt = keyed.repartition(partitions(spark), "key").sortWithinPartitions("key", "n")
        near = materialize(dealt.mapInArrow(meet, "a long, b long"), "near")
        if not near.isEmpty():
            before, both = rough, near.unionByName(rough.select(F.col("node").alias("a"), F.col("component").alias("b")))
            rough = materialize(connected_components(both), "rough")
            discard(before)
        discard(near)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(words)
        for x in batches:
            sets = [shingled(s, t) for t in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.binary()), pa.array([g.astype(np.uint32).tobytes() for g in sets], pa.binary())], ["id", "set"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(n, group): the least n of those that exact links reach, for each rough group."""
        group, ns, sets = None, [], []

        def settled() -> pa.RecordBatch:
            up = list(range(len(ns)))

            def root(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            for i, j in span(sets, similarity) if len(sets) > 1 else []:
                i, j = root(i), root(j)
                up[max(i, j)] = min(i, j)
            return pa.RecordBatch.from_arrays([pa.array(ns, pa.int64()), pa.array([ns[root(i)] for i in range(len(ns))], pa.int64())], ["n", "group"])

        for x in batches:
            for c, n, g in zip(*[y.to_pylist() for y in x.columns], strict=True):
                if c != group:
                    yield settled()
                    group, ns, sets = c, [], []
                ns.append(n)
                sets.append(np.frombuffer(g, np.uint32))
        yield settled()

    # sets are made again for what is in a rough group, so none are kept for all
    members = materialize(each.join(rough.withColumnRenamed("node", "n"), "n").select("id", "n", "component", "least"), "members")
    keys = members.select(F.col("least").alias("w")).distinct()
    texts = held.join(keys, F.col("k").eqNullSafe(F.col("w")), "left_semi").select("t")
    sets = texts.mapInArrow(again, "id binary, set binary").join(members.select("id", "n", "component"), "id").dropDuplicates(["n"])
    dealt = sets.select("component", "n", "set").repartition(partitions(spark), "component").sortWithinPartitions("component")
    exact = dealt.mapInArrow(settle, "n long, group long")
    named = materialize(each.join(exact, "n", "left").select("id", "least", F.coalesce("group", "n").alias("group")), "named")
    least = named.groupBy("group").agg(F.min("least").alias("component"))
    for x in (each, members):
        discard(x)
    out = signed.select("k", "id").join(named.join(least, "group").select("id", "component"), "id")
    return out.select(F.col("k").alias(key), "component")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
