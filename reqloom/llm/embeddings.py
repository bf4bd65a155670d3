"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors are one class and travel once. A vector's bucket in a table is the sign pattern of its
products with N_BITS random directions. Vectors of a bucket are compared exactly, in blocks; a pair
counts in the first table in which it meets. A block gives each vector's number of new links and a
spanning forest of them, never the pairs. Buckets over BLOCK vectors are cut into blocks, and every two
blocks meet in a task of their own, so nothing of a large bucket is lost and no task holds it.

A pair at cosine 0.9 agrees in a bit with probability 0.856: with 8 bits and 20 tables it is missed once
in 900 pairs, one at 0.95 once in 9000. Tables are done ROUND at a time, which bounds the disk that the
copies of the vectors take. Over 65,536 different vectors the bits grow with the logarithm of their
number, so that a bucket keeps its size, and the tables with the bits, so that a pair at the threshold
is missed as seldom. A vector's codes are computed once and travel with it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, prepare, read
from .components import connected_components

#: Buckets that a worker counts before it gives its counts away.
COUNTED = 100_000
#: N_BITS: the least; MISSED: probability that a pair at the threshold meets in no table.
COSINE, N_BITS, MISSED, ROUND, BLOCK, SEED = 0.9, 8, 0.0012, 5, 1024, 4242


def size_of_index(n: int, cosine: float = COSINE, block: int = BLOCK) -> tuple[int, int]:
    """(bits, tables) for n different vectors: buckets of a quarter block if the vectors are spread
    evenly, and as many tables as MISSED wants."""
    bits = max(N_BITS, math.ceil(math.log2(max(n, 1) / (block / 4))))
    agree = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return bits, 1 if agree > 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-agree))


@lru_cache(maxsize=16)
def directions(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, tables * bits))


def codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each vector (row) in each table."""
    sign = (x @ directions(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return (sign @ (1 << np.arange(bits))).astype(np.int32)


def coded(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """reps (node, n, least, vec) with `code`: int32 buckets by table."""
    schema = T.StructType([*reps.schema.fields, T.StructField("code", T.BinaryType())])
    at = reps.columns.index("vec")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(at).to_pylist()
            out = [b""] * len(raw)
            for size in sorted({len(r) for r in raw}):
                own = [i for i, r in enumerate(raw) if len(r) == size]
                for i, c in zip(own, codes(_stack([raw[i] for i in own]), bits, tables), strict=True):
                    out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], schema.names)

    return reps.mapInArrow(go, schema)


def _codes(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), -1)


def _stack(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def distinct_vectors(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """(k, node, vec): node names the vector's value; null for vectors that link with nothing."""
    schema = "k long, node string, vec binary"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, vecs = [], []
            for v in b.column(1).to_pylist():
                x = np.array(v, np.float64) + 0.0 if v and None not in v else None  # -0.0 becomes 0.0
                if x is None or not np.isfinite(x).all() or not x.any():
                    nodes.append(None)
                    vecs.append(None)
                    continue
                raw = x.tobytes()
                nodes.append(hashlib.blake2b(raw, digest_size=16).hexdigest())
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.string()), pa.array(vecs, pa.binary())], ["k", "node", "vec"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(go, schema)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square leaves the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def block_links(x: np.ndarray, code: np.ndarray, table: int, side: np.ndarray | None, cosine: float) -> np.ndarray:
    """Which rows are linked and have not met in an earlier table (symmetric, no self links)."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    if table:
        i, j = np.nonzero(np.triu(near))
        for at in range(0, len(i), 1 << 17):
            p, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            met = (code[p, :table] == code[q, :table]).any(axis=1)
            near[p[met], q[met]] = False
            near[q[met], p[met]] = False
    return near


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the groups of a link matrix; each points to the group's first row."""
    left, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            hit = np.flatnonzero(near[queue.pop()] & left)
            left[hit] = False
            out += [(i, j) for j in hit.tolist()]
            queue += hit.tolist()
    return out


def groups(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, bits: int | None = None, tables: int | None = None, per_round: int = ROUND, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of df; `bits` and `tables` follow from the number of
    different vectors unless they are given.

    Cosines are taken in double precision. Vectors that are null, zero or hold a null or a component
    that isn't finite link with nothing, and vectors of different length don't link. Equal vectors are
    linked with each other. Repeated rows count each for itself; an empty table gives an empty result.
    """
    spark = prepare(df.sparkSession)
    rows = materialize(distinct_vectors(df, key, embedding), "vectors")
    reps = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.first("vec").alias("vec"))
    n_vectors = reps.count()
    own = size_of_index(n_vectors, cosine, block)
    bits, tables = bits or own[0], tables or own[1]
    reps = materialize(coded(reps, bits, tables), "distinct")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for b in batches:
            size, c = b.column(0).to_numpy(), _codes(b.column(1).to_pylist())
            for s in np.unique(size).tolist():
                for t in range(tables):
                    for v, n in zip(*np.unique(c[size == s, t], return_counts=True), strict=True):
                        total[s, t, int(v)] = total.get((s, t, int(v)), 0) + int(n)
            if len(total) > COUNTED:
                yield counted(total)
                total.clear()
        yield counted(total)

    def counted(total: dict[tuple[int, int, int], int]) -> pa.RecordBatch:
        k = list(total)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in k], pa.int64()) for i in range(3)] + [pa.array([total[x] for x in k], pa.int64())], ["size", "t", "c", "n"])

    # rows: only buckets over a block, which the number of bits makes few
    large = reps.select(F.octet_length("vec").cast("long"), "code").mapInArrow(count, "size long, t long, c long, n long").groupBy("size", "t", "c").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    blocks = {(r["size"], r["t"], r["c"]): -(-r["n"] // block) for r in large.collect()}
    keyed = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("cross", T.BooleanType()), T.StructField("node", T.StringType()), T.StructField("n", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("code", T.BinaryType())])
    counts, links = None, None
    for start in range(0, tables, per_round):
        chosen = range(start, min(start + per_round, tables))

        def deal(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, bucket, table, side, cross = [], [], [], [], []
                sizes = [len(r) for r in b.column(2).to_pylist()]
                c = _codes(b.column(3).to_pylist())[:, list(chosen)].tolist() if len(sizes) else []
                for i, (node, size) in enumerate(zip(b.column(0).to_pylist(), sizes, strict=True)):
                    for t, v in zip(chosen, c[i], strict=True):
                        n = blocks.get((size, t, v), 1)
                        mine = int(node[:8], 16) % n
                        for other in range(n):
                            x, y = min(mine, other), max(mine, other)
                            at.append(i)
                            bucket.append(f"{size}:{t}:{v}:{x}:{y}")
                            table.append(t)
                            side.append(mine)
                            cross.append(x != y)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(table, pa.int32()), pa.array(side, pa.int32()), pa.array(cross, pa.bool_()), *[x.take(take) for x in b.columns]], keyed.names)

        def compare(table: pa.Table) -> pa.Table:
            x = _stack(table["vec"].to_pylist())
            code = _codes(table["code"].to_pylist())
            n = table["n"].to_numpy()
            node = table["node"].to_pylist()
            is_cross = table["cross"][0].as_py()
            near = block_links(unit(x), code, table["t"][0].as_py(), table["side"].to_numpy() if is_cross else None, cosine)
            add = near @ n
            some = np.flatnonzero(add).tolist()
            tree = forest(near)
            return pa.Table.from_arrays(
                [
                    pa.array([node[i] for i in some] + [node[i] for i, _ in tree], pa.string()),
                    pa.array([int(add[i]) for i in some] + [0] * len(tree), pa.int64()),
                    pa.array([None] * len(some) + [node[j] for _, j in tree], pa.string()),
                ],
                ["a", "add", "b"],
            )

        dealt = reps.select("node", "n", "vec", "code").mapInArrow(deal, keyed)
        got = materialize(dealt.groupBy("bucket").applyInArrow(compare, "a string, add long, b string"), "compared")
        counts = got.where("b IS NULL").select("a", "add") if counts is None else counts.unionByName(got.where("b IS NULL").select("a", "add"))
        links = got.where("b IS NOT NULL").select("a", "b") if links is None else links.unionByName(got.where("b IS NOT NULL").select("a", "b"))
    degree = counts.groupBy("a").agg(F.sum("add").alias("add")).withColumnRenamed("a", "node")
    linked = connected_components(links)
    named = reps.select("node", "n", "least").join(degree, "node", "left").join(linked, "node", "left")
    named = materialize(named.select("node", "least", (F.coalesce("add", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("group")), "named")
    names = named.groupBy("group").agg(F.min("least").alias("component_id"))
    out = rows.select("k", "node").join(named.join(names, "group").select("node", "n_links", "component_id"), "node", "left")
    component = F.coalesce("component_id", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("k") == component).alias("kept"))


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "embeddings"))
