"""Toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(score - threshold_k): all ordered thresholds share the weights of sparse text
features (words and their beginnings). The labels say toxic or not; grades of toxic training
texts are the terciles of their number of toxic terms. The result is the expected severity, the sum of
the exceedance probabilities, from 0 to the highest grade.

The model is fitted on at most `sample_rows` labelled rows (a parameter, 20,000 by default), taken in
the order of a hash of doc_id; term statistics are made on the executors. Scoring covers all texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, prepare

SAMPLE_ROWS, TERMS, GRADES, SEED = 20_000, 512, 3, 11
#: Words or features that a worker keeps at a time.
HELD = 100_000
EDGES = ".,;:!?\"'()[]{}«»“”„…-_*"
#: Lengths of the word beginnings that count as features beside the word.
PREFIXES = range(3, 9)


def features(word: str) -> tuple[str, ...]:
    """A token's features: the lower-case word without marks around it, and its longer beginnings."""
    w = word.lower().strip(EDGES)
    return (w, *[f"{w[:n]}~" for n in PREFIXES if n <= len(w)]) if w else ()


def text_features(text: str | None) -> set[str]:
    return {f for w in set((text or "").split()) for f in features(w)}


@dataclass(frozen=True)
class OrdinalModel:
    """weights by feature; thresholds ascending; a text is rejected from P(grade >= 1) = `reject` on."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    reject: float = 0.3

    def score(self, text: str | None) -> float:
        return sum(self.weights.get(f, 0.0) for f in text_features(text))

    def exceedance(self, score: float) -> list[float]:
        return [1 / (1 + math.exp(min(60.0, max(-60.0, t - score)))) for t in self.thresholds]


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = GRADES, l2: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the proportional-odds model by maximum likelihood (Adam, L2)."""
    n, d = x.shape
    p = np.zeros(d + grades)
    share = np.array([np.clip((y >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, grades + 1)])
    start = np.log((1 - share) / share)
    p[d], p[d + 1 :] = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        gap = np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0], np.cumsum(gap)])
        s = x @ p[:d].astype(x.dtype)
        up = np.where(y >= 1, sigmoid(s - theta[np.maximum(y, 1) - 1]), 1.0)
        down = np.where(y < grades, sigmoid(s - theta[np.minimum(y, grades - 1)]), 0.0)
        prob = np.maximum(up - down, 1e-12)
        g = np.zeros_like(p)
        g[:d] = -(x.T @ (1 - up - down).astype(x.dtype)) / n + l2 * p[:d]
        t = np.zeros(grades)
        np.add.at(t, np.maximum(y, 1) - 1, np.where(y >= 1, up * (1 - up) / prob, 0))
        np.add.at(t, np.minimum(y, grades - 1), np.where(y < grades, -down * (1 - down) / prob, 0))
        t /= n
        g[d] = t.sum()
        g[d + 1 :] = gap * np.cumsum(t[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, terms: int = TERMS, grades: int = GRADES) -> OrdinalModel:
    """Fits the model on docs (doc_id, text) with labels (doc_id, toxic 0/1).

    Labels with a null id or value are ignored; of repeated ids the highest label counts, of a repeated
    document the least text. Without both toxic and other texts nothing can be learnt and the model
    rejects nothing. The sample is a table of its own, so that the corpus is read once for it.
    """
    prepare(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows pairs of numbers; of several texts of an id one counts, so the sample is as small
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = materialize(sample.select("toxic", "text"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = {0: Counter(), 1: Counter()}, Counter()

        def counted() -> pa.RecordBatch:
            # the empty feature carries the number of texts
            rows = [("", n[1], n[0])] + [(f, seen[1][f], seen[0][f]) for f in seen[1]] + [(f, 0, c) for f, c in seen[0].items() if f not in seen[1]]
            for x in (seen[0], seen[1], n):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["f", "t", "c"])

        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = int(toxic > 0)
                seen[k].update(text_features(text))
                n[k] += 1
                if len(seen[0]) + len(seen[1]) > HELD:  # bounded: the counts go on in parts
                    yield counted()
        yield counted()

    stats = sample.mapInArrow(count, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t > 0")
    total = stats.where("f = ''").first()
    if not total or not total["t"] or not total["c"]:
        return OrdinalModel({}, tuple(40.0 + k for k in range(grades)))
    nt, nc = total["t"], total["c"]
    # a toxic term: over nine tenths of its weighted uses are toxic, and enough texts have it
    rate = (F.col("t") / nt) / (F.col("t") / nt + F.col("c") / nc)
    e = F.col("t") * F.log(F.col("t") / nt / ((F.col("t") + F.col("c")) / (nt + nc)))
    best = stats.where("f != ''").where((rate > 0.95) & (F.col("t") >= max(2, nt / 200))).orderBy(e.desc(), "f").limit(terms)
    vocabulary = [r["f"] for r in best.select("f").collect()]
    index = {f: i for i, f in enumerate(vocabulary)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, terms_in = [], []
            for text in b.column(1).to_pylist():
                at = sorted({index[f] for f in text_features(text) if f in index})
                found.append(at)
                terms_in.append(sum(any(f in index for f in features(w)) for w in (text or "").split()) if at else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(terms_in, pa.int32())], ["toxic", "at", "n"])

    # at most sample_rows short lists; sorted, so that the fit does not depend on the order of tasks
    rows = sorted((r["toxic"], r["n"], r["at"]) for r in sample.mapInArrow(hits, "toxic int, at array<int>, n int").collect())
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (_, _, at) in enumerate(rows):
        x[i, at] = 1
    toxic = np.array([r[0] > 0 for r in rows])
    n = np.array([r[1] for r in rows])
    cuts = [np.quantile(n[toxic], k / grades) for k in range(1, grades)]
    y = np.where(toxic, 1 + sum((n > c).astype(int) for c in cuts), 0)
    weights, thresholds = fit_ordinal(x, y, grades)
    return OrdinalModel({f: round(float(w), 6) for f, w in zip(vocabulary, weights, strict=True)}, tuple(round(float(t), 6) for t in thresholds))


def predict(df: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """df with expected_severity (double), grade (int, the median grade) and toxic (boolean).

    A null or empty text has no features and the score 0. Columns of these names are replaced.
    """
    prepare(df.sparkSession)
    df = df.drop("expected_severity", "grade", "toxic")
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = model.weights, {}
        for b in batches:
            if len(known) > HELD:
                known.clear()
            severity, grade, toxic = [], [], []
            for t in b.column(at).to_pylist():
                words = set((t or "").split())
                for w in words:
                    if w not in known:
                        known[w] = tuple(f for f in features(w) if f in weights)
                hit = {f for fs in map(known.__getitem__, words) if fs for f in fs}
                p = model.exceedance(sum(weights[f] for f in sorted(hit)))
                severity.append(round(sum(p), 9))
                grade.append(sum(q >= 0.5 for q in p))
                toxic.append(p[0] >= model.reject)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic, pa.bool_())], schema.names)

    return df.mapInArrow(go, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, model).select("doc_id", "expected_severity", "grade", "toxic")
