"""A factorisation machine over hashed words, structure statistics and length.

A document is a sparse vector: its words' hash buckets with damped, normalised counts, and for each statistic of its
structure (and its length, the one metadatum that the text itself gives) the interval in which it falls. The model has a
weight for each and, for each pair, the product of two short factors. Pairs are never listed: half of the squared sum
less the sum of squares of the factors gives their total in time linear in the document's buckets.

It is fitted on the driver on the sparse vectors of at most TRAIN_ROWS labelled documents (a documented bound; held-out
rows are never among them) and sent to the executors, where every whole text is scored.

Edge cases. Null or empty text: no words, its statistics are zero, and it gets a score like any other. No labelled rows,
or labels of one kind: the score is that kind's smoothed share. Repeated rows: equal scores. Ties at the bound: by id.
Null ids: scored, never learned from. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.llm._common import CONTINUATION, each, held_out, table
from graphloom.llm._training import labelled_sample

TRAIN_ROWS = 4000
BUCKETS, BINS, RANK = 1 << 12, 24, 8
STEPS, RATE, DECAY = 160, 0.05, 1e-4
STATISTICS = 12
WIDTH = BUCKETS + STATISTICS * BINS
_CLASSES = [b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b".,;:"]
_X = pa.struct([("i", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])


def vector(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one whole text, words first."""
    text = text or b""
    words = text.lower().split()
    n = len(words)
    counts = np.bincount(np.fromiter(map(crc32, words), np.uint32, n) & (BUCKETS - 1)) if n else np.zeros(0, np.int64)
    index = np.nonzero(counts)[0]
    value = np.log1p(counts[index])
    if n:
        value /= math.sqrt(float(value @ value))
    solid = b"".join(text.split())
    size = max(1, len(solid))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = [(len(solid) - len(solid.translate(None, c))) / size for c in _CLASSES]
    shares.append(1 - len(set(words)) / max(1, n))
    shares.append(sum(map(bytes.__eq__, words, words[1:])) / max(1, n))
    shares.append(1 - len(set(lines)) / max(1, len(lines)))
    bins = [min(BINS - 1, math.ceil(math.sqrt(s) * (BINS - 1))) for s in shares]
    bins += [min(BINS - 1, int(2 * math.log2(1 + v))) for v in (n, len(lines), len(solid.translate(None, CONTINUATION)) / 32)]
    bins.append(min(BINS - 1, int(len(solid) / max(1, n) * 1.5)))
    where = BUCKETS + np.arange(STATISTICS) * BINS + bins
    return np.concatenate([index, where]).astype(np.int32), np.concatenate([value, np.full(STATISTICS, 0.5)]).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors, by Adam on the logistic loss over all rows."""
    y = np.array([r[2] for r in rows], np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(WIDTH, np.float32), np.random.default_rng(7).normal(0, 0.05, (WIDTH, RANK)).astype(np.float32)
    if not len(y) or y.min() == y.max():
        return bias, w, np.zeros_like(v)
    x = np.zeros((len(y), WIDTH), np.float32)
    for k, (index, value, _) in enumerate(rows):
        x[k, index] = value
    squares = x * x
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
    for t in range(1, steps + 1):
        sums = x @ v
        z = bias + x @ w + 0.5 * ((sums * sums).sum(1) - squares @ (v * v).sum(1))
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        bias -= RATE * 10 * float(g.sum())
        slopes = (x.T @ g + DECAY * w, x.T @ (g[:, None] * sums) - v * (squares.T @ g)[:, None] + DECAY * v)
        for p, slope, (m, s) in zip((w, v), slopes, state, strict=True):
            m *= 0.9
            m += 0.1 * slope
            s *= 0.99
            s += 0.01 * slope * slope
            p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return bias, w, v


def score(model: tuple[float, np.ndarray, np.ndarray], index: np.ndarray, value: np.ndarray) -> float:
    bias, w, v = model
    part = v[index] * value[:, None]
    sums = part.sum(0)
    z = bias + float(w[index] @ value) + 0.5 * float(sums @ sums - (part * part).sum())
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _vectors():
    @F.arrow_udf("struct<i:array<int>,x:array<float>>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip("ix", vector(t), strict=True)) for t in each(texts)], _X)

    return vectors


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text: str = "text") -> tuple[float, np.ndarray, np.ndarray]:
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, rows, id_col, text)
    got = sample.select("doc_id", "y", _vectors()(F.col("text").cast("binary")).alias("v")).collect()  # at most ``rows`` sparse vectors
    return fit([(np.array(r.v.i, np.int32), np.array(r.v.x, np.float32), r.y) for r in sorted(got, key=lambda r: r.doc_id)])


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, rows, id_col, text))

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([score(sent.value, *vector(t)) for t in each(texts)], pa.float64())

    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scores(F.col(text).cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
