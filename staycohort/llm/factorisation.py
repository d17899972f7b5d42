"""Quality classifier: a factorisation machine over words, structure and metadata.

A document becomes a sparse vector: hashed words, statistics of its structure, and its
recorded length. The model adds to a linear score every pairwise interaction of features,
with weights that are inner products of low-rank factors; summed in linear time as half of
(sum of factors) squared minus the sum of squared factors. It is fitted by Adagrad on a
bounded sample of labelled documents and then scores every document where it lies.

Nulls, ties and the rest: a null or empty text has no words and all-zero statistics and
is scored like any other; a null n_chars counts as unknown; several labels of one document
count once, as good if any says so; without labels of both kinds every score is the share
of good labels, 0.5 if there is none; repeated rows score alike; other columns are unused.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycohort.llm.common import small_batches, words_of

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"#*$%&|<>!?,.;:"

#: Statistics of structure and metadata, see `_statistics`.
STATISTICS = 16


@dataclass(frozen=True)
class Settings:
    """`sample`: the most labelled documents that a fit reads."""

    buckets: int = 1 << 14
    rank: int = 8
    sample: int = 6_000
    passes: int = 12
    batch: int = 64
    rate: float = 0.05
    penalty: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _statistics(text: str, data: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    n, size = max(1, len(words)), max(1, len(data))
    lines = [line for line in data.split(b"\n") if line.strip()]
    marks = [data.count(bytes([m])) / n for m in (b"|!,.")]
    return [
        math.log1p(len(words)),
        len(text) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        (len(data) - len(data.translate(None, _CAPITALS))) / size,
        (len(data) - len(data.translate(None, b"0123456789"))) / size,
        (len(data) - len(data.translate(None, _MARKS))) / size,
        (len(data) - len(data.translate(None, b"#*$%&<>"))) / size,
        len(lines) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        *marks,
        0.0 if n_chars is None else 1.0,
        math.log1p(max(0, n_chars or 0)),
    ]


def features(text: str | None, n_chars: int | None, buckets: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their weights (unit length in all), and the statistics."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = words_of(text)
    counts = Counter(words)
    merged: dict[int, int] = {}
    for word, n in counts.items():
        bucket = zlib.crc32(word) % buckets
        merged[bucket] = merged.get(bucket, 0) + n
    at = np.fromiter(merged, np.int32, len(merged))
    values = np.log1p(np.fromiter(merged.values(), np.float64, len(merged)))
    if len(values):
        values /= np.linalg.norm(values)
    return at, values, _statistics(text, data, words, counts, n_chars)


def _interactions(at: np.ndarray, values: np.ndarray, model: Model) -> float:
    """Linear part and pairwise part by the sum-of-squares identity."""
    parts = model.factors[at] * values[:, None]
    total = parts.sum(0)
    return model.bias + model.weights[at] @ values + 0.5 * float(total @ total - (parts * parts).sum())


def score(text: str | None, n_chars: int | None, model: Model, buckets: int) -> float:
    at, values, statistics = features(text, n_chars, buckets)
    dense = np.clip((np.array(statistics) - model.mean) / model.scale, -4, 4) / 4
    at = np.concatenate([at, np.arange(buckets, buckets + STATISTICS)])
    margin = _interactions(at, np.concatenate([values, dense]), model)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def _fit(rows: list, labels: np.ndarray, settings: Settings) -> Model:
    dense = np.array([list(r["statistics"]) for r in rows], np.float64).reshape(len(rows), STATISTICS)
    mean = dense.mean(0) if len(rows) else np.zeros(STATISTICS)
    scale = np.maximum(dense.std(0), 1e-6) if len(rows) else np.ones(STATISTICS)
    size = settings.buckets + STATISTICS
    rng = np.random.default_rng(settings.seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    weights, factors = np.zeros(size), rng.normal(0, 0.05, (size, settings.rank))
    bias = math.log(share / (1 - share))
    if len(set(labels)) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        bias = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(bias, weights, np.zeros_like(factors), mean, scale)
    dense = np.clip((dense - mean) / scale, -4, 4) / 4
    extra = np.arange(settings.buckets, size)
    at = [np.concatenate([np.array(r["at"], np.int64), extra]) for r in rows]
    values = [np.concatenate([np.array(r["value"], np.float64), d]) for r, d in zip(rows, dense, strict=True)]
    # both labels weigh the same in all
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    sum_w, sum_v, sum_b = np.full(size, 1e-6), np.full((size, settings.rank), 1e-6), 1e-6
    for _ in range(settings.passes):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), settings.batch):
            chosen = order[start : start + settings.batch]
            rows_at = np.concatenate([at[i] for i in chosen])
            x = np.concatenate([values[i] for i in chosen])
            sizes = np.array([len(at[i]) for i in chosen])
            edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            parts = factors[rows_at] * x[:, None]
            total = np.add.reduceat(parts, edges)
            margin = bias + np.add.reduceat(weights[rows_at] * x, edges)
            margin += 0.5 * ((total**2).sum(1) - np.add.reduceat((parts**2).sum(1), edges))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) * weight[chosen] / len(chosen)
            slope = np.repeat(error, sizes) * x
            touched, where = np.unique(rows_at, return_inverse=True)
            grad_w = np.bincount(where, slope, len(touched)) + settings.penalty * weights[touched]
            pull = slope[:, None] * (np.repeat(total, sizes, 0) - parts)
            grad_v = np.stack([np.bincount(where, c, len(touched)) for c in pull.T], 1)
            grad_v += settings.penalty * factors[touched]
            sum_w[touched] += grad_w**2
            sum_v[touched] += grad_v**2
            sum_b += error.sum() ** 2
            weights[touched] -= settings.rate * grad_w / np.sqrt(sum_w[touched])
            factors[touched] -= settings.rate * grad_v / np.sqrt(sum_v[touched])
            bias -= settings.rate * error.sum() / math.sqrt(sum_b)
    return Model(float(bias), weights, factors, mean, scale)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from the documents of `labels` (doc_id, quality), `settings.sample` at most:
    those whose hashed ids are least."""
    small_batches(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.sample)
    )
    sample = docs.select("doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                features(t.as_py(), n.as_py(), settings.buckets)
                for t, n in zip(batch["text"], batch["n_chars"], strict=True)
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "quality": batch["quality"],
                    "doc_id": batch["doc_id"],
                    "at": pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    "value": pa.array([f[1] for f in found], pa.list_(pa.float64())),
                    "statistics": pa.array([f[2] for f in found], pa.list_(pa.float64())),
                }
            )

    schema = "quality int, doc_id bigint, at array<int>, value array<double>, statistics array<double>"
    narrow = sample.withColumn("quality", F.col("quality").cast("int"))
    rows = narrow.select("quality", "doc_id", "text", "n_chars").mapInArrow(extract, schema)
    got = rows.toArrow().sort_by("doc_id").to_pylist()
    return _fit(got, np.array([r["quality"] for r in got], np.float64), settings)


def scored(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [
                score(t.as_py(), n.as_py(), model, settings.buckets)
                for t, n in zip(batch["text"], batch["n_chars"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text", "n_chars").mapInArrow(run, "doc_id bigint, score double")
