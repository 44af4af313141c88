"""Quality scores learned from preference pairs (Bradley-Terry).

A good document is preferred to a bad one with probability sigmoid(s_good - s_bad), where s is
linear in text features; the weights minimise the logistic loss on feature differences of pairs.
The decision threshold is the quantile of the scores at the share of bad documents, over all
labelled documents that may be learned from; only the weights come from a bounded sample of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truemark.llm.common import room_for, written

_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _SPACE, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, "uint8")
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
_CLASS[list(b"#*$%&|<>@^~_=+\\/{}[]")] = _SYMBOL
_CLASS[list(b".,;:!?'\"()-")] = _STOP
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
FEATURES = 16


def features(text: str | None) -> np.ndarray:
    """Length, character classes, repetition and line features of a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = max(1, len(words))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, "uint8")], minlength=7) / max(1, len(raw))
    marks = raw.count(b"!")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    return np.array([
        np.log1p(len(words)), len(raw) / n / 10, kinds[_UPPER], kinds[_DIGIT], kinds[_SYMBOL], kinds[_STOP],
        np.log1p(1000 * kinds[_SYMBOL]), np.log1p(1000 * kinds[_UPPER]), np.log1p(1000 * marks / max(1, len(raw))),
        len(counts) / n, top / n, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(raw.count(b"|")), np.log1p(len(lines)), float(len(words) < 20),
    ])


@dataclass
class PreferenceModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and 0.3 exactly at the threshold."""
        z = np.clip(self.raw(x) - self.threshold, -30, 30)
        return 1 / (1 + (0.7 / 0.3) * np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 20_000, penalty: float = 1e-3, steps: int = 300, seed: int = 7) -> PreferenceModel:
    """Fit on ``pairs`` random (good, bad) pairs; without both classes every score is the same."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(FEATURES)
    if not len(good) or not len(bad):
        return PreferenceModel(weights, mean, scale, -10.0 if len(good) or not len(x) else 10.0)
    rng, z = np.random.default_rng(seed), (x - mean) / scale
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(steps):  # Newton steps would do with fewer; plain ones need no solver
        lost = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
        weights += 0.5 * (difference.T @ lost / pairs - penalty * weights)
    scores = z @ weights
    # the quantile at these rows' share of bad documents, between the scores on its two sides
    return PreferenceModel(weights, mean, scale, float(np.quantile(scores, len(bad) / len(x))))


def share_quantile(values: DataFrame, below: int, column: str = "value") -> float:
    """``numpy.quantile(values, below / n)`` of the n rows of ``values``, for 0 < below < n.

    Exact and distributed: each pass counts 4,096 ranges and goes on in the one that holds the
    ``below``-th smallest value, until that range is one value.
    """
    v = F.col(column)
    n, low, high = values.agg(F.count(v), F.min(v), F.max(v)).first()
    left = below
    while low < high:
        part = F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(4095.0)).alias("part")
        parts = values.where(v.between(low, high)).groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()  # at most 4,096 rows
        for r in sorted(parts, key=lambda r: r["part"]):
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    after, least = values.agg(F.count(F.when(v <= low, 1)), F.min(F.when(v > low, v))).first()
    return low if after > below else low + (least - low) * (1 - below / n)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> PreferenceModel:
    """Fit on labelled documents (doc_id, text; doc_id, quality).

    The weights come from at most about ``per_class`` documents of each class, kept by a hash of
    their id at a rate that gives that many; the threshold comes from the scores of all of them.
    Only features leave the executors.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()).tolist() for t in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    source = docs.select("doc_id", "text")
    measured = source.mapInArrow(measure, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<double>")
    # features are small, so that this join needs no bound on the number of labels
    known = written(measured.join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id"), "features")
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for q, n in sizes.items():
        keep = keep | ((F.col("quality") == q) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, per_class / n) * (1 << 30))))
    got = sorted(known.where(keep).collect(), key=lambda r: (str(r["doc_id"]), r["x"]))  # about 2 * per_class rows
    model = fit_pairs(np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([r["quality"] for r in got]))
    if not model.weights.any():
        return model

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(0).to_pylist()).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x), pa.float64())], names=["value"])

    scores = written(known.select("x").mapInArrow(rank, "value double"), "scores")
    return replace(model, threshold=share_quantile(scores, sizes[0]))


def score(docs: DataFrame, model: PreferenceModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted (score >= 0.3). Null texts are scored as empty ones.

    Repeated rows give equal results; columns of ``docs`` called score or predicted are replaced.
    """
    docs = room_for(docs, ["score", "predicted"], text_col)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)]).reshape(-1, FEATURES)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.3).astype("int32"))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
