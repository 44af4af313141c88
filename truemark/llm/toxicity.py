"""Toxic spans by a linear-chain conditional random field.

Tokens are the chunks between white space. Labels exist for documents only, so the training
tokens are labelled first: in toxic documents, tokens whose word or stem occurs there far more
often than in clean ones. The field has two states, hashed word and stem features, and learned
transitions; forward-backward gives each token's marginal. A document's score is a logistic
function of its marginals (their largest, their sum), and its spans are runs of marginals of
at least a half, as code-point offsets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truemark.llm.common import room_for, worker_cache, written

_DIM, _WINDOW, _CACHED = 1 << 17, 15, 600_000
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_"
_CHUNK = re.compile(r"\S+")


def token_parts(chunk: str) -> tuple[str, ...]:
    """The word and its stems of 4, 5 and 6 letters; one name is one feature."""
    word = chunk.strip(_EDGE).lower()
    return ("w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n))


@dataclass
class ChainField:
    """unary: weights of hashed features; bias: of every token; pair[i, j]: of state i before j."""

    unary: np.ndarray
    bias: float
    pair: np.ndarray
    document: np.ndarray

    def token(self, chunk: str) -> float:
        return self.bias + float(sum(self.unary[zlib.crc32(p.encode()) % _DIM] for p in token_parts(chunk)))


def messages(unary: np.ndarray, mask: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """odds of each token alone, and forward and backward messages as odds toxic : clean.

    Rows are sequences; ``mask`` marks the tokens, which come first. Odds need no logarithm at each
    step; masked places pass odds of 1. A forward message includes its own token, a backward one doesn't.
    """
    n, length = unary.shape
    e = np.exp(pair)
    odds = np.where(mask, np.exp(np.clip(unary, -30, 30)), 0.0)
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    r = odds[:, 0]
    forward[:, 0] = r
    for t in range(1, length):
        r = odds[:, t] * (r * e[1, 1] + e[0, 1]) / (r * e[1, 0] + e[0, 0])
        forward[:, t] = r
    b = np.ones(n)
    for t in range(length - 2, -1, -1):
        v = odds[:, t + 1] * b
        b = np.where(mask[:, t + 1], (v * e[1, 1] + e[1, 0]) / (v * e[0, 1] + e[0, 0]), 1.0)
        backward[:, t] = b
    return odds, forward, backward


def marginals(unary: np.ndarray, mask: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(toxic) of each token."""
    _, forward, backward = messages(unary, mask, pair)
    both = forward * backward
    return both / (1 + both)


def likelihood(unary: np.ndarray, mask: np.ndarray, pair: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P(y) of each sequence, and its gradients by unary (n, length) and pair (n, 2, 2).

    Both gradients are what is seen less what is expected; the expected pairs of states come from
    the forward message of the first token and the odds and backward message of the second.
    """
    odds, forward, backward = messages(unary, mask, pair)
    both = forward * backward
    e, pairs = np.exp(pair), mask[:, 1:] & mask[:, :-1]
    first = np.stack([np.ones_like(forward[:, :-1]), forward[:, :-1]], axis=-1)
    second = np.stack([np.ones_like(odds[:, 1:]), odds[:, 1:] * backward[:, 1:]], axis=-1)
    joint = first[..., :, None] * e * second[..., None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    state = np.stack([1 - y, y], axis=-1)
    seen = state[:, :-1, :, None] * state[:, 1:, None, :]
    by_pair = ((seen - joint) * pairs[..., None, None]).sum(axis=1)
    # log Z: what each step scales the clean state's message by, and the last message's sum
    scales = np.log(e[0, 0] + forward[:, :-1] * e[1, 0]) * pairs
    last = forward[np.arange(len(mask)), np.maximum(mask.sum(axis=1) - 1, 0)]
    value = (np.clip(unary, -30, 30) * y * mask).sum(axis=1) + (seen * pair * pairs[..., None, None]).sum(axis=(1, 2, 3)) - scales.sum(axis=1) - np.log1p(last)
    return value, (y - both / (1 + both)) * mask, by_pair


def part_counts(texts: list[str], toxic: list[int]) -> list[tuple[str, int, int]]:
    """(part, toxic, texts of that class that hold it)."""
    seen = [Counter(), Counter()]
    for text, y in zip(texts, toxic):
        seen[y].update({p for c in set(text.split()) for p in token_parts(c)})
    return [(p, y, n) for y in (0, 1) for p, n in seen[y].items()]


def is_marked(n_clean: int, n_toxic: int, least_docs: int = 3, odds: float = 8.0) -> Column:
    """Parts that are ``odds`` times as frequent in toxic texts as in clean ones, and in ``least_docs`` toxic ones.

    Of rows part, clean and toxic: the texts of either class that hold it.
    """
    clean, toxic = F.col("clean"), F.col("toxic")
    return (toxic >= least_docs) & (toxic / max(1, n_toxic) > odds * (clean + 0.5) / max(1, n_clean)) & (F.length("part") > 3)


def windows(text: str, toxic: int, marked: set[str], per_toxic: int, per_clean: int) -> list[tuple[list[str], list[int]]]:
    """Training sequences of a text with their tags: around at most ``per_toxic`` labelled tokens of a
    toxic one and ``per_clean`` tokens of a clean one, drawn over the whole text by a hash of it."""
    chunks = text.split()
    known: dict[str, bool] = {}
    for c in set(chunks) if toxic else ():
        known[c] = any(p in marked for p in token_parts(c))
    tags = np.array([known.get(c, False) for c in chunks], "int8")
    found = np.flatnonzero(tags) if toxic else np.arange(len(chunks))
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    places = rng.choice(found, min(len(found), per_toxic if toxic else per_clean), replace=False) if len(found) else []
    starts = [max(0, int(p) - _WINDOW // 2) for p in places]
    return [(chunks[a : a + _WINDOW], tags[a : a + _WINDOW].tolist()) for a in starts]


def fit_chain(chunks: list[list[str]], tags: list[list[int]], stands: np.ndarray, rounds: int = 60, penalty: float = 1e-4) -> ChainField:
    """Maximum likelihood, less a penalty, by Adam over full batches of short tagged sequences.

    ``stands`` says how much each sequence counts; only ratios matter. All transitions are learned
    but the one from clean to clean, which is the measure of the others.
    """
    field = ChainField(np.zeros(_DIM), -4.0, np.zeros((2, 2)), np.array([-6.0, 0.0, 0.0, 0.0, 0.0]))
    if not len(chunks):
        return field
    mask = np.array([[i < len(c) for i in range(_WINDOW)] for c in chunks])
    y = np.array([[*t, *[0] * (_WINDOW - len(t))] for t in tags], float)
    ids = {c: [zlib.crc32(p.encode()) % _DIM for p in token_parts(c)] for c in {x for s in chunks for x in s}}
    index = np.full((*mask.shape, 4), _DIM, "int32")
    for i, s in enumerate(chunks):
        for j, c in enumerate(s):
            index[i, j, : len(ids[c])] = ids[c]
    w = np.zeros(_DIM + 5)  # one idle place for missing parts, then bias and three transitions
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[_DIM + 1] = -4.0
    stands = stands / stands.sum()
    for step in range(1, rounds + 1):
        unary = w[_DIM + 1] + sum(w[index[..., k]] for k in range(4))
        _, gap, by_pair = likelihood(unary, mask, np.array([[0.0, w[_DIM + 2]], [w[_DIM + 3], w[_DIM + 4]]]), y)
        gap *= stands[:, None]
        g = sum(np.bincount(index[..., k].ravel(), weights=gap.ravel(), minlength=_DIM + 5) for k in range(4))
        g[_DIM], g[_DIM + 1] = 0.0, gap.sum()
        g[_DIM + 2 :] = (by_pair.reshape(-1, 4)[:, 1:] * stands[:, None]).sum(axis=0)
        g -= penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w[_DIM], w[_DIM + 2 :] = 0.0, np.clip(w[_DIM + 2 :], -3, 3)
    field.unary, field.bias, field.pair = w[:_DIM].copy(), float(w[_DIM + 1]), np.array([[0.0, w[_DIM + 2]], [w[_DIM + 3], w[_DIM + 4]]])
    return field


def _document(p: np.ndarray) -> list[float]:
    """Intercept, the two largest marginals, and the expected toxic tokens among the likelier ones,
    in all and for each hundred tokens."""
    top = np.sort(p[p >= 0.2])[::-1]
    total = float(top.sum())
    return [1.0, float(top[0]) if len(top) else 0.0, float(top[1]) if len(top) > 1 else 0.0, np.log1p(total), np.log1p(100 * total / max(1, len(p)))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


class _Tokens(dict):
    def __init__(self, field: ChainField):
        super().__init__()
        self.field = field

    def __missing__(self, chunk: str) -> float:
        value = self.field.token(chunk)
        if len(self) < _CACHED:
            self[chunk] = value
        return value


def tag(split: list[list[str]], field: ChainField, key: int | None = None) -> list[np.ndarray]:
    """Marginals of each text's chunks; texts of like length run side by side."""
    tokens = _Tokens(field) if key is None else worker_cache(("field", key), lambda: _Tokens(field))
    found = [np.zeros(0)] * len(split)
    order = sorted((i for i, s in enumerate(split) if s), key=lambda i: len(split[i]))
    at = 0
    while at < len(order):
        longest = len(split[order[min(at + 255, len(order) - 1)]])
        group = order[at : at + max(1, min(256, 500_000 // longest))]
        width = len(split[group[-1]])
        unary, mask = np.zeros((len(group), width)), np.zeros((len(group), width), bool)
        for k, i in enumerate(group):
            n = len(split[i])
            unary[k, :n] = np.fromiter(map(tokens.__getitem__, split[i]), float, n)
            mask[k, :n] = True
        # step over the columns of contiguous memory
        p = marginals(np.asfortranarray(unary), np.asfortranarray(mask), field.pair)
        for k, i in enumerate(group):
            found[i] = p[k, : len(split[i])]
        at += len(group)
    return found


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of chunks with marginals of at least ``least``, as code-point offsets."""
    found: list[dict] = []
    last = -2
    for i, m in enumerate(_CHUNK.finditer(text)):
        if p[i] >= least:
            if last == i - 1:
                found[-1]["end"] = m.end()
            else:
                found.append({"start": m.start(), "end": m.end()})
            last = i
    return found


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2500, per_toxic: int = 12, per_clean: int = 6) -> ChainField:
    """Fit on at most about ``per_class`` labelled documents of each class (doc_id, text; doc_id, toxic).

    Each one stands for as many as its class has in all for one that was taken, so that scores
    don't depend on how many were left out. The sequences of one document that train the chain
    are bounded too: ``per_toxic`` and ``per_clean`` places of a text, drawn over its whole length.
    Texts stay in the executors: the driver gets counted parts, short sequences, and five numbers
    a document. Without labels of both classes, all documents get one low or high score.
    """
    known = docs.select("doc_id").join(labels.where("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return replace(fit_chain([], [], np.zeros(0)), document=np.array([2.0 if 1 in sizes else -6.0, 0.0, 0.0, 0.0, 0.0]))
    keep = F.lit(False)
    for q, n in sizes.items():
        keep = keep | ((F.col("toxic") == q) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, per_class / n) * (1 << 30))))
    rows = docs.select("doc_id", "text").join(F.broadcast(labels.where(keep).select("doc_id", "toxic")), "doc_id")  # about 2 * per_class labels
    sample = written(rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")
    taken = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = {q: sizes[q] / n for q, n in taken.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None, dict)  # what another operator left in this worker goes
        for b in batches:
            rows = part_counts(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["part", "toxic", "n"])

    of = lambda q: F.sum(F.when(F.col("toxic") == q, F.col("n")).otherwise(0))
    counts = sample.mapInArrow(count, "part string, toxic int, n long").groupBy("part").agg(of(0).alias("clean"), of(1).alias("toxic"))
    marked = {r["part"] for r in counts.where(is_marked(taken.get(0, 0), taken.get(1, 0))).select("part").collect()}  # the few that mark toxic texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(q, *x) for t, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in windows(t, q, marked, per_toxic, per_clean)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([" ".join(x[1]) for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.int32()))], names=["toxic", "chunks", "tags"])

    cuts = sorted((r["chunks"], r["tags"], r["toxic"]) for r in sample.mapInArrow(cut, "toxic int, chunks string, tags array<int>").collect())
    field = fit_chain([c.split() for c, _, _ in cuts], [t for _, t, _ in cuts], np.array([weight[q] for _, _, q in cuts]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [_document(p) for p in tag([t.split() for t in b.column(0).to_pylist()], field)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = sorted((tuple(r["x"]), r["toxic"]) for r in sample.mapInArrow(measure, "toxic int, x array<double>").collect())
    toxic = np.array([q for _, q in got])
    stands = np.array([weight[q] for _, q in got])
    return replace(field, document=_logistic(np.array([x for x, _ in got]), toxic, stands / stands.mean()))


def score(docs: DataFrame, field: ChainField, text_col: str = "text") -> DataFrame:
    """``docs`` with score, predicted (score >= 0.3) and spans (array of start, end offsets).

    Null and empty texts have no tokens: the score is that of a document without toxic tokens.
    Repeated rows give equal results; columns of ``docs`` that have a name of the added ones are
    replaced.
    """
    docs = room_for(docs, ["score", "predicted", "spans"], text_col)
    names, at = docs.columns, docs.columns.index(text_col)
    key = zlib.crc32(field.unary.tobytes() + field.document.tobytes())
    used = np.flatnonzero(field.unary)  # most weights are zero: send the others
    values, rest = field.unary[used], ChainField(np.zeros(0), field.bias, field.pair, field.document)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unary = np.zeros(_DIM)
        unary[used] = values
        own = ChainField(unary, rest.bias, rest.pair, rest.document)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                texts = [t.as_py() or "" for t in b.column(at)]
                found = tag([t.split() for t in texts], own, key)
                z = np.clip(np.array([_document(p) for p in found]) @ own.document, -30, 30)
                s = 1 / (1 + np.exp(-z))
                marked = [spans(t, p) if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.3).astype("int32")), pa.array(marked, span)], names=[*names, "score", "predicted", "spans"])

    offsets = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", offsets)]
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + more))
