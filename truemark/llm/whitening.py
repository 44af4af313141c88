"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The fit list X (each distinct vector once, as whole numbers, centred) is written once in blocks. A
step takes the right vector v and asks Spark for Xᵀ(Xv): each task multiplies its own rows by v and
sends the sum of its rows weighted by the products, one vector, so that no row moves. Left vectors
are as long as the table and never leave it: each is X z for some z as long as a row, held by the
driver, and its products with other left vectors follow from Xᵀ(Xz). Both sides are orthogonalised
twice against all former vectors. The small bidiagonal matrix's SVD gives singular values (n times
the variances, squared) and components, and bounds their errors, which ends the steps.

One starting vector reaches one direction of an eigenvalue that occurs more than once. So after the
components are found, a second run in the space at right angles to them looks for a larger value,
and goes on as long as it finds one. The end result is measured on all rows of the fit list: the
covariance of the whitened rows less the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truemark.llm.common import columns, room_for, written
from truemark.llm.vector_codes import whole_and_finite

#: Errors of components, relative to the largest singular value, at which steps end.
TOLERANCE, CHECK_TOLERANCE = 1e-14, 1e-6


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list; components (k x d, unit rows) with their variances; trace of the
    covariance; steps that were taken; identity_error as measured on the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    steps: int
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], start: np.ndarray, wanted: int, locked: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, right singular vectors as columns, steps): the ``wanted`` largest of X in the
    space at right angles to the columns of ``locked``; ``product`` is v -> Xᵀ(Xv)."""
    d = len(start)
    right, left, pulled = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V; Z with U = XZ; XᵀU
    diagonal, above = [], []
    v = _apart(start, locked)
    v /= np.linalg.norm(v)
    room = d - locked.shape[1]
    while True:
        g = product(v)
        right = np.column_stack([right, v])
        z, w = v, g
        along = np.zeros(left.shape[1])
        for _ in range(2):  # Xv less its parts along the former left vectors
            part = left.T @ w
            z, w, along = z - left @ part, w - pulled @ part, along + part
        alpha = np.sqrt(max(float(z @ w), 0.0))
        above.append(along)
        diagonal.append(alpha)
        scale = max(diagonal)
        k = len(diagonal)
        b = np.zeros((k, k))
        for i in range(k):
            b[i, i] = diagonal[i]
            b[:i, i] = above[i]
        p, s, q = np.linalg.svd(b)
        if alpha <= 1e-12 * scale or alpha == 0:
            return s[:wanted], right @ q.T[:, :wanted], k
        z, w = z / alpha, w / alpha
        left, pulled = np.column_stack([left, z]), np.column_stack([pulled, w])
        r = w
        for _ in range(2):  # Xᵀu less its parts along the former right vectors
            r = _apart(r, np.column_stack([locked, right]))
        beta = float(np.linalg.norm(r))
        settled = k >= wanted and bool(np.all(beta * np.abs(p[k - 1, :wanted]) <= tolerance * s[0]))
        if settled or k >= room or beta <= 1e-13 * scale:
            return s[:wanted], right @ q.T[:, :wanted], k
        v = r / beta


def _apart(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return v - basis @ (basis.T @ v)


def largest_components(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, components as rows, steps) of X, by falling value; values of 0 are left out.

    A component's sign makes its largest entry positive. Components of equal values are any basis.
    """
    draw = np.random.default_rng(7)
    wanted = min(wanted, d)
    values, vectors, steps = bidiagonalise(product, draw.standard_normal(d), wanted, np.zeros((d, 0)), TOLERANCE)
    whole = steps >= d
    while not whole and vectors.shape[1] < d:
        start = draw.standard_normal(d)
        more, _, taken = bidiagonalise(product, start, 1, vectors, CHECK_TOLERANCE)
        steps += taken
        if len(values) >= wanted and more[0] <= values[wanted - 1] * (1 + 1e-9) or more[0] <= 1e-7 * max(values[0], 1e-300):
            break
        more, found, taken = bidiagonalise(product, start, 1, vectors, TOLERANCE)
        steps += taken
        values, vectors = np.append(values, more), np.column_stack([vectors, found])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    kept = [i for i in range(min(wanted, len(values))) if values[i] > 1e-6 * values[0]]
    rows = vectors[:, kept].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]) if len(rows) else np.zeros(0)
    return values[kept], rows * signs[:, None], steps


# ------------------------------------------------------------------------------- the fit list


def _block_matrix(raw: pa.Scalar, d: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, d)


def fit_blocks(vectors: DataFrame, d: int) -> DataFrame:
    """The distinct rows of ``vectors`` (x, whole numbers), written in blocks (x as bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).flatten().to_numpy().astype("<i8").tobytes()], pa.binary())], names=["x"])

    return written(vectors.select("x").distinct().mapInArrow(pack, "x binary"), "fit-blocks")


def _summed(blocks: DataFrame, size: int, of_block: Callable[[np.ndarray], np.ndarray], d: int, kind: str) -> list:
    """The sum over all blocks of ``of_block``, ``size`` numbers; each task sends that many."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for batch in batches:
            for raw in batch.column(0):
                total = total + of_block(_block_matrix(raw, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    found = [0] * size
    for r in blocks.mapInArrow(partial, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect():
        found[r["at"]] = r["value"]
    return found


def _checked(x: np.ndarray) -> np.ndarray:
    """n, sums and the sum of squares of a block, exact."""
    if len(x) * float(np.abs(x).max(initial=0)) ** 2 * x.shape[1] >= 2.0**62:
        raise ValueError("sums of squares of these components don't fit 64 bits")
    return np.concatenate([[len(x)], x.sum(axis=0), [(x * x).sum()]])


def fit(blocks: DataFrame, d: int, components: int) -> Whitening | None:
    """The whitening of a fit list in ``blocks``; None for an empty one."""
    n, *rest = _summed(blocks, d + 2, _checked, d, "long")
    if not n:
        return None
    sums, squares = rest[:d], rest[d]
    mean = np.array([s / n for s in sums])
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)  # whole numbers up to the division

    def product(v: np.ndarray) -> np.ndarray:
        def of_block(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ v)

        return np.array(_summed(blocks, d, of_block, d, "double"))

    values, rows, steps = largest_components(product, d, components) if trace > 0 else (np.zeros(0), np.zeros((0, d)), 0)
    variances = values * values / n
    k = len(rows)
    if not k:
        return Whitening(n, sums, rows, variances, trace, steps, 0.0)
    to_white = (rows / np.sqrt(variances)[:, None]).T

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ to_white
        return np.concatenate([y.sum(axis=0), (y.T @ y).reshape(-1)])

    found = np.array(_summed(blocks, k + k * k, moments, d, "double")) / n
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    return Whitening(n, sums, rows, variances, trace, steps, error)


# ------------------------------------------------------------------------------- rows


def whiten(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """``docs`` without the vector, a row for each component, numbered from 1 by falling variance:
    component, n, deviation, whitened, explained and identity_error (one value for all).

    A component c of a vector counts as floor(scale * c). Rows whose vector is null or holds a null,
    NaN or infinite component are dropped. The dimension is that of the first kept row by id (null
    ids last, equal ids by vector). Kept rows of another length, and all rows where no direction
    varies, give one row with a null component. Repeated rows are whitened as often as they occur
    and fitted once. Columns with a name of the added ones are replaced; names may hold any sign. An
    empty table gives no rows. Deviations or sums beyond 64 bits are an error.
    """
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    docs = room_for(docs, added, id_col, vector_col)
    vector, row_id = (F.col("`" + c.replace("`", "``") + "`") for c in (vector_col, id_col))
    others = [c for c, name in zip(columns(docs), docs.columns) if name != vector_col]
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    kept = docs.where(whole_and_finite(vector)).select(F.struct(*others).alias("row"), whole.alias("x"), row_id.alias("id"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "x").select(F.size("x").alias("d")).limit(1).collect()
    d = first[0]["d"] if first else 0
    found = fit(fit_blocks(kept.where(F.size("x") == d), d), d, components) if d else None
    rows = kept.select("row", "x")
    schema = T.StructType([rows.schema["row"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    k = len(found.components) if found else 0

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.equal(pc.list_value_length(batch.column(1)), d if k else -1).to_numpy(zero_copy_only=False)
            if fits.any():
                yield _whitened(batch, np.flatnonzero(fits), found, k, d)
            if not fits.all():
                own = batch.column(0).take(pa.array(np.flatnonzero(~fits)))
                yield pa.RecordBatch.from_arrays([own, *(pa.nulls(len(own), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["row", *added])

    return rows.mapInArrow(apply, schema).select("row.*", *added)


def _whitened(batch: pa.RecordBatch, rows: np.ndarray, found: Whitening, k: int, d: int) -> pa.RecordBatch:
    x = batch.column(1).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d)
    white = ((x - found.mean) @ found.components.T) / np.sqrt(found.variances)
    sums = np.array(found.sums, object)
    widest = float(np.abs(x).max()) * found.n + max(abs(s) for s in found.sums)
    kind = object if widest * widest * d >= 2.0**62 else np.int64
    apart = found.n * x.astype(kind) - sums.astype(kind)
    deviation = (apart * apart).sum(axis=1)
    return pa.RecordBatch.from_arrays([
        batch.column(0).take(pa.array(np.repeat(rows, k))),
        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
        pa.array(np.full(k * len(rows), found.n)),
        pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
        pa.array(white.reshape(-1)),
        pa.array(np.tile(found.variances / found.trace, len(rows))),
        pa.array(np.full(k * len(rows), found.identity_error)),
    ], names=["row", "component", "n", "deviation", "whitened", "explained", "identity_error"])
