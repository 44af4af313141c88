"""Product codes of vectors: Lloyd rounds over partition-local cover trees.

A vector's components become whole numbers and are cut into equal parts; each part is coded by the
nearest entry of its position's codebook. Rows are taken in chunks of a bounded number of rows where
they lie, without a shuffle. A chunk gets a cover tree for each part position, written once and read
by every round: points stand in the tree's order, so that a node's points are a range and the
cumulative sums of the points give any node's sum. A node of radius r around c goes as a whole to
the entry nearest to c if each other entry is farther from c by more than 2r; entries that are
farther by that much are out for the node's children too. Only nodes with several entries left
descend, and points of their leaves are compared exactly. A round sends sums and counts of entries,
a table the size of the codebooks for a partition; the driver holds codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truemark.llm.common import columns, room_for, written

#: Rows of a chunk, and points of a leaf. A leaf's points are compared one by one.
CHUNK_ROWS, LEAF_POINTS = 4096, 8
_NODE = np.dtype([("begin", "<u4"), ("end", "<u4"), ("centre", "<u4"), ("child", "<u4"), ("children", "<u4"), ("radius", "<f8")])


def whole_and_finite(vector: Column) -> Column:
    """The vector is there and none of its components is null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def scaled(vector: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: which rows are whole and finite, their lengths, and the floors of
    ``scale`` times their components, one row after the other."""
    lengths = pc.fill_null(pc.list_value_length(vector), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vector.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = vector.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
    values = np.floor(scale * flat[np.repeat(good, lengths)])
    if len(values) and np.abs(values).max() > 2.0**29:
        raise ValueError("components above 2**29 after scaling have no exact distances in 64 bits")
    return good, lengths[good], values.astype(np.int64)


# ------------------------------------------------------------------------------- cover trees


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): the points' order along the tree, and its nodes, each a range of that order.

    Level by level, with the covering distance halved each time, a node that reaches farther than
    the distance is split: its own centre and then, again and again, its first point not yet covered
    become centres of children. So each centre stays a centre below, children cover their points
    within the distance and lie farther than it from each other. All nodes of a level are split
    together. Equal points end in one node of radius 0, however many they are.
    """
    n = len(points)
    order = np.arange(n)
    made = [np.array([(0, n, 0, 0, 0, _reach(points, order, np.array([0]), np.array([0]))[0])], _NODE)]
    total, open_at, open_nodes = 1, np.array([0]), made[0].copy()
    reach = float(made[0]["radius"][0])
    while len(open_nodes) and reach > 0:
        reach /= 2
        if reach < 0.5:
            reach = 0.0
        big = (open_nodes["radius"] > reach) & (open_nodes["end"] - open_nodes["begin"] > LEAF_POINTS)
        alive = (open_nodes["radius"] > 0) & (open_nodes["end"] - open_nodes["begin"] > LEAF_POINTS)
        split, kept, kept_at = open_nodes[big], open_nodes[alive & ~big], open_at[alive & ~big]
        if len(split):
            children, parent = _split(points, order, split, reach)
            counts = np.bincount(parent, minlength=len(split))
            firsts = total + np.cumsum(counts) - counts
            flat = np.concatenate(made)
            flat["child"][open_at[big]], flat["children"][open_at[big]] = firsts, counts
            made = [flat, children]
            open_nodes, open_at = np.concatenate([kept, children]), np.concatenate([kept_at, total + np.arange(len(children))])
            total += len(children)
        else:
            open_nodes, open_at = kept, kept_at
    return order, np.concatenate(made)


def _reach(points: np.ndarray, order: np.ndarray, centres: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The largest distance from each centre to the points from its begin to the next one's."""
    sizes = np.diff(np.append(begins, len(order)))
    apart = points[order] - points[np.repeat(centres, sizes)]
    return np.sqrt(np.maximum.reduceat((apart * apart).sum(axis=1), begins).astype(np.float64))


def _split(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of ``nodes`` and each child's place in ``nodes``; ``order`` is sorted by child in place."""
    sizes = (nodes["end"] - nodes["begin"]).astype(np.int64)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    shift = np.cumsum(sizes) - sizes
    at = np.arange(len(owner)) - shift[owner] + nodes["begin"].astype(np.int64)[owner]  # places in ``order``
    own = order[at]
    child = np.full(len(own), -1)
    centres: list[np.ndarray] = []
    left, turn = np.arange(len(own)), 0
    while len(left):
        centre = np.zeros(len(nodes), np.int64)
        if turn:
            who, first = np.unique(owner[left], return_index=True)
            centre[who] = own[left[first]]
        else:
            centre = nodes["centre"].astype(np.int64)
        apart = points[own[left]] - points[centre[owner[left]]]
        near = (apart * apart).sum(axis=1) <= reach * reach
        child[left[near]] = turn
        centres.append(centre)
        left, turn = left[~near], turn + 1
    by_child = np.lexsort((child, owner))
    order[at] = own[by_child]
    owner, child = owner[by_child], child[by_child]
    begins = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(child) != 0)))
    made = np.zeros(len(begins), _NODE)
    parent = owner[begins]
    made["begin"] = at[begins]
    made["end"] = made["begin"] + np.diff(np.append(begins, len(owner)))
    made["centre"] = np.stack(centres)[child[begins], parent]
    made["radius"] = _reach(points, order[at], made["centre"].astype(np.int64), begins)
    return made, parent


def assign(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, end, entry) arrays: ranges of the tree's order and the nearest entry of ``book`` of all
    their points; ties go to the lower entry, so of equal entries only the first is ever taken."""
    _, first = np.unique(book, axis=0, return_index=True)
    entries = np.sort(first)
    book = book[entries]
    found = []
    at, left = np.array([0]), np.ones((1, len(book)), bool)
    while len(at):
        node = nodes[at]
        squared = _squared(points[node["centre"].astype(np.int64)], book)
        apart = np.sqrt(squared.astype(np.float64))
        apart[~left] = np.inf
        best = apart.min(axis=1)
        # a little more than 2r: rounding may keep an entry that could go, never the other way
        left &= apart <= (best + 2 * node["radius"] + 1e-9 * (1 + best + node["radius"]))[:, None]
        done = (node["radius"] == 0) | (left.sum(axis=1) == 1)
        nearest = np.where(left, squared, np.iinfo(np.int64).max).argmin(axis=1)
        found.append((node["begin"][done].astype(np.int64), node["end"][done].astype(np.int64), entries[nearest[done]]))
        leaf = ~done & (node["children"] == 0)
        if leaf.any():
            sizes = (node["end"][leaf] - node["begin"][leaf]).astype(np.int64)
            places = np.repeat(node["begin"][leaf].astype(np.int64) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            exact = np.where(np.repeat(left[leaf], sizes, axis=0), _squared(points[order[places]], book), np.iinfo(np.int64).max)
            found.append((places, places + 1, entries[exact.argmin(axis=1)]))
        down = ~done & (node["children"] > 0)
        counts = node["children"][down].astype(np.int64)
        at = np.repeat(node["child"][down].astype(np.int64) - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        left = np.repeat(left[down], counts, axis=0)
    return found


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, exact: floats are used only where they hold every sum."""
    widest = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * widest * widest * a.shape[1] < 2.0**52:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)).astype(np.int64)
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        apart = a[:, k, None] - b[None, :, k]
        total += apart * apart
    return total


# ------------------------------------------------------------------------------- chunks


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int16) if not len(values) or np.abs(values).max() < 1 << 15 else values.astype(np.int32)


def _chunks(rows: DataFrame, parts: int, dimension: int, scale: int) -> DataFrame:
    """One row per chunk of ``rows`` (row, vector): the rows as Arrow bytes, the whole-number vectors, and the trees.

    Rows with a vector of another length stand last in the chunk and have no vector there.
    """
    width = dimension // parts

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                own = batch.slice(start, CHUNK_ROWS)
                good, lengths, values = scaled(own.column(1), scale)
                if not good.any():
                    continue
                own, fits = own.filter(pa.array(good)), lengths == dimension
                vectors = values[np.repeat(fits, lengths)].reshape(-1, dimension)
                rest = own.take(pa.array(np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)]))).select(["row"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as out:
                    out.write_batch(rest)
                trees = [cover_tree(vectors[:, p * width : (p + 1) * width]) for p in range(parts)] if len(vectors) else []
                raw, narrow = b"".join(o.astype("<u2").tobytes() + t.tobytes() for o, t in trees), _narrow(vectors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([len(vectors)], pa.int32()), pa.array([narrow.itemsize], pa.int32()), pa.array([narrow.tobytes()], pa.binary()), pa.array([[len(t) for _, t in trees]], pa.list_(pa.int32())), pa.array([raw], pa.binary())],
                    names=["rest", "n", "bytes", "vectors", "nodes", "trees"],
                )

    return rows.mapInArrow(build, "rest binary, n int, bytes int, vectors binary, nodes array<int>, trees binary")


def _read(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(vectors, trees) of each chunk."""
    names = batch.schema.names
    for n, size, vectors, nodes, trees in zip(*(batch.column(names.index(c)) for c in ("n", "bytes", "vectors", "nodes", "trees"))):
        n, raw, place, found = n.as_py(), trees.as_buffer(), 0, []
        for count in nodes.as_py():
            order = np.frombuffer(raw, "<u2", n, place).astype(np.int64)
            found.append((order, np.frombuffer(raw, _NODE, count, place + 2 * n)))
            place += 2 * n + count * _NODE.itemsize
        yield np.frombuffer(vectors.as_buffer(), f"<i{size.as_py()}").reshape(n, dimension).astype(np.int64), found


def _round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one Lloyd round; entries without parts stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for vectors, trees in _read(batch, parts * width):
                for p, (order, nodes) in enumerate(trees):
                    points = vectors[:, p * width : (p + 1) * width]
                    running = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(points[order], axis=0)])
                    for begin, end, entry in assign(points, order, nodes, books[p]):
                        np.add.at(total[p], entry, running[end] - running[begin])
                        np.add.at(count[p], entry, end - begin)
        used = np.nonzero(np.repeat(count, width, axis=1).reshape(books.shape))
        yield pa.RecordBatch.from_arrays([pa.array(np.ravel_multi_index(used, books.shape)), pa.array(total[used]), pa.array(count[used[:2]])], names=["place", "total", "n"])

    partial = chunks.select("n", "bytes", "vectors", "nodes", "trees").mapInArrow(sums, "place long, total long, n long")
    made = books.copy().reshape(-1)
    for r in partial.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # one row a codebook component
        made[r["place"]] = r["total"] // r["n"]
    return made.reshape(books.shape)


def _coded(chunks: DataFrame, books: np.ndarray, row: T.DataType) -> DataFrame:
    parts, _, width = books.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.column(batch.schema.names.index("rest"))
            for (vectors, trees), raw in zip(_read(batch, parts * width), rest):
                (own,) = pa.ipc.open_stream(raw.as_buffer())
                codes, errors = np.zeros((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
                for p, (order, nodes) in enumerate(trees):
                    points, along = vectors[:, p * width : (p + 1) * width], np.zeros(len(vectors), np.uint8)
                    for begin, end, entry in assign(points, order, nodes, books[p]):
                        sizes = end - begin
                        along[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = np.repeat(entry, sizes)
                    codes[order, p] = along
                    apart = points - books[p][codes[:, p]]
                    errors += (apart * apart).sum(axis=1)
                none = [None] * (own.num_rows - len(vectors))
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([*(text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)), *none], pa.string()), pa.array([*errors.tolist(), *none], pa.int64())], names=[*own.schema.names, "code", "error"])

    schema = T.StructType([T.StructField("row", row), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return chunks.mapInArrow(code, schema).select("row.*", "code", "error")


def compress(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): ``docs`` without the vectors, with code (two hex digits a part) and error
    (squared distance to the coded vector); codebooks are parts x entries x width whole numbers.

    A component x counts as floor(scale * x). A codebook starts as the parts of the ``entries``
    smallest ids (null ids last, equal ids by vector); fewer rows give fewer entries. Rows whose
    vector is null or holds a null, NaN or infinite component are dropped. The dimension is that of
    the first kept row by id; kept rows of another length stay, with a null code and error, and take
    no part in the codebooks. Repeated rows count as often as they occur. Columns called code or
    error are replaced; names may hold any sign. An empty table gives no rows and no entries. A
    dimension that ``parts`` doesn't divide, or components above 2**29 after scaling, are errors.
    """
    docs = room_for(docs, ["code", "error"], id_col, vector_col)
    vector = F.col("`" + vector_col.replace("`", "``") + "`")
    by_id = [F.col("`" + id_col.replace("`", "``") + "`").asc_nulls_last(), F.transform(vector, lambda c: F.floor(c.cast("double") * scale))]
    kept = docs.where(whole_and_finite(vector))
    first = kept.orderBy(*by_id).select(F.size(vector).alias("n")).limit(1).collect()
    dimension = first[0]["n"] if first else parts
    if dimension % parts or not dimension:
        raise ValueError(f"{parts} equal parts don't make up {dimension} components")
    seeds = kept.where(F.size(vector) == dimension).orderBy(*by_id).limit(entries).select(by_id[1].alias("x")).collect()  # one row an entry
    books = np.array([r["x"] for r in seeds], np.int64).reshape(-1, parts, dimension // parts).transpose(1, 0, 2).copy()
    rows = kept.select(F.struct(*[c for c, name in zip(columns(docs), docs.columns) if name != vector_col]).alias("row"), vector.alias("vector"))
    if not seeds:
        return rows.select("row.*", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), books
    chunks = written(_chunks(rows, parts, dimension, scale), "vector-chunks")
    for _ in range(rounds):
        books = _round(chunks, books)
    return _coded(chunks, books, rows.schema["row"].dataType), books


def codebook_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components as decimal text, by part, entry and place in the part."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with label_error, the sum of error over rows of the same label, nulls together.

    The sums, a row a label, are written, so that Spark knows their size: it sends a small table to
    all tasks and joins a large one by shuffling, where a hot label's rows can be split.
    """
    coded = room_for(coded, ["label_error"], label_col)
    label = F.col("`" + label_col.replace("`", "``") + "`")
    sums = written(coded.groupBy(label.alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, label.eqNullSafe(F.col("_label"))).drop("_label")


def reconstruct(coded: DataFrame, books: np.ndarray, scale: int = 256, vector_col: str = "vector") -> DataFrame:
    """``coded`` with the vector that each code stands for (null for a null code), in the middle of its step."""
    coded = room_for(coded, [vector_col], "code")
    parts = len(books)
    middle = (books + 0.5) / scale

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [None if c is None else np.frombuffer(bytes.fromhex(c), np.uint8) for c in batch.column(1).to_pylist()]
            vectors = [None if c is None else middle[np.arange(parts), c].reshape(-1) for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["row", "vector"])

    rows = coded.select(F.struct(*columns(coded)).alias("row"), "code")
    schema = T.StructType([rows.schema["row"], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(decode, schema).select("row.*", F.col("vector").alias(vector_col))
