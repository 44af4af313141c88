"""MinHash near-dedup by a signature-coordinate inverted join.

A document is a set of hashed word shingles; equal sets are one node, named by the set's 128-bit
fingerprint. A node's signature has one minimum per coordinate, and a token (coordinate, minimum)
is what the node is posted under. Sizes fall into classes, each a quarter wider than the last, so
that nodes of the wanted similarity are in one class or in neighbouring ones; a family of lists
holds the nodes of two neighbouring classes, and each node is in two families. Two nodes whose sets have the wanted similarity agree in at
least ``MATCH`` of the coordinates but for a chance of some 4e-5 a pair. So with a node's tokens
in the order of their frequency, rarest first, such a pair meets in one of the first
``COORDINATES - MATCH + 1`` of a family (prefix). Longer lists are skipped, not merged: a pair that met in a
short one is counted by probing its tokens in all coordinates, at the first list the two share, so
that a pair comes out once. A node with fewer than ``MATCH`` shared tokens in a family isn't posted there at all.

Pairs are sought in two steps, so that a large group of near copies isn't paired with itself.
First each posting list names a hub, its most central node, and nodes are tried against the hubs
of their lists. Then, in lists that still hold several components, the
nodes outside the largest one meet the nodes of other components; pairs inside a component can't
change the result. That step has no caps; long lists are dealt over blocks. Components are found
by alternating large and small stars.

Posted nodes carry an odd sketch: whether each of 1,024 buckets holds an odd number of the set's
shingles. Two sketches differ in no more buckets than the sets do in shingles, so that this bound
loses no link; sets of some thousand shingles fill the buckets, and there the expected number of
differing buckets and five standard deviations (a chance of some 3e-7) bounds it too. What passes
is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truemark.llm.common import bucketed, worker_cache, written

COORDINATES, MATCH = 48, 27
_MULTIPLY = np.random.default_rng(20).integers(1 << 62, 1 << 63, COORDINATES, dtype="uint64") * np.uint64(2) + np.uint64(1)
_CACHED = 500_000
_BUCKETS = 1024
_LONGS = _BUCKETS // 64
_SKETCH = "doc_id {}, n long, node binary, signature array<int>, parity array<long>"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHED:
            self[word] = value
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words (ASCII white space, A-Z lowered).

    Fewer words make one shingle of their whole sequence; none make an empty set.
    """
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(worker_cache("words", _Words).__getitem__, split), "uint64", len(split))
    size = min(words, len(split))
    rolled = np.full(len(h) - size + 1, size, "uint64")
    for k in range(size):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(rolled)


def fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 32-bit minimum of each coordinate's hash."""
    low = np.full(COORDINATES, 0xFFFFFFFF, "uint64")
    for a in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[a : a + 4096, None] * _MULTIPLY) >> np.uint64(32)).min(axis=0))
    return low.astype("uint32").view("int32")


def parity(shingles: np.ndarray) -> np.ndarray:
    """An odd sketch as longs: for each bucket of the hash's low bits whether it holds an odd number of shingles."""
    held = np.bincount((shingles & np.uint64(_BUCKETS - 1)).astype("int64"), minlength=_BUCKETS)
    return np.packbits((held & 1).astype("uint8")).view("<i8")


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), node (the set's fingerprint), signature and parity."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, nodes, minima, parities = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), words)
                sizes.append(len(s))
                nodes.append(fingerprint(s))
                minima.append(signature(s))
                parities.append(parity(s))
            lists = [pa.ListArray.from_arrays(np.arange(0, len(x) * k + 1, k, "int32"), np.concatenate([np.zeros(0, kind), *x])) for x, k, kind in ((minima, COORDINATES, "int32"), (parities, _LONGS, "int64"))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), *lists], names=["doc_id", "n", "node", "signature", "parity"])

    return source.mapInArrow(run, _SKETCH.format(source.schema["doc_id"].dataType.simpleString()))


def _token(family: Column, at: Column, minimum: Column) -> Column:
    """Family, coordinate and minimum as one long."""
    return F.shiftleft((family * 64 + at).cast("long"), 32) + minimum


def _coordinate(token: Column) -> Column:
    return F.shiftright(token + (1 << 31), 32) % 64


def post(nodes: DataFrame, percent: int) -> DataFrame:
    """A row per node and family that it is posted in: the node's columns, class (of size), prefix (the
    coordinates it is posted under; mask as bits) and weight (how central it is)."""
    step = float(np.log(100 / percent))
    classed = nodes.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step).cast("int") + 1)
    families = classed.select("node", "signature", F.explode(F.array(F.col("class") - 1, F.col("class"))).alias("family"))
    tokens = families.select("node", "family", F.posexplode("signature").alias("at", "minimum")).select("node", _token(F.col("family"), F.col("at"), F.col("minimum")).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    # what a node's row says of its tokens, but for the minima, which it knows: frequency and coordinate in one long
    told = tokens.join(shared, "token").select("node", F.shiftright(F.col("token") + (1 << 31), 38).cast("int").alias("family"), (F.col("freq") * 64 + _coordinate(F.col("token"))).alias("t"))
    own = told.groupBy("node", "family").agg(F.sort_array(F.collect_list("t")).alias("t")).where(F.size("t") >= MATCH)  # at most COORDINATES
    unshared = F.lit(COORDINATES) - F.size("t")
    prefix = F.transform(F.slice("t", F.lit(1), F.greatest(F.lit(COORDINATES - MATCH + 1) - unshared, F.lit(0))), lambda x: (x % 64).cast("int"))
    weight = F.aggregate("t", F.lit(0.0), lambda a, x: a + F.log(F.floor(x / 64).cast("double")))
    own = own.select(F.col("node").alias("_own"), "family", prefix.alias("prefix"), weight.alias("weight"))
    mask = F.aggregate("prefix", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x)))
    parities = [F.get("parity", F.lit(k)).alias(f"b{k}") for k in range(_LONGS)]
    posted = classed.join(own, F.col("node") == F.col("_own"))
    return posted.select("node", "doc_id", "n", "signature", "class", "family", "prefix", mask.alias("mask"), "weight", *parities)


def _postings(posted: DataFrame, *columns: str) -> DataFrame:
    """token and ``columns``: a row for each coordinate that a node is posted under."""
    rows = posted.select("family", "signature", F.explode("prefix").alias("at"), *columns)
    return rows.select(_token(F.col("family"), F.col("at"), F.get("signature", F.col("at"))).alias("token"), *columns)


#: What two nodes are compared by before their full sets: columns, so that the join compiles to few instructions.
_LOOK = ["n", *(f"b{k}" for k in range(_LONGS))]


def _named(prefix: str, columns: list[str], source: str = "") -> list[Column]:
    return [F.col(source + c).alias(prefix + c) for c in columns]


def _alike(percent: int) -> Column:
    """Sizes and odd sketches (columns n, b0 ... of one side, x_n, x_b0 ... of the other) allow the similarity."""
    differing = reduce(lambda a, k: a + F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"x_b{k}"))), range(1, _LONGS), F.bit_count(F.col("b0").bitwiseXOR(F.col("x_b0"))))
    most = F.expr(f"({100 - percent} * (n + x_n)) div {100 + percent}")  # shingles that only one of them has
    share = (1 - F.pow(F.lit(1 - 2 / _BUCKETS), most)) / 2
    likely = _BUCKETS * share + 5 * F.sqrt(_BUCKETS * share * (1 - share)) + 1
    return (100 * F.least("n", "x_n") >= percent * F.greatest("n", "x_n")) & (differing <= F.least(most, likely))


def hub_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b) with b the hub of a list of a; only keys move, until pairs are few."""
    postings = _postings(posted, "weight", "node", "n")
    hubs = postings.groupBy("token").agg(F.max(F.struct("weight", "node", "n")).alias("h")).select("token", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    sized = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    met = postings.join(hubs, "token").where((F.col("node") != F.col("hub")) & sized).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    looks = posted.select("node", *_LOOK).distinct()
    left = looks.select(F.col("node").alias("a"), *_named("", _LOOK))
    right = looks.select(F.col("node").alias("b"), *_named("x_", _LOOK))
    return met.join(left, "a").join(right, "b").where(_alike(percent)).select("a", "b")


def open_rows(posted: DataFrame, components: DataFrame) -> DataFrame:
    """Postings of the lists that hold several components, with ``component``, the list's ``largest``
    and its numbers of rows outside that one (``few``) and in all (``rows``).

    A family's pairs have a node of its lower class, so lists without one have none."""
    labels = components.select(F.col("node").alias("_own"), "component")
    own = posted.join(labels, F.col("node") == F.col("_own"), "left").select("node", "signature", "family", "prefix", (F.col("class") == F.col("family")).alias("low"), F.coalesce("component", "node").alias("component"))
    postings = _postings(own, "node", "low", "component")
    parts = postings.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"), F.max("low").alias("low"))
    lists = parts.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("rows"), F.max(F.struct("size", "component")).alias("m"), F.max("low").alias("low")).where("parts > 1 and low")
    lists = lists.select("token", "rows", (F.col("rows") - F.col("m.size")).alias("few"), F.col("m.component").alias("largest"))
    found = postings.drop("low").join(lists, "token").withColumn("family", F.shiftright(F.col("token") + (1 << 31), 38).cast("int"))
    return found.join(posted.select("node", "family", "class", "signature", "mask", *_LOOK), ["node", "family"])


def open_pairs(rows: DataFrame, percent: int, few: int = 1024, many: int = 8192) -> DataFrame:
    """(a, b) of one list and of different components, but for pairs within a list's largest one.

    A list is dealt over blocks: ``few`` of the nodes outside its largest component meet ``many``
    nodes in one. A pair that the sketches allow is counted in the family of its lower class, at the
    first coordinate only that both are posted under there, by probing the others.
    """
    x_blocks, y_blocks = F.ceil(F.col("few") / few).cast("int"), F.ceil(F.col("rows") / many).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = [*_LOOK, "node", "class", "signature", "mask", "component"]
    x = rows.where("component != largest").withColumn("x_block", place(x_blocks)).withColumn("y_block", blocks(y_blocks)).select("token", "x_block", "y_block", *_named("x_", held))
    y = rows.withColumn("y_block", place(y_blocks)).withColumn("x_block", blocks(x_blocks)).select("token", "family", "x_block", "y_block", *held, "largest")
    apart = (F.col("component") != F.col("x_component")) & ((F.col("component") == F.col("largest")) | (F.col("x_node") < F.col("node")))
    same = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda k: F.get("signature", k) == F.get("x_signature", k))
    both = F.col("mask").bitwiseAND(F.col("x_mask"))
    first = F.array_min(F.filter(same, lambda k: F.call_function("shiftright", both, k) % 2 != 0)) == _coordinate(F.col("token"))
    return x.join(y, ["token", "x_block", "y_block"]).where(apart & (F.least("class", "x_class") == F.col("family")) & _alike(percent) & (F.size(same) >= MATCH) & first).select(F.col("node").alias("a"), F.col("x_node").alias("b"))


def load_sets(docs: DataFrame, posted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """node and shingles of the posted nodes, from their texts, in buckets of the node.

    Each node is read from the document that it names; a row with that id and another text is
    told by its fingerprint, and rows that repeat the text count once.
    """
    chosen = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")).join(posted.select(F.col("doc_id").alias("own"), "node").distinct().hint("shuffle_hash"), "own")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = set()  # rows that repeat an id come to one task
        for b in batches:
            rows, held = [], []
            for k, (text, node) in enumerate(zip(b.column(0), b.column(1).to_pylist())):
                if node in loaded:
                    continue
                own = shingle_set(text.as_py(), words)
                if fingerprint(own) == node:
                    loaded.add(node)
                    rows.append(k)
                    held.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(rows, pa.int64())), pa.array(held, pa.binary())], names=["node", "shingles"])

    return bucketed(chosen.select("text", "node").mapInArrow(load, "node binary, shingles binary"), "sets", "node")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, each: int = 256) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets.

    ``sets`` is bucketed by node, so only pairs move to meet the set of a. What a pair then
    carries moves once more, to b, whose set is sent only to the tasks that need it; a node in
    more than ``each`` pairs, such as the hub of a large group, is dealt over several.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    left = dealt.hint("shuffle_hash").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    right = parts.hint("shuffle_hash").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    faced = left.join(right, ["b", "part"]).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3)):
                s, r = (np.frombuffer(v.as_py(), "<u8") for v in (x, y))
                both = len(np.intersect1d(s, r, assume_unique=True))
                linked.append(100 * both >= percent * (len(s) + len(r) - both))
            kept = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(k).filter(kept) for k in (0, 1)], names=["a", "b"])

    return faced.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of ``edges`` (a, b).

    Each round hangs larger neighbours under a node's smallest neighbour (large star), then a node
    and its smaller neighbours under the smallest (small star), until only stars are left. A node's
    neighbours are only aggregated and joined, never gathered.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        else:
            both = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        moved = joined.where("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()

    def tangled(pairs: DataFrame) -> int:
        """Nodes that stand on both sides, or under several others: none when all pairs are stars."""
        sides = pairs.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(pairs.select("b", F.lit(0), F.lit(1)))
        held = sides.groupBy("node").agg(F.max("above").alias("above"), F.sum("below").alias("below"))
        return held.where("below > 1 or above = 1 and below = 1").count()

    state = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while tangled(state):
        state = written(star(star(state, True), False), "stars")
    return state.select(F.col("b").alias("node"), F.col("a").alias("component")).union(state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept per row.

    Rows with one id are one document: it is linked with what any of them is. A row without words
    has an empty set and is linked with nothing. A null id is linked with nothing: its component_id
    is null and it is kept. Other columns are ignored, whatever their names.
    """
    sketches = written(sketch(docs, words, id_col, text_col), "sketches")
    named = sketches.where("n > 0 and doc_id is not null")
    # what is taken of a node's rows is a function of the set, but for the smallest id
    nodes = written(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "signature", "parity"))), "nodes")
    posted = written(post(nodes, percent), "posted")
    sets = load_sets(docs, posted, words, id_col, text_col)

    found = written(components(confirm(written(hub_pairs(posted, percent), "met"), sets, percent)), "components")
    last = confirm(written(open_pairs(written(open_rows(posted, found), "open"), percent), "met"), sets, percent)
    # different texts under one id are one document
    same_id = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select(F.col("doc_id").alias("_id"), "a")
    same_id = named.join(same_id, F.col("doc_id") == F.col("_id")).select("a", F.col("node").alias("b"))
    label = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).union(last).union(same_id))

    inside = nodes.select("node", "doc_id").join(label.withColumnRenamed("node", "_own"), F.col("node") == F.col("_own"), "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = inside.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = inside.join(least, "component").select(F.col("node").alias("_own"), "component_id")
    by_id = named.join(placed, F.col("node") == F.col("_own")).groupBy("doc_id").agg(F.min("component_id").alias("component_id")).withColumnRenamed("doc_id", "_id")
    rows = sketches.select("doc_id", F.col("n").alias("n_shingles"), "node").join(by_id, F.col("doc_id") == F.col("_id"), "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
