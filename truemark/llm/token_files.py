"""Token ids in binary files: patched frame-of-reference blocks.

Documents are range-sorted by id, tokenized where they arrive and written by Spark's own committer, a
file a range, on any file system that Spark reaches. So texts move once and ids never. A file is a run of records, each of whole documents and of about
``RECORD_IDS`` ids. A record's ids, in blocks of 128, are stored less the block's smallest id in as
many bits as hold all but the largest tenth; of ids that don't fit, the low bits stay in the block
and place and high bits go to an exception list. An index gives each block's base, width, first word
and first exception, so that any range of ids is read without the blocks before it. Reading back
takes the files alone.

A record is, in order, little-endian: ``HEADER``; for each block base (u4), width (u1); for each
block and one more, first word (u4) and first exception (u4); words (u8); exceptions' places (u1) and
high bits (u2 or u4, by ``high``); for each document its id (i8), whether the id is null (u1), and number of ids (i8).
Records end with a line feed, as Spark's writer of text files puts one behind each row.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from truemark.llm.common import shared_dir, worker_cache, written
from truemark.llm.packing import _byte_letters as byte_letters

BLOCK, RECORD_IDS, FILE_BYTES = 128, 1 << 20, 12 << 20
HEADER = np.dtype([("magic", "S4"), ("part", "<i4"), ("first", "<i8"), ("ids", "<i8"), ("documents", "<i8"), ("blocks", "<u4"), ("words", "<u4"), ("exceptions", "<u4"), ("high", "u1")])
_MAGIC = b"PFOR"

# ------------------------------------------------------------------------------- blocks


def _widths(values: np.ndarray, share: float) -> np.ndarray:
    """Bits of each block's value at the percentile ``share``."""
    at = max(0, int(np.ceil(share * BLOCK)) - 1)
    middle = np.partition(values, at, axis=1)[:, at]
    return np.ceil(np.log2(middle.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as ``width`` words each."""
    words = np.zeros((len(values), width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return words


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    values, mask = np.zeros((len(words), 64), np.uint64), np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        values[:, i] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            values[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
        values[:, i] &= mask
    return values


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> tuple[np.ndarray, ...]:
    """(bases, widths, word starts, exception starts, words, places, high bits) of any number of ids below 2**32."""
    blocks = -(-len(ids) // BLOCK)
    full = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint64)
    full[: len(ids)] = ids
    values = full.reshape(blocks, BLOCK)
    bases = values.min(axis=1) if blocks else np.zeros(0, np.uint64)
    values = values - bases[:, None]
    widths = _widths(values, share) if blocks else np.zeros(0, np.uint8)
    high = values >> widths[:, None].astype(np.uint64)
    where, places = np.nonzero(high)
    word_starts = np.concatenate([[0], np.cumsum(2 * widths.astype(np.int64))])
    exception_starts = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=blocks))])
    words = np.zeros(word_starts[-1], np.uint64)
    for width in np.unique(widths):
        if width:
            own = np.flatnonzero(widths == width)
            low = values[own] & np.uint64((1 << int(width)) - 1)
            words[word_starts[own][:, None] + np.arange(2 * int(width))] = _pack(low.reshape(-1, 64), int(width)).reshape(len(own), -1)
    return bases.astype("<u4"), widths, word_starts.astype("<u4"), exception_starts.astype("<u4"), words, places.astype(np.uint8), high[where, places].astype("<u4" if high.max(initial=0) >> np.uint64(16) else "<u2")


def decode_blocks(bases: np.ndarray, widths: np.ndarray, word_starts: np.ndarray, exception_starts: np.ndarray, words: np.ndarray, places: np.ndarray, high: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the blocks ``first`` to ``last`` (excluded), by the index alone."""
    last = len(bases) if last is None else last
    values = np.zeros((last - first, BLOCK), np.uint64)
    for width in np.unique(widths[first:last]):
        if width:
            own = first + np.flatnonzero(widths[first:last] == width)
            packed = words[word_starts[own].astype(np.int64)[:, None] + np.arange(2 * int(width))]
            values[own - first] = _unpack(packed.reshape(-1, int(width)), int(width)).reshape(len(own), BLOCK)
    a, b = int(exception_starts[first]), int(exception_starts[last])
    block = np.repeat(np.arange(last - first), np.diff(exception_starts[first : last + 1].astype(np.int64)))
    values[block, places[a:b]] |= high[a:b].astype(np.uint64) << widths[first + block].astype(np.uint64)
    return (values + bases[first:last].astype(np.uint64)[:, None]).astype("<u4").reshape(-1)


# ------------------------------------------------------------------------------- records


def encode_record(part: int, first: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One record; ``first`` is the number of ids before it in its file."""
    made = encode_blocks(ids)
    bases, _, _, _, words, places, high = made
    head = np.array([(_MAGIC, part, first, len(ids), len(doc_ids), len(bases), len(words), len(places), high.itemsize)], HEADER)
    names, nulls = np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(a.tobytes() for a in (head, *made, names, nulls, np.asarray(lengths, "<i8")))


class Record:
    """A record in ``raw`` from byte ``at``; ``end`` is the byte behind it."""

    def __init__(self, raw: bytes | memoryview, at: int = 0):
        head = np.frombuffer(raw, HEADER, 1, at)[0]
        if head["magic"] != _MAGIC:
            raise ValueError(f"no record of token ids at byte {at}")
        self.part, self.first, self.n = int(head["part"]), int(head["first"]), int(head["ids"])
        blocks, self.end = int(head["blocks"]), at + HEADER.itemsize

        def take(kind: str, n: int) -> np.ndarray:
            found = np.frombuffer(raw, kind, n, self.end)
            self.end += found.nbytes
            return found

        self.blocks = (take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1), take("<u4", blocks + 1), take("<u8", int(head["words"])), take("u1", int(head["exceptions"])), take(f"<u{head['high']}", int(head["exceptions"])))
        documents = int(head["documents"])
        self.doc_ids, self.null, self.lengths = take("<i8", documents), take("u1", documents), take("<i8", documents)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` (excluded) of the record; only their blocks are unpacked."""
        stop = self.n if stop is None else min(stop, self.n)
        if stop <= start:
            return np.zeros(0, "<u4")
        block = start // BLOCK
        return decode_blocks(*self.blocks, block, -(-stop // BLOCK))[start - block * BLOCK : stop - block * BLOCK]


def records(raw: bytes) -> Iterator[Record]:
    """The records of a file."""
    at = 0
    while at < len(raw):
        found = Record(raw, at)
        yield found
        at = found.end + 1  # the line feed


# ------------------------------------------------------------------------------- tokens

_CACHED = 800_000
#: A space before a sign that is no white space begins a pre-token whatever stands before it.
_CUT = re.compile(r" (?=\S)")
#: Letters are a pre-token, with a space before them if there is one, and signs behind them another.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*&%$#()/+=@-]*)")


class _Joined(Exception):
    """A text has white space behind a space, where it must not be cut."""


class ByteTokens(dict):
    """Token ids of texts, as little-endian unsigned bytes of the numpy ``kind``.

    The vocabulary's pre-tokens never run over a space that stands before a sign, so a text's ids
    are those of its chunks from one such space to the next, in order; chunks come again and again.
    Keys are chunks without the space before them; ``bare`` holds pieces that have none. A single
    line feed between signs is a pre-token of its own, so such a chunk is that of its lines. Letters
    and plain signs go to the merge model itself, all else through the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int = 0):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), byte_letters()
        self.model = self.tokenizer.model
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        self.packed = {n: struct.Struct(f"<{n}{'H' if self.kind == '<u2' else 'I'}").pack for n in range(1, 9)}
        self.bare: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        pack = self.packed.get(len(ids))
        return pack(*ids) if pack else np.asarray(ids, self.kind).tobytes()

    def _merged(self, pretoken: str) -> bytes:
        mapped = pretoken.replace(" ", self.letters[32]) if pretoken.isascii() else "".join([self.letters[b] for b in pretoken.encode()])
        return self._bytes([t.id for t in self.model.tokenize(mapped)])

    def _encoded(self, piece: str) -> bytes:
        return self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """A piece that no space stands before."""
        found = self.bare.get(piece)
        if found is None:
            plain = _PLAIN.fullmatch(piece)
            found = (self._merged(plain[1]) + (self._piece(plain[2]) if plain[2] else b"")) if plain else self._encoded(piece)
            if len(self.bare) < _CACHED and len(piece) < 64:
                self.bare[piece] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Joined
        if plain := _PLAIN.fullmatch(chunk):
            found = self[plain[1]] + self._piece(plain[2]) if plain[2] else self._merged(" " + chunk)
        elif len(lines := chunk.split("\n")) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            return self._piece("\n").join([self[lines[0]], *map(self._piece, lines[1:])])
        else:
            found = self._encoded(" " + chunk)
        if len(self) < _CACHED and len(chunk) < 64:
            self[chunk] = found
        return found

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        first, *more = text.split(" ")
        try:
            return (self._piece(first) if first else b"") + b"".join(map(self.__getitem__, more)) if first or more[0] else self._cut(text)
        except _Joined:
            return self._cut(text)

    def _cut(self, text: str) -> bytes:
        first, *more = _CUT.split(text)
        return (self._piece(first) if first else b"") + b"".join(map(self.__getitem__, more))


# ------------------------------------------------------------------------------- files


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write ``docs`` under ``path``, ascending by id, nulls last; each document ends with ``end_id``.

    Rows of one id stand by a hash of their text. Ranges are cut over (id, hash, row), so rows of
    one id, however many, are spread over files. A file holds about ``file_bytes`` of text.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    row = source.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("row")]
    ranged = row.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_cache(("byte tokens", tokenizer, end_id), lambda: ByteTokens(tokenizer, end_id))
        end = np.asarray([end_id], tokens.kind).tobytes()
        names: list[int | None] = []
        held: list[np.ndarray] = []
        part, first, size = 0, 0, 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([encode_record(part, first, names, [len(x) for x in held], np.concatenate(held))], pa.binary())], names=["record"])
        for batch in batches:
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                names.append(doc)
                held.append(np.frombuffer(tokens.text(text.as_py() or "") + end, tokens.kind))
                size, part = size + len(held[-1]), own
                if size >= RECORD_IDS:
                    yield made()
                    names, held, first, size = [], [], first + size, 0
        if held:
            yield made()

    packed = ranged.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(pack, "record binary")
    packed.select(F.col("record").cast("string").alias("value")).write.text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, first (ids before it in its file), n_tokens and ids_crc32 of each document in the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for r in records(raw.as_buffer()):
                    ids, ends = r.ids(), np.cumsum(r.lengths)
                    begins = ends - r.lengths
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, mask=r.null.astype(bool)), pa.array(np.full(len(ends), r.part, np.int32)), pa.array(r.first + begins), pa.array(r.lengths), pa.array(crcs, pa.int64())], names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(decode, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """part, at and ids (array) of the ids ``start`` to ``stop`` (excluded) of each file: what a training job cuts from one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for r in records(raw.as_buffer()):
                    a, b = max(start - r.first, 0), min(stop - r.first, r.n)
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([r.part], pa.int32()), pa.array([r.first + a], pa.int64()), pa.array([r.ids(a, b).astype(np.int64)], pa.list_(pa.int64()))], names=["part", "at", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(cut, "part int, at long, ids array<long>")


def document_index(found: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from ``read_files``.

    What a file adds is one row a file; the running sum over files is in two levels, so that no task
    holds them all. Spark knows the written sums' size and sends them to all tasks if they are small.
    """
    found = written(found, "token-index")
    files = found.groupBy("part").agg(F.sum("n_tokens").alias("own")).withColumn("group", F.floor(F.col("part") / 1024))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = files.groupBy("group").agg(F.sum("own").alias("all")).select("group", F.coalesce(F.sum("all").over(before(F.lit(0)).orderBy("group")), F.lit(0)).alias("earlier"))
    within = files.select("part", "group", F.coalesce(F.sum("own").over(before("group").orderBy("part")), F.lit(0)).alias("inside"))
    base = written(within.join(groups, "group").select(F.col("part").alias("_part"), (F.col("earlier") + F.col("inside")).alias("base")), "token-files")
    return found.join(base, F.col("part") == F.col("_part")).select("doc_id", (F.col("base") + F.col("first")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def store_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` as token files under ``path`` (by default in the shared folder) and return what
    the files hold: doc_id, start, n_tokens and ids_crc32 of each document.

    A null or empty text has the end id alone. Ids are whole numbers; null ids stand last; rows that
    repeat an id are documents of their own, by a hash of their text. A document is never cut, so
    a very long text makes a record as long. Other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer, end_id, id_col, text_col, file_bytes)
    return document_index(read_files(spark, path))
