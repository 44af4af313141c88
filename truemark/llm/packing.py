"""Packing documents into fixed windows by minimum bin slack.

A document longer than a window is cut into whole windows and a remainder, so its pieces follow
from the document alone and one tokenizing pass is enough. What is packed are counts of piece
lengths, a histogram of at most ``window`` entries however large the corpus is. For each window
the longest length left is placed first; a bitset subset-sum over the other lengths left finds
the largest sum that still fits, and the recorded bitsets are walked back to the counts that make
it. A pattern is used as often as the counts allow, so the number of patterns is bounded by the
number of lengths and not by the number of documents. Pieces then find their place by their rank
among the pieces of equal length, which is a distributed prefix sum over salted groups.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truemark.llm.common import spread, worker_cache, written

#: Letters for which lower case and composed form are plain, so that a run of them is one
#: pre-token of the vocabulary and can be given to its merge model directly.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]*)")
_CACHED = 900_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(kept))}
    return [chr(moved.get(b, b)) for b in range(256)]


class WordTokens(dict):
    """Token ids (little-endian unsigned 32-bit bytes) of the chunks between white space.

    The tokenizer drops white space, and no pre-token or merge crosses it, so a text's ids are
    those of its chunks in order. Chunks of plain letters and full stops go to the merge model
    itself; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.model = self.tokenizer.model

    def run(self, piece: str) -> bytes:
        found = self.get(piece)
        if found is None:
            mapped = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            found = np.asarray([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(self) < _CACHED:
                self[piece] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain:
            word, stops = plain[1].lower(), plain[2]
            return self.run(word) + self.run(stops) if stops else self.run(word)
        ids = np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < _CACHED:
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        for c in "\n\t\r":
            text = text.replace(c, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def _tokens(path: str) -> WordTokens:
    return worker_cache(("tokens", path), lambda: WordTokens(path))


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens.

    A null or empty text has the end id alone. Repeated rows give repeated pieces.
    """
    end, step = np.asarray([end_id], "<u4").tobytes(), 4 * window

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for batch in batches:
            ids, starts, lengths, crcs, totals = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = tokens.text(text.as_py() or "") + end
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    ids.append(doc)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def fill_window(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``counts`` whose sum comes closest to ``room`` from below.

    Lengths are taken in blocks of 1, 2, 4 ... copies; bit ``s`` of ``reach`` says that sum ``s``
    can be made of the blocks so far. The bitset before each block is kept and walked back.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length, n in sorted(counts.items(), key=lambda x: (-x[1], -x[0])):
        left, block = min(n, room // length), 1
        while left > 0:
            take = min(block, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, block = left - take, block * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[int, int, dict[int, int]]]:
    """(first sequence, number of sequences, lengths with multiplicities) until no piece is left."""
    left, plan, first = {k: v for k, v in histogram.items() if v > 0}, [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = {k: v for k, v in left.items() if v > 0 and k <= window - longest}
        pattern = fill_window(rest, window - longest) if rest else {}
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // v for k, v in pattern.items())
        for k, v in pattern.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
        plan.append((first, times, pattern))
        first += times
    return plan


def _places(plan: list[tuple[int, int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: rank from which a pattern holds, its first sequence, copies, and offset."""
    used: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for first, times, pattern in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            found.setdefault(length, []).append((used.get(length, 0), first, copies, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += copies * length
    return {k: tuple(np.asarray(v, "int64").T) for k, v in found.items()}


def pack(pieces: DataFrame, window: int) -> DataFrame:
    """Give each piece its sequence_id and offset; ``pieces`` is read twice, so write it first."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    places = _places(plan_windows(histogram, window))

    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(spread(spark))).cast("int")
    salted = pieces.withColumn("_salt", salt)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.join(counts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), "int64"), np.zeros(len(ranks), "int64")
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                starts, first, copies, base = places[int(length)]
                k = np.searchsorted(starts, ranks[at], "right") - 1
                turn = ranks[at] - starts[k]
                sequence[at] = first[k] + turn // copies[k]
                offset[at] = base[k] + turn % copies[k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack ``docs``. One row per piece; no token is dropped or repeated.

    Null and empty texts hold the end id only; null ids are kept; repeated rows are packed as
    often as they occur; other columns are ignored; an empty table gives an empty result.
    """
    return pack(written(cut_pieces(docs, tokenizer, end_id, window, id_col, text_col), "pieces"), window)
