"""Media columns: motion-JPEG in AVI, held as binary columns.

The payload bytes are the samples of grey frames, 64 wide and up to 16 high, one byte a sample.
Frames are intra coded by the lossless process of JPEG (SOF3, predictor 1, Huffman coded
differences) with a restart after each row, and stored as 00dc chunks of a RIFF AVI file with an
idx1 index. The decoder reads the index, takes each frame's tables from its own markers, and
decodes all rows of a batch of files side by side. Shots are found where the histogram of a frame
differs from the one before by more than the recent differences make likely.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, FPS = 64, 16, 10
_GROUP_BYTES = 1 << 21
_BINS = 16


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(height: int) -> bytes:
    """Markers of a frame: nine 4-bit codes for the categories 0 to 8, and a restart each row."""
    codes = bytes([0, 0, 0, 9, *[0] * 12, *range(9)])
    return b"".join([
        b"\xff\xd8",
        _segment(0xC4, b"\x00" + codes),
        _segment(0xC3, struct.pack(">BHHB", 8, height, WIDTH, 1) + bytes([1, 0x11, 0])),
        _segment(0xDD, struct.pack(">H", WIDTH)),
        _segment(0xDA, bytes([1, 1, 0, 1, 0, 0])),
    ])


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference -255 to 255: its code with the extra bits, and their number."""
    d = np.arange(-255, 256)
    category = np.array([int(abs(x)).bit_length() for x in d])
    extra = np.where(d > 0, d, d + (1 << category) - 1)
    return (category << category | extra).astype("uint32"), (category + 4).astype("int64")


_CODE, _BITS = _code_tables()


def _encode_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row (stuffed, without restart markers), and where rows end."""
    left = np.concatenate([np.full((len(rows), 1), 128, "int16"), rows[:, :-1].astype("int16")], axis=1)
    at = rows.astype("int16") - left + 255
    code, bits = _CODE[at], _BITS[at]
    ends = np.cumsum(bits, axis=1)
    total = ends[:, -1]
    size = (total + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    bit = (ends - bits) + 8 * start[:, None]
    word = code << (24 - bits - (bit & 7)).astype("uint32")
    index, n = (bit >> 3).ravel(), int(size.sum())
    out = np.zeros(n + 2)
    for k in range(3):
        out += np.bincount(index + k, weights=(word.ravel() >> (16 - 8 * k)) & 255, minlength=n + 2)
    data = out[:n].astype("uint8")
    data[start + size - 1] |= ((1 << (8 * size - total)) - 1).astype("uint8")  # ones fill the last byte
    full = np.flatnonzero(data == 255)
    row_end = start + size
    return np.insert(data, full + 1, 0), row_end + np.searchsorted(full, row_end)


def _riff(frames: list[bytes]) -> bytes:
    n = len(frames)
    chunks, index, at = [], [], 4
    for f in frames:
        pad = b"\0" * (len(f) & 1)
        chunks.append(b"00dc" + struct.pack("<I", len(f)) + f + pad)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(chunks[-1])
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4h", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index)))


def encode_files(payloads: list[bytes]) -> list[bytes]:
    """AVI files of the payloads; each length must be a positive multiple of the width."""
    rows = np.frombuffer(b"".join(payloads), "uint8").reshape(-1, WIDTH)
    data, ends = _encode_rows(rows)
    raw, ends, files, row, at = data.tobytes(), ends.tolist(), [], 0, 0
    for p in payloads:
        frames, left = [], len(p) // WIDTH
        while left:
            height = min(left, HEIGHT)
            parts = [_HEADS[height]]
            for k in range(height):
                parts.append(raw[at : ends[row]])
                parts.append(b"\xff\xd9" if k == height - 1 else bytes((0xFF, 0xD0 + k % 8)))
                at, row = ends[row], row + 1
            frames.append(b"".join(parts))
            left -= height
        files.append(_riff(frames))
    return files


_HEADS = {h: _frame_head(h) for h in range(1, HEIGHT + 1)}


def read_index(media: bytes) -> list[tuple[int, int]]:
    """(start, length) of each frame, by the idx1 index of a RIFF AVI file."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    at, movi, index = 12, 0, b""
    while at + 8 <= len(media):
        tag, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if tag == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif tag == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return [(movi + at + 8, size) for tag, _, at, size in struct.iter_unpack("<4sIII", index) if tag == b"00dc"]


def _read_head(frame: bytes) -> tuple[int, int, int, bytes]:
    """(start of the scan, height, width, Huffman table) of a lossless frame."""
    at, height, width, table = 2, 0, 0, b""
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC4:
            table = body[1:]
        elif marker == 0xC3:
            height, width = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDA:
            return at + 2 + size, height, width, table
        at += 2 + size


_lookups: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window of the stream: bits used by the next sample, and its difference."""
    if table not in _lookups:
        used, diff = np.zeros(1 << 16, "int64"), np.zeros(1 << 16, "int16")
        code, k = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                category = table[k]
                first = code << (16 - length)
                window = np.arange(first, first + (1 << (16 - length)))
                extra = (window >> (16 - length - category)) & ((1 << category) - 1)
                used[window] = length + category
                diff[window] = np.where(extra >> max(category - 1, 0) & 1, extra, extra - (1 << category) + 1) if category else 0
                code, k = code + 1, k + 1
            code <<= 1
        _lookups[table] = used, diff
    return _lookups[table]


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """The samples of each file's frames, one after the other, as rows of the frame width."""
    scans, rows_of, tables = [], [], set()
    for media in files:
        rows = 0
        for start, size in read_index(media):
            frame = media[start : start + size]
            scan, height, width, table = _read_head(frame)
            if width != WIDTH:
                raise ValueError("frame width")
            scans.append(frame[scan:])
            rows += height
            tables.add(table)
        rows_of.append(rows)
    if len(tables) != 1:
        raise ValueError("frames of a batch share one Huffman table")
    used, diff = _lookup(tables.pop())
    data = np.frombuffer(b"".join(scans) + b"\0\0\0", "uint8")
    marks = np.flatnonzero(data[:-1] == 255)
    after = data[marks + 1]
    stuffed, ends = marks[after == 0] + 1, marks[after >= 0xD0]
    starts = np.concatenate([[0], ends[:-1] + 2])
    starts = starts - np.searchsorted(stuffed, starts)
    data = np.delete(data, stuffed).astype("uint32")
    words = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    bit = starts.astype("int64") * 8
    out, value = np.empty((WIDTH, len(starts)), "uint8"), np.full(len(starts), 128, "int16")
    for k in range(WIDTH):
        window = words[bit >> 3] >> (8 - (bit & 7)).astype("uint32") & 0xFFFF
        value = value + diff[window]
        out[k] = value
        bit += used[window]
    samples = np.ascontiguousarray(out.T)
    return np.split(samples, np.cumsum(rows_of)[:-1])


def find_shots(histograms: np.ndarray, window: int = 8, deviations: float = 3.0, least: float = 0.15) -> list[int]:
    """First frames of the shots: 0, and each frame whose histogram differs from the last one by
    more than ``least`` and than mean plus ``deviations`` standard deviations of up to ``window``
    differences before it."""
    share = histograms / histograms.sum(axis=1, keepdims=True)
    steps = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, step in enumerate(steps):
        recent = steps[max(0, i - window) : i]
        likely = recent.mean() + deviations * recent.std() if len(recent) else 0.0
        if step > max(least, likely):
            cuts.append(i + 1)
    return cuts


def _describe(samples: np.ndarray) -> tuple[str, list[dict]]:
    frames = -(-len(samples) // HEIGHT)
    frame = np.repeat(np.arange(len(samples)) // HEIGHT, WIDTH)
    histograms = np.bincount(frame * _BINS + (samples.ravel() >> 4), minlength=frames * _BINS).reshape(frames, _BINS)
    cuts = find_shots(histograms)
    clips = [{"clip": i, "start_frame": a, "end_frame": b, "start_s": a / FPS, "end_s": b / FPS} for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], frames]))]
    return f"frames={frames};shots={len(cuts)};cuts={','.join(map(str, cuts[1:]))};hist={','.join(map(str, histograms.sum(axis=0)))}", clips


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about _GROUP_BYTES, so that a worker's arrays stay small."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= _GROUP_BYTES:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, filled with bytes 0 to a positive multiple
    of 64, as an AVI file. A null text is an empty one. Ids may be null or repeat; one row a row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(1)]
            for a, b in _groups([len(x) for x in texts]):
                files = encode_files([x.ljust(max(WIDTH, -(-len(x) // WIDTH) * WIDTH), b"\0") for x in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in texts[a:b]], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(encode, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) read back: digests of payload and file, feature, clips."""
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer()) for x in batch.column(2)]
            for a, b in _groups(sizes):
                files = [x.as_py() for x in batch.column(2).slice(a, b - a)]
                samples = decode_files(files)
                payloads, seen = [s.tobytes() for s in samples], [_describe(s) for s in samples]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array(sizes[a:b], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array([x[0] for x in seen]),
                    pa.array([x[1] for x in seen], clip),
                ], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,start_frame:int,end_frame:int,start_s:double,end_s:double>>")


def clip_rows(decoded: DataFrame) -> DataFrame:
    """One row per shot: doc_id, clip, start_frame, end_frame (exclusive), start_s, end_s."""
    return decoded.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
