"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table of (h1, h2, docs, first): the 128-bit hash of a line's key, the number of
documents that hold it and the first of their ids (as text), dealt and sorted by hash. Runs live in levels. When a level holds
``fanout`` runs they are merged into one run of the next level, so a key is rewritten once a
level and a lookup reads few runs. A batch of documents merges with the runs by hash: an anti-join
leaves out the keys that the runs already condemn, and what is left is added as the batch's own run.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truemark.llm.common import columns, fresh, room_for, shared_dir, worker_cache, written

_HASHES = "h1 long, h2 long"
_RUN = f"{_HASHES}, docs long, first string"


def line_keys(text: str | None, min_chars: int) -> list[bytes]:
    """The 16-byte hash of each line's key, in order; b'' for keys that are too short to judge."""
    keys = [x.strip(b" \t\n\x0b\x0c\r") for x in (text or "").encode().lower().split(b"\n")]
    return [xxhash.xxh3_128_digest(k) if len(k) >= min_chars and len(k.decode()) >= min_chars else b"" for k in keys]


def document_keys(docs: DataFrame, text_col: str, min_chars: int, *tags: str) -> DataFrame:
    """The distinct (h1, h2) of each document, with the columns ``tags`` of its row."""
    source = docs.select(*tags, F.col(text_col).alias("_text"))
    n = len(tags)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None, dict)  # what another operator left in this worker goes
        for batch in batches:
            found = [{h for h in line_keys(x.as_py(), min_chars) if h} for x in batch.column(n)]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            halves = np.frombuffer(b"".join(b"".join(x) for x in found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(n)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=[*tags, "h1", "h2"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:n])
    return source.mapInArrow(keys, kinds + _HASHES)


def _summed() -> tuple[Column, Column]:
    return F.sum("docs").alias("docs"), F.min("first").alias("first")


def _counted(id_col: str) -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("docs"), F.min(F.col(id_col).cast("string")).alias("first")


@dataclass
class LineRuns:
    """Levelled runs under one folder that all executors share."""

    spark: SparkSession
    path: str
    fanout: int = 4
    levels: dict[int, list[str]] = field(default_factory=dict)
    made: int = 0

    def _name(self, level: int) -> str:
        self.made += 1
        return f"{self.path}/level-{level}/run-{self.made:06d}"

    def _read(self, paths: list[str]) -> DataFrame:
        frames = [self.spark.read.schema(_RUN).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], _RUN)

    def add(self, counts: DataFrame) -> None:
        """Add one batch's (h1, h2, docs) as a run of level 0 and compact full levels."""
        name = self._name(0)
        counts.sortWithinPartitions("h1", "h2").write.parquet(name)
        self.levels.setdefault(0, []).append(name)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            name, full = self._name(level + 1), self.levels.pop(level)
            merged = self._read(full).groupBy("h1", "h2").agg(*_summed())
            merged.sortWithinPartitions("h1", "h2").write.parquet(name)
            self.levels.setdefault(level + 1, []).append(name)
            level += 1

    def totals(self) -> DataFrame:
        """(h1, h2, docs) over all runs."""
        runs = [p for level in sorted(self.levels) for p in self.levels[level]]
        found = self._read(runs)
        return found if len(runs) <= 1 else found.groupBy("h1", "h2").agg(*_summed())


def _thin(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))


def ingest_counts(runs: LineRuns, counts: DataFrame, min_docs: int) -> None:
    """One batch's (h1, h2, docs, first): those that ``min_docs`` documents of earlier batches hold
    already are known to go and need no more counting; the others are added as a run."""
    known = runs.totals().where(F.col("docs") >= min_docs).select("h1", "h2")
    runs.add(counts.join(known, ["h1", "h2"], "left_anti"))


def count_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 1, min_docs: int = 10, batches: int = 4, fanout: int = 3) -> LineRuns:
    """Runs that tell which line keys of ``docs`` occur in ``min_docs`` documents (rows) or more.

    The documents are dealt to ``batches`` by a hash of their ids. All batches' keys are counted in
    one job; then batch after batch meets the runs, as new documents would.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}", fanout)
    tagged = _thin(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("_id", F.length("_body")), F.lit(batches)).cast("int"))
    keys = document_keys(tagged, "_body", min_chars, "batch", "_id")
    counts = written(keys.groupBy("batch", "h1", "h2").agg(*_counted("_id")), "line-counts", "batch")
    for b in range(batches):
        ingest_counts(runs, counts.where(F.col("batch") == b).select("h1", "h2", "docs", "first"), min_docs)
    return runs


def strip_lines(docs: DataFrame, dropped: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with n_lines, n_dropped and the text left after lines with a key in ``dropped`` went.

    The merge join runs on hashes: each document's keys meet ``dropped`` (distinct h1, h2, first),
    and only the matches go back to the document, as a list no longer than its own lines. With
    ``keep_first`` the document with a key's first id keeps its lines. A list belongs to an id and a
    text, so that rows without an id, or with a repeated one, have lists of their own, and only rows
    alike in both share one.
    """
    docs = room_for(docs, ["n_lines", "n_dropped"], text_col, id_col)
    digest = lambda text: F.xxhash64(F.coalesce(text, F.lit("")))
    keys = document_keys(_thin(docs, id_col, text_col).withColumn("_text_hash", digest(F.col("_body"))), "_body", min_chars, "_id", "_text_hash")
    hits = keys.alias("k").join(dropped.select("h1", "h2", "first").alias("d"), (F.col("k.h1") == F.col("d.h1")) & (F.col("k.h2") == F.col("d.h2")))
    if keep_first:
        hits = hits.where(~F.col("_id").cast("string").eqNullSafe(F.col("first")))
    hit_id, hit_text, found = fresh(docs, "_hit_id"), fresh(docs, "_hit_text"), fresh(docs, "_hits")
    lists = hits.select("_id", "_text_hash", "k.h1", "k.h2").groupBy(F.col("_id").alias(hit_id), F.col("_text_hash").alias(hit_text)).agg(F.collect_set(F.struct("h1", "h2")).alias(found))
    joined = docs.join(lists.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col(hit_id)) & (digest(docs[text_col]) == F.col(hit_text)), "left")
    source = joined.select(*columns(docs), found)
    names, at, n = docs.columns, docs.columns.index(text_col), len(docs.columns)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, gone = [], [], []
            for text, hits in zip(batch.column(at), batch.column(n)):
                own = text.as_py() or ""
                parts = own.split("\n")
                lost = 0
                if hits.is_valid:
                    drop = {np.asarray([h["h1"], h["h2"]], "<i8").tobytes() for h in hits.as_py()}
                    left = [p for p, k in zip(parts, line_keys(own, min_chars)) if k not in drop]
                    lost, own = len(parts) - len(left), "\n".join(left)
                texts.append(own)
                lines.append(len(parts))
                gone.append(lost)
            out = list(batch.columns[:n])
            out[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*out, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return source.mapInArrow(strip, T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", id_col: str = "doc_id", keep_first: bool = False) -> DataFrame:
    """Drop, in every document (but a key's first, with ``keep_first``), all lines whose key at least ``min_docs`` documents hold.

    Returns the columns of ``docs`` with the remaining text, n_lines and n_dropped; columns of
    these names are replaced. A null or empty text is one empty line, whose key is too short to
    drop; it comes back as ''. Repeated rows count as documents of their own. A null id is an id
    like any other. An empty table gives an empty result. A key's first document is the one with
    the smallest id (as text) of those that were counted before the key was known to go.
    """
    often = count_lines(docs, text_col, id_col, min_chars, min_docs).totals().where(F.col("docs") >= min_docs)
    return strip_lines(docs, written(often, "frequent-lines"), text_col, id_col, min_chars, keep_first)


def ingest(runs: LineRuns, batch: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """Incremental use: strip from ``batch`` every line that an earlier batch held, then add its run.

    The result is written before the runs change, so that it doesn't depend on later batches.
    """
    left = written(strip_lines(batch, runs.totals(), text_col, id_col, min_chars), "ingested")
    runs.add(document_keys(_thin(batch, id_col, text_col), "_body", min_chars, "_id").groupBy("h1", "h2").agg(*_counted("_id")))
    return left
