"""Language identification by compression.

Each language has a raw-content zstandard dictionary: a bounded sample of its labelled texts. A
text is cut into blocks, each block is compressed against each dictionary, and the language
whose blocks take the fewest bytes wins. Blocks are compressed apart, so that a long text can't
teach the compressor its own language and the dictionary goes on to decide. The margin between
the two smallest totals, relative to the smaller, gives the score and the rejection flag.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truemark.llm.common import room_for

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}]+")
_ready: dict[tuple, list[zstandard.ZstdCompressor]] = {}


def letters_only(text: str) -> str:
    """Lower-case letters with single spaces: what tells languages apart, without mark-up or case."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def learn_dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 400, letters_per_document: int = 150) -> dict[str, bytes]:
    """Raw dictionary content per language from a bounded sample.

    ``docs_per_language`` bounds the sample: distinct texts are kept by a hash at a rate that gives
    about twice that many, and the smallest hashes are used; a text counts once however often it
    is repeated. From each a slice of ``letters_per_document`` code points is cut at a place that
    its hash names, and every slice enters its dictionary whole.
    """
    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 30)).alias("h")).where("t is not null and l is not null and length(t) > 0")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a language
    if not sizes:
        return {}
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("l") == lang) & (F.col("h") < int(min(1.0, 2.0 * docs_per_language / max(1, n)) * (1 << 30))))
    # a slice long enough to cut from, not the whole text, goes to the driver
    start = F.col("h") % F.greatest(F.lit(1), F.length("t") - letters_per_document)
    sample = rows.where(keep).select("l", "h", F.expr("t").substr((start + 1).cast("int"), F.lit(letters_per_document)).alias("s"))
    sample = sample.groupBy("l", "h").agg(F.min("s").alias("s"))  # a text, however many copies it has
    taken: dict[str, list[tuple[int, str]]] = {lang: [] for lang in sizes}
    for r in sample.collect():
        taken[r["l"]].append((r["h"], r["s"]))
    return {lang: "".join(letters_only(s) for _, s in sorted(x)[:docs_per_language]).encode() for lang, x in sorted(taken.items()) if x}


def _compressors(dictionaries: dict[str, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    key = (level, *((k, hash(v)) for k, v in dictionaries.items()))
    if key not in _ready:
        _ready.clear()
        made = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _ready[key] = made
    return _ready[key]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", block_bytes: int = 1500, level: int = 6, min_margin: float = 0.02) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and rejected (the margin is narrow).

    Null texts and texts without a letter are 'und' with score 0 and are rejected. Ties go to the
    language first by name. Without any dictionary every text is 'und'. Repeated rows give equal
    results; columns of ``docs`` that have a name of the added ones are replaced.
    """
    docs = room_for(docs, ["lang_pred", "score", "margin", "rejected"], text_col)
    names, n, at = list(dictionaries), len(docs.columns), docs.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dictionaries, level) if names else []
        for batch in batches:
            langs, scores, margins = [], [], []
            for cell in batch.column(at):
                text = cell.as_py()
                if not names or not text or not _LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                    margins.append(0.0)
                    continue
                raw = letters_only(text).encode()
                blocks = [raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)]
                sizes = [sum(len(c.compress(b)) for b in blocks) for c in compressors]
                best = min(range(len(names)), key=sizes.__getitem__)
                second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
                margin = (second - sizes[best]) / sizes[best]
                langs.append(names[best])
                margins.append(margin)
                scores.append(1.0 - 0.5 * math.exp(-20.0 * margin))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array([m < min_margin for m in margins])], names=[*batch.schema.names, "lang_pred", "score", "margin", "rejected"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(label, T.StructType(docs.schema.fields + more))
