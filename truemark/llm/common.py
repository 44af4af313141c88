"""Pieces that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truemark.sources.shared import bucketed, bucketed_at, shared_dir, written

__all__ = ["SPACE", "WORD", "bucketed", "bucketed_at", "columns", "fresh", "id_bucket", "room_for", "shared_dir", "spread", "table", "worker_cache", "written"]

#: ASCII white space, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def room_for(df: DataFrame, added: list[str], *used: str) -> DataFrame:
    """``df`` without the columns whose names (in any case) the operator adds: its own replace them.

    A column that the operator reads can't give way; that is an error before any job.
    """
    names = {a.lower() for a in added}
    if clash := [c for c in used if c.lower() in names]:
        raise ValueError(f"rename {', '.join(clash)}: the operator both reads and adds it")
    return df.select(*[c for c, name in zip(columns(df), df.columns) if name.lower() not in names])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it a name that no column of ``df`` has."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


_held: list = [None, None]


def worker_cache(owner: object, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between batches. Workers outlive a stage, so only the last owner's is held;
    the owner None holds nothing of worth and lets the last one's go."""
    if _held[0] != owner:
        _held[:] = [None, None]
        _held[:] = [owner, make()]
    return _held[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; null ids fall in bucket 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0))


def spread(spark: SparkSession) -> int:
    """Salts that split a hot group: as many as a shuffle has partitions, which grows with the cluster."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
