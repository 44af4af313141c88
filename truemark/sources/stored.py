"""Stored state of a versioned table: what an incremental run reads instead of the table.

The end snapshot is written by logical partition and the key frequencies by key bucket, so that a
recompute or a lookup reads the folders it needs alone; the feed is written by commit version; the
partition state and the histogram of key frequencies are small tables. Each is written once, its
rows dealt out by folder, so that a small folder is one file and a large one several.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from truemark.functions.keys import partition_id
from truemark.functions.rules import RuleSet
from truemark.operators.incremental import frequency_histogram, key_frequency, partition_state
from truemark.sources.files import fingerprint
from truemark.sources.shared import shared_dir, written
from truemark.sources.versions import Versions


@dataclass(frozen=True)
class Stored:
    """feed: changes of all commits; end: the last snapshot, with p; state, keys, histogram: of the base."""

    feed: DataFrame
    end: DataFrame
    state: DataFrame
    keys: DataFrame
    histogram: DataFrame


def by_folder(df: DataFrame, name: str, column: str) -> DataFrame:
    return written(df.hint("rebalance", column), name, column)


def adaptive_write(df: DataFrame, name: str, column: str, small: int = 10_000) -> DataFrame:
    """``df`` in one file if it has at most ``small`` rows, else in folders of ``column``.

    For overlays, which are mostly tiny. Whether there is a row too many is found by a probe that
    ends there, so nothing is counted or written twice.
    """
    tiny = df.limit(small + 1).count() <= small
    return written(df.coalesce(1), name) if tiny else by_folder(df, name, column)


_kept: dict[tuple[str, str, str], tuple[str, Stored]] = {}


def stored(spark: SparkSession, path: str, make: Callable[[], Versions], rules: RuleSet) -> Stored:
    """The stored state of the table whose base lies at ``path``, written at the first call of a
    session, and again when files there have changed."""
    place = (spark.sparkContext.applicationId, shared_dir(spark), path)
    now = fingerprint(spark, path)
    if place not in _kept or _kept[place][0] != now:
        t = make()
        base = t.snapshot(0)
        keys = by_folder(key_frequency(base, rules), "key-frequencies", "b")
        made = Stored(
            feed=written(t.changes(1, t.version), "feed", "_commit_version"),
            end=by_folder(t.snapshot().withColumn("p", partition_id()), "end", "p"),
            state=written(partition_state(base, rules).coalesce(1), "partition-state"),  # a row a logical partition
            keys=keys,
            histogram=written(frequency_histogram(keys).coalesce(1), "key-histogram"),  # a row a frequency
        )
        _kept[place] = (now, made)
    return _kept[place][1]
