"""Mergeable distinct counts: an inexact check ahead of the uniqueness rules.

A sketch per logical partition and version holds the keys that came in then. Sketches only grow, so
a version's sketch tells how many keys there have ever been up to it, not how many are left; where
the estimate is clearly below the rows that ever came, duplicates are certain and the exact rule
need not be asked whether, only how many.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truemark.functions.keys import partition_id, row_key
from truemark.functions.rules import RuleSet
from truemark.sources.versions import POSITIVE

#: Base-2 logarithm of a sketch's buckets, and its standard error.
LG_BUCKETS = 12
ERROR = 1.04 / math.sqrt(1 << LG_BUCKETS)


def key_sketches(base: DataFrame, feed: DataFrame, rules: RuleSet) -> DataFrame:
    """p, version, sketch and rows: the keys of the base (version 0) and of what each commit brought in."""
    columns = list(rules.key)
    came = feed.where(F.col("_change_type").isin(*POSITIVE)).select(*columns, F.col("_commit_version").cast("long").alias("version"))
    rows = base.select(*columns, F.lit(0).cast("long").alias("version")).unionByName(came)
    keyed = rows.select(partition_id().alias("p"), "version", row_key(rows, columns).alias("key"))
    return keyed.groupBy("p", "version").agg(F.hll_sketch_agg("key", F.lit(LG_BUCKETS)).alias("sketch"), F.count(F.lit(1)).alias("rows"))


def distinct_by_version(sketches: DataFrame, last: int) -> DataFrame:
    """version, estimate (keys ever seen up to it) and rows, from sketches merged over partitions and versions."""
    versions = sketches.sparkSession.range(last + 1).withColumnRenamed("id", "at")
    upto = sketches.join(F.broadcast(versions), F.col("version") <= F.col("at"))  # a row a version
    merged = upto.groupBy("at").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.sum("rows").alias("rows"))
    return merged.select(F.col("at").alias("version"), "estimate", "rows")


def exact_by_version(base: DataFrame, feed: DataFrame, rules: RuleSet, last: int) -> DataFrame:
    """version and exact_distinct: the keys ever seen up to it, counted."""
    columns = list(rules.key)
    came = feed.where(F.col("_change_type").isin(*POSITIVE)).select(*columns, F.col("_commit_version").cast("long").alias("version"))
    first = base.select(*columns, F.lit(0).cast("long").alias("version")).unionByName(came).groupBy(*columns).agg(F.min("version").alias("version"))
    new = first.groupBy("version").agg(F.count(F.lit(1)).alias("new"))
    order = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)  # a row a version
    filled = base.sparkSession.range(last + 1).withColumnRenamed("id", "version").join(new, "version", "left")
    return filled.select("version", F.sum(F.coalesce("new", F.lit(0))).over(order).alias("exact_distinct"))
