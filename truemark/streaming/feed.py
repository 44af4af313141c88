"""Structured Streaming over the commit files of a saved change feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from truemark.functions.keys import partition_id
from truemark.functions.rules import RuleSet
from truemark.sources.chain import Chain
from truemark.sources.versions import POSITIVE


def stream(spark: SparkSession, changes: str, files_per_batch: int | None = None) -> DataFrame:
    """The change files under ``changes`` as they arrive."""
    reader = spark.readStream.schema(spark.read.parquet(changes).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(changes)


def streamed_deltas(spark: SparkSession, path: str, rules: RuleSet) -> DataFrame:
    """A streaming frame: signed R01 to R07 per logical partition over the commits that arrive.

    Every change row counts with its own sign, so images within a commit and over commits cancel
    and the sums equal those of net images. State is one row a logical partition.
    """
    signed = stream(spark, f"{path}/changes").withColumn("sign", F.when(F.col("_change_type").isin(*POSITIVE), 1).otherwise(-1))
    return signed.groupBy(partition_id().alias("p")).agg(*rules.counts(F.col("sign")))


def carry(chain: Chain, snapshot: Callable[[int], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: carry the chain's states one step. ``snapshot`` gives the table at a version.

    The step's number is the batch's, so a batch that Spark runs again after a failure finds its step
    done, or finishes it from what it left; either way states change once. A batch may hold several
    commits, or a part of one: counts and frequencies add up over any cut of the feed, and an extremum
    is read from the snapshot of the batch's last version wherever a removed row may have held it.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        last = batch.agg(F.max("_commit_version")).first()[0]
        chain.advance(batch_id + 1, batch, lambda: snapshot(last))

    return step


def maintain(spark: SparkSession, changes: str, chain: Chain, snapshot: Callable[[int], DataFrame], checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Start a query that carries ``chain`` over all change files there are, and ends."""
    writer = stream(spark, changes, files_per_batch).writeStream.foreachBatch(carry(chain, snapshot))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
