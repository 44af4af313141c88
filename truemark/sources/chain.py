"""States that are carried from commit to commit in folders.

``start`` writes the states of a base; ``advance`` takes the change rows of the next step and writes
what they change: an overlay of key frequencies, the buckets of the keys it holds, and the next
partition state and histogram. Buckets without a changed key keep their files.

A step may be run again after a failure at any point. The overlay is written first and found again
by a rerun, and holds final frequencies, so that laying it over buckets twice is laying it over
once. The partition state comes last: a step whose state is there is done, and running it again
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truemark.functions.rules import RuleSet
from truemark.operators import incremental as inc
from truemark.sources.shared import found, overwrite_folders, written


class Chain:
    def __init__(self, spark: SparkSession, root: str, rules: RuleSet, row_key: str):
        self.spark, self.root, self.rules, self.row_key = spark, root, rules, row_key

    def _at(self, what: str, step: int | None = None) -> str:
        return f"{self.root}/{what}" + ("" if step is None else f"/step={step}")

    def keys(self) -> DataFrame:
        """b, key columns and frequency after the last step. A bucket that was rewritten holds a
        marker of frequency 0, so that its folder is replaced even when its last key is gone."""
        return self.spark.read.parquet(self._at("keys")).where("frequency > 0")

    def state(self, step: int) -> DataFrame:
        return self.spark.read.parquet(self._at("state", step))

    def histogram(self, step: int) -> DataFrame:
        return self.spark.read.parquet(self._at("histogram", step))

    def overlay(self, step: int) -> DataFrame:
        return self.spark.read.parquet(self._at("overlay", step))

    def last_step(self) -> int:
        """The last step that is done."""
        return self.spark.read.parquet(self._at("state")).agg(F.max("step")).first()[0]

    def start(self, base: DataFrame) -> "Chain":
        """Step 0: the states of ``base``; done once."""
        if found(self.spark, self._at("state", 0)) is None:
            overwrite_folders(inc.key_frequency(base, self.rules), self._at("keys"), "b")
            inc.frequency_histogram(self.keys()).coalesce(1).write.mode("overwrite").parquet(self._at("histogram", 0))
            inc.partition_state(base, self.rules).coalesce(1).write.mode("overwrite").parquet(self._at("state", 0))  # a row a logical partition
        return self

    def advance(self, step: int, feed: DataFrame, end: Callable[[], DataFrame]) -> bool:
        """Carry the states from ``step`` - 1 over the change rows ``feed``; ``end`` gives the snapshot
        behind them, of which partitions that lost an extremum are read. False if it was done before."""
        if found(self.spark, self._at("state", step)) is not None:
            return False
        images, keys = written(inc.net_images(feed, self.row_key), "net-images"), self.keys()
        if found(self.spark, self._at("overlay", step)) is None:
            overlay = inc.key_overlay(keys, inc.key_delta(images, self.rules), self.rules)
            overlay.hint("rebalance").write.mode("overwrite").parquet(self._at("overlay", step))
        overlay = self.overlay(step)
        near = inc.in_buckets(keys, overlay)
        markers = overlay.select("b").distinct().select("b", *(F.lit(None).cast(overlay.schema[k].dataType).alias(k) for k in self.rules.key), F.lit(0).cast("long").alias("frequency"))
        overwrite_folders(written(inc.compacted(near, overlay, self.rules).unionByName(markers), "buckets"), self._at("keys"), "b")
        inc.moved_histogram(self.histogram(step - 1), overlay).coalesce(1).write.mode("overwrite").parquet(self._at("histogram", step))
        kept = inc.maintained_state(self.state(step - 1), images, end(), self.rules).where("R01 > 0")
        kept.coalesce(1).write.mode("overwrite").parquet(self._at("state", step))
        return True

    def uniqueness(self, step: int) -> DataFrame:
        return inc.histogram_metrics(self.histogram(step))
