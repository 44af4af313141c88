"""A table with versions: a base and one change feed per commit, all DataFrames.

DML is written as a Spark user writes it: a predicate filter, a conditional projection, a union, a
join for MERGE. Each commit also gives its change rows (insert, delete, update_preimage,
update_postimage). ``save`` writes the base and the feed as Parquet, the feed partitioned by commit
version, so that a range of versions is a pruned scan; ``load`` replays them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEGATIVE, POSITIVE = ("delete", "update_preimage"), ("insert", "update_postimage")


class Versions:
    def __init__(self, base: DataFrame, key: str):
        self.key, self.columns = key, base.columns
        self.snapshots: list[DataFrame] = [base]
        self.feed: list[DataFrame] = []
        self.operations: list[str] = ["LOAD"]

    @property
    def version(self) -> int:
        return len(self.snapshots) - 1

    def snapshot(self, version: int | None = None) -> DataFrame:
        return self.snapshots[self.version if version is None else version]

    def changes(self, first: int, last: int) -> DataFrame:
        """Change rows of the versions first to last, both included; an empty range has no rows."""
        parts = self.feed[max(first, 1) - 1 : last]
        empty = self.snapshots[0].limit(0).select("*", F.lit("").alias("_change_type"), F.lit(0).cast("long").alias("_commit_version"))
        return reduce(DataFrame.unionByName, parts) if parts else empty

    def _typed(self, rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(*self.columns, F.lit(kind).alias("_change_type"), F.lit(len(self.snapshots)).cast("long").alias("_commit_version"))

    def _commit(self, after: DataFrame, changes: list[DataFrame], operation: str) -> "Versions":
        self.feed.append(reduce(DataFrame.unionByName, changes))
        self.snapshots.append(after)
        self.operations.append(operation)
        return self

    def insert(self, rows: DataFrame) -> "Versions":
        rows = rows.select(*self.columns)
        return self._commit(self.snapshot().unionByName(rows), [self._typed(rows, "insert")], "INSERT")

    def delete(self, where: Column) -> "Versions":
        hit, now = F.coalesce(where, F.lit(False)), self.snapshot()
        return self._commit(now.where(~hit), [self._typed(now.where(hit), "delete")], "DELETE")

    def _changed(self, now: DataFrame, hit: Column, sets: dict[str, Column]) -> DataFrame:
        return now.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).cast(now.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in self.columns])

    def update(self, where: Column, sets: dict[str, Column], delete: Column | None = None) -> "Versions":
        """UPDATE, with a DELETE of other rows in the same commit where ``delete`` is given."""
        now, hit = self.snapshot(), F.coalesce(where, F.lit(False))
        gone = F.lit(False) if delete is None else F.coalesce(delete, F.lit(False)) & ~hit
        touched = now.where(hit)
        changes = [self._typed(touched, "update_preimage"), self._typed(self._changed(touched, F.lit(True), sets), "update_postimage")]
        if delete is not None:
            changes.append(self._typed(now.where(gone), "delete"))
        return self._commit(self._changed(now.where(~gone), hit, sets), changes, "UPDATE" if delete is None else "UPDATE_DELETE")

    def merge(self, source: DataFrame) -> "Versions":
        """MERGE on the key by the source's ``op``: DELETE and UPDATE of matches, INSERT of the others.

        A source with two rows for one key is refused when the result runs.
        """
        key, now = self.key, self.snapshot()
        twice = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
        checked = source.withColumn("_twice", twice).withColumn("op", F.when(F.col("_twice"), F.raise_error(F.lit("MERGE source matches a row twice"))).otherwise(F.col("op")))
        renamed = checked.select(F.col("op").alias("_op"), *[F.col(c).alias(f"_new_{c}") for c in self.columns])
        both = now.join(renamed, F.col(key) == F.col(f"_new_{key}"), "full")
        there = F.col(key).isNotNull()
        names = lambda *kinds: F.array(*(F.lit(k) for k in kinds))
        kinds = (
            F.when(there & (F.col("_op") == "UPDATE"), names("update_preimage", "update_postimage"))
            .when(there & (F.col("_op") == "DELETE"), names("delete"))
            .when(there, names("keep"))
            .when(F.col("_op") == "INSERT", names("insert"))
            .otherwise(F.array().cast("array<string>"))
        )
        images = both.withColumn("_kind", F.explode(kinds))
        fresh = F.col("_kind").isin("insert", "update_postimage")
        images = images.select(*[F.when(fresh, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in self.columns], "_kind")
        after = images.where(F.col("_kind").isin("keep", "insert", "update_postimage")).select(*self.columns)
        changes = images.where("_kind <> 'keep'").select(*self.columns, F.col("_kind").alias("_change_type"), F.lit(len(self.snapshots)).cast("long").alias("_commit_version"))
        return self._commit(after, [changes], "MERGE")

    def history(self) -> DataFrame:
        """version, operation, row_count and change_count of each commit: the base is counted once, the rest
        are running sums of the change rows."""
        spark, (n, grown) = self.snapshots[0].sparkSession, (F.count(F.lit(1)), F.col("_change_type"))
        feed = self.changes(1, self.version).groupBy(F.col("_commit_version").alias("version")).agg(n.alias("change_count"), (F.count_if(grown == "insert") - F.count_if(grown == "delete")).alias("more"))
        commits = spark.createDataFrame(list(enumerate(self.operations)), "version long, operation string")
        upto = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)  # a row a commit
        filled = commits.join(feed, "version", "left").crossJoin(self.snapshots[0].agg(n.alias("base")))  # one row
        return filled.select("version", "operation", (F.col("base") + F.sum(F.coalesce("more", F.lit(0))).over(upto)).alias("row_count"), F.coalesce("change_count", F.lit(0)).alias("change_count"))

    def save(self, path: str) -> None:
        """Write base and feed; a path that has a table already is refused."""
        self.snapshots[0].write.parquet(f"{path}/base")
        self.changes(1, self.version).write.partitionBy("_commit_version").parquet(f"{path}/changes")


def replay(spark: SparkSession, path: str, key: str, version: int) -> DataFrame:
    """The snapshot at ``version`` of a saved table: unchanged base rows and the last images of the others."""
    base = spark.read.parquet(f"{path}/base")
    feed = spark.read.parquet(f"{path}/changes").where(F.col("_commit_version") <= version)
    order = F.struct("_commit_version", F.col("_change_type").isin(*POSITIVE).cast("int"))
    last = feed.groupBy(F.col(key).alias("_changed")).agg(F.max_by(F.struct(*base.columns, "_change_type"), order).alias("r"))
    kept = base.join(last.select("_changed"), F.col(key) == F.col("_changed"), "left_anti")
    return kept.unionByName(last.where(F.col("r._change_type").isin(*POSITIVE)).select("r.*").select(*base.columns))


def event_scenario(events: DataFrame) -> Versions:
    """Four commits over ``events``: deletes, updates, inserts, then updates and deletes together."""
    t = Versions(events, "event_id")
    e = F.col("event_id")
    t.delete(e % 101 == 7)
    t.update(e % 97 == 5, {"event_type": F.lit("fixed"), "value": F.when(e % 2 == 0, F.lit(None)).otherwise(-F.col("value"))})
    value = F.when(e % 3 == 0, F.lit(None)).when(e % 3 == 1, F.col("value")).otherwise(F.col("value") * 100)
    t.insert(events.where(e % 89 == 3).withColumn("value", value).withColumn("event_id", e + 10_000_000))
    late = {"ts": F.lit("2035-01-01 00:00:00").cast("timestamp_ntz")}
    return t.update((e >= 10_000_000) & (e % 2 == 0), late, delete=(e < 10_000_000) & (e % 97 == 5) & (e % 5 == 0))
