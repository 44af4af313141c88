"""A table stored in folders of a logical partition, changed commit by commit.

DELETE, UPDATE and MERGE rewrite the folders of the partitions they touch, those that rows leave and
those that rows move to, and no others (dynamic partition overwrite). A commit finds its touched
partitions first, at most one number a logical partition, so that Spark prunes the scan by them; it
then reads those folders once and writes all row images once, and the new folders and the change rows
both come from that. INSERT only adds files. A rewritten folder holds one marker row, so that it is replaced even when its
last row is gone.

Change rows are kept by commit version. An earlier version is the present one with the changes since
undone: final images go, base images come back. A line per commit, with its counts, is the history;
it is written last.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truemark.operators.incremental import net_images
from truemark.sources.files import file_sizes
from truemark.sources.shared import overwrite_folders, written

_KEEP = "keep"


class FolderTable:
    def __init__(self, spark: SparkSession, path: str, key: str, partition: Column):
        """The table at ``path``; ``partition`` gives a row's logical partition from its columns."""
        self.spark, self.path, self.key, self.partition = spark, path, key, partition

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, partition: Column) -> "FolderTable":
        """Write ``df`` as version 0; a path that has a table is refused."""
        df.select("*", F.lit(True).alias("_live"), partition.alias("p")).hint("rebalance", "p").write.partitionBy("p").parquet(f"{path}/rows")
        made = cls(df.sparkSession, path, key, partition)
        made._log(0, "LOAD", df.sparkSession.createDataFrame([], f"_change_type string, {key} long"))
        return made

    # -------------------------------------------------------------------- reading

    def stored(self) -> DataFrame:
        """The table's rows as they lie, markers included, with p."""
        reader = self.spark.read
        return (reader.schema(self.schema) if "schema" in self.__dict__ else reader).parquet(f"{self.path}/rows")

    @cached_property
    def schema(self) -> T.StructType:
        return self.stored().schema

    @property
    def columns(self) -> list[str]:
        return [c for c in self.schema.names if c not in ("p", "_live")]

    def rows(self) -> DataFrame:
        """The present rows with p; a filter on p reads its folders alone."""
        return self.stored().where("_live").drop("_live")

    def log(self) -> DataFrame:
        """version, operation, inserts, updates, deletes and partitions (how many were rewritten)."""
        return self.spark.read.parquet(f"{self.path}/log")

    @property
    def version(self) -> int:
        return self.log().agg(F.max("version")).first()[0]

    def changes(self, first: int, last: int) -> DataFrame:
        """Change rows of the commits ``first`` to ``last``, both included; their folders alone are read."""
        feed = self.spark.read.parquet(f"{self.path}/changes").where(F.col("_commit_version").between(first, last))
        return feed.select(*self.columns, "_change_type", F.col("_commit_version").cast("long").alias("_commit_version"))

    def as_of(self, version: int) -> DataFrame:
        """The rows at ``version``, without p."""
        now = self.version
        if version >= now:
            return self.rows().select(*self.columns)
        images = net_images(self.changes(version + 1, now), self.key)
        kept = self.rows().join(images.where("sign = 1").select(F.col(self.key).alias("_changed")), F.col(self.key) == F.col("_changed"), "left_anti")
        return kept.select(*self.columns).unionByName(images.where("sign = -1").select(*self.columns))

    def history(self) -> DataFrame:
        """version, operation, row_count and change_count of each commit: the present count less the changes since."""
        n = F.col("inserts") - F.col("deletes")
        later = F.coalesce(F.sum(n).over(Window.orderBy("version").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))  # a row a commit
        present = self.rows().agg(F.count(F.lit(1)).alias("now"))
        return self.log().crossJoin(present).select("version", "operation", (F.col("now") - later).alias("row_count"), (F.col("inserts") + 2 * F.col("updates") + F.col("deletes")).alias("change_count"))  # one row

    def detail(self) -> DataFrame:
        """One row: files, size_bytes, row_count and partitions of the present version, the columns (names
        and types), the key and the partition column: what a catalogue wants to know."""
        sizes = file_sizes(self.stored()).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))
        live = self.rows().agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("p").alias("partitions"))
        kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in self.rows().schema if f.name != "p")
        facts = {"columns": kinds, "row_key": self.key, "partition_column": "p", "version": str(self.version)}
        return sizes.crossJoin(live).withColumn("properties", F.create_map(*(F.lit(x) for pair in facts.items() for x in pair)))  # one row each

    # -------------------------------------------------------------------- writing

    def _log(self, version: int, operation: str, changes: DataFrame, partitions: int = 0) -> None:
        count = lambda kind, name: F.count_if(F.col("_change_type") == kind).alias(name)
        line = changes.agg(count("insert", "inserts"), count("update_postimage", "updates"), count("delete", "deletes"))
        line.select(F.lit(version).cast("long").alias("version"), F.lit(operation).alias("operation"), "*", F.lit(partitions).cast("long").alias("partitions")).write.mode("append").parquet(f"{self.path}/log")

    def _commit(self, operation: str, images: DataFrame, touched: list[int]) -> list[int]:
        """``images``: the columns, p and _kind (keep or a change type) of every row of the touched partitions."""
        version, columns = self.version + 1, self.columns
        images = written(images.select(*columns, "p", "_kind"), "row-images")
        after = images.where(F.col("_kind").isin(_KEEP, "insert", "update_postimage")).select(*columns, F.lit(True).alias("_live"), "p")
        schema = self.schema
        markers = self.spark.createDataFrame([(p,) for p in touched], "p int").select(*(F.lit(None).cast(schema[c].dataType).alias(c) for c in columns), F.lit(False).alias("_live"), "p")
        changed = self._record(version, images.where(F.col("_kind") != _KEEP))
        overwrite_folders(after.unionByName(markers), f"{self.path}/rows", "p")
        self._log(version, operation, changed, len(touched))
        return touched

    def _record(self, version: int, images: DataFrame) -> DataFrame:
        """Write the change rows of a commit; ``images`` have _kind."""
        changed = images.select(*self.columns, F.col("_kind").alias("_change_type"), F.lit(version).alias("_commit_version"))
        changed.hint("rebalance").write.mode("append").partitionBy("_commit_version").parquet(f"{self.path}/changes")
        return changed

    def _partitions(self, *frames: DataFrame) -> list[int]:
        """The distinct numbers in frames of one column: at most one a logical partition."""
        found: set[int] = set()
        for f in frames:
            found |= {r[0] for r in f.distinct().collect()}
        return sorted(found)

    def insert(self, rows: DataFrame) -> list[int]:
        """INSERT: new files beside those that are there, which all stay. Gives the partitions that got
        some, as the others give those that they rewrote."""
        version, rows = self.version + 1, written(rows.select(*self.columns, self.partition.alias("p")), "inserted")
        touched = self._partitions(rows.select("p"))
        changed = self._record(version, rows.withColumn("_kind", F.lit("insert")))
        rows.select(*self.columns, F.lit(True).alias("_live"), "p").hint("rebalance", "p").write.mode("append").partitionBy("p").parquet(f"{self.path}/rows")
        self._log(version, "INSERT", changed, len(touched))
        return touched

    def overwrite(self, rows: DataFrame) -> list[int]:
        """All rows replaced in one commit: the old ones are deleted, the new ones inserted."""
        new = written(rows.select(*self.columns, self.partition.alias("p")), "overwriting")
        touched = self._partitions(new.select("p"), self.rows().select("p"))
        images = self.rows().withColumn("_kind", F.lit("delete")).unionByName(new.withColumn("_kind", F.lit("insert")))
        return self._commit("OVERWRITE", images, touched)

    def delete(self, where: Column) -> list[int]:
        """DELETE WHERE. A condition on p, or on columns with statistics, prunes the search too."""
        hit = F.coalesce(where, F.lit(False))
        touched = self._partitions(self.rows().where(hit).select("p"))
        kind = F.when(hit, "delete").otherwise(_KEEP)
        return self._commit("DELETE", self.rows().where(F.col("p").isin(touched)).withColumn("_kind", kind), touched)

    def _images(self, rows: DataFrame, kinds: Column, new: dict[str, Column]) -> DataFrame:
        """A row for each image that ``kinds`` (an array of names) asks for; new columns and the partition
        they give are for postimages and inserts."""
        at = rows.withColumn("_kind", F.explode(kinds))
        fresh = F.col("_kind").isin("insert", "update_postimage")
        placed = at.select(*(F.when(fresh, new[c]).otherwise(F.col(c)).cast(at.schema[c].dataType).alias(c) if c in new else F.col(c) for c in self.columns), F.col("p").alias("_p"), "_kind")
        return placed.withColumn("p", F.when(fresh, self.partition).otherwise(F.col("_p"))).drop("_p")

    def update(self, where: Column, sets: dict[str, Column]) -> list[int]:
        """UPDATE SET. Rows whose partition follows from a changed column move there."""
        hit = F.coalesce(where, F.lit(False))
        matched = self.rows().where(hit)
        both = F.array(F.lit("update_preimage"), F.lit("update_postimage"))
        touched = self._partitions(self._images(matched, both, sets).select("p"))
        held = self.rows().where(F.col("p").isin(touched))
        return self._commit("UPDATE", self._images(held, F.when(hit, both).otherwise(F.array(F.lit(_KEEP))), sets), touched)

    def merge(self, source: DataFrame) -> list[int]:
        """MERGE of ``source`` (the columns, p of the row that is meant, op) on (key, p): DELETE and UPDATE
        of matches, INSERT of the others. The source is read once. Two rows for one key are an error.
        """
        columns = self.columns
        twice = F.count(F.lit(1)).over(Window.partitionBy(self.key)) > 1
        op = F.when(twice, F.raise_error(F.lit("MERGE source matches a row twice"))).otherwise(F.col("op"))
        staged = written(source.select(*columns, F.col("p").cast("int").alias("_p"), op.alias("_op")).withColumn("_to", self.partition), "merge-source")
        touched = self._partitions(staged.select("_p").where("_p is not null and _op <> 'INSERT'"), staged.select("_to").where("_op <> 'DELETE'"))
        held = self.rows().where(F.col("p").isin(touched))
        new = staged.select("_p", "_op", *(F.col(c).alias(f"_new_{c}") for c in columns))
        # a row that is to be inserted meets a row of its key in the partition it names, or none
        both = held.join(new, (F.col(self.key) == F.col(f"_new_{self.key}")) & (F.col("p") == F.col("_p")), "full")
        there, given = F.col(self.key).isNotNull(), F.col("_op").isNotNull()
        names = lambda *kinds: F.array(*(F.lit(k) for k in kinds))
        kinds = (
            F.when(there & (F.col("_op") == "UPDATE"), names("update_preimage", "update_postimage"))
            .when(there & (F.col("_op") == "DELETE"), names("delete"))
            .when(there, names(_KEEP))
            .when(given & (F.col("_op") == "INSERT"), names("insert"))
            .otherwise(F.array().cast("array<string>"))
        )
        return self._commit("MERGE", self._images(both, kinds, {c: F.col(f"_new_{c}") for c in columns}), touched)
