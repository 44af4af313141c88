"""The folder that driver and executors share, and cutting lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder of its own, and a cluster
    an error: a folder of the driver's machine is of no use to executors elsewhere.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="truemark-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    With ``partition_by`` (a column of whole numbers), a filter on it reads its folders alone.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    return found.select(*df.columns) if partition_by else found  # else the partition column would stand last


def overwrite_folders(df: DataFrame, path: str, column: str) -> None:
    """Replace the folders of ``column`` that ``df`` has rows for; all others keep their files.

    Rows of a folder are dealt out together first, so that a small folder is one file and a large
    one several. ``df`` must not read ``path``: write it elsewhere before.
    """
    df.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def found(spark: SparkSession, path: str) -> DataFrame | None:
    """What a finished job wrote at ``path``, or None if there is nothing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def bucketed_at(df: DataFrame, name: str, *columns: str, sort: tuple[str, ...] = (), buckets: int = 0) -> tuple[DataFrame, str]:
    """``df`` written in buckets of ``columns``, each sorted by ``sort``, and its folder. Joins by these
    columns read the frame without a shuffle.

    Spark writes buckets only through its catalogue; the entry goes as soon as the frame knows the
    buckets, and the files, which are outside the warehouse, stay.
    """
    spark, unique = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{unique}"
    writer = df.write.format("parquet").bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), *columns)
    (writer.sortBy(*sort) if sort else writer).option("path", path).saveAsTable(unique)
    found = spark.table(unique)
    found.schema  # noqa: B018  resolves the frame
    spark.sql(f"DROP TABLE {unique}")
    return found, path


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like ``written``, with the rows in buckets of ``column``: joins on it read them without a shuffle."""
    return bucketed_at(df, name, column)[0]
