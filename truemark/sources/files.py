"""Lists of files, their sizes, text files with typed columns, and guards on what was read."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_files(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The files of a list or of glob patterns, in sorted order, under one schema; columns that a file lacks are NULL."""
    return spark.read.schema(schema).parquet(*sorted(set(paths)))


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the files under ``path``: names, sizes and modification times, from the listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    one = F.sha2(F.concat_ws("|", "path", "length", F.col("modificationTime").cast("double")), 256)
    # order-free: each half of a digest is added up, so no list of files comes together
    halves = [F.sum(F.conv(F.substring(one, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    return "-".join(map(str, listed.agg(F.count(F.lit(1)), *halves).first()))


def schema_signature(schema: T.StructType) -> str:
    """sha256 of names, types and nullability in order: what a table's contract fixes."""
    return hashlib.sha256(json.dumps([(f.name, f.dataType.simpleString(), f.nullable) for f in schema]).encode()).hexdigest()


def checked_scan(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The files of a list as one frame, each held against ``schema`` by its own footer; drift is an error that names the file and columns."""
    wanted = schema_signature(schema)
    for path in sorted(set(paths)):
        own = spark.read.parquet(path).schema
        if schema_signature(own) != wanted:
            drift = sorted({(f.name, f.dataType.simpleString(), f.nullable) for f in own} ^ {(f.name, f.dataType.simpleString(), f.nullable) for f in schema})
            raise ValueError(f"{path} departs from the schema: {drift or 'other order of columns'}")
    return scan_files(spark, paths, schema)


def file_sizes(scan: DataFrame) -> DataFrame:
    """file_name, size_bytes and row_count of the files that ``scan``, a fresh read, reads."""
    of_file = scan.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("size_bytes"))
    return of_file.groupBy("path", "file_name", "size_bytes").agg(F.count(F.lit(1)).alias("row_count")).drop("path")


def typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header: all columns are read as text, those of ``schema`` are cast."""
    read = spark.read.csv(path, header=True, inferSchema=False)
    return read.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def any_null(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def single_row(df: DataFrame, what: str) -> DataFrame:
    """``df``, which must have exactly one row: otherwise the job that reads the result fails."""
    counted = df.limit(2).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*df.columns)).alias("row"))
    checked = F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit(f"{what} must have one row")))
    return counted.select(checked.alias("row")).select("row.*")


def exists(df: DataFrame) -> DataFrame:
    """One row, ``found``: whether ``df`` has a row. The scan ends at the first."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
