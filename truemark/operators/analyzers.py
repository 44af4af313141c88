"""Fraction-style analyzers and table profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size() -> Column:
    return F.count(F.lit(1)).cast("double")


def completeness(column: str) -> Column:
    return F.count(column) / F.count(F.lit(1))


def compliance(predicate: str) -> Column:
    """Share of the rows for which the SQL predicate is true."""
    return F.avg(F.when(F.expr(predicate), 1.0).otherwise(0.0))


def metric_rows(wide: DataFrame) -> DataFrame:
    """(analyzer, instance, value) from one row whose columns are named analyzer__instance."""
    rows = [F.struct(F.lit(c.split("__")[0]).alias("analyzer"), F.lit(c.split("__")[1]).alias("instance"), F.round(F.col(c), 9).alias("value")) for c in wide.columns]
    return wide.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def key_analyzers(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Distinctness (keys per row) and uniqueness (keys seen once per row) in one two-level count."""
    name, n = "_".join(key), F.sum("n")
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg((F.count(F.lit(1)) / n).alias(f"Distinctness__{name}"), (F.count_if(F.col("n") == 1) / n).alias(f"Uniqueness__{name}"))


def reconstruct(fraction: Column, rows: Column, tolerance: float = 1e-4) -> Column:
    """The whole number behind a fraction; NULL if it isn't within ``tolerance`` of one."""
    exact = fraction * rows
    return F.when(F.abs(exact - F.round(exact)) <= tolerance, F.round(exact).cast("long"))


def profile(df: DataFrame, name: str, measure: str) -> DataFrame:
    """One row: counts, range and negatives of a measure, and NULLs over all columns."""
    nulls = reduce(lambda a, b: a + b, (F.count_if(F.col(c).isNull()) for c in df.columns))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(measure).cast("double").alias("min_value"),
        F.max(measure).cast("double").alias("max_value"),
        F.count_if(F.col(measure) < 0).alias("negative_count"),
        nulls.cast("long").alias("null_count"),
    ).select(F.lit(name).alias("table_name"), "*")


def column_profile(df: DataFrame, name: str) -> DataFrame:
    """table_name, column_name, null_count and value_count of each column, in one pass."""
    wide = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"{c}__n") for c in df.columns), *(F.count(c).alias(f"{c}__d") for c in df.columns))
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("null_count"), F.col(f"{c}__d").alias("value_count")) for c in df.columns]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
