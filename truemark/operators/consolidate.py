"""State tables that are stored one by one: folding them into one with checks, and what they take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truemark.functions.rules import COUNTS, EXTREMA, SCALARS
from truemark.sources.files import file_sizes
from truemark.sources.shared import written


def store_states(state: DataFrame) -> dict[str, DataFrame]:
    """The eleven scalar states of a partition state as tables of their own (p, value), by state id."""
    return {f"S{r[1:]}": written(state.select("p", F.col(r).alias("value")).coalesce(1), f"state-{r}") for r in SCALARS}


def _sure(condition: Column, what: Column) -> Column:
    """TRUE, or the job fails with ``what``."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(what))


def consolidated(tables: dict[str, DataFrame], baseline: DataFrame) -> DataFrame:
    """p and R01 to R11 from the tables S01 to S11, in one aggregation instead of a chain of joins.

    The job fails, naming state and partition, if a table lacks a partition that another has or has
    it twice, if a count is NULL, or if the tables rolled up don't equal ``baseline`` (one row, R01
    to R11, NULL equal to NULL).
    """
    names = {r: f"S{r[1:]}" for r in SCALARS}
    if missing := [s for s in names.values() if s not in tables]:
        raise ValueError(f"no table for {', '.join(missing)}")
    long = reduce(DataFrame.unionByName, (tables[s].select("p", F.lit(s).alias("s"), F.col("value").cast("long" if r in COUNTS else "double").cast("double").alias("d"), (F.col("value") if r in COUNTS else F.lit(None)).cast("long").alias("l")) for r, s in names.items()))
    picked = [F.max(F.when(F.col("s") == s, F.col("l" if r in COUNTS else "d"))).alias(r) for r, s in names.items()]
    times = [F.count_if(F.col("s") == s).alias(f"n_{r}") for r, s in names.items()]
    wide = long.groupBy("p").agg(*picked, *times)
    place = lambda s, text: F.concat(F.lit(f"{s}: partition "), F.col("p").cast("string"), F.lit(text))
    once = [_sure(F.col(f"n_{r}") == 1, F.concat(place(s, " occurs "), F.col(f"n_{r}").cast("string"), F.lit(" times"))) for r, s in names.items()]
    filled = [_sure(F.col(r).isNotNull(), place(names[r], " has no count")) for r in COUNTS]
    whole = wide.where(reduce(lambda a, b: a & b, [*once, *filled])).select("p", *SCALARS)
    rolled = whole.agg(*(F.coalesce(F.sum(r), F.lit(0)).cast("long").alias(f"r_{r}") for r in COUNTS), *((F.min if k == "min" else F.max)(r).alias(f"r_{r}") for r, (k, _) in EXTREMA.items()))
    equal = [_sure(F.col(f"r_{r}").eqNullSafe(F.col(f"b_{r}")), F.lit(f"{names[r]}: the partitions don't make up the baseline's {r}")) for r in SCALARS]
    verified = rolled.crossJoin(baseline.select(*(F.col(r).alias(f"b_{r}") for r in SCALARS))).where(reduce(lambda a, b: a & b, equal))  # one row each
    return whole.crossJoin(F.broadcast(verified.select(F.lit(True).alias("verified")))).drop("verified")  # one row


def measured(tables: dict[str, DataFrame]) -> DataFrame:
    """state_id, state_family, files, size_bytes and row_count of stored state tables, from the files' metadata."""

    def family(s: str) -> str:
        return "KEY_FREQUENCY" if s == "S12" else "ADDITIVE" if s < "S08" else "PARTITION_EXTREMA"

    sizes = (file_sizes(t).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("size_bytes"), F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("row_count")).select(F.lit(s).alias("state_id"), F.lit(family(s)).alias("state_family"), "*") for s, t in tables.items())
    return reduce(DataFrame.unionByName, sizes)


def ablation(kept_keys: DataFrame, histogram: DataFrame, images: DataFrame, snapshot: DataFrame, rules, overlay: DataFrame, by_state: DataFrame) -> DataFrame:
    """One row: what uniqueness costs by key state and by a full scan, both results, and the cheaper path.

    buckets_touched of all buckets, keys_read (keys in those) of all keys, changed_rows, rows (of the
    snapshot). Both paths read rows once, so the path that reads fewer wins: keys_read and
    changed_rows against rows. With nearly all buckets touched that is the scan, however small the
    change.
    """
    touched = overlay.select(F.col("b").alias("_b")).distinct()
    held = kept_keys.join(F.broadcast(touched), F.col("b") == F.col("_b"), "left")  # at most one row a bucket
    sizes = held.groupBy("b").agg(F.count(F.lit(1)).alias("keys"), F.max(F.col("_b").isNotNull()).alias("hit"))
    reads = sizes.agg(F.count_if("hit").alias("buckets_touched"), F.count(F.lit(1)).alias("buckets"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("keys"))), F.lit(0)).cast("long").alias("keys_read"), F.sum("keys").alias("keys"))
    changed = images.agg(F.count(F.lit(1)).alias("changed_rows"))
    scanned = snapshot.groupBy(*rules.key).agg(F.count(F.lit(1)).alias("f")).agg(F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum(F.col("f") - 1), F.lit(0)).cast("long").alias("R12_scan"))
    one = reads.crossJoin(changed).crossJoin(scanned).crossJoin(by_state.select(F.col("R12").alias("R12_state")))  # one row each
    cheaper = F.when(F.col("keys_read") + F.col("changed_rows") < F.col("rows"), "KEY_STATE").otherwise("FULL_SCAN")
    return one.select("*", (F.col("R12_state") == F.col("R12_scan")).alias("agree"), (F.col("R12_state") == 0).alias("R13"), F.round(F.col("buckets_touched") / F.col("buckets"), 6).alias("bucket_share"), F.round(F.col("keys_read") / F.col("keys"), 6).alias("key_share"), cheaper.alias("path"))


def key_path_bytes(keys: DataFrame, overlay: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row: state_bytes (files of the touched buckets), all_state_bytes and scan_bytes (files of the
    snapshot): what each way to uniqueness opens. ``keys`` and ``snapshot`` are fresh reads of folders."""
    touched = overlay.select(F.col("b").alias("_b")).where("_b >= 0").distinct()
    held = keys.select("b", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    near = held.join(F.broadcast(touched), F.col("b") == F.col("_b"), "left")  # at most one row a bucket
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    state = near.agg(total(F.when(F.col("_b").isNotNull(), F.col("size"))).alias("state_bytes"), total("size").alias("all_state_bytes"))
    return state.crossJoin(file_sizes(snapshot).agg(total("size_bytes").alias("scan_bytes")))  # one row each
