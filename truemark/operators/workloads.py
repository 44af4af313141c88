"""Workloads that are dealt out of one ranked pool, and corner cases as commits of their own."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truemark.functions.keys import portable_hash

#: Hash values by which the pool is ranked; ranks are taken in as many parts as this is hundreds.
HASHES = 1_000_000


def ranked(pool: DataFrame, key: str, parts: int = 1024) -> DataFrame:
    """``pool`` with rank, 1 and on, by hash of ``key`` and then ``key``: ranks within hash ranges, plus the
    counts of the ranges before, so that no task holds the pool."""
    h = portable_hash(F.col(key).cast("string"), HASHES)
    rows = pool.withColumn("_h", h).withColumn("_part", F.floor(F.col("_h") * parts / HASHES).cast("int"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_own"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_h", key))
    placed = rows.join(F.broadcast(counts), F.col("_part") == F.col("_own"))  # a row a part
    return placed.withColumn("rank", (F.col("_before") + within).cast("long")).drop("_h", "_part", "_own", "_before")


def splits(sizes: tuple[int, ...], shares: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """(inserts, updates, deletes) of each size: whole shares, the remainder to the deletes."""
    found = []
    for s in sizes:
        inserts, updates = math.floor(s * shares[0]), math.floor(s * shares[1])
        found.append((inserts, updates, s - inserts - updates))
    return found


def dealt(pool: DataFrame, families: dict[str, tuple[float, float, float]], sizes: tuple[int, ...]) -> DataFrame:
    """``pool`` (with rank) as operations: family, op, version and ordinal, for all families in one pass.

    Version k is the k-th size less the one before it, so that the source of a size is the versions
    up to its own and holds every smaller one. Updates take the first ranks, deletes those behind the
    largest size's updates, so that no row is both; inserts are clones of the first ranks.
    """
    rank, made = F.col("rank"), []
    for name, shares in families.items():
        counts = splits(sizes, shares)
        for i, op in enumerate(("INSERT", "UPDATE", "DELETE")):
            offset = counts[-1][1] if op == "DELETE" else 0
            limits = [c[i] for c in counts]
            version = F.when(rank - offset < 1, None)
            for k, limit in enumerate(limits, 1):
                version = version.when(rank - offset <= limit, k)
            made.append(F.struct(F.lit(name).alias("family"), F.lit(op).alias("op"), version.cast("long").alias("version"), (rank - offset).alias("ordinal")))
    largest = max(sum(c) for c in (splits(sizes, s)[-1] for s in families.values()))
    near = pool.where(rank <= largest)
    return near.withColumn("_d", F.explode(F.filter(F.array(*made), lambda d: d["version"].isNotNull()))).select(*pool.columns, "_d.*")


def change_rows(operations: DataFrame, columns: list[str], sets: dict[str, Column], key: str, max_key: DataFrame) -> DataFrame:
    """The change feed of ``operations``: ``columns``, family, _change_type and _commit_version.

    Updates and inserts have the columns ``sets``; inserts get the key that follows the largest there
    is (``max_key``, one row and column), by ordinal within their family.
    """
    kinds = F.when(F.col("op") == "INSERT", F.array(F.lit("insert"))).when(F.col("op") == "DELETE", F.array(F.lit("delete"))).otherwise(F.array(F.lit("update_preimage"), F.lit("update_postimage")))
    rows = operations.crossJoin(F.broadcast(max_key.toDF("_top"))).withColumn("_change_type", F.explode(kinds))  # one row
    new = F.col("_change_type").isin("insert", "update_postimage")
    out = [F.when(F.col("_change_type") == "insert", F.col("_top") + F.col("ordinal")).otherwise(F.col(c)).alias(c) if c == key else F.when(new, sets[c]).otherwise(F.col(c)).cast(operations.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in columns]
    return rows.select(*out, "family", "_change_type", F.col("version").alias("_commit_version"))


def case_changes(rows: DataFrame, cases: list[tuple[str, str, str, str | None]], key: str, first_new: int) -> DataFrame:
    """The change feed of corner cases, one commit each: ``rows`` hold scenario_id and the columns of the
    row that each case starts from; a case is (id, operation, role, 'column = value')."""
    columns = [c for c in rows.columns if c not in ("scenario_id", "operation", "source_role")]
    parts = []
    for version, (name, operation, _, change) in enumerate(cases, 1):
        own = rows.where(F.col("scenario_id") == name)
        column, _, to = (change or "").partition(" = ")
        after = own.withColumn(column, F.expr(to).cast(rows.schema[column].dataType)) if column else own
        if operation == "INSERT":
            images = {"insert": after.withColumn(key, F.col(key) + first_new + version)}
        elif operation == "DELETE":
            images = {"delete": own}
        else:
            images = {"update_preimage": own, "update_postimage": after}
        parts += [i.select(*columns, F.lit(kind).alias("_change_type"), F.lit(version).cast("long").alias("_commit_version")) for kind, i in images.items()]
    return reduce(DataFrame.unionByName, parts)


def audit(feed: DataFrame, expected: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Change rows by commit against what is ``expected`` (groups, version, inserts, updates, deletes)."""
    count = lambda kind, name: F.count_if(F.col("_change_type") == kind).alias(name)
    seen = feed.groupBy(*groups, F.col("_commit_version").alias("version")).agg(count("insert", "s_inserts"), count("update_preimage", "s_before"), count("update_postimage", "s_updates"), count("delete", "s_deletes"))
    both = expected.join(seen, [*groups, "version"], "left").fillna(0, ["s_inserts", "s_before", "s_updates", "s_deletes"])
    same = (F.col("inserts") == F.col("s_inserts")) & (F.col("updates") == F.col("s_updates")) & (F.col("s_before") == F.col("s_updates")) & (F.col("deletes") == F.col("s_deletes"))
    return both.select(*groups, "version", F.col("s_inserts").alias("inserts"), F.col("s_updates").alias("updates"), F.col("s_deletes").alias("deletes"), (F.col("s_inserts") + F.col("s_before") + F.col("s_updates") + F.col("s_deletes")).alias("change_rows"), same.alias("as_expected"))
