"""Rules at every version of a table from its base and its change feed, each read once.

Every base row counts +1 at version 0, every change row +1 or -1 at its own. One aggregation by the
columns of the key and of the measures, and by version, holds all that the rules need: signed sums
of R01 to R07, and how often a combination comes or goes. It is written, as a state that other
versions and reports can be read from. Sums over versions are then running sums over a row a version;
a key has constant frequency between two of its versions, so it counts only where that changes; a
combination is alive in intervals of versions, whose extrema are taken by interval before any
interval is spread over its versions. So nothing is done for each key and version, only for each
change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truemark.functions.rules import COUNTS, EXTREMA, RuleSet, rule_rows
from truemark.sources.shared import written
from truemark.sources.versions import POSITIVE

_END = (1 << 31) - 1


def steps(base: DataFrame, feed: DataFrame, rules: RuleSet, groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, key and measure columns, version, n (signed rows) and signed R01 to R07, written.

    ``groups`` are columns of both frames that tell independent tables apart. Rows of one hot key are
    added up in each task before they are dealt out.
    """
    own = [*groups, *dict.fromkeys([*rules.key, *rules.measures])]
    sign = F.when(F.col("_change_type").isin(*POSITIVE), F.lit(1)).otherwise(F.lit(-1)).cast("long")
    columns = [c for c in base.columns if c not in ("_change_type", "_commit_version")]
    rows = base.select(*columns, F.lit(0).cast("long").alias("_version"), F.lit(1).cast("long").alias("_sign"))
    rows = rows.unionByName(feed.select(*columns, F.col("_commit_version").cast("long").alias("_version"), sign.alias("_sign")))
    made = rows.groupBy(*own, F.col("_version").alias("version")).agg(F.sum("_sign").alias("n"), *rules.counts(F.col("_sign")))
    return written(made, "version-steps")


def _running(changes: DataFrame, versions: DataFrame, groups: tuple[str, ...], names: list[str]) -> DataFrame:
    """Running sums of ``names`` over all versions, those without a change too: a row a group and version."""
    order = Window.partitionBy(*groups, *([] if groups else [F.lit(0)])).orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    filled = versions.join(changes, [*groups, "version"], "left")
    return filled.select(*groups, "version", *(F.sum(F.coalesce(n, F.lit(0))).over(order).cast("long").alias(n) for n in names))


def at_versions(made: DataFrame, last: int, rules: RuleSet, groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, version, R01 to R13 at each version 0 to ``last``, from the frame of ``steps``."""
    spark = made.sparkSession
    versions = spark.range(last + 1).withColumnRenamed("id", "version")
    if groups:
        versions = made.select(*groups).distinct().crossJoin(F.broadcast(versions))  # a row a group and version
    counts = _running(made.groupBy(*groups, "version").agg(*(F.sum(r).alias(r) for r in COUNTS)), versions, groups, list(COUNTS))

    by_key = Window.partitionBy(*groups, *rules.key).orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    keyed = made.groupBy(*groups, *rules.key, "version").agg(F.sum("n").alias("n")).withColumn("now", F.sum("n").over(by_key)).withColumn("was", F.col("now") - F.col("n"))
    over = lambda c, k: F.greatest(F.col(c) - k, F.lit(0))
    extra = keyed.groupBy(*groups, "version").agg(F.sum(over("now", 1) - over("was", 1)).alias("R12"))
    unique = _running(extra, versions, groups, ["R12"])

    own = [*groups, *dict.fromkeys([*rules.key, *rules.measures])]
    order = Window.partitionBy(*own).orderBy("version")
    alive = made.select(*own, "version", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("now"), F.lead("version", 1, _END).over(order).alias("until")).where("now > 0")
    spans = alive.groupBy(*groups, "version", "until").agg(*rules.extrema())  # a row for each pair of versions at most
    spread = spans.select(*groups, F.explode(F.sequence("version", F.least(F.col("until") - 1, F.lit(last).cast("long")))).alias("version"), *EXTREMA)
    extrema = spread.groupBy(*groups, "version").agg(*((F.min if kind == "min" else F.max)(r).alias(r) for r, (kind, _) in EXTREMA.items()))

    joined = reduce(lambda a, b: a.join(b, [*groups, "version"], "left"), (unique, extrema), counts)
    return joined.select(*groups, "version", *COUNTS, *EXTREMA, "R12", (F.col("R12") == 0).alias("R13"))


def rules_by_version(base: DataFrame, feed: DataFrame, last: int, rules: RuleSet, groups: tuple[str, ...] = ()) -> DataFrame:
    """The 13 rule rows of every version, with version and groups."""
    return rule_rows(at_versions(steps(base, feed, rules, groups), last, rules, groups), *groups, "version")


def value(prefix: str = "") -> Column:
    """A rule row's value as one double: TRUE is 1."""
    return F.coalesce(F.col(f"{prefix}long_value").cast("double"), F.col(f"{prefix}double_value"), F.col(f"{prefix}boolean_value").cast("double"))


def attribution(by_version: DataFrame) -> DataFrame:
    """version, rule_id, before, after and changed: what each commit did to each rule. A row a commit and rule."""
    order = Window.partitionBy("rule_id").orderBy("version")  # a row a version
    found = by_version.select("version", "rule_id", value().alias("after")).withColumn("before", F.lag("after").over(order))
    return found.where("version > 0").select("version", "rule_id", "before", "after", (~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))
