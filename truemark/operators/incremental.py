"""Exact maintenance of rule results from a change feed.

A change feed is netted to at most one base image (sign -1) and one final image (+1) per row.
Counts move by signed sums. An extremum of a logical partition is kept unless a removed value
equals it; then that partition alone is computed again at the end version. Duplicate counts move
by the frequencies of the keys that changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truemark.functions.keys import bucket_id, partition_id
from truemark.functions.rules import COUNTS, EXTREMA, SCALARS, RuleSet
from truemark.sources.versions import NEGATIVE, POSITIVE


def cdf_counts(feed: DataFrame) -> DataFrame:
    return feed.groupBy(F.col("_commit_version").alias("commit_version"), F.col("_change_type").alias("change_type")).agg(F.count(F.lit(1)).alias("n"))


def row_bounds(feed: DataFrame, key: str) -> DataFrame:
    return feed.groupBy(key).agg(F.min("_commit_version").alias("first_version"), F.max("_commit_version").alias("last_version"))


def _order() -> Column:
    """Within a commit the old image comes first, so a delete and insert of one row nets to the new image."""
    return F.struct("_commit_version", F.col("_change_type").isin(*POSITIVE).cast("int"))


def net_images(feed: DataFrame, key: str) -> DataFrame:
    """Columns of the table with ``net_role`` and ``sign``; one aggregation, no window or self join."""
    columns = [c for c in feed.columns if not c.startswith("_")]
    image = F.struct(*columns, "_change_type")
    ends = feed.groupBy(F.col(key).alias("_row")).agg(F.min_by(image, _order()).alias("first"), F.max_by(image, _order()).alias("last"))
    sides = F.array(
        F.struct(F.lit("BASE_IMAGE").alias("net_role"), F.lit(-1).cast("long").alias("sign"), F.col("first").alias("i"), F.col("first._change_type").isin(*NEGATIVE).alias("real")),
        F.struct(F.lit("FINAL_IMAGE").alias("net_role"), F.lit(1).cast("long").alias("sign"), F.col("last").alias("i"), F.col("last._change_type").isin(*POSITIVE).alias("real")),
    )
    flat = ends.select(F.explode(sides).alias("s")).where("s.real")
    return flat.select(*[F.col(f"s.i.{c}").alias(c) for c in columns], "s.net_role", "s.sign")


def final_images(feed: DataFrame, key: str) -> DataFrame:
    """The last image of each changed row that still exists."""
    last = Window.partitionBy(key).orderBy(F.col("_commit_version").desc(), F.col("_change_type").isin(*POSITIVE).cast("int").desc())
    ranked = feed.withColumn("_rank", F.row_number().over(last)).where("_rank = 1")
    return ranked.where(F.col("_change_type").isin(*POSITIVE)).drop("_rank", "_change_type", "_commit_version")


def partition_state(rows: DataFrame, rules: RuleSet, partition: Column | None = None) -> DataFrame:
    """p and the eleven scalar metrics of each logical partition."""
    return rows.groupBy((partition_id() if partition is None else partition).alias("p")).agg(*rules.scalars())


def roll_up(state: DataFrame) -> DataFrame:
    """One row: counts summed, minima and maxima of the partitions'."""
    counts = [F.coalesce(F.sum(r), F.lit(0)).cast("long").alias(r) for r in COUNTS]
    return state.agg(*counts, *[(F.min if kind == "min" else F.max)(r).alias(r) for r, (kind, _) in EXTREMA.items()])


def key_frequency(rows: DataFrame, rules: RuleSet, bucket: Column | None = None) -> DataFrame:
    """b, the key columns and frequency; b is a function of the key."""
    counted = rows.groupBy(*rules.key).agg(F.count(F.lit(1)).alias("frequency"))
    return counted.select((bucket_id() if bucket is None else bucket).alias("b"), *rules.key, "frequency")


def duplicate_metrics(frequencies: DataFrame) -> DataFrame:
    f = F.col("frequency")
    return frequencies.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(f > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.greatest(f - 1, F.lit(0))), F.lit(0)).cast("long").alias("duplicate_extra"),
        F.coalesce(F.max(f), F.lit(0)).cast("long").alias("max_multiplicity"),
    )


def frequency_histogram(frequencies: DataFrame) -> DataFrame:
    """frequency and keys (how many have it): all that the duplicate metrics need, in a row a frequency."""
    return frequencies.groupBy("frequency").agg(F.count(F.lit(1)).alias("keys"))


def full_validation(rows: DataFrame, rules: RuleSet) -> DataFrame:
    """One row R01 to R13 from scratch: one scalar pass and one two-level key count."""
    extra = duplicate_metrics(rows.groupBy(*rules.key).agg(F.count(F.lit(1)).alias("frequency")))
    # one row each
    return rows.agg(*rules.scalars()).crossJoin(extra.select(F.col("duplicate_extra").alias("R12"), (F.col("duplicate_extra") == 0).alias("R13")))


def additive_delta(images: DataFrame, rules: RuleSet) -> DataFrame:
    return images.groupBy(partition_id().alias("p")).agg(*rules.counts(F.col("sign")))


def affected_partitions(images: DataFrame) -> DataFrame:
    return images.select(partition_id().alias("p")).distinct()


def positive_candidates(images: DataFrame, rules: RuleSet) -> DataFrame:
    return images.groupBy(partition_id().alias("p")).agg(*rules.extrema(F.col("sign") == 1))


def extrema_invalidation(images: DataFrame, state: DataFrame, rules: RuleSet) -> DataFrame:
    """p and, for each extremum, whether a removed value equals it (then it may no longer hold)."""
    stored = state.select("p", *[F.col(r).alias(f"old_{r}") for r in EXTREMA])
    removed = images.where("sign = -1").select(partition_id().alias("p"), *rules.measures)
    hit = [F.bool_or(F.coalesce(F.col(rules.measures[m]).cast("double") == F.col(f"old_{r}"), F.lit(False))).alias(r) for r, (_, m) in EXTREMA.items()]
    return removed.join(stored, "p").groupBy("p").agg(*hit)


def _any(prefix: str = "", extrema: Sequence[str] = tuple(EXTREMA)) -> Column:
    """Some extremum is flagged; as a comparison, which lets Spark prune the folders of a join's other side."""
    return reduce(lambda a, b: a + b, (F.col(f"{prefix}{r}").cast("int") for r in extrema)) > 0


def recompute(rows: DataFrame, invalid: DataFrame, rules: RuleSet) -> DataFrame:
    """Extrema of the invalid partitions at the end version."""
    flagged = invalid.where(_any()).select(F.col("p").alias("_p"))
    return in_partitions(rows, flagged).groupBy("p").agg(*rules.extrema())


def in_partitions(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with p, of the logical partitions in ``wanted`` (_p). Rows stored by p are read from those folders alone."""
    own = rows if "p" in rows.columns else rows.withColumn("p", partition_id())
    # the comparison tells Spark that the list is a choice, which is when it prunes folders by a join
    return own.join(F.broadcast(wanted.where("_p >= 0")), F.col("p") == F.col("_p"), "left_semi")  # at most one row a logical partition


def state_changes(images: DataFrame, state: DataFrame, rules: RuleSet) -> DataFrame:
    """What the images mean for each logical partition, in one pass: d_ (signed counts), c_ (extrema of
    the added values) and i_ (whether a removed value equals the stored extremum)."""
    held = state.select(F.col("p").alias("_p"), *[F.col(r).alias(f"old_{r}") for r in EXTREMA])
    own = images.withColumn("p", partition_id()).join(F.broadcast(held), F.col("p") == F.col("_p"), "left")  # a row a logical partition
    counts = [c.alias(f"d_{r}") for r, c in zip(COUNTS, rules.counts(F.col("sign")))]
    added = [c.alias(f"c_{r}") for r, c in zip(EXTREMA, rules.extrema(F.col("sign") == 1))]
    gone = [F.bool_or(F.coalesce((F.col("sign") == -1) & (F.col(rules.measures[m]).cast("double") == F.col(f"old_{r}")), F.lit(False))).alias(f"i_{r}") for r, (_, m) in EXTREMA.items()]
    return own.groupBy("p").agg(*counts, *added, *gone)


def maintained_state(state: DataFrame, images: DataFrame, end: DataFrame, rules: RuleSet) -> DataFrame:
    """The partition state at the end version. Partitions may appear and empty (then their extrema are NULL)."""
    return maintained(state, state_changes(images, state, rules), end, rules).select("p", *SCALARS)


def maintained(state: DataFrame, changes: DataFrame, end: DataFrame | None, rules: RuleSet, extrema: Sequence[str] = tuple(EXTREMA)) -> DataFrame:
    """p, R01 to R07 and ``extrema`` at the end version, and i_ columns of extrema that had to be computed
    again. Without extrema ``end`` isn't read at all; with some, the partitions flagged for these."""
    both = state.select("p", *[F.col(r).alias(f"s_{r}") for r in (*COUNTS, *extrema)]).join(changes, "p", "full")
    counts = [(F.coalesce(f"s_{r}", F.lit(0)) + F.coalesce(f"d_{r}", F.lit(0))).cast("long").alias(r) for r in COUNTS]
    found = []
    if extrema:
        flagged = changes.where(_any("i_", extrema)).select(F.col("p").alias("_p"))
        fresh = in_partitions(end, flagged).groupBy(F.col("p").alias("n_p")).agg(*[c.alias(f"n_{r}") for r, c in zip(EXTREMA, rules.extrema()) if r in extrema])
        both = both.join(F.broadcast(fresh), F.col("p") == F.col("n_p"), "left")  # at most one row a logical partition
    for r in extrema:
        pick = F.least if EXTREMA[r][0] == "min" else F.greatest
        found.append(F.when(F.coalesce(f"i_{r}", F.lit(False)), F.col(f"n_{r}")).otherwise(pick(f"s_{r}", f"c_{r}")).alias(r))
    return both.select("p", *counts, *found, *[F.coalesce(f"i_{r}", F.lit(False)).alias(f"i_{r}") for r in extrema])


def _same_key(left: str, right: str, key: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in key))


def key_delta(images: DataFrame, rules: RuleSet) -> DataFrame:
    delta = images.groupBy(*rules.key).agg(F.sum("sign").alias("delta")).where("delta <> 0")
    return delta.select(bucket_id().alias("b"), *rules.key, "delta")


def in_buckets(frequencies: DataFrame, delta: DataFrame) -> DataFrame:
    """The frequencies in the buckets of changed keys: of a state stored by bucket, those folders alone."""
    touched = delta.select(F.col("b").alias("_b")).where("_b >= 0").distinct()  # at most one row a bucket; for the comparison see in_partitions
    return frequencies.join(F.broadcast(touched), F.col("b") == F.col("_b"), "left_semi")


def key_overlay(frequencies: DataFrame, delta: DataFrame, rules: RuleSet) -> DataFrame:
    """For each changed key: base, delta and final frequency, and UPSERT or TOMBSTONE (gone)."""
    near = in_buckets(frequencies, delta)
    joined = delta.alias("d").join(near.alias("f"), (F.col("d.b") == F.col("f.b")) & _same_key("d", "f", rules.key), "left")
    base = F.coalesce("f.frequency", F.lit(0)).cast("long")
    final = base + F.col("delta")
    return joined.select("d.b", *[f"d.{k}" for k in rules.key], base.alias("base_frequency"), F.col("delta").alias("delta_frequency"), final.alias("final_frequency"), F.when(final == 0, "TOMBSTONE").otherwise("UPSERT").alias("overlay_action"))


def overlay_adjust(overlay: DataFrame) -> DataFrame:
    was, now = F.col("base_frequency"), F.col("final_frequency")
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    return overlay.agg(
        total((now > 0).cast("long") - (was > 0).cast("long"), "d_distinct"),
        total((now > 1).cast("long") - (was > 1).cast("long"), "d_groups"),
        total(F.greatest(now - 1, F.lit(0)) - F.greatest(was - 1, F.lit(0)), "d_extra"),
        F.coalesce(F.max("final_frequency"), F.lit(0)).cast("long").alias("max_final"),
        F.coalesce(F.max(F.when(now < was, was)), F.lit(0)).cast("long").alias("max_shrunk"),
    )


def moved_histogram(histogram: DataFrame, overlay: DataFrame) -> DataFrame:
    """The frequency histogram after an overlay: a changed key leaves its old frequency and joins its new one."""
    moves = F.array(F.struct(F.col("base_frequency").alias("frequency"), F.lit(-1).cast("long").alias("keys")), F.struct(F.col("final_frequency").alias("frequency"), F.lit(1).cast("long").alias("keys")))
    moved = overlay.select(F.explode(moves).alias("m")).select("m.*").where("frequency > 0")
    return histogram.select("frequency", "keys").unionByName(moved).groupBy("frequency").agg(F.sum("keys").cast("long").alias("keys")).where("keys > 0")


def histogram_metrics(histogram: DataFrame) -> DataFrame:
    """R12, R13 and the other duplicate metrics of a frequency histogram.

    The largest multiplicity is the largest frequency that still has keys, so that no key is read.
    """
    f, n = F.col("frequency"), F.col("keys")
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    found = histogram.agg(total(n * (f - 1), "R12"), total(n, "distinct_keys"), total(F.when(f > 1, n), "duplicate_groups"), F.coalesce(F.max(f), F.lit(0)).cast("long").alias("max_multiplicity"))
    return found.select("R12", (F.col("R12") == 0).alias("R13"), "distinct_keys", "duplicate_groups", "max_multiplicity")


def incremental_uniqueness(histogram: DataFrame, overlay: DataFrame) -> DataFrame:
    """Duplicate metrics at the end version from the base's frequency histogram and the overlay."""
    return histogram_metrics(moved_histogram(histogram, overlay))


def compacted(frequencies: DataFrame, overlay: DataFrame, rules: RuleSet) -> DataFrame:
    """Base and overlay as one key state, to chain from."""
    rest = frequencies.alias("f").join(overlay.alias("d"), (F.col("d.b") == F.col("f.b")) & _same_key("d", "f", rules.key), "left_anti")
    return rest.unionByName(overlay.where("final_frequency > 0").select("b", *rules.key, F.col("final_frequency").alias("frequency")))


def differential(state: DataFrame, feed: DataFrame, end: DataFrame, rules: RuleSet) -> DataFrame:
    """Partition state with the affected partitions computed again at the end version."""
    touched = feed.where("_commit_version > 0").select(partition_id().alias("_p")).distinct()  # at most one row a logical partition
    kept = state.join(F.broadcast(touched), F.col("p") == F.col("_p"), "left_anti")
    return kept.select("p", *SCALARS).unionByName(in_partitions(end, touched).groupBy("p").agg(*rules.scalars()))
