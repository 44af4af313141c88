"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time 0 to 1, linear between equally spaced knots.
The integral of a schedule is the source's share of the token budget; a source whose share
passes ``max_repeat`` times its size is held there and its excess goes to the others by weight.
Along time, a source's cumulative token demand is its target times the normalised integral of its
schedule. Its documents stand in hash order on a token axis, repeated from the start as often as
the target asks, and the inverse of the demand at a document's place is its training position.
Documents are then range-sorted by position. The last document that a source takes may be taken
in part: ``taken`` counts the words up to the target.

Places are prefix sums in two levels: about sqrt(n) hash buckets a source, each of about sqrt(n)
documents, so neither level puts a hot source into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truemark.llm.common import WORD, columns, room_for, written

_HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column, text: Column, half: int = 0) -> Column:
    """60 bits (the first, or the next ones) of md5 of the id and the text, so that rows without an id are
    spread too: the same order in any engine."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    digits = _HASH_BITS // 4
    return F.conv(F.substring(F.md5(both), 1 + half * digits, digits), 16, 10).cast("long")


def cycle_schedules(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), tilt: float = 0.5) -> DataFrame:
    """``sources`` (source, ...) with knots: weights repeat over the sources in code-point order, null
    last; schedules fall and rise in turn by ``tilt`` around their weight."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (at % len(weights) + 1).cast("int"))
    slope = F.when(at % 2 == 0, F.lit(tilt)).otherwise(F.lit(-tilt))
    return sources.withColumn("knots", F.array(weight * (1 + slope), weight, weight * (1 - slope)))


def integral(knots: Column) -> Column:
    """Of a schedule over training time 0 to 1."""
    pieces = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: (F.get(knots, i - 1) + F.get(knots, i)) / 2)
    return F.aggregate(pieces, F.lit(0.0), lambda a, x: a + x) / (F.size(knots) - 1)


def fill_targets(sources: DataFrame, budget: float, max_repeat: float) -> DataFrame:
    """``sources`` (source, source_size, knots) with weight, the integral of the schedule, and target, no target above its cap.

    With sources in the order of cap over weight, those before some point are at their caps and the
    rest share what is left by weight; the point is the first where no share passes its cap.
    """
    sources = sources.withColumn("weight", integral(F.col("knots")))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())  # one row a source
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    total = F.sum("source_size").over(everyone) * F.lit(float(budget))
    level = (total - F.coalesce(F.sum(cap).over(upto), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    free = F.when(level * F.col("weight") <= cap, level)
    shared = sources.withColumn("_free", free).withColumn("_level", F.first("_free", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return shared.withColumn("target", F.least(cap, F.coalesce(F.col("_level") * F.col("weight"), cap))).drop("_free", "_level")


def training_time(knots: Column, share: Column) -> Column:
    """The time at which the normalised integral of a schedule reaches ``share`` (0 to 1)."""
    steps = F.size(knots) - 1
    trapezoids = F.transform(F.sequence(F.lit(1), steps), lambda i: (F.get(knots, i - 1) + F.get(knots, i)) / 2)
    wanted = share * F.aggregate(trapezoids, F.lit(0.0), lambda a, x: a + x)
    # walk the pieces: (area left, time); within a piece the area is quadratic in time
    def walk(state: Column, i: Column) -> Column:
        a, b = F.get(knots, i - 1), F.get(knots, i)
        area, left = (a + b) / 2, state["left"]
        inside = F.greatest(F.least(left, area), F.lit(0.0))
        root = a + F.sqrt(F.greatest(a * a + 2 * (b - a) * inside, F.lit(0.0)))
        part = F.when(root > 0, 2 * inside / root).otherwise(F.lit(0.0))
        return F.struct((left - inside).alias("left"), (state["time"] + part).alias("time"))

    start = F.struct(wanted.alias("left"), F.lit(0.0).alias("time"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, walk)["time"] / steps


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, max_repeat: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, taken, hash_place (0 to 1, the order of documents) and
    positions, one per copy that the mix takes.

    Null texts have size 0 and are never taken; a null source is a source of its own; repeated
    rows are documents of their own; ids may be null. Columns of ``docs`` that have a name of the
    added ones, or one that begins with ``_mix``, are replaced. An empty table gives an empty result.
    Documents stand by a hash of id and text, 120 bits of it, so only rows alike in both are
    interchangeable, and reruns agree however the rows come in.
    """
    own = [c for c in docs.columns if c.lower().startswith("_mix")]
    docs = room_for(docs, ["size", "source_size", "target", "taken", "hash_place", "positions", *own], id_col, text_col, source_col)
    buckets = max(1, math.isqrt(docs.count()))
    sized = docs.withColumn("size", word_count(F.col(text_col))).withColumn("_mix_hash", _hash(F.col(id_col), F.col(text_col))).withColumn("_mix_next", _hash(F.col(id_col), F.col(text_col), 1)).withColumn("_mix_bucket", F.floor(F.col("_mix_hash") / F.lit(2.0**_HASH_BITS) * buckets).cast("int"))
    sums = written(sized.groupBy(F.col(source_col).alias("source"), F.col("_mix_bucket").alias("bucket")).agg(F.sum("size").alias("bucket_size")), "source-buckets")
    sources = fill_targets(cycle_schedules(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights), budget, max_repeat)
    sources = sources.select(F.col("source").alias("_mix_name"), "source_size", "target", F.col("knots").alias("_mix_knots"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.withColumn("_mix_before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(sources, F.col("source").eqNullSafe(F.col("_mix_name")))
    places = places.select(F.col("source").alias("_mix_source"), F.col("bucket").alias("_mix_place"), "_mix_before", "source_size", "target", "_mix_knots")

    placed = sized.join(places, (F.col("_mix_bucket") == F.col("_mix_place")) & F.col(source_col).eqNullSafe(F.col("_mix_source")))
    within = Window.partitionBy("_mix_bucket", source_col).orderBy("_mix_hash", "_mix_next").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_mix_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    stop = F.floor("target").cast("long")
    copies = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(max_repeat) - 1)), lambda k: F.struct(k.alias("copy"), (F.col("_mix_start") + k * F.col("source_size")).alias("at")))
    taken = F.transform(copies, lambda c: F.struct(c["copy"].alias("copy"), c["at"].alias("at"), F.greatest(F.lit(0), F.least(F.col("size"), F.col("_mix_stop") - c["at"])).cast("long").alias("words")))
    found = placed.withColumn("_mix_start", start).withColumn("_mix_stop", stop).withColumn("_mix_copies", F.filter(taken, lambda c: c["words"] > 0))
    positions = F.transform("_mix_copies", lambda c: training_time(F.col("_mix_knots"), c["at"] / F.col("target")))
    return found.withColumn("taken", F.aggregate("_mix_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])).withColumn("positions", positions).select(*columns(docs), "size", "source_size", "target", "taken", (F.col("_mix_hash") / F.lit(2.0**_HASH_BITS)).alias("hash_place"), "positions")


def by_position(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents range-sorted by first training position; those not taken follow in hash order."""
    mixed = room_for(mixed, ["position"], id_col, "hash_place")
    key = F.coalesce(F.get("positions", F.lit(0)), 1.0 + F.col("hash_place"))
    return mixed.withColumn("position", F.get("positions", F.lit(0))).orderBy(key, id_col)


def training_stream(mixed: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """One row per copy taken, whole texts, range-sorted by training position."""
    return mixed.withColumn("_mix_position", F.explode("positions")).orderBy("_mix_position", id_col).select(*columns)
