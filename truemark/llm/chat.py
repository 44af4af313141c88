"""Collapse of cumulative conversation snapshots, and chat rendering. DataFrame functions only.

Loggers often store a conversation again after each turn. The rolling hash of a turn prefix is
the xor of hashes of (position, role, text), which a running window gives. A conversation whose
whole hash is another's proper-prefix hash of the same length is a snapshot that the other
contains; an anti-join drops it. Conversations with equal hashes are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turn_hash(tag: int) -> Column:
    return F.xxhash64(F.lit(tag), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2 ...), n_turns and the 128-bit hash (p1, p2) of the first pos turns.

    Turns stand in the order of turn (null last), then role and text hash, so ties have a defined order.
    """
    turns = conversations.select("conv_id", "turn", "role", _turn_hash(1).alias("a"), _turn_hash(2).alias("b"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "a", "b")
    numbered = turns.withColumn("pos", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.select(
        "conv_id",
        "pos",
        F.bit_xor(F.xxhash64("pos", "a", "b")).over(running).alias("p1"),
        F.bit_xor(F.xxhash64("b", "pos", "a")).over(running).alias("p2"),
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_turns"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that are no proper prefix of another.

    Of equal conversations the smallest conv_id stays; copies counts them. Turns with a null
    conv_id form one conversation.
    """
    hashes = prefix_hashes(conversations)
    whole = hashes.where(F.col("pos") == F.col("n_turns")).groupBy("p1", "p2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = hashes.where(F.col("pos") < F.col("n_turns")).select("p1", "p2", F.col("pos").cast("long").alias("n_turns")).distinct()
    return whole.join(proper, ["p1", "p2", "n_turns"], "left_anti").select("conv_id", "n_turns", "copies")


def render(conversations: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per chosen conversation with its turns in chat mark-up; null role and text are empty."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "a", "b")
    turns = conversations.select("conv_id", "turn", "role", "text", _turn_hash(1).alias("a"), _turn_hash(2).alias("b"))
    kept = turns.alias("t").join(chosen.select(F.col("conv_id").alias("_chosen")), F.col("conv_id").eqNullSafe(F.col("_chosen")), "left_semi")
    marked = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>"))
    lines = kept.select("conv_id", F.row_number().over(order).alias("pos"), marked.alias("line"))
    joined = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("rendered"))
    info = chosen.select(F.col("conv_id").alias("_chosen"), "n_turns", "copies")
    return joined.join(info, F.col("conv_id").eqNullSafe(F.col("_chosen"))).select("conv_id", "n_turns", "copies", "rendered")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations, rendered. Extra columns are ignored; an empty table gives no rows."""
    return render(conversations, maximal_conversations(conversations))
