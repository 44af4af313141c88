"""Which rules are answered how, given the states that are kept, and the plan that follows.

A portfolio is a set of state ids: S01 to S11 hold the rules R01 to R11 by logical partition, S12
holds key frequencies and answers R12 and R13. A rule whose state is kept follows from it and the
changes; an extremum that a removed row may have held is computed again in the partitions concerned;
a rule without a state needs a scan of the end snapshot, of its columns alone, together with the other
such rules. The portfolio is known when the plan is built, so a scan that no rule needs isn't in it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truemark.functions.rules import COUNTS, EXTREMA, RULES, SCALARS, RuleSet, rule_rows
from truemark.operators import incremental as inc
from truemark.sources.stored import Stored

STATES = tuple(f"S{i:02d}" for i in range(1, 13))
ASSISTED, AGAIN, SCANNED = "STATE_ASSISTED", "AFFECTED_PARTITION_RECOMPUTE", "EXACT_FULL_SCAN_FALLBACK"


def state_of(rule: str) -> str:
    return "S12" if rule in ("R12", "R13") else "S" + rule[1:]


def answers(kept: Stored, rules: RuleSet, row_key: str, portfolio: Iterable[str]) -> DataFrame:
    """One row: R01 to R13 at the end version, and again_ columns (partitions computed again) of kept extrema."""
    held = set(portfolio)
    extrema = [r for r in EXTREMA if state_of(r) in held]
    scanned = [r for r in SCALARS if state_of(r) not in held]
    images = inc.net_images(kept.feed, row_key)
    parts: list[DataFrame] = []
    if len(scanned) < len(SCALARS):
        now = inc.maintained(kept.state, inc.state_changes(images, kept.state, rules), kept.end, rules, extrema)
        sums = [F.coalesce(F.sum(r), F.lit(0)).cast("long").alias(r) for r in COUNTS if r not in scanned]
        ends = [(F.min if EXTREMA[r][0] == "min" else F.max)(r).alias(r) for r in extrema]
        parts.append(now.agg(*sums, *ends, *(F.count_if(F.col(f"i_{r}")).alias(f"again_{r}") for r in extrema)))
    if scanned:
        parts.append(kept.end.agg(*(c for r, c in zip(SCALARS, rules.scalars()) if r in scanned)))
    if "S12" in held:
        found = inc.incremental_uniqueness(kept.histogram, inc.key_overlay(kept.keys, inc.key_delta(images, rules), rules))
        parts.append(found.select("R12", "R13"))
    else:
        extra = inc.duplicate_metrics(kept.end.groupBy(*rules.key).agg(F.count(F.lit(1)).alias("frequency")))
        parts.append(extra.select(F.col("duplicate_extra").alias("R12"), (F.col("duplicate_extra") == 0).alias("R13")))
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # one row each
    return one


def planned_rules(kept: Stored, rules: RuleSet, row_key: str, portfolio: Iterable[str]) -> DataFrame:
    """The 13 rule rows at the end version with planner_mode."""
    held = set(portfolio)
    wide = answers(kept, rules, row_key, held)
    modes = []
    for r in RULES:
        mode = F.lit(SCANNED) if state_of(r) not in held else F.when(F.col(f"again_{r}") > 0, AGAIN).otherwise(ASSISTED) if r in EXTREMA else F.lit(ASSISTED)
        modes.append(F.struct(F.lit(r).alias("rule_id"), mode.alias("planner_mode")))
    rows = rule_rows(wide.withColumn("modes", F.map_from_entries(F.array(*modes))), "modes")
    return rows.withColumn("planner_mode", F.col("modes")[F.col("rule_id")]).drop("modes")
