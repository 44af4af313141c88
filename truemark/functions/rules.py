"""Rules as data. Predicates are SQL text, so one text serves Spark, an API user and a test oracle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("R01", "R02", "R03", "R04", "R05", "R06", "R07")
EXTREMA = {"R08": ("min", 0), "R09": ("max", 0), "R10": ("min", 1), "R11": ("max", 1)}
SCALARS = (*COUNTS, *EXTREMA)
RULES = (*SCALARS, "R12", "R13")


@dataclass(frozen=True)
class RuleSet:
    """violations: predicates of R02 to R07 (a NULL predicate is no violation); measures: the
    columns of the extrema; key: the columns that R12 and R13 hold unique, NULL equal to NULL."""

    violations: tuple[str, ...]
    measures: tuple[str, str]
    key: tuple[str, ...]

    def predicate(self, rule: str) -> str:
        return "true" if rule == "R01" else self.violations[int(rule[1:]) - 2]

    def counts(self, sign: Column | None = None) -> list[Column]:
        """R01 to R07 as sums of ``sign`` (1 without) over the rows that violate."""
        one = F.lit(1) if sign is None else sign
        return [F.coalesce(F.sum(F.when(F.expr(self.predicate(r)), one).otherwise(0)), F.lit(0)).cast("long").alias(r) for r in COUNTS]

    def extrema(self, where: Column | None = None) -> list[Column]:
        made = []
        for rule, (kind, m) in EXTREMA.items():
            value = F.col(self.measures[m]).cast("double")
            value = value if where is None else F.when(where, value)
            made.append((F.min if kind == "min" else F.max)(value).alias(rule))
        return made

    def scalars(self) -> list[Column]:
        """All eleven scalar metrics of one scan."""
        return [*self.counts(), *self.extrema()]


def metric_type(rule: str) -> str:
    return "DOUBLE" if rule in EXTREMA else "BOOLEAN" if rule == "R13" else "LONG"


def status(rule: str, value: Column) -> Column:
    if rule == "R01" or rule in EXTREMA:
        return F.lit("OBSERVED")
    return F.when(value if rule == "R13" else value == 0, "PASS").otherwise("FAIL")


def display_value() -> Column:
    """A rule row's value as text: doubles with 12 significant digits, as %.12g prints them, NULL as nothing."""
    d = F.col("double_value")
    exact = F.format_string("%.11e", d).cast("decimal(38,16)").cast("string")
    plain = F.regexp_replace(exact, r"\.?0+$", "")
    # below 1e-4 and from 1e12 on the exponent stays
    mantissa = F.regexp_replace(F.format_string("%.11e", d), r"\.?0+e", "e")
    within = (d == 0) | ((F.abs(d) >= 1e-4) & (F.abs(d) < 1e12))
    text = F.when(d.isNull(), None).when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").when(within, F.when(d == 0, "0").otherwise(plain)).otherwise(mantissa)
    return F.coalesce(F.col("long_value").cast("string"), F.col("boolean_value").cast("string"), text, F.lit(""))


def rule_rows(wide: DataFrame, *more: str) -> DataFrame:
    """One row per rule from one row with columns R01 to R13; the columns ``more`` stay."""
    rows = []
    for r in RULES:
        kind = metric_type(r)
        rows.append(F.struct(
            F.lit(r).alias("rule_id"),
            F.lit(kind).alias("metric_type"),
            (F.col(r) if kind == "LONG" else F.lit(None)).cast("long").alias("long_value"),
            (F.col(r) if kind == "DOUBLE" else F.lit(None)).cast("double").alias("double_value"),
            (F.col(r) if kind == "BOOLEAN" else F.lit(None)).cast("boolean").alias("boolean_value"),
            status(r, F.col(r)).alias("status"),
        ))
    return wide.select(F.explode(F.array(*rows)).alias("r"), *more).select("r.*", *more)


#: The driver tables' rule sets.
EVENTS = RuleSet(
    ("event_type IS NULL", "value IS NULL", "value < 0", "user_id < 1", "user_id < 1 OR user_id > 120", "ts IS NULL OR ts < TIMESTAMP '2024-01-01 00:00:00' OR ts > TIMESTAMP '2024-01-31 23:59:59'"),
    ("value", "user_id"),
    ("user_id", "event_type", "value"),
)
LINEITEM = RuleSet(
    ("l_returnflag IS NULL", "l_extendedprice IS NULL", "l_extendedprice < 0", "l_tax > 0.07", "l_quantity < 1 OR l_quantity > 48", "l_shipdate IS NULL OR l_shipdate < TIMESTAMP '1996-01-01 00:00:00'"),
    ("l_extendedprice", "l_discount"),
    ("l_orderkey", "l_linenumber"),
)
CUSTOMER = RuleSet(
    ("c_mktsegment IS NULL", "c_acctbal IS NULL", "c_acctbal < 0", "c_nationkey < 1", "c_nationkey < 0 OR c_nationkey > 20", "c_name IS NULL"),
    ("c_acctbal", "c_nationkey"),
    ("c_nationkey", "c_mktsegment"),
)
