"""Which states to keep under a storage budget.

A state's net gain is additive: the weighted cost of the rules it answers, less its own recurring
cost, less its build cost spread over the amortisation horizon. So greedy takes states by gain per
byte, skipping those that don't fit, and the oracle tries all subsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rule weights of the validation profiles, R01 to R13.
PROFILES = {
    "BALANCED": [1.0] * 13,
    "ADDITIVE_HEAVY": [10.0] * 7 + [2.0] * 4 + [1.0] * 2,
    "EXTREMA_HEAVY": [2.0] * 7 + [10.0] * 4 + [1.0] * 2,
    "UNIQUENESS_HEAVY": [2.0] * 11 + [20.0] * 2,
    "PRODUCTION_MIXED": [10.0, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0, 4.0, 4.0, 4.0, 4.0, 3.0, 3.0],
}
#: Storage budgets in bytes.
BUDGETS = (0, 32768, 65536, 131072, 262144, 524288, 268435456, 1073741824, 2500000000)
#: Share of inserts, updates and deletes of the workload families, and their sizes.
FAMILIES = {"INSERT_ONLY": (1.0, 0.0, 0.0), "UPDATE_ONLY": (0.0, 1.0, 0.0), "DELETE_ONLY": (0.0, 0.0, 1.0), "MIXED_40I_30U_30D": (0.4, 0.3, 0.3)}
SIZES = (1000, 5000, 20000, 100000)
HORIZON = 1000


def profile_weights(spark) -> DataFrame:
    """profile_id, rule_id, raw_weight, normalized_weight (1 in sum for a profile)."""
    rows = [(p, f"R{i:02d}", w) for p, ws in PROFILES.items() for i, w in enumerate(ws, 1)]
    return normalized(spark.createDataFrame(rows, "profile_id string, rule_id string, raw_weight double"))


def portfolio_gains(states: DataFrame, weights: DataFrame, recurring: Column) -> DataFrame:
    """profile_id, state_id, size_bytes, gain. ``states``: state_id, size_bytes, build_seconds, rules
    (array), cost (seconds a validation without the state); ``recurring``: seconds with it."""
    ruled = states.select("*", F.explode("rules").alias("rule_id")).join(F.broadcast(weights), "rule_id")  # 65 rows
    share = F.sum("normalized_weight")
    net = share * F.first("cost") - share * F.first(recurring) - F.first("build_seconds") / HORIZON
    return ruled.groupBy("profile_id", "state_id", "size_bytes").agg(F.round(net, 12).alias("gain"))


def normalized(weights: DataFrame) -> DataFrame:
    """``weights`` (profile_id, rule, raw_weight) with normalized_weight, 1 in sum for a profile."""
    return weights.withColumn("normalized_weight", F.col("raw_weight") / F.sum("raw_weight").over(Window.partitionBy("profile_id")))


def sane_weights(weights: DataFrame, rules: int = 13) -> DataFrame:
    """profile_id, rules and sane: as many weights as there are rules, which sum to 1."""
    whole = (F.abs(F.sum("normalized_weight") - 1) <= 1e-12) & (F.count(F.lit(1)) == rules)
    return weights.groupBy("profile_id").agg(F.count(F.lit(1)).alias("rules"), whole.alias("sane"))


def oracle(gains: DataFrame, budgets: DataFrame) -> DataFrame:
    """Best subset per profile and budget: gain, then less storage, then fewer states, then by name.

    A profile's states are one array, and a subset is a number whose bits pick from it.
    """
    state = F.struct("state_id", "size_bytes", "gain")
    listed = gains.groupBy("profile_id").agg(F.sort_array(F.collect_list(state)).alias("l"))  # 12 states a profile
    subsets = listed.crossJoin(F.broadcast(gains.sparkSession.range(1 << 12).withColumnRenamed("id", "mask")))  # 4,096 subsets
    inside = subsets.select("profile_id", F.filter("l", lambda s, i: F.col("mask").bitwiseAND(F.pow(F.lit(2.0), i).cast("long")) != 0).alias("s"))
    sums = inside.select(
        "profile_id",
        F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["gain"]), 9).alias("gain"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["size_bytes"]).alias("storage"),
        F.array_join(F.transform("s", lambda x: x["state_id"]), ",").alias("portfolio"),
        F.size("s").alias("n_states"),
    )
    fits = sums.join(F.broadcast(budgets), F.col("storage") <= F.col("budget_bytes"))  # nine budgets
    best = Window.partitionBy("profile_id", "budget_bytes").orderBy(F.col("gain").desc(), "storage", "n_states", "portfolio")
    return fits.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("profile_id", "budget_bytes", "portfolio", "storage", "gain")


def greedy(gains: DataFrame, budgets: DataFrame) -> DataFrame:
    """States by gain per byte (then gain, smaller size, last name), each taken if it still fits."""
    order = F.struct((F.col("gain") / F.col("size_bytes")).alias("density"), F.col("gain").alias("gain"), (F.lit(0) - F.col("size_bytes")).alias("less"), F.col("state_id").alias("i"))
    listed = gains.where("gain > 1e-12").groupBy("profile_id").agg(F.sort_array(F.collect_list(order), asc=False).alias("l"))  # 12 states a profile
    start = F.struct(F.lit(0).cast("long").alias("storage"), F.lit(0.0).alias("gain"), F.array().cast("array<string>").alias("ids"))

    def take(a: Column, x: Column) -> Column:
        fits = a["storage"] - x["less"] <= F.col("budget_bytes")
        return F.struct(F.when(fits, a["storage"] - x["less"]).otherwise(a["storage"]).alias("storage"), F.when(fits, a["gain"] + x["gain"]).otherwise(a["gain"]).alias("gain"), F.when(fits, F.concat(a["ids"], F.array(x["i"]))).otherwise(a["ids"]).alias("ids"))

    filled = listed.crossJoin(F.broadcast(budgets)).withColumn("g", F.aggregate("l", start, take))  # 45 rows
    return filled.select("profile_id", "budget_bytes", F.array_join(F.sort_array("g.ids"), ",").alias("portfolio"), F.col("g.storage").alias("storage"), F.round("g.gain", 9).alias("gain"))


def portfolio_costs(chosen: DataFrame, states: DataFrame, weights: DataFrame, recurring: Column) -> DataFrame:
    """For each chosen portfolio the weighted seconds a validation that it avoids (gross), costs (build
    spread over the horizon, recurring), saves in all (net), and leaves (remaining)."""
    ruled = states.select("*", F.explode("rules").alias("rule_id")).join(F.broadcast(weights), "rule_id")  # 65 rows
    share = F.sum("normalized_weight")
    each = ruled.groupBy("profile_id", "state_id").agg((share * F.first("cost")).alias("gross"), (share * F.first(recurring)).alias("recurring"), (F.first("build_seconds") / HORIZON).alias("amortized"))
    whole = each.groupBy("profile_id").agg(F.sum("gross").alias("whole"))
    held = chosen.select("profile_id", "budget_bytes", F.explode(F.split("portfolio", ",")).alias("state_id")).join(each, ["profile_id", "state_id"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = held.groupBy("profile_id", "budget_bytes").agg(total("gross").alias("gross"), total("recurring").alias("recurring"), total("amortized").alias("amortized")).join(whole, "profile_id")
    net = F.col("gross") - F.col("recurring") - F.col("amortized")
    remaining = F.greatest(F.lit(0.0), F.col("whole") - F.col("gross")) + F.col("recurring") + F.col("amortized")
    return sums.select("profile_id", "budget_bytes", *(F.round(c, 6).alias(c) for c in ("gross", "recurring", "amortized")), F.round(net, 6).alias("net"), F.round(remaining, 6).alias("remaining"))


def oracle_gap(greedy_rows: DataFrame, oracle_rows: DataFrame) -> DataFrame:
    both = greedy_rows.alias("g").join(oracle_rows.alias("o"), ["profile_id", "budget_bytes"])
    gap = F.when(F.abs("o.gain") < 1e-12, 0.0).otherwise(100 * F.greatest(F.col("o.gain") - F.col("g.gain"), F.lit(0.0)) / F.abs("o.gain"))
    return both.groupBy("profile_id").agg(F.count_if(F.abs(F.col("o.gain") - F.col("g.gain")) <= 1e-9).alias("exact_matches"), F.round(F.max(gap), 6).alias("max_gap_percent"), F.round(F.avg(gap), 6).alias("mean_gap_percent"))


def portfolio_shift(chosen: DataFrame) -> DataFrame:
    """States added, removed and kept from one profile to the next at the same budget."""
    own = F.split("portfolio", ",")
    last = F.coalesce(F.split(F.lag("portfolio").over(Window.partitionBy("budget_bytes").orderBy("profile_id")), ","), F.array().cast("array<string>"))
    names = lambda a: F.array_join(F.sort_array(F.array_remove(a, "")), ",")
    return chosen.select("budget_bytes", "profile_id", names(F.array_except(own, last)).alias("added"), names(F.array_except(last, own)).alias("removed"), names(F.array_intersect(own, last)).alias("retained"))
