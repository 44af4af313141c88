"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Base counts are taken inside each row: arrays of words and of hashed word triples. In each stratum
the rules have nested levels of strictness: at a level, each rule's cutoff is the least that at
most so many per thousand of the stratum's documents without a label exceed. On labelled good
documents, which had no part in the cutoffs, each level is tested with all its rules together: if
the true rate of false rejections in the stratum were ``risk`` or more, seeing as few as were seen
has a binomial probability, and the level is safe where that is at most ``error`` over the number
of tests (Bonferroni). The strictest safe level is used; a stratum without one has no rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truemark.llm.common import SPACE, columns, written

#: Rules: a count and what it is per thousand of; a document is rejected above the cutoff.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_words"), "repeats": ("n_repeat_words", "n_words")}
#: Documents per thousand that a level's cutoff of one rule rejects at most.
LEVELS = (1, 2, 5, 10, 20, 50, 100, 200)
STRATA = 3


def _covered(windows: Column) -> Column:
    """Words that 3-word windows starting at these sorted positions cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n"), (p + 3).alias("end"))
    return F.aggregate(windows, start, step)["n"]


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    Repeated triples are neighbours in the sorted array of (hash, position), by their whole 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = lambda a, i: F.get(F.col(a), i.cast("int"))
    step = docs.withColumn("_words", F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
    step = step.withColumn("n_words", F.size("_words").cast("long"))
    step = step.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    triples = F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, at("_words", i + 1), at("_words", i + 2)))
    step = step.withColumn("_triples", triples)
    step = step.withColumn("_repeats", F.size("_triples") > F.size(F.array_distinct("_triples")))
    placed = F.transform("_triples", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))
    step = step.withColumn("_placed", F.when(F.col("_repeats"), F.sort_array(placed)))

    def repeated(v: Column, j: Column) -> Column:
        near = lambda k: F.coalesce(at("_placed", k)["h"] == v["h"], F.lit(False))
        return near(j + 1) | F.when(j > 0, near(F.greatest(j - 1, F.lit(0)))).otherwise(F.lit(False))

    windows = F.sort_array(F.transform(F.filter("_placed", repeated), lambda v: v["i"]))
    step = step.withColumn("n_repeat_words", F.when(F.col("_repeats"), _covered(windows)).otherwise(F.lit(0).cast("long")))
    return step.select(
        *columns(docs),
        "n_words",
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def stratum() -> Column:
    """By length: under 200 words, under 1000, longer."""
    return F.when(F.col("n_words") < 200, 0).when(F.col("n_words") < 1000, 1).otherwise(2)


def _rate(rule: str) -> Column:
    """Per thousand, rounded down."""
    top, bottom = RULES[rule]
    return F.expr(f"(1000 * {top}) div greatest({bottom}, 1)")


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series for the gamma function at n + 8, brought back by seven factors."""
    x = n.cast("double") + 8
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return series - reduce(lambda a, k: a + F.log(n + k), range(2, 8), F.log(n + 1))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for k below the mean; 1 above it. Terms fall from k down, so some 12 standard
    deviations of them are enough for any n."""
    first = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    terms = F.least(k, (12 * F.sqrt(n * p) + 50).cast("long"))
    start = F.struct(first.alias("total"), first.alias("term"))

    def add(s: Column, j: Column) -> Column:
        i = k - j + 1
        term = s["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct((s["total"] + term).alias("total"), term.alias("term"))

    summed = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>")), start, add)["total"]
    return F.when(k < n * p, summed).otherwise(F.lit(1.0))


def level_cutoffs(rates: DataFrame) -> DataFrame:
    """stratum, level and each rule's cutoff. ``rates``: stratum and each rule's rate (0 to 1000) of documents."""
    told = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("rate")) for r in RULES)))
    counts = rates.select("stratum", told.alias("t")).groupBy("stratum", "t.rule", "t.rate").agg(F.count(F.lit(1)).alias("n"))  # at most 1001 a stratum and rule
    own = Window.partitionBy("stratum", "rule")
    above = F.coalesce(F.sum("n").over(own.orderBy(F.col("rate").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("stratum", "rule", "rate", above.alias("above"), F.sum("n").over(own).alias("total"))
    levels = placed.select("*", F.explode(F.array(*map(F.lit, LEVELS))).alias("level")).where("above * 1000 <= level * total")
    return levels.groupBy("stratum", "level").agg(*(F.min(F.when(F.col("rule") == r, F.col("rate"))).alias(f"max_{r}") for r in RULES))


def exceeds() -> Column:
    return reduce(lambda a, b: a | b, (F.col(r) > F.col(f"max_{r}") for r in RULES))


def safe_cutoffs(counted: DataFrame, labels: DataFrame, risk: float, error: float) -> DataFrame:
    """At most one row per stratum: the cutoffs of its strictest safe level.

    ``counted`` has doc_id and the base counts; ``labels`` doc_id and quality, 1 for good. Documents
    that fail the base rules don't count; those with any label row have no part in the cutoffs.
    """
    passed = counted.where(~base_failed()).select("doc_id", stratum().alias("stratum"), *(_rate(r).alias(r) for r in RULES))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"))
    told = passed.join(known.withColumnRenamed("doc_id", "_known"), F.col("doc_id") == F.col("_known"), "left")
    cutoffs = level_cutoffs(told.where("_known is null"))
    tried = told.where("good").join(F.broadcast(cutoffs), "stratum")  # at most three strata and eight levels
    maxima = [f"max_{r}" for r in RULES]
    seen = tried.groupBy("stratum", "level", *maxima).agg(F.count(F.lit(1)).alias("n"), F.count_if(exceeds()).alias("k"))
    safe = seen.where(binomial_tail(F.col("n"), F.col("k"), risk) <= error / (STRATA * len(LEVELS)))
    return safe.groupBy("stratum").agg(F.max_by(F.struct(*maxima), "level").alias("m")).select("stratum", "m.*")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed and kept.

    ``risk`` bounds the share of a stratum's good documents that the rules together reject, the
    bounds of all strata together failing with a probability of at most ``error``. A null text has no words and fails the base rules. Repeated
    rows are judged alike; ids may be null; other columns are ignored.
    """
    counted = written(base_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text").drop("_text"), "quality-counts")
    cutoffs = safe_cutoffs(counted, labels, risk, error).withColumnRenamed("stratum", "_stratum")
    ruled = counted.withColumns({"_own": stratum(), **{r: _rate(r) for r in RULES}}).join(F.broadcast(cutoffs), F.col("_own") == F.col("_stratum"), "left")  # at most three rows
    kept = ~base_failed() & ~F.coalesce(exceeds(), F.lit(False))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))
