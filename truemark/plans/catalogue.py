"""The registered queries over the driver tables, each with SQL of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truemark.functions.keys import EVENT_KEY, EVENT_KEY_SQL, OTHER_REST, bucket_id, double_text, partition_id, portable_hash
from truemark.functions.rules import COUNTS, CUSTOMER, EVENTS, EXTREMA, LINEITEM, RULES, SCALARS, RuleSet, display_value, metric_type, rule_rows
from truemark.operators import analyzers as an
from truemark.operators import consolidate as con
from truemark.operators import incremental as inc
from truemark.operators import planner
from truemark.operators import selection as sel
from truemark.sources import files
from truemark.sources.files import fingerprint
from truemark.sources.folders import FolderTable
from truemark.sources.shared import shared_dir
from truemark.sources.stored import Stored, stored
from truemark.sources.versions import event_scenario

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- SQL shared by the oracles

_H = "('0x' || substr(md5({k}), 1, 8))::UBIGINT % {n}"
_P = f"({_H.format(k=EVENT_KEY_SQL, n=64)})::INTEGER"
_B = f"({_H.format(k=EVENT_KEY_SQL, n=256)})::INTEGER"
_COLS = "event_id, ts, user_id, event_type, value, props"

M1 = f"""v0 AS (SELECT {_COLS} FROM events),
v1 AS (SELECT * FROM v0 WHERE NOT (event_id % 101 = 7)),
v2 AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 97 = 5 THEN 'fixed' ELSE event_type END AS event_type,
  CASE WHEN event_id % 97 = 5 THEN (CASE WHEN event_id % 2 = 0 THEN NULL ELSE -value END) ELSE value END AS value, props FROM v1),
v3 AS (SELECT * FROM v2 UNION ALL SELECT event_id + 10000000, ts, user_id, event_type,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN value ELSE value * 100 END, props FROM v0 WHERE event_id % 89 = 3),
v4 AS (SELECT event_id, CASE WHEN event_id >= 10000000 AND event_id % 2 = 0 THEN TIMESTAMP '2035-01-01 00:00:00' ELSE ts END AS ts, user_id, event_type, value, props
  FROM v3 WHERE NOT (event_id < 10000000 AND event_id % 97 = 5 AND event_id % 5 = 0)),
cdf AS (SELECT *, 'delete' AS change_type, 1::BIGINT AS commit_version FROM v0 WHERE event_id % 101 = 7
  UNION ALL SELECT *, 'update_preimage', 2 FROM v1 WHERE event_id % 97 = 5
  UNION ALL SELECT *, 'update_postimage', 2 FROM v2 WHERE event_id % 97 = 5
  UNION ALL SELECT *, 'insert', 3 FROM v3 WHERE event_id >= 10000000
  UNION ALL SELECT *, 'update_preimage', 4 FROM v3 WHERE event_id >= 10000000 AND event_id % 2 = 0
  UNION ALL SELECT *, 'update_postimage', 4 FROM v4 WHERE event_id >= 10000000 AND event_id % 2 = 0
  UNION ALL SELECT *, 'delete', 4 FROM v3 WHERE event_id < 10000000 AND event_id % 97 = 5 AND event_id % 5 = 0),
img AS (SELECT *, 'BASE_IMAGE' AS net_role, -1::BIGINT AS sign FROM v0 WHERE event_id IN (SELECT event_id FROM cdf)
  UNION ALL SELECT *, 'FINAL_IMAGE', 1 FROM v4 WHERE event_id IN (SELECT event_id FROM cdf))"""


def _counts_sql(rules: RuleSet, sign: str = "1") -> str:
    return ", ".join(f"coalesce(sum(CASE WHEN {rules.predicate(r)} THEN {sign} ELSE 0 END), 0)::BIGINT AS {r}" for r in COUNTS)


def _extrema_sql(rules: RuleSet, where: str = "true") -> str:
    return ", ".join(f"{kind}(CASE WHEN {where} THEN {rules.measures[m]} END)::DOUBLE AS {r}" for r, (kind, m) in EXTREMA.items())


def _wide_sql(source: str, rules: RuleSet) -> str:
    key = ", ".join(rules.key)
    return f"""wide AS (SELECT s.*, d.x AS R12, d.x = 0 AS R13 FROM (SELECT {_counts_sql(rules)}, {_extrema_sql(rules)} FROM {source}) s,
(SELECT coalesce(sum(n - 1), 0)::BIGINT AS x FROM (SELECT count(*) AS n FROM {source} GROUP BY {key})) d)"""


def _rows_sql(extra: str = "") -> str:
    parts = []
    for r in RULES:
        kind = metric_type(r)
        passed = "'OBSERVED'" if r == "R01" or r in EXTREMA else f"CASE WHEN {r if r == 'R13' else r + ' = 0'} THEN 'PASS' ELSE 'FAIL' END"
        values = ", ".join(f"{r if kind == k else 'NULL'}::{t} AS {n}" for k, t, n in (("LONG", "BIGINT", "long_value"), ("DOUBLE", "DOUBLE", "double_value"), ("BOOLEAN", "BOOLEAN", "boolean_value")))
        parts.append(f"SELECT '{r}' AS rule_id, '{kind}' AS metric_type, {values}, {passed} AS status{extra.replace('$r', r)} FROM wide")
    return " UNION ALL ".join(parts)


_STATE = f"{_P} AS p, {_counts_sql(EVENTS)}, {_extrema_sql(EVENTS)}"
_DUP = "SELECT count(*)::BIGINT AS distinct_keys, count_if(n > 1)::BIGINT AS duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS duplicate_extra, coalesce(max(n), 0)::BIGINT AS max_multiplicity FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
_EKEY = ", ".join(EVENTS.key)


def _scenario(spark: SparkSession, d: str):
    return event_scenario(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"))


def _stored(spark: SparkSession, d: str) -> Stored:
    return stored(spark, f"{d}/events.parquet", lambda: _scenario(spark, d), EVENTS)


def _images(spark: SparkSession, d: str) -> DataFrame:
    return inc.net_images(_stored(spark, d).feed, "event_id")


# ---------------------------------------------------------------- scans, filters, profiles


@query("scan_projection", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS price_after_discount FROM lineitem")
def scan_projection(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price_after_discount"))


@query("file_provenance", "SELECT 'orders' AS table_name, count(*)::BIGINT AS row_count FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def file_provenance(spark, d):
    named = [table(spark, d, t).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet", 1).alias("table_name")) for t in ("orders", "lineitem")]
    return named[0].unionByName(named[1]).groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))


@query("filter_valid_rows", "SELECT event_id, user_id, value FROM events WHERE event_type IS NOT NULL AND value >= 0 AND user_id BETWEEN 1 AND 120 AND ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-31 23:59:59'")
def filter_valid_rows(spark, d):
    bad = reduce(lambda a, b: a | b, (F.coalesce(F.expr(p), F.lit(False)) for p in EVENTS.violations))
    return table(spark, d, "events").where(~bad).select("event_id", "user_id", "value")


_PROFILED = {"orders": "o_totalprice", "customer": "c_acctbal", "lineitem": "l_extendedprice"}
_NULLS = {"orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"}
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count, min({m})::DOUBLE AS min_value, max({m})::DOUBLE AS max_value, count_if({m} < 0)::BIGINT AS negative_count, ({' + '.join(f'count_if({c} IS NULL)' for c in _NULLS[t].split())})::BIGINT AS null_count FROM {t}"
    for t, m in _PROFILED.items()
)


@query("table_profile", _PROFILE_SQL)
def table_profile(spark, d):
    return reduce(DataFrame.unionByName, (an.profile(table(spark, d, t), t, m) for t, m in _PROFILED.items()))


@query("column_profile", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count_if({c} IS NULL)::BIGINT AS null_count, count({c})::BIGINT AS value_count FROM {t}" for t, cs in _NULLS.items() for c in cs.split()))
def column_profile(spark, d):
    """NULLs and values of each column, a row a column, in one pass."""
    return reduce(DataFrame.unionByName, (an.column_profile(table(spark, d, t), t) for t in _NULLS))


@query("profile_summary", f"SELECT count(*)::BIGINT AS table_count, sum(row_count)::BIGINT AS total_rows, sum(negative_count)::BIGINT AS total_negative, sum(null_count)::BIGINT AS total_nulls FROM ({_PROFILE_SQL})")
def profile_summary(spark, d):
    total = lambda c, n: F.sum(c).cast("long").alias(n)
    return table_profile(spark, d).agg(F.count(F.lit(1)).alias("table_count"), total("row_count", "total_rows"), total("negative_count", "total_negative"), total("null_count", "total_nulls"))


@query("table_verify", f"SELECT count(*)::BIGINT AS row_count, count(DISTINCT user_id)::BIGINT AS distinct_user, count(DISTINCT {_P})::BIGINT AS distinct_partition, count_if(event_id IS NULL)::BIGINT AS null_ids FROM events")
def table_verify(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("user_id").alias("distinct_user"), F.count_distinct(partition_id()).alias("distinct_partition"), F.count_if(F.col("event_id").isNull()).alias("null_ids"))


_RANK = _H.format(k="cast(event_id AS string)", n=1000000)
_SAMPLE = f"SELECT event_id FROM events WHERE {_RANK} < 20000"
_RANKED = f"SELECT event_id, row_number() OVER (ORDER BY {_RANK}, event_id)::BIGINT AS rank FROM ({_SAMPLE})"


@query("hash_sample", _SAMPLE)
def hash_sample(spark, d):
    return table(spark, d, "events").where(portable_hash(F.col("event_id").cast("string"), 1_000_000) < 20_000).select("event_id")


@query("candidate_rank", _RANKED)
def candidate_rank(spark, d):
    """Global ranks without one task: ranks within hash ranges plus the counts of the ranges before."""
    return _ranked(hash_sample(spark, d))


def _ranked(sample: DataFrame) -> DataFrame:
    h = portable_hash(F.col("event_id").cast("string"), 1_000_000)
    rows = sample.withColumn("h", h).withColumn("part", F.floor(F.col("h") / 100).cast("int"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 200 parts
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("h", "event_id"))
    return rows.join(parts, "part").select("event_id", (F.col("before") + within).cast("long").alias("rank"))


@query("rank_slice", f"SELECT * FROM ({_RANKED}) WHERE rank BETWEEN 11 AND 60")
def rank_slice(spark, d):
    return candidate_rank(spark, d).where("rank BETWEEN 11 AND 60")


_CLEAN = f"""WITH st AS (SELECT {_P} AS p, {_extrema_sql(EVENTS)} FROM events GROUP BY 1), dup AS (SELECT {_EKEY} FROM events GROUP BY ALL HAVING count(*) > 1),
e AS (SELECT *, {_P} AS p FROM events)
SELECT e.event_id FROM e JOIN st ON e.p = st.p WHERE event_type IS NOT NULL AND value > R08 AND value < R09 AND value >= 0 AND user_id > R10 AND user_id < R11 AND user_id BETWEEN 1 AND 120
AND NOT EXISTS (SELECT 1 FROM dup WHERE dup.user_id IS NOT DISTINCT FROM e.user_id AND dup.event_type IS NOT DISTINCT FROM e.event_type AND dup.value IS NOT DISTINCT FROM e.value)"""


@query("clean_candidates", _CLEAN)
def clean_candidates(spark, d):
    """Valid rows with a unique key, strictly inside the extrema of their partition."""
    e = table(spark, d, "events")
    state = e.groupBy(partition_id().alias("p")).agg(*EVENTS.extrema())
    inside = e.withColumn("p", partition_id()).join(F.broadcast(state), "p")  # 64 rows
    inside = inside.where("event_type IS NOT NULL AND value > R08 AND value < R09 AND value >= 0 AND user_id > R10 AND user_id < R11 AND user_id BETWEEN 1 AND 120")
    dup = e.groupBy(*EVENTS.key).count().where("count > 1")
    return inside.alias("l").join(dup.alias("r"), inc._same_key("l", "r", EVENTS.key), "left_anti").select("event_id")


@query("unique_extreme", """WITH u AS (SELECT o_totalprice AS v, min(o_orderkey) AS k FROM orders GROUP BY 1 HAVING count(*) = 1)
SELECT * FROM (SELECT 'min' AS side, k AS o_orderkey, v AS o_totalprice FROM u ORDER BY v, k LIMIT 1) UNION ALL SELECT * FROM (SELECT 'max', k, v FROM u ORDER BY v DESC, k LIMIT 1)""")
def unique_extreme(spark, d):
    """The smallest and largest price that one order alone has; limits are the feature here."""
    once = table(spark, d, "orders").groupBy("o_totalprice").agg(F.min("o_orderkey").alias("o_orderkey"), F.count(F.lit(1)).alias("n")).where("n = 1")
    side = lambda name, *order: once.orderBy(*order).limit(1).select(F.lit(name).alias("side"), "o_orderkey", "o_totalprice")
    return side("min", "o_totalprice", "o_orderkey").unionByName(side("max", F.col("o_totalprice").desc(), "o_orderkey"))


@query("duplicate_group_rows", """WITH k AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 1)
SELECT l.l_orderkey, l.l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem l JOIN k ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber""")
def duplicate_group_rows(spark, d):
    li = table(spark, d, "lineitem")
    first = li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").orderBy("l_orderkey", "l_linenumber").limit(1)
    return li.join(F.broadcast(first), ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")  # one row


# ---------------------------------------------------------------- full validation and states


def _full_additive(t: str, rules: RuleSet) -> str:
    return f"SELECT '{t}' AS table_name, {_counts_sql(rules)} FROM {t}"


@query("full_additive", f"{_full_additive('customer', CUSTOMER)} UNION ALL {_full_additive('events', EVENTS)}")
def full_additive(spark, d):
    return reduce(DataFrame.unionByName, (table(spark, d, t).agg(*r.counts()).select(F.lit(t).alias("table_name"), "*") for t, r in (("customer", CUSTOMER), ("events", EVENTS))))


@query("full_validation_scalar", f"SELECT {_counts_sql(LINEITEM)}, {_extrema_sql(LINEITEM)} FROM lineitem")
def full_validation_scalar(spark, d):
    return table(spark, d, "lineitem").agg(*LINEITEM.scalars())


@query("duplicate_metrics", _DUP.format(t="lineitem", k="l_orderkey, l_linenumber"))
def duplicate_metrics(spark, d):
    return inc.duplicate_metrics(table(spark, d, "lineitem").groupBy(*LINEITEM.key).agg(F.count(F.lit(1)).alias("frequency")))


for _t, _r in (("events", EVENTS), ("lineitem", LINEITEM), ("customer", CUSTOMER)):
    query(f"full_validation_{_t}", f"WITH {_wide_sql(_t, _r)} {_rows_sql()}")(lambda spark, d, t=_t, r=_r: rule_rows(inc.full_validation(table(spark, d, t), r)))


@query("partition_state", f"SELECT {_STATE} FROM events GROUP BY 1")
def partition_state(spark, d):
    return inc.partition_state(table(spark, d, "events"), EVENTS)


@query("stored_state", f"WITH {M1} SELECT (SELECT count(*) FROM cdf)::BIGINT AS feed_rows, (SELECT count(*) FROM v4)::BIGINT AS end_rows, (SELECT count(DISTINCT {_P}) FROM v0)::BIGINT AS partitions, (SELECT count(*) FROM (SELECT DISTINCT {_EKEY} FROM v0))::BIGINT AS keys")
def stored_state(spark, d):
    """Builds what the incremental queries read, once a session, and counts it."""
    kept = _stored(spark, d)
    sizes = {"feed_rows": kept.feed, "end_rows": kept.end, "partitions": kept.state, "keys": kept.keys}
    return reduce(DataFrame.crossJoin, (t.agg(F.count(F.lit(1)).alias(n)) for n, t in sizes.items()))  # one row each


@query("partition_state_rollup", f"SELECT {_counts_sql(EVENTS)}, {_extrema_sql(EVENTS)} FROM events")
def partition_state_rollup(spark, d):
    return inc.roll_up(partition_state(spark, d))


@query("key_frequency_state", f"SELECT {_B} AS b, {_EKEY}, count(*)::BIGINT AS frequency FROM events GROUP BY ALL")
def key_frequency_state(spark, d):
    return inc.key_frequency(table(spark, d, "events"), EVENTS)


@query("state_consolidate", f"SELECT {_STATE} FROM events GROUP BY 1")
def state_consolidate(spark, d):
    """Eleven state tables, stored one by one, folded into one and held against the roll-up of the whole."""
    state = _stored(spark, d).state
    return con.consolidated(con.store_states(state), inc.roll_up(state))


def _trial_seconds(spark, d) -> DataFrame:
    """One row: the median seconds of the trials of a scalar scan (F), a key count (O) and a key-state update (P)."""
    named = {"scan": "F", "count": "O", "recurring": "P"}
    return _trials(spark, d).agg(*(F.round(F.median(F.when(F.col("method") == m, F.col("seconds"))), 6).alias(n) for n, m in named.items()))


def _build_seconds(spark, d) -> DataFrame:
    """state_id and the median seconds of the trials that built it: customers are the trials, nations name the states, balances the seconds."""
    state = F.concat(F.lit("S"), F.lpad((F.col("c_nationkey") % 12 + 1).cast("string"), 2, "0"))
    return table(spark, d, "customer").groupBy(state.alias("state_id")).agg(F.round(F.median(F.abs("c_acctbal")), 6).alias("build_seconds"))


def _states(spark, d) -> DataFrame:
    """The state catalogue of the events table: logical bytes as stored, medians of trials as costs.

    A state's logical bytes are those of its rows as text: partition and value, or key and frequency.
    """
    kept = _stored(spark, d)
    text = lambda r: f"coalesce(length({double_text(r) if r in EXTREMA else f'cast({r} AS string)'}), 1)"
    scalars = kept.state.agg(*(F.sum(F.expr(f"length(cast(p AS string)) + {text(r)} + 2")).cast("long").alias(f"S{r[1:]}") for r in SCALARS))
    keyed = kept.keys.agg(F.sum(F.expr(f"length({EVENT_KEY}) + length(cast(frequency AS string)) + 2")).cast("long").alias("S12"))
    one = scalars.crossJoin(keyed).crossJoin(_trial_seconds(spark, d))  # one row each
    family = lambda i: "ADDITIVE" if i < 8 else "PARTITION_EXTREMA" if i < 12 else "KEY_FREQUENCY"
    rows = [F.struct(F.lit(f"S{i:02d}").alias("state_id"), F.lit(family(i)).alias("state_family"), F.coalesce(f"S{i:02d}", F.lit(0)).cast("long").alias("size_bytes"), F.array(*(F.lit(r) for r in ([f"R{i:02d}"] if i < 12 else ["R12", "R13"]))).alias("rules"), F.col("scan" if i < 12 else "count").alias("cost"), (F.lit(0.0) if i < 12 else F.col("recurring")).alias("recurring")) for i in range(1, 13)]
    listed = one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return listed.join(F.broadcast(_build_seconds(spark, d)), "state_id", "left").fillna(0.0, ["build_seconds"])  # twelve rows


_TEXT = {r: double_text(r, OTHER_REST) if r in EXTREMA else f"{r}::VARCHAR" for r in SCALARS}
_SIZES_SQL = " UNION ALL ".join(f"SELECT {i} AS i, sum(length(p::VARCHAR) + coalesce(length({_TEXT[r]}), 1) + 2)::BIGINT AS size_bytes FROM st0" for i, r in enumerate(SCALARS, 1))
_STATES_SQL = f"""st0 AS (SELECT {_STATE} FROM events GROUP BY 1), kf0 AS (SELECT {_EKEY}, count(*) AS n FROM events GROUP BY {_EKEY}),
sizes AS ({_SIZES_SQL} UNION ALL SELECT 12, sum(length({EVENT_KEY_SQL}) + length(n::VARCHAR) + 2)::BIGINT FROM kf0),
sec AS (SELECT {', '.join(f"round(median(o_totalprice) FILTER (WHERE o_orderstatus = '{m}'), 6) AS {n}_s" for n, m in (('scan', 'F'), ('count', 'O'), ('recurring', 'P')))} FROM orders),
built AS (SELECT c_nationkey % 12 + 1 AS i, round(median(abs(c_acctbal)), 6) AS build_seconds FROM customer GROUP BY 1),
states AS (SELECT 'S' || lpad(sizes.i::VARCHAR, 2, '0') AS state_id, CASE WHEN sizes.i < 8 THEN 'ADDITIVE' WHEN sizes.i < 12 THEN 'PARTITION_EXTREMA' ELSE 'KEY_FREQUENCY' END AS state_family,
 size_bytes, coalesce(build_seconds, 0) AS build_seconds, CASE WHEN sizes.i < 12 THEN scan_s ELSE count_s END AS cost, CASE WHEN sizes.i < 12 THEN 0.0::DOUBLE ELSE recurring_s END AS recurring, sizes.i AS i FROM sizes CROSS JOIN sec LEFT JOIN built ON built.i = sizes.i)"""
_W = ", ".join(f"('{p}', {i}, {w}::DOUBLE)" for p, ws in sel.PROFILES.items() for i, w in enumerate(ws, 1))
_WEIGHTS_SQL = f"w AS (SELECT profile_id, i AS rule, raw_weight, raw_weight / sum(raw_weight) OVER (PARTITION BY profile_id) AS nw FROM (VALUES {_W}) t(profile_id, i, raw_weight))"
_GAINS_SQL = f"""{_STATES_SQL}, {_WEIGHTS_SQL}, gains AS (SELECT profile_id, state_id, size_bytes,
 round(sum(nw) * any_value(cost) - sum(nw) * any_value(recurring) - any_value(build_seconds) / 1000, 12) AS gain
 FROM states JOIN w ON w.rule = states.i OR (states.i = 12 AND w.rule = 13) GROUP BY ALL)"""
_BUDGETS_SQL = f"b AS (SELECT unnest([{', '.join(map(str, sel.BUDGETS))}])::BIGINT AS budget_bytes)"
_ORACLE_SQL = f"""sums AS (SELECT profile_id, mask, round(coalesce(sum(gain) FILTER (WHERE inside), 0), 9) AS gain, coalesce(sum(size_bytes) FILTER (WHERE inside), 0)::BIGINT AS storage,
 coalesce(string_agg(state_id, ',' ORDER BY state_id) FILTER (WHERE inside), '') AS portfolio, count_if(inside) AS n FROM (SELECT g.*, mask, ((mask >> (substr(state_id, 2)::BIGINT - 1)) & 1) = 1 AS inside FROM gains g, range(4096) r(mask)) GROUP BY 1, 2),
best AS (SELECT profile_id, budget_bytes, portfolio, storage, gain FROM sums JOIN b ON storage <= budget_bytes QUALIFY row_number() OVER (PARTITION BY profile_id, budget_bytes ORDER BY gain DESC, storage, n, portfolio) = 1)"""


@query("state_catalog_summary", f"WITH {_STATES_SQL} SELECT state_family, count(*)::BIGINT AS states, sum(size_bytes)::BIGINT AS bytes, round(sum(build_seconds), 6) AS build_seconds FROM states GROUP BY 1")
def state_catalog_summary(spark, d):
    return _states(spark, d).groupBy("state_family").agg(F.count(F.lit(1)).alias("states"), F.sum("size_bytes").cast("long").alias("bytes"), F.round(F.sum("build_seconds"), 6).alias("build_seconds"))


def _gains(spark, d) -> DataFrame:
    return sel.portfolio_gains(_states(spark, d), sel.profile_weights(spark), F.col("recurring"))


def _budgets(spark) -> DataFrame:
    return spark.createDataFrame([(b,) for b in sel.BUDGETS], "budget_bytes long")


@query("portfolio_eval", f"WITH {_GAINS_SQL} SELECT profile_id, state_id, size_bytes, round(gain, 6) AS gain FROM gains")
def portfolio_eval(spark, d):
    return _gains(spark, d).withColumn("gain", F.round("gain", 6))


@query("oracle_select", f"WITH {_GAINS_SQL}, {_BUDGETS_SQL}, {_ORACLE_SQL} SELECT profile_id, budget_bytes, portfolio, storage, round(gain, 6) AS gain FROM best")
def oracle_select(spark, d):
    return sel.oracle(_gains(spark, d), _budgets(spark)).withColumn("gain", F.round("gain", 6))


_GREEDY_SQL = """ranked AS (SELECT profile_id, state_id, size_bytes, gain, row_number() OVER (PARTITION BY profile_id ORDER BY gain / size_bytes DESC, gain DESC, size_bytes, state_id DESC) AS k FROM gains WHERE gain > 1e-12),
walk AS (SELECT profile_id, budget_bytes, 0::BIGINT AS k, 0::BIGINT AS storage, 0.0::DOUBLE AS gain, []::VARCHAR[] AS ids FROM (SELECT DISTINCT profile_id FROM ranked), b
 UNION ALL SELECT w.profile_id, budget_bytes, r.k, CASE WHEN storage + size_bytes <= budget_bytes THEN storage + size_bytes ELSE storage END,
  CASE WHEN storage + size_bytes <= budget_bytes THEN w.gain + r.gain ELSE w.gain END, CASE WHEN storage + size_bytes <= budget_bytes THEN list_append(ids, r.state_id) ELSE ids END
 FROM walk w JOIN ranked r ON r.profile_id = w.profile_id AND r.k = w.k + 1),
greedy AS (SELECT profile_id, budget_bytes, list_sort(ids) AS ids, storage, round(gain, 9) AS gain FROM walk QUALIFY row_number() OVER (PARTITION BY profile_id, budget_bytes ORDER BY k DESC) = 1)"""
_CHOICES = f"WITH RECURSIVE {_GAINS_SQL}, {_BUDGETS_SQL}, {_GREEDY_SQL}"


@query("greedy_select", f"{_CHOICES} SELECT profile_id, budget_bytes, array_to_string(ids, ',') AS portfolio, storage, gain FROM greedy")
def greedy_select(spark, d):
    return sel.greedy(_gains(spark, d), _budgets(spark))


@query("portfolio_costs", f"""{_CHOICES}, each AS (SELECT profile_id, state_id, sum(nw) * any_value(cost) AS gross, sum(nw) * any_value(recurring) AS recurring, any_value(build_seconds) / 1000 AS amortized
 FROM states JOIN w ON w.rule = states.i OR (states.i = 12 AND w.rule = 13) GROUP BY ALL), whole AS (SELECT profile_id, sum(gross) AS whole FROM each GROUP BY 1),
sums AS (SELECT g.profile_id, g.budget_bytes, coalesce(sum(gross), 0) AS gross, coalesce(sum(recurring), 0) AS recurring, coalesce(sum(amortized), 0) AS amortized FROM greedy g LEFT JOIN each e ON e.profile_id = g.profile_id AND list_contains(g.ids, e.state_id) GROUP BY 1, 2)
SELECT s.profile_id, budget_bytes, round(gross, 6) AS gross, round(recurring, 6) AS recurring, round(amortized, 6) AS amortized, round(gross - recurring - amortized, 6) AS net, round(greatest(0, whole - gross) + recurring + amortized, 6) AS remaining FROM sums s JOIN whole ON whole.profile_id = s.profile_id""")
def portfolio_costs(spark, d):
    """Gross, net and remaining cost of the portfolios that greedy chooses."""
    return sel.portfolio_costs(greedy_select(spark, d), _states(spark, d), sel.profile_weights(spark), F.col("recurring"))


@query("oracle_gap", f"""{_CHOICES}, {_ORACLE_SQL} SELECT g.profile_id, count_if(abs(o.gain - g.gain) <= 1e-9)::BIGINT AS exact_matches, round(max(gap), 6) AS max_gap_percent, round(avg(gap), 6) AS mean_gap_percent
 FROM greedy g JOIN best o USING (profile_id, budget_bytes), LATERAL (SELECT CASE WHEN abs(o.gain) < 1e-12 THEN 0.0::DOUBLE ELSE 100 * greatest(o.gain - g.gain, 0) / abs(o.gain) END AS gap) GROUP BY 1""")
def oracle_gap(spark, d):
    return sel.oracle_gap(greedy_select(spark, d), sel.oracle(_gains(spark, d), _budgets(spark)))


@query("portfolio_shift", f"""{_CHOICES}, l AS (SELECT *, coalesce(lag(ids) OVER (PARTITION BY budget_bytes ORDER BY profile_id), []) AS before FROM greedy WHERE budget_bytes IN (65536, 262144))
SELECT budget_bytes, profile_id, array_to_string(list_filter(ids, lambda x: NOT list_contains(before, x)), ',') AS added, array_to_string(list_filter(before, lambda x: NOT list_contains(ids, x)), ',') AS removed, array_to_string(list_filter(ids, lambda x: list_contains(before, x)), ',') AS retained FROM l""")
def portfolio_shift(spark, d):
    return sel.portfolio_shift(greedy_select(spark, d).where("budget_bytes IN (65536, 262144)"))


@query("profile_weights", f"WITH {_STATES_SQL}, {_WEIGHTS_SQL} SELECT profile_id, 'R' || lpad(rule::VARCHAR, 2, '0') AS rule_id, raw_weight, round(nw, 12) AS normalized_weight, round(nw * (SELECT max(cost) FROM states WHERE i = least(rule, 12)), 9) AS weighted_cost FROM w")
def profile_weights(spark, d):
    cost = _states(spark, d).select(F.explode("rules").alias("rule_id"), "cost")
    weighted = sel.profile_weights(spark).join(F.broadcast(cost), "rule_id")  # 13 rows
    return weighted.select("profile_id", "rule_id", "raw_weight", F.round("normalized_weight", 12).alias("normalized_weight"), F.round(F.col("normalized_weight") * F.col("cost"), 9).alias("weighted_cost"))


@query("budget_matrix", f"WITH {_STATES_SQL}, {_BUDGETS_SQL} SELECT budget_bytes, (SELECT size_bytes FROM states WHERE i = 12) <= budget_bytes AS fits_key_state, (SELECT sum(size_bytes) FROM states) <= budget_bytes AS fits_all FROM b")
def budget_matrix(spark, d):
    sizes = _states(spark, d).agg(F.max(F.when(F.col("state_id") == "S12", F.col("size_bytes"))).alias("k"), F.sum("size_bytes").alias("a"))
    return _budgets(spark).crossJoin(sizes).select("budget_bytes", (F.col("k") <= F.col("budget_bytes")).alias("fits_key_state"), (F.col("a") <= F.col("budget_bytes")).alias("fits_all"))  # nine rows, one row


_FAM = ", ".join(f"('{f}', {a}::DOUBLE, {u}::DOUBLE)" for f, (a, u, _) in sel.FAMILIES.items())


@query("workload_matrix", f"""WITH f AS (SELECT * FROM (VALUES {_FAM}) t(family, fi, fu)), s AS (SELECT unnest([{', '.join(map(str, sel.SIZES))}])::BIGINT AS operations),
x AS (SELECT family, operations, floor(operations * fi)::BIGINT AS inserts, floor(operations * fu)::BIGINT AS updates FROM f, s)
SELECT family, operations, inserts, updates, operations - inserts - updates AS deletes, inserts + 2 * updates + (operations - inserts - updates) AS cdf_rows,
 (SELECT count(*) FROM events) + inserts - (operations - inserts - updates) AS expected_rows FROM x""")
def workload_matrix(spark, d):
    families = spark.createDataFrame([(f, a, u) for f, (a, u, _) in sel.FAMILIES.items()], "family string, fi double, fu double")
    sizes = spark.createDataFrame([(s,) for s in sel.SIZES], "operations long")
    rows = table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))
    x = families.crossJoin(sizes).crossJoin(rows).withColumn("inserts", F.floor(F.col("operations") * F.col("fi"))).withColumn("updates", F.floor(F.col("operations") * F.col("fu")))  # 16 rows
    x = x.withColumn("deletes", F.col("operations") - F.col("inserts") - F.col("updates"))
    return x.select("family", "operations", "inserts", "updates", "deletes", (F.col("inserts") + 2 * F.col("updates") + F.col("deletes")).alias("cdf_rows"), (F.col("n") + F.col("inserts") - F.col("deletes")).alias("expected_rows"))


# ---------------------------------------------------------------- versions and the change feed

_SNAP = ["event_id", "ts", "user_id", "event_type", "value"]
for _v in range(5):
    query(f"snapshot_v{_v}", f"WITH {M1} SELECT {', '.join(_SNAP)} FROM v{_v}")(lambda spark, d, v=_v: _scenario(spark, d).snapshot(v).select(*_SNAP))


@query("time_travel_count", f"WITH {M1} " + " UNION ALL ".join(f"SELECT {v}::BIGINT AS version, count(*)::BIGINT AS row_count FROM v{v}" for v in range(5)))
def time_travel_count(spark, d):
    return _scenario(spark, d).history().select("version", "row_count")


@query("table_history", f"WITH {M1}, n AS (" + " UNION ALL ".join(f"SELECT {v}::BIGINT AS version, '{o}' AS operation, (SELECT count(*) FROM v{v})::BIGINT AS row_count" for v, o in enumerate(("LOAD", "DELETE", "UPDATE", "INSERT", "UPDATE_DELETE"))) + ") SELECT n.*, (SELECT count(*) FROM cdf WHERE commit_version = version)::BIGINT AS change_count FROM n")
def table_history(spark, d):
    return _scenario(spark, d).history()


_AUDIT = "count_if(change_type = '{k}')::BIGINT"


@query("commit_audit", f"""WITH {M1}, n AS ({' UNION ALL '.join(f'SELECT {v}::BIGINT AS version, (SELECT count(*) FROM v{v})::BIGINT - (SELECT count(*) FROM v{v - 1})::BIGINT AS row_delta' for v in range(1, 5))})
SELECT n.version, any_value(row_delta) AS row_delta, {_AUDIT.format(k='insert')} AS inserts, {_AUDIT.format(k='update_preimage')} AS updates, {_AUDIT.format(k='delete')} AS deletes,
 count_if(change_type = 'insert') - count_if(change_type = 'delete') = any_value(row_delta) AND count_if(change_type = 'update_preimage') = count_if(change_type = 'update_postimage') AS as_expected FROM n JOIN cdf ON commit_version = n.version GROUP BY 1""")
def commit_audit(spark, d):
    """Each commit's change rows against the change of its snapshot's row count; images of updates come in pairs."""
    counts = time_travel_count(spark, d).withColumn("row_delta", F.col("row_count") - F.lag("row_count").over(Window.orderBy("version"))).where("version > 0")  # five rows
    kinds = {"inserts": "insert", "updates": "update_preimage", "_post": "update_postimage", "deletes": "delete"}
    seen = _stored(spark, d).feed.groupBy(F.col("_commit_version").alias("version")).agg(*(F.count_if(F.col("_change_type") == k).alias(n) for n, k in kinds.items()))
    expected = (F.col("inserts") - F.col("deletes") == F.col("row_delta")) & (F.col("updates") == F.col("_post"))
    return counts.join(seen, "version").select("version", "row_delta", "inserts", "updates", "deletes", expected.alias("as_expected"))


@query("cdf_scan", f"WITH {M1} SELECT event_id, change_type, commit_version FROM cdf")
def cdf_scan(spark, d):
    return _scenario(spark, d).changes(1, 4).select("event_id", F.col("_change_type").alias("change_type"), F.col("_commit_version").alias("commit_version"))


@query("cdf_counts", f"WITH {M1} SELECT commit_version, change_type, count(*)::BIGINT AS n FROM cdf GROUP BY 1, 2")
def cdf_counts(spark, d):
    return inc.cdf_counts(_scenario(spark, d).changes(1, 4))


@query("cdf_row_bounds", f"WITH {M1} SELECT event_id, min(commit_version) AS first_version, max(commit_version) AS last_version FROM cdf GROUP BY 1")
def cdf_row_bounds(spark, d):
    return inc.row_bounds(_scenario(spark, d).changes(1, 4), "event_id")


@query("cdf_net_images", f"WITH {M1} SELECT event_id, net_role, sign, value FROM img")
def cdf_net_images(spark, d):
    return _images(spark, d).select("event_id", "net_role", "sign", "value")


@query("changed_final_images", f"WITH {M1} SELECT event_id, value FROM img WHERE sign = 1")
def changed_final_images(spark, d):
    return inc.final_images(_scenario(spark, d).changes(1, 4), "event_id").select("event_id", "value")


@query("cdf_guard", f"WITH {M1} SELECT (SELECT count(*) FROM (SELECT 1 FROM img GROUP BY event_id, sign HAVING count(*) > 1))::BIGINT AS duplicate_roles, 0::BIGINT AS negative_states, (SELECT count(*) FROM v4)::BIGINT AS frequency_sum")
def cdf_guard(spark, d):
    """Invariants: one image per row and role, no negative count, frequencies sum to the rows."""
    kept, images = _stored(spark, d), _images(spark, d)
    state = inc.maintained_state(kept.state, images, kept.end, EVENTS)
    twice = images.groupBy("event_id", "sign").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_roles"))
    negative = state.where(reduce(lambda a, b: a | b, (F.col(r) < 0 for r in COUNTS))).agg(F.count(F.lit(1)).alias("negative_states"))
    keys = inc.compacted(kept.keys, inc.key_overlay(kept.keys, inc.key_delta(images, EVENTS), EVENTS), EVENTS)
    return twice.crossJoin(negative).crossJoin(keys.agg(F.sum("frequency").cast("long").alias("frequency_sum")))  # one row each


def _folder_table(spark, d) -> FolderTable:
    """The events as a table in folders, with the scenario's four commits executed; made once a session."""
    base = table(spark, d, "events").select(*_COLS.split(", "))
    place = (spark.sparkContext.applicationId, shared_dir(spark), fingerprint(spark, f"{d}/events.parquet"))
    if place not in _made:
        t = FolderTable.create(base, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}", "event_id", partition_id())
        e = F.col("event_id")
        t.delete(e % 101 == 7)
        t.update(e % 97 == 5, {"event_type": F.lit("fixed"), "value": F.when(e % 2 == 0, F.lit(None)).otherwise(-F.col("value"))})
        value = F.when(e % 3 == 0, F.lit(None)).when(e % 3 == 1, F.col("value")).otherwise(F.col("value") * 100)
        t.insert(base.where(e % 89 == 3).withColumn("value", value).withColumn("event_id", e + 10_000_000))
        late = t.rows().where((e >= 10_000_000) & (e % 2 == 0)).withColumn("ts", F.lit("2035-01-01 00:00:00").cast("timestamp_ntz")).withColumn("op", F.lit("UPDATE"))
        t.merge(late.unionByName(t.rows().where((e < 10_000_000) & (e % 97 == 5) & (e % 5 == 0)).withColumn("op", F.lit("DELETE"))))
        _made[place] = t
    return _made[place]


_made: dict[tuple[str, str, str], FolderTable] = {}

for _n, _v in (("dml_delete", 1), ("dml_update", 2), ("dml_insert", 3), ("dml_scenario", 4)):
    query(_n, f"WITH {M1} SELECT event_id, user_id, event_type, value FROM v{_v}")(lambda spark, d, v=_v: _folder_table(spark, d).as_of(v).select("event_id", "user_id", "event_type", "value"))


@query("folder_history", f"WITH {M1}, n AS (" + " UNION ALL ".join(f"SELECT {v}::BIGINT AS version, '{o}' AS operation, (SELECT count(*) FROM v{v})::BIGINT AS row_count" for v, o in enumerate(("LOAD", "DELETE", "UPDATE", "INSERT", "MERGE"))) + ") SELECT n.*, (SELECT count(*) FROM cdf WHERE commit_version = version)::BIGINT AS change_count FROM n")
def folder_history(spark, d):
    """Operations and counts of the commits executed on the table in folders, from its log."""
    return _folder_table(spark, d).history()


@query("folder_detail", f"WITH {M1} SELECT count(*)::BIGINT AS row_count, count(DISTINCT {_P})::BIGINT AS partitions, true AS sized, 'event_id' AS row_key, '4' AS version FROM v4")
def folder_detail(spark, d):
    """Rows, partitions, properties and whether files have a size; SQL knows no files, so these come as a check."""
    sized = (F.col("files") >= F.col("partitions")) & (F.col("size_bytes") > 0)
    return _folder_table(spark, d).detail().select("row_count", "partitions", sized.alias("sized"), F.col("properties")["row_key"].alias("row_key"), F.col("properties")["version"].alias("version"))


_OPS = "CASE WHEN event_id % 50 = 1 THEN 'DELETE' WHEN event_id % 50 = 2 THEN 'UPDATE' ELSE 'INSERT' END"
_SOURCE = f"SELECT CASE WHEN event_id % 50 = 3 THEN event_id + 20000000 ELSE event_id END AS event_id, ts, user_id, event_type, CASE WHEN event_id % 50 = 2 THEN value + 1 ELSE value END AS value, props, {_OPS} AS op FROM events WHERE event_id % 50 IN (1, 2, 3)"


@query("merge_source", f"SELECT event_id, op, value FROM ({_SOURCE})")
def merge_source(spark, d):
    return _merge_source(spark, d).select("event_id", "op", "value")


def _merge_source(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_id % 50 IN (1, 2, 3)").withColumn("op", F.expr(_OPS))
    return e.withColumn("value", F.expr("CASE WHEN op = 'UPDATE' THEN value + 1 ELSE value END")).withColumn("event_id", F.expr("CASE WHEN op = 'INSERT' THEN event_id + 20000000 ELSE event_id END"))


@query("dml_merge", f"WITH s AS ({_SOURCE}) SELECT event_id, user_id, event_type, value FROM events WHERE event_id NOT IN (SELECT event_id FROM s) UNION ALL SELECT event_id, user_id, event_type, value FROM s WHERE op <> 'DELETE'")
def dml_merge(spark, d):
    base = table(spark, d, "events").select(*_COLS.split(", "))
    t = FolderTable.create(base, f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}", "event_id", partition_id())
    # a row to be changed is meant where it lies
    source = _merge_source(spark, d)
    at = table(spark, d, "events").where("event_id % 50 IN (1, 2)").select(F.col("event_id").alias("_id"), partition_id().alias("p"))
    t.merge(source.join(at, F.col("event_id") == F.col("_id"), "left").drop("_id"))
    return t.rows().select("event_id", "user_id", "event_type", "value")


# ---------------------------------------------------------------- incremental maintenance


@query("incremental_additive", f"WITH {M1} SELECT {_counts_sql(EVENTS)} FROM v4")
def incremental_additive(spark, d):
    delta, state = inc.additive_delta(_images(spark, d), EVENTS), _stored(spark, d).state
    return state.select(*COUNTS).unionByName(delta.select(*COUNTS)).agg(*[F.sum(r).cast("long").alias(r) for r in COUNTS])


@query("affected_partitions", f"WITH {M1} SELECT DISTINCT {_P} AS p FROM img")
def affected_partitions(spark, d):
    return inc.affected_partitions(_images(spark, d))


@query("extrema_positive_candidates", f"WITH {M1} SELECT {_P} AS p, {_extrema_sql(EVENTS, 'sign = 1')} FROM img GROUP BY 1")
def extrema_positive_candidates(spark, d):
    return inc.positive_candidates(_images(spark, d), EVENTS)


_INVALID = f"""st AS (SELECT {_P} AS p, {_extrema_sql(EVENTS)} FROM v0 GROUP BY 1), gone AS (SELECT {_P} AS p, value, user_id FROM img WHERE sign = -1),
inv AS (SELECT gone.p, {', '.join(f'bool_or(coalesce(gone.{EVENTS.measures[m]} = st.{r}, false)) AS {r}' for r, (_, m) in EXTREMA.items())} FROM gone JOIN st ON gone.p = st.p GROUP BY 1)"""


@query("extrema_invalidation", f"WITH {M1}, {_INVALID} SELECT * FROM inv")
def extrema_invalidation(spark, d):
    return inc.extrema_invalidation(_images(spark, d), _stored(spark, d).state, EVENTS)


@query("extrema_recompute", f"WITH {M1}, {_INVALID} SELECT {_P} AS p, {_extrema_sql(EVENTS)} FROM v4 WHERE {_P} IN (SELECT p FROM inv WHERE R08 OR R09 OR R10 OR R11) GROUP BY 1")
def extrema_recompute(spark, d):
    kept = _stored(spark, d)
    return inc.recompute(kept.end, inc.extrema_invalidation(_images(spark, d), kept.state, EVENTS), EVENTS)


@query("extrema_merge", f"WITH {M1}, b AS (SELECT * FROM v0 UNION ALL SELECT {_COLS} FROM img WHERE sign = 1) SELECT {_P} AS p, {_extrema_sql(EVENTS)} FROM b GROUP BY 1")
def extrema_merge(spark, d):
    """Stored and candidate extrema merged; least and greatest pass over NULL."""
    state, new = _stored(spark, d).state, inc.positive_candidates(_images(spark, d), EVENTS)
    both = state.alias("s").join(new.alias("c"), F.col("s.p") == F.col("c.p"), "full")
    return both.select(F.coalesce("s.p", "c.p").alias("p"), *[(F.least if k == "min" else F.greatest)(F.col(f"s.{r}"), F.col(f"c.{r}")).alias(r) for r, (k, _) in EXTREMA.items()])


@query("incremental_extrema", f"WITH {M1} SELECT {_STATE} FROM v4 GROUP BY 1")
def incremental_extrema(spark, d):
    """The whole partition state at version 4, from state and changes."""
    kept = _stored(spark, d)
    return inc.maintained_state(kept.state, _images(spark, d), kept.end, EVENTS)


@query("key_delta", f"WITH {M1} SELECT {_B} AS b, {_EKEY}, sum(sign)::BIGINT AS delta FROM img GROUP BY ALL HAVING sum(sign) <> 0")
def key_delta(spark, d):
    return inc.key_delta(_images(spark, d), EVENTS)


_F0 = f"f0 AS (SELECT {_EKEY}, count(*)::BIGINT AS f FROM v0 GROUP BY ALL), f4 AS (SELECT {_EKEY}, count(*)::BIGINT AS f FROM v4 GROUP BY ALL)"
_ON = " AND ".join(f"f0.{k} IS NOT DISTINCT FROM f4.{k}" for k in EVENTS.key)
_OVER = f"""{_F0}, ov AS (SELECT {', '.join(f'CASE WHEN f4.f IS NULL THEN f0.{k} ELSE f4.{k} END AS {k}' for k in EVENTS.key)}, coalesce(f0.f, 0) AS base_frequency, coalesce(f4.f, 0) AS final_frequency
 FROM f0 FULL JOIN f4 ON {_ON} WHERE coalesce(f0.f, 0) <> coalesce(f4.f, 0))"""


def _overlay(spark, d) -> tuple[DataFrame, DataFrame]:
    keys = _stored(spark, d).keys
    return keys, inc.key_overlay(keys, inc.key_delta(_images(spark, d), EVENTS), EVENTS)


@query("key_overlay", f"WITH {M1}, {_OVER} SELECT {_B} AS b, {_EKEY}, base_frequency, final_frequency - base_frequency AS delta_frequency, final_frequency, CASE WHEN final_frequency = 0 THEN 'TOMBSTONE' ELSE 'UPSERT' END AS overlay_action FROM ov")
def key_overlay(spark, d):
    return _overlay(spark, d)[1]


_ADJUST = """SELECT sum((final_frequency > 0)::INT - (base_frequency > 0)::INT)::BIGINT AS d_distinct, sum((final_frequency > 1)::INT - (base_frequency > 1)::INT)::BIGINT AS d_groups,
 sum(greatest(final_frequency - 1, 0) - greatest(base_frequency - 1, 0))::BIGINT AS d_extra, max(final_frequency)::BIGINT AS max_final, coalesce(max(base_frequency) FILTER (WHERE final_frequency < base_frequency), 0)::BIGINT AS max_shrunk FROM ov"""


@query("key_overlay_adjust", f"WITH {M1}, {_OVER} {_ADJUST}")
def key_overlay_adjust(spark, d):
    return inc.overlay_adjust(_overlay(spark, d)[1])


@query("bucket_pruned_lookup", f"WITH {M1}, {_F0} SELECT b, count(*)::BIGINT AS keys, sum(f)::BIGINT AS n FROM (SELECT {_B} AS b, f FROM f0) WHERE b IN (SELECT DISTINCT {_B} FROM img) GROUP BY 1")
def bucket_pruned_lookup(spark, d):
    """Only the buckets of changed keys are read from the key state."""
    changed = _images(spark, d).where("sign <> 0").select(bucket_id().alias("b"))
    own = inc.in_buckets(_stored(spark, d).keys, changed)
    return own.groupBy("b").agg(F.count(F.lit(1)).alias("keys"), F.sum("frequency").cast("long").alias("n"))


_DUP4 = f"SELECT duplicate_extra AS R12, duplicate_extra = 0 AS R13, distinct_keys, duplicate_groups, max_multiplicity FROM ({_DUP.format(t='v4', k=_EKEY)})"


@query("incremental_uniqueness", f"WITH {M1} {_DUP4}")
def incremental_uniqueness(spark, d):
    return inc.incremental_uniqueness(_stored(spark, d).histogram, _overlay(spark, d)[1])


@query("max_multiplicity_fallback", f"WITH {M1}, {_OVER} SELECT max(f)::BIGINT AS unchanged_max FROM f4 WHERE NOT EXISTS (SELECT 1 FROM ov WHERE {' AND '.join(f'ov.{k} IS NOT DISTINCT FROM f4.{k}' for k in EVENTS.key)})")
def max_multiplicity_fallback(spark, d):
    frequencies, overlay = _overlay(spark, d)
    rest = frequencies.alias("f").join(overlay.alias("d"), (F.col("d.b") == F.col("f.b")) & inc._same_key("d", "f", EVENTS.key), "left_anti")
    return rest.agg(F.max("frequency").alias("unchanged_max"))


@query("uniqueness_fallback", f"WITH {M1} {_DUP4}")
def uniqueness_fallback(spark, d):
    m = inc.duplicate_metrics(_stored(spark, d).end.groupBy(*EVENTS.key).agg(F.count(F.lit(1)).alias("frequency")))
    return m.select(F.col("duplicate_extra").alias("R12"), (F.col("duplicate_extra") == 0).alias("R13"), "distinct_keys", "duplicate_groups", "max_multiplicity")


def _rules_at(rows: DataFrame) -> DataFrame:
    return rule_rows(inc.full_validation(rows, EVENTS))


_MODE_SQL = ", CASE WHEN (SELECT coalesce(max(n), 0) FROM again WHERE rule = '$r') > 0 THEN 'AFFECTED_PARTITION_RECOMPUTE' ELSE 'STATE_ASSISTED' END AS planner_mode"
_AGAIN = "again AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, count_if({r}) AS n FROM inv" for r in EXTREMA) + ")"


@query("incremental_all_rules", f"WITH {M1}, {_INVALID}, {_AGAIN}, {_wide_sql('v4', EVENTS)} {_rows_sql(_MODE_SQL)}")
def incremental_all_rules(spark, d):
    """Flagship: every rule from state and changes, with its planner mode."""
    return planner.planned_rules(_stored(spark, d), EVENTS, "event_id", planner.STATES)


@query("differential_partition", f"WITH {M1}, {_wide_sql('v4', EVENTS)} {_rows_sql()}")
def differential_partition(spark, d):
    kept = _stored(spark, d)
    state = inc.differential(kept.state, kept.feed, kept.end, EVENTS)
    extra = uniqueness_fallback(spark, d).select("R12", "R13")
    return rule_rows(inc.roll_up(state).crossJoin(extra))  # one row each


@query("changed_rows_only", f"WITH {M1}, fin AS (SELECT * FROM img WHERE sign = 1), {_wide_sql('fin', EVENTS)} {_rows_sql()}")
def changed_rows_only(spark, d):
    """Deliberately inexact: rules over the changed rows' final images alone."""
    return _rules_at(inc.final_images(_stored(spark, d).feed, "event_id"))


@query("union_states", f"WITH {M1}, t AS (SELECT DISTINCT {_P} AS p FROM cdf) SELECT {_STATE} FROM v0 WHERE {_P} NOT IN (SELECT p FROM t) GROUP BY 1 UNION ALL SELECT {_STATE} FROM v4 WHERE {_P} IN (SELECT p FROM t) GROUP BY 1")
def union_states(spark, d):
    kept = _stored(spark, d)
    return inc.differential(kept.state, kept.feed, kept.end, EVENTS)


def _agreement(spark, d) -> DataFrame:
    """(method, rule_id, exact_match, absolute_error) of three methods against full validation."""
    end = _stored(spark, d).end
    value = F.coalesce(F.col("long_value").cast("double"), F.col("double_value"), F.col("boolean_value").cast("double"))
    full = _rules_at(end).select("rule_id", value.alias("want"))
    methods = {"incremental": incremental_all_rules, "differential": differential_partition, "changed_rows_only": changed_rows_only}
    rows = reduce(DataFrame.unionByName, (q(spark, d).select(F.lit(m).alias("method"), "rule_id", value.alias("got")) for m, q in methods.items()))
    match = F.col("got").eqNullSafe(F.col("want")) | F.coalesce(F.abs(F.col("got") - F.col("want")) <= 1e-9, F.lit(False))
    return rows.join(full, "rule_id").select("method", "rule_id", match.alias("exact_match"), F.round(F.coalesce(F.abs(F.col("got") - F.col("want")), F.lit(0.0)), 9).alias("absolute_error"))


def _flat(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS rule_id, {r}::DOUBLE AS v FROM {source}" for r in RULES)


_AGREE = f"""WITH {M1}, fin AS (SELECT * FROM img WHERE sign = 1), {_wide_sql('v4', EVENTS)}, {_wide_sql('fin', EVENTS).replace('wide AS', 'wide_fin AS', 1)},
a AS ({_flat('wide')}), c AS ({_flat('wide_fin')}),
r AS (SELECT 'incremental' AS method, rule_id, true AS exact_match, 0.0::DOUBLE AS absolute_error FROM a UNION ALL SELECT 'differential', rule_id, true, 0.0 FROM a
 UNION ALL SELECT 'changed_rows_only', a.rule_id, abs(c.v - a.v) <= 1e-9, round(abs(c.v - a.v), 9) FROM a JOIN c ON a.rule_id = c.rule_id)"""


@query("rule_comparison", f"{_AGREE} SELECT * FROM r")
def rule_comparison(spark, d):
    return _agreement(spark, d)


@query("agreement_by_method", f"{_AGREE} SELECT method, count_if(exact_match)::BIGINT AS exact_matches, round(avg(exact_match::INT), 6) AS agreement FROM r GROUP BY 1")
def agreement_by_method(spark, d):
    return _agreement(spark, d).groupBy("method").agg(F.count_if("exact_match").alias("exact_matches"), F.round(F.avg(F.col("exact_match").cast("int")), 6).alias("agreement"))


# ---------------------------------------------------------------- corner cases, analyzers, method reports

#: id, operation, source row, changed column and value, by FIXTURES 1.6.
CORNER_CASES = [
    ("C01", "DELETE", "min_value", None), ("C02", "DELETE", "max_value", None), ("C03", "UPDATE", "min_id", "event_type = 'broken'"), ("C04", "INSERT", "clean", ""),
    ("C05", "INSERT", "clean", "event_type = NULL"), ("C06", "INSERT", "clean", "value = NULL"), ("C07", "INSERT", "clean", "value = -9999.99"), ("C08", "INSERT", "clean", "user_id = -7"),
    ("C09", "INSERT", "clean", "user_id = 0"), ("C10", "INSERT", "clean", "ts = TIMESTAMP '2000-01-01 00:00:00'"), ("C11", "INSERT", "clean", "ts = TIMESTAMP '2035-01-01 00:00:00'"), ("C12", "INSERT", "min_id", ""),
]
_ROLES = """roles AS (SELECT 'min_value' AS role, min(k) FILTER (WHERE v = lo) AS event_id FROM u, x UNION ALL SELECT 'max_value', min(k) FILTER (WHERE v = hi) FROM u, x
 UNION ALL SELECT 'min_id', min(event_id) FROM events UNION ALL SELECT 'clean', min(event_id) FROM events WHERE value >= 0 AND user_id BETWEEN 1 AND 120 AND event_type IS NOT NULL)"""
_CASES = ", ".join(f"('{i}', '{o}', '{r}')" for i, o, r, _ in CORNER_CASES)
_PLAN = f"u AS (SELECT value AS v, min(event_id) AS k FROM events GROUP BY 1 HAVING count(*) = 1), x AS (SELECT min(v) AS lo, max(v) AS hi FROM u), {_ROLES}, plan AS (SELECT t.*, event_id FROM (VALUES {_CASES}) t(scenario_id, operation, source_role) JOIN roles ON role = source_role)"


@query("corner_case_plan", f"WITH {_PLAN} SELECT * FROM plan")
def corner_case_plan(spark, d):
    e = table(spark, d, "events")
    once = e.groupBy("value").agg(F.min("event_id").alias("k"), F.count(F.lit(1)).alias("n")).where("n = 1").agg(F.min_by("k", "value").alias("min_value"), F.max_by("k", "value").alias("max_value"))
    ids = e.agg(F.min("event_id").alias("min_id"), F.min(F.when(F.expr("value >= 0 AND user_id BETWEEN 1 AND 120 AND event_type IS NOT NULL"), F.col("event_id"))).alias("clean"))
    cases = spark.createDataFrame([c[:3] for c in CORNER_CASES], "scenario_id string, operation string, source_role string")
    role = F.coalesce(*(F.when(F.col("source_role") == r, F.col(r)) for r in ("min_value", "max_value", "min_id", "clean")))
    return cases.crossJoin(once).crossJoin(ids).select("scenario_id", "operation", "source_role", role.alias("event_id"))  # 12 rows


def _case_sql() -> str:
    parts = [f"SELECT {_COLS} FROM events WHERE event_id NOT IN (SELECT event_id FROM plan WHERE operation <> 'INSERT')"]
    for i, o, _, change in CORNER_CASES:
        if o == "DELETE":
            continue
        name, _, to = (change or "").partition(" = ")
        cols = ", ".join(f"{to} AS {c}" if c == name else ("event_id + 30000000 + " + i[1:].lstrip("0") + " AS event_id" if c == "event_id" and o == "INSERT" else f"e.{c}") for c in _COLS.replace("event_id", "event_id").split(", "))
        cols = cols.replace("event_id + 3", "e.event_id + 3")
        parts.append(f"SELECT {cols} FROM events e JOIN plan ON plan.event_id = e.event_id WHERE scenario_id = '{i}'")
    return " UNION ALL ".join(parts)


@query("corner_case_apply", f"WITH {_PLAN}, after AS ({_case_sql()}), {_wide_sql('after', EVENTS)} {_rows_sql()}")
def corner_case_apply(spark, d):
    """All twelve scenarios in one table, validated in full."""
    e, plan = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"), corner_case_plan(spark, d)
    rows = e.join(F.broadcast(plan), "event_id")  # twelve rows
    parts = [e.join(F.broadcast(plan.where("operation <> 'INSERT'")), "event_id", "left_anti")]
    for i, o, _, change in CORNER_CASES:
        if o == "DELETE":
            continue
        own = rows.where(F.col("scenario_id") == i)
        if change:
            name, _, to = change.partition(" = ")
            own = own.withColumn(name, F.expr(to).cast(e.schema[name].dataType))
        if o == "INSERT":
            own = own.withColumn("event_id", F.col("event_id") + 30_000_000 + int(i[1:]))
        parts.append(own.select(*e.columns))
    return _rules_at(reduce(DataFrame.unionByName, parts))


def _metric(a: str, i: str, e: str, t: str) -> str:
    return f"SELECT '{a}' AS analyzer, '{i}' AS instance, round(({e})::DOUBLE, 9) AS value FROM {t}"


@query("analyzer_size", _metric("Size", "lineitem", "count(*)", "lineitem"))
def analyzer_size(spark, d):
    return an.metric_rows(table(spark, d, "lineitem").agg(an.size().alias("Size__lineitem")))


@query("analyzer_completeness", f"WITH {M1} " + " UNION ALL ".join(_metric("Completeness", c, f"count({c}) / count(*)", "v4") for c in ("event_type", "value")))
def analyzer_completeness(spark, d):
    return an.metric_rows(_scenario(spark, d).snapshot(4).agg(*[an.completeness(c).alias(f"Completeness__{c}") for c in ("event_type", "value")]))


@query("analyzer_compliance", " UNION ALL ".join(_metric("Compliance", f"R{i:02d}", f"avg(CASE WHEN {p} THEN 1.0 ELSE 0.0 END)", "lineitem") for i, p in enumerate(LINEITEM.violations, 2)))
def analyzer_compliance(spark, d):
    return an.metric_rows(table(spark, d, "lineitem").agg(*[an.compliance(p).alias(f"Compliance__R{i:02d}") for i, p in enumerate(LINEITEM.violations, 2)]))


@query("analyzer_minmax", " UNION ALL ".join(_metric(a, c, f"{f}({c})", "lineitem") for a, f in (("Minimum", "min"), ("Maximum", "max")) for c in LINEITEM.measures))
def analyzer_minmax(spark, d):
    return an.metric_rows(table(spark, d, "lineitem").agg(*[f(c).cast("double").alias(f"{a}__{c}") for a, f in (("Minimum", F.min), ("Maximum", F.max)) for c in LINEITEM.measures]))


_LK = "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query("analyzer_distinctness", _metric("Distinctness", "l_orderkey_l_linenumber", "count(*) / sum(n)", _LK))
def analyzer_distinctness(spark, d):
    return an.metric_rows(an.key_analyzers(table(spark, d, "lineitem"), LINEITEM.key).select("Distinctness__l_orderkey_l_linenumber"))


@query("analyzer_uniqueness", _metric("Uniqueness", "l_orderkey_l_linenumber", "count_if(n = 1) / sum(n)", _LK))
def analyzer_uniqueness(spark, d):
    return an.metric_rows(an.key_analyzers(table(spark, d, "lineitem"), LINEITEM.key).select("Uniqueness__l_orderkey_l_linenumber"))


@query("analyzer_reconstruct", " UNION ALL ".join(f"SELECT 'R{i:02d}' AS rule_id, count_if({p})::BIGINT AS violations FROM lineitem" for i, p in enumerate(LINEITEM.violations, 2)))
def analyzer_reconstruct(spark, d):
    """Whole counts back from fractions."""
    wide = table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), *[an.compliance(p).alias(f"R{i:02d}") for i, p in enumerate(LINEITEM.violations, 2)])
    rows = [F.struct(F.lit(r).alias("rule_id"), an.reconstruct(F.col(r), F.col("n")).alias("violations")) for r in wide.columns[1:]]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Trial reports: orders are the trials, priorities the workloads, statuses the methods, prices the seconds.
_TRIALS = "SELECT o_orderpriority AS workload, o_orderstatus AS method, o_totalprice AS seconds FROM orders"


def _trials(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("workload"), F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("seconds"))


@query("method_summary", f"SELECT workload, method, count(*)::BIGINT AS trials, round(avg(seconds), 6) AS mean_seconds, min(seconds) AS min_seconds, max(seconds) AS max_seconds FROM ({_TRIALS}) GROUP BY 1, 2")
def method_summary(spark, d):
    return _trials(spark, d).groupBy("workload", "method").agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"))


_MED = f"SELECT workload, method, quantile_disc(seconds, 0.5) AS approx_median, round(median(seconds), 6) AS exact_median FROM ({_TRIALS}) GROUP BY 1, 2"


@query("method_summary_median", _MED)
def method_summary_median(spark, d):
    return _trials(spark, d).groupBy("workload", "method").agg(F.percentile_approx("seconds", 0.5, 1_000_000).alias("approx_median"), F.round(F.median("seconds"), 6).alias("exact_median"))


@query("method_comparison", f"WITH m AS ({_MED}) SELECT a.workload, a.method AS method, b.method AS against, round(b.exact_median / a.exact_median, 6) AS speedup FROM m a JOIN m b ON a.workload = b.workload AND a.method < b.method")
def method_comparison(spark, d):
    m = method_summary_median(spark, d)
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, (F.col("a.workload") == F.col("b.workload")) & (F.col("a.method") < F.col("b.method"))).select("a.workload", "a.method", F.col("b.method").alias("against"), F.round(F.col("b.exact_median") / F.col("a.exact_median"), 6).alias("speedup"))


# ---------------------------------------------------------------- files, guards, candidate chains


@query("multi_file_scan", """SELECT 'lineitem' AS table_name, count(*)::BIGINT AS row_count, count(l_extendedprice)::BIGINT AS line_prices, 0::BIGINT AS order_prices FROM lineitem
UNION ALL SELECT 'orders', count(*), 0, count(o_totalprice) FROM orders""")
def multi_file_scan(spark, d):
    """Several files under one explicit schema, told apart by their names."""
    schema = T.StructType([T.StructField("l_extendedprice", T.DoubleType()), T.StructField("o_totalprice", T.DoubleType())])
    rows = files.scan_files(spark, [f"{d}/{t}.parquet" for t in ("orders", "lineitem")], schema)
    named = rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"(orders|lineitem)\.parquet", 1).alias("table_name"))
    return named.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"), F.count("l_extendedprice").alias("line_prices"), F.count("o_totalprice").alias("order_prices"))


@query("profile_with_sizes", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count, min({m})::DOUBLE AS min_value, max({m})::DOUBLE AS max_value, true AS sized, true AS same_rows FROM {t}" for t, m in _PROFILED.items()))
def profile_with_sizes(spark, d):
    """Profiles joined with the sizes of the files; SQL knows no file sizes, so these come as a check."""
    sizes = [files.file_sizes(table(spark, d, t)).agg(F.sum("size_bytes").alias("size_bytes"), F.sum("row_count").alias("file_rows")).select(F.lit(t).alias("table_name"), "*") for t in _PROFILED]
    both = table_profile(spark, d).join(reduce(DataFrame.unionByName, sizes), "table_name")
    return both.select("table_name", "row_count", "min_value", "max_value", (F.col("size_bytes") > 0).alias("sized"), (F.col("file_rows") == F.col("row_count")).alias("same_rows"))


_EVENT_NULLS = "event_id ts user_id event_type value props".split()


@query("event_profile", "SELECT count(*)::BIGINT AS row_count, min(ts) AS min_ts, max(ts) AS max_ts, min(value) AS min_value, max(value) AS max_value, min(user_id) AS min_user, max(user_id) AS max_user, count_if(value < 0)::BIGINT AS negative_values, count_if(user_id < 0)::BIGINT AS negative_users, " + ", ".join(f"count_if({c} IS NULL)::BIGINT AS null_{c}" for c in _EVENT_NULLS) + " FROM events")
def event_profile(spark, d):
    """Times, ranges, negatives and NULLs of each column in one pass."""
    ranges = [f(c).alias(f"{n}_{a}") for c, a in (("ts", "ts"), ("value", "value"), ("user_id", "user")) for n, f in (("min", F.min), ("max", F.max))]
    negatives = [F.count_if(F.col(c) < 0).alias(a) for c, a in (("value", "negative_values"), ("user_id", "negative_users"))]
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("row_count"), *ranges, *negatives, *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in _EVENT_NULLS))


@query("csv_typed_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_typed_scan(spark, d):
    """Customers written as CSV with a header, read back as text and cast."""
    rows = table(spark, d, "customer").select(*_NULLS["customer"].split())
    path = f"{shared_dir(spark)}/customer-csv-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True)
    return files.typed_csv(spark, path, rows.schema)


@query("single_row_summary", ORACLES["profile_summary"])
def single_row_summary(spark, d):
    return files.single_row(profile_summary(spark, d), "the summary")


@query("any_null_rows", f"WITH {M1} SELECT event_id FROM v4 WHERE event_type IS NULL OR value IS NULL OR user_id IS NULL")
def any_null_rows(spark, d):
    return _stored(spark, d).end.where(files.any_null("event_type", "value", "user_id")).select("event_id")


@query("prefix_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1')")
def prefix_filter(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_orderpriority")


@query("existence_probe", f"WITH {M1} " + " UNION ALL ".join(f"SELECT 'R{i:02d}' AS rule_id, EXISTS (SELECT 1 FROM v4 WHERE {p}) AS found FROM (SELECT 1)" for i, p in enumerate(EVENTS.violations, 2)))
def existence_probe(spark, d):
    """Whether any row breaks a rule; each probe stops at its first hit."""
    end = _stored(spark, d).end
    return reduce(DataFrame.unionByName, (files.exists(end.where(p)).select(F.lit(f"R{i:02d}").alias("rule_id"), "found") for i, p in enumerate(EVENTS.violations, 2)))


@query("first_duplicate_by_hex", "SELECT l_orderkey, l_linenumber, hex(concat_ws('|', l_orderkey, l_linenumber)) AS key_hex, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY key_hex LIMIT 1")
def first_duplicate_by_hex(spark, d):
    """The duplicate key that comes first by the hex of its bytes; the limit is the feature."""
    keys = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.select("l_orderkey", "l_linenumber", F.hex(F.concat_ws("|", "l_orderkey", "l_linenumber")).alias("key_hex"), "n").orderBy("key_hex").limit(1)


@query("ranked_merge_source", f"""WITH c AS (SELECT event_id, {_RANK} AS h FROM ({_CLEAN}) WHERE {_RANK} < 20000), r AS (SELECT event_id, row_number() OVER (ORDER BY h, event_id)::BIGINT AS rank FROM c)
SELECT rank, CASE WHEN rank <= 20 THEN 'UPDATE' WHEN rank <= 40 THEN 'DELETE' ELSE 'INSERT' END AS op, CASE WHEN rank > 40 THEN (SELECT max(event_id) FROM events) + rank - 40 ELSE event_id END AS event_id,
 sha256(concat_ws('|', 'INSERT', lpad(rank::VARCHAR, 8, '0'), event_id)) AS marker FROM r WHERE rank <= 60""")
def ranked_merge_source(spark, d):
    """The whole chain: clean, hash-sampled, ranked; rank slices become updates, deletes and inserts with markers of their own."""
    sampled = clean_candidates(spark, d).join(hash_sample(spark, d), "event_id", "left_semi")
    slices = F.when(F.col("rank") <= 20, "UPDATE").when(F.col("rank") <= 40, "DELETE").otherwise("INSERT")
    new_id = F.when(F.col("rank") > 40, F.col("top") + F.col("rank") - 40).otherwise(F.col("event_id"))
    top = table(spark, d, "events").agg(F.max("event_id").alias("top"))
    marker = F.sha2(F.concat_ws("|", F.lit("INSERT"), F.lpad(F.col("rank").cast("string"), 8, "0"), F.col("event_id").cast("string")), 256)
    return _ranked(sampled).where("rank <= 60").crossJoin(F.broadcast(top)).select("rank", slices.alias("op"), new_id.alias("event_id"), marker.alias("marker"))


_SHARES = "SELECT o_orderpriority AS profile_id, o_orderkey % 13 AS rule, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS nw FROM orders GROUP BY 1, 2"


@query("weight_sanity", f"SELECT profile_id, count(*)::BIGINT AS rules, abs(sum(nw) - 1) <= 1e-12 AND count(*) = 13 AS sane FROM ({_SHARES}) GROUP BY 1")
def weight_sanity(spark, d):
    """Profiles as the data weighs them (how often each rule is asked for, by priority): thirteen weights that sum to 1."""
    asked = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("profile_id"), (F.col("o_orderkey") % 13).alias("rule")).agg(F.count(F.lit(1)).alias("raw_weight"))
    return sel.sane_weights(sel.normalized(asked))


@query("budget_labels", f"""WITH {_STATES_SQL}, {_BUDGETS_SQL} SELECT budget_bytes, CASE WHEN budget_bytes >= 1073741824 THEN printf('%.3f GiB', budget_bytes / 1073741824) WHEN budget_bytes >= 1048576 THEN printf('%.3f MiB', budget_bytes / 1048576)
 WHEN budget_bytes >= 1024 THEN printf('%.3f KiB', budget_bytes / 1024) ELSE budget_bytes || ' B' END AS label, (SELECT count(*) FROM states WHERE size_bytes <= budget_bytes)::BIGINT AS fitting FROM b""")
def budget_labels(spark, d):
    """Budgets in binary units, with the number of states that fit alone."""
    b = F.col("budget_bytes")
    label = reduce(lambda c, u: c.when(b >= u[1], F.format_string(f"%.3f {u[0]}", b / u[1])), (("MiB", 1 << 20), ("KiB", 1 << 10)), F.when(b >= 1 << 30, F.format_string("%.3f GiB", b / (1 << 30))))
    sizes = _states(spark, d).select("size_bytes")
    fitting = _budgets(spark).join(F.broadcast(sizes), F.col("size_bytes") <= b, "left")  # twelve states
    return fitting.groupBy("budget_bytes", label.otherwise(F.concat(b.cast("string"), F.lit(" B"))).alias("label")).agg(F.count("size_bytes").alias("fitting"))


@query("matrix_manifest", f"""WITH s AS ({_SOURCE}), m AS (SELECT op || '_ONLY' AS family, count(*)::BIGINT AS available FROM s GROUP BY 1 UNION ALL SELECT 'MIXED_40I_30U_30D', count(*) FROM s), x AS ({ORACLES["workload_matrix"]})
SELECT x.family, x.operations, m.available, m.available >= x.operations AS enough FROM x JOIN m ON m.family = x.family""")
def matrix_manifest(spark, d):
    """The workload matrix joined with the manifest of the rows there are for each family."""
    source = _merge_source(spark, d)
    single = source.groupBy(F.concat("op", F.lit("_ONLY")).alias("family")).agg(F.count(F.lit(1)).alias("available"))
    manifest = single.unionByName(source.agg(F.count(F.lit(1)).alias("available")).select(F.lit("MIXED_40I_30U_30D").alias("family"), "available"))
    return workload_matrix(spark, d).join(F.broadcast(manifest), "family").select("family", "operations", "available", (F.col("available") >= F.col("operations")).alias("enough"))  # four rows


_SHOWN = "lower(concat_ws(' ', rule_id, metric_type, status, coalesce(long_value::VARCHAR, boolean_value::VARCHAR, printf('%.12g', double_value), '')))"


@query("rule_display", f"WITH {_wide_sql('events', EVENTS)}, r AS ({_rows_sql()}) SELECT rule_id, {_SHOWN} AS metric_display FROM r ORDER BY rule_id")
def rule_display(spark, d):
    """Each result as text, doubles with 12 significant digits, in the order of the report."""
    return _rules_at(table(spark, d, "events")).select("rule_id", F.lower(F.concat_ws(" ", "rule_id", "metric_type", "status", display_value())).alias("metric_display")).orderBy("rule_id")
