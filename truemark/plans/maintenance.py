"""Queries over states that are kept, carried along, streamed and chosen, and over every version at once."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truemark.functions.keys import row_key
from truemark.functions.rules import EVENTS, RULES, SCALARS
from truemark.operators import consolidate as con
from truemark.operators import incremental as inc
from truemark.operators import planner, sketches, timeline, workloads
from truemark.operators import selection as sel
from truemark.plans import catalogue as cat
from truemark.plans.catalogue import M1, query, table
from truemark.sources import files
from truemark.sources.chain import Chain
from truemark.sources.shared import shared_dir, written
from truemark.sources.stored import adaptive_write
from truemark.sources.versions import replay
from truemark.streaming.feed import maintain

_ROWS_AT = lambda v: f"(WITH {cat._wide_sql(f'v{v}', EVENTS)} SELECT {v}::BIGINT AS version, r.* FROM ({cat._rows_sql()}) r)"


# ---------------------------------------------------------------- rules from a portfolio

#: Budgets that keep a few states, all scalar ones, and all; and the profile that fills them.
PLANNED = ((2048, 32768, 268435456), "EXTREMA_HEAVY")
_PLANNED_MODE = ", CASE WHEN NOT list_contains(ids, CASE WHEN '$r' IN ('R12', 'R13') THEN 'S12' ELSE 'S' || substr('$r', 2) END) THEN 'EXACT_FULL_SCAN_FALLBACK' WHEN (SELECT coalesce(max(n), 0) FROM again WHERE rule = '$r') > 0 THEN 'AFFECTED_PARTITION_RECOMPUTE' ELSE 'STATE_ASSISTED' END AS planner_mode, budget_bytes"


@query("planned_rules", f"""WITH RECURSIVE {M1}, {cat._INVALID}, {cat._AGAIN}, {cat._wide_sql('v4', EVENTS).replace('wide AS', 'wide0 AS', 1)}, {cat._GAINS_SQL}, b AS (SELECT unnest([{', '.join(map(str, PLANNED[0]))}])::BIGINT AS budget_bytes), {cat._GREEDY_SQL},
wide AS (SELECT wide0.*, ids, budget_bytes FROM wide0, greedy WHERE profile_id = '{PLANNED[1]}') {cat._rows_sql(_PLANNED_MODE)}""")
def planned_rules(spark, d):
    """All rules for the portfolio of each budget: how each is answered, and its value.

    Portfolios are known before the plans are built, so that a plan reads the end snapshot only where
    a rule of that portfolio needs it.
    """
    kept = cat._stored(spark, d)
    budgets = spark.createDataFrame([(b,) for b in PLANNED[0]], "budget_bytes long")
    chosen = sel.greedy(cat._gains(spark, d).where(F.col("profile_id") == PLANNED[1]), budgets)
    portfolios = {r["budget_bytes"]: r["portfolio"].split(",") for r in chosen.collect()}  # a row a budget
    plans = (planner.planned_rules(kept, EVENTS, "event_id", held).withColumn("budget_bytes", F.lit(b).cast("long")) for b, held in portfolios.items())
    return reduce(DataFrame.unionByName, plans)


@query("uniqueness_ablation", f"WITH {M1}, ks AS (SELECT {cat._B} AS bucket, count(*) AS keys FROM (SELECT DISTINCT {cat._EKEY} FROM v0) GROUP BY 1), " + ", ".join(
    f"""base{v} AS (SELECT * FROM v0 WHERE event_id IN (SELECT event_id FROM cdf WHERE commit_version <= {v})), last{v} AS (SELECT * FROM v{v} WHERE event_id IN (SELECT event_id FROM cdf WHERE commit_version <= {v})),
d{v} AS (SELECT {cat._EKEY} FROM (SELECT {cat._EKEY}, -1 AS s FROM base{v} UNION ALL SELECT {cat._EKEY}, 1 FROM last{v}) GROUP BY ALL HAVING sum(s) <> 0),
t{v} AS (SELECT DISTINCT {cat._B} AS bucket FROM d{v}),
x{v} AS (SELECT {v}::BIGINT AS version, (SELECT count(*) FROM t{v})::BIGINT AS buckets_touched, (SELECT count(*) FROM ks)::BIGINT AS buckets, (SELECT coalesce(sum(keys), 0) FROM ks WHERE bucket IN (SELECT bucket FROM t{v}))::BIGINT AS keys_read,
 (SELECT sum(keys) FROM ks)::BIGINT AS keys, ((SELECT count(*) FROM base{v}) + (SELECT count(*) FROM last{v}))::BIGINT AS changed_rows, (SELECT count(*) FROM v{v})::BIGINT AS rows, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM v{v} GROUP BY {cat._EKEY}))::BIGINT AS extra)"""
    for v in range(1, 5)) + ", x AS (" + " UNION ALL ".join(f"SELECT * FROM x{v}" for v in range(1, 5)) + """)
SELECT version, buckets_touched, buckets, keys_read, keys, changed_rows, rows, extra AS "R12_scan", extra AS "R12_state", true AS agree, extra = 0 AS "R13", round(buckets_touched / buckets, 6) AS bucket_share, round(keys_read / keys, 6) AS key_share,
 CASE WHEN keys_read + changed_rows < rows THEN 'KEY_STATE' ELSE 'FULL_SCAN' END AS path FROM x""")
def uniqueness_ablation(spark, d):
    """For the commits 1 to v: what the key state reads, both methods' results, and the path that reads less."""
    kept, t = cat._stored(spark, d), cat._scenario(spark, d)
    parts = []
    for v in range(1, 5):
        images = written(inc.net_images(kept.feed.where(F.col("_commit_version") <= v), "event_id"), "ablation-images")
        overlay = written(inc.key_overlay(kept.keys, inc.key_delta(images, EVENTS), EVENTS), "ablation-overlay")
        one = con.ablation(kept.keys, kept.histogram, images, t.snapshot(v), EVENTS, overlay, inc.incremental_uniqueness(kept.histogram, overlay))
        parts.append(one.withColumn("version", F.lit(v).cast("long")))
    return reduce(DataFrame.unionByName, parts)


@query("overlay_stored", cat.ORACLES["key_overlay"])
def overlay_stored(spark, d):
    """The key overlay written adaptively (one small file, or folders by bucket) and read back."""
    return adaptive_write(cat._overlay(spark, d)[1], "overlay", "b").select("b", *EVENTS.key, "base_frequency", "delta_frequency", "final_frequency", "overlay_action")


@query("state_catalogue", f"WITH st AS (SELECT DISTINCT {cat._P} AS p FROM events), kf AS (SELECT DISTINCT {cat._EKEY} FROM events) SELECT 'S' || lpad(i::VARCHAR, 2, '0') AS state_id, CASE WHEN i < 8 THEN 'ADDITIVE' WHEN i < 12 THEN 'PARTITION_EXTREMA' ELSE 'KEY_FREQUENCY' END AS state_family, CASE WHEN i < 12 THEN (SELECT count(*) FROM st) ELSE (SELECT count(*) FROM kf) END::BIGINT AS row_count, true AS measured FROM range(1, 13) t(i)")
def state_catalogue(spark, d):
    """The stored states with the rows, files and bytes that their files' metadata tell; SQL knows no files, so these come as a check."""
    kept = cat._stored(spark, d)
    found = con.measured(con.store_states(kept.state) | {"S12": kept.keys})
    return found.select("state_id", "state_family", "row_count", ((F.col("files") > 0) & (F.col("size_bytes") > 0)).alias("measured"))


@query("uniqueness_share", """WITH m AS (SELECT o_orderpriority AS workload, median(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS scan, median(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS n, median(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS assisted FROM orders GROUP BY 1)
SELECT workload, round(n / (scan + n), 6) AS uniqueness_share, round((scan + n) / assisted, 6) AS speedup_full, round(n / assisted, 6) AS speedup_uniqueness FROM m""")
def uniqueness_share(spark, d):
    """What share of a full validation the key count takes, and how much faster the assisted method is, by medians of trials."""
    of = lambda m: F.median(F.when(F.col("method") == m, F.col("seconds")))
    m = cat._trials(spark, d).groupBy("workload").agg(of("F").alias("scan"), of("O").alias("n"), of("P").alias("assisted"))
    full = F.col("scan") + F.col("n")
    return m.select("workload", F.round(F.col("n") / full, 6).alias("uniqueness_share"), F.round(full / F.col("assisted"), 6).alias("speedup_full"), F.round(F.col("n") / F.col("assisted"), 6).alias("speedup_uniqueness"))


# ---------------------------------------------------------------- every version at once


@query("rules_by_version", f"WITH {M1} " + " UNION ALL ".join(f"SELECT * FROM {_ROWS_AT(v)}" for v in range(5)))
def rules_by_version(spark, d):
    """The 13 rules at every version, from one reading of base and feed."""
    t = cat._scenario(spark, d)
    return timeline.rules_by_version(t.snapshot(0), cat._stored(spark, d).feed, t.version, EVENTS)


@query("distinct_sketch_by_version", f"""WITH {M1}, came AS (SELECT {cat._EKEY}, 0::BIGINT AS version FROM v0 UNION ALL SELECT {cat._EKEY}, commit_version FROM cdf WHERE change_type IN ('insert', 'update_postimage')),
f AS (SELECT min(version) AS version FROM came GROUP BY {cat._EKEY}) SELECT v::BIGINT AS version, (SELECT count(*) FROM f WHERE version <= v)::BIGINT AS exact_distinct, (SELECT count(*) FROM came WHERE version <= v)::BIGINT AS rows, true AS within_error FROM range(5) t(v)""")
def distinct_sketch_by_version(spark, d):
    """Keys ever seen up to each version: counted, and whether mergeable sketches come within four standard errors."""
    base, feed = table(spark, d, "events"), cat._stored(spark, d).feed
    seen = sketches.distinct_by_version(sketches.key_sketches(base, feed, EVENTS), 4)
    exact = sketches.exact_by_version(base, feed, EVENTS, 4)
    near = F.abs(F.col("estimate") - F.col("exact_distinct")) <= 4 * sketches.ERROR * F.col("exact_distinct") + 1
    return exact.join(seen, "version").select("version", "exact_distinct", "rows", near.alias("within_error"))


# ---------------------------------------------------------------- states carried along

_SCALARS_AT = " UNION ALL ".join(f"SELECT {v}::BIGINT AS version, {cat._counts_sql(EVENTS)}, {cat._extrema_sql(EVENTS)}, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM v{v} GROUP BY {cat._EKEY}))::BIGINT AS R12, (SELECT count(*) FROM (SELECT DISTINCT {cat._EKEY} FROM v{v}))::BIGINT AS keys FROM v{v}" for v in range(5))


def _carried(chain: Chain, steps: list[tuple[int, int]]) -> DataFrame:
    """version, R01 to R12 and the number of keys of a chain's (version, step) pairs."""
    parts = []
    for version, step in steps:
        unique = chain.uniqueness(step).select("R12", F.col("distinct_keys").alias("keys"))
        parts.append(inc.roll_up(chain.state(step)).crossJoin(unique).select(F.lit(version).cast("long").alias("version"), *SCALARS, "R12", "keys"))  # one row each
    return reduce(DataFrame.unionByName, parts)


@query("chained_rules", f"WITH {M1} {_SCALARS_AT}")
def chained_rules(spark, d):
    """Each commit carried from the states that the one before it left; the base is read once."""
    t, feed = cat._scenario(spark, d), cat._stored(spark, d).feed
    chain = Chain(spark, f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}", EVENTS, "event_id").start(t.snapshot(0))
    for v in range(1, t.version + 1):
        chain.advance(v, feed.where(F.col("_commit_version") == v), lambda v=v: t.snapshot(v))
    return _carried(chain, [(v, v) for v in range(t.version + 1)])


def _streamed(spark, d) -> tuple[Chain, int]:
    """The chain that a stream over the saved feed carried to its end, and its last step."""
    t, path = cat._scenario(spark, d), f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    t.save(path)
    chain = Chain(spark, f"{path}/states", EVENTS, "event_id").start(t.snapshot(0))
    run = maintain(spark, f"{path}/changes", chain, lambda v: replay(spark, path, "event_id", v), f"{path}/checkpoint")
    run.awaitTermination()
    return chain, chain.last_step()


@query("streamed_state", cat.ORACLES["incremental_extrema"])
def streamed_state(spark, d):
    """The partition state that a stream over the commit files keeps, extrema included."""
    chain, step = _streamed(spark, d)
    return chain.state(step).select("p", *SCALARS)


@query("streamed_uniqueness", cat.ORACLES["incremental_uniqueness"])
def streamed_uniqueness(spark, d):
    """R12, R13 and the other duplicate metrics from the key frequencies that a stream keeps."""
    chain, step = _streamed(spark, d)
    return chain.uniqueness(step)


# ---------------------------------------------------------------- whole-row keys and contracts

_ALL = {"events": "event_id, ts, user_id, event_type, value, props", "events without id": "ts, user_id, event_type, value, props", "lineitem": cat._NULLS["lineitem"].replace(" ", ", ")}


@query("row_key_duplicates", " UNION ALL ".join(f"SELECT '{n}' AS table_name, sum(n)::BIGINT AS row_count, count(*)::BIGINT AS distinct_keys, count_if(n > 1)::BIGINT AS duplicate_groups, sum(n - 1)::BIGINT AS duplicate_extra, max(n)::BIGINT AS max_multiplicity FROM (SELECT count(*) AS n FROM {n.split()[0]} GROUP BY {c})" for n, c in _ALL.items()))
def row_key_duplicates(spark, d):
    """Duplicates by all columns, through canonical keys of 32 bytes: a shuffle moves keys, whatever the rows hold."""
    parts = []
    for name, columns in _ALL.items():
        rows = table(spark, d, name.split()[0]).select(*columns.split(", "))
        counted = rows.groupBy(row_key(rows).alias("k")).agg(F.count(F.lit(1)).alias("frequency"))
        metrics = inc.duplicate_metrics(counted.select("frequency"))
        total = F.col("distinct_keys") + F.col("duplicate_extra")
        parts.append(metrics.select(F.lit(name).alias("table_name"), total.alias("row_count"), "distinct_keys", "duplicate_groups", "duplicate_extra", "max_multiplicity"))
    return reduce(DataFrame.unionByName, parts)


@query("contract_scan", "SELECT o_orderstatus, count(*)::BIGINT AS row_count FROM orders GROUP BY 1")
def contract_scan(spark, d):
    """A list of files held against a declared schema, footer by footer, before they are read as one."""
    path = f"{d}/orders.parquet"
    return files.checked_scan(spark, [path], spark.read.parquet(path).schema).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("row_count"))


# ---------------------------------------------------------------- corner cases, one commit each

_FIRST_NEW = 30_000_000
_LIVES = ["SELECT e.*, 0 AS born, coalesce(v, 99) AS died FROM (SELECT " + cat._COLS + " FROM events) e LEFT JOIN gone ON gone.event_id = e.event_id"]
for _i, (_id, _op, _, _change) in enumerate(cat.CORNER_CASES, 1):
    if _op != "DELETE":
        _name, _, _to = (_change or "").partition(" = ")
        _cols = ", ".join(f"e.event_id + {_FIRST_NEW + _i}" if c == "event_id" and _op == "INSERT" else _to if c == _name else f"e.{c}" for c in cat._COLS.split(", "))
        _LIVES.append(f"SELECT {_cols}, {_i}, 99 FROM events e JOIN plan ON plan.event_id = e.event_id WHERE scenario_id = '{_id}'")
_KEYS_AT = f"SELECT version, sum(n - 1)::BIGINT AS R12 FROM (SELECT version, count(*) AS n FROM atv GROUP BY version, {cat._EKEY}) GROUP BY 1"
_CASE_LIVES = f"{cat._PLAN}, gone AS (SELECT event_id, substr(scenario_id, 2)::INT AS v FROM plan WHERE operation <> 'INSERT'), lives AS ({' UNION ALL '.join(_LIVES)})"
_CASES_SQL = f"""WITH {_CASE_LIVES},
atv AS (SELECT lives.*, v::BIGINT AS version FROM lives, range(13) r(v) WHERE born <= v AND v < died),
sc AS (SELECT version, {cat._counts_sql(EVENTS)}, {cat._extrema_sql(EVENTS)} FROM atv GROUP BY 1), un AS ({_KEYS_AT}), w AS (SELECT sc.*, R12, R12 = 0 AS R13 FROM sc JOIN un USING (version)),
long AS ({' UNION ALL '.join(f"SELECT version, '{r}' AS rule_id, {r}::DOUBLE AS after FROM w" for r in RULES)})
SELECT * FROM (SELECT version, rule_id, lag(after) OVER (PARTITION BY rule_id ORDER BY version) AS before, after, lag(after) OVER (PARTITION BY rule_id ORDER BY version) IS DISTINCT FROM after AS changed FROM long) WHERE version > 0"""


def _case_feed(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(*cat._COLS.split(", "))
    rows = e.join(F.broadcast(cat.corner_case_plan(spark, d)), "event_id")  # twelve rows
    return written(workloads.case_changes(rows, cat.CORNER_CASES, "event_id", _FIRST_NEW).select(*cat._COLS.split(", "), "_change_type", "_commit_version"), "case-feed")


@query("corner_case_commits", _CASES_SQL)
def corner_case_commits(spark, d):
    """Twelve adversarial scenarios as twelve commits: every rule before and after each, and which moved."""
    e = table(spark, d, "events").select(*cat._COLS.split(", "))
    return timeline.attribution(timeline.rules_by_version(e, _case_feed(spark, d), len(cat.CORNER_CASES), EVENTS))


_EXPECTED = [(i, int(o == "INSERT"), int(o == "UPDATE"), int(o == "DELETE")) for i, (_, o, _, _) in enumerate(cat.CORNER_CASES, 1)]


@query("corner_case_audit", f"WITH {cat._PLAN} SELECT substr(scenario_id, 2)::BIGINT AS version, count_if(operation = 'INSERT')::BIGINT AS inserts, count_if(operation = 'UPDATE')::BIGINT AS updates, count_if(operation = 'DELETE')::BIGINT AS deletes, sum(CASE WHEN operation = 'UPDATE' THEN 2 ELSE 1 END)::BIGINT AS change_rows, true AS as_expected FROM plan JOIN events USING (event_id) GROUP BY 1")
def corner_case_audit(spark, d):
    """The change rows of each of the twelve commits against what its scenario asks for."""
    expected = spark.createDataFrame(_EXPECTED, "version long, inserts long, updates long, deletes long")
    return workloads.audit(_case_feed(spark, d), expected)


# ---------------------------------------------------------------- nested workloads, executed

#: Operations of the nested sizes that are executed; a size's source holds every smaller one's.
NESTED = (5, 25, 100, 500)
_SETS = {"event_type": "concat('made ', event_type)", "value": "value + 1000"}
_STREAMS = []
for _f, _shares in sel.FAMILIES.items():
    _counts = workloads.splits(NESTED, _shares)
    for _k, _o in enumerate(("INSERT", "UPDATE", "DELETE")):
        _off = _counts[-1][1] if _o == "DELETE" else 0
        _when = " ".join(f"WHEN rank - {_off} <= {c[_k]} THEN {v}" for v, c in enumerate(_counts, 1))
        _STREAMS.append(f"SELECT '{_f}' AS family, '{_o}' AS op, CASE WHEN rank - {_off} < 1 THEN NULL {_when} END AS version, rank - {_off} AS ordinal, ranked.* FROM ranked")
_DEALT = f"ranked AS (SELECT {cat._COLS}, row_number() OVER (ORDER BY {cat._RANK}, event_id)::BIGINT AS rank FROM events), dealt AS (SELECT * FROM ({' UNION ALL '.join(_STREAMS)}) WHERE version IS NOT NULL)"
_NEW = ", ".join(_SETS.get(c, c) + f" AS {c}" for c in cat._COLS.split(", ")[1:])
_WORK_AT = f"""{_DEALT}, fv AS (SELECT f AS family, v::BIGINT AS version FROM (VALUES {', '.join(f"('{f}')" for f in sel.FAMILIES)}) t(f), range(1, {len(NESTED) + 1}) r(v)),
atv AS (SELECT fv.*, {cat._COLS} FROM fv, events WHERE NOT EXISTS (SELECT 1 FROM dealt x WHERE x.family = fv.family AND x.version <= fv.version AND x.op <> 'INSERT' AND x.event_id = events.event_id)
 UNION ALL SELECT fv.*, CASE WHEN op = 'INSERT' THEN (SELECT max(event_id) FROM events) + ordinal ELSE event_id END, {_NEW} FROM fv JOIN dealt x ON x.family = fv.family AND x.version <= fv.version AND op <> 'DELETE')"""


def _operations(spark, d) -> DataFrame:
    """All operations of all families, dealt out of the ranked events in one pass."""
    e = table(spark, d, "events").select(*cat._COLS.split(", "))
    return written(workloads.dealt(workloads.ranked(e, "event_id"), sel.FAMILIES, NESTED), "operations")


def _work_feed(spark, d) -> DataFrame:
    top = table(spark, d, "events").agg(F.max("event_id"))
    return written(workloads.change_rows(_operations(spark, d), cat._COLS.split(", "), {c: F.expr(x) for c, x in _SETS.items()}, "event_id", top), "workload-feed")


@query("workload_sources", f"WITH {_DEALT}, fv AS (SELECT f AS family, v::BIGINT AS version FROM (SELECT DISTINCT family FROM dealt) t(f), range(1, {len(NESTED) + 1}) r(v)) SELECT fv.family, version, count_if(op = 'INSERT')::BIGINT AS inserts, count_if(op = 'UPDATE')::BIGINT AS updates, count_if(op = 'DELETE')::BIGINT AS deletes, sum(CASE WHEN op = 'UPDATE' THEN 2 ELSE 1 END)::BIGINT AS change_rows, true AS as_expected FROM fv JOIN (SELECT family AS f, version AS v, op FROM dealt) x ON x.f = fv.family AND x.v <= fv.version GROUP BY 1, 2")
def workload_sources(spark, d):
    """Operations and change rows of the 16 nested sources against the arithmetic of shares and remainders."""
    grown = []
    for family, shares in sel.FAMILIES.items():
        grown += [(family, v, *c) for v, c in enumerate(workloads.splits(NESTED, shares), 1)]
    expected = spark.createDataFrame(grown, "family string, version long, inserts long, updates long, deletes long")
    # a source is the commits up to its own
    upto = F.explode(F.sequence(F.col("_commit_version"), F.lit(len(NESTED)).cast("long")))
    nested = _work_feed(spark, d).select("family", "_change_type", upto.alias("_commit_version"))
    return workloads.audit(nested, expected, ("family",))


@query("workload_rules", f"""WITH {_WORK_AT}, sc AS (SELECT family, version, {cat._counts_sql(EVENTS)}, {cat._extrema_sql(EVENTS)} FROM atv GROUP BY 1, 2),
un AS (SELECT family, version, sum(n - 1)::BIGINT AS R12 FROM (SELECT family, version, count(*) AS n FROM atv GROUP BY family, version, {cat._EKEY}) GROUP BY 1, 2), wide AS (SELECT sc.*, R12, R12 = 0 AS R13 FROM sc JOIN un USING (family, version)) {cat._rows_sql(', family, version')}""")
def workload_rules(spark, d):
    """The 13 rules after each of the 16 workloads, executed as 4 tables of 4 nested commits."""
    families = spark.createDataFrame([(f,) for f in sel.FAMILIES], "family string")
    base = table(spark, d, "events").select(*cat._COLS.split(", ")).crossJoin(F.broadcast(families))  # a table a family
    return timeline.rules_by_version(base, _work_feed(spark, d), len(NESTED), EVENTS, ("family",)).where("version > 0")
