"""Rules at every version, canonical keys, sketches, workloads and streams."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from truemark.functions.keys import EVENT_KEY, canonical, kinds, row_key
from truemark.functions.rules import CUSTOMER, EVENTS
from truemark.operators import incremental as inc
from truemark.operators import selection as sel
from truemark.operators import sketches, timeline, workloads
from truemark.plans import catalogue, maintenance
from truemark.sources.chain import Chain
from truemark.sources.versions import Versions, event_scenario, replay
from truemark.streaming.feed import carry, maintain

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").cache()


def test_timeline_equals_full_validation_on_random_commits(spark, events):
    draw, t = random.Random(3), Versions(events.where("event_id < 200"), "event_id")
    e = F.col("event_id")
    for v in range(1, 6):
        n, k = draw.randrange(3, 9), draw.randrange(3)
        kind = draw.choice(["delete", "update", "insert"])
        if kind == "delete":
            t.delete(e % n == k)
        elif kind == "update":
            t.update(e % n == k, {"value": F.when(e % 2 == 0, None).otherwise(F.col("value") * -2), "user_id": F.col("user_id") + v})
        else:
            t.insert(t.snapshot().where(e % n == k).withColumn("event_id", e + 1000 * v))
    t.delete(F.lit(True))  # the last version is empty
    got = timeline.at_versions(timeline.steps(t.snapshot(0), t.changes(1, t.version), EVENTS), t.version, EVENTS).orderBy("version").drop("version").collect()
    assert [str(tuple(r)) for r in got] == [str(tuple(inc.full_validation(t.snapshot(v), EVENTS).first())) for v in range(t.version + 1)]


def test_timeline_with_measures_outside_the_key(spark):
    """CUSTOMER holds (nation, segment) unique, and its extrema are of another column."""
    rows_ = spark.read.parquet(f"{SF}/customer.parquet")
    t = Versions(rows_, "c_custkey").delete(F.col("c_custkey") % 3 == 0).update(F.col("c_custkey") % 5 == 1, {"c_acctbal": -F.col("c_acctbal"), "c_mktsegment": F.lit(None)})
    got = timeline.at_versions(timeline.steps(rows_, t.changes(1, 2), CUSTOMER), 2, CUSTOMER).orderBy("version").drop("version").collect()
    assert [str(tuple(r)) for r in got] == [str(tuple(inc.full_validation(t.snapshot(v), CUSTOMER).first())) for v in range(3)]


def test_base_and_feed_are_read_once(spark, events):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    base = events.coalesce(1).mapInArrow(counted, events.schema)
    timeline.at_versions(timeline.steps(base, event_scenario(events).changes(1, 4), EVENTS), 4, EVENTS).collect()
    assert reads.value == 1


def test_corner_cases_move_the_rules_they_should(spark):
    moved = {}
    for r in maintenance.corner_case_commits(spark, SF).where("changed").collect():
        moved.setdefault(r["version"], set()).add(r["rule_id"])
    assert {"R01", "R08"} <= moved[1] and {"R01", "R09"} <= moved[2] and {"R01", "R02"} <= moved[5] and {"R01", "R03"} <= moved[6]
    assert {"R01", "R04", "R08"} <= moved[7] and {"R01", "R05", "R06", "R10"} <= moved[8] and {"R01", "R07"} <= moved[10] and {"R01", "R07"} <= moved[11]


# ------------------------------------------------------------------------------- keys


def test_row_keys_are_injective(spark):
    odd = [float("nan"), float("inf"), -float("inf"), 0.0, 0.1, 1e20, -1e20, 1e300, 5e-324, 1e-300, 2.0**63, 2.0**53 + 2, None]
    texts = ["a", "1:a", "a;", ";", ":", "~", "", None, "1:a1;", "é"]
    made = [(t, u, v, n) for t in texts for u in ("a", None, "1:") for v in odd for n in (1, -1, None)]
    df = spark.createDataFrame(made, "t string, u string, v double, n long").withColumn("a.`b", F.lit(1))
    keyed = df.select(row_key(df).alias("k"), row_key(df, ["t", "u"]).alias("tu"))
    assert keyed.select("k").distinct().count() == len(made) and keyed.select("tu").distinct().count() == 30
    assert keyed.where("length(k) <> 32").count() == 0
    zeros = spark.createDataFrame([(0.0, float("nan")), (-0.0, float("nan"))], "a double, b double")
    assert zeros.select(row_key(zeros)).distinct().count() == 1
    with pytest.raises(ValueError, match="array"):
        row_key(spark.createDataFrame([([1],)], "a array<int>"))


def test_row_keys_are_hashes_of_the_canonical_text(spark):
    near = [m * 2.0**e + d for e in (-1074, -1022, -84, -83, -53, -32, -31, -30, -1, 0, 1, 30, 51, 52, 53, 62, 63, 64, 1022) for m in (1.0, 1.1, -1.7) for d in (0.0, 2.0**-83, 0.5)]
    odd = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 0.01, -0.04, 84197.04, 1.7976931348623157e308, 5e-324, 1.0 - 2.0**-53, 2.0**63 - 1024, *near]
    made = [(v, i if i % 3 else None, "é;" if i % 2 else None, dt.datetime(2024, 1, 1, 0, 0, i % 60, i) if i % 5 else None) for i, v in enumerate(odd)]
    df = spark.createDataFrame(made, "`x` double, n int, `t.``u` string, at timestamp_ntz").withColumn("f", F.expr("cast(x as float)")).withColumn("ok", F.expr("n > 9"))
    whole = F.unhex(F.sha2(F.expr(canonical(kinds(df))), 256))
    assert df.where(row_key(df).isNull() | (row_key(df) != whole)).count() == 0
    assert df.select(row_key(df, ["x"])).distinct().count() == len({repr(v + 0.0 if v is not None else v) for v in odd})


def test_row_keys_of_many_columns_are_compiled(spark):
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet")
    wide = lineitem.select("*", *(F.col("l_tax").alias(f"tax{i}") for i in range(12)))
    for rows in (lineitem, wide):
        plan = rows.select(row_key(rows))._jdf.queryExecution()
        methods = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(plan, "codegen"))
        assert all(int(n) < 8000 for n in methods), methods  # the JVM interprets larger ones at every row


def test_event_keys_take_any_double(spark):
    df = spark.createDataFrame([(1, "a", v) for v in (float("nan"), 1e20, 9e16, -1e300, None, 0.01)], "user_id long, event_type string, value double")
    assert df.select(F.expr(EVENT_KEY)).distinct().count() == 6


# ------------------------------------------------------------------------------- sketches, workloads


def test_sketches_merge_over_versions(spark, events):
    t = event_scenario(events)
    made = sketches.key_sketches(events, t.changes(1, 4), EVENTS)
    assert made.where("version = 0").count() == 64
    exact = {r["version"]: r["exact_distinct"] for r in sketches.exact_by_version(events, t.changes(1, 4), EVENTS, 4).collect()}
    for r in sketches.distinct_by_version(made, 4).collect():
        assert abs(r["estimate"] - exact[r["version"]]) <= 4 * sketches.ERROR * exact[r["version"]] + 1 and r["rows"] >= exact[r["version"]]


def test_ranks_are_global_and_gapless(spark, events):
    got = workloads.ranked(events.select("event_id"), "event_id", parts=7).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and {r["event_id"] for r in got} == {r["event_id"] for r in events.collect()}


def test_nested_sources_hold_each_other(spark, events):
    sizes = (7, 30, 100)
    dealt = workloads.dealt(workloads.ranked(events, "event_id"), sel.FAMILIES, sizes).collect()
    for family, shares in sel.FAMILIES.items():
        own, before = [d for d in dealt if d["family"] == family], set()
        for v, counts in enumerate(workloads.splits(sizes, shares), 1):
            now = {(d["op"], d["event_id"]) for d in own if d["version"] <= v}
            assert before <= now and tuple(sum(op == o for op, _ in now) for o in ("INSERT", "UPDATE", "DELETE")) == counts and sum(counts) == sizes[v - 1]
            before = now
        assert not {i for op, i in before if op == "UPDATE"} & {i for op, i in before if op == "DELETE"}


def test_workload_keys_follow_the_largest(spark):
    feed = maintenance._work_feed(spark, SF)
    top = spark.read.parquet(f"{SF}/events.parquet").agg(F.max("event_id")).first()[0]
    made = [r["event_id"] for r in feed.where("_change_type = 'insert' AND family = 'INSERT_ONLY'").collect()]
    assert sorted(made) == list(range(top + 1, top + 1 + len(made)))


# ------------------------------------------------------------------------------- streams


def test_stream_carries_states_and_replays_change_nothing(spark, events, tmp_path):
    t, path = event_scenario(events), str(tmp_path / "t")
    t.save(path)
    chain = Chain(spark, f"{path}/states", EVENTS, "event_id").start(t.snapshot(0))
    snapshot = lambda v: replay(spark, path, "event_id", v)
    run = maintain(spark, f"{path}/changes", chain, snapshot, f"{path}/checkpoint", files_per_batch=2)
    run.awaitTermination()
    step = chain.last_step()
    assert step > 1

    def states():
        return rows(chain.state(step)), rows(chain.keys()), rows(chain.histogram(step))

    after = states()
    assert after[0] == rows(inc.partition_state(t.snapshot(4), EVENTS).select(*chain.state(step).columns))
    assert rows(chain.keys().select("b", *EVENTS.key, "frequency")) == rows(inc.key_frequency(t.snapshot(4), EVENTS))
    assert tuple(chain.uniqueness(step).first()[:2]) == tuple(inc.full_validation(t.snapshot(4), EVENTS).first())[-2:]
    for batch in range(step):  # Spark hands every batch over once more
        carry(chain, snapshot)(spark.read.parquet(f"{path}/changes"), batch)
    assert states() == after


def test_queries_are_registered():
    assert {"planned_rules", "rules_by_version", "streamed_state", "dml_merge"} <= set(catalogue.QUERIES)
