"""Metamorphic tests: state plus changes equals full validation, at every version and edge."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from truemark.functions.rules import EVENTS, SCALARS
from truemark.operators import incremental as inc
from truemark.operators import selection as sel
from truemark.plans import catalogue
from truemark.sources.shared import written
from truemark.sources.versions import Versions, event_scenario, replay
from truemark.streaming.feed import streamed_deltas

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def state_rows(df):
    return rows(df.where("R01 > 0").select("p", *SCALARS))


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").cache()


def test_golden_rule_values(spark, events):
    t = event_scenario(events)
    got = [tuple(inc.full_validation(t.snapshot(v), EVENTS).first()) for v in range(5)]
    assert [g[0] for g in got] == [1000, 990, 990, 1002, 999]
    assert [g[2] for g in got] == [0, 0, 5, 9, 8]
    assert [round(g[7], 2) for g in got] == [0.03, 0.03, -75.58, -75.58, -57.96]
    assert [g[11] for g in got] == [0, 0, 0, 4, 4]


@pytest.mark.parametrize("first,last", [(0, 4), (1, 4), (2, 3), (3, 4)])
def test_maintained_state_equals_rebuilt(events, first, last):
    t = event_scenario(events)
    images = inc.net_images(t.changes(first + 1, last), "event_id")
    state = inc.maintained_state(inc.partition_state(t.snapshot(first), EVENTS), images, t.snapshot(last), EVENTS)
    assert state_rows(state) == state_rows(inc.partition_state(t.snapshot(last), EVENTS))


def test_key_state_chains(events):
    t, keys = event_scenario(events), ("b", *EVENTS.key, "frequency")
    now = inc.key_frequency(t.snapshot(0), EVENTS)
    for v in range(1, 5):
        overlay = inc.key_overlay(now, inc.key_delta(inc.net_images(t.changes(v, v), "event_id"), EVENTS), EVENTS)
        now = written(inc.compacted(now, overlay, EVENTS), "keys")  # a chain of states is cut at each step
    assert rows(now.select(*keys)) == rows(inc.key_frequency(t.snapshot(4), EVENTS).select(*keys))


def test_max_multiplicity_falls_back(spark):
    day = dt.datetime(2024, 1, 2)
    base = spark.createDataFrame([(i, day, 1, "a", 1.0, "") for i in range(3)] + [(9, day, 2, "b", 2.0, ""), (10, day, 2, "b", 2.0, "")], SCHEMA)
    t = Versions(base, "event_id").delete(F.col("event_id") < 2)
    f = inc.key_frequency(base, EVENTS)
    overlay = inc.key_overlay(f, inc.key_delta(inc.net_images(t.changes(1, 1), "event_id"), EVENTS), EVENTS)
    assert inc.incremental_uniqueness(inc.frequency_histogram(f), overlay).first().asDict() == {"R12": 1, "R13": False, "distinct_keys": 2, "duplicate_groups": 1, "max_multiplicity": 2}


def test_emptied_table_and_empty_feed(spark, events):
    t = Versions(events, "event_id").delete(F.lit(True))
    images = inc.net_images(t.changes(1, 1), "event_id")
    state = inc.maintained_state(inc.partition_state(events, EVENTS), images, t.snapshot(1), EVENTS)
    assert inc.roll_up(state).first()["R01"] == 0 and inc.roll_up(state).first()["R08"] is None
    assert t.changes(2, 1).count() == 0
    none = inc.net_images(t.changes(2, 1).select(*events.columns, "_change_type", "_commit_version"), "event_id")
    assert none.count() == 0


def test_merge_and_double_match(spark, events):
    src = events.limit(2).withColumn("op", F.lit("DELETE"))
    with pytest.raises(Exception, match="matches a row twice"):
        Versions(events, "event_id").merge(src.union(src)).snapshot().collect()
    t = Versions(events, "event_id").merge(catalogue._merge_source(spark, SF))
    assert t.history().where("version = 1").first()["row_count"] == t.snapshot().count()
    kinds = {r["change_type"]: r["n"] for r in inc.cdf_counts(t.changes(1, 1)).collect()}
    assert kinds["update_preimage"] == kinds["update_postimage"] and set(kinds) == {"delete", "insert", "update_preimage", "update_postimage"}


def test_save_replay_and_stream(spark, events, tmp_path):
    t, path = event_scenario(events), str(tmp_path / "t")
    t.save(path)
    for v in (0, 2, 4):
        assert rows(replay(spark, path, "event_id", v).select("event_id", "value")) == rows(t.snapshot(v).select("event_id", "value"))
    q = streamed_deltas(spark, path, EVENTS).writeStream.format("memory").queryName("deltas").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = inc.additive_delta(inc.net_images(t.changes(1, 4), "event_id"), EVENTS)
    nonzero = " OR ".join(f"R0{i} <> 0" for i in range(1, 8))
    assert rows(spark.table("deltas").where(nonzero)) == rows(want.where(nonzero))


def test_flagship_equals_full_validation(spark, events):
    got = {r["rule_id"]: r for r in entry.entry(spark).collect()}
    want = {r["rule_id"]: r for r in catalogue._rules_at(event_scenario(events).snapshot(4)).collect()}
    assert len(got) == 13 and {r["planner_mode"] for r in got.values()} <= {"STATE_ASSISTED", "AFFECTED_PARTITION_RECOMPUTE"}
    assert all(got[r][c] == want[r][c] for r in want for c in want[r].asDict())


def test_greedy_can_lose(spark):
    gains = spark.createDataFrame([("P", "A", 60, 66.0), ("P", "B", 50, 50.0), ("P", "C", 50, 50.0)], "profile_id string, state_id string, size_bytes long, gain double")
    budgets = spark.createDataFrame([(100,)], "budget_bytes long")
    g, o = sel.greedy(gains, budgets), sel.oracle(gains, budgets)
    assert (g.first()["portfolio"], o.first()["portfolio"]) == ("A", "B,C")
    assert sel.oracle_gap(g, o).first()["max_gap_percent"] == 34.0


def test_greedy_ties_go_to_the_last_name(spark):
    gains = spark.createDataFrame([("P", s, 60, 6.0) for s in "ABC"] + [("P", "D", 30, 3.0)], "profile_id string, state_id string, size_bytes long, gain double")
    budgets = spark.createDataFrame([(60,), (90,), (130,)], "budget_bytes long")
    assert {r["budget_bytes"]: r["portfolio"] for r in sel.greedy(gains, budgets).collect()} == {60: "C", 90: "C,D", 130: "B,C"}


def test_greedy_never_beats_oracle(spark):
    g = {(r["profile_id"], r["budget_bytes"]): r for r in catalogue.greedy_select(spark, SF).collect()}
    o = {(r["profile_id"], r["budget_bytes"]): r for r in catalogue.oracle_select(spark, SF).collect()}
    assert len(g) == len(o) == 45
    assert all(g[k]["gain"] <= o[k]["gain"] + 1e-5 and g[k]["storage"] <= k[1] for k in g)
