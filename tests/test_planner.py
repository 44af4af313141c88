"""Plans over kept states: what they answer, what they leave out, and that folders are pruned."""

import datetime as dt
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from truemark.functions.keys import partition_id
from truemark.functions.rules import EVENTS, RULES, display_value, rule_rows
from truemark.operators import consolidate as con
from truemark.operators import incremental as inc
from truemark.operators import planner
from truemark.operators import selection as sel
from truemark.plans import catalogue, registered
from truemark.sources import files
from truemark.sources.shared import written
from truemark.sources.stored import adaptive_write, by_folder, stored
from truemark.sources.versions import Versions, event_scenario

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def kept(spark):
    return catalogue._stored(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def place(df):
    """The folder that a stored frame lies in."""
    return os.path.dirname(df.inputFiles()[0].split("/p=")[0].split("/b=")[0])


@pytest.mark.parametrize("held", [(), ("S12",), ("S01", "S05"), ("S08", "S11"), planner.STATES[:11], planner.STATES])
def test_any_portfolio_gives_full_validation(spark, kept, held):
    got = {r["rule_id"]: r for r in planner.planned_rules(kept, EVENTS, "event_id", held).collect()}
    want = {r["rule_id"]: r for r in catalogue._rules_at(kept.end).collect()}
    for r in RULES:
        assert all(got[r][c] == want[r][c] for c in ("long_value", "double_value", "boolean_value", "status")), (held, r)
        assert (got[r]["planner_mode"] == planner.SCANNED) == (planner.state_of(r) not in held)


def test_plans_leave_scans_out(kept):
    """With all states kept the end snapshot is read for recomputes alone, behind a pruning filter; else
    once for the scalar rules without a state, and once for the key count unless S12 is kept."""

    def scans(held):
        lines = [x for x in plan(planner.answers(kept, EVENTS, "event_id", held)).splitlines() if "FileScan" in x and "/end-" in x]
        pruned = sum("dynamicpruning" in x for x in lines)
        return len(lines) - pruned, pruned

    assert scans(planner.STATES) == (0, 1)
    assert scans(planner.STATES[:11]) == (1, 1)
    assert scans(("S12",)) == (1, 0) and scans(()) == (2, 0)


def test_recomputes_and_lookups_read_their_folders_alone(spark, kept):
    """Asserted by the files that rows come from, and by the pruning filter of the scans."""
    t = Versions(spark.read.parquet(f"{SF}/events.parquet"), "event_id")
    least = F.col("event_id") == t.snapshot(0).orderBy("value").first()["event_id"]
    t.delete(least)
    images = written(inc.net_images(t.changes(1, 1), "event_id"), "images")
    touched = {r["p"] for r in inc.affected_partitions(images).collect()}
    end = by_folder(t.snapshot().withColumn("p", partition_id()), "end", "p")
    changes = inc.state_changes(images, kept.state, EVENTS)
    flagged = changes.where(inc._any("i_")).select(F.col("p").alias("_p"))
    near = inc.in_partitions(end, flagged)
    assert "dynamicpruning" in plan(near.groupBy("p").count())
    read = {r[0] for r in near.select("p").distinct().collect()}
    assert read == touched and len(read) == 1

    delta = written(inc.key_delta(images, EVENTS), "delta")
    near = inc.in_buckets(kept.keys, delta)
    assert "dynamicpruning" in plan(near.groupBy("b").count())
    assert {r[0] for r in near.select("b").distinct().collect()} == {r["b"] for r in delta.collect()}
    metrics = near.groupBy("b").agg(F.count("*"))
    metrics.collect()
    assert files_read(metrics) == len(delta.collect()) < 256


def files_read(df):
    """Files that the executed scans of ``df`` with a pruning filter opened."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec" and "dynamicpruning" in node.toString():
            found.append(node.metrics().apply("numFiles").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def test_stored_state_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.where("event_id < 500").write.parquet(path)
    make = lambda: event_scenario(spark.read.parquet(path))
    first = stored(spark, path, make, EVENTS)
    assert stored(spark, path, make, EVENTS) is first
    events.write.mode("overwrite").parquet(path)
    assert inc.roll_up(stored(spark, path, make, EVENTS).state).first()["R01"] == 1000


def test_adaptive_write_is_one_file_or_folders(spark):
    rows = spark.range(100).select("id", (F.col("id") % 7).cast("int").alias("b"))
    for small, folders in ((100, 0), (99, 7)):
        df = adaptive_write(rows, "adaptive", "b", small)
        assert df.count() == 100 and len({f.split("/b=")[1] for f in df.inputFiles() if "/b=" in f}) == (0 if not folders else len(df.inputFiles()))
        assert len({f.split("/b=")[1].split("/")[0] for f in df.inputFiles() if "/b=" in f}) == folders


# ------------------------------------------------------------------------------- consolidation, catalogue


def test_consolidation_checks_what_it_folds(spark, kept):
    tables, baseline = con.store_states(kept.state), inc.roll_up(kept.state)
    got = con.consolidated(tables, baseline)
    assert sorted(map(str, got.collect())) == sorted(map(str, kept.state.select(*got.columns).collect()))

    def broken(state, change):
        return con.consolidated(tables | {state: change(tables[state])}, baseline)

    with pytest.raises(Exception, match="S03: partition 5 occurs 2 times"):
        broken("S03", lambda t: t.unionByName(t.where("p = 5"))).collect()
    with pytest.raises(Exception, match="S09: partition 6 occurs 0 times"):
        broken("S09", lambda t: t.where("p <> 6")).collect()
    with pytest.raises(Exception, match="S02: partition 7 has no count"):
        broken("S02", lambda t: t.withColumn("value", F.when(F.col("p") != 7, F.col("value")))).collect()
    with pytest.raises(Exception, match="S01: the partitions don't make up the baseline's R01"):
        broken("S01", lambda t: t.withColumn("value", F.col("value") + (F.col("p") == 8).cast("int"))).collect()
    with pytest.raises(ValueError, match="S11"):
        con.consolidated({s: t for s, t in tables.items() if s != "S11"}, baseline)


def test_measured_sizes_are_the_file_systems(kept):
    tables = con.store_states(kept.state) | {"S12": kept.keys}
    for r in con.measured(tables).collect():
        paths = [f.removeprefix("file://") for f in tables[r["state_id"]].inputFiles()]
        held = [p for p in paths if pq.read_metadata(p).num_rows]
        assert (r["files"], r["size_bytes"], r["row_count"]) == (len(held), sum(map(os.path.getsize, held)), tables[r["state_id"]].count())
        assert r["state_id"] != "S12" or r["files"] > 200


def test_costs_are_medians_of_trials(spark):
    states = {r["state_id"]: r for r in catalogue._states(spark, SF).collect()}
    trials = spark.read.parquet(f"{SF}/orders.parquet").toPandas()
    median = trials.groupby("o_orderstatus")["o_totalprice"].median().round(6)
    assert {states[f"S{i:02d}"]["cost"] for i in range(1, 12)} == {median["F"]} and states["S12"]["cost"] == median["O"] and states["S12"]["recurring"] == median["P"]
    assert all(r["size_bytes"] > 0 for r in states.values()) and states["S12"]["size_bytes"] > 10_000


def test_ablation_takes_the_cheaper_path(spark, kept):
    got = {r["version"]: r for r in registered.QUERIES["uniqueness_ablation"](spark, SF).collect()}
    assert all(r["agree"] for r in got.values()) and got[1]["bucket_share"] < got[4]["bucket_share"] <= 1
    for r in got.values():
        assert (r["path"] == "KEY_STATE") == (r["keys_read"] + r["changed_rows"] < r["rows"])


def test_key_paths_open_these_bytes(spark, kept):
    delta = inc.key_delta(inc.net_images(kept.feed.where("_commit_version = 1"), "event_id"), EVENTS)
    overlay = written(inc.key_overlay(kept.keys, delta, EVENTS), "overlay")
    got = con.key_path_bytes(kept.keys, overlay, kept.end).first()
    sizes = {p: os.path.getsize(p) for p in (f.removeprefix("file://") for f in kept.keys.inputFiles())}
    touched = {r["b"] for r in overlay.select("b").distinct().collect()}
    assert got["all_state_bytes"] == sum(sizes.values())
    assert got["state_bytes"] == sum(n for p, n in sizes.items() if int(p.split("/b=")[1].split("/")[0]) in touched) < got["all_state_bytes"]
    assert got["scan_bytes"] == sum(os.path.getsize(f.removeprefix("file://")) for f in kept.end.inputFiles())


# ------------------------------------------------------------------------------- reports and contracts


def test_schema_drift_is_refused(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in "abc")
    spark.range(3).withColumn("x", F.lit("y")).write.parquet(a)
    spark.range(4).withColumn("x", F.lit("z")).write.parquet(b)
    spark.range(4).withColumn("x", F.lit(1.5)).write.parquet(c)
    schema = spark.read.parquet(a).schema
    assert files.checked_scan(spark, [b, a], schema).count() == 7
    with pytest.raises(ValueError, match="c departs from the schema.*double"):
        files.checked_scan(spark, [a, b, c], schema)


def test_display_has_twelve_digits(spark):
    values = [0.0, -0.0, 1.5, 100.0, -75.58, 7698.000000000001, 123456789012.25, 1e12, 1.25e-7, 0.0001, 1 / 3, 2e300, float("nan"), float("inf"), -float("inf"), None]
    rows = spark.createDataFrame([(i, None, v, None) for i, v in enumerate(values)], "i int, long_value long, double_value double, boolean_value boolean")
    got = [r[0] for r in rows.orderBy("i").select(display_value()).collect()]
    assert got == ["0" if v == 0 else "" if v is None else f"{v:.12g}" for v in values]


def test_weights_must_be_whole(spark):
    made = sel.normalized(spark.createDataFrame([("a", r, 2.0) for r in range(13)] + [("b", r, 1.0) for r in range(12)], "profile_id string, rule int, raw_weight double"))
    assert {r["profile_id"]: r["sane"] for r in sel.sane_weights(made).collect()} == {"a": True, "b": False}


def test_rule_rows_of_odd_doubles(spark):
    """NaN, infinities and doubles beyond a long pass through partitions, buckets and rules."""
    day = dt.datetime(2024, 1, 2)
    odd = [float("nan"), float("nan"), float("inf"), -float("inf"), 1e20, -1e300, 5e-324, 0.0, -0.0, None]
    base = spark.createDataFrame([(i, day, 1, "a", v, "") for i, v in enumerate(odd)], SCHEMA)
    t = Versions(base, "event_id").delete(F.col("event_id").isin(2, 4))
    images = inc.net_images(t.changes(1, 1), "event_id")
    state = inc.maintained_state(inc.partition_state(base, EVENTS), images, t.snapshot(1), EVENTS)
    frequencies = inc.key_frequency(base, EVENTS)
    unique = inc.incremental_uniqueness(inc.frequency_histogram(frequencies), inc.key_overlay(frequencies, inc.key_delta(images, EVENTS), EVENTS))
    rolled = inc.roll_up(state).crossJoin(unique.select("R12", "R13"))
    got, want = rule_rows(rolled).collect(), catalogue._rules_at(t.snapshot(1)).collect()
    assert list(map(str, got)) == list(map(str, want)) and {r["rule_id"]: r["long_value"] for r in got}["R12"] == 2
