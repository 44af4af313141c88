"""Tables in folders: pruned DML, files that stay, undone versions; states that are carried along."""

import pytest
from pyspark.sql import functions as F

from truemark.functions.keys import partition_id
from truemark.functions.rules import EVENTS, SCALARS
from truemark.operators import incremental as inc
from truemark.sources.chain import Chain
from truemark.sources.folders import FolderTable
from truemark.sources.shared import written
from truemark.sources.versions import Versions, event_scenario

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_by_folder(t):
    found = t.stored().select("p", F.col("_metadata.file_path").alias("f")).groupBy("p").agg(F.sort_array(F.collect_set("f")))
    return {r[0]: tuple(r[1]) for r in found.collect()}


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").cache()


@pytest.fixture
def table(events, tmp_path):
    return FolderTable.create(events, str(tmp_path / "t"), "event_id", partition_id())


def check(t, want, before, touched):
    after = files_by_folder(t)
    assert rows(t.rows().select(*t.columns)) == rows(want.select(*t.columns))
    assert rows(t.rows().where(F.col("p") != partition_id())) == []
    assert {p for p in before if before[p] == after.get(p)} == set(before) - set(touched)


def test_dml_rewrites_only_what_it_touches(spark, events, table):
    few = F.col("event_id").isin(3, 10, 44)
    want = Versions(events, "event_id")
    before = files_by_folder(table)
    assert len(before) == 64
    touched = table.delete(few)
    assert len(touched) <= 3
    check(table, want.delete(few).snapshot(), before, touched)

    before, sets = files_by_folder(table), {"value": F.col("value") + 1, "event_type": F.lit(None)}
    some = F.col("event_id").isin(5, 6)
    touched = table.update(some, sets)
    assert len(touched) <= 4 and rows(table.rows().where("event_id = 5").select("p")) != rows(events.where("event_id = 5").select(partition_id()))
    check(table, want.update(some, sets).snapshot(), before, touched)

    before = files_by_folder(table)
    more = events.where("event_id = 8").withColumn("event_id", F.lit(9_000_000).cast("long"))
    touched = table.insert(more)
    now = files_by_folder(table)
    assert len(touched) == 1 and all(set(before[p]) <= set(now[p]) for p in before)  # files only join
    check(table, want.insert(more).snapshot(), before, touched)

    before = files_by_folder(table)
    at = table.rows()
    source = at.where("event_id = 20").withColumn("op", F.lit("DELETE")).unionByName(at.where("event_id = 21").withColumn("value", F.lit(-5.0)).withColumn("op", F.lit("UPDATE")))
    source = source.unionByName(at.where("event_id = 22").withColumn("event_id", F.lit(9_000_001).cast("long")).withColumn("op", F.lit("INSERT")))
    source = source.unionByName(at.where("event_id = 23").withColumn("event_id", F.lit(77_777_777).cast("long")).withColumn("op", F.lit("UPDATE")))  # no such row
    source = source.unionByName(at.where("event_id = 24").withColumn("op", F.lit("INSERT")))  # there already
    source = written(source, "source")
    touched = table.merge(source)
    assert len(touched) <= 6
    check(table, want.merge(source.drop("p")).snapshot(), before, touched)
    assert [tuple(r)[1:5] for r in table.log().orderBy("version").collect()] == [("LOAD", 0, 0, 0), ("DELETE", 0, 0, 3), ("UPDATE", 0, 2, 0), ("INSERT", 1, 0, 0), ("MERGE", 1, 1, 1)]
    for v in range(5):
        assert rows(table.as_of(v)) == rows(want.snapshot(v).select(*table.columns))
        assert rows(table.changes(v, v)) == rows(want.changes(v, v))
    assert [tuple(r) for r in table.history().orderBy("version").select("row_count", "change_count").collect()] == [(r["row_count"], r["change_count"]) for r in want.history().orderBy("version").collect()]


def test_scan_is_pruned_and_source_read_once(spark, table):
    held = table.rows().where(F.col("p").isin([1, 2]))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [p" in plan and held.select(F.col("p")).distinct().count() == 2
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    source = table.rows().where("event_id = 20").withColumn("op", F.lit("DELETE")).coalesce(1).mapInArrow(counted, table.rows().withColumn("op", F.lit("")).schema)
    table.merge(source)
    assert reads.value == 1


def test_emptied_partition_and_table(spark, table):
    table.delete(F.col("p") == 7)
    assert table.rows().where("p = 7").count() == 0 and table.stored().where("p = 7").count() == 1
    table.delete(F.lit(True))
    assert table.rows().count() == 0 and len(files_by_folder(table)) == 64 and table.as_of(0).count() == 1000
    detail = table.detail().first()
    assert detail["row_count"] == 0 and detail["files"] == 64 and detail["properties"]["row_key"] == "event_id"


def test_overwrite_is_a_commit(spark, events, table):
    table.delete(F.col("event_id") == 3)
    table.overwrite(events.where("event_id < 300").withColumn("value", F.lit(0.5)))
    assert table.rows().count() == 300 and table.version == 2
    assert rows(table.as_of(1)) == rows(events.where("event_id <> 3").select(*table.columns)) and rows(table.as_of(0)) == rows(events.select(*table.columns))


def test_merge_refuses_two_rows_for_a_key(spark, table):
    one = table.rows().where("event_id = 3").withColumn("op", F.lit("DELETE"))
    with pytest.raises(Exception, match="matches a row twice"):
        table.merge(one.unionByName(one))


def test_existing_table_is_refused(events, table):
    with pytest.raises(Exception, match="already exists"):
        FolderTable.create(events, table.path, "event_id", partition_id())


# ------------------------------------------------------------------------------- carried states


def key_files(chain):
    found = chain.spark.read.parquet(f"{chain.root}/keys").select("b", F.col("_metadata.file_path").alias("f")).distinct()
    return {r["b"]: r["f"] for r in found.collect()}


def test_chain_equals_rebuilt_states(spark, events, tmp_path):
    t = event_scenario(events)
    chain = Chain(spark, str(tmp_path / "c"), EVENTS, "event_id").start(t.snapshot(0))
    for v in range(1, 5):
        before = key_files(chain)
        assert chain.advance(v, t.changes(v, v), lambda: t.snapshot(v))
        assert not chain.advance(v, t.changes(v, v), lambda: t.snapshot(v))  # again: nothing happens
        touched = {r["b"] for r in chain.overlay(v).select("b").distinct().collect()}
        after = key_files(chain)
        assert {b for b in before if before[b] == after.get(b)} == set(before) - touched
        want = inc.key_frequency(t.snapshot(v), EVENTS)
        assert rows(chain.keys().select("b", *EVENTS.key, "frequency")) == rows(want)
        assert rows(chain.histogram(v)) == rows(inc.frequency_histogram(want))
        assert rows(chain.state(v).select("p", *SCALARS)) == rows(inc.partition_state(t.snapshot(v), EVENTS).select("p", *SCALARS))
        full = inc.full_validation(t.snapshot(v), EVENTS).first()
        assert (full["R12"], full["R13"]) == tuple(chain.uniqueness(v).first()[:2])


def test_a_broken_step_is_run_again(spark, events, tmp_path):
    """A failure after the buckets were rewritten: the rerun finds the overlay and gives the same states."""
    t = event_scenario(events)
    chain = Chain(spark, str(tmp_path / "c"), EVENTS, "event_id").start(t.snapshot(0))

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        chain.advance(1, t.changes(1, 4), broken)
    assert chain.advance(1, t.changes(1, 4), lambda: t.snapshot(4))
    assert rows(chain.keys().select("b", *EVENTS.key, "frequency")) == rows(inc.key_frequency(t.snapshot(4), EVENTS))
    assert rows(chain.state(1).select("p", *SCALARS)) == rows(inc.partition_state(t.snapshot(4), EVENTS).select("p", *SCALARS))
