"""File lists, sizes, typed text, guards, and states in one file or in folders."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truemark.operators import incremental as inc
from truemark.plans import catalogue
from truemark.functions.rules import EVENTS
from truemark.sources import files
from truemark.sources.stored import adaptive_write
from truemark.sources.versions import event_scenario

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_file_list_and_sizes(spark, tmp_path):
    for k in range(3):
        spark.range(k, 2 * k + 1).coalesce(1).write.parquet(str(tmp_path / f"m{k}"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("absent", T.StringType())])
    got = files.scan_files(spark, [str(tmp_path / "m2"), str(tmp_path / "m[01]"), str(tmp_path / "m2")], schema)
    assert rows(got) == [(0, None), (1, None), (2, None), (2, None), (3, None), (4, None)]
    sizes = {r["size_bytes"]: r["row_count"] for r in files.file_sizes(spark.read.parquet(str(tmp_path / "m2"))).collect()}
    part = [p for p in os.listdir(tmp_path / "m2") if p.endswith(".parquet")]
    assert sizes == {os.path.getsize(tmp_path / "m2" / part[0]): 3}


def test_typed_csv_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.1), (2, None, None), (3, 'q"', -1e300)], "k long, s string, v double")
    df.write.csv(str(tmp_path / "c"), header=True)
    assert rows(files.typed_csv(spark, str(tmp_path / "c"), df.schema)) == rows(df)


def test_guards(spark):
    two = spark.range(2)
    assert rows(files.single_row(two.where("id = 1"), "it")) == [(1,)]
    for wrong in (two, two.where("id > 5")):
        with pytest.raises(Exception, match="it must have one row"):
            files.single_row(wrong, "it").collect()
    assert [files.exists(two.where(p)).first()["found"] for p in ("id = 1", "id = 7")] == [True, False]
    nulls = spark.createDataFrame([(1, None), (None, "a"), (2, "b")], "a long, b string")
    assert rows(nulls.where(files.any_null("a", "b"))) == [(1, None), (None, "a")]


def test_saving_is_create_only(spark, tmp_path):
    t = event_scenario(spark.read.parquet(f"{SF}/events.parquet"))
    t.save(str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        t.save(str(tmp_path / "t"))


def test_state_in_folders_or_in_one_file(spark):
    t = event_scenario(spark.read.parquet(f"{SF}/events.parquet"))
    keys = inc.key_frequency(t.snapshot(0), EVENTS)
    delta = inc.key_delta(inc.net_images(t.changes(1, 4), "event_id"), EVENTS)
    few, many = adaptive_write(keys, "keys", "b"), adaptive_write(keys, "keys", "b", small=10)
    assert few.columns == many.columns and rows(few) == rows(many) == rows(keys)
    assert len(few.inputFiles()) < len(many.inputFiles())
    assert rows(inc.key_overlay(few, delta, EVENTS)) == rows(inc.key_overlay(many, delta, EVENTS))


def test_chain_takes_each_candidate_once(spark):
    got = catalogue.ranked_merge_source(spark, "/root/testdata/sf0.01")
    assert got.agg(F.count_distinct("marker") == F.count("*"), F.max("rank") == F.count("*")).first() == (True, True)
