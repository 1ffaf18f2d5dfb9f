"""Sources and sinks on damaged and half-written files."""

import pytest
from pyspark.sql import functions as F

from wardgrid.sources import sinks, tables


def test_lines_that_do_not_fit_are_kept_apart(spark, tmp_path):
    (tmp_path / "icu").mkdir()
    (tmp_path / "icu" / "icustays.csv").write_text("stay_id,subject_id,hadm_id,intime,extra\n1,2,3,t,x\nsecond,2,3,t,y\n4,5,6,,\n")
    got = tables.read_checked(spark, str(tmp_path), "icu/icustays")
    assert [(r.stay_id, r.intime, r.outtime) for r in got.rows.orderBy("stay_id").collect()] == [(1, "t", None), (4, None, None)]
    assert [r.line for r in got.quarantine.collect()] == ["second,2,3,t,y"]
    assert {(r.column_name, r.state) for r in got.drift.collect()} == {
        ("outtime", "missing"), ("extra", "unexpected"), ("stay_id", "moved"), ("subject_id", "moved"), ("hadm_id", "moved")}


def test_empty_file_and_missing_file(spark, tmp_path):
    (tmp_path / "icu").mkdir()
    (tmp_path / "icu" / "d_items.csv").write_text("itemid,label\n")
    got = tables.read_checked(spark, str(tmp_path), "icu/d_items")
    assert (got.rows.count(), got.quarantine.count(), got.drift.count()) == (0, 0, 0)
    with pytest.raises(tables.TableNotFound):
        tables.read_checked(spark, str(tmp_path), "icu/icustays")


def test_broken_batch_counts_for_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (None, "c"), (None, "c")], "k int, v string")
    assert sinks.append_batch(df.where("k = 1"), path, ["k"], "one") == 1
    # a run that ended after its rows and before the log
    df.where("k = 2").write.parquet(f"{path}/rows/batch=two")
    assert sinks.read_appended(spark, path).count() == 1
    assert sinks.append_batch(df, path, ["k"], "two", "v") == 2
    assert sinks.append_batch(df, path, ["k"], "two", "v") == 0
    assert {tuple(r) for r in sinks.read_appended(spark, path).collect()} == {(1, "a"), (2, "a"), (None, "c")}


def test_batch_without_news(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [sinks.append_new(df, path, ["k"]) for _ in range(3)] == [1, 0, 0]
    assert sinks.read_appended(spark, path).count() == 1


def test_same_rows_give_same_shards_and_changes_show(spark, tmp_path):
    rows = spark.range(0, 500, 1, 3).select("id", F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    sinks.write_shards(rows, str(tmp_path / "a"), ["id"], shards=4)
    sinks.write_shards(rows.orderBy(F.desc("id")), str(tmp_path / "b"), ["id"], shards=4)
    a, b = [sorted(map(tuple, sinks.verify_shards(spark, str(tmp_path / x)).select("split", "shard", "n", "sound").collect())) for x in "ab"]
    assert a == b and len(a) == 8 and all(r[3] for r in a) and sum(r[2] for r in a) == 500
    spark.createDataFrame([(9999,)], "id long").write.mode("append").parquet(str(tmp_path / "b/rows/split=train/shard=2"))
    bad = sinks.verify_shards(spark, str(tmp_path / "b")).where("not sound").collect()
    assert [(r.split, r.shard, r.found - r.n) for r in bad] == [("train", 2, 1)]
