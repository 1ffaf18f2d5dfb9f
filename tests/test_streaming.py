import uuid
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.plans import stream_queries
from wardgrid.session import shared_dir
from wardgrid.streaming import vitals as sv

T0 = datetime(2024, 1, 1)
SCHEMA = "patient_id long, ts timestamp, ord long, heart_rate double, spo2 double, systolic_bp double, " \
         "respiratory_rate double, body_temperature double, diastolic_bp double, risk double"


def write_steps(spark, folder, steps):
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def frame(p, i, risk=0.1, spo2=97.0):
    return (p, T0 + timedelta(minutes=i), i, 60.0 + i, spo2, 120.0, 16.0, 37.0, 80.0, risk)


def name():
    return uuid.uuid4().hex


def test_buffers_over_several_batches(spark, tmp_path):
    order = list(range(40))
    order[5], order[33] = order[33], order[5]  # late and early frames
    steps = [[frame(1, i, spo2=None if i == 39 else 97.0) for i in order[k:k + 10]] + [frame(2, k)] for k in range(0, 40, 10)]
    write_steps(spark, tmp_path, steps)
    stream = sv.replay(spark, str(tmp_path), SCHEMA)
    out = sv.run_to_table(sv.buffers(stream), name()).toPandas()
    last = out[out.patient_id == 1].sort_values(["newest", "size"]).iloc[-1]
    assert last["size"] == 24 and last.newest == pd.Timestamp(T0 + timedelta(minutes=39))
    assert [row[0] for row in last.matrix] == [60.0 + i for i in range(16, 40)]
    assert last.matrix[-1][1] == fx.LIVE_BASELINE["spo2"]
    assert len(out[out.patient_id == 2]) == 4 and out[out.patient_id == 2]["size"].max() == 4


def test_latest_state_is_upserted(spark, tmp_path):
    write_steps(spark, tmp_path, [[frame(1, 5), frame(2, 1)], [frame(1, 3)], [frame(2, 9)]])
    got = sv.latest_state(sv.replay(spark, str(tmp_path), SCHEMA), ["ts", "ord"], ["ts", "ord", "heart_rate"], name())
    assert {r.patient_id: r.heart_rate for r in got.collect()} == {1: 65.0, 2: 69.0}


def test_alerts_once_per_patient_and_second(spark, tmp_path):
    write_steps(spark, tmp_path, [[frame(1, 0, 0.9), frame(1, 0, 0.8), frame(2, 0, 0.5)], [frame(1, 0, 0.9), frame(1, 1, 0.7)]])
    got = sv.run_to_table(sv.alerts(sv.replay(spark, str(tmp_path), SCHEMA)), name())
    assert sorted((r.patient_id, r.second.minute) for r in got.collect()) == [(1, 0), (1, 1)]


def test_grid_means_drop_late_rows(spark, tmp_path):
    schema = "stay_id long, charttime timestamp, channel string, valuenum double"
    def write(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    write([(1, T0, "spo2", 90.0), (1, T0 + timedelta(minutes=5), "spo2", 94.0)])
    write([(1, T0 + timedelta(hours=5), "spo2", 99.0)])
    write([(1, T0 + timedelta(hours=6), "spo2", 98.0)])  # closes the first window
    write([(1, T0 + timedelta(minutes=6), "spo2", 10.0), (1, T0 + timedelta(hours=9), "spo2", 99.0)])
    stream = sv.replay(spark, str(tmp_path), schema)
    got = sv.run_to_table(sv.grid_means(stream, ["spo2"]), name()).orderBy("window").collect()
    assert [(r.window.start, r.spo2) for r in got] == [(T0, 92.0), (T0 + timedelta(hours=5), 99.0),
                                                       (T0 + timedelta(hours=6), 98.0)]


def test_messages_and_controls(spark):
    df = spark.createDataFrame([frame(1, 75, 0.12345), frame(2, 0, 0.5)], SCHEMA)
    controls = spark.createDataFrame([(1, ["hypoxia_drop", "hypoxia_drop"])], "patient_id long, anomalies array<string>")
    rows = {r.patient_id: r for r in sv.messages(sv.with_anomalies(df, controls)).collect()}
    assert rows[1].spo2 == 83.0 and rows[1].heart_rate == 160.0 and rows[1].is_anomaly_active
    assert rows[1].news2_tier == "High" and rows[1].health_risk_score == 0.1235 or rows[1].health_risk_score == 0.1234
    assert rows[2].spo2 == 97.0 and not rows[2].is_anomaly_active and rows[2].news2_tier == "Low"
    over = spark.createDataFrame([(2, 135.0, 82.0)], "patient_id long, set_heart_rate double, set_systolic_bp double")
    hit = {r.patient_id: r for r in sv.with_overrides(df, over).collect()}
    assert hit[2].shock_index == 135.0 / 82.0 and hit[1].heart_rate == 135.0


def test_snapshot_keeps_one_row_a_patient_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    schema = "patient_id long, ts timestamp, ord long, v double"
    steps = [[(1, "2024-01-01 00:00:00", 1, 1.0), (2, "2024-01-01 00:00:00", 2, 2.0)], [(1, "2024-01-02 00:00:00", 3, 3.0)],
             [(2, "2023-01-01 00:00:00", 4, 9.0), (3, "2024-01-01 00:00:00", 5, None)]]
    folder, name = str(tmp_path / "in"), f"latest-{uuid.uuid4().hex}"
    for rows in steps:
        df = spark.createDataFrame(rows, "patient_id long, ts string, ord long, v double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)
        got = sv.latest_state(sv.replay(spark, folder, schema), ["ts", "ord"], ["ts", "ord", "v"], name)
    base = f"{shared_dir(spark)}/{name}"
    assert {(r.patient_id, r.ord) for r in got.collect()} == {(1, 3), (2, 2), (3, 5)} and got.count() == 3
    assert spark.read.parquet(f"{base}/snapshot/0").count() == 0 and spark.read.parquet(f"{base}/snapshot/1").count() == 2
    # nothing new: the last snapshot stays
    again = sv.latest_state(sv.replay(spark, folder, schema), ["ts", "ord"], ["ts", "ord", "v"], name)
    assert again.count() == 3 and sv.snapshot(spark, base, 0) is None


def test_steps_of_many_files_are_one_micro_batch_each(spark, tmp_path):
    """The input has eight files, so a step that one task wrote would have one file; rows of later steps are later."""
    rows = [(i, f"2024-01-{1 + i % 28:02d}") for i in range(280)]
    df = spark.createDataFrame(rows, "k long, day string").withColumn("day", F.col("day").cast("date"))
    df.repartition(8).write.parquet(str(tmp_path / "t.parquet"))
    schema, name, seen = spark.read.parquet(str(tmp_path / "t.parquet")).schema, uuid.uuid4().hex, []

    def run(folder):
        out = sv.run_to_table(sv.replay(spark, folder, schema, files_per_step=sv.ALL_NEW), name)
        seen.append((len(spark.read.parquet(folder).inputFiles()), [r.day for r in out.collect()]))
        return out

    _, out = stream_queries._in_steps(spark, str(tmp_path), "t", "day", run)
    assert sorted(r.k for r in out.collect()) == list(range(280)) and len(seen) == 3
    assert all(files >= 2 * (i + 1) for i, (files, _) in enumerate(seen))
    before, after = seen[0][1], sorted(seen[2][1])[len(seen[1][1]):]
    assert len(before) < len(seen[1][1]) < 280 and max(before) < min(after)
    commits = spark.read.text(f"{shared_dir(spark)}/{name}/checkpoint/commits/[0-9]*")
    assert len(commits.inputFiles()) == 3
