import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardgrid.operators import metrics as me
from wardgrid.operators import monitoring as mn
from wardgrid.operators import splits as sp
from wardgrid.operators.quantiles import exact_quantiles
from wardgrid.operators.scaling import Scaler, scaler_stats
from wardgrid.operators.slices import halo_chunks, running_totals, with_previous, with_sequence_number

T0 = datetime(2024, 1, 1)


def skewed(spark, n=3000):
    """One key holds most rows; times repeat."""
    rnd = random.Random(9)
    rows = [(i, 1 if rnd.random() < 0.8 else rnd.randint(2, 30), T0 + timedelta(seconds=rnd.randint(0, 900)),
             round(rnd.gauss(0, 50), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, key long, t timestamp, v double")


@pytest.mark.parametrize("max_rows", [50, 700, 10**9])
def test_previous_and_position_across_slices(spark, max_rows):
    df = skewed(spark)
    w = Window.partitionBy("key").orderBy("t", "id")
    want = df.select("id", F.lag("v").over(w).alias("p"), F.row_number().over(w).cast("long").alias("n"))
    prev = with_previous(df, ["key"], "t", ["t", "id"], ["v"], max_rows=max_rows).select("id", "prev_v")
    seq = with_sequence_number(df, ["key"], "t", ["t", "id"], max_rows=max_rows).select("id", "seq")
    both = want.join(prev, "id").join(seq, "id")
    assert both.count() == 3000
    assert both.where("NOT (p <=> prev_v) OR n <> seq").count() == 0


def test_quantiles_equal_numpy(spark):
    df = skewed(spark)
    got = exact_quantiles(df, ["key"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}).toPandas().set_index("key")
    for key, part in df.toPandas().groupby("key"):
        want = np.percentile(part.v, [0, 25, 50, 95, 100])
        np.testing.assert_allclose(got.loc[key].to_numpy(), want, atol=1e-9)


def test_quantiles_of_one_heavy_value(spark):
    df = spark.createDataFrame([(5.0,)] * 500 + [(float(i),) for i in range(-3, 3)] + [(None,)], "v double")
    row = exact_quantiles(df, [], "v", {"m": 0.5, "lo": 0.005}).first()
    assert row.m == 5.0 and row.lo == pytest.approx(np.percentile([5.0] * 500 + list(range(-3, 3)), 0.5))


@pytest.mark.parametrize("rows", [40, 10 ** 9])
def test_running_totals(spark, rows):
    df = skewed(spark).groupBy("key", "v").agg(F.count(F.lit(1)).alias("c"))
    got = running_totals(df, ["key"], ["v"], {"total": "c"}, rows)
    w = Window.partitionBy("key").orderBy("v")
    assert got.count() == df.count() and got.withColumn("w", F.sum("c").over(w)).where("w <> total").count() == 0


def dense_scores(spark):
    """Nine tenths of 20,000 scores between 0.90 and 0.91, all different."""
    at = (F.col("id") * 7919) % 20_000
    return spark.range(0, 20_000, 1, 4).select(
        "id", F.when(F.col("id") % 10 > 0, 0.90 + at / 2_000_000).otherwise(at / 20_000).alias("s"), (at % 3 == 0).cast("int").alias("y"))


def test_prefix_scan_cuts_dense_values(spark):
    df = dense_scores(spark).withColumn("one", F.lit(1))
    got = running_totals(df, [], ["s", "id"], {"rank": "one"}, 1000).toPandas().sort_values(["s", "id"])
    assert (got["rank"].to_numpy() == np.arange(1, 20_001)).all()


def test_no_range_of_a_prefix_scan_holds_many_more_rows_than_asked_for(spark, monkeypatch):
    from wardgrid.operators import slices
    written = []
    monkeypatch.setattr(slices, "store", lambda df, plain=slices.store: written.append(plain(df)) or written[-1])
    slices.running_totals(dense_scores(spark).withColumn("one", F.lit(1)), [], ["s"], {"rank": "one"}, 1000)
    sizes = [r["count"] for r in written[-1].groupBy("_range").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000


def test_ranking_quality_of_dense_scores(spark, monkeypatch):
    from wardgrid.operators import metrics, slices
    monkeypatch.setattr(slices.running_totals, "__defaults__", (1000,))
    got = metrics.ranking_quality(dense_scores(spark), [], "s", "y").first()
    p = dense_scores(spark).toPandas()
    ranks = p.s.rank().to_numpy()
    pos, n = int(p.y.sum()), len(p)
    assert got.auroc == pytest.approx((ranks[p.y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos)))


def test_quantiles_of_dense_values(spark):
    """Close values need several passes; the extremes of doubles need none to overflow."""
    rng = np.random.default_rng(6)
    v = np.concatenate([0.9 + rng.random(3000) * 1e-9, [1e308, -1e308, 5e-324, -5e-324, 0.0, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(3)
    row = exact_quantiles(df, [], "v", {"lo": 0.0, "a": 0.25, "m": 0.5, "b": 0.9, "hi": 1.0}).first()
    ordered = np.sort(v)

    def at(p):
        k = p * (len(v) - 1)
        low, high = ordered[int(np.floor(k))], ordered[int(np.ceil(k))]
        return low if low == high else low + (high - low) * (k - np.floor(k))
    assert (row.a, row.m, row.b) == pytest.approx((at(0.25), at(0.5), at(0.9)), rel=1e-15)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"m": 0.5}).count() == 0


def test_halo_rows_are_core_once(spark):
    df = spark.range(0, 1000).withColumn("p", F.col("id") * 5)
    cut = halo_chunks(df, "p", 100, 30, 4, step=5)
    assert cut.where("core").count() == 1000
    assert cut.where("chunk = 3").agg(F.min("id"), F.max("id")).first() == (270, 403)
    with pytest.raises(ValueError):
        halo_chunks(df, "p", 10, 11)


def test_split_counts_and_leaks(spark):
    cohort = spark.range(62).select(F.col("id").alias("subject_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("x"))
    cohort = cohort.withColumn("stay_id", F.col("subject_id") * 2 + F.col("x"))
    parts = sp.split_subjects(cohort)
    counts = {r.split: (r.patients, r.stays) for r in sp.split_summary(cohort, parts).collect()}
    assert counts == {"train": (43, 86), "validate": (9, 18), "test": (10, 20)}
    assert parts.select("subject_id").distinct().count() == 62
    good = spark.createDataFrame([("P1", "train"), ("P1", "train"), ("P2", "train"), ("P3", "validate"), ("P4", "test")],
                                 "subject_id string, split string")
    bad = good.unionByName(spark.createDataFrame([("P1", "validate")], good.schema))
    assert sp.overlap_names(good) == [] and sp.split_overlaps(good).count() == 3
    assert sp.overlap_names(bad) == ["train_vs_validate"]
    assert sp.is_subset(good.where("split = 'test'"), good) and not sp.is_subset(bad, good.where("split = 'test'"))


def test_scaler(spark, tmp_path):
    train = spark.createDataFrame([(80.0, 98.0, None), (90.0, 96.0, None), (100.0, 95.0, None)],
                                  "heart_rate double, spo2 double, wbc double")
    cols = ["heart_rate", "spo2", "wbc"]
    scaler = Scaler.fit(train, cols)
    assert scaler.stats["heart_rate"] == (90.0, 10.0, 90.0)
    assert scaler.stats["wbc"] == (0.0, 1.0, 0.0)
    test = spark.createDataFrame([(90.0, 95.0, None), (110.0, None, None), (999.0, 1.0, 5.0)], train.schema)
    out = scaler.transform(test, cols).collect()
    assert abs(out[0].heart_rate) < 1e-3 and all(v is not None for r in out for v in r)
    assert out[1].spo2 == 0.0 or abs(out[1].spo2) < 1.0
    assert out[2].heart_rate == pytest.approx((250.0 - 90.0) / (10.0 + 1e-6))
    scaler.save(spark, str(tmp_path / "scaler"))
    assert Scaler.load(spark, str(tmp_path / "scaler")) == scaler
    constant = spark.createDataFrame([(5.0,), (5.0,)], "heart_rate double")
    assert scaler_stats(constant, ["heart_rate"]).first()["std"] == 1.0


def brute_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_ranking_quality(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.7 + y * 0.2, 2)
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 400, "y": y, "s": s}))
    row = me.ranking_quality(df, ["k"], "s", "y").first()
    assert row.auroc == pytest.approx(brute_auroc(y, s))
    precision, recall, ap = 0.0, 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        precision, new = (y[hit] == 1).mean(), (y[hit] == 1).sum() / (y == 1).sum()
        ap, recall = ap + (new - recall) * precision, new
    assert row.average_precision == pytest.approx(ap)
    one = me.ranking_quality(df.where("y = 1"), ["k"], "s", "y").first()
    assert one.auroc is None and one.average_precision is None
    assert me.macro_micro(df.where("y = 1"), "k", "s", "y").first().macro_auroc == 0.5


def test_weights(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1)], "a int, b int, c int")
    got = {r.label: r.weight for r in me.positive_weights(labels, ["a", "b", "c"]).collect()}
    assert got["a"] == pytest.approx(1.0, rel=1e-4) and got["c"] == pytest.approx(3.0, rel=1e-4)
    assert me.positive_weights(labels.where("c = 9"), ["a"]).first().weight == 1.0


@pytest.mark.parametrize("missing", [0.0, 0.3])
@pytest.mark.parametrize("n", [30, 48, 3000])
def test_personal_baseline(spark, monkeypatch, n, missing):
    monkeypatch.setattr(mn, "COUNT_ROWS", 500)
    rng = np.random.default_rng(n)
    x = rng.normal(80, 10, n)
    x[rng.random(n) < missing] = np.nan
    if missing:
        x[60:120] = np.nan
    rows = [(1, i + 1, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, seq long, v double")
    got = mn.personal_baseline(df, ["k"], "v").orderBy("seq").toPandas()
    want, seen = np.full(n, np.nan), []
    for i, v in enumerate(x):
        if not np.isnan(v):
            seen.append(v)
            base = np.mean(seen) if len(seen) == 48 else 0.05 * v + 0.95 * base if len(seen) > 48 else np.nan
        want[i] = base if len(seen) >= 48 else np.nan
    np.testing.assert_allclose(got.baseline.to_numpy(float), want, atol=1e-9)
    np.testing.assert_allclose(got.deviation.to_numpy(float), x - want, atol=1e-9)


def test_a_burst_is_cut_by_its_rows(spark):
    """Nine tenths of a key's readings lie in one minute of a year; no slice holds many more rows than asked for."""
    from wardgrid.operators.slices import time_slices, with_previous, with_sequence_number
    rng = np.random.default_rng(8)
    seconds = np.sort(np.r_[rng.uniform(0, 3e7, 300), 1e7 + rng.uniform(0, 60_000, 2700)])
    df = spark.createDataFrame([(1, i, T0 + timedelta(seconds=float(s))) for i, s in enumerate(seconds)], "k long, id long, t timestamp")
    sizes = [r["count"] for r in time_slices(df, ["k"], "t", 100).groupBy("_slice").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 250
    got = with_previous(with_sequence_number(df, ["k"], "t", ["t", "id"], max_rows=100), ["k"], "t", ["t", "id"], ["id"], max_rows=100)
    assert got.where("seq <> id + 1 OR NOT prev_id <=> IF(id = 0, NULL, id - 1)").count() == 0


def test_repeats_in_one_crowded_second(spark):
    """One second holds all alerts; cut into many parts, the result is the same as of a plain lag."""
    rows = [(i, int(p)) for i, p in enumerate(np.random.default_rng(3).integers(0, 2, 2000))]
    log = spark.createDataFrame([(i, p, T0) for i, p in rows], "id long, patient_id long, ts timestamp")
    want = [i for i, p in rows if i == 0 or rows[i - 1][1] != p]
    for most in (50, 100_000):
        assert [r.id for r in mn.suppress_repeats(log, ["id"], max_rows=most).orderBy("id").collect()] == want


def test_repeated_alerts_and_lead_time(spark):
    at = [(1, T0), (1, T0 + timedelta(milliseconds=300)), (2, T0 + timedelta(milliseconds=400)),
          (1, T0 + timedelta(milliseconds=500)), (1, T0 + timedelta(seconds=1))]
    log = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(at)], "id long, patient_id long, ts timestamp")
    kept = [r.id for r in mn.suppress_repeats(log, ["id"]).orderBy("id").collect()]
    assert kept == [0, 2, 3, 4]
    events = spark.createDataFrame([(9, 1, T0 + timedelta(hours=3)), (8, 2, T0 + timedelta(hours=30)), (7, 3, T0)],
                                   "event_id long, patient_id long, ts timestamp")
    lead = {r.event_id: r.lead_minutes for r in mn.lead_times(log, events, 12).collect()}
    assert lead == {9: 180.0, 8: None, 7: None}
