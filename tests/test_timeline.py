import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.operators import features as feat
from wardgrid.operators import targets as tg
from wardgrid.operators import treatments as tx
from wardgrid.operators.timeline import GridSpec, align, chunked_timeline, fill_forever, stay_bounds

OBS = "stay_id long, subject_id long, itemid long, charttime timestamp, valuenum double"
STAYS = "stay_id long, subject_id long, intime timestamp, outtime timestamp"
T0 = datetime(2026, 8, 23)


def stays_of(spark, rows):
    return spark.createDataFrame(rows, STAYS)


def test_grid_starts_before_the_first_reading(spark):
    stays = stays_of(spark, [(1, 101, datetime(2026, 8, 23, 19, 55), datetime(2026, 8, 24, 8, 30))])
    obs = spark.createDataFrame([(1, 101, 220045, datetime(2026, 8, 23, 20, 0), 82.0)], OBS)
    rows = align(stays, obs, obs.limit(0), GridSpec()).orderBy("charttime").toPandas()
    assert rows.charttime.iloc[0] == pd.Timestamp("2026-08-23 19:45:00")
    assert pd.isna(rows.heart_rate.iloc[0]) and rows.mask_heart_rate.iloc[0] == 0.0
    assert rows.heart_rate.iloc[1] == 82.0 and rows.mask_heart_rate.iloc[1] == 1.0
    assert rows.charttime.iloc[-1] == pd.Timestamp("2026-08-24 08:30:00")
    assert rows.heart_rate.notna().sum() == 9  # the reading and 8 carried ticks


def test_fahrenheit_and_merged_channels(spark):
    stays = stays_of(spark, [(1, 1, T0, T0 + timedelta(hours=1))])
    obs = spark.createDataFrame([
        (1, 1, 223761, T0, 98.6), (1, 1, 220179, T0, 120.0), (1, 1, 220050, T0 + timedelta(minutes=5), 130.0),
        (1, 1, 99999, T0, 1.0)], OBS)
    first = align(stays, obs, obs.limit(0), GridSpec()).orderBy("charttime").first()
    assert first.temperature_c == pytest.approx(37.0)
    assert first.sbp == 125.0


def test_a_stay_of_one_tick_gives_no_grid(spark):
    stays = stays_of(spark, [(1, 1, T0, T0)])
    empty = spark.createDataFrame([], OBS)
    assert align(stays, empty, empty, GridSpec()).count() == 0


def make_readings(hours, seed, gap):
    """Random readings of two stays with a silent stretch of `gap` hours."""
    rnd, rows = random.Random(seed), []
    for stay in (1, 2):
        for item, base in ((220045, 80), (220277, 97), (220210, 18), (220052, 85), (220050, 120), (50813, 2)):
            for _ in range(hours):
                at = rnd.uniform(0, hours)
                if hours * 0.3 < at < hours * 0.3 + gap:
                    continue
                rows.append((stay, 7, item, T0 + timedelta(hours=at), base + rnd.uniform(-20, 10)))
    return rows


def pandas_timeline(rows, stay, start, end, spec):
    index = pd.date_range(start.floor("15min"), end.ceil("15min"), freq="15min")
    df = pd.DataFrame(rows, columns=["stay", "subject", "item", "t", "v"])
    df["t"] = df.t.dt.floor("15min")
    out = pd.DataFrame(index=index)
    names = {220045: "heart_rate", 220277: "spo2", 220210: "respiratory_rate", 220052: "map", 220050: "sbp", 50813: "lactate"}
    for item, name in names.items():
        part = df[(df["item"] == item) & ((df.stay == stay) | (name == "lactate"))]
        raw = part.groupby("t").v.mean().reindex(index)
        out["raw_" + name] = raw
        out[name] = raw.ffill(limit=spec.fill_steps(name))
    for c in fx.DELTA_CHANNELS:
        out["ema_" + c] = out[c].ewm(span=4, adjust=False).mean()
        out["delta_" + c] = out[c].diff().fillna(0.0)
    for c in fx.VOLATILITY_CHANNELS:
        out["roll_std_" + c] = out[c].rolling(4, min_periods=1).std().fillna(0.0)
    return out


@pytest.mark.parametrize("chunk,gap", [(192, 60), (192, 0), (192, 150), (1024, 60), (5000, 60)])
def test_features_match_pandas_for_any_chunk_length(spark, chunk, gap):
    spec = GridSpec(chunk_ticks=chunk)
    rows = make_readings(300, 3, gap)
    start, end = T0 + timedelta(minutes=7), T0 + timedelta(hours=299)
    stays = stays_of(spark, [(1, 7, start, end), (2, 7, start, end)])
    obs = spark.createDataFrame(rows, OBS)
    t = feat.add_features(chunked_timeline(stays, obs, obs, spec, stored=True))
    t = fill_forever(t, ["spo2"])
    got = t.rows("stay_id", "tick", *fx.FEATURES, "ffill_spo2").toPandas()
    for stay in (1, 2):
        mine = got[got.stay_id == stay].sort_values("tick")
        want = pandas_timeline(rows, stay, pd.Timestamp(start), pd.Timestamp(end), spec)
        assert list(pd.to_datetime(mine.tick, unit="s")) == list(want.index)
        for c in [c for c in want.columns if c in mine.columns]:
            np.testing.assert_allclose(mine[c].to_numpy(float), want[c].to_numpy(float), atol=1e-8, err_msg=c)
        np.testing.assert_allclose(mine.ffill_spo2.to_numpy(float), want.raw_spo2.ffill().to_numpy(float))


@pytest.mark.parametrize("chunk,span,digits", [(8192, 19, 250.0), (8192, 19, 4.0), (192, 4, 9.0), (192, 19, 250.0)])
def test_exponential_mean_for_any_alpha_and_block(spark, monkeypatch, chunk, span, digits):
    monkeypatch.setattr(feat, "PRODUCT_DIGITS", digits)
    spec = GridSpec(chunk_ticks=chunk)
    end = T0 + timedelta(hours=100)
    stays = stays_of(spark, [(1, 7, T0, end)])
    rows = [(1, 7, 220045, T0 + timedelta(minutes=15 * i), 0.0 if i < 190 else 100.0) for i in range(400) if i % 7 != 3 and not 210 < i < 260]
    obs = spark.createDataFrame(rows, OBS)
    t = feat.add_ema(chunked_timeline(stays, obs, obs.limit(0), spec), ["heart_rate"], span=span)
    got = t.rows("tick", "heart_rate", "ema_heart_rate").orderBy("tick").toPandas()
    want = got.heart_rate.ewm(span=span, adjust=False).mean()
    np.testing.assert_allclose(got.ema_heart_rate.to_numpy(float), want.to_numpy(float), atol=1e-8)


@pytest.mark.parametrize("chunk", [192, 1024])
def test_flags_match_brute_force(spark, chunk):
    spec = GridSpec(chunk_ticks=chunk)
    rnd = random.Random(1)
    start, end = T0, T0 + timedelta(hours=200)
    stays = stays_of(spark, [(1, 7, start, end)])
    spans = []
    for _ in range(60):
        s = T0 + timedelta(minutes=rnd.uniform(-600, 12500))
        spans.append((1, rnd.choice(fx.TREATMENTS), s, s + timedelta(minutes=rnd.choice([0, 10, 200, 4000]))))
    intervals = spark.createDataFrame(spans, "stay_id long, treatment string, starttime timestamp, endtime timestamp")
    bounds = stay_bounds(stays, spec)
    edges = tx.interval_edges(intervals, bounds, spec)
    empty = spark.createDataFrame([], OBS)
    t = tx.add_flags(chunked_timeline(stays, empty, empty, spec, [edges], [f"_edge_{c}" for c in fx.TREATMENTS]))
    got = t.rows("tick", *fx.TREATMENTS).toPandas()
    assert len(got) == 801
    for row in got.itertuples():
        at = datetime(1970, 1, 1) + timedelta(seconds=row.tick)
        for c in fx.TREATMENTS:
            want = any(k == c and s <= at <= e for _, k, s, e in spans)
            assert getattr(row, c) == float(want), (at, c)


def test_open_order_ends_after_a_day_and_last_episode_wins(spark):
    stays = stays_of(spark, [(1, 7, T0, T0 + timedelta(hours=10))])
    inf = tx.classify(spark.createDataFrame(
        [(1, 1, 7, "Norepinephrine", T0 + timedelta(hours=1), T0 + timedelta(hours=2)),
         (2, 1, 7, "Saline", T0 + timedelta(hours=1), T0 + timedelta(hours=2))],
        "event_id long, stay_id long, subject_id long, drug_name string, starttime timestamp, endtime timestamp"), "drug_name")
    orders = tx.classify(spark.createDataFrame(
        [(3, 7, "Cefepime", T0 + timedelta(hours=1, minutes=3), None), (4, 7, "Furosemide", T0 - timedelta(hours=1), None)],
        "event_id long, subject_id long, drug_name string, starttime timestamp, stoptime timestamp"), "drug_name")
    closed = tx.close_orders(orders).where("event_id = 3").first()
    assert closed.endtime - closed.starttime == timedelta(hours=24)
    found = tx.episodes(inf, orders, stays)
    assert found.count() == 2  # unknown drug and order before the stay drop out
    per_tick = tx.episode_per_tick(found, GridSpec()).collect()
    assert len(per_tick) == 1 and per_tick[0].episode.treatment == "tx_antibiotic"
    assert per_tick[0].episode_count == 2 and not per_tick[0].episode.eligible


def test_targets_of_a_normal_stay(spark):
    spec = GridSpec()
    items = {220045: 80.0, 220277: 98.0, 220050: 120.0, 220052: 85.0, 220210: 16.0, 223762: 37.0}
    rows = [(1, 7, i, T0 + timedelta(minutes=15 * k), v) for i, v in items.items() for k in range(30)]
    stays = stays_of(spark, [(1, 7, T0, T0 + timedelta(minutes=15 * 29))])
    obs = spark.createDataFrame(rows, OBS)
    t = chunked_timeline(stays, obs, obs.limit(0), spec)
    t = tg.add_targets(t.with_df(t.df.withColumn("episode", F.lit(None).cast("struct<eligible:boolean>"))))
    windows = t.df.where(F.col("core") & tg.is_window(t)).collect()
    assert len(windows) == 3  # positions 23, 24, 25 of 30
    w = windows[0]
    assert len(w.forecast) == 4 and len(w.forecast[0]) == 5 and w.forecast[0][0] == 80.0
    assert (w.deterioration, w.risk_tier, w.response, w.response_mask) == (0.0, 0, 0, 0.0)


def test_persistent_hypoxia_is_deterioration(spark):
    spec = GridSpec()
    rows = [(1, 7, 220277, T0 + timedelta(minutes=15 * k), 85.0 if k >= 26 else 98.0) for k in range(30)]
    stays = stays_of(spark, [(1, 7, T0, T0 + timedelta(minutes=15 * 29))])
    obs = spark.createDataFrame(rows, OBS)
    t = chunked_timeline(stays, obs, obs.limit(0), spec)
    t = tg.add_targets(t.with_df(t.df.withColumn("episode", F.lit(None).cast("struct<eligible:boolean>"))))
    got = {(r.tick - r.first_tick) // 900: r for r in t.df.where(F.col("core") & tg.is_window(t)).collect()}
    assert got[23].abnormal_steps == 2 and got[23].deterioration == 1.0 and got[23].risk_tier == 2
    assert got[25].abnormal_steps == 4 and got[23].valid_points == 4


def test_orders_reach_every_stay_they_touch(spark):
    """Subject-level orders and labs against several stays, long orders crossing weeks."""
    spec = GridSpec(step_minutes=60)
    rnd = random.Random(2)
    spans = [(k, 7, T0 + timedelta(days=9 * k), T0 + timedelta(days=9 * k + 8)) for k in range(1, 6)]
    orders = []
    for i in range(80):
        s = T0 + timedelta(hours=rnd.uniform(0, 1400))
        orders.append((i, 7, "Furosemide", s, s + timedelta(hours=rnd.choice([0.1, 30, 500]))))
    stays = stays_of(spark, spans)
    bounds = stay_bounds(stays, spec)
    ordered = tx.classify(spark.createDataFrame(
        orders, "event_id long, subject_id long, drug_name string, starttime timestamp, stoptime timestamp"), "drug_name")
    none = tx.classify(spark.createDataFrame(
        [], "event_id long, stay_id long, subject_id long, drug_name string, starttime timestamp, endtime timestamp"), "drug_name")
    edges = tx.interval_edges(tx.stay_intervals(none, ordered, bounds), bounds, spec)
    labs = [(0, 7, 50813, T0 + timedelta(hours=rnd.uniform(0, 1400)), 1.0) for _ in range(200)]
    empty = spark.createDataFrame([], OBS)
    t = tx.add_flags(chunked_timeline(stays, empty, spark.createDataFrame(labs, OBS), spec, [edges],
                                      [f"_edge_{c}" for c in fx.TREATMENTS]))
    got = t.rows("stay_id", "tick", "tx_diuretic", "mask_lactate").toPandas()
    hours = {at.replace(minute=0, second=0, microsecond=0) for _, _, _, at, _ in labs}
    assert len(got) == sum(8 * 24 + 1 for _ in spans)
    for row in got.itertuples():
        at = datetime(1970, 1, 1) + timedelta(seconds=row.tick)
        assert row.tx_diuretic == float(any(s <= at <= e for _, _, _, s, e in orders))
        assert row.mask_lactate == float(at in hours)
    found = tx.episodes(none, ordered, stays)
    want = sum(1 for _, _, _, s, _ in orders for _, _, a, b in spans if a <= s <= b)
    assert found.count() == want


def test_short_stays_give_no_windows(spark):
    from wardgrid.operators.windows import long_enough
    stays = stays_of(spark, [(1, 7, T0, T0 + timedelta(hours=6, minutes=30)), (2, 7, T0, T0 + timedelta(hours=6, minutes=45))])
    empty = spark.createDataFrame([], OBS)
    t = long_enough(chunked_timeline(stays, empty, empty, GridSpec()))
    assert [r.stay_id for r in t.rows().select("stay_id").distinct().collect()] == [2]
