"""The forest with many outputs against one grown node by node in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardgrid.operators import forests
from wardgrid.operators.scaling import Scaler
from wardgrid.operators.targets import add_forecast
from wardgrid.operators.timeline import GridSpec, Timeline


def grown_by_hand(bins, y, mask, keys, trees, depth, seed, features):
    """Depth first, by trying every split of every node on its rows."""
    out = forests.Forest(trees, depth, y.shape[1], seed)
    for tree in range(trees):
        weight = forests.bootstrap(keys, tree, seed).astype(float)

        def error(rows):
            total = 0.0
            for k in range(y.shape[1]):
                r = rows[mask[rows, k] > 0]
                if weight[r].sum():
                    mean = (weight[r] * y[r, k]).sum() / weight[r].sum()
                    total += (weight[r] * (y[r, k] - mean) ** 2).sum()
            return total

        def grow(node, level, rows, otherwise):
            value = [(weight[r] * y[r, k]).sum() / weight[r].sum() if weight[r := rows[mask[rows, k] > 0]].sum() else otherwise[k] for k in range(y.shape[1])]
            out.value[tree, node] = value
            if level == depth or weight[rows].sum() < 1.5:
                return
            found = []
            for f in out.looked_at(tree, level, bins.shape[1], features):
                for b in range(forests.BINS - 1):
                    left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    if weight[left].sum() and weight[right].sum():
                        found.append((error(rows) - error(left) - error(right), f, b, left, right))
            best = max((x[0] for x in found), default=0)
            if best <= 1e-9:
                return
            _, f, b, left, right = next(x for x in found if x[0] >= best * (1 - 1e-9))
            out.feature[tree, node], out.threshold[tree, node] = f, b
            grow(2 * node + 1, level + 1, left, value)
            grow(2 * node + 2, level + 1, right, value)
        grow(0, 0, np.flatnonzero(weight > 0), np.zeros(y.shape[1]))
    return out


def rows_of(spark, keys, bins, y, mask):
    rows = [(int(k), bytearray(b.tobytes()), [float(v) for v in t], [float(v) for v in m]) for k, b, t, m in zip(keys, bins, y, mask, strict=True)]
    return spark.createDataFrame(rows, "key long, bins binary, y array<double>, mask array<double>").repartition(5)


@pytest.mark.parametrize("chunk", [7, 65_536])
def test_same_splits_as_by_hand(spark, monkeypatch, chunk):
    monkeypatch.setattr(forests, "ROWS", chunk)
    rng = np.random.default_rng(1)
    bins = rng.integers(0, forests.BINS, (60, 5)).astype(np.uint8)
    y = np.stack([bins[:, 0] * 1.7 + rng.normal(0, 1, 60), bins[:, 1] * -0.9 + (bins[:, 2] > 7) * 5 + rng.normal(0, 1, 60)], axis=1)
    mask = (rng.random((60, 2)) > 0.2).astype(float)
    keys = rng.integers(-2 ** 62, 2 ** 62, 60)
    got = forests.grow(rows_of(spark, keys, bins, y, mask), 2, trees=3, depth=3, seed=7, features=4)
    want = grown_by_hand(bins, y, mask, keys, 3, 3, 7, 4)
    assert (got.feature == want.feature).all() and (got.threshold == want.threshold).all() and (want.feature >= 0).sum() > 9
    assert got.value == pytest.approx(want.value)
    assert got.predict(bins) == pytest.approx(want.predict(bins))


def test_bootstrap_is_poisson():
    w = forests.bootstrap(np.arange(50_000), 3, 42)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.04)
    assert (w != forests.bootstrap(np.arange(50_000), 4, 42)).any()


def test_fit_and_predict_windows(spark):
    """History matrices of 3 x 2 whose newest first feature decides both outputs; the second is mostly missing."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (800, 3, 2))
    rows = [(i, [[float(v) for v in r] for r in m], [float(m[2][0] > 0) * 10, float(m[2][0])], [1.0, float(i % 5 == 0)]) for i, m in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, X array<array<float>>, y array<double>, mask array<double>").repartition(3)
    forest, edges, history = forests.fit(df, F.col("id"), F.col("y"), F.col("mask"), 2, trees=10, depth=4)
    got = forests.predicted(df, forest, edges, history).collect()
    assert len(got) == 800 and history == 3 and edges.shape == (2, forests.BINS - 1)
    assert np.mean([abs(r.predicted[0] - r.y[0]) for r in got]) < 0.5
    assert np.mean([abs(r.predicted[1] - r.y[1]) for r in got]) < 0.4


def test_no_rows_equal_rows_and_nulls(spark):
    schema = "id long, X array<array<float>>, y array<double>, mask array<double>"
    assert forests.fit(spark.createDataFrame([], schema), F.col("id"), F.col("y"), F.col("mask"), 1) is None
    same = spark.createDataFrame([(i, [[1.0]], [2.0, None], [1.0, 0.0]) for i in range(20)], schema)
    forest, edges, history = forests.fit(same, F.col("id"), F.col("y"), F.col("mask"), 2, trees=2, depth=2)
    assert (forest.feature == -1).all()
    assert {tuple(r.predicted) for r in forests.predicted(same, forest, edges, history).collect()} == {(2.0, 0.0)}


def test_histograms_hold_used_cells_only():
    rng = np.random.default_rng(2)
    bins, parts = rng.choice([0, 0, 0, 3, 15], (7, 1300)).astype(np.uint8), rng.normal(0, 1, (1300, 5))
    parts[:, 0] = rng.integers(1, 4, 1300)
    bins[6] = 2
    got = forests.histogram(bins, parts)
    want = np.stack([np.stack([parts[bins[f] == b].sum(axis=0) for b in range(forests.BINS)]) for f in range(7)])
    assert got == pytest.approx(want) and (got[..., 0] == want[..., 0]).all()
    sent = forests.packed(got.reshape(-1, 5))
    assert len(sent) == (6 * 3 + 1) * (4 + 8 * 5)
    cells, held = forests.unpacked(sent, 5)
    assert (cells == np.flatnonzero(want[..., 0])).all() and held == pytest.approx(want.reshape(-1, 5)[cells])


def test_bin_numbers_count_borders_below():
    edges = np.array([-1.5, 0.0, 0.25, 2.0, *[np.inf] * 11])
    values = np.array([[-np.inf, -1.5, -1.4, 0.0], [0.25, 0.3, np.inf, np.nan]])
    assert (forests.bin_numbers(values, edges) == np.searchsorted(edges, values, "left")).all()


def ticks_of(spark, rng, lengths, history):
    """Ticks of some stays as `history_ticks` gives them, two features each, and the windows with X that they stand for."""
    ticks, windows = [], []
    for stay, n in enumerate(lengths):
        values = rng.normal(0, 1, (n, 2)).round(1)
        for i in range(n):
            kept = i >= history - 1 and i < n - 2 and (stay, i) != (0, 9)
            y, mask = [float(values[i, 0] * 3), float(i % 7)], [1.0, float(i % 3 > 0)]
            key = stay * 1000 + i
            ticks.append((stay, 0, i * 60, i + 1, kept, "test" if stay == 2 else "train", key if kept else None, y if kept else None, mask if kept else None, *map(float, values[i])))
            if kept:
                windows.append((stay, i * 60, "test" if stay == 2 else "train", key, y, mask, [[float(v) for v in r] for r in values[i - history + 1: i + 1]]))
    df = spark.createDataFrame(ticks, "stay_id long, chunk long, tick long, _n int, _kept boolean, split string, key long, y array<double>, mask array<double>, a float, b float")
    ordered = df.repartition(3, "stay_id").sortWithinPartitions("stay_id", "chunk", "tick")
    return ordered, spark.createDataFrame(windows, "stay_id long, tick long, split string, key long, y array<double>, mask array<double>, X array<array<float>>")


@pytest.mark.parametrize(("batch", "run"), [(10_000, 64), (7, 5)])
def test_runs_give_the_forest_of_the_matrices(spark, monkeypatch, batch, run):
    """Also where runs are cut by their length, by a window left out and by batches; each tick is stored once a run, not once a window."""
    history = 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    monkeypatch.setattr(forests, "RUN", run)
    try:
        ticks, windows = ticks_of(spark, np.random.default_rng(3), [40, 5, 33, 30, 90, 4], history)
        forest, kept = forests.fit_runs(ticks, ["a", "b"], history, 2, trees=6, depth=4)
        want, edges, _ = forests.fit(windows.where("split = 'train'"), F.col("key"), F.col("y"), F.col("mask"), 2, trees=6, depth=4)
        assert (forest.feature == want.feature).all() and (forest.threshold == want.threshold).all() and (want.feature >= 0).sum() > 9
        assert forest.value == pytest.approx(want.value)
        got = {(r.stay_id, r.tick): r for r in forests.predicted_runs(kept, forest, history).collect()}
        rows = forests.predicted(windows, want, edges, history).collect()
        assert len(got) == len(rows) == kept.agg(F.sum("n")).first()[0]
        for r in rows:
            assert tuple(got[r.stay_id, r.tick].predicted) == pytest.approx(tuple(r.predicted))
            assert (got[r.stay_id, r.tick].y, got[r.stay_id, r.tick].mask) == (r.y, r.mask)
        cells = kept.agg(F.sum(F.length("bins")), F.sum(F.expr(f"(n + {history - 1}) * 2"))).first()
        assert cells[0] == cells[1] and kept.agg(F.max("n")).first()[0] <= run
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_without_train_windows_predict_zeros(spark):
    ticks, _ = ticks_of(spark, np.random.default_rng(4), [9], 4)
    forest, kept = forests.fit_runs(ticks.withColumn("split", F.lit("test")), ["a", "b"], 4, 2, trees=2, depth=2)
    assert {tuple(r.predicted) for r in forests.predicted_runs(kept, forest, 4).collect()} == {(0.0, 0.0)}


@pytest.mark.parametrize("outputs", [1, 2, 5])
def test_counts_travel_in_pairs(outputs):
    rng = np.random.default_rng(6)
    mask, y, weight = (rng.random((500, outputs)) < 0.6).astype(float), rng.normal(0, 1, (500, outputs)), rng.integers(1, 9, 500)
    y[mask == 0] = np.nan
    got = forests.unpaired((forests.paired(mask, y) * weight[:, None]).sum(axis=0)[None], outputs)[0]
    assert got[0] == weight.sum() and (got[1: 1 + outputs] == (mask * weight[:, None]).sum(axis=0)).all()
    assert got[1 + outputs:] == pytest.approx(np.nansum(y * weight[:, None], axis=0))


def test_tasks_standardise_as_the_scaler_does(spark):
    """Out of range, missing and NaN, of clipped channels, flags and other features."""
    columns = ["heart_rate", "mask_spo2", "ema_map", "wbc"]
    scaler = Scaler({"heart_rate": (80.0, 12.5, 77.0), "mask_spo2": (0.3, 0.4, 0.0), "ema_map": (70.123456, 9.87, 71.5)})
    values = [(v, v, v, v) for v in (-1e9, 0.0, 0.1, 55.5, 77.7, 1e9, float("nan"), float("inf"), None)]
    df = spark.createDataFrame(values, ", ".join(f"{c} double" for c in columns)).coalesce(1)
    want = scaler.transform(df, columns).toArrow()
    rows = df.toArrow()
    for c in columns:
        got = scaler.scaled(c, rows.column(c).to_numpy().astype(float), np.asarray(rows.column(c).is_null()))
        assert np.array_equal(got, want.column(c).to_numpy(), equal_nan=True), c


def test_forecasts_end_with_the_stay(spark):
    """Rows ahead, with what is missing as 0; the last ticks have fewer."""
    rows = [(1, 0, i * 60, float(i) if i % 2 else None, float(10 + i)) for i in range(6)] + [(2, 0, 0, 5.0, None)]
    t = Timeline(spark.createDataFrame(rows, "stay_id long, chunk long, tick long, a double, b double"), GridSpec(step_minutes=1, horizon=3))
    got = {(r.stay_id, r.tick): r for r in add_forecast(t, ["a", "b"]).df.collect()}
    assert got[1, 0].forecast == [[1.0, 11.0], [0.0, 12.0], [3.0, 13.0]] and got[1, 0].forecast_mask == [[1.0, 1.0], [0.0, 1.0], [1.0, 1.0]]
    assert got[1, 180].forecast == [[0.0, 14.0], [5.0, 15.0]] and got[1, 180].valid_points == 3
    assert got[1, 300].forecast == got[1, 300].forecast_mask == got[2, 0].forecast == [] and got[1, 300].valid_points is None
