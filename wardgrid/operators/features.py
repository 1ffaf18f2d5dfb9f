"""Causal features on a timeline."""

from __future__ import annotations

from collections.abc import Sequence
from math import log10

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.clinical import shock_index
from wardgrid.operators.slices import halo_chunks
from wardgrid.operators.timeline import (
    EMA_LOOK_BACK, SO_FAR, TICKS, Timeline, over_ticks,
)

#: Digits that a running product may lose before a new block starts; doubles hold 307. At the default span a block is longer
#: than a chunk with its halo, so that nothing is chained.
PRODUCT_DIGITS = 280.0


def add_shock_index(t: Timeline) -> Timeline:
    return t.with_df(t.df.withColumn("shock_index", shock_index(F.col("heart_rate"), F.col("sbp"))))


def add_deltas(t: Timeline, channels: Sequence[str] = tuple(fx.DELTA_CHANNELS)) -> Timeline:
    """Change since the previous tick; 0 where either side is missing."""
    return t.with_df(t.df.selectExpr("*", *[
        f"coalesce({c} - lag({c}) OVER ({TICKS}), 0D) AS delta_{c}" for c in channels]))


def add_volatility(t: Timeline, channels: Sequence[str] = tuple(fx.VOLATILITY_CHANNELS),
                   rows: int = 4) -> Timeline:
    """Sample standard deviation of the last `rows` ticks; 0 with fewer than two values."""
    frame = f"{TICKS} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW"
    return t.with_df(t.df.selectExpr("*", *[
        f"coalesce(stddev_samp({c}) OVER ({frame}), 0D) AS roll_std_{c}" for c in channels]))


def _ema_parts(t: Timeline, channels: Sequence[str], alpha: float) -> Timeline:
    """Per channel and tick, counted from the start of the chunk's segment: the previous observed tick `_t`,
    the first observation `_f`, the newest observed tick `_l`, the decay factor `_a` of the old mean
    at this tick and its running product `_p`.

    An observation x after a gap of g ticks turns the mean m into (d m + alpha x) / (d + alpha)
    with d = (1 - alpha)^g, so the old mean keeps the share a = d / (d + alpha).
    """
    so_far = over_ticks().rowsBetween(Window.unboundedPreceding, 0)
    kept = t.df.columns
    df = t.df.selectExpr("*", *[
        f"CASE WHEN tick >= {_segment_start('chunk', t)} THEN {c} END AS _x_{c}" for c in channels])
    df = df.selectExpr(
        "*",
        *[f"last(CASE WHEN _x_{c} IS NOT NULL THEN tick END, true) OVER "
          f"({TICKS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _t_{c}" for c in channels],
        *[f"first(CASE WHEN _x_{c} IS NOT NULL THEN struct(tick, _x_{c} AS x) END, true) OVER ({SO_FAR}) AS _f_{c}"
          for c in channels])
    df = df.selectExpr("*", *[
        f"CASE WHEN _x_{c} IS NOT NULL THEN {_share(f'tick - _t_{c}', t, alpha)} END AS _d_{c}" for c in channels])
    df = df.selectExpr(
        *kept, *[f"_f_{c}" for c in channels], *[f"_x_{c}" for c in channels],
        *[f"CASE WHEN _x_{c} IS NOT NULL THEN tick ELSE _t_{c} END AS _l_{c}" for c in channels],
        *[f"coalesce(_d_{c}, 1D) AS _a_{c}" for c in channels],
        *[f"CASE WHEN _d_{c} IS NULL THEN _x_{c} ELSE (1D - _d_{c}) * _x_{c} END AS _b_{c}" for c in channels])
    return t.with_df(df.withColumns({f"_p_{c}": F.product(f"_a_{c}").over(so_far) for c in channels}))


def _segment_start(chunk: str, t: Timeline) -> str:
    """SQL for the first tick at which a chunk knows every carried-forward value.

    The halo before it only feeds the carry-forward.
    """
    exact = EMA_LOOK_BACK + t.spec.history - 1
    return f"({chunk} * {t.spec.length * t.spec.step} - {exact * t.spec.step})"


def _share(gap_seconds: str, t: Timeline, alpha: float) -> str:
    """SQL for d / (d + alpha), d = (1 - alpha)^gap; NULL without an earlier observation."""
    d = f"pow({1.0 - alpha}D, ({gap_seconds}) / {t.spec.step})"
    return f"({d} / ({d} + {alpha}D))"


def _ema_in_chunk(t: Timeline, channels: Sequence[str], alpha: float) -> Timeline:
    """Exponential mean that starts at the chunk's first observation, with its parts.

    The recurrence m = a m + b is solved as P * sum(b / P), constant work per tick, in blocks of so many ticks that the
    product P cannot underflow. A block turns the mean M before it into m + P M; the few blocks of a chunk are chained.
    """
    parts = _ema_parts(t, channels, alpha)
    block = int(-PRODUCT_DIGITS / log10(1.0 - alpha))
    if t.spec.length + t.spec.before + t.spec.after <= block:      # one block: nothing to chain
        return parts.with_df(parts.df.selectExpr("*", *[
            f"_p_{c} * sum(_b_{c} / _p_{c}) OVER ({SO_FAR}) AS ema_{c}" for c in channels]))
    kept = parts.df.columns
    inside = "PARTITION BY stay_id, chunk, _block ORDER BY tick ROWS UNBOUNDED PRECEDING"
    df = parts.df.withColumn("_block", F.floor(F.col("tick") / (block * t.spec.step)))
    product = Window.partitionBy("stay_id", "chunk", "_block").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_q_{c}": F.product(f"_a_{c}").over(product) for c in channels})
    df = df.selectExpr("*", f"lead(_block) OVER ({TICKS}) <> _block AS _ends", *[
        f"_q_{c} * sum(_b_{c} / _q_{c}) OVER ({inside}) AS _m_{c}" for c in channels])
    df = df.selectExpr("*", *[
        f"aggregate(collect_list(CASE WHEN _ends THEN struct(_q_{c} AS q, _m_{c} AS m) END) OVER "
        f"({TICKS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(NULL AS DOUBLE), "
        f"(m, s) -> CASE WHEN s.m IS NULL THEN m ELSE s.m + coalesce(s.q * m, 0D) END) AS _c_{c}" for c in channels])
    return parts.with_df(df.selectExpr(*kept, *[
        f"CASE WHEN _m_{c} IS NULL THEN _c_{c} ELSE _m_{c} + coalesce(_q_{c} * _c_{c}, 0D) END AS ema_{c}" for c in channels]))


def _ema_before_chunks(t: Timeline, channels: Sequence[str], alpha: float) -> DataFrame:
    """Mean `_m0` and newest observed tick `_t0` before a chunk's segment, per (stay, chunk).

    The segments of a stay follow each other without overlap. A segment
    turns the mean m before it into A m + B; the few segments of a stay are chained in order.
    """
    span = t.spec.length * t.spec.step
    several = t.df.where(F.floor(F.col("first_tick") / span) < F.floor(F.col("last_tick") / span))
    inside = F.expr(f"tick < {_segment_start('(chunk + 1)', t)}")
    names = [f"{k}_{c}" for k in ("ema", "_p", "_f", "_l") for c in channels]
    ends = _ema_in_chunk(t.with_df(several), channels, alpha).df.where(inside).groupBy("stay_id", "chunk").agg(
        F.max_by(F.struct(*names), "tick").alias("e")).select("stay_id", "chunk", "e.*")
    earlier = "PARTITION BY stay_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ends = ends.selectExpr("*", *[f"last(_l_{c}, true) OVER ({earlier}) AS _t0_{c}" for c in channels])
    ends = ends.selectExpr("*", *[
        f"_p_{c} * coalesce({_share(f'_f_{c}.tick - _t0_{c}', t, alpha)}, 0D) AS _w_{c}" for c in channels])
    ends = ends.selectExpr("stay_id", "chunk", *[f"_t0_{c}" for c in channels], *[
        f"collect_list(CASE WHEN _f_{c} IS NOT NULL THEN struct(_w_{c} AS a, ema_{c} - _w_{c} * _f_{c}.x AS b) END) "
        f"OVER ({earlier}) AS _s_{c}" for c in channels])
    return ends.selectExpr("stay_id", "chunk", *[f"_t0_{c}" for c in channels], *[
        f"CASE WHEN size(_s_{c}) > 0 THEN aggregate(_s_{c}, 0D, (m, s) -> s.a * m + s.b) END AS _m0_{c}" for c in channels])


def add_ema(t: Timeline, channels: Sequence[str] = tuple(fx.DELTA_CHANNELS), span: int = 4) -> Timeline:
    """Causal exponential mean, alpha = 2 / (span + 1); gaps fade the old mean, never reset it.

    Exact for any chunk length: each chunk continues from the mean reached before it.
    """
    alpha = 2.0 / (span + 1.0)
    carried = _ema_before_chunks(t, channels, alpha)
    df = _ema_in_chunk(t, channels, alpha).df.join(carried, ["stay_id", "chunk"], "left")
    return t.with_df(df.selectExpr(*t.df.columns, *[
        f"CASE WHEN _m0_{c} IS NULL THEN ema_{c} WHEN _f_{c} IS NULL THEN _m0_{c} "
        f"ELSE ema_{c} + _p_{c} * {_share(f'_f_{c}.tick - _t0_{c}', t, alpha)} * (_m0_{c} - _f_{c}.x) END AS ema_{c}"
        for c in channels]))


def add_features(t: Timeline) -> Timeline:
    """All derived features; channels, masks and treatment flags must be there already."""
    have = t.df.columns
    df = t.df.selectExpr(
        *[c for c in have if c not in fx.TREATMENTS],
        *[f"coalesce(CAST({c if c in have else 'NULL'} AS DOUBLE), 0D) AS {c}" for c in fx.TREATMENTS])
    return add_ema(add_volatility(add_deltas(add_shock_index(t.with_df(df)))))


def feature_frame(t: Timeline) -> DataFrame:
    """stay_id, subject_id, tick and the 45 features in their fixed order."""
    return t.rows("stay_id", "subject_id", "tick", *fx.FEATURES)


def rolling_stats(numbered: DataFrame, keys: Sequence[str], value: str, seq: str,
                  windows: Sequence[int] = (5, 15, 30), length: int = 4096) -> DataFrame:
    """Rolling mean, sample std, min and max over the last readings of a key.

    `seq` numbers the readings of a key; chunks of `length` readings with a halo bound each frame.
    """
    cut = halo_chunks(numbered, seq, length, max(windows) - 1)
    w = Window.partitionBy(*keys, "chunk").orderBy(seq)
    stats = {}
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        stats[f"mean_{n}"] = F.avg(value).over(frame)
        stats[f"std_{n}"] = F.stddev_samp(value).over(frame)
        stats[f"min_{n}"] = F.min(value).over(frame)
        stats[f"max_{n}"] = F.max(value).over(frame)
    return cut.withColumns(stats).where("core").drop("core", "chunk")
