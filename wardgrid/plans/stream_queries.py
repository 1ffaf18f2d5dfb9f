"""Streaming queries: supplied tables replayed as streams, checked against batch SQL where possible."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.operators.timeline import name_items
from wardgrid.plans import testmodel as tm
from wardgrid.plans.scoring_queries import (
    _FRAME, _KEY, _KEY_SQL, _ORDER, _ORDER_SQL, _VIT, FRAMES_SQL, LATEST_SQL, _anomaly_sql, _news_query,
    _split_top, controls,
)
from wardgrid.plans.testmodel import with_sql
from wardgrid.plans.timeline_queries import NAMED_SQL, r6
from wardgrid.session import shared_dir
from wardgrid.streaming import vitals as sv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


def _run(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


def _stream(spark, d, table: str) -> DataFrame:
    schema = tm.load(spark, d, table).schema
    return sv.replay(spark, d, schema, f"{table}.parquet")


def _in_steps(spark, d, table: str, by: str, run: Callable[[str], DataFrame], steps: int = 3) -> tuple[str, DataFrame]:
    """The table written to a new folder of the shared one in `steps` that follow each other in the order of `by`.

    After each step `run(folder)` reads its files; the folder and what the last run returned come back. Tasks write the rows
    they read, so a step has any number of files, and a stream that takes all that is new has one micro-batch for each.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/{_run('input')}"
    rows = tm.load(spark, d, table)
    shares = [k / steps for k in range(1, steps)]
    cuts = rows.select(F.percentile_approx(F.unix_micros(F.col(by).cast("timestamp")), F.array(*map(F.lit, shares)), 1000)).first()[0] or []
    at = F.unix_micros(F.col(by).cast("timestamp"))
    out = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
        rows.where(inside).write.mode("append").parquet(folder)
        out = run(folder)
    return folder, out


def frames(spark, d, folder: str | None = None) -> DataFrame:
    raw = sv.replay(spark, folder, tm.load(spark, d, "lineitem").schema, files_per_step=sv.ALL_NEW) if folder else _stream(spark, d, "lineitem")
    return raw.selectExpr(*[e.strip() for e in _split_top(_FRAME)]).withColumn("ts", F.col("ts").cast("timestamp"))


_MESSAGE_SQL = (
    f"SELECT {_KEY_SQL}, total_score AS news2_score, risk_tier AS news2_tier, round(health_risk_score, 4) AS health_risk_score FROM ("
    + _news_query(True).replace(f"SELECT {_KEY_SQL}, ", f"SELECT {_KEY_SQL}, l_discount AS health_risk_score, ") + ")")


@query("stream_messages", _MESSAGE_SQL)
def stream_messages(spark, d):
    out = sv.run_to_table(sv.messages(frames(spark, d), "l_discount"), _run("messages"))
    return out.select(*_KEY, "news2_score", "news2_tier", "health_risk_score")


@query("stream_anomalies", FRAMES_SQL + f"""
SELECT {_KEY_SQL}, {', '.join(_anomaly_sql(c) for c in fx.LIVE_BOUNDS)}, patient_id % 2 = 0 OR patient_id % 3 = 0 OR patient_id % 4 = 0 AS is_anomaly_active FROM frames""")
def stream_anomalies(spark, d):
    out = sv.run_to_table(sv.with_anomalies(frames(spark, d), controls(spark, d)), _run("anomalies"))
    return r6(out.select(*_KEY, *fx.LIVE_BOUNDS, "is_anomaly_active"), *fx.LIVE_BOUNDS)


@query("stream_overrides", FRAMES_SQL + f"""
, o AS (SELECT *, CASE WHEN patient_id % 2 = 0 THEN 135 ELSE heart_rate END AS h FROM frames)
SELECT {_KEY_SQL}, h AS heart_rate, round(h / systolic_bp, 6) AS shock_index FROM o""")
def stream_overrides(spark, d):
    over = tm.load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("patient_id"), F.when(F.col("s_suppkey") % 2 == 0, 135.0).alias("set_heart_rate"))
    out = sv.run_to_table(sv.with_overrides(frames(spark, d), over), _run("overrides"))
    return r6(out.select(*_KEY, "heart_rate", "shock_index"), "shock_index")


@query("stream_alerts", """
SELECT DISTINCT user_id % 20 AS patient_id, date_trunc('second', ts) AS second FROM events WHERE value / 200 > 0.65e0""")
def stream_alerts(spark, d):
    ev = _stream(spark, d, "events").select(
        (F.col("user_id") % 20).alias("patient_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 200).alias("risk"))
    out = sv.run_to_table(sv.alerts(ev), _run("alerts"))
    return tm.export(out.select("patient_id", "second"))


_DAY = 86400


_LIVE_CHANNELS = sorted({fx.MERGED_CHANNELS.get(c, c) for c in fx.VITAL_ITEMS.values()})
_IN_CHANNELS = ", ".join(f"'{c}'" for c in _LIVE_CHANNELS)


@query("stream_grid_means", with_sql("ev", "obs") + "," + NAMED_SQL + f"""
, w AS (SELECT stay_id, us, us // {_DAY}000000 AS b, channel, v FROM named WHERE channel IN ({_IN_CHANNELS}))
SELECT stay_id, make_timestamp(b * {_DAY}000000) AS tick, {', '.join(f"round(avg(v) FILTER (WHERE channel = '{c}'), 6) AS {c}" for c in _LIVE_CHANNELS)} FROM w
WHERE (b + 1) * {_DAY}000000 <= (SELECT max(us) // 1000 * 1000 FROM w) - 3600000000 GROUP BY stay_id, b""")
def stream_grid_means(spark, d):
    """All live channels; a window is emitted once the watermark has passed it, so the last ones stay open."""
    raw = _stream(spark, d, "events")
    named = name_items(_observations(raw), fx.VITAL_ITEMS).where(F.col("channel").isin(_LIVE_CHANNELS))
    out = sv.run_to_table(sv.grid_means(named, _LIVE_CHANNELS, "1 day", "1 hour"), _run("grid"))
    return tm.export(r6(out.select("stay_id", F.col("window.start").alias("tick"), *_LIVE_CHANNELS), *_LIVE_CHANNELS))


@query("stream_grid_closed", with_sql("ev", "obs") + "," + NAMED_SQL + f"""
, w AS (SELECT stay_id, us // {_DAY}000000 AS b, channel, v FROM named WHERE channel IN ({_IN_CHANNELS}))
SELECT stay_id, make_timestamp(b * {_DAY}000000) AS tick, {', '.join(f"round(avg(v) FILTER (WHERE channel = '{c}'), 6) AS {c}" for c in _LIVE_CHANNELS)} FROM w
GROUP BY stay_id, b""")
def stream_grid_closed(spark, d):
    """The same grid over several micro-batches up to the end of the input: no window is left open."""
    schema, name = tm.load(spark, d, "events").schema, _run("grid")

    def grid(folder: str) -> DataFrame:
        raw = sv.replay(spark, folder, schema, files_per_step=sv.ALL_NEW)
        named = name_items(_observations(raw), fx.VITAL_ITEMS).where(F.col("channel").isin(_LIVE_CHANNELS))
        return sv.grid_means(named, _LIVE_CHANNELS, "1 day", "1 hour")

    folder, _ = _in_steps(spark, d, "events", "ts", lambda folder: sv.run_to_table(grid(folder), name))
    # a reading of a live channel far beyond the last one: an error event of the first kind
    mark = tm.load(spark, d, "events").where("event_type = 'click'").limit(1).withColumns({
        "ts": F.lit("2999-01-01").cast(dict(tm.load(spark, d, "events").dtypes)["ts"]), "props": F.lit('{"k": 0}')})
    out = sv.run_to_end(grid(folder), name, folder, mark)
    return tm.export(r6(out.select("stay_id", F.col("window.start").alias("tick"), *_LIVE_CHANNELS), *_LIVE_CHANNELS))


def _observations(raw: DataFrame) -> DataFrame:
    return tm.to_observations(tm.to_events(raw))


@query("stream_latest", LATEST_SQL + f"SELECT patient_id, {_ORDER_SQL}, {', '.join(_VIT)} FROM latest")
def stream_latest(spark, d):
    return tm.export(sv.latest_state(frames(spark, d), _ORDER, [*_ORDER, *_VIT], _run("latest")))


@query("stream_latest_files", LATEST_SQL + f"SELECT patient_id, {_ORDER_SQL}, {', '.join(_VIT)} FROM latest")
def stream_latest_files(spark, d):
    """The latest state after several micro-batches: one row a patient in the last snapshot."""
    name = _run("latest")
    _, out = _in_steps(spark, d, "lineitem", "l_shipdate", lambda folder: sv.latest_state(frames(spark, d, folder), _ORDER, [*_ORDER, *_VIT], name))
    return tm.export(out)


_FILLED = " + ".join(f"coalesce({c}, {fx.LIVE_BASELINE[c]}e0)" for c in fx.LIVE_VITALS)


@query("stream_buffers", FRAMES_SQL + f"""
, b AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, l_orderkey * 10 + l_linenumber DESC) AS back FROM frames)
SELECT patient_id, count(*)::INT AS size, max(ts) AS newest, round(sum({_FILLED}) / (count(*) * 5), 6) AS mean_value
FROM b WHERE back <= 24 GROUP BY patient_id""")
def stream_buffers(spark, d):
    f = frames(spark, d).withColumn("ord", F.expr("l_orderkey * 10 + l_linenumber"))
    out = sv.run_to_table(sv.buffers(f), _run("buffers"))
    mean = F.aggregate(F.flatten("matrix"), F.lit(0.0), lambda a, x: a + x) / (F.col("size") * 5)
    return tm.export(out.select("patient_id", "size", "newest", F.round(mean, 6).alias("mean_value")))


@query("stream_buffers_files", ORACLES["stream_buffers"])
def stream_buffers_files(spark, d):
    """The last matrix of each patient after several micro-batches."""
    name = _run("buffers")

    def run(folder: str) -> DataFrame:
        return sv.run_to_table(sv.buffers(frames(spark, d, folder).withColumn("ord", F.expr("l_orderkey * 10 + l_linenumber"))), name)

    out = sv.last_buffers(_in_steps(spark, d, "lineitem", "l_shipdate", run)[1])
    mean = F.aggregate(F.flatten("matrix"), F.lit(0.0), lambda a, x: a + x) / (F.col("size") * 5)
    return tm.export(out.select("patient_id", "size", "newest", F.round(mean, 6).alias("mean_value")))
