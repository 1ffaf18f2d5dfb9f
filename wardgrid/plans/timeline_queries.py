"""Grid, treatment, feature, target and window queries with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.rules import unpivot_numbers
from wardgrid.operators import features as feat
from wardgrid.operators import splits as sp
from wardgrid.operators import targets as tg
from wardgrid.operators import treatments as tx
from wardgrid.operators import windows as win
from wardgrid.operators.scaling import Scaler, clip_channels, scaler_stats
from wardgrid.operators.timeline import (
    Timeline, align, chunked_timeline, fill_forever, grid_chunks, grid_ticks, name_items,
    phase_reconciliation, stay_bounds, tick_means, tick_time,
)
from wardgrid.plans import testmodel as tm
from wardgrid.plans.testmodel import SPEC, SQL, with_sql

STEP = SPEC.step
VITALS, LABS, CHANNELS = fx.VITAL_CHANNELS, fx.LAB_CHANNELS, fx.CHANNELS
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.selectExpr(*[f"round({c}, {digits}) AS {c}" if c in columns else c for c in df.columns])


# ---- building blocks -----------------------------------------------------------------------

def classified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (tx.classify(tm.infusions(spark, d), "drug_name"), tx.classify(tm.orders(spark, d), "drug_name"))


def timeline(spark: SparkSession, d: str, treated: bool = False, stored: bool = False, parts: DataFrame | None = None, **options) -> Timeline:
    """The test model's timeline; with `parts`, the splits of subjects, each tick has its split."""
    obs, stays = tm.observations(spark, d), tm.stays(spark, d)
    placed = stays if parts is None else win.assigned(stays, parts)
    if not treated:
        return chunked_timeline(placed, obs, obs, SPEC, stored=stored, **options)
    bounds = stay_bounds(stays, SPEC)
    inf, orders = classified(spark, d)
    edges = tx.interval_edges(tx.stay_intervals(inf, orders, bounds), bounds, SPEC)
    started = tx.episode_per_tick(tx.episodes(inf, orders, stays), SPEC)
    t = chunked_timeline(placed, obs, obs, SPEC, [edges, started],
                         sums=[f"_edge_{c}" for c in fx.TREATMENTS], stored=stored, **options)
    return tx.add_flags(t)


def splits(spark: SparkSession, d: str) -> DataFrame:
    return sp.split_subjects(tm.stays(spark, d))


def windows(spark: SparkSession, d: str) -> DataFrame:
    return win.window_rows(tg.add_targets(timeline(spark, d, treated=True)), splits(spark, d))


# ---- SQL building blocks ---------------------------------------------------------------------

_NAMED = {**fx.VITAL_ITEMS, **fx.LAB_ITEMS}
_FINAL = {i: fx.MERGED_CHANNELS.get(c, c) for i, c in _NAMED.items()}
_VALUE = "CASE WHEN itemid = 223761 THEN (valuenum - 32) * 5e0 / 9e0 ELSE valuenum END"
NAMED_SQL = f"""
named AS (SELECT *, {tm._sql_map(_FINAL)} AS channel, {_VALUE} AS v,
    (us // {STEP}000000) * {STEP} AS tick FROM obs WHERE itemid IN ({', '.join(map(str, _NAMED))}))"""
GRID_SQL = f"""
bounds AS (SELECT stay_id, subject_id, (in_us // {STEP}000000) * {STEP} AS first_tick,
    ((out_us + {STEP}000000 - 1) // {STEP}000000) * {STEP} AS last_tick FROM stays),
grid AS (SELECT *, unnest(generate_series(first_tick, last_tick, {STEP})) AS tick
    FROM bounds WHERE last_tick > first_tick)"""


def _means(channels, key):
    cols = ", ".join(f"avg(v) FILTER (WHERE channel = '{c}') AS {c}" for c in channels)
    return f"SELECT {key}, tick, {cols} FROM named GROUP BY {key}, tick"


_FILLED = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY tick "
    f"ROWS BETWEEN {SPEC.fill_steps(c)} PRECEDING AND CURRENT ROW) AS {c}" for c in CHANNELS)
_MASKS = ", ".join(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE 1e0 END AS mask_{c}" for c in CHANNELS)
ALIGN_SQL = f"""
vit AS ({_means(VITALS, 'stay_id')}),
lab AS ({_means(LABS, 'subject_id')}),
raw AS (SELECT g.stay_id, g.subject_id, g.first_tick, g.last_tick, g.tick,
    {', '.join(f'vit.{c}' for c in VITALS)}, {', '.join(f'lab.{c}' for c in LABS)}
  FROM grid g LEFT JOIN vit ON vit.stay_id = g.stay_id AND vit.tick = g.tick
  LEFT JOIN lab ON lab.subject_id = g.subject_id AND lab.tick = g.tick),
filled AS (SELECT stay_id, subject_id, first_tick, last_tick, tick, {_FILLED}, {_MASKS} FROM raw)"""
ALIGNED = with_sql("ev", "obs", "stays") + "," + NAMED_SQL + "," + GRID_SQL + "," + ALIGN_SQL

_FLAG_CLASS = tm._sql_class("drug_name", fx.DRUG_FLAGS)
TREAT_SQL = SQL["infusions"] + "," + SQL["orders"] + f""",
intervals AS (
  SELECT stay_id, {_FLAG_CLASS} AS treatment, s_us, e_us FROM infusions
  UNION ALL
  SELECT b.stay_id, {_FLAG_CLASS}, s_us, coalesce(stop_us, s_us + 86400000000)
  FROM rx JOIN bounds b ON b.subject_id = rx.subject_id),
active AS (SELECT DISTINCT g.stay_id, g.tick, i.treatment FROM grid g JOIN intervals i
  ON i.stay_id = g.stay_id AND g.tick * 1000000 BETWEEN i.s_us AND i.e_us
  WHERE i.treatment IS NOT NULL),
flags AS (SELECT g.stay_id, g.tick, {', '.join(
    f"CASE WHEN count(*) FILTER (WHERE a.treatment = '{c}') > 0 THEN 1e0 ELSE 0e0 END AS {c}"
    for c in fx.TREATMENTS)}
  FROM grid g LEFT JOIN active a ON a.stay_id = g.stay_id AND a.tick = g.tick GROUP BY g.stay_id, g.tick),
episodes AS (
  SELECT s.stay_id, s.subject_id, {_FLAG_CLASS} AS treatment, drug_name, i.starttime, s_us, event_id,
    0 AS load_rank, 'icu_inputevents' AS source,
    s_us - 7200000000 >= s.in_us AND s_us + 7200000000 <= s.out_us AS eligible
  FROM infusions i JOIN stays s ON s.stay_id = i.stay_id
  UNION ALL
  SELECT s.stay_id, s.subject_id, {_FLAG_CLASS}, drug_name, r.starttime, s_us, event_id, 1,
    'hosp_prescriptions', s_us - 7200000000 >= s.in_us AND s_us + 7200000000 <= s.out_us
  FROM rx r JOIN stays s ON s.subject_id = r.subject_id AND s_us BETWEEN s.in_us AND s.out_us),
known AS (SELECT *, (s_us // {STEP}000000) * {STEP} AS tick FROM episodes WHERE treatment IS NOT NULL),
last_episode AS (SELECT * FROM known QUALIFY row_number() OVER (
    PARTITION BY stay_id, tick ORDER BY load_rank DESC, s_us DESC, event_id DESC) = 1)"""

_W = "OVER (PARTITION BY stay_id ORDER BY tick"
_DELTAS = ", ".join(f"coalesce({c} - lag({c}) {_W}), 0) AS delta_{c}" for c in fx.DELTA_CHANNELS)
_VOL = ", ".join(
    f"coalesce(stddev_samp({c}) {_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS roll_std_{c}"
    for c in fx.VOLATILITY_CHANNELS)
_EMA_STATE = ", ".join(
    f"CASE WHEN f.{c} IS NULL THEN e.m_{c} WHEN e.m_{c} IS NULL THEN f.{c} "
    f"ELSE (e.w_{c} * 0.6e0 * e.m_{c} + 0.4e0 * f.{c}) / (e.w_{c} * 0.6e0 + 0.4e0) END, "
    f"CASE WHEN f.{c} IS NULL THEN e.w_{c} * 0.6e0 ELSE 1e0 END" for c in fx.DELTA_CHANNELS)
FEATURE_SQL = f"""
ordered AS (SELECT *, (tick - first_tick) // {STEP} AS i FROM filled),
ema(stay_id, i, {', '.join(f'm_{c}, w_{c}' for c in fx.DELTA_CHANNELS)}) AS (
  SELECT stay_id, i, {', '.join(f'{c}, 1e0' for c in fx.DELTA_CHANNELS)} FROM ordered WHERE i = 0
  UNION ALL
  SELECT f.stay_id, f.i, {_EMA_STATE} FROM ema e JOIN ordered f ON f.stay_id = e.stay_id AND f.i = e.i + 1),
feat AS (SELECT f.*, {', '.join(f'fl.{c}' for c in fx.TREATMENTS)}, f.heart_rate / nullif(f.sbp, 0) AS shock_index,
    {', '.join(f'e.m_{c} AS ema_{c}' for c in fx.DELTA_CHANNELS)}
  FROM ordered f JOIN flags fl ON fl.stay_id = f.stay_id AND fl.tick = f.tick
  JOIN ema e ON e.stay_id = f.stay_id AND e.i = f.i),
features AS (SELECT *, {_DELTAS}, {_VOL} FROM feat)"""
FEATURED = ALIGNED.replace("WITH ", "WITH RECURSIVE ", 1) + "," + TREAT_SQL + "," + FEATURE_SQL

SPLIT_SQL = """
ranked AS (SELECT subject_id, row_number() OVER (ORDER BY md5(subject_id || '-42'), subject_id) AS r,
    count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM stays)),
splits AS (SELECT subject_id, CASE WHEN r <= round_even(0.7e0 * n, 0) THEN 'train'
    WHEN r <= round_even(0.7e0 * n, 0) + round_even(0.15e0 * n, 0) THEN 'validate' ELSE 'test' END AS split
  FROM ranked)"""

_ABN = ("coalesce(spo2 < 90, false) OR coalesce(map < 65, false) OR coalesce(sbp < 90, false) OR "
        "coalesce(respiratory_rate > 28, false) OR coalesce(heart_rate < 45, false) OR "
        "coalesce(heart_rate > 130, false)")
SCORE_SQL = """least(1e0,
    CASE WHEN o < 88 THEN 0.35e0 WHEN o < 92 THEN 0.2e0 WHEN o < 95 THEN 0.1e0 ELSE 0 END
  + CASE WHEN b < 60 OR s < 85 THEN 0.3e0 WHEN b < 65 OR s < 90 THEN 0.2e0 WHEN b < 70 THEN 0.1e0 ELSE 0 END
  + CASE WHEN q > 30 OR q < 8 THEN 0.25e0 WHEN q > 24 THEN 0.15e0 WHEN q > 20 THEN 0.05e0 ELSE 0 END
  + CASE WHEN h > 130 OR h < 40 THEN 0.2e0 WHEN h > 110 OR h < 50 THEN 0.1e0 ELSE 0 END)"""
_AHEAD = f"{_W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)"
TARGET_SQL = f"""
marked AS (SELECT *, ({_ABN}) AS abn,
    coalesce(spo2 < 93, false) OR coalesce(respiratory_rate > 22, false) AS mild,
    coalesce(spo2, 98) AS o, coalesce(map, 85) AS b, coalesce(sbp, 120) AS s,
    coalesce(respiratory_rate, 16) AS q, coalesce(heart_rate, 75) AS h FROM filled),
scored AS (SELECT *, {SCORE_SQL} AS score FROM marked),
ahead AS (SELECT *, count(*) FILTER (WHERE abn) {_AHEAD} AS abnormal_steps,
    coalesce(bool_or(mild) {_AHEAD}, false) AS any_mild,
    {' + '.join(f'count({c}) {_AHEAD}' for c in fx.FORECAST_CHANNELS)} AS valid_points,
    avg(score) {_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS pre_risk,
    avg(score) {_AHEAD} AS post_risk FROM scored),
targets AS (SELECT a.*, CASE WHEN abnormal_steps >= 2 THEN 1e0 ELSE 0e0 END AS deterioration,
    CASE WHEN valid_points > 0 THEN 1e0 ELSE 0e0 END AS deterioration_mask,
    CASE WHEN abnormal_steps >= 2 THEN 2 WHEN abnormal_steps = 1 OR any_mild THEN 1 ELSE 0 END AS risk_tier,
    round(post_risk - pre_risk, 12) AS delta_risk, e.stay_id IS NOT NULL AS is_treatment_window,
    coalesce(e.eligible, false) AS eligible, e.treatment, e.drug_name, e.starttime
  FROM ahead a LEFT JOIN last_episode e ON e.stay_id = a.stay_id AND e.tick = a.tick),
windows AS (SELECT t.*, p.split,
    CASE WHEN NOT eligible THEN 0 WHEN delta_risk <= -0.15e0 THEN 1 WHEN delta_risk >= 0.15e0 THEN 2
      ELSE 0 END AS response,
    CASE WHEN eligible THEN 1e0 ELSE 0e0 END AS response_mask
  FROM targets t JOIN splits p ON p.subject_id = t.subject_id
  WHERE (tick - first_tick) // {STEP} >= 23 AND (tick - first_tick) // {STEP} < (last_tick - first_tick) // {STEP} + 1 - 4)"""
TARGETED = ALIGNED + "," + TREAT_SQL + "," + SPLIT_SQL + "," + TARGET_SQL


def _round_list(names, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


# ---- grid ------------------------------------------------------------------------------------

@query("grid_align", ALIGNED + f"""
SELECT stay_id, subject_id, make_timestamp(tick * 1000000) AS charttime, {_round_list(CHANNELS)},
  {', '.join(f'mask_{c}' for c in CHANNELS)} FROM filled""")
def grid_align(spark, d):
    out = align(tm.stays(spark, d), tm.observations(spark, d), tm.observations(spark, d), SPEC)
    return tm.export(r6(out, *CHANNELS))


@query("grid_ticks", ALIGNED + """
SELECT stay_id, count(*) AS ticks, make_timestamp(min(tick) * 1000000) AS first_tick,
  make_timestamp(max(tick) * 1000000) AS last_tick FROM grid GROUP BY stay_id""")
def grid_ticks_query(spark, d):
    bounds = stay_bounds(tm.stays(spark, d), SPEC)
    ticks = grid_ticks(grid_chunks(bounds, SPEC), SPEC).where("core")
    return tm.export(ticks.groupBy("stay_id").agg(
        F.count(F.lit(1)).alias("ticks"), tick_time(F.min("tick")).alias("first_tick"),
        tick_time(F.max("tick")).alias("last_tick")))


@query("channel_pivot_mean", with_sql("ev", "obs") + "," + NAMED_SQL + f"""
SELECT stay_id, make_timestamp(tick * 1000000) AS charttime, {', '.join(
    f"round(avg(v) FILTER (WHERE channel = '{c}'), 6) AS {c}" for c in CHANNELS)}
FROM named GROUP BY stay_id, tick""")
def channel_pivot_mean(spark, d):
    named = name_items(tm.observations(spark, d), {**fx.VITAL_ITEMS, **fx.LAB_ITEMS})
    means = tick_means(named, "stay_id", CHANNELS, SPEC)
    return tm.export(r6(means, *CHANNELS).withColumn("charttime", tick_time(F.col("tick"))).drop("tick"))


@query("item_channels", with_sql("ev", "obs") + "," + NAMED_SQL + f"""
SELECT channel, count(*) AS n, count(v) AS n_values, round(min(v), 6) AS lowest, round(max(v), 6) AS highest
FROM named GROUP BY channel""")
def item_channels(spark, d):
    named = name_items(tm.observations(spark, d), {**fx.VITAL_ITEMS, **fx.LAB_ITEMS})
    out = named.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.count("valuenum").alias("n_values"),
        F.min("valuenum").alias("lowest"), F.max("valuenum").alias("highest"))
    return r6(out, "lowest", "highest")


@query("grid_phase", with_sql("ev", "obs", "stays") + "," + NAMED_SQL + f"""
, m AS (SELECT stay_id, tick FROM named WHERE channel = 'heart_rate' AND v IS NOT NULL GROUP BY stay_id, tick),
 n AS (SELECT stay_id, count(*) AS raw_readings FROM named WHERE channel = 'heart_rate' AND v IS NOT NULL GROUP BY stay_id)
SELECT n.stay_id, raw_readings,
  count(*) FILTER (WHERE (m.tick * 1000000 - in_us) % {STEP}000000 = 0 AND m.tick * 1000000 BETWEEN in_us AND out_us) AS unfloored_joined,
  count(*) FILTER (WHERE m.tick BETWEEN (in_us // {STEP}000000) * {STEP} AND ((out_us + {STEP}000000 - 1) // {STEP}000000) * {STEP}) AS floored_joined
FROM n JOIN stays s USING (stay_id) JOIN m USING (stay_id) GROUP BY n.stay_id, raw_readings""")
def grid_phase(spark, d):
    return phase_reconciliation(tm.stays(spark, d), tm.observations(spark, d), SPEC)


@query("fill_unbounded", ALIGNED + f"""
SELECT stay_id, tick, {', '.join(f'round(last_value({c} IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING), 6) AS ffill_{c}' for c in ('spo2', 'map', 'respiratory_rate'))}
FROM raw""")
def fill_unbounded(spark, d):
    cols = ["spo2", "map", "respiratory_rate"]
    t = fill_forever(timeline(spark, d, stored=True), cols)
    return r6(t.rows("stay_id", "tick", *[f"ffill_{c}" for c in cols]), *[f"ffill_{c}" for c in cols])


# ---- treatments ------------------------------------------------------------------------------

@query("treatment_flags", ALIGNED + "," + TREAT_SQL + f"SELECT stay_id, tick, {', '.join(fx.TREATMENTS)} FROM flags")
def treatment_flags(spark, d):
    return timeline(spark, d, treated=True).rows("stay_id", "tick", *fx.TREATMENTS)


@query("treatment_initiations", ALIGNED + "," + TREAT_SQL + f"""
SELECT stay_id, tick FROM (SELECT stay_id, tick, {' OR '.join(f'coalesce({c} - lag({c}) {_W}) > 0, false)' for c in fx.TREATMENTS)} AS hit
FROM flags) WHERE hit""")
def treatment_initiations(spark, d):
    t = tx.initiations(timeline(spark, d, treated=True))
    return t.rows("stay_id", "tick", "initiation").where("initiation").drop("initiation")


@query("treatment_episodes", ALIGNED + "," + TREAT_SQL + """
SELECT stay_id, subject_id, treatment, drug_name, source, starttime, eligible,
  make_timestamp(s_us - 7200000000) AS pre_start, make_timestamp(s_us + 7200000000) AS post_end FROM known""")
def treatment_episodes(spark, d):
    inf, orders = classified(spark, d)
    out = tx.episodes(inf, orders, tm.stays(spark, d))
    return tm.export(out.select("stay_id", "subject_id", "treatment", "drug_name", "source", "starttime",
                                "eligible", "pre_start", "post_end"))


@query("episode_per_tick", ALIGNED + "," + TREAT_SQL + """
SELECT e.stay_id, e.tick, e.treatment, e.drug_name, e.eligible, e.event_id, c.n AS episode_count
FROM last_episode e JOIN (SELECT stay_id, tick, count(*) AS n FROM known GROUP BY stay_id, tick) c USING (stay_id, tick)""")
def episode_per_tick(spark, d):
    inf, orders = classified(spark, d)
    out = tx.episode_per_tick(tx.episodes(inf, orders, tm.stays(spark, d)), SPEC)
    return out.select("stay_id", "tick", "episode.treatment", "episode.drug_name", "episode.eligible",
                      "episode.event_id", "episode_count")


@query("co_administration", ALIGNED + "," + TREAT_SQL + f"""
, per AS (SELECT stay_id, tick, count(*) AS n FROM known GROUP BY stay_id, tick),
w AS (SELECT p.*, e.eligible FROM per p JOIN bounds b USING (stay_id) JOIN last_episode e USING (stay_id, tick)
  WHERE (p.tick - first_tick) // {STEP} >= 23 AND (p.tick - first_tick) // {STEP} < (last_tick - first_tick) // {STEP} - 3)
SELECT count(*) AS unique_windows, coalesce(sum(n), 0)::BIGINT AS linked_events,
  count(*) FILTER (WHERE n > 1) AS windows_with_several, count(*) FILTER (WHERE eligible) AS eligible_windows,
  (coalesce(sum(n), 0) - count(*))::BIGINT AS difference FROM w""")
def co_administration(spark, d):
    inf, orders = classified(spark, d)
    stays = tm.stays(spark, d)
    return tx.co_administration(tx.episodes(inf, orders, stays), stays, SPEC)


@query("drug_classes", with_sql("ev") + "," + SQL["infusions"] + "," + SQL["orders"] + f"""
SELECT 'infusions' AS source, {tm._sql_class('drug_name', fx.DRUG_CLASSES)} AS treatment, count(*) AS n
FROM infusions GROUP BY 2 HAVING {tm._sql_class('drug_name', fx.DRUG_CLASSES)} IS NOT NULL
UNION ALL SELECT 'orders', {tm._sql_class('drug_name', fx.DRUG_CLASSES)}, count(*)
FROM rx GROUP BY 2 HAVING {tm._sql_class('drug_name', fx.DRUG_CLASSES)} IS NOT NULL""")
def drug_classes(spark, d):
    return tx.class_counts(tx.classify(tm.infusions(spark, d), "drug_name", fx.DRUG_CLASSES),
                           tx.classify(tm.orders(spark, d), "drug_name", fx.DRUG_CLASSES))


@query("treatment_audit", with_sql("ev", "stays") + "," + SQL["infusions"] + "," + SQL["orders"] + f"""
, b AS (SELECT {_FLAG_CLASS} AS c FROM infusions WHERE stay_id IN (SELECT stay_id FROM stays WHERE stay_id % 2 = 1)
  UNION ALL SELECT {_FLAG_CLASS} FROM rx)
SELECT t AS treatment, count(c) AS n_rows, (SELECT count(c) FROM b) AS total_rows
FROM (SELECT unnest({tm._sql_list(fx.TREATMENTS)}) AS t) LEFT JOIN b ON c = t GROUP BY t""")
def treatment_audit(spark, d):
    inf, orders = classified(spark, d)
    return tx.treatment_audit(inf, orders, tm.stays(spark, d).where("stay_id % 2 = 1"))


# ---- features and scaler ---------------------------------------------------------------------

@query("features", FEATURED + f"""
SELECT stay_id, subject_id, tick, {_round_list(fx.FEATURES)} FROM features""")
def features_query(spark, d):
    frame = feat.feature_frame(feat.add_features(timeline(spark, d, treated=True, stored=True)))
    return r6(frame, *fx.FEATURES)


_CHANGES = [*(f"delta_{c}" for c in fx.DELTA_CHANNELS), *(f"roll_std_{c}" for c in fx.VOLATILITY_CHANNELS)]


@query("deltas_and_volatility", ALIGNED + f", x AS (SELECT stay_id, tick, {_DELTAS}, {_VOL} FROM filled) SELECT stay_id, tick, {_round_list(_CHANGES)} FROM x")
def deltas_and_volatility(spark, d):
    t = feat.add_volatility(feat.add_deltas(timeline(spark, d)))
    return r6(t.rows("stay_id", "tick", *_CHANGES), *_CHANGES)


_CLIPPED = ", ".join(
    (f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {fx.CLIP_BOUNDS[c][0]}e0), {fx.CLIP_BOUNDS[c][1]}e0) END AS {c}"
     if c in fx.CLIP_BOUNDS else c) for c in fx.FEATURES)
SCALER_SQL = SPLIT_SQL + f""",
clipped AS (SELECT stay_id, subject_id, tick, first_tick, last_tick, {_CLIPPED} FROM features),
train AS (SELECT c.* FROM clipped c JOIN splits s ON s.subject_id = c.subject_id AND s.split = 'train'),
scaler AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS channel, round(coalesce(avg({c}), 0), 6) AS mean, "
    f"round(CASE WHEN stddev_samp({c}) > 1e-6 THEN stddev_samp({c}) ELSE 1 END, 6) AS std, "
    f"round(coalesce(quantile_cont({c}, 0.5), 0), 6) AS median FROM train" for c in fx.FEATURES)})"""


@query("scaler_fit", FEATURED + "," + SCALER_SQL + "SELECT channel, round(mean, 4) AS mean, round(std, 4) AS std, round(median, 4) AS median FROM scaler")
def scaler_fit(spark, d):
    frame = feat.feature_frame(feat.add_features(timeline(spark, d, treated=True, stored=True)))
    train = frame.join(splits(spark, d).where("split = 'train'"), "subject_id", "left_semi")
    return r6(scaler_stats(train, fx.FEATURES), "mean", "std", "median", digits=4)


@query("clip_bounds", ALIGNED + f"""
SELECT stay_id, tick, {', '.join(f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {fx.CLIP_BOUNDS[c][0]}e0), {fx.CLIP_BOUNDS[c][1]}e0) END, 6) AS {c}" for c in CHANNELS)}
FROM filled""")
def clip_bounds(spark, d):
    rows = timeline(spark, d).rows("stay_id", "tick", *CHANNELS)
    return r6(clip_channels(rows), *CHANNELS)


# ---- splits ----------------------------------------------------------------------------------

@query("patient_split", with_sql("ev", "stays") + "," + SPLIT_SQL + "SELECT subject_id, split FROM splits")
def patient_split(spark, d):
    return splits(spark, d)


@query("split_summary", with_sql("ev", "stays") + "," + SPLIT_SQL + """
SELECT split, count(DISTINCT s.subject_id) AS patients, count(DISTINCT stay_id) AS stays,
  round(count(DISTINCT s.subject_id) * 100e0 / (SELECT count(*) FROM splits), 2) AS patients_pct
FROM stays s JOIN splits p USING (subject_id) GROUP BY split""")
def split_summary(spark, d):
    return sp.split_summary(tm.stays(spark, d), splits(spark, d))


_LEAKY = "labelled AS (SELECT doc_id, source AS subject_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN lang = 'en' THEN 'validate' ELSE 'test' END AS split FROM documents)"


def _leaky(spark, d):
    docs = tm.load(spark, d, "documents")
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("lang") == "en", "validate").otherwise("test")
    return docs.select("doc_id", F.col("source").alias("subject_id"), split.alias("split"))


@query("split_overlaps", f"WITH {_LEAKY}" + """
, d AS (SELECT DISTINCT subject_id, split FROM labelled)
SELECT a.s AS split_a, b.s AS split_b,
  (SELECT count(*) FROM d x JOIN d y ON x.subject_id = y.subject_id WHERE x.split = a.s AND y.split = b.s) AS shared_subjects
FROM (SELECT DISTINCT split AS s FROM d) a JOIN (SELECT DISTINCT split AS s FROM d) b ON a.s < b.s""")
def split_overlaps(spark, d):
    return sp.split_overlaps(_leaky(spark, d))


@query("split_verification", f"WITH {_LEAKY}" + """
, p AS (SELECT subject_id, split, count(*) AS n FROM labelled GROUP BY subject_id, split),
q AS (SELECT *, count(*) OVER (PARTITION BY subject_id) AS k FROM p)
SELECT split, count(*) AS patients, sum(n)::BIGINT AS n_rows, count(*) FILTER (WHERE k > 1) AS leaking_patients
FROM q GROUP BY split""")
def split_verification(spark, d):
    return sp.verify_split(_leaky(spark, d))


@query("subject_sets", """
SELECT o_custkey AS subject_id FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1""")
def subject_sets(spark, d):
    o = tm.load(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), "o_orderkey")
    return sp.shared_subjects(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"))


# ---- targets and windows ---------------------------------------------------------------------

_WINDOW_COLS = ("stay_id, subject_id, split, make_timestamp(tick * 1000000) AS prediction_time, is_treatment_window, "
                "deterioration, deterioration_mask, risk_tier, abnormal_steps, valid_points, response, response_mask, "
                "round(pre_risk, 6) AS pre_risk, round(post_risk, 6) AS post_risk, round(delta_risk, 6) AS delta_risk")


@query("window_targets", TARGETED + f"SELECT {_WINDOW_COLS} FROM windows")
def window_targets(spark, d):
    out = windows(spark, d).select(
        "stay_id", "subject_id", "split", "prediction_time", "is_treatment_window", "deterioration",
        "deterioration_mask", "risk_tier", "abnormal_steps", "valid_points", "response", "response_mask",
        "pre_risk", "post_risk", "delta_risk")
    return tm.export(r6(out, "pre_risk", "post_risk", "delta_risk"))


_FC = [(k, c) for k in range(1, 5) for c in fx.FORECAST_CHANNELS]


@query("forecast_targets", ALIGNED + f"""
, f AS (SELECT stay_id, tick, first_tick, last_tick, {', '.join(
    f'lead({c}, {k}) {_W}) AS {c}_{k}' for k, c in _FC)} FROM filled)
SELECT stay_id, tick, {', '.join(f'round(coalesce({c}_{k}, 0), 6) AS {c}_{k}' for k, c in _FC)},
  {' + '.join(f'CASE WHEN {c}_{k} IS NULL THEN 0e0 ELSE 1e0 END' for k, c in _FC)} AS mask_sum
FROM f WHERE (tick - first_tick) // {STEP} >= 23 AND (tick - first_tick) // {STEP} < (last_tick - first_tick) // {STEP} - 3""")
def forecast_targets(spark, d):
    t = tg.add_forecast(timeline(spark, d))
    rows = t.df.where(F.col("core") & tg.is_window(t))
    cols = [F.round(F.col("forecast")[k - 1][fx.FORECAST_CHANNELS.index(c)], 6).alias(f"{c}_{k}") for k, c in _FC]
    mask = F.aggregate(F.flatten("forecast_mask"), F.lit(0.0), lambda a, b: a + b)
    return rows.select("stay_id", "tick", *cols, mask.alias("mask_sum"))


_NORM = ", ".join(
    (f"coalesce(c.{c}, (SELECT median FROM scaler WHERE channel = '{c}'))" if c.startswith(("mask_", "tx_")) else
     f"(coalesce(c.{c}, (SELECT median FROM scaler WHERE channel = '{c}')) - (SELECT mean FROM scaler WHERE channel = '{c}')) / "
     f"((SELECT std FROM scaler WHERE channel = '{c}') + 1e-6)") + f" AS {c}" for c in fx.FEATURES)


@query("window_dataset", FEATURED + "," + SCALER_SQL + "," + TARGET_SQL + f"""
, norm AS (SELECT stay_id, tick, {_NORM} FROM clipped c),
rs AS (SELECT stay_id, tick, {' + '.join(f'{c}::FLOAT::DOUBLE' for c in fx.FEATURES)} AS row_sum,
  heart_rate::FLOAT::DOUBLE AS hr, ema_map::FLOAT::DOUBLE AS em FROM norm),
hist AS (SELECT stay_id, tick, sum(row_sum) {_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS x_sum,
  first_value(hr) {_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS oldest_heart_rate,
  em AS newest_ema_map FROM rs)
SELECT w.stay_id, w.tick, w.split, w.deterioration, w.risk_tier, w.response, w.response_mask, 24 AS steps, 45 AS width,
  round(h.x_sum, 2) AS x_sum, round(h.oldest_heart_rate, 3) AS oldest_heart_rate, round(h.newest_ema_map, 3) AS newest_ema_map
FROM windows w JOIN hist h USING (stay_id, tick)""")
def window_dataset(spark, d):
    out = build_windows(spark, d)
    total = F.aggregate(F.flatten("X"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    at = fx.FEATURES.index
    return out.select(
        "stay_id", "tick", "split", "deterioration", "risk_tier", "response", "response_mask",
        F.size("X").alias("steps"), F.size(F.col("X")[0]).alias("width"), F.round(total, 2).alias("x_sum"),
        F.round(F.col("X")[0][at("heart_rate")].cast("double"), 3).alias("oldest_heart_rate"),
        F.round(F.col("X")[23][at("ema_map")].cast("double"), 3).alias("newest_ema_map"))


@query("window_cells", FEATURED + "," + SCALER_SQL + "," + TARGET_SQL + f"""
, norm AS (SELECT stay_id, tick, {_NORM} FROM clipped c),
tall AS (UNPIVOT (SELECT stay_id, tick, {', '.join(f'{c}::FLOAT::DOUBLE AS {c}' for c in fx.FEATURES)} FROM norm)
  ON {', '.join(fx.FEATURES)} INTO NAME feature VALUE v),
lags AS (SELECT stay_id, tick, split, unnest(range(24)) AS step FROM windows)
SELECT split, step::INT AS step, feature, count(*) AS n, round(sum(v), 3) AS total, round(min(v), 4) AS low, round(max(v), 4) AS high
FROM lags l JOIN tall x ON x.stay_id = l.stay_id AND x.tick = l.tick - (23 - l.step) * {STEP} GROUP BY ALL""")
def window_cells(spark, d):
    """Every cell of the history matrices, summed up by split, step and feature."""
    names = F.array(*map(F.lit, fx.FEATURES))
    rows = build_windows(spark, d).select("split", F.posexplode("X").alias("step", "row"))
    cells = rows.select("split", "step", F.posexplode("row").alias("f", "v")).select("split", "step", F.get(names, "f").alias("feature"), F.col("v").cast("double"))
    return cells.groupBy("split", "step", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"), F.round(F.min("v"), 4).alias("low"), F.round(F.max("v"), 4).alias("high"))


def featured(spark: SparkSession, d: str) -> Timeline:
    """Features and split of every tick."""
    return feat.add_features(win.long_enough(timeline(spark, d, treated=True, stored=True, parts=splits(spark, d))))


def train_scaler(t: Timeline) -> Scaler:
    return Scaler.fit(feat.feature_frame(t.with_df(t.df.where("split = 'train'"))))


def build_timeline(spark: SparkSession, d: str) -> tuple[Timeline, Scaler]:
    """The timeline with features, targets and split, and the train-only scaler, for a reader that looks at few targets.

    Targets are added where the stored features are read, so that those nobody looks at are neither made nor written.
    """
    t = featured(spark, d).stored()
    return tg.add_targets(t), train_scaler(t)


def build_windows(spark: SparkSession, d: str) -> DataFrame:
    """The full window dataset: features, train-only scaler, history matrix, targets, split."""
    t = tg.add_targets(featured(spark, d)).stored()
    return win.window_rows(win.with_history(t, train_scaler(t), keep=tg.is_window(t)), columns=["X"])


@query("validity_report", TARGETED + """
SELECT split, count(*) AS windows, count(*) * 20 AS future_points, sum(valid_points)::BIGINT AS valid_points,
  count(*) FILTER (WHERE valid_points > 0) AS windows_with_vitals,
  count(*) FILTER (WHERE deterioration_mask = 0) AS windows_without_vitals,
  count(*) FILTER (WHERE deterioration = 1) AS deterioration_positives,
  count(*) FILTER (WHERE response_mask = 1) AS response_windows FROM windows GROUP BY split""")
def validity_report(spark, d):
    return win.validity_report(windows(spark, d))


_AUD = ("count(*) AS windows, count(*) FILTER (WHERE deterioration = 1) AS det_pos, "
        + ", ".join(f"count(*) FILTER (WHERE risk_tier = {k}) AS tier_{k}" for k in range(3)) + ", "
        + ", ".join(f"count(*) FILTER (WHERE response = {k}) AS resp_{k}" for k in range(3)))


@query("target_audit", TARGETED + f"""
SELECT 'split' AS level, split, NULL::BIGINT AS subject_id, NULL::BIGINT AS stay_id, {_AUD} FROM windows GROUP BY split
UNION ALL SELECT 'subject', split, subject_id, NULL, {_AUD} FROM windows GROUP BY split, subject_id
UNION ALL SELECT 'stay', split, subject_id, stay_id, {_AUD} FROM windows GROUP BY split, subject_id, stay_id""")
def target_audit(spark, d):
    return win.target_audit(windows(spark, d))


@query("target_totals", TARGETED + """
SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS part, count(*) AS windows,
  count(*) FILTER (WHERE deterioration = 1) AS det_pos,
  round(count(*) FILTER (WHERE deterioration = 1) * 100e0 / count(*), 6) AS positive_pct,
  count(DISTINCT subject_id) AS subjects, count(DISTINCT stay_id) AS stays,
  count(DISTINCT subject_id) FILTER (WHERE deterioration = 1) AS subjects_with_positive,
  count(DISTINCT stay_id) FILTER (WHERE deterioration = 1) AS stays_with_positive,
  count(DISTINCT subject_id) FILTER (WHERE response = 1) AS subjects_improving,
  count(DISTINCT subject_id) FILTER (WHERE response = 2) AS subjects_worsening
FROM windows GROUP BY ROLLUP (split)""")
def target_totals(spark, d):
    return r6(win.target_totals(windows(spark, d)), "positive_pct")


@query("response_distribution", TARGETED + """
SELECT response, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 2) AS pct
FROM windows WHERE is_treatment_window GROUP BY response""")
def response_distribution(spark, d):
    return win.response_distribution(windows(spark, d))


@query("event_linked_responses", TARGETED + """
SELECT subject_id, stay_id, make_timestamp(tick * 1000000) AS prediction_time, split, treatment, drug_name, starttime,
  eligible, response AS response_code, ['Stable', 'Improving', 'Worsening'][response + 1] AS response_label
FROM windows WHERE is_treatment_window""")
def event_linked_responses(spark, d):
    return tm.export(win.event_linked_responses(windows(spark, d)))
