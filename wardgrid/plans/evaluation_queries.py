"""Metric, baseline, audit and monitoring queries with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.operators import audits as au
from wardgrid.operators import features as feat
from wardgrid.operators import metrics as me
from wardgrid.operators import models as mo
from wardgrid.operators import monitoring as mn
from wardgrid.operators import targets as tg
from wardgrid.operators import windows as win
from wardgrid.operators.features import rolling_stats
from wardgrid.operators.scaling import Scaler
from wardgrid.operators.slices import with_sequence_number
from wardgrid.operators.timeline import SO_FAR, TICKS, add_provenance
from wardgrid.plans import testmodel as tm
from wardgrid.plans.testmodel import SPEC, with_sql
from wardgrid.session import store
from wardgrid.sources.tables import LABEL_ONLY_TABLES
from wardgrid.plans.timeline_queries import (
    ALIGNED, SPLIT_SQL, STEP, TARGETED, _W, build_timeline, build_windows, r6, splits, timeline, windows,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


# ---- ranking metrics: score from the document length, labels from the labels table ---------------

_SCORES_SQL = """WITH j AS (SELECT l.doc_id, quality, toxic, (n_chars % 50) / 50e0 AS s1, (n_chars % 31) / 31e0 AS s2
  FROM labels l JOIN documents d USING (doc_id)),
sc AS (SELECT 'quality' AS label, quality AS y, s1 AS score FROM j UNION ALL SELECT 'toxic', toxic, s2 FROM j)"""


def scores(spark, d) -> DataFrame:
    docs = tm.load(spark, d, "documents").select("doc_id", "n_chars")
    j = tm.load(spark, d, "labels").join(docs, "doc_id")
    a = j.selectExpr("'quality' AS label", "quality AS y", "(n_chars % 50) / 50D AS score")
    return a.unionByName(j.selectExpr("'toxic' AS label", "toxic AS y", "(n_chars % 31) / 31D AS score"))


_RANK_SQL = """
, g AS (SELECT label, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS n FROM sc GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER a AS cp, sum(n) OVER a AS cn, sum(p) OVER (PARTITION BY label) AS tp, sum(n) OVER (PARTITION BY label) AS tn
  FROM g WINDOW a AS (PARTITION BY label ORDER BY score)),
q AS (SELECT label, max(tp)::BIGINT AS positives, max(tn)::BIGINT AS negatives, sum(p * (cn - n + n / 2e0)) / (max(tp) * max(tn))::DOUBLE AS auroc,
  sum(p * (tp - cp + p)::DOUBLE / (tp - cp + p + tn - cn + n)) / max(tp)::DOUBLE AS average_precision FROM c GROUP BY label)"""


@query("ranking_quality", _SCORES_SQL + _RANK_SQL + """
SELECT label, positives, negatives, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision FROM q""")
def ranking_quality(spark, d):
    return r6(me.ranking_quality(scores(spark, d), ["label"], "score", "y"), "auroc", "average_precision")


@query("macro_micro_auroc", _SCORES_SQL + _RANK_SQL + """
, m AS (SELECT 'all' AS label, score, y FROM sc), mg AS (SELECT score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS n FROM m GROUP BY 1),
mc AS (SELECT *, sum(n) OVER (ORDER BY score) AS cn FROM mg)
SELECT round((SELECT avg(auroc) FROM q), 6) AS macro_auroc, round(sum(p * (cn - n + n / 2e0)) / (sum(p) * sum(n))::DOUBLE, 6) AS micro_auroc FROM mc""")
def macro_micro_auroc(spark, d):
    return r6(me.macro_micro(scores(spark, d), "label", "score", "y"), "macro_auroc", "micro_auroc")


_CONF = "count(*) FILTER (WHERE score >= 0.38e0 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.38e0 AND y <> 1) AS fp, count(*) FILTER (WHERE score < 0.38e0 AND y = 1) AS fn, count(*) FILTER (WHERE score < 0.38e0 AND y <> 1) AS tn"


@query("threshold_metrics", _SCORES_SQL + f""", c AS (SELECT label, {_CONF} FROM sc GROUP BY label)
SELECT label, tp, fp, fn, tn, round(tp / greatest(tp + fp, 1)::DOUBLE, 6) AS precision, round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS recall,
 round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 6) AS f1, round(tn / greatest(tn + fp, 1)::DOUBLE, 6) AS specificity,
 round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round((tp + fn) / (tp + fp + fn + tn)::DOUBLE, 6) AS prevalence FROM c""")
def threshold_metrics(spark, d):
    out = me.threshold_metrics(scores(spark, d), ["label"], "score", "y", F.lit(0.38))
    return r6(out, "precision", "recall", "f1", "specificity", "accuracy", "prevalence")


@query("brier_score", _SCORES_SQL + "SELECT label, round(avg((score - y) * (score - y)), 6) AS brier FROM sc GROUP BY label")
def brier_score(spark, d):
    return r6(me.brier(scores(spark, d), ["label"], "score", "y"), "brier")


@query("calibration", _SCORES_SQL + """
SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS observed_rate FROM sc GROUP BY 1""")
def calibration(spark, d):
    return r6(me.calibration(scores(spark, d), "score", "y"), "mean_score", "observed_rate")


@query("model_comparison", _SCORES_SQL + _RANK_SQL + f"""
, cf AS (SELECT label, {_CONF} FROM sc GROUP BY label)
SELECT label AS model, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision,
 round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 6) AS f1 FROM q JOIN cf USING (label)""")
def model_comparison(spark, d):
    s = scores(spark, d)
    ranks = me.ranking_quality(s, ["label"], "score", "y").unpivot("label", ["auroc", "average_precision"], "metric", "value")
    f1 = me.threshold_metrics(s, ["label"], "score", "y", F.lit(0.38)).unpivot("label", ["f1"], "metric", "value")
    out = me.comparison_table(ranks.unionByName(f1).withColumnRenamed("label", "model"))
    return r6(out, "auroc", "average_precision", "f1")


# ---- weights and prevalence ----------------------------------------------------------------------

@query("positive_weights", """
SELECT l AS label, round(CASE WHEN p > 0 THEN least(greatest((n - p) / (p + 1e-6), 1), 25) ELSE 1 END, 6) AS weight FROM (
 SELECT 'quality' AS l, sum(quality) AS p, count(*) AS n FROM labels UNION ALL SELECT 'toxic', sum(toxic), count(*) FROM labels)""")
def positive_weights(spark, d):
    return r6(me.positive_weights(tm.load(spark, d, "labels"), ["quality", "toxic"]), "weight")


@query("label_prevalence", """
SELECT 'quality' AS label, sum(quality)::BIGINT AS positives, round(sum(quality) * 100e0 / count(*), 2) AS prevalence_pct FROM labels
UNION ALL SELECT 'toxic', sum(toxic)::BIGINT, round(sum(toxic) * 100e0 / count(*), 2) FROM labels""")
def label_prevalence(spark, d):
    return me.prevalence(tm.load(spark, d, "labels"), ["quality", "toxic"])


@query("class_weights", TARGETED + """
, t AS (SELECT * FROM windows WHERE split = 'train')
SELECT 'risk_tier' AS target, k AS class, round((SELECT count(*) FROM t) / (3e0 * greatest((SELECT count(*) FROM t WHERE risk_tier = k), 1)), 6) AS weight FROM (SELECT unnest([0, 1, 2]) AS k)
UNION ALL SELECT 'response', k, round((SELECT count(*) FROM t WHERE response_mask = 1) / (3e0 * greatest((SELECT count(*) FROM t WHERE response_mask = 1 AND response = k), 1)), 6) FROM (SELECT unnest([0, 1, 2]) AS k)
UNION ALL SELECT 'deterioration', 1, round(count(*) FILTER (WHERE deterioration = 0) / greatest(count(*) FILTER (WHERE deterioration = 1), 1)::DOUBLE, 6) FROM t""")
def class_weights(spark, d):
    t = store(windows(spark, d).where("split = 'train'").select("risk_tier", "response", "response_mask", "deterioration"))
    a = me.class_weights(t, "risk_tier").withColumn("target", F.lit("risk_tier"))
    b = me.class_weights(t, "response", mask="response_mask").withColumn("target", F.lit("response"))
    c = me.deterioration_weight(t).select(F.lit(1).alias("class"), F.col("pos_weight").alias("weight"), F.lit("deterioration").alias("target"))
    return r6(a.unionByName(b).unionByName(c), "weight")


_POINTS_SQL = f""", pts AS ({' UNION ALL '.join(
    f"SELECT stay_id, tick, '{c}' AS channel, {k} AS step, y, l, a FROM (SELECT stay_id, tick, first_tick, last_tick, "
    f"lead({c}, {k}) {_W}) AS y, coalesce({c}, (SELECT m_{c} FROM med)) AS l, "
    f"coalesce(avg({c}) {_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), (SELECT m_{c} FROM med)) AS a FROM filled) "
    f"WHERE (tick - first_tick) // {STEP} >= 23 AND (tick - first_tick) // {STEP} < (last_tick - first_tick) // {STEP} - 3 AND y IS NOT NULL"
    for c in fx.FORECAST_CHANNELS for k in range(1, 5))})"""


def _clip_sql(c: str) -> str:
    low, high = fx.CLIP_BOUNDS[c]
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {low}e0), {high}e0) END"


_MED_SQL = f""", med AS (SELECT {', '.join(f'round(quantile_cont({_clip_sql(c)}, 0.5), 6) AS m_{c}' for c in fx.FORECAST_CHANNELS)}
 FROM filled JOIN splits s USING (subject_id) WHERE s.split = 'train')"""


@query("channel_variance", ALIGNED + "," + SPLIT_SQL + _MED_SQL + _POINTS_SQL + """
, t AS (SELECT p.* FROM pts p JOIN stays s USING (stay_id) JOIN splits x ON x.subject_id = s.subject_id AND x.split = 'train'),
v AS (SELECT channel, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std, var_pop(y) AS variance FROM t GROUP BY channel)
SELECT channel, n, round(mean, 4) AS mean, round(std, 4) AS std, round(variance, 4) AS variance,
 round(variance * 100 / sum(variance) OVER (), 4) AS share_pct, round(greatest(variance, 1e-3), 4) AS scale FROM v""")
def channel_variance(spark, d):
    points = me.forecast_points(windows(spark, d).where("split = 'train'"))
    return r6(me.channel_variance(points), "mean", "std", "variance", "share_pct", "scale", digits=4)


def baseline_points(spark, d, kind: str) -> DataFrame:
    """Valid test points with the forecasts of a causal baseline ('last' or 'avg')."""
    parts = splits(spark, d)
    t = tg.add_forecast(timeline(spark, d, stored=True))
    train = t.rows("subject_id", *fx.FORECAST_CHANNELS).join(parts.where("split = 'train'"), "subject_id", "left_semi")
    medians = {c: m for c, (_, _, m) in Scaler.fit(train, fx.FORECAST_CHANNELS).stats.items()}
    t = me.baseline_predictions(t, medians)
    rows = t.df.where(F.col("core") & tg.is_window(t)).join(parts.where("split = 'test'"), "subject_id", "left_semi")
    return me.forecast_points(rows, ["stay_id", "tick"], predicted={c: F.col(f"{kind}_{c}") for c in fx.FORECAST_CHANNELS})


def _error_sql(kind: str) -> str:
    p = {"last": "l", "avg": "a"}[kind]
    m = (f"count(*) AS n, round(avg(abs({p} - y)), 4) AS mae, round(sqrt(avg(({p} - y) * ({p} - y))), 4) AS rmse, "
         f"round(CASE WHEN count(*) > 1 AND var_pop(y) > 1e-6 THEN 1 - sum(({p} - y) * ({p} - y)) / (var_pop(y) * count(*)) ELSE 0 END, 4) AS r2")
    return ALIGNED + "," + SPLIT_SQL + _MED_SQL + _POINTS_SQL + f"""
, t AS (SELECT p.* FROM pts p JOIN stays s USING (stay_id) JOIN splits x ON x.subject_id = s.subject_id AND x.split = 'test')
SELECT channel, {m} FROM t GROUP BY channel UNION ALL SELECT 'all', {m} FROM t"""


@query("persistence_forecast", _error_sql("last"))
def persistence_forecast(spark, d):
    return r6(me.forecast_errors(baseline_points(spark, d, "last")), "mae", "rmse", "r2", digits=4)


@query("moving_average_forecast", _error_sql("avg"))
def moving_average_forecast(spark, d):
    return r6(me.forecast_errors(baseline_points(spark, d, "avg")), "mae", "rmse", "r2", digits=4)


def _facts_sql(kind: str) -> str:
    return TARGETED + f"""
SELECT '{kind}' AS model, count(*) AS n, sum(deterioration)::BIGINT AS positives, count(*) AS in_range, 0e0 AS rate_gap
FROM windows WHERE split = 'test' AND deterioration_mask = 1"""


@query("logistic_baseline", _facts_sql("logistic_regression"))
def logistic_baseline(spark, d):
    return mo.scored_facts(store(mo.classify(build_windows(spark, d), "logistic_regression")), "logistic_regression")


@query("forest_baseline", _facts_sql("random_forest"))
def forest_baseline(spark, d):
    return mo.scored_facts(store(mo.classify(build_windows(spark, d), "random_forest")), "random_forest")


@query("forest_forecast", ALIGNED + "," + SPLIT_SQL + _MED_SQL + _POINTS_SQL + """
, t AS (SELECT p.* FROM pts p JOIN stays s USING (stay_id) JOIN splits x ON x.subject_id = s.subject_id AND x.split = 'test')
SELECT channel, step, count(*) AS n, round(sum(y) / 7, 4) AS sum_y, 0e0 AS mae_gap, 0e0 AS rmse_gap, 0e0 AS r2_gap FROM t GROUP BY channel, step""")
def forest_forecast(spark, d):
    """Rows and a seventh of the targets' sum (which no decimal tie can round both ways) of every channel and step, and how far the errors of `forecast_errors` are from plain aggregates of the rows (y, p)."""
    points = store(mo.forest_forecasts(*build_timeline(spark, d)))
    plain = points.groupBy("channel", "step").agg(
        F.round(F.sum("y") / 7, 4).alias("sum_y"), F.expr("sum(greatest(p, y) - least(p, y)) / count(*)").alias("_mae"),
        F.expr("sqrt((sum(p * p) - 2 * sum(p * y) + sum(y * y)) / count(*))").alias("_rmse"),
        F.expr("if(count(*) > 1 AND var_pop(y) > 1e-6, 1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 0D)").alias("_r2"))
    gap = lambda c: F.round(F.abs(F.col(c) - F.col(f"_{c}")), 5).alias(f"{c}_gap")
    return me.forecast_errors(points, ("channel", "step")).join(plain, ["channel", "step"]).select(
        "channel", "step", "n", "sum_y", gap("mae"), gap("rmse"), gap("r2"))


# ---- reports: the evaluation of the three models, which no SQL can foresee; tests recompute it from the rows (y, p) ----

def logistic_report(spark, d):
    return mo.evaluated(store(mo.classify(build_windows(spark, d), "logistic_regression")), "logistic_regression")


def forest_report(spark, d):
    return mo.evaluated(store(mo.classify(build_windows(spark, d), "random_forest")), "random_forest")


def forest_forecast_report(spark, d):
    """MAE, RMSE and R2 per channel and step, and of all channels per step."""
    return me.forecast_errors(store(mo.forest_forecasts(*build_timeline(spark, d))), ("channel", "step"))


REPORTS = {f.__name__: f for f in (logistic_report, forest_report, forest_forecast_report)}


# ---- audits --------------------------------------------------------------------------------------

RULES = ["temporal_leakage", "scaler_leakage", "patient_leakage", "denied_features", "label_only_sources"]


def traced_windows(spark, d, frame: str = SO_FAR) -> tuple[DataFrame, Scaler, list[str]]:
    """Windows with the provenance of their inputs, the scaler fitted on the train ticks, and the tables that the features read."""
    plain = timeline(spark, d, treated=True, sources=True, frame=frame)
    rows = win.window_rows(tg.add_targets(add_provenance(plain)), splits(spark, d), columns=["newest_source", "target_tick"])
    train = store(plain.rows("subject_id", *fx.FORECAST_CHANNELS).join(splits(spark, d).where("split = 'train'"), "subject_id", "left_semi"))
    kept = store(rows.select("stay_id", "subject_id", "split", "tick", "newest_source", "target_tick"))
    return kept, Scaler.fit(train, fx.FORECAST_CHANNELS), au.tables_read(feat.feature_frame(feat.add_features(plain)))


def label_only_tables(spark, d) -> list[str]:
    """Tables whose rows may only give labels."""
    mapped = {"diagnoses_icd": tm.diagnoses}
    return [t for name in sorted(LABEL_ONLY_TABLES) for t in au.tables_read(mapped[name](spark, d))]


@query("leakage_audit", f"""
SELECT r AS rule, 0::BIGINT AS violations, true AS passed FROM (SELECT unnest({RULES}) AS r)""")
def leakage_audit(spark, d):
    w, scaler, files = traced_windows(spark, d)
    return au.leakage_audit(w, splits(spark, d), scaler.seen, fx.FEATURES, read=files, label_only=label_only_tables(spark, d))


_ANY_RAW = " OR ".join(f"{c} IS NOT NULL" for c in fx.CHANNELS)


@query("leakage_audit_peeking", TARGETED + f"""
, seen AS (SELECT stay_id, tick, lead({_ANY_RAW}) OVER (PARTITION BY stay_id ORDER BY tick) AS next_seen FROM raw)
SELECT r AS rule, CASE WHEN r = 'temporal_leakage' THEN (SELECT count(*) FROM windows JOIN seen USING (stay_id, tick) WHERE next_seen) ELSE 0 END AS violations,
 r <> 'temporal_leakage' OR NOT EXISTS (SELECT 1 FROM windows JOIN seen USING (stay_id, tick) WHERE next_seen) AS passed FROM (SELECT unnest({RULES}) AS r)""")
def leakage_audit_peeking(spark, d):
    """The same audit over a timeline whose fill looks one tick ahead: a window is late where any channel was read in its next tick."""
    w, scaler, files = traced_windows(spark, d, f"{TICKS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING")
    return au.leakage_audit(w, splits(spark, d), scaler.seen, fx.FEATURES, read=files, label_only=label_only_tables(spark, d))


@query("leakage_audit_leaky", TARGETED + f"""
, l AS (SELECT stay_id, subject_id, tick, split, CASE WHEN stay_id % 5 = 0 THEN 'train' ELSE split END AS s FROM windows),
r AS (SELECT 'temporal_leakage' AS rule, count(*) AS violations FROM l WHERE tick % {7 * STEP} = 0
 UNION ALL SELECT 'scaler_leakage', count(DISTINCT subject_id) FROM l WHERE s = 'train' AND split <> 'train'
 UNION ALL SELECT 'patient_leakage', count(*) FROM (SELECT subject_id FROM l GROUP BY 1 HAVING min(s) <> max(s))
 UNION ALL SELECT 'denied_features', 1 UNION ALL SELECT 'label_only_sources', 2)
SELECT rule, violations, violations = 0 AS passed FROM r""")
def leakage_audit_leaky(spark, d):
    """Windows with targets at their own tick, stays moved to train, a score among the features, and the label tables among the files read."""
    w, _, files = traced_windows(spark, d)
    w = store(w.withColumns({
        "split": F.when(F.col("stay_id") % 5 == 0, "train").otherwise(F.col("split")),
        "target_tick": F.when(F.col("tick") % (7 * STEP) == 0, F.col("tick")).otherwise(F.col("target_tick"))}))
    labels = label_only_tables(spark, d)
    return au.leakage_audit(w, splits(spark, d), w.where("split = 'train'").select("subject_id"), [*fx.FEATURES, "news2"],
                            read=files + labels, label_only=labels)


@query("integrity_audit_damaged", TARGETED + """
SELECT split, count(*) AS windows, count(*) FILTER (WHERE stay_id % 4 = 0) AS bad_inputs, count(*) FILTER (WHERE stay_id % 6 = 0) AS bad_targets,
 count(*) FILTER (WHERE stay_id % 10 = 0) AS bad_masks FROM windows GROUP BY split""")
def integrity_audit_damaged(spark, d):
    """NaN inputs, missing targets and missing mask values in some stays."""
    w = build_windows(spark, d)
    return au.integrity_audit(w.withColumns({
        "X": F.expr("transform(X, (r, i) -> if(i = 0 AND stay_id % 4 = 0, transform(r, (v, j) -> if(j = 0, float('nan'), v)), r))"),
        "forecast": F.expr("transform(forecast, (r, i) -> if(i = 3 AND stay_id % 6 = 0, transform(r, v -> nullif(v, v)), r))"),
        "forecast_mask": F.expr("transform(forecast_mask, (r, i) -> if(i = 1 AND stay_id % 10 = 0, transform(r, v -> nullif(v, v)), r))")}))


@query("integrity_audit", TARGETED + """
SELECT split, count(*) AS windows, 0::BIGINT AS bad_inputs, 0::BIGINT AS bad_targets, 0::BIGINT AS bad_masks FROM windows GROUP BY split""")
def integrity_audit(spark, d):
    return au.integrity_audit(build_windows(spark, d))


# ---- monitoring ----------------------------------------------------------------------------------

def _numbered(spark, d) -> DataFrame:
    ev = tm.events(spark, d).select("event_id", "user_id", "ts", "value")
    return with_sequence_number(ev, ["user_id"], "ts", ["ts", "event_id"])


@query("personal_baseline", """WITH RECURSIVE n AS (SELECT event_id, user_id, value / 7 AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
b(user_id, seq, base) AS (SELECT user_id, 48, avg(value) FROM n WHERE seq <= 48 GROUP BY user_id HAVING count(*) = 48
 UNION ALL SELECT n.user_id, n.seq, 0.05e0 * n.value + 0.95e0 * b.base FROM b JOIN n ON n.user_id = b.user_id AND n.seq = b.seq + 1)
SELECT n.event_id, n.seq, round(base, 6) AS baseline, round(value - base, 6) AS deviation FROM n LEFT JOIN b ON b.user_id = n.user_id AND b.seq = n.seq""")
def personal_baseline(spark, d):
    # sevenths have no finite decimal form, so no rounding tie can occur
    readings = _numbered(spark, d).withColumn("value", F.col("value") / 7)
    out = mn.personal_baseline(readings, ["user_id"], "value")
    return r6(out.select("event_id", "seq", "baseline", "deviation"), "baseline", "deviation")


@query("personal_baseline_gaps", """WITH RECURSIVE r AS (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 AND event_id % 700 > 90 THEN value / 7 END AS value, ts FROM events),
n AS (SELECT event_id, user_id, value, row_number() OVER w AS seq, count(value) OVER w AS k FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b(user_id, k, base) AS (SELECT user_id, 48, avg(value) FROM n WHERE k <= 48 GROUP BY user_id HAVING count(value) = 48
 UNION ALL SELECT n.user_id, n.k, 0.05e0 * n.value + 0.95e0 * b.base FROM b JOIN n ON n.user_id = b.user_id AND n.k = b.k + 1 AND n.value IS NOT NULL)
SELECT n.event_id, n.seq, round(base, 6) AS baseline, round(value - base, 6) AS deviation FROM n LEFT JOIN b ON b.user_id = n.user_id AND b.k = n.k""")
def personal_baseline_gaps(spark, d):
    present = F.when((F.col("event_id") % 4 != 0) & (F.col("event_id") % 700 > 90), F.col("value") / 7)
    out = mn.personal_baseline(_numbered(spark, d).withColumn("value", present), ["user_id"], "value")
    return r6(out.select("event_id", "seq", "baseline", "deviation"), "baseline", "deviation")


def _roll(n: int) -> str:
    w = f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"round(avg(value) {w}, 6) AS mean_{n}, round(stddev_samp(value) {w}, 6) AS std_{n}, "
            f"min(value) {w} AS min_{n}, max(value) {w} AS max_{n}")


@query("rolling_stats", f"SELECT event_id, {', '.join(_roll(n) for n in (5, 15, 30))} FROM events")
def rolling_stats_query(spark, d):
    out = rolling_stats(_numbered(spark, d), ["user_id"], "value", "seq").drop("user_id", "ts", "value", "seq")
    return r6(out, *[f"{s}_{n}" for n in (5, 15, 30) for s in ("mean", "std")])


_HIST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query("strided_windows", f"""
SELECT event_id, seq, round(s, 5) AS history_sum FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, sum(value) {_HIST} AS s FROM events)
WHERE seq >= 24 AND (seq - 24) % 6 = 0""")
def strided_windows(spark, d):
    out = win.strided_windows(_numbered(spark, d), ["user_id"], "seq", ["value"], 24, 6)
    total = F.aggregate("history", F.lit(0.0), lambda a, x: a + x["value"])
    return r6(out.select("event_id", "seq", total.alias("history_sum")), "history_sum", digits=5)


@query("lag_pairs", f"""
SELECT event_id, seq, round(h, 5) AS history_sum, round(f, 5) AS future_sum FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
 count(*) OVER (PARTITION BY user_id) AS n, sum(value) {_HIST} AS h, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS f FROM events)
WHERE seq >= 24 AND seq + 15 <= n""")
def lag_pairs(spark, d):
    out = win.strided_windows(_numbered(spark, d), ["user_id"], "seq", ["value"], 24, 1, 15)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["value"])
    return r6(out.select("event_id", "seq", total("history").alias("history_sum"), total("future").alias("future_sum")),
              "history_sum", "future_sum", digits=5)


@query("sustained_events", """
SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE value > 65 AND p > 65""")
def sustained_events(spark, d):
    ev = tm.events(spark, d).select("event_id", "user_id", "ts", "value")
    return mn.sustained(ev, ["user_id"], "ts", ["ts", "event_id"], F.col("value") > 65).where("sustained").select("event_id")


@query("composite_outcome", with_sql("ev", "stays", "admissions", "infusions") + """
, s AS (SELECT stay_id, ts, value, lag(value) OVER (PARTITION BY stay_id ORDER BY ts, event_id) AS p FROM ev),
e AS (SELECT stay_id, ts AS time, 'sustained' AS kind FROM s WHERE value > 65 AND p > 65
 UNION ALL SELECT stay_id, starttime, 'vasopressor' FROM infusions WHERE itemid IN (0, 8)
 UNION ALL SELECT stay_id, deathtime, 'death' FROM stays JOIN admissions USING (hadm_id) WHERE deathtime BETWEEN intime AND outtime)
SELECT stay_id, min(time) AS first_time, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kinds FROM e GROUP BY stay_id""")
def composite_outcome(spark, d):
    from wardgrid.operators.profiling import deaths_in_stay
    ev = tm.events(spark, d).select("event_id", "stay_id", "ts", "value")
    a = mn.sustained(ev, ["stay_id"], "ts", ["ts", "event_id"], F.col("value") > 65).where("sustained").selectExpr(
        "stay_id", "ts AS time", "'sustained' AS kind")
    b = tm.infusions(spark, d).where("itemid IN (0, 8)").selectExpr("stay_id", "starttime AS time", "'vasopressor' AS kind")
    c = deaths_in_stay(tm.stays(spark, d), tm.admissions(spark, d)).selectExpr("stay_id", "deathtime AS time", "'death' AS kind")
    return tm.export(mn.composite_outcome([a, b, c]))


@query("alert_log", """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, l_suppkey % 3 AS p, lag(l_suppkey % 3) OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS q
 FROM lineitem WHERE l_discount * 10 > 0.65e0) WHERE q IS NULL OR p <> q""")
def alert_log(spark, d):
    a = tm.load(spark, d, "lineitem").where("l_discount * 10 > 0.65D").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_suppkey % 3 AS patient_id", "CAST(l_shipdate AS TIMESTAMP) AS ts")
    out = mn.suppress_repeats(a, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


@query("alert_lead_time", """
WITH a AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE value > 80), e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error')
SELECT e.user_id AS patient_id, e.event_id, round((any_value(e.us) - min(a.us)) / 60e6, 8) AS lead_minutes
FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.us BETWEEN e.us - 172800000000 AND e.us GROUP BY 1, 2""")
def alert_lead_time(spark, d):
    ev = tm.events(spark, d).withColumnRenamed("user_id", "patient_id")
    return r6(mn.lead_times(ev.where("value > 80"), ev.where("event_type = 'error'"), 48.0), "lead_minutes", digits=8)


