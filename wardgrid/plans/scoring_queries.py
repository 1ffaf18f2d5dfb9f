"""Scoring, ward-view and finding queries with their checking SQL.

Vitals frames come from `lineitem`: one frame per line, so their number grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.functions import clinical as cl
from wardgrid.functions import fixed_values as fx
from wardgrid.functions import vectors as vec
from wardgrid.functions.rules import clip
from wardgrid.operators import scoring as sc
from wardgrid.plans import testmodel as tm
from wardgrid.plans.timeline_queries import SCORE_SQL, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


_FRAME = """l_orderkey, l_linenumber, l_partkey, l_suppkey AS patient_id, l_discount, l_tax, l_quantity, l_shipdate AS ts,
  40 + l_quantity * 2 AS heart_rate,
  CASE WHEN l_quantity = 13 THEN NULL ELSE 100 - l_discount * 200 END AS spo2,
  CAST(70 + l_partkey % 131 AS DOUBLE) AS systolic_bp, CAST(70 + l_partkey % 131 AS DOUBLE) AS sbp,
  CAST(40 + l_partkey % 53 AS DOUBLE) AS diastolic_bp,
  8 + l_tax * 300 AS respiratory_rate, 35 + (l_quantity % 12) / 2 AS body_temperature"""
FRAMES_SQL = f"WITH frames AS (SELECT {_FRAME} FROM lineitem)"
_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
_KEY_SQL = "l_orderkey, l_linenumber, l_partkey"


def frames(spark, d) -> DataFrame:
    return tm.load(spark, d, "lineitem").selectExpr(
        *[e.strip() for e in _split_top(_FRAME)]).withColumn("ts", F.col("ts").cast("timestamp"))


def _split_top(text: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return [*parts, cur]


def _news_sql(gap_free: bool) -> str:
    base = fx.LIVE_BASELINE
    v = {n: f"coalesce({n}, {base[n]}e0)" for n in fx.NEWS2_BOUNDS}
    out = []
    if gap_free:
        for n, bands in fx.NEWS2_BOUNDS.items():
            whens = " ".join(f"WHEN {v[n]} <= {b} THEN {s}" for b, s in bands if b is not None)
            out.append(f"CASE {whens} ELSE {bands[-1][1]} END AS s_{n}")
    else:
        rules = {
            "respiratory_rate": "WHEN x <= 8 OR x >= 25 THEN 3 WHEN x BETWEEN 21 AND 24 THEN 2 WHEN x BETWEEN 9 AND 11 THEN 1",
            "spo2": "WHEN x <= 91 THEN 3 WHEN x BETWEEN 92 AND 93 THEN 2 WHEN x BETWEEN 94 AND 95 THEN 1",
            "systolic_bp": "WHEN x <= 90 OR x >= 220 THEN 3 WHEN x BETWEEN 91 AND 100 THEN 2 WHEN x BETWEEN 101 AND 110 THEN 1",
            "heart_rate": "WHEN x <= 40 OR x >= 131 THEN 3 WHEN x BETWEEN 111 AND 130 THEN 2 WHEN x BETWEEN 41 AND 50 OR x BETWEEN 91 AND 110 THEN 1",
            "body_temperature": "WHEN x <= 35 THEN 3 WHEN x >= 39.1e0 THEN 2 WHEN x BETWEEN 35.1e0 AND 36 OR x BETWEEN 38.1e0 AND 39 THEN 1",
        }
        out = [f"CASE {r.replace('x ', v[n] + ' ')} ELSE 0 END AS s_{n}" for n, r in rules.items()]
    return ", ".join(out)


def _advice_sql(tier: str, advice: dict[str, str]) -> str:
    return f"CASE {tier} " + " ".join(f"WHEN '{name}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for name, text in advice.items()) + " END"


def _news_query(gap_free: bool) -> str:
    total = " + ".join(f"s_{n}" for n in fx.NEWS2_BOUNDS)
    red = " OR ".join(f"s_{n} = 3" for n in ("respiratory_rate", "spo2", "systolic_bp", "heart_rate"))
    return FRAMES_SQL + f""", s AS (SELECT *, {_news_sql(gap_free)} FROM frames),
t AS (SELECT *, CASE WHEN {total} >= 7 OR {red} THEN 'High' WHEN {total} >= 5 THEN 'Medium' ELSE 'Low' END AS risk_tier FROM s)
SELECT {_KEY_SQL}, {total} AS total_score, risk_tier, {_advice_sql('risk_tier', fx.NEWS2_ADVICE)} AS clinical_recommendation,
  s_respiratory_rate AS respiratory_rate_score, s_spo2 AS spo2_score, s_systolic_bp AS systolic_bp_score,
  s_heart_rate AS heart_rate_score, s_body_temperature AS temperature_score FROM t"""


@query("news2", _news_query(True))
def news2(spark, d):
    return frames(spark, d).select(*_KEY, cl.news2().alias("n")).select(*_KEY, "n.*")


@query("news2_banded", _news_query(False))
def news2_banded(spark, d):
    return frames(spark, d).select(*_KEY, cl.news2("banded").alias("n")).select(*_KEY, "n.*")


@query("instability_score", FRAMES_SQL + f"""
, m AS (SELECT *, coalesce(spo2, 98) AS o, coalesce(diastolic_bp + (systolic_bp - diastolic_bp) / 3, 85) AS b, coalesce(sbp, 120) AS s,
  coalesce(respiratory_rate, 16) AS q, coalesce(heart_rate, 75) AS h FROM frames)
SELECT {_KEY_SQL}, round({SCORE_SQL}, 6) AS score FROM m""")
def instability_score(spark, d):
    f = frames(spark, d)
    score = cl.instability(map_=cl.mean_arterial_pressure(F.col("systolic_bp"), F.col("diastolic_bp")))
    return r6(f.select(*_KEY, score.alias("score")), "score")


_POINTS_SQL = """least(100e0,
  CASE WHEN h >= 130 THEN 30 WHEN h >= 110 THEN 18 WHEN h < 45 THEN 20 ELSE 0 END
+ CASE WHEN o <= 88 THEN 35 WHEN o <= 92 THEN 22 WHEN o < 95 THEN 10 ELSE 0 END
+ CASE WHEN s <= 85 THEN 30 WHEN s <= 95 THEN 18 ELSE 0 END
+ CASE WHEN q >= 28 THEN 25 WHEN q >= 22 THEN 14 ELSE 0 END)"""
_BED_SQL = FRAMES_SQL + ", m AS (SELECT *, coalesce(spo2, 98) AS o, sbp AS s, respiratory_rate AS q, heart_rate AS h FROM frames)"


@query("bedside_points", _BED_SQL + f"""
SELECT {_KEY_SQL}, {_POINTS_SQL} AS points, concat_ws('; ',
  CASE WHEN h >= 130 THEN 'Severe Tachycardia (HR: ' || printf('%.0f', h) || ' bpm)' WHEN h >= 110 THEN 'Moderate Tachycardia (HR: ' || printf('%.0f', h) || ' bpm)'
    WHEN h < 45 THEN 'Bradycardia (HR: ' || printf('%.0f', h) || ' bpm)' END,
  CASE WHEN o <= 88 THEN 'Severe Hypoxemia (SpO2: ' || printf('%.1f', o) || '%)' WHEN o <= 92 THEN 'Moderate Hypoxemia (SpO2: ' || printf('%.1f', o) || '%)'
    WHEN o < 95 THEN 'Mild Desaturation (SpO2: ' || printf('%.1f', o) || '%)' END,
  CASE WHEN s <= 85 THEN 'Severe Hypotension / Shock (SBP: ' || printf('%.0f', s) || ' mmHg)' WHEN s <= 95 THEN 'Moderate Hypotension (SBP: ' || printf('%.0f', s) || ' mmHg)' END,
  CASE WHEN q >= 28 THEN 'Severe Tachypnea (RR: ' || printf('%.0f', q) || ' bpm)' WHEN q >= 22 THEN 'Elevated Respiratory Rate (RR: ' || printf('%.0f', q) || ' bpm)' END) AS factors
FROM m""")
def bedside_points(spark, d):
    return frames(spark, d).select(
        *_KEY, cl.bedside_points().alias("points"), F.array_join(cl.bedside_factors(), "; ").alias("factors"))


_FUSE = """c AS (SELECT *, (l_partkey % 997 + 0.5e0) / 997 AS p, {pts} AS points,
  CASE WHEN l_linenumber IN (1, 2) THEN 'No Finding' WHEN l_linenumber = 3 THEN NULL ELSE 'Pneumonia' END AS finding FROM m),
v AS (SELECT *, CASE WHEN finding IS NOT NULL AND finding <> 'No Finding' THEN p * 100 ELSE least(greatest(l_tax * 5 * 120, 5), 75) END AS visual FROM c),
w AS (SELECT *, p * 100 * 0.45e0 + points * 0.35e0 + visual * 0.2e0 AS combined FROM v)""".format(pts=_POINTS_SQL)


@query("late_fusion", _BED_SQL + ", " + _FUSE + f"""
, x AS (SELECT *, round(least(greatest(combined, 0), 100), 1) AS risk_score,
  CASE WHEN combined > 1e-6 THEN round((p * 100 * 0.25e0 + points * 0.35e0) / combined * 100, 1) ELSE 50 END AS vitals_contribution FROM w),
y AS (SELECT *, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High' WHEN risk_score >= 25 THEN 'Moderate' ELSE 'Low' END AS risk_tier FROM x)
SELECT {_KEY_SQL}, risk_score, risk_tier, {_advice_sql('risk_tier', fx.FUSION_ADVICE)} AS recommendation,
  vitals_contribution, round(100 - vitals_contribution, 1) AS visual_contribution FROM y""")
def late_fusion(spark, d):
    finding = F.when(F.col("l_linenumber").isin(1, 2), "No Finding").when(
        F.col("l_linenumber") == 3, None).otherwise("Pneumonia")
    p = (F.col("l_partkey") % 997 + 0.5) / 997.0
    visual = cl.visual_risk(finding, p, F.col("l_tax") * 5)
    out = frames(spark, d).select(*_KEY, cl.fusion(p, cl.bedside_points(), visual).alias("f"))
    return out.select(*_KEY, "f.*")


@query("vital_status", FRAMES_SQL + f"""
SELECT {_KEY_SQL},
 CASE WHEN heart_rate >= 130 THEN 'CRITICAL HIGH' WHEN heart_rate >= 100 THEN 'TACHYCARDIA' WHEN heart_rate < 50 THEN 'BRADYCARDIA' ELSE 'NORMAL' END AS hr,
 CASE WHEN spo2 IS NULL THEN NULL WHEN spo2 <= 88 THEN 'SEVERE HYPOXIA' WHEN spo2 < 92 THEN 'DESATURATION' ELSE 'OPTIMAL' END AS oxygen,
 CASE WHEN sbp <= 85 THEN 'SHOCK / HYPOTENSION' WHEN sbp < 95 THEN 'BORDERLINE LOW' WHEN sbp > 160 THEN 'HYPERTENSIVE' ELSE 'NORMOTENSIVE' END AS pressure,
 CASE WHEN respiratory_rate >= 28 THEN 'TACHYPNEA CRITICAL' WHEN respiratory_rate >= 22 THEN 'ELEVATED RR' ELSE 'NORMAL' END AS breathing FROM frames""")
def vital_status(spark, d):
    return frames(spark, d).select(
        *_KEY, cl.vital_status("heart_rate", F.col("heart_rate")).alias("hr"),
        cl.vital_status("spo2", F.col("spo2")).alias("oxygen"), cl.vital_status("sbp", F.col("sbp")).alias("pressure"),
        cl.vital_status("respiratory_rate", F.col("respiratory_rate")).alias("breathing"))


@query("derived_vitals", FRAMES_SQL + f"""
SELECT {_KEY_SQL}, round(diastolic_bp + (systolic_bp - diastolic_bp) / 3, 6) AS mean_arterial_pressure,
 systolic_bp - diastolic_bp AS pulse_pressure, round(CASE WHEN systolic_bp > 0 THEN heart_rate / systolic_bp ELSE 0 END, 6) AS shock_index,
 round((heart_rate - 30) / (170 + 1e-6), 6) AS scaled, CASE WHEN (heart_rate > 110 AND sbp < 95) OR coalesce(spo2 < 90, false) OR body_temperature > 38.8e0 THEN 0.85e0 ELSE 0.15e0 END AS label_risk,
 CASE WHEN (heart_rate > 110 AND sbp < 95) OR coalesce(spo2 < 90, false) OR body_temperature > 38.8e0 THEN 2 ELSE 0 END AS label_tier,
 round(0.5e0 * l_discount + 0.3e0 * l_tax + 0.2e0 * l_discount, 4) AS horizon FROM frames""")
def derived_vitals(spark, d):
    f = sc.derived_vitals(frames(spark, d))
    label = cl.shock_label(F.col("heart_rate"), F.col("sbp"), F.col("spo2"), F.col("body_temperature"))
    out = f.select(
        *_KEY, "mean_arterial_pressure", "pulse_pressure", "shock_index",
        cl.min_max(F.col("heart_rate"), *fx.LIVE_BOUNDS["heart_rate"]).alias("scaled"),
        label["risk"].alias("label_risk"), label["tier"].alias("label_tier"),
        cl.horizon_risk(F.col("l_discount"), F.col("l_tax"), F.col("l_discount")).alias("horizon"))
    return r6(out, "mean_arterial_pressure", "shock_index", "scaled")


@query("deviation_vector", FRAMES_SQL + f"""
SELECT {_KEY_SQL}, round(least(greatest((heart_rate - 75) / 25, -3), 5), 6) AS hr, round(least(greatest((98 - coalesce(spo2, 98)) / 8, -3), 5), 6) AS oxygen,
 round(least(greatest((115 - sbp) / 25, -3), 5), 6) AS pressure, round(least(greatest((respiratory_rate - 16) / 6, -3), 5), 6) AS breathing FROM frames""")
def deviation_vector(spark, d):
    v = frames(spark, d).select(*_KEY, cl.bedside_deviation().alias("v"))
    names = ["hr", "oxygen", "pressure", "breathing"]
    return v.select(*_KEY, *[F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate(names)])


@query("range_validation", FRAMES_SQL + f"""
, a AS (SELECT *, CASE WHEN l_quantity = 7 THEN NULL ELSE l_quantity * 3 END AS age FROM frames),
r AS (SELECT *, CASE WHEN NOT coalesce(heart_rate BETWEEN 20 AND 250, false) THEN 'heart_rate out of range'
 WHEN NOT coalesce(spo2 BETWEEN 50 AND 100, false) THEN 'spo2 out of range' WHEN NOT coalesce(sbp BETWEEN 40 AND 260, false) THEN 'sbp out of range'
 WHEN NOT coalesce(respiratory_rate BETWEEN 4 AND 70, false) THEN 'respiratory_rate out of range'
 WHEN NOT coalesce(age BETWEEN 0 AND 130, true) THEN 'age out of range' END AS reject_reason FROM a)
SELECT {_KEY_SQL}, reject_reason FROM r""")
def range_validation(spark, d):
    f = frames(spark, d).withColumn("age", F.when(F.col("l_quantity") == 7, None).otherwise(F.col("l_quantity") * 3))
    return sc.with_violation(f).select(*_KEY, "reject_reason")


@query("frame_contract", FRAMES_SQL + """
SELECT count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected FROM (
 SELECT heart_rate BETWEEN 20 AND 250 AND coalesce(spo2 BETWEEN 50 AND 100, false) AND systolic_bp BETWEEN 40 AND 280
  AND respiratory_rate BETWEEN 4 AND 60 AND body_temperature BETWEEN 36 AND 44 AS ok FROM frames)""")
def frame_contract(spark, d):
    bounds = {**fx.FRAME_CONTRACT, "body_temperature": (36.0, 44.0)}
    checked = sc.with_violation(frames(spark, d), bounds, ["diastolic_bp"])
    return checked.agg(F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
                       F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))


_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey"]
_ORDER_SQL = "ts, l_orderkey, l_linenumber, l_partkey"
_DESC_SQL = ", ".join(f"{c} DESC" for c in _ORDER)
_VIT = [*fx.LIVE_VITALS, "diastolic_bp"]


def latest(spark, d) -> DataFrame:
    return sc.latest_per_patient(frames(spark, d), _ORDER, [*_ORDER, *_VIT])


LATEST_SQL = FRAMES_SQL + f", latest AS (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY {_DESC_SQL}) = 1)"


@query("latest_vitals", LATEST_SQL + f"SELECT patient_id, {_ORDER_SQL}, {', '.join(_VIT)} FROM latest")
def latest_vitals(spark, d):
    return tm.export(latest(spark, d))


@query("last_readings", FRAMES_SQL + f"""
, b AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY {_DESC_SQL}) AS back,
  count(*) OVER (PARTITION BY patient_id) AS n FROM frames)
SELECT patient_id, {_ORDER_SQL}, heart_rate, least(n, 10) - back + 1 AS position FROM b WHERE back <= 10""")
def last_readings(spark, d):
    out = sc.last_readings(frames(spark, d).select("patient_id", *_ORDER, "heart_rate"), _ORDER, 10)
    return tm.export(out)


_LIVE = ["heart_rate", "spo2", "systolic_bp", "diastolic_bp", "respiratory_rate", "body_temperature"]


def _ranges_sql(hours: int) -> str:
    return FRAMES_SQL + f"""
, n AS (SELECT patient_id, max(ts) AS newest FROM frames GROUP BY 1)
SELECT patient_id, {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in _LIVE)}
FROM frames JOIN n USING (patient_id) WHERE ts >= newest - INTERVAL {hours} HOURS GROUP BY patient_id"""


@query("vital_ranges", _ranges_sql(2400))
def vital_ranges(spark, d):
    return sc.vital_ranges(frames(spark, d), _LIVE, 2400.0)


@query("vital_ranges_24h", _ranges_sql(24))
def vital_ranges_24h(spark, d):
    return sc.vital_ranges(frames(spark, d), _LIVE)


def summary(spark, d) -> DataFrame:
    s = tm.load(spark, d, "supplier")
    n = tm.load(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("unit"))
    people = s.join(n, "s_nationkey").select(F.col("s_suppkey").alias("patient_id"), F.col("s_name").alias("name"), "unit")
    p = tm.load(spark, d, "lineitem")
    risk = p.groupBy(F.col("l_suppkey").alias("patient_id")).agg(
        F.avg("l_discount").alias("risk_1h"), F.max("l_discount").alias("risk_3h"), F.max("l_tax").alias("risk_6h"))
    return sc.ward_summary(people, latest(spark, d), risk)


SUMMARY_SQL = LATEST_SQL + f""", s AS (SELECT *, {_news_sql(True)} FROM latest),
 n AS (SELECT *, {' + '.join(f's_{x}' for x in fx.NEWS2_BOUNDS)} AS total FROM s),
 risk AS (SELECT l_suppkey AS patient_id, avg(l_discount) AS risk_1h, max(l_discount) AS risk_3h, max(l_tax) AS risk_6h FROM lineitem GROUP BY 1),
 summary AS (SELECT p.s_suppkey AS patient_id, p.s_name AS name, t.n_name AS unit, n.ts, n.heart_rate, n.spo2, n.systolic_bp, n.diastolic_bp,
   n.respiratory_rate, n.body_temperature, risk_1h, risk_3h, risk_6h, n.total AS news2_score,
   CASE WHEN total IS NULL THEN NULL WHEN total >= 7 OR s_respiratory_rate = 3 OR s_spo2 = 3 OR s_systolic_bp = 3 OR s_heart_rate = 3 THEN 'High'
     WHEN total >= 5 THEN 'Medium' ELSE 'Low' END AS news2_tier
   FROM supplier p JOIN nation t ON t.n_nationkey = p.s_nationkey LEFT JOIN n ON n.patient_id = p.s_suppkey
   LEFT JOIN risk ON risk.patient_id = p.s_suppkey)"""


@query("ward_summary", SUMMARY_SQL + """
SELECT patient_id, name, unit, heart_rate, spo2, news2_score, news2_tier, round(risk_1h, 6) AS risk_1h FROM summary""")
def ward_summary(spark, d):
    return r6(summary(spark, d).select("patient_id", "name", "unit", "heart_rate", "spo2", "news2_score",
                                       "news2_tier", "risk_1h"), "risk_1h")


@query("patient_state", SUMMARY_SQL + """
SELECT patient_id, name, ts AS latest_timestamp, round(diastolic_bp + (systolic_bp - diastolic_bp) / 3, 6) AS map,
 news2_score, """ + ", ".join(f"round(coalesce({c}, 0) - {fx.LIVE_BASELINE[c]}e0, 2) AS {c}_deviation" for c in fx.LIVE_VITALS) + """,
 round(0.5e0 * risk_1h + 0.3e0 * risk_3h + 0.2e0 * risk_6h, 4) AS health_risk_score,
 CASE WHEN patient_id % 3 = 0 THEN 1 ELSE 0 END AS n_anomalies FROM summary""")
def patient_state(spark, d):
    s = summary(spark, d).withColumns({
        "active_anomalies": F.when(F.col("patient_id") % 3 == 0, F.array(F.lit("hypoxia_drop"))).otherwise(
            F.array().cast("array<string>")),
        "overrides": F.create_map().cast("map<string,double>")})
    st = sc.patient_state(s)
    out = st.select(
        "patient_id", "observed_state.name", "observed_state.latest_timestamp",
        F.col("derived_state.mean_arterial_pressure").alias("map"),
        F.col("derived_state.news2.total_score").alias("news2_score"),
        *[F.col(f"derived_state.baseline_deviations.{c}").alias(f"{c}_deviation") for c in fx.LIVE_VITALS],
        "predicted_state.health_risk_score", F.size("simulation_state.active_anomalies").alias("n_anomalies"))
    return tm.export(r6(out, "map"))


_ANOM = ["septic_spike", "hypoxia_drop", "cardiac_arrhythmia"]


def controls(spark, d) -> DataFrame:
    s = tm.load(spark, d, "supplier")
    kinds = F.filter(F.array(*[F.when(F.col("s_suppkey") % (i + 2) == 0, a) for i, a in enumerate(_ANOM)]),
                     lambda x: x.isNotNull())
    return s.select(F.col("s_suppkey").alias("patient_id"), kinds.alias("anomalies"))


def _anomaly_sql(c: str) -> str:
    parts = [f"CASE WHEN patient_id % {i + 2} = 0 THEN {fx.ANOMALY_OFFSETS[a][c]}e0 ELSE 0 END"
             for i, a in enumerate(_ANOM) if c in fx.ANOMALY_OFFSETS[a]]
    low, high = fx.LIVE_BOUNDS[c]
    value = " + ".join([c, *parts])
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE round(least(greatest({value}, {low}), {high}), 6) END AS {c}"


@query("anomaly_injection", FRAMES_SQL + f"""
SELECT {_KEY_SQL}, {', '.join(_anomaly_sql(c) for c in fx.LIVE_BOUNDS)}, patient_id % 2 = 0 OR patient_id % 3 = 0 OR patient_id % 4 = 0 AS is_anomaly_active FROM frames""")
def anomaly_injection(spark, d):
    out = sc.apply_anomalies(frames(spark, d), controls(spark, d))
    return r6(out.select(*_KEY, *fx.LIVE_BOUNDS, "is_anomaly_active"), *fx.LIVE_BOUNDS)


@query("what_if_overrides", LATEST_SQL + """
, o AS (SELECT *, CASE WHEN patient_id % 2 = 0 THEN 135 ELSE heart_rate END AS h, CASE WHEN patient_id % 5 = 0 THEN 82 ELSE systolic_bp END AS s FROM latest)
SELECT patient_id, h AS heart_rate, s AS systolic_bp, round(diastolic_bp + (s - diastolic_bp) / 3, 6) AS mean_arterial_pressure,
 round(CASE WHEN s > 0 THEN h / s ELSE 0 END, 6) AS shock_index FROM o""")
def what_if_overrides(spark, d):
    o = tm.load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("patient_id"),
        F.when(F.col("s_suppkey") % 2 == 0, 135.0).alias("set_heart_rate"),
        F.when(F.col("s_suppkey") % 5 == 0, 82.0).alias("set_systolic_bp"))
    out = sc.apply_overrides(latest(spark, d), o)
    return r6(out.select("patient_id", "heart_rate", "systolic_bp", "mean_arterial_pressure", "shock_index"),
              "mean_arterial_pressure", "shock_index")


@query("what_if_projection", FRAMES_SQL + f"""
, b AS (SELECT *, least(greatest(floor(15
  + CASE WHEN spo2 < 85 THEN 45 WHEN spo2 < 90 THEN 32 WHEN spo2 < 93 THEN 18 WHEN spo2 < 95 THEN 8 ELSE 0 END
  + CASE WHEN heart_rate > 140 THEN 30 WHEN heart_rate > 120 THEN 20 WHEN heart_rate > 100 THEN 10 WHEN heart_rate < 50 THEN 25 ELSE 0 END
  + CASE WHEN sbp < 80 THEN 35 WHEN sbp < 90 THEN 22 WHEN sbp < 100 THEN 12 WHEN sbp > 180 THEN 18 ELSE 0 END
  + CASE WHEN respiratory_rate > 32 THEN 32 WHEN respiratory_rate > 26 THEN 20 WHEN respiratory_rate > 20 THEN 10 WHEN respiratory_rate < 10 THEN 25 ELSE 0 END + 0.5e0), 5), 98)::DOUBLE AS base,
  CASE WHEN l_linenumber = 1 THEN -22 ELSE 0 END + CASE WHEN l_linenumber <= 2 THEN -18 ELSE 0 END + CASE WHEN l_linenumber = 4 THEN -12 ELSE 0 END AS effect FROM frames),
h AS (SELECT *, unnest([0, 1, 3, 6]) AS hours FROM b),
g AS (SELECT *, floor(base * (1 + (CASE WHEN base > 55 THEN 1.18e0 WHEN base > 35 THEN 1.08e0 ELSE 0.96e0 END - 1)
   * CASE hours WHEN 1 THEN 0.45e0 WHEN 3 THEN 1.15e0 WHEN 6 THEN 1.95e0 ELSE 0 END) + 0.5e0) AS drift FROM h),
r AS (SELECT *, CASE WHEN hours = 0 THEN base ELSE least(greatest(drift, 4), 99) END AS unmanaged_risk,
  least(greatest(CASE WHEN effect = 0 THEN drift ELSE floor(drift + effect * CASE hours WHEN 0 THEN 0 WHEN 1 THEN 0.6e0 WHEN 3 THEN 0.9e0 ELSE 1 END + 0.5e0) END, 4), 99) AS counterfactual_risk FROM g)
SELECT {_KEY_SQL}, hours, unmanaged_risk::DOUBLE AS unmanaged_risk, counterfactual_risk::DOUBLE AS counterfactual_risk,
 CASE WHEN unmanaged_risk >= 70 THEN 'Critical' WHEN unmanaged_risk >= 45 THEN 'High' WHEN unmanaged_risk >= 25 THEN 'Moderate' ELSE 'Low' END AS tier FROM r""")
def what_if_projection(spark, d):
    line = F.col("l_linenumber")
    return sc.what_if(frames(spark, d), _KEY, cl.intervention_effect(line == 1, line <= 2, line == 4))


# ---- findings and vectors ----------------------------------------------------------------------

_PROB = {"Pneumonia": "l_discount * 10", "Edema": "l_tax * 12", "Atelectasis": "l_quantity / 60", "No Finding": "0.5"}


def _prob_map():
    return F.map_from_arrays(F.expr(f"array({', '.join(repr(k) for k in _PROB)})"),
                             F.expr(f"array({', '.join(f'CAST({v} AS DOUBLE)' for v in _PROB.values())})"))


_P_SQL = "p AS (SELECT *, l_discount * 10 AS pn, l_tax * 12 AS ed, l_quantity / 60 AS atl, 0.5e0 AS nf FROM frames)"


@query("top_finding", FRAMES_SQL + ", " + _P_SQL + f"""
, h AS (SELECT *, pn >= 0.35e0 OR ed >= 0.38e0 OR atl >= 0.38e0 AS hit FROM p)
SELECT {_KEY_SQL}, hit AS has_pathology, CASE WHEN NOT hit THEN 'No Finding' WHEN pn >= ed AND pn >= atl THEN 'Pneumonia'
  WHEN ed >= atl THEN 'Edema' ELSE 'Atelectasis' END AS top_finding,
 round(CASE WHEN hit THEN greatest(pn, ed, atl) ELSE nf END, 6) AS top_probability FROM h""")
def top_finding(spark, d):
    f = frames(spark, d).withColumn("t", sc.top_finding(_prob_map()))
    return r6(f.select(*_KEY, "t.*"), "top_probability")


@query("finding_list", FRAMES_SQL + ", " + _P_SQL + f"""
, u AS (SELECT {_KEY_SQL}, unnest([{{'name': 'Pneumonia', 'q': pn, 't': 0.35e0}}, {{'name': 'Edema', 'q': ed, 't': 0.38e0}},
   {{'name': 'Atelectasis', 'q': atl, 't': 0.38e0}}, {{'name': 'No Finding', 'q': nf, 't': 0.5e0}}]) AS f FROM p)
SELECT f.name AS name, CASE WHEN f.q < f.t THEN 'none' WHEN f.q < 0.65e0 THEN 'mild' WHEN f.q < 0.85e0 THEN 'moderate' ELSE 'severe' END AS severity,
 f.q >= f.t AS is_positive, count(*) AS n, round(min(f.q), 6) AS lowest FROM u GROUP BY 1, 2, 3""")
def finding_list(spark, d):
    f = frames(spark, d).select(F.explode(sc.finding_list(_prob_map())).alias("f"))
    out = f.groupBy("f.name", "f.severity", "f.is_positive").agg(
        F.count(F.lit(1)).alias("n"), F.min("f.probability").alias("lowest"))
    return r6(out, "lowest")


@query("positive_findings", """
SELECT doc_id, concat_ws(';', CASE WHEN quality = 1 THEN 'Quality' END, CASE WHEN toxic = 1 THEN 'Toxic' END) AS findings FROM labels""")
def positive_findings(spark, d):
    return tm.load(spark, d, "labels").select("doc_id", F.array_join(
        sc.positive_findings({"Quality": "quality", "Toxic": "toxic"}), ";").alias("findings"))


@query("unit_vectors", """
, n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l2, sqrt(list_sum(list_transform(e[1:32], lambda x: x * x))) AS l2_32 FROM v)
SELECT vec_id, 128 AS padded_size, 32 AS cut_size, round(e[1] / l2, 5) AS first_padded, 0e0 AS last_padded,
 round(e[32] / l2_32, 5) AS last_cut, round(list_sum(list_transform(e, lambda x: abs(x))) / 64, 5) AS activation FROM n""".replace(
    ", n AS", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS", 1))
def unit_vectors(spark, d):
    e = tm.load(spark, d, "embeddings")
    wide, cut = vec.unit_vector(F.col("embedding"), 128), vec.unit_vector(F.col("embedding"), 32)
    return e.select(
        "vec_id", F.size(wide).alias("padded_size"), F.size(cut).alias("cut_size"),
        F.round(wide[0], 5).alias("first_padded"), wide[127].alias("last_padded"), F.round(cut[31], 5).alias("last_cut"),
        F.round(vec.mean_activation(F.col("embedding")), 5).alias("activation"))


@query("image_gate", """
SELECT doc_id, CASE WHEN w < 32 OR h < 32 THEN 'too small' WHEN w / h < 0.45e0 OR w / h > 2.2e0 THEN 'implausible aspect ratio'
 WHEN chroma > 15 THEN 'colour saturation' WHEN sd < 15 THEN 'flat or blank' WHEN white > 0.7e0 THEN 'white background'
 WHEN black > 0.85e0 THEN 'black background' WHEN edge < 0.5e0 THEN 'edge density too low' WHEN edge > 65 THEN 'edge density too high'
 ELSE 'Valid chest radiograph.' END AS verdict
FROM (SELECT doc_id, 20 + n_chars % 300 AS w, (20 + doc_id * 7 % 300)::DOUBLE AS h, doc_id % 20 AS chroma, n_chars % 60 AS sd,
 (doc_id % 100) / 100e0 AS white, (n_chars % 97) / 97e0 AS black, (n_chars % 701) / 10e0 AS edge FROM documents)""")
def image_gate(spark, d):
    x = tm.load(spark, d, "documents").selectExpr(
        "doc_id", "20 + n_chars % 300 AS width", "CAST(20 + doc_id * 7 % 300 AS DOUBLE) AS height", "doc_id % 20 AS chroma",
        "n_chars % 60 AS std_dev", "(doc_id % 100) / 100D AS white_fraction", "(n_chars % 97) / 97D AS black_fraction",
        "(n_chars % 701) / 10D AS edge_magnitude")
    return x.select("doc_id", cl.image_gate().alias("verdict"))


# ---- studies and ward views --------------------------------------------------------------------

@query("study_ownership", """
SELECT l_orderkey AS study_id, l_linenumber, CASE WHEN o_custkey IS NULL THEN 'STUDY_NOT_FOUND' WHEN o_custkey <> l_suppkey THEN 'PATIENT_MISMATCH' ELSE 'OK' END AS status
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'""")
def study_ownership(spark, d):
    req = tm.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("study_id"), "l_linenumber", F.col("l_suppkey").alias("patient_id"))
    st = tm.load(spark, d, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("study_id"), F.col("o_custkey").alias("patient_id"))
    return sc.ownership(req, st).select("study_id", "l_linenumber", "status")


@query("patient_studies", """
SELECT o_custkey AS patient_id, o_orderkey AS study_id, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey""")
def patient_studies(spark, d):
    st = tm.load(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("study_id"), "o_orderstatus")
    return sc.studies_of(st, 7)


@query("scan_comparison", """
WITH s AS (SELECT conv_id AS patient_id, turn AS seq, (length(text) % 100)::DOUBLE AS risk, (length(text) % 37)::DOUBLE AS p FROM conversations)
SELECT b.patient_id, b.seq, b.risk - a.risk AS risk_delta, round(CASE WHEN a.risk > 0 THEN (b.risk - a.risk) / a.risk * 100 ELSE 0 END, 6) AS risk_change_pct,
 b.p - a.p < -5 AS pathology_improved, b.p - a.p > 0 AS clear_improved FROM s a JOIN s b ON a.patient_id = b.patient_id AND b.seq = a.seq + 1""")
def scan_comparison(spark, d):
    s = tm.load(spark, d, "conversations").selectExpr(
        "conv_id AS patient_id", "turn AS seq", "CAST(length(text) % 100 AS DOUBLE) AS risk", "CAST(length(text) % 37 AS DOUBLE) AS p")
    out = sc.with_risk_change(sc.consecutive_studies(s, ["risk", "p"]))
    delta = F.col("post_p") - F.col("pre_p")
    return r6(out.select("patient_id", "seq", "risk_delta", "risk_change_pct",
                         sc.finding_improved("Pneumonia", delta).alias("pathology_improved"),
                         sc.finding_improved("No Finding", delta).alias("clear_improved")), "risk_change_pct")


@query("archive_search", """
SELECT c_custkey::VARCHAR AS id, 'MRN-' || c_custkey AS mrn, c_name AS name, c_mktsegment AS primary_diagnosis, c_nationkey AS age, c_acctbal AS peak_risk,
 CASE WHEN c_nationkey % 2 = 0 THEN 'Home' ELSE 'Transfer' END AS disposition FROM customer
WHERE (contains(c_custkey::VARCHAR, '12') OR contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12') OR contains(lower('MRN-' || c_custkey), '12'))
 AND c_nationkey % 2 = 0""")
def archive_search(spark, d):
    rec = tm.load(spark, d, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS id", "concat('MRN-', c_custkey) AS mrn", "c_name AS name",
        "c_mktsegment AS primary_diagnosis", "c_nationkey AS age", "c_acctbal AS peak_risk",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'Home' ELSE 'Transfer' END AS disposition")
    return sc.search_archive(rec, " 12 ", "Home")


def _alerts(spark, d) -> DataFrame:
    ev = tm.events(spark, d)
    return ev.selectExpr(
        "event_id", "ts", "user_id AS patient_id", "concat('Patient ', user_id) AS patient_name", "concat('Bed ', user_id % 40) AS bed",
        "concat(event_type, ' alarm') AS message",
        "CASE WHEN value >= 100 THEN 'critical' WHEN value >= 40 THEN 'warning' ELSE 'info' END AS severity")


_ALERT_SQL = """WITH alerts AS (SELECT event_id, ts, user_id AS patient_id, 'Patient ' || user_id AS patient_name, 'Bed ' || user_id % 40 AS bed, event_type || ' alarm' AS message,
 CASE WHEN value >= 100 THEN 'critical' WHEN value >= 40 THEN 'warning' ELSE 'info' END AS severity FROM events)"""


@query("alert_feed", _ALERT_SQL + """
SELECT event_id, patient_name, bed, message FROM alerts WHERE severity = 'critical'
 AND (contains(lower(patient_name), 'sign') OR contains(lower(bed), 'sign') OR contains(lower(message), 'sign'))""")
def alert_feed(spark, d):
    return sc.alert_feed(_alerts(spark, d), "critical", "SIGN").select("event_id", "patient_name", "bed", "message")


@query("daily_alerts", _ALERT_SQL + """
SELECT ts::DATE AS day, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning,
 count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM alerts GROUP BY 1""")
def daily_alerts(spark, d):
    return sc.daily_alerts(_alerts(spark, d))


@query("pathology_shares", "SELECT lang, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 1) AS pct FROM documents GROUP BY lang")
def pathology_shares(spark, d):
    return sc.share_counts(tm.load(spark, d, "documents"), "lang")


@query("unit_breakdown", """
SELECT c_mktsegment AS unit, count(o) AS beds_occupied, count(*) AS total_beds, round(avg(r), 6) AS avg_risk, count(*) FILTER (WHERE r >= 75) AS critical_count
FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 10 < 8 THEN c_custkey END AS o, CASE WHEN c_custkey % 10 < 8 THEN abs(c_acctbal) / 100 END AS r FROM customer) GROUP BY 1""")
def unit_breakdown(spark, d):
    beds = tm.load(spark, d, "customer").selectExpr(
        "c_mktsegment AS unit", "CASE WHEN c_custkey % 10 < 8 THEN c_custkey END AS patient_id",
        "CASE WHEN c_custkey % 10 < 8 THEN abs(c_acctbal) / 100 END AS risk")
    return r6(sc.unit_breakdown(beds), "avg_risk")
