"""Cohort and profiling queries with their checking SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.operators import cohort as co
from wardgrid.operators import profiling as pf
from wardgrid.operators import treatments as tx
from wardgrid.operators.timeline import fill_forever, name_items
from wardgrid.plans import testmodel as tm
from wardgrid.plans.testmodel import SPEC, with_sql
from wardgrid.plans.timeline_queries import ALIGNED, NAMED_SQL, STEP, _W, r6, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


# ---- cohort ----------------------------------------------------------------------------------

def _found(spark, d):
    return co.categorised_diagnoses(tm.diagnoses(spark, d), tm.diagnosis_dictionary(spark, d),
                                    tm.DIAGNOSIS_STEMS, tm.CONDITION_RULES, "Other part")


def _cohort(spark, d):
    return co.select_cohort(tm.stays(spark, d), tm.patients(spark, d), _found(spark, d))


_LIKE = " OR ".join(f"lower(long_title) LIKE '%{s}%'" for s in tm.DIAGNOSIS_STEMS)
FOUND_SQL = f"""
found AS (SELECT *, {tm._sql_class('long_title', tm.CONDITION_RULES, "'Other part'")} AS condition FROM diag WHERE {_LIKE})"""
COHORT_SQL = with_sql("ev", "stays", "patients", "diag") + "," + FOUND_SQL + f"""
, cond AS (SELECT hadm_id, string_agg(condition, '; ' ORDER BY condition) AS conditions
  FROM (SELECT DISTINCT hadm_id, condition FROM found) GROUP BY hadm_id),
cohort AS (SELECT s.*, (out_us - in_us) / 3600e6 AS duration_hours, gender, anchor_age,
    coalesce(conditions, '{fx.CONDITION_DEFAULT}') AS conditions
  FROM stays s LEFT JOIN patients USING (subject_id) LEFT JOIN cond USING (hadm_id)
  WHERE s.subject_id IN (SELECT subject_id FROM found) AND (out_us - in_us) / 3600e6 >= 6)"""


@query("cohort", COHORT_SQL + """
SELECT subject_id, hadm_id, stay_id, intime, outtime, first_careunit, round(duration_hours, 6) AS duration_hours,
  gender, anchor_age, conditions FROM cohort ORDER BY subject_id, intime""")
def cohort(spark, d):
    out = co.sorted_cohort(_cohort(spark, d)).select(
        "subject_id", "hadm_id", "stay_id", "intime", "outtime", "first_careunit", "duration_hours",
        "gender", "anchor_age", "conditions")
    return tm.export(r6(out, "duration_hours"))


@query("cohort_summary", COHORT_SQL + """
SELECT count(DISTINCT subject_id) AS patients, count(DISTINCT hadm_id) AS admissions, count(*) AS stays,
  round(quantile_cont(duration_hours, 0.5), 6) AS median_hours, round(avg(duration_hours), 6) AS mean_hours FROM cohort""")
def cohort_summary(spark, d):
    c = _cohort(spark, d)
    from wardgrid.operators.quantiles import exact_quantiles
    one = c.agg(F.count_distinct("subject_id").alias("patients"), F.count_distinct("hadm_id").alias("admissions"),
                F.count(F.lit(1)).alias("stays"), F.avg("duration_hours").alias("mean_hours"), F.lit(0).alias("_k"))
    med = exact_quantiles(c, [], "duration_hours", {"median_hours": 0.5}).withColumn("_k", F.lit(0))
    return r6(one.join(med, "_k").drop("_k"), "mean_hours", "median_hours")


@query("condition_counts", with_sql("diag") + "," + FOUND_SQL + "SELECT condition, count(*) AS n FROM found GROUP BY condition")
def condition_counts(spark, d):
    return co.value_counts(_found(spark, d), "condition")


@query("top_diagnoses", with_sql("diag") + "," + FOUND_SQL + """
SELECT long_title, count(*) AS n FROM found GROUP BY long_title ORDER BY n DESC, long_title LIMIT 10""")
def top_diagnoses(spark, d):
    return co.top_values(_found(spark, d), "long_title")


_DRUG_TITLES = "SELECT coalesce(p_name, 'unlisted') AS label FROM infusions LEFT JOIN part ON p_partkey = itemid"


@query("top_infusion_labels", with_sql("ev", "infusions") + f"""
SELECT label, count(*) AS n FROM ({_DRUG_TITLES}) GROUP BY label ORDER BY n DESC, label LIMIT 10""")
def top_infusion_labels(spark, d):
    labels = tm.load(spark, d, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"))
    out = tx.with_labels(tm.infusions(spark, d), labels).na.fill("unlisted", ["label"])
    return co.top_values(out, "label")


@query("stay_hours", with_sql("ev", "stays") + """
SELECT stay_id, round((out_us - in_us) / 3600e6, 6) AS duration_hours FROM stays WHERE (out_us - in_us) / 3600e6 >= 200""")
def stay_hours(spark, d):
    out = co.stay_hours(tm.stays(spark, d)).where("duration_hours >= 200")
    return r6(out.select("stay_id", "duration_hours"), "duration_hours")


@query("parse_raw_times", """
SELECT count(*) AS n, count(CASE WHEN turn % 2 = 0 THEN 1 END) AS parsed, count(CASE WHEN turn % 2 = 1 THEN 1 END) AS unparsed
FROM conversations""")
def parse_raw_times(spark, d):
    c = tm.load(spark, d, "conversations")
    raw = F.when(F.col("turn") % 2 == 0, F.format_string("2024-01-%02d 00:00:00", (F.col("turn") + 1).cast("int"))).otherwise(
        F.concat(F.lit("not a time "), F.col("role")))
    out = co.parse_time(c.select(raw.alias("charttime")), "charttime")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("charttime").alias("parsed"),
                   F.count_if(F.col("charttime").isNull()).alias("unparsed"))


# ---- sampling --------------------------------------------------------------------------------

_OBS = with_sql("ev", "obs", "stays")


def _group_sql(groups) -> str:
    return "(CASE itemid " + " ".join(
        f"WHEN {i} THEN '{g}'" for g, ids in groups.items() for i in ids) + " END)"


def _gap_sql(keys: str, per: float, source: str) -> str:
    return (f"gaps AS (SELECT * FROM (SELECT *, (us - lag(us) OVER (PARTITION BY {keys} ORDER BY us)) / {per}e0 AS gap "
            f"FROM {source}) WHERE gap > 0)")


@query("sampling_all", _OBS + "," + _gap_sql("subject_id, stay_id", 60e6, "obs") + """
SELECT count(*) AS intervals, round(avg(gap), 6) AS mean, round(stddev_pop(gap), 6) AS std, round(min(gap), 6) AS min,
  round(max(gap), 6) AS max, round(quantile_cont(gap, 0.25), 6) AS p25, round(quantile_cont(gap, 0.5), 6) AS median,
  round(quantile_cont(gap, 0.75), 6) AS p75, round(quantile_cont(gap, 0.9), 6) AS p90, round(quantile_cont(gap, 0.95), 6) AS p95
FROM gaps""")
def sampling_all(spark, d):
    gaps = pf.positive_gaps(tm.observations(spark, d), ["subject_id", "stay_id"])
    out = pf.gap_summary(gaps, [], {**pf.QUARTERS, "p90": 0.9, "p95": 0.95})
    return r6(out, "mean", "std", "min", "max", "p25", "median", "p75", "p90", "p95")


@query("gap_to_previous", _OBS + "," + _gap_sql("stay_id", 60e6, "obs") + """
SELECT event_id, stay_id, round(gap, 8) AS gap FROM gaps""")
def gap_to_previous(spark, d):
    from wardgrid.operators.slices import with_previous
    obs = tm.observations(spark, d)
    out = with_previous(obs.select("event_id", "stay_id", "charttime"), ["stay_id"], "charttime",
                        ["charttime", "event_id"], ["charttime"])
    gap = (F.unix_micros("charttime") - F.unix_micros("prev_charttime")) / 60e6
    return r6(out.select("event_id", "stay_id", gap.alias("gap")).where("gap > 0"), "gap", digits=8)


@query("sampling_by_variable", _OBS + f""",
v AS (SELECT *, {_group_sql(fx.SAMPLING_VITALS)} AS variable FROM obs WHERE {_group_sql(fx.SAMPLING_VITALS)} IS NOT NULL),
""" + _gap_sql("variable, subject_id, stay_id", 60e6, "v") + """,
per AS (SELECT variable, stay_id, count(*) AS n FROM v GROUP BY 1, 2),
tot AS (SELECT variable, sum(n)::BIGINT AS measurements, quantile_cont(n, 0.5)::DOUBLE AS per_stay_median FROM per GROUP BY 1)
SELECT variable, any_value(measurements) AS measurements, any_value(per_stay_median) AS per_stay_median, count(*) AS intervals,
  round(avg(gap), 6) AS mean, round(stddev_pop(gap), 6) AS std, round(min(gap), 6) AS min, round(max(gap), 6) AS max,
  round(quantile_cont(gap, 0.25), 6) AS p25, round(quantile_cont(gap, 0.5), 6) AS median,
  round(quantile_cont(gap, 0.75), 6) AS p75, round(quantile_cont(gap, 0.9), 6) AS p90
FROM gaps JOIN tot USING (variable) GROUP BY variable""")
def sampling_by_variable(spark, d):
    return r6(pf.sampling_by_variable(tm.observations(spark, d)),
              "mean", "std", "min", "max", "p25", "median", "p75", "p90")


@query("sampling_by_lab", _OBS + f""",
v AS (SELECT *, {_group_sql(fx.SAMPLING_LABS)} AS variable FROM obs WHERE {_group_sql(fx.SAMPLING_LABS)} IS NOT NULL),
""" + _gap_sql("variable, subject_id", 3600e6, "v") + """,
tot AS (SELECT variable, count(*) AS measurements FROM v GROUP BY 1)
SELECT t.variable, any_value(measurements) AS measurements, round(avg(gap), 6) AS mean, round(quantile_cont(gap, 0.5), 6) AS median
FROM tot t LEFT JOIN gaps g ON g.variable = t.variable GROUP BY t.variable""")
def sampling_by_lab(spark, d):
    return r6(pf.sampling_by_lab(tm.observations(spark, d)), "mean", "median")


def _items_sql(items) -> str:
    return "items AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}::BIGINT, '{c}')" for i, c in items.items()) + ") t(itemid, canonical_name))"


def _temporal_sql(items, source: str, per: float, quantiles: str) -> str:
    return f"""{_items_sql(items)},
src AS (SELECT * FROM {source} WHERE itemid IN (SELECT itemid FROM items)),
cnt AS (SELECT itemid, count(*) AS n_observations, count(DISTINCT subject_id) AS n_patients,
    count(DISTINCT stay_id) AS n_stays FROM src GROUP BY itemid),
{_gap_sql("itemid, stay_id", per, "(SELECT * FROM src WHERE stay_id IS NOT NULL)")},
g AS (SELECT itemid, avg(gap) AS mean, stddev_pop(gap) AS std, min(gap) AS min, max(gap) AS max, {quantiles} FROM gaps GROUP BY itemid),
med AS (SELECT itemid, quantile_cont(n, 0.5)::DOUBLE AS obs_per_stay_median FROM (
    SELECT itemid, stay_id, count(*) AS n FROM src WHERE stay_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


_Q3 = "quantile_cont(gap, 0.25) AS p25, quantile_cont(gap, 0.5) AS median, quantile_cont(gap, 0.75) AS p75"


@query("temporal_profile", _OBS + "," + _temporal_sql(fx.PROFILE_VITALS, "obs", 60e6, _Q3) + """
SELECT i.itemid, canonical_name, coalesce(n_observations, 0) AS n_observations, coalesce(n_patients, 0) AS n_patients,
  coalesce(n_stays, 0) AS n_stays, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max,
  round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, obs_per_stay_median,
  round(coalesce(n_stays, 0) * 100e0 / (SELECT count(*) FROM stays), 6) AS coverage_pct
FROM items i LEFT JOIN cnt USING (itemid) LEFT JOIN g USING (itemid) LEFT JOIN med USING (itemid)""")
def temporal_profile(spark, d):
    stays = tm.stays(spark, d)
    out = pf.temporal_profile(tm.observations(spark, d), pf.registry(spark, fx.PROFILE_VITALS), stays.count())
    return r6(out, "mean", "std", "min", "max", "p25", "median", "p75", "coverage_pct")


@query("missingness_profile", _OBS + "," + _items_sql(fx.PROFILE_VITALS) + """
, c AS (SELECT itemid, count(*) AS n, count(*) - count(valuenum) AS m, count(DISTINCT subject_id) AS p,
   count(DISTINCT stay_id) AS s FROM obs GROUP BY itemid),
q AS (SELECT i.itemid, canonical_name, coalesce(n, 0) AS n_observations, coalesce(m, 0) AS n_missing, coalesce(p, 0) AS n_patients,
   coalesce(s, 0) AS n_stays, round(coalesce(m, 0) * 100e0 / greatest(coalesce(n, 0), 1), 2) AS missing_pct
  FROM items i LEFT JOIN c USING (itemid))
SELECT *, round(n_stays * 100e0 / (SELECT count(*) FROM stays), 6) AS coverage_pct,
  CASE WHEN n_observations = 0 THEN 'ABSENT' WHEN missing_pct < 10 THEN 'LOW' WHEN missing_pct < 30 THEN 'MODERATE'
    WHEN missing_pct < 60 THEN 'HIGH' ELSE 'SEVERE' END AS severity FROM q""")
def missingness_profile(spark, d):
    stays = tm.stays(spark, d)
    out = pf.missingness_profile(tm.observations(spark, d), pf.registry(spark, fx.PROFILE_VITALS), stays.count())
    return r6(out, "coverage_pct")


@query("value_summary", _OBS + """
SELECT itemid, count(*) AS n_observations, count(valuenum) AS n_values, round(avg(valuenum), 6) AS mean,
  round(stddev_samp(valuenum), 6) AS std, round(min(valuenum), 6) AS min, round(max(valuenum), 6) AS max,
  round(quantile_cont(valuenum, 0.05), 6) AS p5, round(quantile_cont(valuenum, 0.25), 6) AS p25,
  round(quantile_cont(valuenum, 0.5), 6) AS median, round(quantile_cont(valuenum, 0.75), 6) AS p75,
  round(quantile_cont(valuenum, 0.95), 6) AS p95 FROM obs GROUP BY itemid HAVING count(valuenum) > 0""")
def value_summary(spark, d):
    out = pf.value_summary(tm.observations(spark, d))
    return r6(out, "mean", "std", "min", "max", "p5", "p25", "median", "p75", "p95")


@query("quality_issues", _OBS + """
, o AS (SELECT *, date_trunc('day', charttime) AS day FROM obs),
k AS (SELECT itemid, count(*) - count(DISTINCT (stay_id, day)) AS dup, count(*) FILTER (WHERE valuenum < 0) AS neg,
  count(DISTINCT valueuom) AS units FROM o GROUP BY itemid HAVING count(valuenum) > 0)
SELECT itemid, 'negative_values' AS issue, neg AS n, 'WARNING' AS severity FROM k WHERE neg > 0
UNION ALL SELECT itemid, 'duplicate_timestamps', dup, 'WARNING' FROM k WHERE dup > 0
UNION ALL SELECT itemid, 'multiple_units', units, 'NOTE' FROM k WHERE units > 1""")
def quality_issues(spark, d):
    obs = tm.observations(spark, d).withColumn("charttime", F.date_trunc("day", "charttime"))
    return pf.quality_issues(obs)


@query("lab_profile_by_stay", _OBS + """,
linked AS (SELECT o.event_id, o.subject_id, o.itemid, o.us, o.valuenum, s.stay_id FROM obs o LEFT JOIN stays s ON s.hadm_id = o.hadm_id),
""" + _temporal_sql(fx.PROFILE_LABS, "linked", 3600e6, "quantile_cont(gap, 0.5) AS median") + """
SELECT i.itemid, canonical_name, coalesce(n_observations, 0) AS n_observations, coalesce(n_patients, 0) AS n_patients,
  coalesce(n_stays, 0) AS n_stays, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max,
  round(median, 6) AS median, obs_per_stay_median,
  round(coalesce(n_stays, 0) * 100e0 / (SELECT count(*) FROM stays), 6) AS coverage_pct
FROM items i LEFT JOIN cnt USING (itemid) LEFT JOIN g USING (itemid) LEFT JOIN med USING (itemid)""")
def lab_profile_by_stay(spark, d):
    stays = tm.stays(spark, d)
    linked = pf.labs_with_stays(tm.observations(spark, d), stays)
    out = pf.temporal_profile(linked, pf.registry(spark, fx.PROFILE_LABS), stays.count(), 3600.0, {"median": 0.5})
    return r6(out, "mean", "std", "min", "max", "median", "coverage_pct")


@query("lab_missingness_by_stay", _OBS + """,
linked AS (SELECT o.subject_id, o.itemid, o.valuenum, s.stay_id FROM obs o LEFT JOIN stays s ON s.hadm_id = o.hadm_id),
""" + _items_sql(fx.PROFILE_LABS) + """,
c AS (SELECT itemid, count(*) AS n, count(*) - count(valuenum) AS m, count(DISTINCT subject_id) AS p, count(DISTINCT stay_id) AS s,
   avg(valuenum) AS mean, quantile_cont(valuenum, 0.5) AS median, min(valuenum) AS low, max(valuenum) AS high FROM linked GROUP BY itemid),
q AS (SELECT i.itemid, canonical_name, coalesce(n, 0) AS n_observations, coalesce(m, 0) AS n_missing, coalesce(p, 0) AS n_patients,
   coalesce(s, 0) AS n_stays, round(coalesce(m, 0) * 100e0 / greatest(coalesce(n, 0), 1), 2) AS missing_pct,
   round(mean, 6) AS mean, round(median, 6) AS median, round(low, 6) AS min, round(high, 6) AS max FROM items i LEFT JOIN c USING (itemid))
SELECT *, round(n_stays * 100e0 / (SELECT count(*) FROM stays), 6) AS coverage_pct,
  CASE WHEN n_observations = 0 THEN 'ABSENT' WHEN missing_pct < 10 THEN 'LOW' WHEN missing_pct < 30 THEN 'MODERATE'
    WHEN missing_pct < 60 THEN 'HIGH' ELSE 'SEVERE' END AS severity FROM q""")
def lab_missingness_by_stay(spark, d):
    stays = tm.stays(spark, d)
    linked = pf.labs_with_stays(tm.observations(spark, d), stays)
    out = pf.missingness_with_values(linked, pf.registry(spark, fx.PROFILE_LABS), stays.count())
    return r6(out, "mean", "median", "min", "max", "coverage_pct")


@query("labs_linked_to_stays", _OBS + """
SELECT s.stay_id, count(*) AS n FROM obs o LEFT JOIN stays s ON s.hadm_id = o.hadm_id GROUP BY s.stay_id""")
def labs_linked_to_stays(spark, d):
    linked = pf.labs_with_stays(tm.observations(spark, d), tm.stays(spark, d))
    return linked.groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"))


def _metrics(pairs: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, ({e})::DOUBLE AS value FROM {source}" for m, e in pairs.items())


@query("population", with_sql("ev", "stays", "patients", "admissions") + ", st AS (SELECT *, (out_us - in_us) / 3600e6 AS h FROM stays), m AS (" + " UNION ALL ".join([
    _metrics({"n_patients": "count(DISTINCT subject_id)", "age_min": "min(anchor_age)", "age_max": "max(anchor_age)",
              "age_mean": "avg(anchor_age)", "age_std": "stddev_samp(anchor_age)",
              "age_median": "quantile_cont(anchor_age, 0.5)"}, "patients"),
    _metrics({"n_icu_stays": "count(DISTINCT stay_id)", "icu_los_min_hours": "min(h)", "icu_los_max_hours": "max(h)",
              "icu_los_mean_hours": "avg(h)", "icu_los_std_hours": "stddev_samp(h)",
              "icu_los_p25_hours": "quantile_cont(h, 0.25)", "icu_los_median_hours": "quantile_cont(h, 0.5)",
              "icu_los_p75_hours": "quantile_cont(h, 0.75)"}, "st"),
    _metrics({"n_admissions": "count(DISTINCT hadm_id)", "n_hospital_deaths": "count(deathtime)",
              "hospital_mortality_rate": "count(deathtime) / count(*)::DOUBLE"}, "admissions"),
    "SELECT 'sex_' || gender, count(*)::DOUBLE FROM patients GROUP BY gender",
    "SELECT 'care_unit_' || replace(first_careunit, ' ', '_'), count(*)::DOUBLE FROM stays GROUP BY first_careunit",
]) + ") SELECT metric, round(value, 6) AS value FROM m")
def population(spark, d):
    return r6(pf.population(tm.patients(spark, d), tm.admissions(spark, d), tm.stays(spark, d)), "value")


@query("outcome_counts", with_sql("ev", "stays", "admissions", "infusions") + """
, n AS (SELECT count(*) AS c FROM stays),
o AS (SELECT 'hospital_mortality' AS outcome, count(deathtime) AS n_positive, count(*) AS n_total FROM admissions
UNION ALL SELECT 'icu_mortality', count(*), (SELECT c FROM n) FROM stays s JOIN admissions a USING (hadm_id)
  WHERE deathtime BETWEEN intime AND outtime
UNION ALL SELECT 'vasopressor_initiation', count(DISTINCT stay_id), (SELECT c FROM n) FROM infusions WHERE itemid IN (0, 8)
UNION ALL SELECT 'mechanical_ventilation', count(DISTINCT stay_id), (SELECT c FROM n) FROM infusions WHERE itemid = 5)
SELECT *, round(n_positive / greatest(n_total, 1)::DOUBLE, 6) AS rate FROM o""")
def outcome_counts(spark, d):
    inf = tm.infusions(spark, d)
    return r6(pf.outcome_counts(tm.stays(spark, d), tm.admissions(spark, d), inf, inf, [0, 8], [5]), "rate")


@query("deaths_in_stay", with_sql("ev", "stays", "admissions") + """
SELECT stay_id, deathtime FROM stays s JOIN admissions a USING (hadm_id) WHERE deathtime BETWEEN intime AND outtime""")
def deaths_in_stay(spark, d):
    return tm.export(pf.deaths_in_stay(tm.stays(spark, d), tm.admissions(spark, d)).select("stay_id", "deathtime"))


@query("variable_mapping", "WITH " + _items_sql({**{i: f"part_{i}" for i in (0, 1, 2, 77)}, 10**9: "nowhere"}) + """
SELECT itemid, canonical_name, CASE WHEN p_partkey IS NULL THEN 'NOT_IN_D_ITEMS' ELSE 'CONFIRMED_IN_D_ITEMS' END AS status,
  p_name AS label, p_brand AS unit, p_type AS category FROM items LEFT JOIN part ON p_partkey = itemid""")
def variable_mapping(spark, d):
    items = pf.registry(spark, {**{i: f"part_{i}" for i in (0, 1, 2, 77)}, 10**9: "nowhere"})
    p = tm.load(spark, d, "part").select(
        F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"),
        F.col("p_brand").alias("unitname"), F.col("p_type").alias("category"))
    return pf.variable_mapping(items, p)


@query("window_estimates", _OBS + f""",
g AS (SELECT ((out_us - in_us) // {STEP}000000) + 1 AS n FROM stays WHERE (out_us - in_us) >= 6 * 3600000000
  AND stay_id IN (SELECT stay_id FROM obs WHERE itemid IN ({', '.join(map(str, fx.VITAL_ITEMS))}))),
e AS (SELECT count(*) AS eligible_stays, sum(n)::BIGINT AS grid_steps, {', '.join(
    f'sum(greatest(0, n - 24 - {h}))::BIGINT AS windows_{h}' for h in (4, 12, 24))} FROM g)
SELECT *, windows_4 >= 200 AS feasible_4, windows_12 >= 150 AS feasible_12, windows_24 >= 100 AS feasible_24 FROM e""")
def window_estimates(spark, d):
    named = name_items(tm.observations(spark, d), fx.VITAL_ITEMS)
    return pf.window_estimates(tm.stays(spark, d), named, STEP)


_MISS = ["heart_rate", "spo2", "respiratory_rate", "sbp", "temperature_c"]


@query("grid_missingness", _OBS + "," + NAMED_SQL + f"""
, g AS (SELECT sum(((out_us - in_us) // {STEP}000000) + 1) AS n FROM stays WHERE (out_us - in_us) >= 6 * 3600000000
  AND stay_id IN (SELECT stay_id FROM named WHERE itemid IN ({', '.join(map(str, fx.VITAL_ITEMS))})))
SELECT c AS channel, round((1 - (SELECT count(*) FROM named WHERE channel = c) / (SELECT n FROM g)::DOUBLE) * 100, 6) AS missing_pct
FROM (SELECT unnest({tm._sql_list(_MISS)}) AS c)""")
def grid_missingness(spark, d):
    named = name_items(tm.observations(spark, d), fx.VITAL_ITEMS)
    return r6(pf.grid_missingness(named, tm.stays(spark, d), STEP, _MISS), "missing_pct")


@query("point_deterioration_rate", ALIGNED + f"""
, u AS (SELECT stay_id, {', '.join(f'last_value({c} IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS {c}' for c in ('spo2', 'map', 'respiratory_rate'))} FROM raw)
SELECT count(*) AS ticks, count(*) FILTER (WHERE coalesce(spo2 < 90, false) OR coalesce(map < 65, false) OR coalesce(respiratory_rate > 28, false)) AS positive,
 round(count(*) FILTER (WHERE coalesce(spo2 < 90, false) OR coalesce(map < 65, false) OR coalesce(respiratory_rate > 28, false)) * 100e0 / count(*), 6) AS positive_pct FROM u""")
def point_deterioration_rate(spark, d):
    t = fill_forever(timeline(spark, d, stored=True), ["spo2", "map", "respiratory_rate"])
    hit = F.coalesce(F.col("ffill_spo2") < 90, F.lit(False)) | F.coalesce(F.col("ffill_map") < 65, F.lit(False)) | \
        F.coalesce(F.col("ffill_respiratory_rate") > 28, F.lit(False))
    out = t.rows().agg(F.count(F.lit(1)).alias("ticks"), F.count_if(hit).alias("positive"))
    return r6(out.withColumn("positive_pct", F.col("positive") * 100.0 / F.col("ticks")), "positive_pct")


# ---- inventory -------------------------------------------------------------------------------

# The supplied tables' columns with Spark's types.
_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _columns_sql() -> str:
    parts = []
    for table, columns in _COLUMNS.items():
        for c, kind in (x.split(" ") for x in columns.split(", ")):
            rng = (f"strftime(min({c}), '%Y-%m-%d %H:%M:%S'), strftime(max({c}), '%Y-%m-%d %H:%M:%S')" if "date" in c
                   else "NULL::VARCHAR, NULL::VARCHAR")
            parts.append(f"SELECT '{table}', count(*), '{c}', '{kind}', count(*) - count({c}), {rng}, "
                         f"round((count(*) - count({c})) * 100e0 / greatest(count(*), 1), 2) FROM {table}")
    return ("SELECT * FROM (" + " UNION ALL ".join(parts)
            + ") t(table_name, row_count, column_name, data_type, null_count, min_time, max_time, null_pct)")


@query("column_inventory", _columns_sql())
def column_inventory(spark, d):
    return reduce(lambda a, b: a.unionByName(b), [pf.column_inventory(tm.load(spark, d, t), t) for t in _COLUMNS])


#: Columns that stand for the subject, admission and stay ids of a table.
_KEYS = {"events": {"user_id": "subject_id", "event_id": "stay_id"}, "orders": {"o_custkey": "subject_id", "o_orderkey": "hadm_id"},
         "customer": {"c_custkey": "subject_id"}, "lineitem": {"l_orderkey": "hadm_id", "l_partkey": "stay_id"},
         "documents": {"source": "subject_id", "doc_id": "stay_id"}, "labels": {"doc_id": "stay_id"}, "conversations": {"conv_id": "subject_id"}}


def _keys_sql() -> str:
    parts = []
    for table, columns in _COLUMNS.items():
        by = {k: c for c, k in _KEYS.get(table, {}).items()}
        counts = ", ".join(f"count(DISTINCT {by[k]})" if k in by else "0::BIGINT" for k in ("subject_id", "hadm_id", "stay_id"))
        parts.append(f"SELECT '{table}', count(*), {len(columns.split(', '))}, {counts} FROM {table}")
    return ("SELECT * FROM (" + " UNION ALL ".join(parts)
            + ") t(table_name, row_count, column_count, unique_subject_id, unique_hadm_id, unique_stay_id)")


@query("key_inventory", _keys_sql())
def key_inventory(spark, d):
    return reduce(lambda a, b: a.unionByName(b), [
        pf.key_inventory(tm.load(spark, d, t).withColumnsRenamed(_KEYS.get(t, {})), t) for t in _COLUMNS])
