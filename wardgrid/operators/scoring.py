"""Patient-level scoring tables: latest state, ward views, findings, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.functions import clinical as cl
from wardgrid.functions import fixed_values as fx
from wardgrid.functions.rules import case, clip, contains_any, first_range_violation


# ---- validation --------------------------------------------------------------------------

def with_violation(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = fx.INTAKE_CONTRACT,
                   optional: Sequence[str] = ("age",)) -> DataFrame:
    """Add `reject_reason`: the first broken range in rule order, or NULL for accepted rows."""
    return df.withColumn("reject_reason", first_range_violation(bounds, optional))


def split_by_contract(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = fx.FRAME_CONTRACT,
                      optional: Sequence[str] = ("diastolic_bp",)) -> tuple[DataFrame, DataFrame]:
    checked = with_violation(df, bounds, optional)
    return checked.where("reject_reason IS NULL").drop("reject_reason"), checked.where("reject_reason IS NOT NULL")


# ---- latest readings -----------------------------------------------------------------------

def latest_per_patient(frames: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The newest frame of each patient; partial maxima are combined before the shuffle."""
    newest = frames.groupBy("patient_id").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_f"))
    return newest.select("patient_id", "_f.*")


def last_readings(frames: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last n frames of each patient with their chronological position.

    The row_number filter becomes a per-partition group limit before the shuffle, so a patient
    with very many frames sends at most n rows per input partition.
    """
    newest_first = Window.partitionBy("patient_id").orderBy(*[F.desc(c) for c in order])
    kept = frames.withColumn("_back", F.row_number().over(newest_first)).where(F.col("_back") <= n)
    oldest_first = Window.partitionBy("patient_id").orderBy(F.desc("_back"))
    return kept.withColumn("position", F.row_number().over(oldest_first)).drop("_back")


def derived_vitals(frames: DataFrame) -> DataFrame:
    return frames.withColumns({
        "mean_arterial_pressure": cl.mean_arterial_pressure(F.col("systolic_bp"), F.col("diastolic_bp")),
        "pulse_pressure": cl.pulse_pressure(F.col("systolic_bp"), F.col("diastolic_bp")),
        "shock_index": cl.live_shock_index(F.col("heart_rate"), F.col("systolic_bp")),
    })


def vital_ranges(frames: DataFrame, columns: Sequence[str], hours: float = 24.0) -> DataFrame:
    """Minimum and maximum of each vital over the last hours before a patient's newest frame."""
    newest = frames.groupBy("patient_id").agg(F.max("ts").alias("_newest"))
    recent = frames.join(newest, "patient_id").where(
        F.unix_micros("ts") >= F.unix_micros("_newest") - int(hours * 3.6e9))
    return recent.groupBy("patient_id").agg(
        *[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns])


def ward_summary(patients: DataFrame, latest: DataFrame, risk: DataFrame) -> DataFrame:
    """Each patient with latest vitals, early-warning score and risk; missing parts stay NULL."""
    scored = latest.withColumn("_news2", cl.news2())
    return (
        patients.join(scored, "patient_id", "left").join(risk, "patient_id", "left")
        .withColumns({"news2_score": F.col("_news2.total_score"), "news2_tier": F.col("_news2.risk_tier")})
        .drop("_news2")
    )


def baseline_deviations(baseline: Mapping[str, float] | None = None) -> Column:
    values = baseline or {k: fx.LIVE_BASELINE[k] for k in fx.LIVE_VITALS}
    return F.struct(*[F.round(F.coalesce(F.col(c), F.lit(0.0)) - b, 2).alias(c) for c, b in values.items()])


def patient_state(summary: DataFrame, risk_columns: Sequence[str] = ("risk_1h", "risk_3h", "risk_6h")) -> DataFrame:
    """Four partitions per patient: observed, derived, predicted and simulation state.

    Needs the ward summary columns plus `active_anomalies` (array) and `overrides` (map).
    """
    derived = derived_vitals(summary)
    vitals = F.struct(*fx.LIVE_VITALS, "diastolic_bp")
    one, three, six = (F.col(c) for c in risk_columns)
    return derived.select(
        "patient_id",
        F.struct("name", "unit", F.col("ts").alias("latest_timestamp"), vitals.alias("current_vitals"))
        .alias("observed_state"),
        F.struct("mean_arterial_pressure", "shock_index", cl.news2().alias("news2"),
                 baseline_deviations().alias("baseline_deviations")).alias("derived_state"),
        F.struct(cl.horizon_risk(one, three, six).alias("health_risk_score"), *risk_columns)
        .alias("predicted_state"),
        F.struct("active_anomalies", "overrides").alias("simulation_state"),
    )


def as_json(state: DataFrame) -> DataFrame:
    parts = ("observed_state", "derived_state", "predicted_state", "simulation_state")
    return state.select("patient_id", *[F.to_json(c).alias(c) for c in parts])


def apply_anomalies(frames: DataFrame, controls: DataFrame) -> DataFrame:
    """Add the offsets of each patient's active anomalies, then clip.

    `controls` has one row per patient with an `anomalies` array; a repeated name counts once.
    """
    joined = frames.join(controls, "patient_id", "left")
    active = F.array_distinct(F.coalesce("anomalies", F.expr("array()").cast("array<string>")))
    shifted = {}
    for c, (low, high) in fx.LIVE_BOUNDS.items():
        value = F.col(c)
        for kind, offsets in fx.ANOMALY_OFFSETS.items():
            if c in offsets:
                value = value + F.when(F.array_contains(active, kind), offsets[c]).otherwise(0.0)
        shifted[c] = clip(value, low, high)
    out = joined.withColumns(shifted)
    return out.withColumn("is_anomaly_active", F.size(active) > 0).drop("anomalies")


def apply_overrides(latest: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace vitals by the given values where present, then recompute the derived ones."""
    names = [c for c in latest.columns if f"set_{c}" in overrides.columns]
    joined = latest.join(overrides, "patient_id", "left")
    joined = joined.withColumns({c: F.coalesce(F.col(f"set_{c}"), F.col(c)) for c in names})
    return derived_vitals(joined.drop(*[f"set_{c}" for c in names]))


# ---- findings ------------------------------------------------------------------------------

def finding_list(probabilities: Column, thresholds: Mapping[str, float] = fx.FINDING_THRESHOLDS) -> Column:
    """Findings of a map column with threshold, flag and severity, most probable first."""
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])

    def finding(entry: Column) -> Column:
        threshold = F.coalesce(F.element_at(limit, entry["key"]), F.lit(0.5))
        return F.struct(
            F.negative(entry["value"]).alias("_rank"), entry["key"].alias("name"),
            entry["value"].alias("probability"), threshold.alias("threshold"),
            (entry["value"] >= threshold).alias("is_positive"),
            cl.finding_severity(entry["value"], threshold).alias("severity"))

    ordered = F.array_sort(F.transform(F.map_entries(probabilities), finding))
    return F.transform(ordered, lambda f: F.struct(
        f["name"].alias("name"), f["probability"].alias("probability"), f["threshold"].alias("threshold"),
        f["is_positive"].alias("is_positive"), f["severity"].alias("severity")))


def predictions(probabilities: Column, thresholds: Mapping[str, float] = fx.FINDING_THRESHOLDS) -> Column:
    """map<finding, bool> for every known finding; a missing probability counts as 0."""
    return F.create_map(*[
        x for name, limit in thresholds.items()
        for x in (F.lit(name), F.coalesce(F.element_at(probabilities, name), F.lit(0.0)) >= limit)])


def top_finding(probabilities: Column, thresholds: Mapping[str, float] = fx.FINDING_THRESHOLDS) -> Column:
    """Most probable pathology, or 'No Finding' when no pathology reaches its threshold."""
    diseases = F.map_filter(probabilities, lambda k, v: k != "No Finding")
    best = F.array_max(F.transform(F.map_entries(diseases), lambda e: F.struct(
        e["value"].alias("probability"), e["key"].alias("name"))))
    flags = predictions(probabilities, thresholds)
    hit = F.exists(F.map_entries(flags), lambda e: e["value"] & (e["key"] != "No Finding"))
    none = F.struct(F.coalesce(F.element_at(probabilities, "No Finding"), F.lit(0.5)).alias("probability"),
                    F.lit("No Finding").alias("name"))
    chosen = F.when(hit, best).otherwise(none)
    return F.struct(chosen["name"].alias("top_finding"), chosen["probability"].alias("top_probability"),
                    hit.alias("has_pathology"))


def positive_findings(labels: Mapping[str, str]) -> Column:
    """Names of the flag columns that equal 1, in the given order."""
    return F.array_compact(F.array(*[F.when(F.col(c) == 1.0, name) for name, c in labels.items()]))


# ---- studies -------------------------------------------------------------------------------

def studies_of(studies: DataFrame, patient_id, order: str = "study_id") -> DataFrame:
    return studies.where(F.col("patient_id") == F.lit(patient_id)).orderBy(order)


def ownership(requests: DataFrame, studies: DataFrame) -> DataFrame:
    """Check that a requested study exists and belongs to the requesting patient."""
    owner = studies.select("study_id", F.col("patient_id").alias("owner_id"))
    status = case([
        (F.col("owner_id").isNull(), "STUDY_NOT_FOUND"),
        (F.col("owner_id") != F.col("patient_id"), "PATIENT_MISMATCH"),
    ], "OK")
    return requests.join(owner, "study_id", "left").withColumn("status", status)


def consecutive_studies(studies: DataFrame, values: Sequence[str], seq: str = "seq") -> DataFrame:
    """Each study with the one before it: an equi-join on (patient, position), even under skew."""
    before = studies.select("patient_id", (F.col(seq) + 1).alias(seq), *[F.col(v).alias(f"pre_{v}") for v in values])
    return studies.join(before, ["patient_id", seq]).withColumnsRenamed({v: f"post_{v}" for v in values})


def with_risk_change(pairs: DataFrame, value: str = "risk") -> DataFrame:
    pre, post = F.col(f"pre_{value}"), F.col(f"post_{value}")
    return pairs.withColumns({
        "risk_delta": post - pre, "risk_change_pct": F.when(pre > 0, (post - pre) / pre * 100.0).otherwise(0.0)})


def finding_improved(name: str | Column, delta_points: Column) -> Column:
    """Improved: a pathology fell by more than 5 points, or No Finding rose."""
    label = F.lit(name) if isinstance(name, str) else name
    return F.when(label == "No Finding", delta_points > 0).otherwise(delta_points < -5)


# ---- ward views ----------------------------------------------------------------------------

def what_if(frames: DataFrame, ids: Sequence[str], effect: Column) -> DataFrame:
    """Risk at 0, 1, 3 and 6 hours, with and without interventions, and its tier."""
    rows = frames.withColumns({"base_risk": cl.what_if_base(), "effect": effect})
    rows = rows.withColumn("hours", F.explode(F.array(*[F.lit(h) for h in (0, 1, 3, 6)])))
    plain = F.when(F.col("hours") == 0, F.col("base_risk")).otherwise(
        cl.what_if_risk(F.col("base_risk"), F.col("hours"), F.lit(0.0)))
    out = rows.withColumns({
        "unmanaged_risk": plain,
        "counterfactual_risk": cl.what_if_risk(F.col("base_risk"), F.col("hours"), F.col("effect")),
    })
    return out.select(*ids, "hours", "unmanaged_risk", "counterfactual_risk",
                      cl.what_if_tier(F.col("unmanaged_risk")).alias("tier"))


def search_archive(records: DataFrame, term: str, disposition: str = "ALL",
                   columns: Sequence[str] = ("id", "name", "primary_diagnosis", "mrn")) -> DataFrame:
    hit = contains_any(term, columns)
    if disposition != "ALL":
        hit = hit & (F.col("disposition") == disposition)
    return records.where(hit)


def alert_feed(alerts: DataFrame, severity: str = "all", term: str = "",
               columns: Sequence[str] = ("patient_name", "bed", "message")) -> DataFrame:
    hit = contains_any(term, columns)
    if severity != "all":
        hit = hit & (F.col("severity") == severity)
    return alerts.where(hit)


def share_counts(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Rows per value and their share in percent."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", F.round(share, digits))


def daily_alerts(alerts: DataFrame, severities: Sequence[str] = ("critical", "warning", "info")) -> DataFrame:
    """Alerts per day and severity, one column each, with their total."""
    out = alerts.groupBy(F.to_date("ts").alias("day")).pivot("severity", list(severities)).agg(
        F.count(F.lit(1))).na.fill(0)
    return out.withColumn("total", sum((F.col(s) for s in severities), F.lit(0)))


def unit_breakdown(beds: DataFrame) -> DataFrame:
    """Per unit: occupied and total beds, average risk and critical patients."""
    return beds.groupBy("unit").agg(
        F.count("patient_id").alias("beds_occupied"), F.count(F.lit(1)).alias("total_beds"),
        F.avg("risk").alias("avg_risk"), F.count_if(F.col("risk") >= 75.0).alias("critical_count"))
