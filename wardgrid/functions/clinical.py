"""Clinical formulas and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.rules import at_least_bands, below_bands, case, clip, upper_bands


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def to_celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32.0) * 5.0 / 9.0


def shock_index(hr: Column, sbp: Column) -> Column:
    """HR / SBP, NULL when SBP is 0."""
    return hr / F.nullif(sbp, F.lit(0.0))


def live_shock_index(hr: Column, sbp: Column) -> Column:
    """The live-frame variant: 0 when SBP is not positive."""
    return F.when(sbp > 0, hr / sbp).otherwise(0.0)


def mean_arterial_pressure(sbp: Column, dbp: Column) -> Column:
    return dbp + (sbp - dbp) / 3.0


def pulse_pressure(sbp: Column, dbp: Column) -> Column:
    return sbp - dbp


def instability(hr="heart_rate", spo2="spo2", sbp="sbp", rr="respiratory_rate", map_="map") -> Column:
    """Instability index in [0, 1]; a missing vital counts as normal."""
    hr = F.coalesce(_c(hr), F.lit(75.0))
    spo2 = F.coalesce(_c(spo2), F.lit(98.0))
    sbp = F.coalesce(_c(sbp), F.lit(120.0))
    rr = F.coalesce(_c(rr), F.lit(16.0))
    bp = F.coalesce(_c(map_), F.lit(85.0))
    oxygen = below_bands(spo2, [(88.0, 0.35), (92.0, 0.20), (95.0, 0.10)], 0.0)
    pressure = case([
        ((bp < 60.0) | (sbp < 85.0), 0.30),
        ((bp < 65.0) | (sbp < 90.0), 0.20),
        (bp < 70.0, 0.10),
    ], 0.0)
    breathing = case([((rr > 30.0) | (rr < 8.0), 0.25), (rr > 24.0, 0.15), (rr > 20.0, 0.05)], 0.0)
    heart = case([((hr > 130.0) | (hr < 40.0), 0.20), ((hr > 110.0) | (hr < 50.0), 0.10)], 0.0)
    return F.least(F.lit(1.0), oxygen + pressure + breathing + heart)


def abnormal_step() -> Column:
    """A tick with hypoxaemia, hypotension, tachypnoea or an unstable heart rate."""
    signs = [
        F.col("spo2") < 90.0,
        F.col("map") < 65.0,
        F.col("sbp") < 90.0,
        F.col("respiratory_rate") > 28.0,
        F.col("heart_rate") < 45.0,
        F.col("heart_rate") > 130.0,
    ]
    any_sign = F.lit(False)
    for sign in signs:
        any_sign = any_sign | F.coalesce(sign, F.lit(False))
    return any_sign


def risk_tier(abnormal_steps: Column, mild_sign: Column) -> Column:
    return case([(abnormal_steps >= 2, 2), ((abnormal_steps == 1) | mild_sign, 1)], 0)


def _news2_gap_free() -> dict[str, Column]:
    return {
        name: upper_bands(F.coalesce(F.col(name), F.lit(fx.LIVE_BASELINE[name])), bands)
        for name, bands in fx.NEWS2_BOUNDS.items()
    }


def _news2_integer_bands() -> dict[str, Column]:
    """Bands written for whole numbers: fractions between two bands score 0."""
    v = {n: F.coalesce(F.col(n), F.lit(fx.LIVE_BASELINE[n])) for n in fx.NEWS2_BOUNDS}
    rr, spo2, sbp = v["respiratory_rate"], v["spo2"], v["systolic_bp"]
    hr, temp = v["heart_rate"], v["body_temperature"]
    return {
        "respiratory_rate": case(
            [((rr <= 8) | (rr >= 25), 3), (rr.between(21, 24), 2), (rr.between(9, 11), 1)], 0),
        "spo2": case([(spo2 <= 91, 3), (spo2.between(92, 93), 2), (spo2.between(94, 95), 1)], 0),
        "systolic_bp": case(
            [((sbp <= 90) | (sbp >= 220), 3), (sbp.between(91, 100), 2), (sbp.between(101, 110), 1)], 0),
        "heart_rate": case(
            [((hr <= 40) | (hr >= 131), 3), (hr.between(111, 130), 2),
             (hr.between(41, 50) | hr.between(91, 110), 1)], 0),
        "body_temperature": case(
            [(temp <= 35.0, 3), (temp >= 39.1, 2),
             (temp.between(35.1, 36.0) | temp.between(38.1, 39.0), 1)], 0),
    }


def news2(mode: str = "gap_free") -> Column:
    """Early-warning score struct from live-vitals columns: sub-scores, total, tier, advice."""
    parts = _news2_integer_bands() if mode == "banded" else _news2_gap_free()
    total = sum((parts[n] for n in fx.NEWS2_BOUNDS), F.lit(0))
    red = F.lit(False)
    for name in ("respiratory_rate", "spo2", "systolic_bp", "heart_rate"):
        red = red | (parts[name] == 3)
    tier = case([((total >= 7) | red, "High"), (total >= 5, "Medium")], "Low")
    advice = case([(tier == name, text) for name, text in fx.NEWS2_ADVICE.items()])
    return F.struct(
        total.cast("int").alias("total_score"),
        tier.alias("risk_tier"),
        parts["respiratory_rate"].cast("int").alias("respiratory_rate_score"),
        parts["spo2"].cast("int").alias("spo2_score"),
        parts["systolic_bp"].cast("int").alias("systolic_bp_score"),
        parts["heart_rate"].cast("int").alias("heart_rate_score"),
        parts["body_temperature"].cast("int").alias("temperature_score"),
        advice.alias("clinical_recommendation"),
    )


def _bedside_vitals() -> tuple[Column, Column, Column, Column]:
    return (
        F.coalesce(F.col("heart_rate"), F.lit(75.0)),
        F.coalesce(F.col("spo2"), F.lit(98.0)),
        F.coalesce(F.col("sbp"), F.lit(120.0)),
        F.coalesce(F.col("respiratory_rate"), F.lit(16.0)),
    )


def bedside_points() -> Column:
    """Bedside instability, 0 to 100."""
    hr, spo2, sbp, rr = _bedside_vitals()
    points = (
        case([(hr >= 130.0, 30.0), (hr >= 110.0, 18.0), (hr < 45.0, 20.0)], 0.0)
        + case([(spo2 <= 88.0, 35.0), (spo2 <= 92.0, 22.0), (spo2 < 95.0, 10.0)], 0.0)
        + case([(sbp <= 85.0, 30.0), (sbp <= 95.0, 18.0)], 0.0)
        + case([(rr >= 28.0, 25.0), (rr >= 22.0, 14.0)], 0.0)
    )
    return F.least(points, F.lit(100.0))


def bedside_factors() -> Column:
    """The active risk factors as text, in the order heart, oxygen, pressure, breathing."""
    hr, spo2, sbp, rr = _bedside_vitals()

    def text(label: str, unit: str, value: Column, fmt: str) -> Column:
        return F.format_string(f"{label}: {fmt}{unit})", value)

    heart = case([
        (hr >= 130.0, text("Severe Tachycardia (HR", " bpm", hr, "%.0f")),
        (hr >= 110.0, text("Moderate Tachycardia (HR", " bpm", hr, "%.0f")),
        (hr < 45.0, text("Bradycardia (HR", " bpm", hr, "%.0f")),
    ])
    oxygen = case([
        (spo2 <= 88.0, text("Severe Hypoxemia (SpO2", "%%", spo2, "%.1f")),
        (spo2 <= 92.0, text("Moderate Hypoxemia (SpO2", "%%", spo2, "%.1f")),
        (spo2 < 95.0, text("Mild Desaturation (SpO2", "%%", spo2, "%.1f")),
    ])
    pressure = case([
        (sbp <= 85.0, text("Severe Hypotension / Shock (SBP", " mmHg", sbp, "%.0f")),
        (sbp <= 95.0, text("Moderate Hypotension (SBP", " mmHg", sbp, "%.0f")),
    ])
    breathing = case([
        (rr >= 28.0, text("Severe Tachypnea (RR", " bpm", rr, "%.0f")),
        (rr >= 22.0, text("Elevated Respiratory Rate (RR", " bpm", rr, "%.0f")),
    ])
    return F.array_compact(F.array(heart, oxygen, pressure, breathing))


def bedside_deviation() -> Column:
    """Deviation vector [HR, SpO2, SBP, RR], each clipped to [-3, 5]."""
    hr, spo2, sbp, rr = _bedside_vitals()
    parts = [(hr - 75.0) / 25.0, (98.0 - spo2) / 8.0, (115.0 - sbp) / 25.0, (rr - 16.0) / 6.0]
    return F.array(*[clip(p, -3.0, 5.0) for p in parts])


def visual_risk(finding: Column, probability: Column, mean_activation: Column) -> Column:
    """Pathology part of the fusion score; without a finding, from the mean |activation|."""
    usable = probability.isNotNull() & (F.coalesce(finding, F.lit("")) != "") & (finding != "No Finding")
    return F.when(usable, probability * 100.0).otherwise(clip(mean_activation * 120.0, 5.0, 75.0))


def fusion(model_probability: Column, points: Column, visual: Column) -> Column:
    """Late-fusion risk struct. Contributions use the model share 0.25, the score 0.45."""
    combined = model_probability * 100.0 * 0.45 + points * 0.35 + visual * 0.20
    score = F.round(clip(combined, 0.0, 100.0), 1)
    vitals_share = F.when(
        combined > 1e-6,
        F.round((model_probability * 100.0 * 0.25 + points * 0.35) / combined * 100.0, 1),
    ).otherwise(50.0)
    tier = fusion_tier(score)
    return F.struct(
        score.alias("risk_score"),
        tier.alias("risk_tier"),
        F.round(100.0 - vitals_share, 1).alias("visual_contribution"),
        vitals_share.alias("vitals_contribution"),
        case([(tier == n, t) for n, t in fx.FUSION_ADVICE.items()]).alias("recommendation"),
    )


def fusion_tier(score: Column) -> Column:
    return at_least_bands(score, [(75.0, "Critical"), (50.0, "High"), (25.0, "Moderate")], "Low")


def vital_status(kind: str, value: Column) -> Column:
    """Bedside label of one vital."""
    rules = {
        "heart_rate": ([(value >= 130, "CRITICAL HIGH"), (value >= 100, "TACHYCARDIA"),
                        (value < 50, "BRADYCARDIA")], "NORMAL"),
        "spo2": ([(value <= 88, "SEVERE HYPOXIA"), (value < 92, "DESATURATION")], "OPTIMAL"),
        "sbp": ([(value <= 85, "SHOCK / HYPOTENSION"), (value < 95, "BORDERLINE LOW"),
                 (value > 160, "HYPERTENSIVE")], "NORMOTENSIVE"),
        "respiratory_rate": ([(value >= 28, "TACHYPNEA CRITICAL"), (value >= 22, "ELEVATED RR")],
                             "NORMAL"),
    }[kind]
    return F.when(value.isNotNull(), case(*rules))


def finding_severity(probability: Column, threshold: Column) -> Column:
    return case([
        (probability < threshold, "none"),
        (probability < 0.65, "mild"),
        (probability < 0.85, "moderate"),
    ], "severe")


def horizon_risk(one: Column, three: Column, six: Column) -> Column:
    return F.round(0.5 * one + 0.3 * three + 0.2 * six, 4)


def shock_label(hr: Column, sbp: Column, spo2: Column, temp: Column) -> Column:
    """Heuristic risk 0.85 / 0.15 with its tier."""
    shock = ((hr > 110) & (sbp < 95)) | (spo2 < 90) | (temp > 38.8)
    risk = F.when(F.coalesce(shock, F.lit(False)), 0.85).otherwise(0.15)
    return F.struct(risk.alias("risk"), case([(risk > 0.65, 2), (risk > 0.35, 1)], 0).alias("tier"))


def min_max(value: Column, low: float, high: float) -> Column:
    return (value - low) / (high - low + 1e-6)


def from_min_max(value: Column, low: float, high: float) -> Column:
    return value * (high - low) + low


def _half_up(value: Column) -> Column:
    """Round half towards +infinity."""
    return F.floor(value + 0.5).cast("double")


def what_if_base() -> Column:
    """Starting risk of the what-if projection, from heart_rate, spo2, sbp, respiratory_rate."""
    spo2, hr = F.col("spo2"), F.col("heart_rate")
    sbp, rr = F.col("sbp"), F.col("respiratory_rate")
    raw = (
        F.lit(15.0)
        + below_bands(spo2, [(85, 45.0), (90, 32.0), (93, 18.0), (95, 8.0)], 0.0)
        + case([(hr > 140, 30.0), (hr > 120, 20.0), (hr > 100, 10.0), (hr < 50, 25.0)], 0.0)
        + case([(sbp < 80, 35.0), (sbp < 90, 22.0), (sbp < 100, 12.0), (sbp > 180, 18.0)], 0.0)
        + case([(rr > 32, 32.0), (rr > 26, 20.0), (rr > 20, 10.0), (rr < 10, 25.0)], 0.0)
    )
    return clip(_half_up(raw), 5.0, 98.0)


def what_if_risk(base: Column, hours: Column, effect: Column) -> Column:
    """Risk at a horizon of 0, 1, 3 or 6 hours after applying an intervention effect (<= 0)."""
    slope = case([(base > 55, 1.18), (base > 35, 1.08)], 0.96) - 1.0
    growth = case([(hours == 1, 0.45), (hours == 3, 1.15), (hours == 6, 1.95)], 0.0)
    onset = case([(hours == 0, 0.0), (hours == 1, 0.6), (hours == 3, 0.9)], 1.0)
    drifted = _half_up(base * (1.0 + slope * growth))
    treated = F.when(effect != 0, _half_up(drifted + effect * onset)).otherwise(drifted)
    return clip(treated, 4.0, 99.0)


def what_if_tier(score: Column) -> Column:
    return at_least_bands(score, [(70, "Critical"), (45, "High"), (25, "Moderate")], "Low")


def intervention_effect(niv: Column, vasopressor: Column, sedation: Column) -> Column:
    return (
        F.when(niv, -22.0).otherwise(0.0)
        + F.when(vasopressor, -18.0).otherwise(0.0)
        + F.when(sedation, -12.0).otherwise(0.0)
    )


def image_gate() -> Column:
    """First failing check over per-image statistics, or 'Valid chest radiograph.'

    Columns: width, height, chroma, std_dev, white_fraction, black_fraction, edge_magnitude.
    """
    aspect = F.col("width") / F.col("height")
    return case([
        ((F.col("width") < 32) | (F.col("height") < 32), "too small"),
        ((aspect < 0.45) | (aspect > 2.2), "implausible aspect ratio"),
        (F.col("chroma") > 15.0, "colour saturation"),
        (F.col("std_dev") < 15.0, "flat or blank"),
        (F.col("white_fraction") > 0.70, "white background"),
        (F.col("black_fraction") > 0.85, "black background"),
        (F.col("edge_magnitude") < 0.5, "edge density too low"),
        (F.col("edge_magnitude") > 65.0, "edge density too high"),
    ], "Valid chest radiograph.")
