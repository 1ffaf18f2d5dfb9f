"""Sliding-window samples: history matrix, targets, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.operators.scaling import Scaler
from wardgrid.operators.slices import halo_chunks
from wardgrid.operators.targets import is_window, tick_count
from wardgrid.operators.timeline import TICKS, Timeline, tick_time

TARGETS = ["deterioration", "deterioration_mask", "risk_tier", "abnormal_steps", "valid_points",
           "forecast", "forecast_mask", "response", "response_mask", "pre_risk", "post_risk",
           "delta_risk"]


def with_history(t: Timeline, scaler: Scaler, columns: Sequence[str] = tuple(fx.FEATURES), keep: Column | None = None) -> Timeline:
    """Add X: the last `history` ticks of the standardised features, oldest first, as floats.

    The ticks of a chunk become one array, and X a slice of it, which is made only for the ticks that `keep` (all core
    ticks without it); other ticks, the halo's among them, drop out.
    """
    touched = [c for c in t.df.columns if c in fx.CLIP_BOUNDS or c in columns]
    others = [c for c in t.df.columns if c not in touched]
    kept = t.df.selectExpr(*others, *touched, *[f"{c} AS _raw_{c}" for c in touched])
    row = ", ".join(f"CAST({c} AS FLOAT)" for c in columns)
    scaled = scaler.transform(kept, columns).selectExpr(
        *others, *[f"_raw_{c} AS {c}" for c in touched], f"array({row}) AS _row")
    wanted = F.col("core") & (F.lit(True) if keep is None else keep)
    rest = [c for c in t.df.columns if c not in ("stay_id", "chunk", "tick")]
    # what a dropped tick carries is only its row
    ticks = scaled.select("stay_id", "chunk", F.struct(
        "tick", "_row", F.when(F.coalesce(wanted, F.lit(False)), F.struct(*rest)).alias("_rest")).alias("_tick"))
    chunks = ticks.groupBy("stay_id", "chunk").agg(F.sort_array(F.collect_list("_tick")).alias("_ticks"))
    made = chunks.selectExpr("stay_id", "chunk", f"""explode(transform(
        filter(sequence(1, size(_ticks)), i -> _ticks[i - 1]._rest IS NOT NULL),
        i -> struct(_ticks[i - 1].tick AS tick, _ticks[i - 1]._rest AS rest, transform(
            slice(_ticks, greatest(i - {t.spec.history - 1}, 1), least(i, {t.spec.history})), r -> r._row) AS X))) AS w""")
    return t.with_df(made.select("stay_id", "chunk", "w.tick", "w.rest.*", "w.X"))


def history_ticks(t: Timeline, columns: Sequence[str] = tuple(fx.FEATURES), keep: Column | None = None, others: Sequence[Column] = ()) -> DataFrame:
    """The rows that `with_history` puts into X, each once and not yet standardised: all ticks by (stay_id, chunk, tick).

    Partitions hold whole chunks in this order; `_n` numbers the ticks of a chunk from 1, and X of a tick is the last
    `history` rows up to it. `_kept` marks the ticks that have an X, which alone carry `others`.
    """
    wanted = F.coalesce(F.col("core") & (F.lit(True) if keep is None else keep), F.lit(False))
    number = F.row_number().over(Window.partitionBy("stay_id", "chunk").orderBy("tick"))
    names = [t.df.select(o).columns[0] for o in others]
    return t.df.select("stay_id", "chunk", "tick", number.alias("_n"), wanted.alias("_kept"),
                       *[F.when(wanted, o).alias(n) for o, n in zip(others, names, strict=True)], *columns)


def long_enough(t: Timeline) -> Timeline:
    """Only stays that can hold a window: at least history + horizon ticks."""
    return t.with_df(t.df.where(tick_count(t) >= t.spec.history + t.spec.horizon))


def assigned(stays: DataFrame, splits: DataFrame) -> DataFrame:
    """The stays with their `split`, which each tick of their grid then carries; unassigned subjects drop out. Ticks are never joined."""
    return stays.join(splits, "subject_id")


def window_rows(t: Timeline, splits: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """One row per window with its split; stays of unassigned subjects drop out.

    A timeline of `assigned` stays already carries its split: its wide history column then meets no join.
    """
    meta = ["stay_id", "subject_id", "tick"] + (["split"] if splits is None else [])
    rows = t.df.where(F.col("core") & is_window(t)).select(
        *meta, F.col("episode").isNotNull().alias("is_treatment_window"), "episode",
        *TARGETS, *columns)
    rows = rows if splits is None else rows.join(splits, "subject_id")
    return rows.withColumn("prediction_time", tick_time(F.col("tick")))


def validity_report(windows: DataFrame) -> DataFrame:
    """Per split: windows, positives, masks and valid future points."""
    points = F.aggregate(F.flatten("forecast_mask"), F.lit(0.0), lambda a, b: a + b)
    return windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(F.size(F.flatten("forecast_mask"))).alias("future_points"),
        F.sum(points).cast("long").alias("valid_points"),
        F.count_if(points > 0).alias("windows_with_vitals"),
        F.count_if(F.col("deterioration_mask") == 0).alias("windows_without_vitals"),
        F.count_if(F.col("deterioration") == 1).alias("deterioration_positives"),
        F.count_if(F.col("response_mask") == 1).alias("response_windows"),
    )


def target_audit(windows: DataFrame) -> DataFrame:
    """Windows, positives, tier and response histograms per split, subject and stay in one pass."""
    measures = [
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("deterioration") == 1).alias("det_pos"),
        *[F.count_if(F.col("risk_tier") == k).alias(f"tier_{k}") for k in (0, 1, 2)],
        *[F.count_if(F.col("response") == k).alias(f"resp_{k}") for k in (0, 1, 2)],
    ]
    per_stay = windows.groupBy("split", "subject_id", "stay_id").agg(*measures)
    names = [c for c in per_stay.columns if c not in ("split", "subject_id", "stay_id")]
    sets = [[F.col("split")], [F.col("split"), F.col("subject_id")],
            [F.col("split"), F.col("subject_id"), F.col("stay_id")]]
    grouped = per_stay.groupingSets(sets, "split", "subject_id", "stay_id")
    level = F.when(F.grouping("subject_id") == 1, "split").when(
        F.grouping("stay_id") == 1, "subject").otherwise("stay")
    return grouped.agg(level.alias("level"), *[F.sum(c).alias(c) for c in names])


def target_totals(windows: DataFrame) -> DataFrame:
    """Per split and over `all`: windows, positive rate, and subjects and stays with positive, improving or worsening windows.

    Windows collapse to one row per stay first, so the distinct counts run on small data.
    """
    per_stay = windows.groupBy("split", "subject_id", "stay_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("deterioration") == 1).alias("positive"),
        F.count_if(F.col("response") == 1).alias("improving"), F.count_if(F.col("response") == 2).alias("worsening"))

    def with_any(key: str, measure: str) -> Column:
        return F.count_distinct(F.when(F.col(measure) > 0, F.col(key)))

    return per_stay.rollup("split").agg(
        F.when(F.grouping("split") == 1, "all").otherwise(F.first("split")).alias("part"),
        F.sum("n").alias("windows"), F.sum("positive").alias("det_pos"),
        (F.sum("positive") * 100.0 / F.sum("n")).alias("positive_pct"),
        F.count_distinct("subject_id").alias("subjects"), F.count_distinct("stay_id").alias("stays"),
        with_any("subject_id", "positive").alias("subjects_with_positive"),
        with_any("stay_id", "positive").alias("stays_with_positive"),
        with_any("subject_id", "improving").alias("subjects_improving"),
        with_any("subject_id", "worsening").alias("subjects_worsening"),
    ).drop("split").where("windows > 0")


def response_distribution(windows: DataFrame) -> DataFrame:
    """Response classes of treatment windows with their share in percent."""
    counts = windows.where("is_treatment_window").groupBy("response").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", F.round(share, 2))


def event_linked_responses(windows: DataFrame) -> DataFrame:
    """One record per treatment window with its episode and response label."""
    label = F.element_at(F.array(F.lit("Stable"), F.lit("Improving"), F.lit("Worsening")),
                         F.col("response") + 1)
    return windows.where("is_treatment_window").select(
        "subject_id", "stay_id", "prediction_time", "split", "episode.treatment",
        "episode.drug_name", "episode.starttime", "episode.eligible",
        F.col("response").alias("response_code"), label.alias("response_label"))


def strided_windows(numbered: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str],
                    window: int = 24, stride: int = 1, horizon: int = 0, length: int = 4096) -> DataFrame:
    """Windows over consecutive readings: `history` and, with a horizon, `future` row arrays.

    A window ends at position p where p >= window and (p - window) is a multiple of the stride,
    and at least `horizon` later readings exist.
    """
    cut = halo_chunks(numbered, seq, length, window - 1, horizon)
    w = Window.partitionBy(*keys, "chunk").orderBy(seq)
    row = F.struct(*columns)
    cut = cut.withColumn("history", F.collect_list(row).over(w.rowsBetween(-(window - 1), 0)))
    keep = F.col("core") & (F.col(seq) >= window) & ((F.col(seq) - window) % stride == 0)
    if horizon:
        cut = cut.withColumn("future", F.collect_list(row).over(w.rowsBetween(1, horizon)))
        keep = keep & (F.size("future") == horizon)
    return cut.where(keep).drop("core", "chunk")
