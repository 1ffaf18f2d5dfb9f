"""Future targets of each tick, with validity masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.clinical import abnormal_step, instability, risk_tier
from wardgrid.functions.rules import case
from wardgrid.operators.timeline import Timeline, over_ticks


def _ahead(t: Timeline) -> Window:
    return over_ticks().rowsBetween(1, t.spec.horizon)


def _behind(t: Timeline) -> Window:
    return over_ticks().rowsBetween(-(t.spec.horizon - 1), 0)


def tick_index(t: Timeline) -> Column:
    return (F.col("tick") - F.col("first_tick")) / t.spec.step


def tick_count(t: Timeline) -> Column:
    return (F.col("last_tick") - F.col("first_tick")) / t.spec.step + 1


def is_window(t: Timeline) -> Column:
    """Ticks with a full history and a full horizon inside the stay."""
    i, n = tick_index(t), tick_count(t)
    return (i >= t.spec.history - 1) & (i < n - t.spec.horizon)


def observed_only(t: Timeline) -> Timeline:
    """Blank carried-forward values, so that targets use readings taken at their own tick only."""
    return t.with_df(t.df.withColumns({
        c: F.when(F.col(f"mask_{c}") == 1.0, F.col(c)) for c in t.spec.channels}))


def add_forecast(t: Timeline, channels: Sequence[str] = tuple(fx.FORECAST_CHANNELS)) -> Timeline:
    """The next ticks of the forecast channels (missing as 0) and their validity mask."""
    steps = range(1, t.spec.horizon + 1)

    def matrix(cell) -> Column:
        rows = F.array(*[F.array(*[cell(F.col(f"_{c}_{k}")) for c in channels]) for k in steps])
        return F.slice(rows, 1, F.col("_ahead"))        # fewer rows near the end of a stay

    df = t.df.withColumns({"_ahead": F.count(F.lit(1)).over(_ahead(t)).cast("int"), **{
        f"_{c}_{k}": F.lead(c, k).over(over_ticks()) for c in channels for k in steps}})
    df = df.withColumns({
        "forecast": matrix(lambda v: F.coalesce(v, F.lit(0.0))),
        "forecast_mask": matrix(lambda v: v.isNotNull().cast("double")),
    }).drop(*[f"_{c}_{k}" for c in channels for k in steps])
    present = sum((F.col(c).isNotNull().cast("int") for c in channels), F.lit(0))
    df = df.withColumn("valid_points", F.sum(present).over(_ahead(t)))
    return t.with_df(df.drop("_ahead"))


def add_deterioration(t: Timeline) -> Timeline:
    """Persistence rule: two or more abnormal ticks ahead; tier 0, 1 or 2."""
    ahead = _ahead(t)
    mild = F.coalesce(F.col("spo2") < 93.0, F.lit(False)) | F.coalesce(
        F.col("respiratory_rate") > 22.0, F.lit(False))
    df = t.df.withColumns({
        "abnormal_steps": F.sum(abnormal_step().cast("int")).over(ahead),
        "_mild": F.max(mild).over(ahead),
    })
    df = df.withColumns({
        "deterioration": (F.col("abnormal_steps") >= 2).cast("double"),
        "risk_tier": risk_tier(F.col("abnormal_steps"), F.col("_mild")),
    })
    return t.with_df(df.drop("_mild"))


def add_response(t: Timeline) -> Timeline:
    """Instability before and after a tick; a response label only where an eligible episode starts."""
    df = t.df.withColumn("_score", instability())
    df = df.withColumns({
        "pre_risk": F.avg("_score").over(_behind(t)),
        "post_risk": F.avg("_score").over(_ahead(t)),
    })
    df = df.withColumn("delta_risk", F.round(F.col("post_risk") - F.col("pre_risk"), 12))
    eligible = F.coalesce(F.col("episode.eligible"), F.lit(False))
    label = case([(F.col("delta_risk") <= -0.15, 1), (F.col("delta_risk") >= 0.15, 2)], 0)
    df = df.withColumns({
        "response": F.when(eligible, label).otherwise(0),
        "response_mask": eligible.cast("double"),
    })
    return t.with_df(df.drop("_score"))


def add_targets(t: Timeline) -> Timeline:
    out = add_response(add_deterioration(add_forecast(t)))
    return out.with_df(out.df.withColumn(
        "deterioration_mask", (F.col("valid_points") > 0).cast("double")))
