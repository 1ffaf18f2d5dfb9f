"""Treatment intervals, episodes and their audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.rules import keyword_class
from wardgrid.operators.timeline import (
    SO_FAR, GridSpec, Timeline, by_week, floor_to, over_ticks, stay_bounds, week_of,
)


def with_labels(infusions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Infusions with their item label (left join on itemid)."""
    return infusions.join(dictionary.select("itemid", "label"), "itemid", "left")


def classify(treatments: DataFrame, name: str, rules: Sequence = tuple(fx.DRUG_FLAGS)) -> DataFrame:
    return treatments.withColumn("treatment", keyword_class(F.col(name), rules))


def close_orders(orders: DataFrame, default_hours: float = 24.0) -> DataFrame:
    """Orders without a stop time end `default_hours` after their start."""
    default = F.timestamp_seconds(F.unix_micros("starttime") / 1e6 + default_hours * 3600.0)
    return orders.withColumn("endtime", F.coalesce(F.col("stoptime"), default))


def stay_intervals(infusions: DataFrame, orders: DataFrame, bounds: DataFrame) -> DataFrame:
    """Classified infusions (by stay) and orders (by subject) as (stay, treatment, start, end)."""
    known = F.col("treatment").isNotNull() & F.col("starttime").isNotNull() & F.col("endtime").isNotNull()
    cols = ["treatment", "starttime", "endtime"]
    by_stay = infusions.where(known).select("stay_id", *cols)
    closed = close_orders(orders).where(known & (F.col("endtime") >= F.col("starttime")))
    start, end = week_of(F.unix_seconds("starttime")), week_of(F.unix_seconds("endtime"))
    weekly = closed.select("subject_id", *cols, start.alias("_from"), F.explode(F.sequence(start, end)).alias("_week"))
    stays = by_week(bounds).withColumn("_opens", week_of(F.col("first_tick")))
    # a pair that shares several weeks is kept in the first one only
    met = weekly.join(stays, ["subject_id", "_week"]).where(F.col("_week") == F.greatest("_from", "_opens"))
    return by_stay.unionByName(met.select("stay_id", *cols))


def interval_edges(intervals: DataFrame, bounds: DataFrame, spec: GridSpec,
                   treatments: Sequence[str] = tuple(fx.TREATMENTS)) -> DataFrame:
    """Start (+1) and end (-1) edges per (stay, chunk, tick): two rows per interval and chunk.

    An interval covers the ticks with start <= tick <= end, cut to the grid and to the chunk's
    ticks, so its cost does not depend on how many ticks it covers.
    """
    span, step = spec.length * spec.step, spec.step
    start = F.ceil(F.unix_micros("starttime") / F.lit(step * 1_000_000)) * step
    end = F.floor(F.unix_micros("endtime") / F.lit(step * 1_000_000)) * step
    cut = (
        intervals.join(bounds.select("stay_id", "first_tick", "last_tick"), "stay_id")
        .withColumn("_s", F.greatest(start, "first_tick"))
        .withColumn("_e", F.least(end, "last_tick"))
        .where(F.col("_s") <= F.col("_e"))
    )
    lowest = F.greatest(F.floor(F.col("first_tick") / span),
                        F.floor((F.col("_s") - (spec.after - 1) * step) / span) - 1)
    highest = F.least(F.floor(F.col("last_tick") / span),
                      F.floor((F.col("_e") + spec.before * step) / span))
    cut = cut.withColumn("chunk", F.explode(F.sequence(lowest, highest)))
    from_tick = F.greatest("first_tick", F.col("chunk") * span - spec.before * step)
    to_tick = F.least("last_tick", (F.col("chunk") + 1) * span + (spec.after - 1) * step)
    cut = (
        cut.withColumn("_s", F.greatest("_s", from_tick)).withColumn("_to", to_tick)
        .withColumn("_e", F.least("_e", "_to")).where(F.col("_s") <= F.col("_e"))
    )
    edges = cut.withColumn("edge", F.explode(F.array(
        F.struct(F.col("_s").alias("tick"), F.lit(1).alias("delta")),
        F.struct((F.col("_e") + step).alias("tick"), F.lit(-1).alias("delta")),
    ))).where(F.col("edge.tick") <= F.col("_to"))
    return edges.groupBy("stay_id", "chunk", F.col("edge.tick").cast("long").alias("tick")).agg(*[
        F.sum(F.when(F.col("treatment") == c, F.col("edge.delta"))).alias(f"_edge_{c}")
        for c in treatments])


def add_flags(t: Timeline, treatments: Sequence[str] = tuple(fx.TREATMENTS)) -> Timeline:
    """Active-treatment flags from the running sum of edges; no treatment counts as 0."""
    kept = [c for c in t.df.columns if not c.startswith("_edge_")]
    return t.with_df(t.df.selectExpr(*kept, *[
        f"CAST(coalesce(sum(_edge_{c}) OVER ({SO_FAR}), 0) > 0 AS DOUBLE) AS {c}" for c in treatments]))


def episodes(infusions: DataFrame, orders: DataFrame, stays: DataFrame,
             pre_hours: float = 2.0, post_hours: float = 2.0) -> DataFrame:
    """Treatment starts with their pre/post bounds and eligibility inside the stay.

    Orders must start within the stay; infusions need not. `load_rank` orders infusions before
    orders, as they are loaded.
    """
    stay = stays.select("stay_id", "subject_id", "intime", "outtime")
    cols = ["stay_id", "subject_id", "intime", "outtime", "treatment", "drug_name", "starttime",
            "event_id", "source", "load_rank"]
    started = F.col("treatment").isNotNull() & F.col("starttime").isNotNull()
    given = (
        infusions.where(started).drop("subject_id").join(stay, "stay_id")
        .withColumns({"source": F.lit("icu_inputevents"), "load_rank": F.lit(0)}).select(*cols)
    )
    weeks = by_week(stay.withColumns({"_in": F.unix_seconds("intime"), "_out": F.unix_seconds("outtime")}), "_in", "_out")
    ordered = (
        orders.where(started).withColumn("_week", week_of(F.unix_seconds("starttime")))
        .join(weeks, ["subject_id", "_week"])
        .where(F.col("starttime").between(F.col("intime"), F.col("outtime")))
        .withColumns({"source": F.lit("hosp_prescriptions"), "load_rank": F.lit(1)}).select(*cols)
    )

    def shifted(hours: float) -> Column:
        return F.timestamp_micros((F.unix_micros("starttime") + F.lit(int(hours * 3_600_000_000))))

    out = given.unionByName(ordered).withColumns(
        {"pre_start": shifted(-pre_hours), "post_end": shifted(post_hours)})
    return out.withColumn("eligible", (F.col("pre_start") >= F.col("intime"))
                          & (F.col("post_end") <= F.col("outtime")))


def episode_per_tick(found: DataFrame, spec: GridSpec) -> DataFrame:
    """The last loaded episode per (stay, tick), with the number of episodes on the tick."""
    ticked = found.withColumn("tick", floor_to(F.col("starttime"), spec.step))
    order = F.struct("load_rank", "starttime", "event_id")
    return ticked.groupBy("stay_id", "tick").agg(
        F.max_by(F.struct("treatment", "drug_name", "eligible", "starttime", "event_id"), order)
        .alias("episode"),
        F.count(F.lit(1)).alias("episode_count"),
    )


def initiations(t: Timeline, treatments: Sequence[str] = tuple(fx.TREATMENTS)) -> Timeline:
    """True where any flag turns from 0 to 1."""
    w = over_ticks()
    starts = F.lit(False)
    for c in treatments:
        starts = starts | F.coalesce(F.col(c) - F.lag(c).over(w) > 0, F.lit(False))
    return t.with_df(t.df.withColumn("initiation", starts))


def class_counts(infusions: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows per source and treatment class."""
    a = infusions.select(F.lit("infusions").alias("source"), "treatment")
    b = orders.select(F.lit("orders").alias("source"), "treatment")
    return a.unionByName(b).where("treatment is not null").groupBy("source", "treatment").agg(
        F.count(F.lit(1)).alias("n"))


def treatment_audit(infusions: DataFrame, orders: DataFrame, cohort_stays: DataFrame) -> DataFrame:
    """Rows per class: infusions of cohort stays plus all orders, every class listed."""
    cohort = infusions.join(cohort_stays.select("stay_id"), "stay_id", "left_semi")
    both = cohort.select("treatment").unionByName(orders.select("treatment"))
    counts = both.agg(*[F.count_if(F.col("treatment") == c).alias(c) for c in fx.TREATMENTS])
    return counts.unpivot([], list(fx.TREATMENTS), "treatment", "n_rows").withColumn(
        "total_rows", F.sum("n_rows").over(Window.partitionBy(F.lit(0))))


def co_administration(found: DataFrame, stays: DataFrame, spec: GridSpec) -> DataFrame:
    """Episodes and distinct windows they fall on, over ticks that can hold a window."""
    bounds = stay_bounds(stays, spec)
    per_tick = episode_per_tick(found, spec).join(bounds, "stay_id")
    index = (F.col("tick") - F.col("first_tick")) / spec.step
    n_ticks = (F.col("last_tick") - F.col("first_tick")) / spec.step + 1
    usable = (index >= spec.history - 1) & (index < n_ticks - spec.horizon)
    windows = per_tick.where(usable & (n_ticks >= spec.history + spec.horizon))
    linked = windows.agg(
        F.count(F.lit(1)).alias("unique_windows"),
        F.coalesce(F.sum("episode_count"), F.lit(0)).alias("linked_events"),
        F.count_if(F.col("episode_count") > 1).alias("windows_with_several"),
        F.count_if(F.col("episode.eligible")).alias("eligible_windows"),
    )
    return linked.withColumn("difference", F.col("linked_events") - F.col("unique_windows"))
