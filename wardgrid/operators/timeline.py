"""Irregular measurements onto a uniform grid.

A `Timeline` is one relation with a row per (stay, chunk, tick). It is built with two shuffles:
measurements are averaged per (stay, tick) with map-side combine, then averages, treatment edges,
episodes and the bare grid are stacked and shuffled once by (stay, chunk). Every later operator
(fill, features, targets, windows) is a window over that same partitioning and adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.clinical import to_celsius
from wardgrid.operators.slices import halo_chunks
from wardgrid.session import store_bucketed

EMA_LOOK_BACK = 72
WEEK = 7 * 86400


@dataclass(frozen=True)
class GridSpec:
    """Grid step, carry-forward limits and chunking."""

    step_minutes: int = 15
    fill_hours: Mapping[str, float] = field(default_factory=lambda: dict(fx.FILL_HOURS))
    channels: Sequence[str] = tuple(fx.CHANNELS)
    history: int = 24
    horizon: int = 4
    chunk_ticks: int = 1024

    @property
    def step(self) -> int:
        return self.step_minutes * 60

    def fill_steps(self, channel: str) -> int:
        return ceil(self.fill_hours.get(channel, 2.0) * 60.0 / self.step_minutes)

    @property
    def before(self) -> int:
        longest = max(self.fill_steps(c) for c in self.channels)
        return longest + EMA_LOOK_BACK + self.history - 1

    @property
    def after(self) -> int:
        return self.horizon

    @property
    def length(self) -> int:
        return max(self.chunk_ticks, self.before + 1)


@dataclass(frozen=True)
class Timeline:
    """Chunked rows plus the grid they live on."""

    df: DataFrame
    spec: GridSpec

    def stored(self) -> Timeline:
        """The same rows from a bucketed table, for plans that read the timeline several times."""
        return self.with_df(store_bucketed(
            self.df, ["stay_id", "chunk"], ["stay_id", "chunk", "tick"]))

    def with_df(self, df: DataFrame) -> Timeline:
        return replace(self, df=df)

    def rows(self, *columns: str) -> DataFrame:
        """Each tick once, without halo rows."""
        core = self.df.where("core")
        return core.select(*columns) if columns else core


TICKS = "PARTITION BY stay_id, chunk ORDER BY tick"
SO_FAR = f"{TICKS} ROWS UNBOUNDED PRECEDING"


def over_ticks() -> Window:
    return Window.partitionBy("stay_id", "chunk").orderBy("tick")


def floor_to(time: Column, step: int) -> Column:
    """Epoch second of the grid tick at or before a timestamp."""
    return (F.floor(F.unix_seconds(time) / F.lit(step)) * step).cast("long")


def ceil_to(time: Column, step: int) -> Column:
    """Epoch second of the grid tick at or after a timestamp (sub-second precision)."""
    return (F.ceil(F.unix_micros(time) / F.lit(step * 1_000_000)) * step).cast("long")


def tick_time(tick: Column) -> Column:
    return F.timestamp_seconds(tick)


def stay_bounds(stays: DataFrame, spec: GridSpec) -> DataFrame:
    """Grid bounds [floor(intime), ceil(outtime)] per stay, with its `split` where it has one; stays with under two ticks drop out."""
    bounds = stays.select(
        "stay_id", "subject_id", *[c for c in stays.columns if c == "split"],
        floor_to(F.col("intime"), spec.step).alias("first_tick"),
        ceil_to(F.col("outtime"), spec.step).alias("last_tick"),
    )
    return bounds.where(F.col("last_tick") > F.col("first_tick"))


def grid_chunks(bounds: DataFrame, spec: GridSpec) -> DataFrame:
    """One row per stay and chunk with the tick range it needs, halo included."""
    span = spec.length * spec.step
    out = bounds.withColumn("chunk", F.explode(F.sequence(
        F.floor(F.col("first_tick") / span), F.floor(F.col("last_tick") / span))))
    return out.select(
        "*",
        F.greatest("first_tick", F.col("chunk") * span - spec.before * spec.step).alias("from_tick"),
        F.least("last_tick", (F.col("chunk") + 1) * span + (spec.after - 1) * spec.step).alias("to_tick"),
    )


def grid_ticks(chunks: DataFrame, spec: GridSpec) -> DataFrame:
    """The uniform grid: one row per stay, chunk and tick."""
    span = spec.length * spec.step
    ticks = chunks.withColumn("tick", F.explode(F.sequence(
        F.col("from_tick"), F.col("to_tick"), F.lit(spec.step).cast("long"))))
    return ticks.select(
        "stay_id", "chunk", "tick", "subject_id", "first_tick", "last_tick", *[c for c in chunks.columns if c == "split"],
        (F.floor(F.col("tick") / span) == F.col("chunk")).alias("core"))


def name_items(observations: DataFrame, items: Mapping[int, str]) -> DataFrame:
    """Keep known items, add `channel` (arterial and cuff merged) and convert Fahrenheit."""
    mapped = F.create_map(*[F.lit(x) for pair in items.items() for x in pair])
    raw = F.element_at(mapped, F.col("itemid").cast("int"))
    merged = [F.lit(x) for pair in fx.MERGED_CHANNELS.items() for x in pair]
    return (
        observations.where(F.col("itemid").isin(list(items)))
        .withColumn("raw_channel", raw)
        .withColumn("channel", F.coalesce(F.element_at(F.create_map(*merged), F.col("raw_channel")),
                                          F.col("raw_channel")))
        .withColumn("valuenum", F.when(F.col("raw_channel") == "temp_f", to_celsius(F.col("valuenum")))
                    .otherwise(F.col("valuenum")))
    )


def tick_means(named: DataFrame, key: str, channels: Sequence[str], spec: GridSpec, sources: bool = False) -> DataFrame:
    """Mean per (key, tick), one column per channel; partial sums are combined before the shuffle.

    With `sources`, `src_<channel>` is the time of the newest reading in the mean, in microseconds.
    """
    newest = [F.expr(f"max(CASE WHEN channel = '{c}' AND valuenum IS NOT NULL THEN unix_micros(charttime) END) AS {source(c)}")
              for c in channels] if sources else []
    ticked = named.where("charttime IS NOT NULL").withColumn(
        "tick", floor_to(F.col("charttime"), spec.step))
    return ticked.groupBy(key, "tick").agg(*[
        F.expr(f"avg(CASE WHEN channel = '{c}' THEN valuenum END) AS {c}") for c in channels], *newest)


def source(channel: str) -> str:
    """Column with the time of the newest reading behind a channel's value."""
    return f"src_{channel}"


def week_of(second: Column) -> Column:
    return F.floor(second / F.lit(WEEK)).cast("long")


def by_week(bounds: DataFrame, first: str = "first_tick", last: str = "last_tick") -> DataFrame:
    """A row per week a stay touches, so that subject-level rows meet only the stays near their time.

    Without it every row of a subject would be compared with every stay of that subject.
    """
    return bounds.withColumn("_week", F.explode(F.sequence(week_of(F.col(first)), week_of(F.col(last)))))


def labs_per_stay(lab_means: DataFrame, bounds: DataFrame) -> DataFrame:
    """Labs belong to a subject: give them to every stay of the subject whose grid holds the tick."""
    inside = F.col("tick").between(F.col("first_tick"), F.col("last_tick"))
    weekly = lab_means.withColumn("_week", week_of(F.col("tick")))
    joined = weekly.join(by_week(bounds), ["subject_id", "_week"]).where(inside)
    return joined.drop("subject_id", "first_tick", "last_tick", "_week")


def stack(grid: DataFrame, parts: Sequence[DataFrame], spec: GridSpec,
          sums: Sequence[str] = ()) -> Timeline:
    """Bring the grid and tick-level parts together with one shuffle by (stay, chunk).

    Each part holds at most one row per (stay, tick), or carries its own `chunk`; columns named in
    `sums` add up, all others have one value per tick.
    """
    placed = [
        p if "chunk" in p.columns
        else halo_chunks(p, "tick", spec.length, spec.before, spec.after, spec.step).drop("core")
        for p in parts
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed, grid)
    rows = rows.repartition("stay_id", "chunk")
    values = [c for c in rows.columns if c not in ("stay_id", "chunk", "tick")]
    tied = rows.groupBy("stay_id", "chunk", "tick").agg(*[
        F.expr(f"{'sum' if c in sums else 'max'}({c}) AS {c}") for c in values])
    return Timeline(tied.where("core IS NOT NULL"), spec)


def fill_and_mask(t: Timeline, frame: str = SO_FAR) -> Timeline:
    """Masks first (1 observed, 0 missing), then carry forward up to the channel's step limit.

    A value's source time goes with it where the timeline has one. `frame` is where a value is looked for.
    """
    spec = t.spec
    traced = [c for c in spec.channels if source(c) in t.df.columns]
    kept = [c for c in t.df.columns if c not in spec.channels and c not in map(source, traced)]
    seen = t.df.selectExpr("*", *[
        f"last(CASE WHEN {c} IS NOT NULL THEN struct(tick, {c}{', ' + source(c) if c in traced else ''}) END, true) OVER ({frame}) AS _last_{c}"
        for c in spec.channels])

    def carried(c: str, name: str) -> str:
        return f"CASE WHEN tick - _last_{c}.tick <= {spec.fill_steps(c) * spec.step} THEN _last_{c}.{name} END AS {name}"
    return t.with_df(seen.selectExpr(
        *kept, *[carried(c, c) for c in spec.channels], *[carried(c, source(c)) for c in traced],
        *[f"CAST({c} IS NOT NULL AS DOUBLE) AS mask_{c}" for c in spec.channels]))


def add_provenance(t: Timeline) -> Timeline:
    """`newest_source`: the newest reading behind any value of the history that ends at a tick; `target_tick`: the first tick ahead."""
    names = [source(c) for c in t.spec.channels if source(c) in t.df.columns]
    row = f"greatest({', '.join(names)})" if len(names) > 1 else names[0]
    return t.with_df(t.df.selectExpr(
        "*", f"max({row}) OVER ({TICKS} ROWS BETWEEN {t.spec.history - 1} PRECEDING AND CURRENT ROW) AS newest_source",
        f"min(tick) OVER ({TICKS} ROWS BETWEEN 1 FOLLOWING AND {t.spec.horizon} FOLLOWING) AS target_tick"))


def chunked_timeline(stays: DataFrame, vitals: DataFrame, labs: DataFrame, spec: GridSpec,
                     extra: Sequence[DataFrame] = (), sums: Sequence[str] = (),
                     stored: bool = False, sources: bool = False, frame: str = SO_FAR) -> Timeline:
    """Grid, vitals (by stay), labs (by subject) and any extra parts as one filled timeline.

    With `sources`, each channel carries the time of the reading it came from; `frame` is that of `fill_and_mask`.

    With `stored`, the stacked rows are written once before the fill: right for plans with several
    readers (features, scaler, windows), since the grid is far smaller than the readings.
    """
    bounds = stay_bounds(stays, spec)
    grid = grid_ticks(grid_chunks(bounds, spec), spec)
    vital_names = [c for c in fx.VITAL_CHANNELS if c in spec.channels]
    lab_names = [c for c in fx.LAB_CHANNELS if c in spec.channels]
    vital_rows = tick_means(name_items(vitals, fx.VITAL_ITEMS), "stay_id", vital_names, spec, sources)
    lab_rows = labs_per_stay(
        tick_means(name_items(labs, fx.LAB_ITEMS), "subject_id", lab_names, spec, sources), bounds.drop("split"))
    t = stack(grid, [vital_rows, lab_rows, *extra], spec, sums)
    return fill_and_mask(t.stored() if stored else t, frame)


def align(stays: DataFrame, vitals: DataFrame, labs: DataFrame, spec: GridSpec) -> DataFrame:
    """Aligned timeline of every stay: charttime, 14 channels, 14 masks."""
    t = chunked_timeline(stays, vitals, labs, spec)
    return t.rows().select(
        "stay_id", "subject_id", tick_time(F.col("tick")).alias("charttime"),
        *spec.channels, *[f"mask_{c}" for c in spec.channels])


def carry_over_chunks(t: Timeline, columns: Sequence[str], value) -> DataFrame:
    """Last non-NULL value of each column before a chunk's first halo tick, per (stay, chunk).

    `value` adds the columns to a timeline. Only stays spanning several chunks are evaluated; they
    reuse the (stay, chunk) shuffle of the main plan, and the per-chunk table is small.
    """
    spec, span = t.spec, t.spec.length * t.spec.step
    several = t.df.where(F.floor(F.col("first_tick") / span) < F.floor(F.col("last_tick") / span))
    before_halo = F.col("tick") < (F.col("chunk") + 1) * span - spec.before * spec.step

    def last_tick(c: str, kept: Column) -> Column:
        return F.max_by(c, F.when(kept & F.col(c).isNotNull(), F.col("tick")))

    tails = value(t.with_df(several)).df.where("core").groupBy("stay_id", "chunk").agg(
        *[last_tick(c, F.lit(True)).alias(f"_end_{c}") for c in columns],
        *[last_tick(c, before_halo).alias(f"_mid_{c}") for c in columns])
    w = Window.partitionBy("stay_id").orderBy("chunk")
    older = w.rowsBetween(Window.unboundedPreceding, -2)
    return tails.select("stay_id", "chunk", *[
        F.coalesce(F.lag(f"_mid_{c}").over(w), F.last(f"_end_{c}", ignorenulls=True).over(older))
        .alias(f"_carry_{c}") for c in columns])


def fill_forever(t: Timeline, columns: Sequence[str], prefix: str = "ffill_") -> Timeline:
    """Unbounded carry-forward, exact across chunks."""
    def add(x: Timeline) -> Timeline:
        return x.with_df(x.df.selectExpr("*", *[
            f"last({c}, true) OVER ({SO_FAR}) AS {prefix}{c}" for c in columns]))

    return with_carry(t, [f"{prefix}{c}" for c in columns], add)


def with_carry(t: Timeline, names: Sequence[str], add) -> Timeline:
    """Add running columns and, where a chunk has no value of its own yet, the carried one."""
    carried = carry_over_chunks(t, names, add)
    df = add(t).df.join(carried, ["stay_id", "chunk"], "left")
    keep = [c for c in df.columns if c not in names and not c.startswith("_carry_")]
    return t.with_df(df.selectExpr(*keep, *[f"coalesce({n}, _carry_{n}) AS {n}" for n in names]))


def phase_reconciliation(stays: DataFrame, observations: DataFrame, spec: GridSpec,
                         channel: str = "heart_rate") -> DataFrame:
    """Per stay: how many floored readings meet a tick of the unfloored and of the floored grid."""
    named = name_items(observations, fx.VITAL_ITEMS).where(F.col("channel") == channel)
    means = tick_means(named, "stay_id", [channel], spec).where(F.col(channel).isNotNull())
    step_us = spec.step * 1_000_000
    tick_us = F.col("tick") * 1_000_000
    start_us, end_us = F.unix_micros("intime"), F.unix_micros("outtime")
    on_raw = ((tick_us - start_us) % step_us == 0) & tick_us.between(start_us, end_us)
    on_floored = F.col("tick").between(
        floor_to(F.col("intime"), spec.step), ceil_to(F.col("outtime"), spec.step))
    raw = named.where(F.col("valuenum").isNotNull()).groupBy("stay_id").agg(
        F.count(F.lit(1)).alias("raw_readings"))
    joined = means.join(stays.select("stay_id", "intime", "outtime"), "stay_id")
    counts = joined.groupBy("stay_id").agg(
        F.count_if(on_raw).alias("unfloored_joined"), F.count_if(on_floored).alias("floored_joined"))
    return raw.join(counts, "stay_id", "left").na.fill(0)
