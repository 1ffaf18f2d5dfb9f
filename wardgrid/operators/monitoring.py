"""Personal baselines, sustained events and alerts over raw readings."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log10

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.operators.slices import halo_chunks, running_totals, with_previous

#: Rows that one task orders when a key is counted or compared.
COUNT_ROWS = 100_000


def personal_baseline(numbered: DataFrame, keys: Sequence[str], value: str, seq: str = "seq",
                      alpha: float = 0.05, min_obs: int = 48) -> DataFrame:
    """Causal baseline: mean of the first `min_obs` readings, then B = alpha x + (1 - alpha) B.

    Missing readings count for nothing: the baseline stands still over them, before the first `min_obs` present ones it
    is NULL, and their deviation is NULL. Present readings go in blocks so long that a block fades its start to
    1e-12; a block starts from the ends of the two blocks before it, and what is older lies below double precision.
    """
    keys = list(keys)
    keep = 1.0 - alpha
    size = ceil(-12.0 / log10(keep))
    present = F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long")
    counted = running_totals(numbered.withColumn("_one", present), keys, [seq], {"_k": "_one"})
    start = counted.where((F.col("_one") == 1) & (F.col("_k") <= min_obs)).groupBy(*keys).agg(
        F.avg(value).alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == min_obs).drop("_n")
    index = F.col("_k") - min_obs - 1
    rows = counted.withColumns({
        "_b": F.when(index >= 0, F.floor(index / size)).otherwise(-1).cast("long"),
        "_i": F.when(index >= 0, index % size + 1).otherwise(0).cast("long")})
    inside = Window.partitionBy(*keys, "_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    # a missing reading adds nothing, and its place in the block is that of the last present one
    scaled = F.when(F.col("_b") >= 0, F.coalesce(alpha * F.col(value) * F.pow(F.lit(keep), -F.col("_i")), F.lit(0.0)))
    rows = rows.withColumn("_local", F.pow(F.lit(keep), F.col("_i")) * F.sum(scaled).over(inside))
    blocks = Window.partitionBy(*keys).orderBy("_b")
    fade = keep ** size
    ends = rows.where("_b >= 0").groupBy(*keys, "_b").agg(F.max_by("_local", "_i").alias("_end"))
    ends = ends.select(*keys, "_b", (
        F.coalesce(F.lag("_end", 1).over(blocks), F.lit(0.0))
        + fade * F.coalesce(F.lag("_end", 2).over(blocks), F.lit(0.0))).alias("_before"))
    joined = rows.join(ends, [*keys, "_b"], "left").join(start, keys, "left")
    carried = F.col("_before") + F.when(F.col("_b") < 2, F.pow(F.lit(fade), F.col("_b")) * F.col("_first")).otherwise(0.0)
    baseline = F.when(F.col("_k") == min_obs, F.col("_first")).when(
        F.col("_k") > min_obs, F.col("_local") + F.pow(F.lit(keep), F.col("_i")) * carried)
    return joined.select(*numbered.columns, baseline.alias("baseline"),
                         (F.col(value) - baseline).alias("deviation"))


def sustained(readings: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], flag: Column,
              name: str = "sustained") -> DataFrame:
    """True from the second consecutive flagged reading of a key on."""
    marked = readings.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    lagged = with_previous(marked, keys, time, order, ["_flag"])
    return lagged.withColumn(name, F.col("_flag") & F.coalesce("prev__flag", F.lit(False))).drop("_flag", "prev__flag")


def composite_outcome(events: Sequence[DataFrame], key: str = "stay_id") -> DataFrame:
    """OR of several event tables (key, time, kind): first time and the kinds seen per key."""
    rows = events[0]
    for other in events[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(key).agg(
        F.min("time").alias("first_time"), F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"))


def suppress_repeats(alerts: DataFrame, order: Sequence[str], time: str = "ts", max_rows: int = COUNT_ROWS) -> DataFrame:
    """Drop an alert when the one logged just before it is of the same patient and second.

    An alert can only repeat one of its own second, so the log is compared second by second. A second with more than
    `max_rows` alerts is cut along a whole-number first column of `order`, and each cut hands its last alert on.
    """
    marked = alerts.withColumn("_second", F.date_trunc("second", F.col(time)))
    whole = dict(alerts.dtypes)[order[0]] in ("tinyint", "smallint", "int", "bigint")
    place = F.timestamp_micros(F.col(order[0]).cast("long")) if whole else F.col("_second")
    lagged = with_previous(marked.withColumn("_place", place), ["_second"], "_place", order, ["patient_id"], "_last_", max_rows)
    return lagged.where(~F.col("patient_id").eqNullSafe(F.col("_last_patient_id"))).select(*alerts.columns)


def lead_times(alerts: DataFrame, events: DataFrame, hours: float) -> DataFrame:
    """Per event: first alert of the same patient within the look-back and its lead in minutes."""
    back = int(hours * 3_600_000_000)
    a = alerts.select("patient_id", F.unix_micros("ts").alias("_us"), F.lit(None).cast("long").alias("event_id"),
                      F.lit(True).alias("_alert"))
    e = events.select("patient_id", F.unix_micros("ts").alias("_us"), F.col("event_id").cast("long"),
                      F.lit(False).alias("_alert"))
    cut = halo_chunks(a.unionByName(e), "_us", 2 * back, back)
    w = Window.partitionBy("patient_id", "chunk").orderBy("_us").rangeBetween(-back, 0)
    first = F.min(F.when(F.col("_alert"), F.col("_us"))).over(w)
    found = cut.withColumn("_first", first).where(F.col("core") & ~F.col("_alert"))
    return found.select("patient_id", "event_id", ((F.col("_us") - F.col("_first")) / 60e6).alias("lead_minutes"))
