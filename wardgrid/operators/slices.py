"""Bounded work units for ordered operators.

A key may hold a large share of all rows, so nothing here orders a whole key in one task:

* ticks on a grid are cut into chunks of a fixed number of ticks, with a halo of earlier and
  later ticks copied in, so that every bounded frame is exact inside its chunk;
* raw readings of a key with very many rows are cut into time slices, and what crosses a slice
  border (the previous reading, a running total) is carried over from a small per-slice table;
* running totals go by ranges between sampled splitters: each range is summed first, and what lies before it is carried in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.session import store

SLICE_ROWS = 2_000_000
#: Rows of a range of a prefix scan, about.
RANGE_ROWS = 500_000
#: Bins in which the readings of a large key are counted before it is cut.
SLICE_BINS = 65_536


def number_bin(value: Column, per_octave: int = 256) -> Column:
    """A bin number that never decreases when the value increases; infinite values have the outermost bins."""
    def magnitude(v: Column) -> Column:
        return F.floor((F.least(F.log2(v), F.lit(1025.0)) + 1100.0) * per_octave) + 1

    return (
        F.when(value > 0, magnitude(value))
        .when(value < 0, -magnitude(-value))
        .otherwise(F.lit(0))
        .cast("long")
    )


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, str],
                   rows: int = RANGE_ROWS) -> DataFrame:
    """Inclusive running totals per key in the given order, as a prefix scan over ranges of about `rows` rows.

    Sampled splitters of (keys, order) cut the rows into ranges, which are written once so that a row's range is fixed. Each
    range sums up its keys; what a key has in earlier ranges is carried into the running totals inside a range. So neither a
    key with most rows nor a crowd of close values meets in one task; only rows equal in keys and order share a range.
    `totals` maps an output column to the summed column. Rows equal in keys and order get their totals in any order.
    """
    keys = list(keys)
    kept = store(df)
    ranges = max(1, -(-kept.count() // rows))
    cut = store(kept.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id())) if ranges > 1 \
        else kept.withColumn("_range", F.lit(0))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in totals.items()])
    carried = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in totals])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"_t_{o}") for o, c in totals.items()])
    return local.join(carried, [*keys, "_range"]).select(
        *df.columns, *[(F.col(f"_o_{o}") + F.col(f"_t_{o}")).alias(o) for o in totals])


def time_slices(df: DataFrame, keys: Sequence[str], time: str, max_rows: int = SLICE_ROWS) -> DataFrame:
    """Add `_slice`: 0 for ordinary keys, a time-slice number for keys above `max_rows` rows.

    One narrow count looks for large keys; without any, rows are neither joined nor binned. A large key's readings are counted in SLICE_BINS bins of equal width, and a new slice starts as soon as the bins before
    hold another `max_rows`, so a burst is cut as finely as its bins allow. Missing times come first. The table
    of large keys is tiny (total rows / max_rows at most); adaptive execution measures it and broadcasts it only
    while it is small.
    """
    keys = list(keys)
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows).isEmpty():
        return df.withColumns({"_slice": F.lit(0).cast("long"), "_large": F.lit(False)})
    micros = F.unix_micros(F.col(time))
    large = (
        df.where(F.col(time).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
        .where(F.col("_n") > max_rows)
        .select(*keys, "_lo", F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / SLICE_BINS)).alias("_width"))
    )
    binned = df.join(large, keys, "left").withColumn("_fine", F.floor((micros - F.col("_lo")) / F.col("_width")).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        binned.where("_fine IS NOT NULL").groupBy(*keys, "_fine").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_fine", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / max_rows).cast("long").alias("_slice"))
    )
    number = F.when(F.col("_width").isNull(), F.lit(0)).otherwise(F.coalesce(F.col("_slice"), F.lit(-1)))
    return binned.join(cuts, [*keys, "_fine"], "left").withColumns({
        "_slice": number.cast("long"), "_large": F.col("_width").isNotNull()}).select(*df.columns, "_slice", "_large")


def with_previous(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str],
                  columns: Sequence[str], prefix: str = "prev_", max_rows: int = SLICE_ROWS) -> DataFrame:
    """`lag` of the columns per key in the given order, exact across slices."""
    cut = time_slices(df, keys, time, max_rows)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    row = F.struct(*columns)
    tails = (
        cut.where("_large")
        .groupBy(*keys, "_slice")
        .agg(F.max_by(row, F.struct(*order)).alias("_tail"))
        .withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice")))
    )
    lagged = cut.withColumn("_prev", F.lag(row).over(w))
    joined = lagged.join(tails, [*keys, "_slice"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_tail"))
    return joined.select(*df.columns, *[prev[c].alias(f"{prefix}{c}") for c in columns])


def with_sequence_number(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str],
                         name: str = "seq", max_rows: int = SLICE_ROWS) -> DataFrame:
    """1-based position of each row within its key, exact across slices."""
    cut = time_slices(df, keys, time, max_rows)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    offsets = (
        cut.where("_large")
        .groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(
            Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)))
        .drop("_n")
    )
    numbered = cut.withColumn("_rn", F.row_number().over(w)).join(offsets, [*keys, "_slice"], "left")
    return numbered.select(
        *df.columns, (F.col("_rn") + F.coalesce(F.col("_before"), F.lit(0))).cast("long").alias(name))


def halo_chunks(df: DataFrame, position: str, length: int, before: int, after: int = 0,
                step: int = 1) -> DataFrame:
    """Assign rows to chunks of `length` positions and copy the halo rows.

    Adds `chunk` and `core`; a row is core in exactly one chunk. Positions are multiples of `step`.
    """
    span = length * step
    if before > length or after > length:
        raise ValueError("the halo must not be longer than a chunk")
    home = f"CAST(floor({position} / {span}) AS BIGINT)"
    homes = (
        f"array_compact(array({home}, "
        f"CASE WHEN {position} >= ({home} + 1) * {span} - {before * step} THEN {home} + 1 END, "
        f"CASE WHEN {position} < {home} * {span} + {after * step} THEN {home} - 1 END))"
    )
    out = df.selectExpr("*", f"explode({homes}) AS chunk")
    return out.selectExpr("*", f"chunk = {home} AS core")
