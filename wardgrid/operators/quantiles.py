"""Exact quantiles by radix selection: values are counted, never ordered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.operators.slices import number_bin
from wardgrid.session import store

#: Parts into which a pass cuts the interval that holds a wanted rank.
PARTS = 4096


def _located(level: DataFrame, group: Sequence[str], interval: Sequence[str]) -> DataFrame:
    """The parts of `level` that hold a wanted rank: one row for each rank, with the rank's place in the part.

    A key has few intervals of at most PARTS parts, so what one task puts in order here is bounded.
    """
    before = Window.partitionBy(*group, *interval).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = level.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    inside = F.filter("_ranks", lambda r: (r["at"] >= F.col("_start")) & (r["at"] < F.col("_start") + F.col("_c")))
    ranks = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["at"] - F.col("_start")).alias("at")))
    return start.withColumn("_ranks", ranks).where(F.size("_ranks") > 0)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probabilities: Mapping[str, float]) -> DataFrame:
    """One row per key with linearly interpolated quantiles (0-based position p * (n - 1)).

    The first pass counts values in bins of a part of an octave; each later one cuts the bins that hold a wanted rank
    into PARTS equal parts of the range that their values really span, and keeps only the rows of parts that hold one. It
    ends when all values of each kept part are equal: after five passes at most, since a double has 52 binary digits.
    Only counts are shuffled, by partial aggregates, so neither a hot key nor a crowd of close values meets in one task.
    Keys must not be NULL; NULL and NaN values are ignored.
    """
    keys = list(keys)
    group = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.select(*([F.col(k) for k in keys] or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_part", number_bin(F.col("_v")))
    measures = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo2"), F.max("_v").alias("_hi2")]
    level = rows.groupBy(*group, "_part").agg(*measures).withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
    positions = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in probabilities.items()}
    wanted = F.array_distinct(F.array(*[r(pos).cast("long") for pos in positions.values() for r in (F.floor, F.ceil)]))
    level = level.withColumn("_ranks", F.transform(wanted, lambda r: F.struct(r.alias("rank"), r.alias("at"))))
    interval: list[str] = []
    found = None
    while True:
        hits = store(_located(level, group, interval).select(*group, *interval, "_part", "_n", "_ranks", "_lo2", "_hi2"))
        done = hits.where("_lo2 = _hi2").select(*group, "_n", F.col("_lo2").alias("_value"), F.explode("_ranks.rank").alias("_rank"))
        found = done if found is None else found.unionByName(done)
        left = hits.where("_lo2 < _hi2")
        if left.isEmpty():
            break
        kept = rows.join(left.select(*group, *interval, "_part", "_lo2", "_hi2", "_n", "_ranks"), [*group, *interval, "_part"])
        part = F.least(F.floor((F.col("_v") - F.col("_lo2")) / (F.col("_hi2") - F.col("_lo2")) * PARTS), F.lit(PARTS - 1)).cast("long")
        rows = store(kept.select(*group, "_v", F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), part.alias("_part")))
        interval = ["_lo", "_hi"]
        asked = left.select(*group, F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), "_n", "_ranks")
        level = rows.groupBy(*group, *interval, "_part").agg(*measures).join(asked, [*group, *interval])
    picked = found.groupBy(*group).agg(
        F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))  # two ranks a probability

    def at(rank):
        return F.col("_at")[rank.cast("long")]

    def between(pos):
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        return F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos)))

    return picked.select(*keys, *[between(pos).alias(name) for name, pos in positions.items()])
