"""Train-only scaler: clip, impute, standardise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.rules import unpivot_numbers
from wardgrid.operators.quantiles import exact_quantiles
from wardgrid.session import store


#: Columns whose moments one aggregate computes.
WIDE = 9


def clip_channels(df: DataFrame) -> DataFrame:
    """Cut every known channel to its plausible range; NULL stays NULL."""
    return df.selectExpr(*[
        "CASE WHEN {0} IS NOT NULL THEN least(greatest({0}, {1}D), {2}D) END AS {0}".format(
            c, *fx.CLIP_BOUNDS[c]) if c in fx.CLIP_BOUNDS else c for c in df.columns])


def _moments(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = ", ".join(f"struct('{c}' AS channel, avg({c}) AS mean, stddev_samp({c}) AS std)" for c in columns)
    return rows.agg(F.expr(f"array({cells})").alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def scaler_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """channel, mean, std, median: std of at most 1e-6 counts as 1, an empty channel is (0, 1, 0)."""
    clipped = clip_channels(train).selectExpr(*[f"CAST({c} AS DOUBLE) AS {c}" for c in columns])
    # moments need no tall copy of the data: wide aggregates, each of so few columns that its code is compiled, turned into rows afterwards
    moments = reduce(DataFrame.unionByName, [_moments(clipped, columns[at: at + WIDE]) for at in range(0, len(columns), WIDE)])
    tall = unpivot_numbers(clipped, [], columns, "channel", "x")
    medians = exact_quantiles(tall, ["channel"], "x", {"median": 0.5})
    joined = moments.join(medians, "channel", "left")
    std = F.when(F.col("std") > 1e-6, F.col("std")).otherwise(1.0)
    return joined.select(
        "channel",
        F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"),
        F.round(std, 6).alias("std"),
        F.round(F.coalesce("median", F.lit(0.0)), 6).alias("median"),
    )


@dataclass(frozen=True)
class Scaler:
    """Fitted statistics: one small row per column; `seen` holds the subjects of the fitted rows, for audits."""

    stats: dict[str, tuple[float, float, float]]
    seen: DataFrame | None = field(default=None, compare=False)

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str] = tuple(fx.FEATURES)) -> Scaler:
        seen = store(train.select("subject_id").distinct()) if "subject_id" in train.columns else None
        return replace(cls.from_table(scaler_stats(train, columns)), seen=seen)

    @classmethod
    def from_table(cls, table: DataFrame) -> Scaler:
        """Statistics are one row per feature column, so collecting them is bounded."""
        return cls({r.channel: (r["mean"], r["std"], r["median"]) for r in table.collect()})

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, m, s, d) for c, (m, s, d) in sorted(self.stats.items())]
        return spark.createDataFrame(rows, "channel string, mean double, std double, median double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_table(spark).coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        schema = "channel string, mean double, std double, median double"
        return cls.from_table(spark.read.schema(schema).json(path))

    def transform(self, df: DataFrame, columns: Sequence[str] = tuple(fx.FEATURES)) -> DataFrame:
        """Clip, fill with the train median, then (x - mean) / (std + 1e-6) except masks and flags."""
        out = clip_channels(df)
        exprs = [c for c in out.columns if c not in columns]
        for c in columns:
            mean, std, median = self.stats.get(c, (0.0, 1.0, 0.0))
            x = f"coalesce({c}, {median!r}D)" if c in out.columns else f"{median!r}D"
            if not c.startswith(("mask_", "tx_")):
                x = f"({x} - {mean!r}D) / ({std!r}D + 1e-6D)"
            exprs.append(f"{x} AS {c}")
        return out.selectExpr(*exprs)

    def scaled(self, column: str, values: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """What `transform` makes of a column's values, within a task; NaN lies above all numbers there."""
        mean, std, median = self.stats.get(column, (0.0, 1.0, 0.0))
        if column in fx.CLIP_BOUNDS:
            low, high = fx.CLIP_BOUNDS[column]
            values = np.where(np.isnan(values), high, np.minimum(np.maximum(values, low), high))
        values = np.where(missing, median, values)
        return values if column.startswith(("mask_", "tx_")) else (values - mean) / (std + 1e-6)
