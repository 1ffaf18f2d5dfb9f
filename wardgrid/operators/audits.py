"""Leakage and integrity audits of a window dataset: counts per rule, never a literal 'passed'."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENIED_FEATURES = ("news2", "news_score", "news2_total")


def tables_read(df: DataFrame) -> list[str]:
    """The stored tables below a plan, by the paths of their files without those inside a table's folder."""
    return sorted({re.sub(r"(\.(parquet|csv|csv\.gz))/.*", r"\1", f) for f in df.inputFiles()})


def leakage_audit(windows: DataFrame, splits: DataFrame, fitted: DataFrame, features: Sequence[str],
                  denied: Sequence[str] = DENIED_FEATURES, read: Iterable[str] = (), label_only: Iterable[str] = ()) -> DataFrame:
    """(rule, violations, passed): time order, scaler subjects outside train, split overlap, denied features and sources.

    Windows carry `target_tick`, the first tick of their targets, and `newest_source`, the time in microseconds of the
    newest reading behind any of their inputs, as the timeline carried it: a window is late when that reading was not made
    before its first target tick, or when there is no such tick. `fitted` holds the subjects that the scaler saw, `read` the
    tables that the features read, `label_only` those that may only give labels.
    """
    def rule(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))

    train = splits.where("split = 'train'").select("subject_id")
    # overlap counts what the windows really carry, not what the split table promises
    shared = windows.groupBy("subject_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    late = windows.where(F.col("target_tick").isNull() | (F.col("newest_source") >= F.col("target_tick") * 1_000_000)
                         | (F.col("tick") >= F.col("target_tick")))
    spark = windows.sparkSession
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    both = spark.createDataFrame([(f,) for f in sorted(set(read) & set(label_only))], "name string")
    rules = [
        rule("temporal_leakage", late),
        rule("scaler_leakage", fitted.select("subject_id").distinct().join(train, "subject_id", "left_anti")),
        rule("patient_leakage", shared),
        rule("denied_features", names.where(F.lower("feature").isin(list(denied)))),
        rule("label_only_sources", both),
    ]
    return reduce(lambda a, b: a.unionByName(b), rules).withColumn("passed", F.col("violations") == 0)


def integrity_audit(windows: DataFrame) -> DataFrame:
    """Per split: windows whose matrices hold a NULL, NaN or infinite number."""
    def broken(column: str):
        return F.exists(F.flatten(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    return windows.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(broken("X")).alias("bad_inputs"),
        F.count_if(broken("forecast")).alias("bad_targets"), F.count_if(broken("forecast_mask")).alias("bad_masks"))


def fail_on_violations(audit: DataFrame, column: str = "violations") -> None:
    bad = audit.where(F.col(column) > 0).take(1)
    if bad:
        raise ValueError(f"audit failed: {bad[0].asDict()}")
