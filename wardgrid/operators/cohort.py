"""Cohort selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.rules import has_any_stem, keyword_class


def parse_time(df: DataFrame, *columns: str) -> DataFrame:
    """Raw text times to timestamps; what does not parse becomes NULL."""
    return df.withColumns({c: F.try_to_timestamp(c) for c in columns})


def stay_hours(stays: DataFrame) -> DataFrame:
    return stays.withColumn(
        "duration_hours", (F.unix_micros("outtime") - F.unix_micros("intime")) / 3_600_000_000)


def categorised_diagnoses(diagnoses: DataFrame, dictionary: DataFrame,
                          stems: Sequence[str] = tuple(fx.DIAGNOSIS_STEMS),
                          rules: Sequence = tuple(fx.CONDITION_RULES),
                          other: str = fx.CONDITION_OTHER) -> DataFrame:
    """Diagnoses whose dictionary title holds one of the stems, with their condition.

    The dictionary keeps its size-checked join: adaptive execution broadcasts it while it is small.
    """
    titled = diagnoses.join(dictionary, ["icd_code", "icd_version"], "left")
    hits = titled.where(has_any_stem(F.col("long_title"), stems))
    return hits.withColumn("condition", keyword_class(F.col("long_title"), rules, other))


def admission_conditions(found: DataFrame) -> DataFrame:
    """Sorted distinct conditions per admission joined by '; ' (at most one per rule)."""
    return found.groupBy("hadm_id").agg(
        F.array_join(F.array_sort(F.collect_set("condition")), "; ").alias("conditions"))


def select_cohort(stays: DataFrame, patients: DataFrame, found: DataFrame,
                  min_hours: float = 6.0) -> DataFrame:
    """Stays of subjects with a matching diagnosis and a minimum length, with demographics."""
    eligible = stay_hours(
        stays.join(found.select("subject_id"), "subject_id", "left_semi")
    ).where(F.col("duration_hours") >= min_hours)
    person = patients.select("subject_id", "gender", "anchor_age")
    joined = eligible.join(person, "subject_id", "left").join(
        admission_conditions(found), "hadm_id", "left")
    return joined.withColumn("conditions", F.coalesce("conditions", F.lit(fx.CONDITION_DEFAULT)))


def sorted_cohort(cohort: DataFrame) -> DataFrame:
    return cohort.orderBy("subject_id", "intime")


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, NULL left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))


def top_values(df: DataFrame, column: str, k: int = 10, name: str = "n") -> DataFrame:
    """The k most frequent values; equal counts in value order."""
    return value_counts(df, column, name).orderBy(F.desc(name), column).limit(k)
