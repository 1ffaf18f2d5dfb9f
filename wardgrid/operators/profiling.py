"""Data-quality and sampling profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions.rules import below_bands
from wardgrid.operators.quantiles import exact_quantiles
from wardgrid.operators.slices import with_previous

QUARTERS = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def registry(spark: SparkSession, items: Mapping[int, str]) -> DataFrame:
    """Item registry: one row per item, so always small."""
    return spark.createDataFrame(sorted(items.items()), "itemid long, canonical_name string")


def positive_gaps(df: DataFrame, keys: Sequence[str], seconds: float = 60.0) -> DataFrame:
    """Time to the previous reading of the same key, zero gaps left out."""
    lagged = with_previous(df.select(*keys, "charttime"), keys, "charttime", ["charttime"], ["charttime"])
    gap = (F.unix_micros("charttime") - F.unix_micros("prev_charttime")) / (seconds * 1e6)
    return lagged.select(*keys, gap.alias("gap")).where("gap > 0")


def gap_summary(gaps: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """Count, mean, population std, range and exact quantiles of the gaps."""
    group = list(keys) or [F.lit(0).alias("_all")]
    stats = gaps.groupBy(*group).agg(
        F.count(F.lit(1)).alias("intervals"), F.avg("gap").alias("mean"),
        F.stddev_pop("gap").alias("std"), F.min("gap").alias("min"), F.max("gap").alias("max"))
    if keys:
        return stats.join(exact_quantiles(gaps, keys, "gap", probabilities), list(keys))
    quantiles = exact_quantiles(gaps.withColumn("_all", F.lit(0)), ["_all"], "gap", probabilities)
    return stats.join(quantiles, "_all").drop("_all")


def with_group(df: DataFrame, groups: Mapping[str, Sequence[int]], name: str = "variable") -> DataFrame:
    """Name the group of each item (several items may form one variable); others drop out."""
    pairs = [F.lit(x) for label, ids in groups.items() for i in ids for x in (i, label)]
    keyed = df.where(F.col("itemid").isin([i for ids in groups.values() for i in ids]))
    return keyed.withColumn(name, F.element_at(F.create_map(*pairs), F.col("itemid").cast("int")))


def sampling_by_variable(observations: DataFrame, groups: Mapping[str, Sequence[int]] = fx.SAMPLING_VITALS) -> DataFrame:
    """Per variable: measurements, median per stay, gap distribution in minutes within a stay."""
    named = with_group(observations, groups)
    per_stay = named.groupBy("variable", "stay_id").agg(F.count("itemid").alias("n"))
    totals = per_stay.groupBy("variable").agg(F.sum("n").alias("measurements"))
    medians = exact_quantiles(per_stay, ["variable"], "n", {"per_stay_median": 0.5})
    gaps = positive_gaps(named, ["variable", "subject_id", "stay_id"])
    summary = gap_summary(gaps, ["variable"], {**QUARTERS, "p90": 0.9})
    return totals.join(medians, "variable").join(summary, "variable")


def sampling_by_lab(labs: DataFrame, groups: Mapping[str, Sequence[int]] = fx.SAMPLING_LABS) -> DataFrame:
    """Per lab: measurements and gap mean/median in hours within a subject."""
    named = with_group(labs, groups)
    totals = named.groupBy("variable").agg(F.count(F.lit(1)).alias("measurements"))
    gaps = positive_gaps(named, ["variable", "subject_id"], 3600.0)
    summary = gap_summary(gaps, ["variable"], {"median": 0.5})
    return totals.join(summary.select("variable", "mean", "median"), "variable", "left")


def item_counts(observations: DataFrame, keys: Sequence[str] = ("itemid",)) -> DataFrame:
    """Rows, missing values, patients and stays per item.

    Rows collapse per (item, subject, stay) first, so the distinct counts run on small data.
    """
    per = observations.groupBy(*keys, "subject_id", "stay_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("valuenum").isNull()).alias("_missing"))
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("n_observations"), F.sum("_missing").alias("n_missing"),
        F.count_distinct("subject_id").alias("n_patients"), F.count_distinct("stay_id").alias("n_stays"))


def temporal_profile(observations: DataFrame, items: DataFrame, n_stays: int, seconds: float = 60.0,
                     probabilities: Mapping[str, float] = QUARTERS) -> DataFrame:
    """Per registered item, absent ones included: counts, stay coverage and gap statistics."""
    known = observations.join(items.select("itemid"), "itemid", "left_semi")
    counts = item_counts(known).drop("n_missing")
    in_stay = known.where("stay_id IS NOT NULL")
    summary = gap_summary(positive_gaps(in_stay, ["itemid", "stay_id"], seconds), ["itemid"], probabilities)
    per_stay = in_stay.groupBy("itemid", "stay_id").agg(F.count(F.lit(1)).alias("n"))
    medians = exact_quantiles(per_stay, ["itemid"], "n", {"obs_per_stay_median": 0.5})
    out = items.join(counts, "itemid", "left").join(summary.drop("intervals"), "itemid", "left").join(
        medians, "itemid", "left")
    out = out.na.fill(0, ["n_observations", "n_patients", "n_stays"])
    return out.withColumn("coverage_pct", F.col("n_stays") * 100.0 / max(n_stays, 1))


def missingness_profile(observations: DataFrame, items: DataFrame, n_stays: int) -> DataFrame:
    """Per registered item: share of missing values and its severity band; ABSENT without rows."""
    counts = item_counts(observations.join(items.select("itemid"), "itemid", "left_semi"))
    out = items.join(counts, "itemid", "left").na.fill(
        0, ["n_observations", "n_missing", "n_patients", "n_stays"])
    pct = F.round(F.col("n_missing") * 100.0 / F.greatest("n_observations", F.lit(1)), 2)
    out = out.withColumns({"missing_pct": pct, "coverage_pct": F.col("n_stays") * 100.0 / max(n_stays, 1)})
    return out.withColumn("severity", F.when(F.col("n_observations") == 0, "ABSENT").otherwise(
        below_bands(F.col("missing_pct"), fx.MISSINGNESS_BANDS, "SEVERE")))


def missingness_with_values(observations: DataFrame, items: DataFrame, n_stays: int) -> DataFrame:
    """The missingness profile beside mean, median and range of each item's values; NULL where it has none."""
    known = observations.join(items.select("itemid"), "itemid", "left_semi")
    stats = known.groupBy("itemid").agg(
        F.avg("valuenum").alias("mean"), F.min("valuenum").alias("min"), F.max("valuenum").alias("max"))
    median = exact_quantiles(known, ["itemid"], "valuenum", {"median": 0.5})
    return missingness_profile(observations, items, n_stays).join(stats, "itemid", "left").join(median, "itemid", "left")


def value_summary(observations: DataFrame, keys: Sequence[str] = ("itemid",)) -> DataFrame:
    """Distribution of the non-missing values per item."""
    stats = observations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"), F.count("valuenum").alias("n_values"),
        F.avg("valuenum").alias("mean"), F.stddev_samp("valuenum").alias("std"),
        F.min("valuenum").alias("min"), F.max("valuenum").alias("max"))
    quantiles = exact_quantiles(observations, keys, "valuenum",
                                {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    return stats.join(quantiles, list(keys))


def quality_issues(observations: DataFrame, keys: Sequence[str] = ("itemid",)) -> DataFrame:
    """Negative values, repeated (stay, time, item) rows and several units, one row per issue."""
    row_key = [*keys, "stay_id", "charttime"]
    repeats = observations.groupBy(*row_key).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum(F.col("_n") - 1).alias("duplicate_timestamps"))
    per_unit = observations.groupBy(*keys, "valueuom").agg(
        F.count_if(F.col("valuenum") < 0).alias("_neg"), F.count("valuenum").alias("_values"))
    units = per_unit.groupBy(*keys).agg(
        F.sum("_neg").alias("negative_values"), F.sum("_values").alias("_values"),
        F.count("valueuom").alias("multiple_units"))
    wide = units.join(repeats, list(keys)).where("_values > 0").drop("_values")
    tall = wide.unpivot(list(keys), ["negative_values", "duplicate_timestamps", "multiple_units"],
                        "issue", "n")
    found = F.when(F.col("issue") == "multiple_units", F.col("n") > 1).otherwise(F.col("n") > 0)
    return tall.where(found).withColumn(
        "severity", F.when(F.col("issue") == "multiple_units", "NOTE").otherwise("WARNING"))


def labs_with_stays(labs: DataFrame, stays: DataFrame) -> DataFrame:
    """Labs reach stays through the admission; an admission with several stays fans out."""
    links = stays.select("hadm_id", "stay_id").distinct()
    return labs.drop("stay_id").join(links, "hadm_id", "left")


def population(patients: DataFrame, admissions: DataFrame, stays: DataFrame) -> DataFrame:
    """Population statistics as (metric, value) rows."""
    age = patients.agg(
        F.count_distinct("subject_id").cast("double").alias("n_patients"),
        F.min("anchor_age").cast("double").alias("age_min"), F.max("anchor_age").cast("double").alias("age_max"),
        F.avg("anchor_age").alias("age_mean"), F.stddev_samp("anchor_age").alias("age_std"))
    hours = stays.withColumn("h", (F.unix_micros("outtime") - F.unix_micros("intime")) / 3.6e9)
    los = hours.agg(
        F.count_distinct("stay_id").cast("double").alias("n_icu_stays"),
        F.min("h").alias("icu_los_min_hours"), F.max("h").alias("icu_los_max_hours"),
        F.avg("h").alias("icu_los_mean_hours"), F.stddev_samp("h").alias("icu_los_std_hours"))
    deaths = admissions.agg(
        F.count_distinct("hadm_id").cast("double").alias("n_admissions"),
        F.count("deathtime").cast("double").alias("n_hospital_deaths"),
        (F.count("deathtime") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("hospital_mortality_rate"))
    age_median = exact_quantiles(patients, [], "anchor_age", {"age_median": 0.5})
    los_quantiles = exact_quantiles(hours, [], "h", {
        "icu_los_p25_hours": 0.25, "icu_los_median_hours": 0.5, "icu_los_p75_hours": 0.75})

    def tall(one_row: DataFrame) -> DataFrame:
        return one_row.unpivot([], one_row.columns, "metric", "value")

    def counted(df: DataFrame, column: str, prefix: str) -> DataFrame:
        counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
            F.count(F.lit(1)).cast("double").alias("value"))
        return counts.select(
            F.concat(F.lit(prefix), F.regexp_replace(column, " ", "_")).alias("metric"), "value")

    out = tall(age)
    for part in (tall(age_median), tall(los), tall(los_quantiles), tall(deaths),
                 counted(patients, "gender", "sex_"), counted(stays, "first_careunit", "care_unit_")):
        out = out.unionByName(part)
    return out


def deaths_in_stay(stays: DataFrame, admissions: DataFrame) -> DataFrame:
    """Stays whose admission's death time lies within the stay."""
    joined = stays.join(admissions.select("hadm_id", "deathtime"), "hadm_id", "left")
    return joined.where(F.col("deathtime").between(F.col("intime"), F.col("outtime")))


def outcome_counts(stays: DataFrame, admissions: DataFrame, infusions: DataFrame, procedures: DataFrame,
                   vasopressors: Sequence[int] = tuple(fx.VASOPRESSOR_ITEMS),
                   ventilation: Sequence[int] = tuple(fx.VENTILATION_ITEMS)) -> DataFrame:
    """Positives, totals and rates of the candidate outcomes."""
    n_stays = stays.select("stay_id").distinct().agg(F.count(F.lit(1)).alias("n_total"))

    def stays_with(events: DataFrame, ids: Sequence[int], name: str) -> DataFrame:
        hit = events.where(F.col("itemid").isin(list(ids))).join(stays.select("stay_id"), "stay_id", "left_semi")
        return hit.agg(F.lit(name).alias("outcome"), F.count_distinct("stay_id").alias("n_positive"))

    hospital = admissions.agg(F.lit("hospital_mortality").alias("outcome"),
                              F.count("deathtime").alias("n_positive"), F.count(F.lit(1)).alias("n_total"))
    icu = deaths_in_stay(stays, admissions).agg(
        F.lit("icu_mortality").alias("outcome"), F.count(F.lit(1)).alias("n_positive"))
    per_stay = icu.unionByName(stays_with(infusions, vasopressors, "vasopressor_initiation")).unionByName(
        stays_with(procedures, ventilation, "mechanical_ventilation"))
    key = F.lit(0).alias("_k")
    per_stay = per_stay.select("*", key).join(n_stays.select("*", key), "_k").drop("_k")
    out = hospital.unionByName(per_stay.select(*hospital.columns))
    return out.withColumn("rate", F.col("n_positive") / F.greatest("n_total", F.lit(1)))


def variable_mapping(items: DataFrame, dictionary: DataFrame, missing: str = "NOT_IN_D_ITEMS",
                     found: str = "CONFIRMED_IN_D_ITEMS") -> DataFrame:
    """Registry checked against a dictionary."""
    first = dictionary.groupBy("itemid").agg(
        F.min_by(F.struct("label", "unitname", "category"), "label").alias("_d"), F.lit(True).alias("_hit"))
    joined = items.join(first, "itemid", "left")
    return joined.select(
        "itemid", "canonical_name", F.when(F.col("_hit"), found).otherwise(missing).alias("status"),
        F.col("_d.label").alias("label"), F.col("_d.unitname").alias("unit"),
        F.col("_d.category").alias("category"))


def grid_steps(stays: DataFrame, step: int, min_hours: float = 6.0) -> DataFrame:
    """Ticks per stay of the unfloored grid intime, intime + step, ... <= outtime."""
    seconds = (F.unix_micros("outtime") - F.unix_micros("intime")) / 1e6
    long_enough = stays.where(seconds >= min_hours * 3600.0)
    return long_enough.withColumn("grid_steps", (F.floor(seconds / step) + 1).cast("long"))


def window_estimates(stays: DataFrame, charted: DataFrame, step: int, history: int = 24,
                     horizons: Sequence[int] = (4, 12, 24), minimums: Sequence[int] = (200, 150, 100)) -> DataFrame:
    """Total ticks, usable windows max(0, n - history - h) and feasibility per horizon."""
    steps = grid_steps(stays.join(charted.select("stay_id"), "stay_id", "left_semi"), step)
    usable = [F.coalesce(F.sum(F.greatest(F.lit(0), F.col("grid_steps") - history - h)), F.lit(0))
              .alias(f"windows_{h}") for h in horizons]
    out = steps.agg(F.count(F.lit(1)).alias("eligible_stays"),
                    F.coalesce(F.sum("grid_steps"), F.lit(0)).alias("grid_steps"), *usable)
    return out.withColumns({
        f"feasible_{h}": F.col(f"windows_{h}") >= least for h, least in zip(horizons, minimums)})


def grid_missingness(named: DataFrame, stays: DataFrame, step: int, channels: Sequence[str]) -> DataFrame:
    """100 * (1 - readings / ticks) per channel."""
    steps = grid_steps(stays.join(named.select("stay_id"), "stay_id", "left_semi"), step)
    total = steps.agg(F.greatest(F.lit(1), F.sum("grid_steps")).alias("_ticks"), F.lit(0).alias("_k"))
    counts = named.agg(*[F.count_if(F.col("channel") == c).alias(c) for c in channels], F.lit(0).alias("_k"))
    wide = counts.join(total, "_k").select(*[
        ((1.0 - F.col(c) / F.col("_ticks")) * 100.0).alias(c) for c in channels])
    return wide.unpivot([], list(channels), "channel", "missing_pct")


def column_inventory(df: DataFrame, table: str) -> DataFrame:
    """Per column: type, rows, NULLs, NULL share; time-named columns also their range."""
    timed = {c for c in df.columns if "time" in c.lower() or "date" in c.lower()}
    cells = []
    for c, kind in df.dtypes:
        low = F.min(F.col(c).cast("string")) if c in timed else F.lit(None).cast("string")
        high = F.max(F.col(c).cast("string")) if c in timed else F.lit(None).cast("string")
        cells.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"),
            (F.count(F.lit(1)) - F.count(c)).alias("null_count"), low.alias("min_time"), high.alias("max_time")))
    one = df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*cells).alias("cells"))
    out = one.select(F.lit(table).alias("table_name"), "row_count", F.explode("cells").alias("c"))
    pct = F.round(F.col("c.null_count") * 100.0 / F.greatest("row_count", F.lit(1)), 2)
    return out.select("table_name", "row_count", "c.*", pct.alias("null_pct"))


def key_inventory(df: DataFrame, table: str,
                  keys: Sequence[str] = ("subject_id", "hadm_id", "stay_id")) -> DataFrame:
    """Rows, columns and distinct ids of a table; absent ids count 0."""
    present = [k for k in keys if k in df.columns]
    counts = [F.count_distinct(k).alias(f"unique_{k}") if k in present else F.lit(0).cast("long").alias(f"unique_{k}")
              for k in keys]
    return df.agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                  F.lit(len(df.columns)).alias("column_count"), *counts)


def sample_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """A few example values of a column as text."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias(column)).limit(k)
