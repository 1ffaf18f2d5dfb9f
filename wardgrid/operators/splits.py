"""Patient-level splits and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.functions.rules import case
from wardgrid.operators.slices import running_totals
from wardgrid.session import store


def split_subjects(cohort: DataFrame, train: float = 0.70, validate: float = 0.15,
                   seed: int = 42) -> DataFrame:
    """(subject_id, split) with exact rounded counts (half to even), in seeded hash order.

    The rank is a prefix scan, so subjects are never ordered in one task.
    """
    subjects = cohort.select("subject_id").distinct().withColumn(
        "_h", F.md5(F.concat_ws("-", F.col("subject_id").cast("string"), F.lit(str(seed)))))
    subjects = store(subjects.withColumn("_one", F.lit(1)))
    ranked = running_totals(subjects, [], ["_h", "subject_id"], {"_rank": "_one"})
    total = subjects.agg(F.count(F.lit(1)).alias("_n"))
    n_train, n_val = F.bround(F.lit(train) * F.col("_n")), F.bround(F.lit(validate) * F.col("_n"))
    bounds = total.select(n_train.alias("_n_train"), (n_train + n_val).alias("_n_val"), F.lit(1).alias("_one"))
    return ranked.join(F.broadcast(bounds), "_one").select(  # one row
        "subject_id",
        case([(F.col("_rank") <= F.col("_n_train"), "train"),
              (F.col("_rank") <= F.col("_n_val"), "validate")], "test").alias("split"))


def split_summary(cohort: DataFrame, splits: DataFrame) -> DataFrame:
    """Patients, share of patients and stays per split."""
    stays = cohort.select("subject_id", "stay_id").distinct().join(splits, "subject_id")
    per_subject = stays.groupBy("split", "subject_id").agg(F.count(F.lit(1)).alias("_stays"))
    out = per_subject.groupBy("split").agg(
        F.count(F.lit(1)).alias("patients"), F.sum("_stays").alias("stays"))
    whole = Window.partitionBy(F.lit(0))
    return out.withColumn(
        "patients_pct", F.round(F.col("patients") * 100.0 / F.sum("patients").over(whole), 2))


def split_overlaps(rows: DataFrame, subject: str = "subject_id", split: str = "split") -> DataFrame:
    """Subjects shared by each pair of the splits present, zero pairs included.

    Subjects collapse to their set of splits first (a handful of names), so no self join is needed.
    """
    sets = rows.groupBy(subject).agg(F.array_sort(F.collect_set(split)).alias("_splits"))
    kinds = sets.groupBy("_splits").agg(F.count(F.lit(1)).alias("_n"))
    names = kinds.select(F.explode("_splits").alias("s")).agg(
        F.array_sort(F.collect_set("s")).alias("_names")).withColumn("_k", F.lit(1))
    pairs = names.select("_k", F.explode(F.expr(
        "flatten(transform(_names, a -> transform(filter(_names, b -> b > a), b -> array(a, b))))")
    ).alias("_pair"))
    shared = kinds.where(F.size("_splits") > 1).withColumn("_pair", F.explode(F.expr(
        "flatten(transform(_splits, a -> transform(filter(_splits, b -> b > a), b -> array(a, b))))")))
    counts = shared.groupBy("_pair").agg(F.sum("_n").alias("shared_subjects"))
    return pairs.join(counts, "_pair", "left").select(
        F.col("_pair")[0].alias("split_a"), F.col("_pair")[1].alias("split_b"),
        F.coalesce("shared_subjects", F.lit(0)).alias("shared_subjects"))


def verify_split(rows: DataFrame, subject: str = "subject_id", split: str = "split") -> DataFrame:
    """Patients and rows per split, and how many of its patients also occur elsewhere."""
    per = rows.groupBy(subject, split).agg(F.count(F.lit(1)).alias("_rows"))
    per = per.withColumn("_leaks", F.count(F.lit(1)).over(Window.partitionBy(subject)) > 1)
    return per.groupBy(split).agg(
        F.count(F.lit(1)).alias("patients"), F.sum("_rows").alias("n_rows"),
        F.count_if("_leaks").alias("leaking_patients"))


def overlap_names(rows: DataFrame, subject: str = "subject_id", split: str = "split") -> list[str]:
    """Names such as 'train_vs_validate' of overlapping split pairs (bounded by pairs of splits)."""
    found = split_overlaps(rows, subject, split).where("shared_subjects > 0").collect()
    order = {"train": 0, "validate": 1, "test": 2}
    return ["_vs_".join(sorted((r.split_a, r.split_b), key=lambda s: order.get(s, 9))) for r in found]


def is_subset(left: DataFrame, right: DataFrame, on: str = "subject_id") -> bool:
    """True where every key of `left` occurs in `right`."""
    return left.join(right.select(on), on, "left_anti").isEmpty()


def shared_subjects(left: DataFrame, right: DataFrame, on: str = "subject_id") -> DataFrame:
    return left.select(on).intersect(right.select(on))
