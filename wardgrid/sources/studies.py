"""Packed study rows: one CSV row per patient with stringified lists of images, views and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.functions import text as tx
from wardgrid.sources.files import with_existence

LABEL_COLUMNS = {f: f.lower().replace(" ", "_") for f in fx.FINDINGS}


class MissingFiles(FileNotFoundError):
    """Fail-fast ingestion met an image that does not exist."""


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """subject_id, image, view, text as written; quoted cells may span lines."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return names.select(*[
        (F.col(c) if c in names.columns else F.lit(None)).cast("string").alias(c)
        for c in ("subject_id", "image", "view", "text")])


def explode_images(packed: DataFrame, split: str) -> DataFrame:
    """One row per image with study, image id, view and the report of its study.

    The n-th distinct study of a row takes the n-th report; a study beyond the reports has none.
    """
    rows = packed.withColumn("subject_id", F.trim("subject_id")).where(
        F.col("subject_id").isNotNull() & (F.col("subject_id") != ""))
    rows = rows.select(
        "subject_id", tx.list_items(F.col("image")).alias("_images"), tx.list_items(F.col("view")).alias("_views"),
        tx.list_items(F.col("text")).alias("_texts"))
    study = lambda p: tx.path_part(p, 3)
    rows = rows.withColumn("_order", F.array_distinct(F.filter(
        F.transform("_images", study), lambda s: s.isNotNull())))
    images = rows.select("*", F.posexplode("_images").alias("image_index", "_image"))
    path = tx.clean_path(F.col("_image"))
    index = F.format_string("%04d", F.col("image_index"))
    rank = F.array_position("_order", F.col("study_id"))
    images = images.withColumns({
        "image_path": path,
        "study_id": F.coalesce(tx.path_part(path, 3), F.concat(F.lit("STD-"), index)),
        "image_id": F.coalesce(tx.image_name(path), F.concat(F.lit("DCM-"), index)),
        "view_position": F.coalesce(F.get("_views", F.col("image_index")), F.lit("PA")),
    })
    report = F.when(rank > 0, F.coalesce(F.get("_texts", (rank - 1).cast("int")), F.lit(""))).otherwise(
        F.coalesce(F.get("_texts", 0), F.lit("")))
    return images.select("subject_id", "study_id", "image_id", "view_position", "image_path",
                         report.alias("report_text"), F.lit(split).alias("split"))


def with_report_labels(images: DataFrame, patterns=fx.REPORT_PATTERNS, negation: str = fx.NEGATION_PATTERN) -> DataFrame:
    """0/1 columns per finding, plus no_finding."""
    labels = tx.report_labels(F.col("report_text"), patterns, negation)
    named = {LABEL_COLUMNS.get(k, k.lower().replace(" ", "_")): v for k, v in labels.items()}
    out = images.withColumns(named)
    return out.withColumn("no_finding", tx.no_finding(list(named)))


def ingest(images: DataFrame, files: DataFrame, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid studies with labels, violations). Only images on disk are labelled."""
    checked = with_existence(images, files)
    violations = checked.where("NOT file_exists").select(
        "split", "subject_id", "study_id", "image_id", "image_path",
        F.lit("FILE_NOT_FOUND_ON_DISK").alias("reason"))
    if fail_fast:
        first = violations.take(1)
        if first:
            raise MissingFiles(f"image not found: {first[0].image_path} (subject {first[0].subject_id})")
    return with_report_labels(checked.where("file_exists").drop("file_exists")), violations


def ingestion_audit(patients: DataFrame, valid: DataFrame, violations: DataFrame) -> DataFrame:
    """Totals and the share of images on disk."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.lit(0).alias("_k"))
    out = one(patients, "patients").join(one(valid, "valid_studies"), "_k").join(
        one(violations, "violations"), "_k").drop("_k")
    total = F.greatest(F.lit(1), F.col("valid_studies") + F.col("violations"))
    return out.withColumn("validity_pct", F.round(F.col("valid_studies") * 100.0 / total, 2))


def join_labels_to_split(labels: DataFrame, splits: DataFrame) -> DataFrame:
    return labels.join(splits, ["subject_id", "study_id"])


def in_split(rows: DataFrame, split: str) -> DataFrame:
    return rows.where(F.lower("split") == split.lower())
