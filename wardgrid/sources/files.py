"""File listings: table availability and image existence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path below root, length) of all files; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", pattern).load(root)
    inner = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    return files.select(F.substring_index(inner, root.rstrip("/") + "/", -1).alias("path"), "length")


def availability(spark: SparkSession, files: DataFrame, dataset: str,
                 tables: Sequence[str] = tuple(fx.REQUIRED_TABLES + fx.OPTIONAL_TABLES)) -> DataFrame:
    """Expected tables with existence and size; the uncompressed name counts as well."""
    expected = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "position int, table_name string")
    names = expected.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), F.col("table_name").alias("path")),
        F.struct(F.lit(1).alias("rank"), F.regexp_replace("table_name", r"\.gz$", "").alias("path")))).alias("c"))
    hit = names.select("position", "table_name", "c.*").join(files, "path", "left")
    return hit.groupBy("position", "table_name").agg(
        F.count("length").cast("boolean").alias("present"),
        F.coalesce(F.min_by("length", F.when(F.col("length").isNotNull(), F.col("rank"))), F.lit(0)).alias("size_bytes"),
    ).select(F.lit(dataset).alias("dataset"), "table_name", "present", "size_bytes")


def availability_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("dataset").agg(
        F.count_if("present").alias("available"), F.count_if(~F.col("present")).alias("missing"),
        F.sum("size_bytes").alias("size_bytes"))


def with_existence(rows: DataFrame, files: DataFrame, path: str = "image_path") -> DataFrame:
    """Add `file_exists`: listed paths are distinct, so the left join never fans out."""
    present = files.select(F.col("path").alias(path), F.lit(True).alias("_there"))
    return rows.join(present, path, "left").withColumn(
        "file_exists", F.coalesce("_there", F.lit(False))).drop("_there")


def resolve_candidates(rows: DataFrame, files: DataFrame, key: Sequence[str]) -> DataFrame:
    """First existing of four candidate places per image, or NULL.

    Columns: image_path, subject_id, study_id, image_id (text).
    """
    subject = F.col("subject_id").cast("string")
    prefix = F.when(F.length(subject) >= 2, F.concat(F.lit("p"), F.substring(subject, 1, 2))).otherwise("p10")
    folder = F.concat_ws("/", prefix, F.concat(F.lit("p"), subject), F.concat(F.lit("s"), F.col("study_id")),
                         F.concat(F.col("image_id"), F.lit(".jpg")))
    direct = F.when(F.col("image_path").startswith("files/"), F.col("image_path"))
    candidates = F.array(direct, F.concat(F.lit("files/"), folder), folder,
                         F.concat(F.col("image_id"), F.lit(".jpg")))
    tried = rows.select(*key, F.posexplode(candidates).alias("priority", "path")).where("path IS NOT NULL")
    found = tried.join(files.select("path"), "path").groupBy(*key).agg(
        F.min_by("path", "priority").alias("resolved_path"))
    return rows.join(found, list(key), "left")


def file_audit(rows: DataFrame, path: str = "image_path") -> DataFrame:
    """Referenced, present, missing, availability in percent and repeated references of present files."""
    per_path = rows.groupBy(path, "file_exists").agg(F.count(F.lit(1)).alias("_n"))
    out = per_path.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("referenced"),
        F.coalesce(F.sum(F.when(F.col("file_exists"), F.col("_n"))), F.lit(0)).alias("on_disk"),
        F.coalesce(F.sum(F.when(F.col("file_exists"), F.col("_n") - 1)), F.lit(0)).alias("duplicate_references"))
    return out.withColumns({
        "missing": F.col("referenced") - F.col("on_disk"),
        "available_pct": F.round(F.col("on_disk") * 100.0 / F.greatest("referenced", F.lit(1)), 2)})


def first_per_subject(rows: DataFrame, position: str) -> DataFrame:
    """The first row of each subject in file order."""
    rest = [c for c in rows.columns if c != "subject_id"]
    best = rows.groupBy("subject_id").agg(F.min_by(F.struct(*rest), position).alias("_r"))
    return best.select("subject_id", "_r.*")


def newest_first(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Row cap in a fixed order (a report's first n rows)."""
    return rows.orderBy(order).limit(n)


