"""Sinks: append-only tables, reports, logs and the window dataset."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE_COLUMNS = {
    "id": "Patient ID", "mrn": "MRN", "name": "Name", "age": "Age", "gender": "Gender",
    "length_of_stay_days": "LOS (days)", "primary_diagnosis": "Diagnosis", "cxr_finding": "CXR Finding",
    "peak_risk": "Peak Risk (%)", "final_risk": "Final Risk (%)", "disposition": "Disposition",
}


def new_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], position: str | None = None) -> DataFrame:
    """Incoming rows whose key is not stored yet, NULL keys matching NULL.

    Of rows with one key the first by `position` is taken, and the first by all columns without it or where it ties.
    """
    marked = existing.select(*[F.col(k).alias(f"_e_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    whole = F.struct(*incoming.columns)
    first = F.struct(F.col(position), whole) if position else F.struct(whole)
    once = incoming.groupBy(*keys).agg(F.min_by(whole, first).alias("_r")).select("_r.*")
    return once.join(marked, same, "left_anti")


def _committed(spark: SparkSession, path: str) -> DataFrame | None:
    """(batch, n) of the finished batches; None before the first."""
    try:
        return spark.read.schema("batch string, n long").parquet(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_appended(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of finished batches; what a broken run left is not seen. None before the first batch."""
    log = _committed(spark, path)
    if log is None:
        return None
    # one row a batch; a broken batch's folder has none
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.withColumn("batch", F.col("batch").cast("string")).join(log.select("batch"), "batch", "left_semi").drop("batch")


def append_batch(incoming: DataFrame, path: str, keys: Sequence[str], batch: str, position: str | None = None) -> int:
    """Append rows with unseen keys as batch `batch`; returns how many were added, 0 for a batch that is already there.

    Rows go to the batch's own folder first, over what a broken run of it left there, and count only once the log names the
    batch. Earlier batches are read for their keys alone, and no row is counted but the new ones.
    """
    spark, path = incoming.sparkSession, path.rstrip("/")
    log = _committed(spark, path)
    if log is not None and not log.where(F.col("batch") == batch).isEmpty():
        return 0
    before = read_appended(spark, path)
    fresh = new_rows(incoming, incoming.limit(0) if before is None else before.select(*keys), keys, position)
    folder = f"{path}/rows/batch={batch}"
    fresh.write.mode("overwrite").parquet(folder)
    added = spark.read.schema(incoming.schema).parquet(folder).count()
    spark.createDataFrame([(batch, added)], "batch string, n long").coalesce(1).write.mode("append").parquet(f"{path}/log")
    return added


def append_new(incoming: DataFrame, path: str, keys: Sequence[str]) -> int:
    """`append_batch` as a batch of its own: a second run with the same rows adds nothing."""
    return append_batch(incoming, path, keys, uuid.uuid4().hex)


def write_shards(rows: DataFrame, path: str, ids: Sequence[str], shards: int = 16, seed: int = 42, group: str = "split") -> None:
    """Rows in a seeded random order over `shards` files a group, with a manifest of rows and digest for each.

    A row's shard and place follow from a hash of its ids, so the same rows always give the same shards. The digest is the
    exclusive or of the hashes of the shard's rows and does not depend on their order.
    """
    order = F.xxhash64(*ids, F.lit(seed))
    placed = rows.withColumn("shard", F.pmod(order, F.lit(shards)).cast("int")).withColumn("_order", order)
    (placed.repartition(group, "shard").sortWithinPartitions(group, "shard", "_order", *ids).drop("_order")
     .write.mode("overwrite").partitionBy(group, "shard").parquet(f"{path.rstrip('/')}/rows"))
    _digests(placed.drop("_order"), group).write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest")


def _digests(rows: DataFrame, group: str) -> DataFrame:
    values = [c for c in sorted(rows.columns) if c not in (group, "shard")]
    return rows.groupBy(F.col(group).cast("string").alias(group), "shard").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*values)).alias("digest"))


def verify_shards(spark: SparkSession, path: str, group: str = "split") -> DataFrame:
    """(group, shard, n, found, bytes, sound): the manifest beside the rows and bytes that the shards hold now."""
    root = path.rstrip("/")
    found = _digests(spark.read.parquet(f"{root}/rows"), group).select(
        group, "shard", F.col("n").alias("found"), F.col("digest").alias("_digest"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{root}/rows")
    sizes = files.groupBy(F.regexp_extract("path", rf"/{group}=([^/]*)/", 1).alias(group),
                          F.regexp_extract("path", "/shard=([0-9]+)/", 1).cast("int").alias("shard")).agg(F.sum("length").alias("bytes"))
    both = spark.read.parquet(f"{root}/manifest").join(found, [group, "shard"], "full").join(sizes, [group, "shard"], "left")
    return both.select(group, "shard", "n", "found", "bytes",
                       F.coalesce((F.col("n") == F.col("found")) & (F.col("digest") == F.col("_digest")), F.lit(False)).alias("sound"))


def write_json_report(report: DataFrame, path: str) -> None:
    """A one-row nested report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_csv_report(report: DataFrame, path: str) -> None:
    """A small report table as one CSV file with a header."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def violation_lines(violations: DataFrame, time: str = "") -> DataFrame:
    stamp = F.lit(time) if time else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return violations.select(F.format_string(
        "[%s] VIOLATION | Split: %s | Subject: %s | Study: %s | Attempted Path: %s | Reason: %s",
        stamp, "split", "subject_id", "study_id", "image_path", "reason").alias("value"))


def write_violation_log(violations: DataFrame, path: str) -> None:
    violation_lines(violations).write.mode("overwrite").text(path)


def archive_export(records: DataFrame) -> DataFrame:
    """The eleven archive columns under their printed names."""
    return records.select(*[
        (F.col(c) if c in records.columns else F.lit(None).cast("string")).alias(title)
        for c, title in ARCHIVE_COLUMNS.items()])


def write_windows(windows: DataFrame, path: str) -> None:
    """Window dataset as parquet, one folder per split."""
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_windows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df
