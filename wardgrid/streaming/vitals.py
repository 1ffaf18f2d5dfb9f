"""Live vitals with Structured Streaming.

Every function takes a streaming (or batch) DataFrame of frames with `patient_id`, `ts` and the
live-vitals columns. Late rows: the watermark is one grid step beyond the longest expected charting
delay; what arrives later is dropped by the windowed and de-duplicating operators.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardgrid.functions import clinical as cl
from wardgrid.functions import fixed_values as fx
from wardgrid.operators.scoring import apply_anomalies, apply_overrides, derived_vitals
from wardgrid.session import shared_dir, store

BUFFER = 24
#: Files of a micro-batch, so that it takes all new ones.
ALL_NEW = 2 ** 31 - 1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_step: int = 1,
           fmt: str = "parquet", **options) -> DataFrame:
    """Frames replayed from files; `files_per_step` sets the pace."""
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern).option(
        "maxFilesPerTrigger", files_per_step)
    return reader.options(**options).load(folder)


def messages(frames: DataFrame, risk: str = "risk") -> DataFrame:
    """One enriched message per frame: derived vitals, early-warning score, risk."""
    scored = derived_vitals(frames).withColumn("_news2", cl.news2())
    return scored.withColumns({
        "news2_score": F.col("_news2.total_score"), "news2_tier": F.col("_news2.risk_tier"),
        "health_risk_score": F.round(F.col(risk), 4)}).drop("_news2")


def with_anomalies(frames: DataFrame, controls: DataFrame) -> DataFrame:
    """Stream-static join with the control table (one row per patient)."""
    return apply_anomalies(frames, controls)


def with_overrides(frames: DataFrame, overrides: DataFrame) -> DataFrame:
    return apply_overrides(frames, overrides)


def alerts(frames: DataFrame, risk: str = "risk", delay: str = "1 hour") -> DataFrame:
    """Alerts above the risk threshold, one per patient and second."""
    hot = frames.where(F.col(risk) > fx.ALERT_RISK).withColumn("second", F.date_trunc("second", "ts"))
    return hot.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["patient_id", "second"])


def grid_means(readings: DataFrame, channels: Sequence[str], step: str = "15 minutes",
               delay: str = "30 minutes") -> DataFrame:
    """Incremental grid: mean per stay, tumbling window and channel; a closed window never changes."""
    return readings.withWatermark("charttime", delay).groupBy("stay_id", F.window("charttime", step)).agg(*[
        F.avg(F.when(F.col("channel") == c, F.col("valuenum"))).alias(c) for c in channels])


class NewestFrames(StatefulProcessor):
    """Keeps the newest frames of a patient by event time; a late frame older than all kept ones is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = ", ".join(f"{c} double" for c in fx.LIVE_VITALS)
        self.kept = handle.getListState("kept", f"ts timestamp, ord long, {columns}")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["ts", "ord", *fx.LIVE_VITALS]
        newest = pd.DataFrame(list(self.kept.get()), columns=names)
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for batch in rows:  # only BUFFER frames are ever held
            seen += len(batch)
            joined = batch[names] if newest.empty else pd.concat([newest, batch[names]])
            newest = joined.sort_values(["ts", "ord"], kind="stable").tail(BUFFER)
        values = newest[list(fx.LIVE_VITALS)].astype("float64")
        newest = newest.assign(**values)
        self.kept.put([
            (t.to_pydatetime(), int(o), *(None if pd.isna(v) else float(v) for v in rest))
            for t, o, *rest in newest.itertuples(index=False)])
        self.seen.update((seen,))
        filled = values.fillna({c: fx.LIVE_BASELINE[c] for c in fx.LIVE_VITALS})
        yield pd.DataFrame({
            "patient_id": [key[0]], "size": [len(newest)], "newest": [newest["ts"].iloc[-1]], "seen": [seen],
            "matrix": [filled.to_numpy().tolist()]})

    def close(self) -> None:
        pass


def buffers(frames: DataFrame) -> DataFrame:
    """After each micro-batch: the newest 24 frames of every touched patient as a matrix.

    `seen` counts the patient's frames so far. Missing vitals take the channel's baseline. Needs an `ord` column that breaks equal times, and
    the RocksDB state store.
    """
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = frames.select("patient_id", "ts", "ord", *[F.col(c).cast("double").alias(c) for c in fx.LIVE_VITALS])
    return rows.groupBy("patient_id").transformWithStateInPandas(
        NewestFrames(), "patient_id long, size int, newest timestamp, seen long, matrix array<array<double>>", "Append", "None")


def last_buffers(rows: DataFrame) -> DataFrame:
    """The last matrix of each patient over all micro-batches."""
    rest = [c for c in rows.columns if c != "patient_id"]
    return rows.groupBy("patient_id").agg(F.max_by(F.struct(*rest), "seen").alias("_r")).select("patient_id", "_r.*")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is available into a parquet table with its own checkpoint, and read it back.

    Run again with the same name, it goes on where it stopped.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_to_end(stream: DataFrame, name: str, folder: str, mark: DataFrame) -> DataFrame:
    """`run_to_table` for an input that has ended: windows still open are closed as well.

    `mark` is one input row whose time lies beyond every window and delay. It goes to the input's folder after all else has
    been read and moves the watermark past the open windows; its own window never closes.
    """
    run_to_table(stream, name)
    mark.coalesce(1).write.mode("append").parquet(folder)
    return run_to_table(stream, name)


def latest_state(frames: DataFrame, order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Latest frame per patient: one row a patient in the newest of numbered snapshots.

    The stream's state holds each patient's newest frame, and a micro-batch passes on the patients that changed. They replace
    their rows of the snapshot before, so that a snapshot is complete, and a replayed batch writes its own again. The log
    names the finished snapshots; a reader opens the last one only, and those before its predecessor are emptied.
    """
    spark = frames.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}"
    whole = F.struct(*[c for c in columns])
    newest = frames.groupBy("patient_id").agg(F.max_by(whole, F.struct(*order)).alias("_r")).select("patient_id", "_r.*")

    def upsert(batch: DataFrame, version: int) -> None:
        batch = store(batch)
        before = snapshot(spark, base, version)
        rows = batch if before is None else batch.unionByName(before.join(batch.select("patient_id"), "patient_id", "left_anti"))
        rows.write.mode("overwrite").parquet(f"{base}/snapshot/{version}")
        spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{base}/log")
        if version >= 2:
            batch.limit(0).write.mode("overwrite").parquet(f"{base}/snapshot/{version - 2}")

    newest.writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return snapshot(spark, base)


def snapshot(spark: SparkSession, base: str, below: int | None = None) -> DataFrame | None:
    """The newest finished snapshot, or the newest one before version `below`; None without one."""
    try:
        log = spark.read.schema("version long").parquet(f"{base}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = log.where(F.lit(True) if below is None else F.col("version") < below).agg(F.max("version")).first()[0]
    return None if last is None else spark.read.parquet(f"{base}/snapshot/{last}")
