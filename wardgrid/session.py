"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wardgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # call-site capture costs more than planning itself for wide generated projections
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local runs that set none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="wardgrid-")
    return _LOCAL_DIRS[app]


def store_bucketed(df: DataFrame, keys: list[str], sort: list[str], buckets: int | None = None) -> DataFrame:
    """Write `df` once as a table in the shared folder, bucketed so that readers need no shuffle.

    One task writes one bucket; later jobs read only the columns they use and survive executor loss. Without `buckets`
    there are as many as shuffle partitions.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"wardgrid_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *keys).write.format("parquet")
        .bucketBy(buckets, *keys).sortBy(*sort)
        .option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    )
    return spark.table(name)


def store(df: DataFrame) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/wardgrid_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
