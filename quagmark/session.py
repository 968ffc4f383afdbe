"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def session(app: str = "quagmark", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume (UTC, AQE, Arrow).

    With ``cores``, or where Python was not started by spark-submit, it is local with few shuffle partitions; else the cluster's own settings stand.
    """
    builder = SparkSession.builder
    if cores is not None or not ("PYSPARK_GATEWAY_PORT" in os.environ or "SPARK_REMOTE" in os.environ or SparkSession.getActiveSession()):
        builder = builder.master(f"local[{cores or '*'}]").config("spark.sql.shuffle.partitions", "8")
    builder = (
        builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUAGMARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (tests, a local session) one is made on this machine, which goes when Python ends."""
    global _own
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not shared and _own is None:
        _own = tempfile.mkdtemp(prefix="quagmark-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return (shared or _own).rstrip("/")


def removed_at_exit(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder, from where it survives the loss of executors, and read again.

    Unlike a checkpoint of rows it is compressed, and later plans read only the columns that they need and know its size. The
    table goes when the session ends.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/quagmark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    removed_at_exit(spark, place)
    return spark.read.schema(df.schema).parquet(place)
