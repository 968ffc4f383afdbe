"""Queries that run a stream over the events to its end and give its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quagmark.plans.book import query, rounded
from quagmark.session import removed_at_exit, shared_folder
from quagmark.streaming import live


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream, its zoneless times as UTC."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")
    return raw.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """The table, in the shared folder, of a stream that was run over all that there is. A whole result (``complete``) is overwritten by each batch, the others grow."""
    place = f"{shared_folder(stream.sparkSession)}/quagmark-live-{uuid.uuid4().hex}"

    def batch(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/rows")

    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    removed_at_exit(stream.sparkSession, place)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")


@query("""SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    w = live.windowed(stream_of(spark, d, "events"), ["event_type"], "ts", "value", "6 hours", "1 day")
    out = finished(w, "complete")
    return rounded(out.select("event_type", "start", "mean", F.round("total", 4).alias("total"), "n"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    e = stream_of(spark, d, "events")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = finished(live.once_per_id(twice, "ts", "event_id", "1 day").select("event_id"), "append")
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
