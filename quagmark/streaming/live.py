"""Streams: late readings into daily buckets, chains kept as state, idempotent intake."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, on: list[str], time: str, value: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Mean, sum and count per key and event-time window; readings later than ``late`` are left out, and state older than that is dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    g = stream.withWatermark(time, late).groupBy(*on, w.alias("w")).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("n"))
    return g.select(*on, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "total", "n")


def once_per_id(stream: DataFrame, time: str, rec_id: str, late: str) -> DataFrame:
    """The stream without readings that came before."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([rec_id])


def chained(stream: DataFrame, key: str, t1: str, t2: str, est: str) -> DataFrame:
    """Pairs (t1, t2 in order of arrival) chained to levels: the last end, segment and level of a key are its state."""
    kind = stream.schema[key].dataType.simpleString()
    stamp = stream.schema[t2].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, seg, level = state.get if state.exists else (None, -1, 0.0)
        for pdf in batches:
            out = []
            for a, b, x in pdf.sort_values([t1, t2])[[t1, t2, est]].itertuples(index=False, name=None):
                if pd.isna(x):
                    end = None
                    continue
                if end is None or pd.Timestamp(a).value // 1000 != end:
                    seg, level = seg + 1, 0.0
                level += x
                end = pd.Timestamp(b).value // 1000
                out.append((k[0], b, seg, level))
            yield pd.DataFrame(out, columns=[key, "time", "seg", "level"])
        state.update((end, seg, level))

    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, time {stamp}, seg int, level double", "end long, seg int, level double", "append", GroupStateTimeout.NoTimeout)


def take_in(stream: DataFrame, target: str, key: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Starts a query that appends to a parquet table the rows whose key it does not have, so that a repeated batch changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        new = prepare(df).dropDuplicates([key])
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # before the first batch; any fault in reading stops the stream
            new.write.mode("append").parquet(target)
            return
        have = spark.read.parquet(target).select(key)
        new.join(have, key, "left_anti").write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
