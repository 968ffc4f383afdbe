"""Runs, chains and segments: gap-and-islands over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(on: list[str], *by) -> Window:
    return Window.partitionBy(*on).orderBy(*by)


def run_id(on: list[str], by: list, same: Column) -> Column:
    """Number, from 0, of the run that a row belongs to; a new run begins where ``same`` (a condition on this and the previous row) is not true."""
    w = ordered(on, *by)
    return F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def chain(pairs: DataFrame, on: list[str], t1: str, t2: str, est: str) -> DataFrame:
    """Increments over (t1, t2) as levels (time, seg, est): summed while a pair begins where the last ended; a segment's first epoch is 0.

    A null increment breaks the chain: it belongs to no segment.
    """
    known = pairs.where(F.col(est).isNotNull() & F.col(t1).isNotNull() & F.col(t2).isNotNull())
    w = ordered(on, t1, t2)
    joined = F.lag(t2).over(w) == F.col(t1)
    seg = known.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    seg = seg.withColumn("seg", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    level = F.sum(est).over(Window.partitionBy(*on, "seg").orderBy(t1, t2).rowsBetween(Window.unboundedPreceding, 0))
    ends = seg.select(*on, F.col(t2).alias("time"), "seg", level.alias("est"))
    starts = seg.where("__new = 1").select(*on, F.col(t1).alias("time"), "seg", F.lit(0.0).alias("est"))
    return ends.unionByName(starts)


def runs_of(rows: DataFrame, on: list[str], time: str, state: Column, min_rows: int = 1) -> DataFrame:
    """Runs of rows in which ``state`` holds: (run, first, last, n), at least ``min_rows`` long."""
    w = ordered(on, time)
    marked = rows.withColumn("__s", F.coalesce(state, F.lit(False)))
    marked = marked.withColumn("__run", run_id(on, [time], F.lag("__s").over(w) == F.col("__s"))).where("__s")
    out = marked.groupBy(*on, "__run").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    return out.withColumnRenamed("__run", "run")


def longest_run(runs: DataFrame, on: list[str]) -> DataFrame:
    """Each key's longest run; the earliest wins ties."""
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), "first", "last")).alias("b")
    return runs.groupBy(*on).agg(best).select(*on, F.col("b.first").alias("first"), F.col("b.last").alias("last"), (-F.col("b.minus_n")).alias("n"))


def steps(series: DataFrame, on: list[str], time: str, value: str, threshold: float, max_gap_s: int) -> DataFrame:
    """Rows at which the value jumps by more than ``threshold`` from a row at most ``max_gap_s`` earlier, with ``step``."""
    w = ordered(on, time)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    jumped = series.withColumns({"step": F.col(value) - F.lag(value).over(w), "__gap": gap})
    return jumped.where((F.abs("step") > threshold) & (F.col("__gap") <= max_gap_s * 1_000_000)).drop("__gap")


def sessions(rows: DataFrame, on: list[str], time: str, gap: str) -> DataFrame:
    """Stretches without a gap of ``gap`` or more: (start, end of the last row, n)."""
    w = F.session_window(F.col(time).cast("timestamp"), gap)
    return rows.groupBy(*on, w.alias("w")).agg(F.count("*").alias("n"), F.max(F.col(time).cast("timestamp")).alias("last")).select(*on, F.col("w.start").alias("first"), "last", "n")


def centred_runs(pairs: DataFrame, on: list[str], k: str, inc: str, min_len: int = 4) -> DataFrame:
    """Chained levels of successive non-null increments with each run's mean taken off; runs shorter than ``min_len`` epochs are dropped."""
    w = ordered(on, k)
    r = pairs.withColumn("run", run_id(on, [k], F.lag(inc).over(w).isNotNull() & F.col(inc).isNotNull())).where(F.col(inc).isNotNull())
    own = Window.partitionBy(*on, "run")
    r = r.withColumn("level", F.sum(inc).over(own.orderBy(k).rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("__n", F.count("*").over(own)).where(F.col("__n") >= min_len)
    return r.withColumn("level", F.col("level") - F.avg("level").over(own)).drop("__n")
