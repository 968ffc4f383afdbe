"""Data contracts, coverage, differences of tables, manifests of what was already taken in."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """A table's unique key, the columns that it must have, and inclusive ranges of values."""

    keys: list[str]
    required: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)


# The contracts of the gold tables.
GOLD = {
    "plots_acq": Contract(["track", "date", "plot"], ["time_utc", "period", "unit", "row", "col", "air_c", "flag_wet_any", "flag_frozen_air"], {"vv_db_3x3": (-40, 15), "vh_db_3x3": (-45, 10), "rvi_3x3": (0, 4), "air_c": (-40, 45), "wtd_at": (-200, 80), "s2_ndvi_3x3": (-1, 1), "s2_ndmi_3x3": (-1, 1), "lst_c_3x3": (-40, 70), "uav_ndvi": (-1, 1), "uav_lai": (0, 15), "s2_lag_days": (-10, 10), "lst_lag_days": (-16, 16), "uav_lag_days": (-30, 30), "eco_lst_c_3x3": (-40, 70)}),
    "plots_pair": Contract(["period", "track", "grid", "pair", "plot"], ["t1", "t2", "revisit_days", "wrapped_1x1", "unw_1x1", "coh_1x1", "ref_stable_unw", "ref_grassland_unw", "fold_year"], {"revisit_days": (1, 800), "coh_1x1": (0, 1), "coh_3x3": (0, 1), "wrapped_1x1": (-math.pi, math.pi), "wrapped_3x3": (-math.pi, math.pi), "consistency_3x3": (0, 1 + 1e-9), "rain_sum_mm": (0, 3000)}),
    "triangles": Contract(["period", "track", "grid", "p12", "p23", "p13", "unit"], ["closure_wrapped", "closure_consistency", "cycle_share"], {"closure_wrapped": (-math.pi, math.pi), "closure_consistency": (0, 1 + 1e-9), "cycle_share": (0, 1)}),
    "truth_laser_daily": Contract(["date"], ["surface_cm", "n_ok_hours"], {"surface_cm": (-100, 100), "n_ok_hours": (0, 24)}),
}


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(problem, column, n): missing columns; if there are none, surplus rows of a key and values outside their range (null and NaN never are)."""
    spark = df.sparkSession
    missing = [c for c in [*contract.keys, *contract.required] if c not in df.columns]
    schema = "problem string, column string, n long"
    if missing:
        return spark.createDataFrame([("missing column", c, 1) for c in missing], schema)
    bad = {c: (F.col(c) < lo) | ((F.col(c) > hi) & ~F.isnan(F.col(c).cast("double"))) for c, (lo, hi) in contract.ranges.items() if c in df.columns}
    # one pass: counts per key, added up
    per_key = df.groupBy(*contract.keys).agg((F.count("*") - 1).alias("__extra"), *(F.count_if(cond).alias(f"__{c}") for c, cond in bad.items()))
    total = per_key.agg(F.coalesce(F.sum("__extra"), F.lit(0)).alias("__extra"), *(F.coalesce(F.sum(f"__{c}"), F.lit(0)).alias(f"__{c}") for c in bad))
    items = [F.struct(F.lit("repeated key").alias("problem"), F.lit(",".join(contract.keys)).alias("column"), F.col("__extra").alias("n"))]
    items += [F.struct(F.lit("out of range").alias("problem"), F.lit(c).alias("column"), F.col(f"__{c}").alias("n")) for c in bad]
    return total.select(F.inline(F.array(*items))).where("n > 0")


def coverage(df: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Rows per key and the share of known values of each column."""
    return df.groupBy(*on).agg(F.count("*").alias("n"), *((F.count(c) / F.count("*")).alias(f"{c}_share") for c in columns))


def table_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per column the number of keys whose value differs (both null is equal, numbers within ``tolerance`` too), and keys on one side only."""
    o = old.select(*keys, *(F.col(c).alias(f"__o_{c}") for c in columns), F.lit(1).alias("__in_o"))
    n = new.select(*keys, *(F.col(c).alias(f"__n_{c}") for c in columns), F.lit(1).alias("__in_n"))
    j = o.join(n, keys, "full_outer")
    both = F.col("__in_o").isNotNull() & F.col("__in_n").isNotNull()
    numeric = {f.name for f in old.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")}
    same = lambda c: F.col(f"__o_{c}").eqNullSafe(F.col(f"__n_{c}")) | (F.coalesce(F.abs(F.col(f"__o_{c}") - F.col(f"__n_{c}")) <= tolerance, F.lit(False)) if c in numeric else F.lit(False))
    counts = j.agg(*(F.count_if(both & ~same(c)).alias(c) for c in columns), F.count_if(F.col("__in_n").isNull()).alias("__gone"), F.count_if(F.col("__in_o").isNull()).alias("__added"))
    items = [F.struct(F.lit(label).alias("column"), F.col(c).alias("n")) for c, label in [*((c, c) for c in columns), ("__gone", "only in old"), ("__added", "only in new")]]
    return counts.select(F.inline(F.array(*items)))


def joined_once(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that must be one to one: a key that either side has twice ends the query with an error, in the join's own plan and pass."""
    once = lambda df: df.withColumn("__twice", F.count("*").over(Window.partitionBy(*keys)))
    fail = F.when(F.coalesce(F.greatest("__twice", "__twice_right"), F.lit(1)) > 1, F.raise_error(F.concat(F.lit("key occurs twice: "), F.to_json(F.struct(*keys)))))
    both = once(left).join(once(right).withColumnRenamed("__twice", "__twice_right"), keys, how)
    return both.where(fail.cast("string").isNull()).drop("__twice", "__twice_right")


def presence(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Every key of the named sets with a flag for each, by one union and one aggregate."""
    tagged = [df.select(F.col(key).alias("key")).distinct().withColumn("__s", F.lit(name)) for name, df in sets.items()]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy("key").agg(*(F.max((F.col("__s") == name).cast("int")).alias(f"in_{name}") for name in sets)).withColumnRenamed("key", key)


def has_all(df: DataFrame, key: str, level: str, wanted: list) -> DataFrame:
    """The keys that occur with every one of the wanted levels (relational division)."""
    return df.where(F.col(level).isin(*wanted)).groupBy(key).agg(F.count_distinct(level).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def not_yet(items: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Items that the manifest of earlier runs does not have."""
    return items.join(manifest.select(key).distinct(), key, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
