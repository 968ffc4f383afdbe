"""The register of runs and what they read and write."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("experiment", "phase", "pipeline")
STATES = ("active", "superseded", "removed")
SCHEMA = "id string, kind string, status string, runs_on string, code string, inputs array<string>, outputs array<string>, tickets array<string>, extra map<string,string>"


@dataclass(frozen=True)
class Entry:
    """One registered run."""

    id: str
    kind: str
    status: str = "active"
    runs_on: str = "local"
    code: str = ""
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    tickets: list[str] = field(default_factory=list)
    extra: dict[str, str] = field(default_factory=dict)


def register(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    return spark.createDataFrame([tuple(vars(e).values()) for e in entries], SCHEMA)


def problems(reg: DataFrame) -> DataFrame:
    """(id, problem): repeated ids, unknown kinds and states, active entries without code."""
    repeated = reg.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    checks = F.array_compact(F.array(
        F.when(~F.col("kind").isin(*KINDS), "unknown kind"), F.when(~F.col("status").isin(*STATES), "unknown status"),
        F.when((F.col("status") == "active") & (F.coalesce(F.col("code"), F.lit("")) == ""), "no code"),
    ))
    return repeated.unionByName(reg.select("id", F.explode(checks).alias("problem")))


def find(reg: DataFrame, ticket: str | None = None, kind: str | None = None, **extra: str) -> DataFrame:
    """Entries by ticket, kind and further fields."""
    out = reg
    if ticket is not None:
        out = out.where(F.array_contains("tickets", ticket))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    for k, v in extra.items():
        out = out.where(F.coalesce(F.try_element_at("extra", F.lit(k)) == v, F.lit(False)))
    return out


def lineage(reg: DataFrame) -> DataFrame:
    """(item, producers, consumers): which active entries write and read each file, by its base name."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    active = reg.where("status = 'active'")
    p = active.select("id", F.explode("outputs").alias("f")).groupBy(base(F.col("f")).alias("item")).agg(F.array_sort(F.collect_set("id")).alias("producers"))
    c = active.select("id", F.explode("inputs").alias("f")).groupBy(base(F.col("f")).alias("item")).agg(F.array_sort(F.collect_set("id")).alias("consumers"))
    none = F.array().cast("array<string>")
    return p.join(c, "item", "full_outer").select("item", F.coalesce("producers", none).alias("producers"), F.coalesce("consumers", none).alias("consumers"))


def summary(reg: DataFrame) -> DataFrame:
    return reg.groupBy("kind", "status").agg(F.count("*").alias("n"))
