"""Queries pN_... of the problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quagmark.llm.encode import encoded, encoder, token_counts
from quagmark.llm.nearest_time import nearest_in_days, nearest_in_time
from quagmark.llm.pack import containers
from quagmark.llm.subjects import document_subjects
from quagmark.plans.dealt import instants
from quagmark.session import checkpointed
from quagmark.sources.tables import table

HOUR_US = 3_600_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The laser reading within 60 minutes and the plot product within 2 days of each overpass."""
    when = checkpointed(instants(spark, d, ("s1_acquisitions",)).where("decided").select(F.col("rec_id").alias("acq_id"), "epoch_us"))
    overpasses = table(spark, d, "s1_acquisitions").select("acq_id", "station", "plot", "track").join(when, "acq_id").withColumn("utc_day", F.date_from_unix_date(F.floor(F.col("epoch_us") / (24 * HOUR_US)).cast("int")))
    readings = table(spark, d, "laser_at_s1").where("laser_cm IS NOT NULL").select("station", "plot", "reading_id", F.unix_micros("time_utc").alias("reading_us"))
    products = table(spark, d, "plots_acq").select("station", "plot", "track", "plot_acq_id", "date")
    lasers = nearest_in_time(overpasses, readings, ["station", "plot"], "epoch_us", "reading_us", "reading_id", HOUR_US)
    plots = nearest_in_days(overpasses, products, ["station", "plot", "track"], "utc_day", "date", "plot_acq_id", 2)
    found = lambda kind, df: df.where("match_id IS NOT NULL").select(F.lit(kind).alias("kind"), "acq_id", F.col("match_id").cast("long").alias("match_id"))
    return found("laser_at_s1", lasers).unionByName(found("plots_acq", plots))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text by byte_bpe_50k."""
    return encoded(table(spark, d, "documents"), "doc_id", "text", encoder())


#: More lanes than this are taken for a mistake: lanes are a table of settings.
MOST_LANES = 1000


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, in tokens of byte_bpe_50k, in a container of each lane."""
    lanes = [(r["lane"], r["capacity_tokens"]) for r in table(spark, d, "pack_lanes").where("lane IS NOT NULL AND capacity_tokens > 0").orderBy("lane").limit(MOST_LANES + 1).collect()]
    if len(lanes) > MOST_LANES:
        raise ValueError(f"pack_lanes has more than {MOST_LANES} rows")
    return containers(checkpointed(token_counts(table(spark, d, "documents"), "doc_id", "text", encoder())), lanes)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per lane the containers, the tokens in them and the share of their space that is used."""
    each = p7_containers(spark, d).groupBy("lane", "capacity", "container").agg(F.sum("n_tokens").alias("used"))
    out = each.groupBy("lane", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of every document."""
    subjects = table(spark, d, "subject_areas").select("subject")
    labels = table(spark, d, "subject_labels").join(subjects, "subject", "left_semi")
    return document_subjects(table(spark, d, "documents"), labels, checkpointed)


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many documents deal with each subject."""
    counts = p8_found(spark, d).groupBy("subject").agg(F.count("*").alias("n_docs"))
    return table(spark, d, "subject_areas").select("subject").join(counts, "subject", "left").na.fill(0, ["n_docs"])


def queries() -> dict:
    return {"p1_found": p1_found, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_composition": p8_composition}


def oracle_sql() -> dict[str, str]:
    return {}
