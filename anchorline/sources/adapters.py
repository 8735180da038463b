"""Views of the supplied tables in the engine's own shape: a sensor series and an event cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c) -> "F.Column":
    return F.unix_micros(F.col(c).cast("timestamp"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse sensor series: one row per reading, several channels, anchors carry a label and a dose."""
    t = F.col("event_type")
    v = F.col("value")
    label = (F.when(F.col("event_id") % 5 == 0, " Breakfast").when(F.col("event_id") % 5 == 1, "lunch")
             .when(F.col("event_id") % 5 == 2, "Snack 1").when(F.col("event_id") % 5 == 3, "DINNER").otherwise("brunch"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("participant_id"), F.col("event_id").alias("row_order"), micros("ts").alias("us"),
        F.when(t.isin("view", "click", "error"), v).alias("sensor_a"),
        F.when(t.isin("view", "error"), v * F.lit(1.1)).alias("sensor_b"),
        F.when(t == "signup", v).alias("activity"),
        F.when(t == "purchase", label).alias("anchor_label"),
        F.when(t == "purchase", F.regexp_extract("props", "([0-9]+)", 1).cast("double")).alias("dose"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: participant, event, microsecond time, dose, activity, baseline, rise, label, group."""
    lines = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.sum("l_extendedprice").alias("ep")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", micros("o_orderdate").alias("us"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp"))
    base = F.round(90 + 400 * F.col("t"), 6)
    rise = F.round(F.col("ep") / 3000, 6)
    return orders.join(lines, "o_orderkey").join(people, "o_custkey").select(
        F.col("o_custkey").cast("string").alias("participant_id"), F.col("o_orderkey").cast("string").alias("event_id"), "us",
        F.col("q").alias("carbs_g"), F.round(1 + 20 * F.col("d"), 6).alias("activity_level"), base.alias("baseline_glucose"),
        rise.alias("peak_glucose_rise"), F.when(base + rise >= 180 - 1e-6, 1).otherwise(0).alias("label_exceeds_180"), "grp")
