"""Leakage check by mutation: rewrite everything after an anchor, rebuild the event table, and require unchanged features.

One probe anchor per participant; each mutation is a copy of that participant's series under its own id, so all rebuilds are one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.events import FEATURES, event_table
from anchorline.session import stage
from anchorline.spec import WindowSpec

SENTINEL = 12345.0
SENSOR_FEATURES = ("baseline_glucose", "baseline_age", "trend_slope")
INVENTED = (5, 50, 120)


def _checked(kind: str) -> tuple[str, ...]:
    return SENSOR_FEATURES if kind == "sensor_after_lag" else tuple(FEATURES)


def mutate(series: DataFrame, probe: DataFrame, spec: WindowSpec) -> DataFrame:
    """Three rewritten copies of each probed participant: all numbers after t0 plus invented later anchors; the sensors after t0 - lag;
    the non-sensor covariates at and after t0."""
    s = series.join(probe.select("participant_id", F.col("us").alias("t0")), "participant_id")
    late, t = F.col("us") > F.col("t0"), F.lit(SENTINEL)
    # the 5th, 50th and 120th later unlabelled rows, by a top-120 per participant on those rows only
    w = Window.partitionBy("participant_id").orderBy("us", "row_order")
    nth = s.where(late & F.col("anchor_label").isNull()).select("participant_id", "us", "row_order").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= max(INVENTED) + 1)
    invented = nth.where(F.col("rk").isin(*[k + 1 for k in INVENTED])).select("participant_id", "row_order", F.lit(True).alias("__new"))
    s = s.join(invented, ["participant_id", "row_order"], "left")
    sensors = [c for c in ("sensor_a", "sensor_b") if c in series.columns]
    # the builder knows participants only: mutation first, so that the first mark ends it whatever an id holds
    name = lambda k: F.concat(F.lit(f"{k}#"), "participant_id").alias("participant_id")
    over = lambda cond, c: F.when(cond, t).otherwise(F.col(c)).alias(c)
    rest = ["row_order", "us"]
    after = s.select(name("all_after"), *rest, *[over(late, c) for c in (*sensors, "activity", "dose")], F.when(F.col("__new"), F.lit("Snack")).otherwise(F.col("anchor_label")).alias("anchor_label"))
    lag = s.select(name("sensor_after_lag"), *rest, *[over(F.col("us") > F.col("t0") - spec.lag_us, c) for c in sensors], "activity", "dose", "anchor_label")
    at = s.select(name("covariate_at_anchor"), *rest, *sensors, over(F.col("us") >= F.col("t0"), "activity"), "dose", "anchor_label")
    return after.unionByName(lag).unionByName(at)


def check(series: DataFrame, spec: WindowSpec, anchor_number: int = 0, builder=event_table) -> DataFrame:
    """(participant_id, mutation, rebuilt, mismatched columns, passed) for the `anchor_number`-th usable anchor of every participant."""
    base = stage(builder(series, spec), "leakage-base")
    # the nth by (time, event): n is small, so Spark keeps only the first rows of each participant before the exchange
    rk = F.row_number().over(Window.partitionBy("participant_id").orderBy("us", "event_id"))
    first = base.select("participant_id", "event_id", "us").withColumn("rk", rk).where(F.col("rk") <= anchor_number + 1)
    probe = stage(first.where(F.col("rk") == anchor_number + 1).select("participant_id", "us"), "probes")
    rebuilt = builder(stage(mutate(series, probe, spec), "mutated"), spec)
    at = F.instr("participant_id", "#")
    own = F.substring(F.col("participant_id"), at + 1, F.length("participant_id"))
    re = rebuilt.select(own.alias("participant_id"), F.substring_index("participant_id", "#", 1).alias("mutation"), "us", F.struct(*FEATURES).alias("new"))
    want = base.join(probe, ["participant_id", "us"], "left_semi").select("participant_id", "us", F.struct(*FEATURES).alias("old"))
    kinds = ("all_after", "sensor_after_lag", "covariate_at_anchor")
    want = want.withColumn("mutation", F.explode(F.array(*[F.lit(k) for k in kinds])))
    j = want.join(re, ["participant_id", "mutation", "us"], "left")
    bad = [F.when(F.col("mutation").isin(*[k for k in kinds if f in _checked(k)]) & ~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in FEATURES]
    j = j.withColumn("mismatched", F.array_compact(F.array(*bad)))
    return j.select("participant_id", "mutation", F.col("new").isNotNull().alias("rebuilt"), F.when(F.col("new").isNotNull(), F.concat_ws(",", "mismatched")).alias("mismatched"),
                    (F.col("new").isNotNull() & (F.size("mismatched") == 0)).alias("passed"))


def tally(result: DataFrame) -> DataFrame:
    return result.groupBy("mutation", "rebuilt", "passed").agg(F.count(F.lit(1)).alias("n_participants"))

