"""Sensor series -> anchored event table.

Every look-back and look-ahead of an anchor is bounded, so a participant's series is cut into time slices and each reading is copied into
the few slices whose anchors can see it. One exchange on (participant, slice) then serves de-duplication, the previous-valid-reading lag
and the anchor range join, and a participant holding a third of all rows is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.functions.labels import normalize_meal_type
from anchorline.functions.numeric import clean
from anchorline.session import stage
from anchorline.spec import WindowSpec

# fixed values: reason and flag texts
INVALID_TIME = "invalid_meal_timestamp"
CHANNEL_MISSING = "cgm_channel_missing"
TOO_FEW = "too_few_readings"
LEADING = "leading_gap_exceeds_limit"
INTERNAL = "internal_gap_exceeds_limit"
TRAILING = "incomplete_window_end"
BASELINE_MISSING = "baseline_missing"
CARBS_MISSING = "carbs_missing"
OVERLAP = "overlapping_meal_window"
ACTIVITY_MISSING = "activity_missing_or_low_coverage"

FEATURES = ["carbs_g", "baseline_glucose", "baseline_age", "trend_slope", "activity_level", "activity_coverage", "time_since_last",
            "activity_short", "activity_short_coverage", "activity_long", "activity_long_coverage", "label_norm"]
OUTCOMES = ["peak_glucose", "peak_glucose_rise", "label_exceeds", "n_window_readings", "window_completeness"]
ELIGIBILITY = ["overlaps_prior", "overlaps_next", "isolated", "eligible_core", "eligible_activity", "ineligible_reasons", "data_quality_flag"]
RETAINED_RAW = ["amount_consumed_raw"]
MACROS = ["protein_g", "fat_g", "fiber_g", "calories"]

_LAST_SLICE = 1 << 62
#: Readings of a task. A session that shuffles to too few partitions for that gets more in the one exchange of the readings.
TASK_ROWS = 1 << 17


def duplicate_timestamps(df: DataFrame) -> DataFrame:
    """Rows beyond the first at one (participant, time): what the strict policy refuses."""
    return (df.where(F.col("us").isNotNull()).groupBy("participant_id", "us").agg((F.count(F.lit(1)) - 1).alias("extra"))
            .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows")))


def _anchors(df: DataFrame, spec: WindowSpec) -> DataFrame:
    have = set(df.columns)
    extra = [c for c in MACROS + RETAINED_RAW if c in have]
    flag = F.col("has_channel") if "has_channel" in have else F.lit(spec.channel in have)
    slice_ = F.coalesce(F.floor(F.col("us") / F.lit(spec.chunk_us)).cast("bigint"), F.lit(_LAST_SLICE))
    return df.where(F.col("anchor_label").isNotNull()).select(
        "participant_id", slice_.alias("slice"), F.col("row_order").alias("a_row"), F.col("us").alias("t0"), "anchor_label",
        clean("dose").alias("carbs_g"), flag.alias("has_channel"), *extra)


def _sliced_readings(df: DataFrame, spec: WindowSpec) -> DataFrame:
    width = F.lit(spec.chunk_us)
    sensor = clean(F.col(spec.channel).cast("double")) if spec.channel in df.columns else F.lit(None).cast("double")
    act = clean(F.col("activity").cast("double")) if "activity" in df.columns else F.lit(None).cast("double")
    rows = df.where(F.col("us").isNotNull()).select(
        "participant_id", "us", "row_order", sensor.alias("v"), act.alias("act"),
        F.explode(F.sequence(F.floor((F.col("us") - spec.window) / width).cast("bigint"),
                             F.floor((F.col("us") + spec.lookback) / width).cast("bigint"))).alias("slice"))
    tasks = -(-df.count() // TASK_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, "participant_id", "slice")
    same_time = Window.partitionBy("participant_id", "slice", "us").orderBy("row_order")
    before = Window.partitionBy("participant_id", "slice").orderBy("us", "row_order").rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.withColumn("kept", F.row_number().over(same_time) == 1)
    return kept.withColumn("valid_us", F.when(F.col("kept") & F.col("v").isNotNull(), F.col("us"))).withColumn(
        "prev_valid", F.last("valid_us", ignorenulls=True).over(before))


def _observe(anchors: DataFrame, readings: DataFrame, spec: WindowSpec) -> DataFrame:
    """Range join inside a slice and one conditional aggregate per anchor; no exchange beyond the slice's own."""
    t, t0 = F.col("us"), F.col("t0")
    timed = anchors.where(t0.isNotNull())
    pairs = readings.join(timed, ["participant_id", "slice"]).where((t >= t0 - spec.lookback) & (t <= t0 + spec.window))
    inside = F.col("kept") & (t >= t0)
    valid_in = inside & F.col("v").isNotNull()
    cutoff = t0 - spec.lag_us
    base_row = F.col("kept") & F.col("v").isNotNull() & (t <= cutoff) & (t >= t0 - spec.lag_us - spec.extra_age)
    in_trend = (t <= cutoff) & (t >= cutoff - spec.trend) & F.col("v").isNotNull()
    aggs: list[Column] = [
        F.max((t == t0) & (F.col("row_order") < F.col("a_row"))).alias("dropped"),
        F.count_if(inside).alias("n_rows"), F.count_if(valid_in).alias("n_valid"),
        F.min(F.when(valid_in, t)).alias("first_valid"), F.max(F.when(valid_in, t)).alias("last_valid"),
        F.max(F.when(valid_in & (F.col("prev_valid") >= t0), t - F.col("prev_valid"))).alias("max_gap"),
        F.max(F.when(valid_in & (t > t0), F.col("v"))).alias("peak"), F.count_if(valid_in & (t > t0)).alias("n_after"),
        F.max(F.when(base_row, F.struct(t.alias("us"), F.col("v").alias("v")))).alias("base"),
        F.count_if(in_trend).alias("n_trend"),
        F.regr_slope(F.when(in_trend, F.col("v")), F.when(in_trend, (t - cutoff) / spec.unit)).alias("slope"),
    ]
    for i, h in enumerate(spec.activity):
        span = (t < t0) & (t >= t0 - h) & F.col("act").isNotNull()
        aggs += [F.avg(F.when(span, F.col("act"))).alias(f"act{i}"), F.count_if(span).alias(f"n_act{i}")]
    keep = [c for c in anchors.columns if c not in ("participant_id", "slice", "a_row")]
    return pairs.groupBy("participant_id", "slice", "a_row").agg(*[F.any_value(c).alias(c) for c in keep], *aggs)


def _neighbours(obs: DataFrame) -> DataFrame:
    """Ordinal and nearest anchors on each side, two-level over the time slices."""
    per = obs.groupBy("participant_id", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("lo"), F.max("t0").alias("hi"))
    w = Window.partitionBy("participant_id").orderBy("slice")
    per = per.select("participant_id", "slice", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
                     F.lag("hi").over(w).alias("__hi"), F.lead("lo").over(w).alias("__lo"))
    local = Window.partitionBy("participant_id", "slice").orderBy(F.col("t0").asc_nulls_last(), "a_row")
    return (obs.join(per, ["participant_id", "slice"])
            .withColumn("ordinal", F.row_number().over(local) - 1 + F.col("__off"))
            .withColumn("prev_t0", F.when(F.col("t0").isNotNull(), F.coalesce(F.lag("t0").over(local), F.col("__hi"))))
            .withColumn("next_t0", F.when(F.col("t0").isNotNull(), F.coalesce(F.lead("t0").over(local), F.col("__lo"))))
            .drop("__off", "__hi", "__lo"))


def resolve_anchors(df: DataFrame, spec: WindowSpec) -> DataFrame:
    """Every anchor row that survives de-duplication, with all window facts and its list of extraction failures."""
    anchors = _anchors(df, spec)
    seen = _observe(anchors, _sliced_readings(df, spec), spec).where(~F.col("dropped"))
    untimed = anchors.where(F.col("t0").isNull())
    # anchors are a small share of the series; staged, because the two-level neighbour step and both output tables read them
    obs = _neighbours(stage(seen.unionByName(untimed, allowMissingColumns=True), "anchors"))
    unit = F.lit(float(spec.unit))
    few = F.col("n_valid") < 2
    leading = F.when(~few, (F.col("first_valid") - F.col("t0")) / unit)
    internal = F.when(~few, F.col("max_gap") / unit)
    trailing = F.when(~few, (F.col("t0") + spec.window - F.col("last_valid")) / unit)
    limit = spec.max_gap / spec.unit
    reasons = (
        F.when(F.col("t0").isNull(), F.array(F.lit(INVALID_TIME)))
        .when(~F.col("has_channel"), F.array(F.lit(CHANNEL_MISSING)))
        .when(few, F.array(F.lit(TOO_FEW)))
        .otherwise(F.array_compact(F.array(F.when(leading > limit, F.lit(LEADING)), F.when(internal > limit, F.lit(INTERNAL)),
                                           F.when(trailing > spec.trailing / spec.unit, F.lit(TRAILING))))))
    return (obs.withColumn("leading_gap", leading).withColumn("internal_gap", internal).withColumn("trailing_gap", trailing)
            .withColumn("reasons", reasons)
            .withColumn("event_id", F.format_string("%s-m%03d", F.col("participant_id"), F.col("ordinal").cast("bigint")))
            .withColumn("label_norm", normalize_meal_type("anchor_label"))
            .withColumn("prior_gap", (F.col("t0") - F.col("prev_t0")) / unit)
            .withColumn("next_gap", (F.col("next_t0") - F.col("t0")) / unit))


def overlap_flags(resolved: DataFrame, spec: WindowSpec) -> DataFrame:
    o = spec.overlap_us / spec.unit
    return (resolved.withColumn("overlaps_prior", F.coalesce(F.col("prior_gap") < o, F.lit(False)))
            .withColumn("overlaps_next", F.coalesce(F.col("next_gap") < o, F.lit(False)))
            .withColumn("isolated", ~(F.col("overlaps_prior") | F.col("overlaps_next"))))


def coverage(n: Column, hours: int, spec: WindowSpec) -> Column:
    return n / F.lit(float(spec.activity_rate * hours))


def event_table(df: DataFrame, spec: WindowSpec, resolved: DataFrame | None = None) -> DataFrame:
    """One row per anchor whose outcome window is usable: past-only features, outcome, eligibility."""
    r = overlap_flags(resolve_anchors(df, spec) if resolved is None else resolved, spec).where(F.size("reasons") == 0)
    base = F.col("base.v")
    cov = [coverage(F.col(f"n_act{i}"), h, spec) for i, h in enumerate(spec.activity)]
    usable = (F.col("n_act0") > 0) & (cov[0] >= spec.min_activity_coverage)
    no_base, bad_carbs = base.isNull(), F.col("carbs_g").isNull() | (F.col("carbs_g") < 0)
    overlap = ~F.col("isolated") if spec.require_isolated else F.lit(False)
    core = ~(no_base | bad_carbs | overlap)
    why = F.array_compact(F.array(F.when(no_base, F.lit(BASELINE_MISSING)), F.when(bad_carbs, F.lit(CARBS_MISSING)),
                                  F.when(overlap, F.lit(OVERLAP)), F.when(core & ~usable, F.lit(ACTIVITY_MISSING))))
    flags = F.array_compact(F.array(F.when(no_base, F.lit("baseline_missing")), F.when(bad_carbs, F.lit("carbs_missing")),
                                    F.when(F.col("overlaps_prior"), F.lit("overlap_prior")),
                                    F.when(F.col("overlaps_next"), F.lit("overlap_next")), F.when(~usable, F.lit("activity_missing"))))
    extra = [c for c in MACROS + RETAINED_RAW if c in r.columns]
    return r.select(
        "participant_id", "event_id", F.col("t0").alias("us"), F.col("anchor_label").alias("label_raw"), "label_norm", *extra, "carbs_g",
        base.alias("baseline_glucose"), ((F.col("t0") - F.col("base.us")) / F.lit(float(spec.unit))).alias("baseline_age"),
        F.when(F.col("n_trend") >= spec.trend_min_points, F.col("slope")).alias("trend_slope"),
        F.col("act0").alias("activity_level"), F.least(cov[0], F.lit(1.0)).alias("activity_coverage"),
        F.col("act1").alias("activity_short"), F.least(cov[1], F.lit(1.0)).alias("activity_short_coverage"),
        F.col("act2").alias("activity_long"), F.least(cov[2], F.lit(1.0)).alias("activity_long_coverage"),
        F.col("prior_gap").alias("time_since_last"),
        F.col("peak").alias("peak_glucose"), (F.col("peak") - base).alias("peak_glucose_rise"),
        F.when(F.col("peak").isNotNull(), (F.col("peak") >= spec.threshold).cast("int")).alias("label_exceeds"),
        F.col("n_after").alias("n_window_readings"),
        F.when(F.col("n_after") > 0, F.col("n_after") / F.greatest(F.col("n_rows") - 1, F.lit(1))).otherwise(0.0).alias("window_completeness"),
        F.col("n_valid"), "leading_gap", "internal_gap", "trailing_gap",
        "overlaps_prior", "overlaps_next", "isolated", core.alias("eligible_core"), (core & usable).alias("eligible_activity"),
        F.concat_ws(";", why).alias("ineligible_reasons"),
        F.when(F.size(flags) == 0, F.lit("ok")).otherwise(F.concat_ws(";", flags)).alias("data_quality_flag"))


def exclusion_log(df: DataFrame, spec: WindowSpec, resolved: DataFrame | None = None) -> DataFrame:
    r = (resolve_anchors(df, spec) if resolved is None else resolved).where(F.size("reasons") > 0)
    return r.select("participant_id", "event_id", F.col("anchor_label").alias("label_raw"), "label_norm",
                    F.col("reasons")[0].alias("reason"), F.concat_ws(";", "reasons").alias("reasons"),
                    F.when(F.col("has_channel") & F.col("t0").isNotNull(), F.col("n_valid")).alias("n_valid"),
                    "leading_gap", "internal_gap", "trailing_gap")


def eligible_core(events: DataFrame) -> DataFrame:
    return events.where(F.col("eligible_core"))


def eligible_activity(events: DataFrame) -> DataFrame:
    """Core-eligible rows whose pre-anchor activity is usable; nothing is imputed."""
    return events.where(F.col("eligible_core") & F.col("eligible_activity"))
