"""Count, missingness and distribution reports over event tables; schema checks as single conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.numeric import finite
from anchorline.functions.scale import dense_ids, exact_quantiles
from anchorline.spec import LABEL_TOLERANCE, THRESHOLD

NUMERIC = ("carbs_g", "baseline_glucose", "activity_level", "peak_glucose_rise")
_COUNT_COLUMNS = ("n_meal_rows", "n_excluded", "n_window_valid", "n_isolated", "n_eligible_core", "n_eligible_activity", "n_positive", "n_negative")


def _marks(events: DataFrame, exclusions: DataFrame) -> DataFrame:
    one = lambda c: c.cast("bigint")
    core = F.col("eligible_core")
    kept = events.select("participant_id", F.lit(1).cast("bigint").alias("n_meal_rows"), F.lit(0).cast("bigint").alias("n_excluded"),
                         F.lit(1).cast("bigint").alias("n_window_valid"), one(F.col("isolated")).alias("n_isolated"), one(core).alias("n_eligible_core"),
                         one(F.col("eligible_activity")).alias("n_eligible_activity"),
                         one(core & (F.coalesce(F.col("label_exceeds"), F.lit(-1)) == 1)).alias("n_positive"),
                         one(core & (F.coalesce(F.col("label_exceeds"), F.lit(-1)) == 0)).alias("n_negative"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in _COUNT_COLUMNS[2:]]
    lost = exclusions.select("participant_id", F.lit(1).cast("bigint").alias("n_meal_rows"), F.lit(1).cast("bigint").alias("n_excluded"), *zero)
    return kept.unionByName(lost)


def event_counts(events: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Per participant and overall in one pass, with the kept + excluded reconciliation."""
    per = _marks(events, exclusions).groupBy("participant_id").agg(*[F.sum(c).alias(c) for c in _COUNT_COLUMNS])
    rolled = per.rollup("participant_id").agg(*[F.sum(c).alias(c) for c in _COUNT_COLUMNS])
    return rolled.select(F.coalesce("participant_id", F.lit("ALL")).alias("participant_id"), *_COUNT_COLUMNS,
                         (F.col("n_meal_rows") == F.col("n_window_valid") + F.col("n_excluded")).alias("reconciles"))


def both_class_participants(events: DataFrame, exclusions: DataFrame, per_class: int = 5) -> DataFrame:
    per = _marks(events, exclusions).groupBy("participant_id").agg(F.sum("n_positive").alias("p"), F.sum("n_negative").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_participants"),
                   F.count_if((F.col("p") >= per_class) & (F.col("n") >= per_class)).alias("participants_with_both_classes"))


def group_event_counts(events: DataFrame, exclusions: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts by participant group; `groups` holds (participant_id, grp)."""
    per = _marks(events, exclusions).groupBy("participant_id").agg(*[F.sum(c).alias(c) for c in _COUNT_COLUMNS])
    return per.join(groups, "participant_id").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_participants"), *[F.sum(c).alias(c) for c in ("n_meal_rows", "n_eligible_core", "n_positive", "n_negative")])


def reason_counts(events: DataFrame, exclusions: DataFrame) -> DataFrame:
    why_not = (events.select(F.explode(F.split("ineligible_reasons", ";")).alias("reason")).where(F.col("reason") != "")
               .groupBy("reason").count().withColumn("stage", F.lit("eligibility")))
    lost = exclusions.groupBy("reason").count().withColumn("stage", F.lit("extraction"))
    return why_not.unionByName(lost).select("stage", "reason", F.col("count").alias("n"))


def label_type_counts(events: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Normalised label counts over all and over retained rows, plus the raw text of unrecognised ones (30 characters)."""
    rows = events.select("label_norm", "label_raw", F.lit(1).alias("kept")).unionByName(exclusions.select("label_norm", "label_raw", F.lit(0).alias("kept")))
    return rows.groupBy("label_norm", F.when(F.col("label_norm") == "unrecognized", F.substring("label_raw", 1, 30)).alias("raw_text")).agg(
        F.count(F.lit(1)).alias("n_all"), F.sum("kept").alias("n_retained"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One aggregate for every column, then a bounded unpivot of the single result row."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = row.select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns])).alias("s"))
    return long.select("s.column_name", "s.n_missing", "n_rows", F.try_divide(F.col("s.n_missing"), F.col("n_rows")).alias("share_missing"))


def distribution(df: DataFrame, value: str, keys: list[str] | None = None, probs: dict[str, float] | None = None) -> DataFrame:
    """n, mean, sample sd, extremes and interpolated quantiles of one column."""
    keys = keys or []
    probs = probs or {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    rows = df.where(F.col(value).isNotNull())
    moments = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                      F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(rows, keys, value, probs)
    if keys:
        return moments.join(q, keys)
    return moments.withColumn("__k", F.lit(0)).join(q.withColumn("__k", F.lit(0)), "__k").drop("__k")


def completeness_distribution(events: DataFrame) -> DataFrame:
    d = distribution(events, "window_completeness", probs={"p5": 0.05, "median": 0.5}).drop("sd")
    full = events.agg(F.avg((F.col("window_completeness") >= 1.0).cast("double")).alias("share_complete"))
    return d.withColumn("__k", F.lit(0)).join(full.withColumn("__k", F.lit(0)), "__k").drop("__k")


def anonymous_labels(ids: DataFrame, seed: int = 0) -> DataFrame:
    """P1..Pn by a seeded hash order; the numbering carries no trace of the id order."""
    keyed = ids.select("participant_id").distinct().withColumn("__seeded", F.concat_ws("|", F.lit(str(seed)), "participant_id"))
    return dense_ids(keyed, "__seeded", "__k").select("participant_id", F.concat(F.lit("P"), (F.col("__k") + 1).cast("string")).alias("label"))


def schema_problems(df: DataFrame) -> DataFrame:
    """Counts of every schema or consistency problem of an event table, in one aggregate. Values are never reported."""
    expected = (F.col("baseline_glucose") + F.col("peak_glucose_rise") >= F.lit(THRESHOLD - LABEL_TOLERANCE)).cast("int")
    label = F.col("label_exceeds_180")
    usable = finite("baseline_glucose") & finite("peak_glucose_rise") & label.isin(0, 1)
    return df.agg(F.count_if(F.col("participant_id").isNull()).alias("null_participant"),
                  F.count_if(label.isNotNull() & ~label.isin(0, 1)).alias("bad_label"),
                  *[F.count_if(~F.coalesce(finite(c), F.lit(False))).alias(f"bad_{c}") for c in NUMERIC],
                  F.count_if(F.col("carbs_g") < 0).alias("negative_carbs"),
                  F.count_if(usable & (expected != label)).alias("label_mismatch"))


def replay_problems(df: DataFrame) -> DataFrame:
    """As `schema_problems`, for a replay: rows with an exclusion reason need no outcome."""
    out = F.coalesce(F.trim("excluded_reason") != "", F.lit(False))
    label = F.col("label_exceeds_180")
    expected = F.coalesce((F.col("baseline_glucose") + F.col("peak_glucose_rise") >= F.lit(THRESHOLD - LABEL_TOLERANCE)).cast("int"), F.lit(0))
    bad = lambda c: ~F.coalesce(finite(c), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("us").isNull()).alias("bad_time"),
                  *[F.count_if(bad(c) & (~out if c == "peak_glucose_rise" else F.lit(True))).alias(f"bad_{c}") for c in NUMERIC],
                  F.count_if(F.col("carbs_g") < 0).alias("negative_carbs"),
                  F.count_if(~out & (label.isNull() | ~label.isin(0, 1))).alias("bad_label"),
                  F.count_if(~out & (expected != F.coalesce(label, F.lit(-1)))).alias("label_mismatch"))


def require_zero(problems: DataFrame, what: str, ignore: tuple[str, ...] = ("n_events",)) -> None:
    """Refuse when a one-row problem report has any count above zero."""
    row = problems.first().asDict()
    bad = {k: v for k, v in row.items() if k not in ignore and v}
    if bad:
        raise ValueError(f"{what}: {bad}")


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def sample_size_gate(events: DataFrame, min_participants: int = 20, min_median_events: float = 8, min_pos: int = 30, min_neg: int = 30) -> DataFrame:
    per = events.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label_exceeds_180").alias("pos"))
    # event counts per participant are small integers: the count histogram is what `percentile` holds
    tot = per.agg(F.count(F.lit(1)).alias("n_participants"), F.percentile("n", F.lit(0.5)).alias("median_events"),
                  F.sum("pos").alias("n_positive"), F.sum(F.col("n") - F.col("pos")).alias("n_negative"))
    ok: Column = ((F.col("n_participants") >= min_participants) & (F.col("median_events") >= min_median_events)
                  & (F.col("n_positive") >= min_pos) & (F.col("n_negative") >= min_neg))
    short = F.concat_ws(";", *[F.when(~F.coalesce(F.col(c) >= least, F.lit(False)), F.lit(f"{c} < {least:g}")) for c, least in
                               (("n_participants", min_participants), ("median_events", min_median_events), ("n_positive", min_pos), ("n_negative", min_neg))])
    return tot.withColumn("passes", F.coalesce(ok, F.lit(False))).withColumn("shortfalls", short)
