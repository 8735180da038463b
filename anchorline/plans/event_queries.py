"""Registered queries: event extraction, eligibility, count reports."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from anchorline.functions.numeric import rounded_value
from anchorline.operators import events as ev
from anchorline.operators import reports as rep
from anchorline.plans.registry import query
from anchorline.plans.sqltext import COHORT, SERIES, event_ctes, r, with_
from anchorline.sources.adapters import cohort, series, table
from anchorline.spec import FIXTURE

_FLOATS = ["carbs_g", "baseline_glucose", "baseline_age", "trend_slope", "activity_level", "activity_coverage", "activity_short",
           "activity_short_coverage", "activity_long", "activity_long_coverage", "time_since_last", "peak_glucose", "peak_glucose_rise",
           "window_completeness", "leading_gap", "internal_gap", "trailing_gap"]
_KEYS = ["participant_id", "event_id", "us", "label_raw", "label_norm"]
_REST = ["label_exceeds", "overlaps_prior", "overlaps_next", "isolated", "eligible_core", "eligible_activity", "ineligible_reasons", "data_quality_flag"]
_COUNTS = ["n_window_readings", "n_valid"]

_BASE = with_(SERIES, event_ctes())


def build(spark, sf, channel="sensor_a"):
    return ev.event_table(series(spark, sf), _spec(channel))


def _project(df, floats, plain, counts=()):
    return df.select(*plain, *[F.col(c).cast("bigint").alias(c) for c in counts], *[rounded_value(c).alias(c) for c in floats])


def _sql(floats, plain, counts=(), src="ev"):
    cols = [*plain, *[f"CAST({c} AS BIGINT) AS {c}" for c in counts], *[f"{r(c)} AS {c}" for c in floats]]
    return _BASE + f"SELECT {', '.join(cols)} FROM {src}"


@query("event_table", _sql(_FLOATS, _KEYS + _REST, _COUNTS))
def event_table(spark, sf):
    return _project(build(spark, sf), _FLOATS, _KEYS + _REST, _COUNTS)


# ------------------------------------------------------------------ the operators of the table, one query each

def _spec(channel="sensor_a"):
    return FIXTURE if channel == "sensor_a" else dataclasses.replace(FIXTURE, channel=channel)


def _resolved(spark, sf, channel="sensor_a"):
    return ev.resolve_anchors(series(spark, sf), _spec(channel))


def _both(spark, sf):
    res = _resolved(spark, sf)
    return ev.event_table(None, FIXTURE, res), ev.exclusion_log(None, FIXTURE, res)


_EXCL = """ex AS (SELECT participant_id, event_id, anchor_label AS label_raw, label_norm, split_part(reasons, ';', 1) AS reason, reasons,
 CAST(n_valid AS BIGINT) AS n_valid, leading_gap, internal_gap, trailing_gap FROM ev_x WHERE reasons <> '')"""
_BOTH = with_(SERIES, event_ctes(), _EXCL)


@query("exclusion_log", _BOTH + f"""SELECT participant_id, event_id, label_raw, label_norm, reason, reasons, n_valid,
 {r('leading_gap')} AS leading_gap, {r('internal_gap')} AS internal_gap, {r('trailing_gap')} AS trailing_gap FROM ex""")
def exclusion_log(spark, sf):
    gaps = ["leading_gap", "internal_gap", "trailing_gap"]
    return _project(ev.exclusion_log(series(spark, sf), FIXTURE), gaps, ["participant_id", "event_id", "label_raw", "label_norm", "reason", "reasons"], ["n_valid"])


@query("overlap_flags", _BASE + f"""SELECT participant_id, event_id, us, {r('prior_gap')} AS prior_gap, {r('next_gap')} AS next_gap,
 overlaps_prior, overlaps_next, isolated FROM ev_x""")
def overlap_flags(spark, sf):
    return _project(ev.overlap_flags(_resolved(spark, sf), FIXTURE).withColumn("us", F.col("t0")), ["prior_gap", "next_gap"],
                    ["participant_id", "event_id", "us", "overlaps_prior", "overlaps_next", "isolated"])


@query("baseline_asof", _BASE + f"SELECT participant_id, event_id, base_us, {r('base_v')} AS base_v FROM ev_x")
def baseline_asof(spark, sf):
    return _resolved(spark, sf).select("participant_id", "event_id", F.col("base.us").alias("base_us"), rounded_value("base.v").alias("base_v"))


@query("activity_windows", _BASE + f"""SELECT participant_id, event_id, {', '.join(f"{r(f'act{i}')} AS act{i}, n_act{i}" for i in range(3))} FROM ev_x""")
def activity_windows(spark, sf):
    return _project(_resolved(spark, sf), ["act0", "act1", "act2"], ["participant_id", "event_id"], ["n_act0", "n_act1", "n_act2"])


@query("trend_slope", _BASE + f"SELECT participant_id, event_id, n_trend, {r('CASE WHEN n_trend >= 3 THEN slope END')} AS trend_slope FROM ev_x")
def trend_slope(spark, sf):
    return _resolved(spark, sf).select("participant_id", "event_id", "n_trend",
                                       rounded_value(F.when(F.col("n_trend") >= FIXTURE.trend_min_points, F.col("slope"))).alias("trend_slope"))


@query("outcome_window", _BASE + f"""SELECT participant_id, event_id, {r('peak')} AS peak, n_after, n_rows,
 CASE WHEN peak IS NOT NULL THEN peak >= {FIXTURE.threshold} END AS exceeds FROM ev_x""")
def outcome_window(spark, sf):
    return _resolved(spark, sf).select("participant_id", "event_id", rounded_value("peak").alias("peak"), "n_after", "n_rows",
                                       (F.col("peak") >= FIXTURE.threshold).alias("exceeds"))


@query("gap_checks", _BASE + f"""SELECT participant_id, event_id, CAST(n_valid AS BIGINT) AS n_valid, {r('leading_gap')} AS leading_gap,
 {r('internal_gap')} AS internal_gap, {r('trailing_gap')} AS trailing_gap, reasons FROM ev_x""")
def gap_checks(spark, sf):
    return _project(_resolved(spark, sf).withColumn("reasons", F.concat_ws(";", "reasons")), ["leading_gap", "internal_gap", "trailing_gap"],
                    ["participant_id", "event_id", "reasons"], ["n_valid"])


@query("window_readings", with_(SERIES) + f"""SELECT a.participant_id, a.row_order AS anchor_row, s.us - a.us AS offset_us, {r('s.sensor_a')} AS value
 FROM series a JOIN series s ON s.participant_id = a.participant_id AND s.us BETWEEN a.us AND a.us + {FIXTURE.window} WHERE a.anchor_label IS NOT NULL""")
def window_readings(spark, sf):
    """The anchor-window range join on its own, in long form."""
    src = series(spark, sf)
    step = FIXTURE.window
    a = src.where(F.col("anchor_label").isNotNull()).select(
        "participant_id", F.col("row_order").alias("anchor_row"), F.col("us").alias("t0"),
        F.explode(F.sequence(F.floor(F.col("us") / step).cast("bigint"), F.floor((F.col("us") + step) / step).cast("bigint"))).alias("slot"))
    s = src.select("participant_id", "us", "sensor_a", F.floor(F.col("us") / step).cast("bigint").alias("slot"))
    hit = a.join(s, ["participant_id", "slot"]).where((F.col("us") >= F.col("t0")) & (F.col("us") <= F.col("t0") + step))
    return hit.select("participant_id", "anchor_row", (F.col("us") - F.col("t0")).alias("offset_us"), rounded_value("sensor_a").alias("value"))


_DUPES = """d AS (SELECT *, row_number() OVER (PARTITION BY participant_id, us // 21600000000 ORDER BY row_order) AS rn FROM series)"""


@query("keep_first_rows", with_(SERIES, _DUPES) + "SELECT participant_id, row_order FROM d WHERE rn = 1")
def keep_first_rows(spark, sf):
    """De-duplication in file order; the fixture has no equal times, so times are coarsened to six hours first."""
    src = series(spark, sf).withColumn("us", F.floor(F.col("us") / 21600000000))
    first = src.groupBy("participant_id", "us").agg(F.min("row_order").alias("row_order"))
    return first.select("participant_id", "row_order")


_CNT = "n_meal_rows n_excluded n_window_valid n_isolated n_eligible_core n_eligible_activity n_positive n_negative".split()
_MARKS = """mk AS (
 SELECT participant_id, 1 AS n_meal_rows, 0 AS n_excluded, 1 AS n_window_valid, CAST(isolated AS INT) AS n_isolated, CAST(eligible_core AS INT) AS n_eligible_core,
  CAST(eligible_activity AS INT) AS n_eligible_activity, CAST(eligible_core AND coalesce(label_exceeds, -1) = 1 AS INT) AS n_positive,
  CAST(eligible_core AND coalesce(label_exceeds, -1) = 0 AS INT) AS n_negative FROM ev
 UNION ALL SELECT participant_id, 1, 1, 0, 0, 0, 0, 0, 0 FROM ex)"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _CNT)


@query("event_counts", with_(SERIES, event_ctes(), _EXCL, _MARKS) + f"""SELECT coalesce(participant_id, 'ALL') AS participant_id, {_SUMS},
 sum(n_meal_rows) = sum(n_window_valid) + sum(n_excluded) AS reconciles FROM mk GROUP BY ROLLUP(participant_id)""")
def event_counts(spark, sf):
    return rep.event_counts(*_both(spark, sf))


@query("both_class_participants", with_(SERIES, event_ctes(), _EXCL, _MARKS) + """SELECT count(*) AS n_participants,
 count(CASE WHEN p >= 5 AND n >= 5 THEN 1 END) AS participants_with_both_classes
 FROM (SELECT participant_id, sum(n_positive) AS p, sum(n_negative) AS n FROM mk GROUP BY 1)""")
def both_class_participants(spark, sf):
    return rep.both_class_participants(*_both(spark, sf))


@query("group_event_counts", with_(SERIES, event_ctes(), _EXCL, _MARKS) + """SELECT grp, count(*) AS n_participants,
 CAST(sum(n_meal_rows) AS BIGINT) AS n_meal_rows, CAST(sum(n_eligible_core) AS BIGINT) AS n_eligible_core, CAST(sum(n_positive) AS BIGINT) AS n_positive,
 CAST(sum(n_negative) AS BIGINT) AS n_negative
 FROM (SELECT participant_id, sum(n_meal_rows) AS n_meal_rows, sum(n_eligible_core) AS n_eligible_core, sum(n_positive) AS n_positive, sum(n_negative) AS n_negative
       FROM mk GROUP BY 1) JOIN (SELECT CAST(c_custkey AS VARCHAR) AS participant_id, c_mktsegment AS grp FROM customer) USING (participant_id) GROUP BY grp""")
def group_event_counts(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("participant_id"), F.col("c_mktsegment").alias("grp"))
    return rep.group_event_counts(*_both(spark, sf), people)


@query("reason_counts", _BOTH + """SELECT 'eligibility' AS stage, reason, count(*) AS n
 FROM (SELECT unnest(string_split(ineligible_reasons, ';')) AS reason FROM ev) WHERE reason <> '' GROUP BY reason
 UNION ALL SELECT 'extraction', reason, count(*) FROM ex GROUP BY reason""")
def reason_counts(spark, sf):
    return rep.reason_counts(*_both(spark, sf))


@query("label_type_counts", _BOTH + """SELECT label_norm, CASE WHEN label_norm = 'unrecognized' THEN label_raw[1:30] END AS raw_text, count(*) AS n_all,
 CAST(sum(kept) AS BIGINT) AS n_retained FROM (SELECT label_norm, label_raw, 1 AS kept FROM ev UNION ALL SELECT label_norm, label_raw, 0 FROM ex) GROUP BY 1, 2""")
def label_type_counts(spark, sf):
    return rep.label_type_counts(*_both(spark, sf))


_MISS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, count(*) AS n_rows, "
                           f"{r(f'(count(*) - count({c})) / count(*)')} AS share_missing FROM ev" for c in ev.FEATURES)


@query("feature_missingness", _BASE + _MISS)
def feature_missingness(spark, sf):
    return rep.missingness(build(spark, sf), ev.FEATURES).withColumn("share_missing", rounded_value("share_missing"))


@query("completeness_distribution", _BASE + f"""SELECT count(*) AS n, {r('avg(window_completeness)')} AS mean, {r('min(window_completeness)')} AS min,
 {r('max(window_completeness)')} AS max, {r('quantile_cont(window_completeness, 0.05)')} AS p5, {r('quantile_cont(window_completeness, 0.5)')} AS median,
 {r('avg(CAST(window_completeness >= 1 AS INT))')} AS share_complete FROM ev""")
def completeness_distribution(spark, sf):
    d = rep.completeness_distribution(build(spark, sf))
    return d.select("n", *[rounded_value(c).alias(c) for c in ("mean", "min", "max", "p5", "median", "share_complete")])


@query("excluded_valid_share", _BOTH + f"""SELECT count(n_valid) AS n, {r('avg(n_valid / 121.0e0)')} AS mean, {r('quantile_cont(n_valid / 121.0e0, 0.5)')} AS median,
 {r('max(n_valid / 121.0e0)')} AS max FROM ex""")
def excluded_valid_share(spark, sf):
    x = ev.exclusion_log(series(spark, sf), FIXTURE).withColumn("share", F.col("n_valid") / 121.0)
    return rep.distribution(x, "share", probs={"median": 0.5}).select("n", *[rounded_value(c).alias(c) for c in ("mean", "median", "max")])


@query("anonymous_labels", with_(SERIES) + """SELECT participant_id, 'P' || row_number() OVER (ORDER BY md5('0|' || participant_id), participant_id) AS label
 FROM (SELECT DISTINCT participant_id FROM series)""")
def anonymous_labels(spark, sf):
    return rep.anonymous_labels(series(spark, sf))


@query("eligibility_filters", _BASE + "SELECT participant_id, event_id, eligible_activity AS usable FROM ev WHERE eligible_core")
def eligibility_filters(spark, sf):
    return ev.eligible_core(build(spark, sf)).select("participant_id", "event_id", F.col("eligible_activity").alias("usable"))


# damaged copies of the cohort so that every rule of the validators has something to find
_DAMAGE = """bad AS (SELECT CASE WHEN CAST(event_id AS BIGINT) % 41 = 0 THEN NULL ELSE participant_id END AS participant_id, event_id, us,
 CASE WHEN CAST(event_id AS BIGINT) % 37 = 0 THEN -carbs_g WHEN CAST(event_id AS BIGINT) % 53 = 0 THEN NULL ELSE carbs_g END AS carbs_g, activity_level, baseline_glucose,
 CASE WHEN CAST(event_id AS BIGINT) % 43 = 0 THEN NULL ELSE peak_glucose_rise END AS peak_glucose_rise,
 CASE WHEN CAST(event_id AS BIGINT) % 47 = 0 THEN 2 WHEN CAST(event_id AS BIGINT) % 31 = 0 THEN 1 - label_exceeds_180 ELSE label_exceeds_180 END AS label_exceeds_180,
 CASE WHEN CAST(event_id AS BIGINT) % 43 = 0 THEN 'sensor gap' WHEN CAST(event_id AS BIGINT) % 59 = 0 THEN ' ' END AS excluded_reason FROM cohort)"""


def damaged(spark, sf):
    k = F.col("event_id").cast("bigint")
    return cohort(spark, sf).select(
        F.when(k % 41 != 0, F.col("participant_id")).alias("participant_id"), "event_id", "us",
        F.when(k % 37 == 0, -F.col("carbs_g")).when(k % 53 != 0, F.col("carbs_g")).alias("carbs_g"), "activity_level", "baseline_glucose",
        F.when(k % 43 != 0, F.col("peak_glucose_rise")).alias("peak_glucose_rise"),
        F.when(k % 47 == 0, F.lit(2)).when(k % 31 == 0, 1 - F.col("label_exceeds_180")).otherwise(F.col("label_exceeds_180")).alias("label_exceeds_180"),
        F.when(k % 43 == 0, "sensor gap").when(k % 59 == 0, " ").alias("excluded_reason"))


_NUMS = ("carbs_g", "baseline_glucose", "activity_level", "peak_glucose_rise")
_EXP = "CAST(baseline_glucose + peak_glucose_rise >= 180 - 1e-6 AS INT)"


@query("schema_validation", with_(COHORT, _DAMAGE) + f"""SELECT count(*) FILTER (participant_id IS NULL) AS null_participant,
 count(*) FILTER (label_exceeds_180 NOT IN (0, 1)) AS bad_label, {', '.join(f'count(*) FILTER ({c} IS NULL) AS bad_{c}' for c in _NUMS)},
 count(*) FILTER (carbs_g < 0) AS negative_carbs,
 count(*) FILTER (baseline_glucose IS NOT NULL AND peak_glucose_rise IS NOT NULL AND label_exceeds_180 IN (0, 1) AND {_EXP} <> label_exceeds_180) AS label_mismatch FROM bad""")
def schema_validation(spark, sf):
    return rep.schema_problems(damaged(spark, sf))


_OUT = "(trim(coalesce(excluded_reason, '')) <> '')"


@query("replay_validation", with_(COHORT, _DAMAGE) + f"""SELECT count(*) AS n_events, count(*) FILTER (us IS NULL) AS bad_time,
 {', '.join(f'count(*) FILTER ({c} IS NULL' + (f' AND NOT {_OUT}' if c == 'peak_glucose_rise' else '') + f') AS bad_{c}' for c in _NUMS)},
 count(*) FILTER (carbs_g < 0) AS negative_carbs, count(*) FILTER (NOT {_OUT} AND (label_exceeds_180 IS NULL OR label_exceeds_180 NOT IN (0, 1))) AS bad_label,
 count(*) FILTER (NOT {_OUT} AND coalesce({_EXP}, 0) <> coalesce(label_exceeds_180, -1)) AS label_mismatch FROM bad""")
def replay_validation(spark, sf):
    return rep.replay_problems(damaged(spark, sf))


@query("sample_size_gate", with_(COHORT) + """SELECT count(*) AS n_participants, quantile_cont(n, 0.5) AS median_events, CAST(sum(pos) AS BIGINT) AS n_positive,
 CAST(sum(n - pos) AS BIGINT) AS n_negative, count(*) >= 20 AND quantile_cont(n, 0.5) >= 8 AND sum(pos) >= 30 AND sum(n - pos) >= 30 AS passes, concat_ws(';', CASE WHEN NOT count(*) >= 20 THEN 'n_participants < 20' END, CASE WHEN NOT quantile_cont(n, 0.5) >= 8 THEN 'median_events < 8' END,
 CASE WHEN NOT sum(pos) >= 30 THEN 'n_positive < 30' END, CASE WHEN NOT sum(n - pos) >= 30 THEN 'n_negative < 30' END) AS shortfalls
 FROM (SELECT participant_id, count(*) AS n, sum(label_exceeds_180) AS pos FROM cohort GROUP BY 1)""")
def sample_size_gate(spark, sf):
    return rep.sample_size_gate(cohort(spark, sf))
