"""Data-quality facts carried with a forecast or an observation. They never alter a probability or an interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorline.functions.numeric import finite
from anchorline.spec import COLD_START_MAX, LOW_ACTIVITY_COVERAGE, STALE_BASELINE


def _missing(c: str) -> Column:
    return ~F.coalesce(finite(c), F.lit(False))


def forecast_reasons(coverage="activity_coverage", activity="activity_level", age="baseline_age", baseline="baseline_glucose", trend="trend_slope") -> Column:
    whole = lambda c: F.bround(c).cast("int").cast("string")
    return F.array_compact(F.array(
        F.when(_missing(coverage), F.lit("activity coverage unknown")).when(
            F.col(coverage) < LOW_ACTIVITY_COVERAGE, F.concat(F.lit("low pre-meal activity coverage ("), whole(F.col(coverage) * 100), F.lit("% of the window)"))),
        F.when(_missing(activity), F.lit("pre-meal activity missing")),
        F.when(F.col(age) > STALE_BASELINE, F.concat(F.lit("baseline glucose reading is "), whole(F.col(age)), F.lit(" minutes old"))),
        F.when(_missing(baseline), F.lit("baseline glucose missing")),
        F.when(_missing(trend), F.lit("pre-meal glucose trend unavailable"))))


def insufficient_history(n: str) -> Column:
    return F.col(n) < COLD_START_MAX


def forecast_warning(reasons: str, n: str) -> Column:
    low = F.when(F.size(reasons) > 0, F.concat(F.lit("LOW DATA QUALITY: "), F.concat_ws("; ", reasons), F.lit(".")))
    few = F.when(insufficient_history(n), F.concat(F.lit("INSUFFICIENT HISTORY: only "), F.col(n).cast("string"), F.lit(" own meals observed.")))
    return F.nullif(F.concat_ws(" ", low, few), F.lit(""))


def partial_window(completeness: str) -> Column:
    return F.coalesce(F.col(completeness) < 1.0, F.lit(False))


# rule name -> SQL predicate of an acceptable request value
RANGES = {
    "carbs_out_of_range": "carbs_g BETWEEN 0 AND 500", "baseline_out_of_range": "baseline_glucose BETWEEN 20 AND 600",
    "activity_out_of_range": "activity_level BETWEEN 0 AND 25", "bad_identifier": "event_id RLIKE '^[A-Za-z0-9][A-Za-z0-9._:-]{0,63}$'",
}

# of fields that may be left out
OPTIONAL = {
    "coverage_out_of_range": ("activity_coverage", "activity_coverage BETWEEN 0 AND 1"), "baseline_age_out_of_range": ("baseline_age", "baseline_age BETWEEN 0 AND 1440"),
    "trend_out_of_range": ("trend_slope", "trend_slope BETWEEN -20 AND 20"), "time_since_last_out_of_range": ("time_since_last", "time_since_last BETWEEN 0 AND 100000"),
    "completeness_out_of_range": ("window_completeness", "window_completeness BETWEEN 0 AND 1"), "bad_reason_length": ("excluded_reason", "length(excluded_reason) BETWEEN 3 AND 200"),
}


def request_faults(optional: list[str] | tuple[str, ...] = ()) -> Column:
    """Names of the rules a request breaks. `optional` lists which optional fields the table has; a null there is no fault."""
    must = [F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(n)) for n, p in RANGES.items()]
    may = [F.when(~F.coalesce(F.expr(p), F.lit(True)), F.lit(n)) for n, (c, p) in OPTIONAL.items() if c in optional]
    return F.array_compact(F.array(*must, *may))


def outcome_faults(peak: str, excluded: str) -> Column:
    """Exactly one of a peak and an exclusion reason must be given, and a peak must be in range."""
    return F.array_compact(F.array(F.when(F.col(peak).isNull() == F.col(excluded).isNull(), F.lit("need exactly one of peak and excluded reason")),
                                   F.when(~F.coalesce(F.col(peak).between(20, 600), F.lit(True)), F.lit("peak_out_of_range"))))
