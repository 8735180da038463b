import dataclasses

import pytest
from pyspark.sql import functions as F

from anchorline.operators import events as ev
from anchorline.operators import leakage as lk
from anchorline.spec import DAY, MINUTE, WindowSpec
from helpers import T0, frame, minute_rows

SPEC = WindowSpec(channel="sensor_a", chunk=DAY // 4)


def build(spark, rows, spec=SPEC):
    return [r.asDict() for r in ev.event_table(frame(spark, rows), spec).orderBy("us").collect()]


def log(spark, rows, spec=SPEC):
    return [r.asDict() for r in ev.exclusion_log(frame(spark, rows), spec).collect()]


def test_clean_meal(spark):
    (e,) = build(spark, minute_rows())
    assert e["event_id"] == "p1-m000" and e["label_norm"] == "lunch"
    assert e["baseline_glucose"] == pytest.approx(100 + 0.05 * 395) and e["baseline_age"] == 5
    assert e["peak_glucose"] == pytest.approx(100 + 0.05 * 520) and e["n_window_readings"] == 120 and e["window_completeness"] == 1.0
    assert e["trend_slope"] == pytest.approx(0.05) and e["activity_level"] == pytest.approx(1.5) and e["activity_coverage"] == 1.0
    assert e["eligible_core"] and e["eligible_activity"] and e["isolated"] and e["data_quality_flag"] == "ok"


def test_reading_at_anchor_is_not_outcome_but_closes_leading_gap(spark):
    rows = minute_rows(value=lambda i: 250 if i == 400 else 100)
    (e,) = build(spark, rows)
    assert e["peak_glucose"] == 100 and e["label_exceeds"] == 0 and e["leading_gap"] == 0
    (e,) = build(spark, minute_rows(value=lambda i: 180 if i == 520 else 100))
    assert e["label_exceeds"] == 1


@pytest.mark.parametrize("holes, reason", [
    (range(400, 417), "leading_gap_exceeds_limit"), (range(430, 446), "internal_gap_exceeds_limit"), (range(515, 521), "incomplete_window_end"),
    (range(400, 520), "too_few_readings")])
def test_gap_reasons(spark, holes, reason):
    (x,) = log(spark, minute_rows(holes=holes))
    assert x["reason"] == reason


@pytest.mark.parametrize("holes", [range(400, 415), range(430, 444), range(516, 521)])
def test_gap_equal_to_limit_passes(spark, holes):
    assert log(spark, minute_rows(holes=holes)) == []


def test_gap_straddling_anchor_is_not_internal(spark):
    assert len(build(spark, minute_rows(holes=range(380, 410)))) == 1


def test_baseline_age_limit_is_inclusive(spark):
    (e,) = build(spark, minute_rows(holes=range(381, 400)))
    assert e["baseline_age"] == 20
    (e,) = build(spark, minute_rows(holes=range(380, 400)))
    assert e["baseline_glucose"] is None and not e["eligible_core"] and "baseline_missing" in e["ineligible_reasons"]


def test_overlap_is_strict_and_counts_excluded_meals(spark):
    a, b = build(spark, minute_rows(meals=(300, 420)))
    assert a["isolated"] and b["isolated"] and b["time_since_last"] == 120
    a, b = build(spark, minute_rows(meals=(300, 419)))
    assert not a["isolated"] and "overlapping_meal_window" in b["ineligible_reasons"]
    # the second meal is excluded (sensor hole) but still counts as a neighbour
    (only,) = build(spark, minute_rows(meals=(300, 400), holes=range(421, 521)))
    assert not only["isolated"]


def test_duplicates_keep_first_row_in_file_order(spark):
    rows = minute_rows()
    p, i, us, v, a, lab, d = rows[400]
    swapped = rows[:400] + [(p, 400, us, v, a, None, None), (p, 401, us, v, a, "Dinner", 10.0)] + [(r[0], r[1] + 1, *r[2:]) for r in rows[401:]]
    assert build(spark, swapped) == []
    assert ev.duplicate_timestamps(frame(spark, swapped)).first().duplicate_rows == 1


def test_untimed_meal_absent_channel_and_reconciliation(spark):
    rows = minute_rows() + [("p1", 9999, None, None, None, "Snack 2", 5.0)]
    f = frame(spark, rows)
    res = ev.resolve_anchors(f, SPEC)
    assert {r.event_id: r.reasons for r in res.select("event_id", "reasons").collect()} == {"p1-m000": [], "p1-m001": ["invalid_meal_timestamp"]}
    x = ev.exclusion_log(f.withColumn("has_channel", F.lit(False)), SPEC).orderBy("event_id").collect()
    assert [r.reason for r in x] == ["cgm_channel_missing", "invalid_meal_timestamp"]


def test_negative_or_missing_carbs_and_low_activity(spark):
    for dose in (-1.0, None):
        (e,) = build(spark, minute_rows(dose=dose))
        assert e["ineligible_reasons"] == "carbs_missing"
    (e,) = build(spark, minute_rows(activity=None))
    assert e["eligible_core"] and not e["eligible_activity"] and e["ineligible_reasons"] == "activity_missing_or_low_coverage"


def test_slices_do_not_change_the_result(spark):
    rows = minute_rows(n=3000, meals=(400, 900, 1441, 2000), value=lambda i: 100 + (i * 37 % 50)) + minute_rows(n=1500, meals=(700,), pid="p2")
    f = frame(spark, rows)
    cols = [c for c in ev.event_table(f, SPEC).columns]
    one = ev.event_table(f, dataclasses.replace(SPEC, chunk=365 * DAY)).orderBy("participant_id", "us").collect()
    many = ev.event_table(f, dataclasses.replace(SPEC, chunk=25 * 60 * MINUTE)).orderBy("participant_id", "us").collect()
    assert len(one) == 5
    for a, b in zip(one, many, strict=True):
        for c in cols:
            assert a[c] == (pytest.approx(b[c]) if isinstance(b[c], float) else b[c]), c


def test_leakage_check_passes_and_is_not_vacuous(spark):
    f = frame(spark, minute_rows(n=1200))
    res = lk.check(f, SPEC).collect()
    assert len(res) == 3 and all(r.passed for r in res)

    def leaky(series, spec):
        t = ev.event_table(series, spec)
        return t.withColumn("activity_level", F.col("peak_glucose"))
    bad = {r.mutation: r for r in lk.check(f, SPEC, builder=leaky).collect()}
    assert not bad["all_after"].passed and bad["all_after"].mismatched == "activity_level"


def test_first_meal_time_is_in_range(spark):
    (e,) = build(spark, minute_rows())
    assert e["us"] == T0 + 400 * MINUTE


def test_readings_of_a_task_are_bounded_whatever_the_session_shuffles_to(spark, monkeypatch):
    f = frame(spark, [r for p in range(6) for r in minute_rows(pid=f"p{p}", meals=(200, 400, 700))])
    want = ev.event_table(f, SPEC).orderBy("participant_id", "us").collect()
    monkeypatch.setattr(ev, "TASK_ROWS", 500, raising=False)
    assert ev._sliced_readings(f, SPEC).rdd.getNumPartitions() == 11  # 5,400 readings; the session shuffles to four
    assert ev.event_table(f, SPEC).orderBy("participant_id", "us").collect() == want and len(want) > 6
