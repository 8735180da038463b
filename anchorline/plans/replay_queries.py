"""Registered queries: replays published as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from anchorline.operators import replay_store as rs
from anchorline.plans.registry import query
from anchorline.plans.sqltext import COHORT, with_
from anchorline.plans.twin_queries import _LOG, EXC, with_exclusions
from anchorline.session import checkpoint_dir, stage

_BROKEN = """bk AS (SELECT participant_id, event_id, CASE WHEN k % 67 <> 0 THEN us END AS us, CASE WHEN k % 97 = 0 THEN -carbs_g ELSE carbs_g END AS carbs_g,
 CASE WHEN k % 89 = 0 THEN 'Infinity'::DOUBLE ELSE activity_level END AS activity_level, CASE WHEN k % 83 <> 0 THEN baseline_glucose END AS baseline_glucose,
 CASE WHEN k % 79 <> 0 THEN peak_glucose_rise END AS peak_glucose_rise, CASE WHEN k % 71 = 0 THEN 2 WHEN k % 73 = 0 THEN 1 - label_exceeds_180 ELSE label_exceeds_180 END AS label, excluded_reason
 FROM (SELECT *, CAST(event_id AS BIGINT) AS k FROM ce0) q)"""
_RULED = """ru AS (SELECT *, us IS NULL AS r1, carbs_g IS NULL OR isinf(carbs_g) AS r2, baseline_glucose IS NULL OR isinf(baseline_glucose) AS r3, activity_level IS NULL OR isinf(activity_level) AS r4,
 excluded_reason IS NULL AND (peak_glucose_rise IS NULL OR isinf(peak_glucose_rise)) AS r5, coalesce(carbs_g < 0, FALSE) AS r6, excluded_reason IS NULL AND (label IS NULL OR label NOT IN (0, 1)) AS r7,
 excluded_reason IS NULL AND coalesce((baseline_glucose + peak_glucose_rise >= 180 - 1e-6) <> (label = 1), TRUE) AS r8 FROM bk),
re AS (SELECT participant_id, count(*) FILTER (r1) AS n1, count(*) FILTER (r2) AS n2, count(*) FILTER (r3) AS n3, count(*) FILTER (r4) AS n4, count(*) FILTER (r5) AS n5, count(*) FILTER (r6) AS n6,
 count(*) FILTER (r7) AS n7, count(*) FILTER (r8) AS n8 FROM ru GROUP BY participant_id),
ce AS (SELECT * FROM bk WHERE participant_id IN (SELECT participant_id FROM re WHERE n1 + n2 + n3 + n4 + n5 + n6 + n7 + n8 = 0))"""
_CTES = (COHORT, EXC.replace("ce AS", "ce0 AS", 1), _BROKEN, _RULED)


def broken(spark, sf):
    """The cohort with each kind of fault planted by event id; some of the faults stand in excluded events, which need neither rise nor label."""
    k = F.col("event_id").cast("bigint")
    return stage(with_exclusions(spark, sf).withColumns({
        "us": F.when(k % 67 != 0, F.col("us")), "carbs_g": F.when(k % 97 == 0, -F.col("carbs_g")).otherwise(F.col("carbs_g")),
        "activity_level": F.when(k % 89 == 0, F.lit(float("inf"))).otherwise(F.col("activity_level")), "baseline_glucose": F.when(k % 83 != 0, F.col("baseline_glucose")),
        "peak_glucose_rise": F.when(k % 79 != 0, F.col("peak_glucose_rise")),
        "label_exceeds_180": F.when(k % 71 == 0, 2).when(k % 73 == 0, 1 - F.col("label_exceeds_180")).otherwise(F.col("label_exceeds_180"))}), "events")


def _published(spark, sf):
    """One committed run, and one of all events that was lost before its manifest row."""
    base = f"{checkpoint_dir(spark)}/anchorline/replays-{uuid.uuid4().hex}"
    e = broken(spark, sf)
    rs.publish(e, base, "first")
    rs.write_run(e.where("participant_id < '5'"), base, "lost")
    return base


@query("replay_refused", with_(*_CTES) + """SELECT participant_id, CASE WHEN n1 > 0 THEN 'no time' WHEN n2 > 0 THEN 'carbs not finite' WHEN n3 > 0 THEN 'baseline not finite' WHEN n4 > 0 THEN 'activity not finite'
 WHEN n5 > 0 THEN 'rise not finite' WHEN n6 > 0 THEN 'negative carbs' WHEN n7 > 0 THEN 'label not 0 or 1' ELSE 'label disagrees with baseline plus rise' END AS refused,
 CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 WHEN n3 > 0 THEN n3 WHEN n4 > 0 THEN n4 WHEN n5 > 0 THEN n5 WHEN n6 > 0 THEN n6 WHEN n7 > 0 THEN n7 ELSE n8 END AS n_events
 FROM re WHERE n1 + n2 + n3 + n4 + n5 + n6 + n7 + n8 > 0""")
def replay_refused(spark, sf):
    return rs.refused(broken(spark, sf))


@query("replay_published", with_(*_CTES, _LOG) + "SELECT 'first' AS run_id, participant_id, seq, action, event_id, \"at\", version_after - e AS version_before, version_after FROM lg")
def replay_published(spark, sf):
    return rs.published(spark, _published(spark, sf))


@query("replay_manifest", with_(*_CTES) + """SELECT 'first' AS run_id, (SELECT count(DISTINCT participant_id) FROM ce) AS n_participants,
 (SELECT count(*) FROM re WHERE n1 + n2 + n3 + n4 + n5 + n6 + n7 + n8 > 0) AS n_refused, (SELECT 2 * count(*) FROM ce) AS n_actions""")
def replay_manifest(spark, sf):
    return rs.manifest(spark, _published(spark, sf))
