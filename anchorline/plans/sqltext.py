"""SQL building blocks shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from anchorline.functions.numeric import _DEN, _NUM, _ROOT_TWO_PI, _SPLIT
from anchorline.spec import FIXTURE as S
from anchorline.spec import Z90


def r(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE) + 1e-9, 5) + 0e0)"


def _h(coefs, a):
    acc = f"{coefs[0]!r}e0"
    for c in coefs[1:]:
        acc = f"({acc} * {a} + {c!r}e0)"
    return acc


def phi(z: str) -> str:
    a = f"abs({z})"
    e = f"exp(-({a} * {a}) / 2e0)"
    frac = f"({a} + 1e0/({a} + 2e0/({a} + 3e0/({a} + 4e0/({a} + 0.65e0)))))"
    tail = (f"CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < {_SPLIT!r}e0 THEN {e} * {_h(_NUM, a)} / {_h(_DEN, a)} "
            f"ELSE {e} / {frac} / {_ROOT_TWO_PI!r}e0 END")
    return f"(CASE WHEN {z} > 0 THEN 1e0 - ({tail}) ELSE ({tail}) END)"


SERIES = """series AS (
 SELECT CAST(user_id AS VARCHAR) AS participant_id, event_id AS row_order, epoch_us(ts) AS us,
  CASE WHEN event_type IN ('view','click','error') THEN value END AS sensor_a,
  CASE WHEN event_type IN ('view','error') THEN value * 1.1e0 END AS sensor_b,
  CASE WHEN event_type = 'signup' THEN value END AS activity,
  CASE WHEN event_type = 'purchase' THEN CASE event_id % 5 WHEN 0 THEN ' Breakfast' WHEN 1 THEN 'lunch' WHEN 2 THEN 'Snack 1'
       WHEN 3 THEN 'DINNER' ELSE 'brunch' END END AS anchor_label,
  CASE WHEN event_type = 'purchase' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS dose
 FROM events)"""

COHORT = """cohort AS (
 SELECT CAST(o.o_custkey AS VARCHAR) AS participant_id, CAST(o.o_orderkey AS VARCHAR) AS event_id, epoch_us(o.o_orderdate) AS us,
  q AS carbs_g, ROUND(1 + 20 * d, 6) AS activity_level, ROUND(90 + 400 * t, 6) AS baseline_glucose, ROUND(ep / 3000, 6) AS peak_glucose_rise,
  CASE WHEN ROUND(90 + 400 * t, 6) + ROUND(ep / 3000, 6) >= 180 - 1e-6 THEN 1 ELSE 0 END AS label_exceeds_180, c_mktsegment AS grp
 FROM orders o JOIN customer ON c_custkey = o.o_custkey
 JOIN (SELECT l_orderkey, SUM(l_quantity) AS q, AVG(l_discount) AS d, AVG(l_tax) AS t, SUM(l_extendedprice) AS ep
       FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o.o_orderkey)"""


def normalize(c: str) -> str:
    s = f"regexp_replace(lower(trim({c})), '\\s+', ' ', 'g')"
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {s} IN ('breakfast','lunch','dinner') THEN {s} "
            f"WHEN regexp_full_match({s}, 'snacks?( ?[0-9]+)?') THEN 'snack' ELSE 'unrecognized' END")


def event_ctes(channel: str = "sensor_a", name: str = "ev") -> str:
    """CTEs {name}_x (every anchor with facts and reasons) and {name} (the event table), by plain range joins."""
    u = f"{S.unit}e0"
    lag = S.lag_us
    acts = ", ".join(
        f"avg(CASE WHEN s.us < a.us AND s.us >= a.us - {h} THEN s.activity END) AS act{i}, "
        f"count(CASE WHEN s.us < a.us AND s.us >= a.us - {h} THEN s.activity END) AS n_act{i}" for i, h in enumerate(S.activity))
    cov = [f"(n_act{i} / {float(S.activity_rate * h)!r})" for i, h in enumerate(S.activity)]
    usable = f"(n_act0 > 0 AND {cov[0]} >= {S.min_activity_coverage})"
    nob, bad = "(base_v IS NULL)", "(carbs_g IS NULL OR carbs_g < 0)"
    n = name
    return f"""{n}_a AS (
 SELECT participant_id, row_order, us, anchor_label, dose AS carbs_g,
  row_number() OVER (PARTITION BY participant_id ORDER BY us, row_order) - 1 AS ordinal,
  lag(us) OVER (PARTITION BY participant_id ORDER BY us, row_order) AS prev_us,
  lead(us) OVER (PARTITION BY participant_id ORDER BY us, row_order) AS next_us FROM series WHERE anchor_label IS NOT NULL),
{n}_w AS (
 SELECT a.participant_id, a.us AS t0, s.us, s.{channel} AS v,
  s.us - lag(s.us) OVER (PARTITION BY a.participant_id, a.us ORDER BY s.us) AS gap
 FROM {n}_a a JOIN series s ON s.participant_id = a.participant_id AND s.us BETWEEN a.us AND a.us + {S.window} AND s.{channel} IS NOT NULL),
{n}_wa AS (
 SELECT participant_id, t0, count(*) AS n_valid, min(us) AS first_valid, max(us) AS last_valid, max(gap) AS max_gap,
  max(CASE WHEN us > t0 THEN v END) AS peak, count(CASE WHEN us > t0 THEN 1 END) AS n_after FROM {n}_w GROUP BY ALL),
{n}_c AS (
 SELECT a.participant_id, a.us AS t0, count(*) AS n_rows FROM {n}_a a
 JOIN series s ON s.participant_id = a.participant_id AND s.us BETWEEN a.us AND a.us + {S.window} GROUP BY ALL),
{n}_p AS (
 SELECT a.participant_id, a.us AS t0,
  max_by(s.us, s.us) FILTER (WHERE s.{channel} IS NOT NULL AND s.us <= a.us - {lag} AND s.us >= a.us - {lag + S.extra_age}) AS base_us,
  max_by(s.{channel}, s.us) FILTER (WHERE s.{channel} IS NOT NULL AND s.us <= a.us - {lag} AND s.us >= a.us - {lag + S.extra_age}) AS base_v,
  count(s.{channel}) FILTER (WHERE s.us <= a.us - {lag} AND s.us >= a.us - {lag + S.trend}) AS n_trend,
  regr_slope(s.{channel}, (s.us - a.us + {lag}) / {u}) FILTER (WHERE s.{channel} IS NOT NULL AND s.us <= a.us - {lag} AND s.us >= a.us - {lag + S.trend}) AS slope,
  {acts}
 FROM {n}_a a JOIN series s ON s.participant_id = a.participant_id AND s.us BETWEEN a.us - {S.lookback} AND a.us GROUP BY ALL),
{n}_x0 AS (
 SELECT a.participant_id, printf('%s-m%03d', a.participant_id, a.ordinal) AS event_id, a.us, a.anchor_label, {normalize('a.anchor_label')} AS label_norm,
  a.carbs_g, coalesce(w.n_valid, 0) AS n_valid, coalesce(w.n_after, 0) AS n_after, w.peak, c.n_rows,
  CASE WHEN w.n_valid >= 2 THEN (w.first_valid - a.us) / {u} END AS leading_gap,
  CASE WHEN w.n_valid >= 2 THEN w.max_gap / {u} END AS internal_gap,
  CASE WHEN w.n_valid >= 2 THEN (a.us + {S.window} - w.last_valid) / {u} END AS trailing_gap,
  (a.us - a.prev_us) / {u} AS prior_gap, (a.next_us - a.us) / {u} AS next_gap, p.* EXCLUDE (participant_id, t0)
 FROM {n}_a a LEFT JOIN {n}_wa w ON w.participant_id = a.participant_id AND w.t0 = a.us
 LEFT JOIN {n}_c c ON c.participant_id = a.participant_id AND c.t0 = a.us
 LEFT JOIN {n}_p p ON p.participant_id = a.participant_id AND p.t0 = a.us),
{n}_x AS (
 SELECT *, coalesce(prior_gap < {S.overlap_us / S.unit}, FALSE) AS overlaps_prior, coalesce(next_gap < {S.overlap_us / S.unit}, FALSE) AS overlaps_next,
  NOT (coalesce(prior_gap < {S.overlap_us / S.unit}, FALSE) OR coalesce(next_gap < {S.overlap_us / S.unit}, FALSE)) AS isolated,
  CASE WHEN n_valid < 2 THEN 'too_few_readings' ELSE concat_ws(';',
   CASE WHEN leading_gap > {S.max_gap / S.unit} THEN 'leading_gap_exceeds_limit' END,
   CASE WHEN internal_gap > {S.max_gap / S.unit} THEN 'internal_gap_exceeds_limit' END,
   CASE WHEN trailing_gap > {S.trailing / S.unit} THEN 'incomplete_window_end' END) END AS reasons FROM {n}_x0),
{n}_y AS (SELECT *, {usable} AS usable, NOT ({nob} OR {bad} OR NOT isolated) AS core FROM {n}_x WHERE reasons = ''),
{n} AS (
 SELECT participant_id, event_id, us, anchor_label AS label_raw, label_norm, carbs_g, base_v AS baseline_glucose, (us - base_us) / {u} AS baseline_age,
  CASE WHEN n_trend >= {S.trend_min_points} THEN slope END AS trend_slope,
  act0 AS activity_level, least({cov[0]}, 1e0) AS activity_coverage, act1 AS activity_short, least({cov[1]}, 1e0) AS activity_short_coverage,
  act2 AS activity_long, least({cov[2]}, 1e0) AS activity_long_coverage, prior_gap AS time_since_last,
  peak AS peak_glucose, peak - base_v AS peak_glucose_rise, CASE WHEN peak IS NOT NULL THEN CAST(peak >= {S.threshold} AS INT) END AS label_exceeds,
  n_after AS n_window_readings, CASE WHEN n_after > 0 THEN n_after / greatest(n_rows - 1, 1) ELSE 0e0 END AS window_completeness,
  n_valid, leading_gap, internal_gap, trailing_gap, overlaps_prior, overlaps_next, isolated, core AS eligible_core, core AND usable AS eligible_activity,
  concat_ws(';', CASE WHEN {nob} THEN 'baseline_missing' END, CASE WHEN {bad} THEN 'carbs_missing' END,
   CASE WHEN NOT isolated THEN 'overlapping_meal_window' END, CASE WHEN core AND NOT usable THEN 'activity_missing_or_low_coverage' END) AS ineligible_reasons,
  CASE WHEN NOT ({nob} OR {bad} OR overlaps_prior OR overlaps_next OR NOT usable) THEN 'ok' ELSE concat_ws(';', CASE WHEN {nob} THEN 'baseline_missing' END,
   CASE WHEN {bad} THEN 'carbs_missing' END, CASE WHEN overlaps_prior THEN 'overlap_prior' END, CASE WHEN overlaps_next THEN 'overlap_next' END,
   CASE WHEN NOT usable THEN 'activity_missing' END) END AS data_quality_flag
 FROM {n}_y)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


__all__ = ["r", "phi", "SERIES", "COHORT", "normalize", "event_ctes", "with_", "Z90"]
