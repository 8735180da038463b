"""Registered queries: versioned state, replay, reconciliation, explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.functions import quality as ql
from anchorline.functions.numeric import rounded_value
from anchorline.operators import twin as tw
from anchorline.plans import modelsql as M
from anchorline.plans.event_queries import _BASE as EVENTS
from anchorline.plans.event_queries import build
from anchorline.plans.model_queries import oof, rounded, rsql, traj, traj_sql
from anchorline.plans.registry import query
from anchorline.plans.sqltext import COHORT, r, with_
from anchorline.session import stage
from anchorline.sources.adapters import cohort

W = 7200000000
_EX = "CASE WHEN CAST(event_id AS BIGINT) % 43 = 0 THEN 'sensor gap' END"
EXC = f"ce AS (SELECT *, {_EX} AS excluded_reason FROM cohort)"


def with_exclusions(spark, sf):
    return cohort(spark, sf).withColumn("excluded_reason", F.when(F.col("event_id").cast("bigint") % 43 == 0, "sensor gap"))


def scored(spark, sf):
    return stage(oof(spark, sf, "C"), "forecasts")


def trajectory(spark, sf):
    return stage(traj(spark, sf, "C"), "versions")


_LOG = f"""ac AS (SELECT participant_id, event_id, us, us AS "at", 1 AS kind, 'forecast' AS action, 0 AS e FROM ce
 UNION ALL SELECT participant_id, event_id, us, us + {W}, 0, CASE WHEN excluded_reason IS NULL THEN 'reconcile' ELSE 'exclude' END, CASE WHEN excluded_reason IS NULL THEN 1 ELSE 0 END FROM ce),
lg AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(e) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version_after FROM ac WINDOW w AS (PARTITION BY participant_id ORDER BY "at", kind, us, event_id))"""


@query("replay_log", with_(COHORT, EXC, _LOG) + "SELECT participant_id, seq, action, event_id, \"at\", version_after - e AS version_before, version_after FROM lg")
def replay_log(spark, sf):
    return tw.replay_log(stage(with_exclusions(spark, sf), "events"))


@query("resolution_status", with_(COHORT, EXC) + f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN us + {W} > max(us) OVER (PARTITION BY participant_id) THEN 'pending'
 WHEN excluded_reason IS NOT NULL THEN 'excluded' ELSE 'reconciled' END AS status FROM ce) GROUP BY status""")
def resolution_status(spark, sf):
    e = stage(with_exclusions(spark, sf), "events")
    last = e.groupBy("participant_id").agg(F.max("us").alias("as_of"))
    return tw.resolution_status(e.join(last, "participant_id"), "as_of").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("version_after", with_(COHORT, EXC) + """SELECT event_id, CASE WHEN excluded_reason IS NULL THEN CAST(v AS BIGINT) END AS version_after FROM (
 SELECT *, sum(CASE WHEN excluded_reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY participant_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS v FROM ce)""")
def version_after(spark, sf):
    return tw.versions(stage(with_exclusions(spark, sf), "events")).select("event_id", F.col("version_after").cast("bigint").alias("version_after"))


_QR = """concat_ws('; ', CASE WHEN activity_coverage IS NULL THEN 'activity coverage unknown' WHEN activity_coverage < 0.5
  THEN 'low pre-meal activity coverage (' || CAST(CAST(round(activity_coverage * 100) AS INT) AS VARCHAR) || '% of the window)' END,
 CASE WHEN activity_level IS NULL THEN 'pre-meal activity missing' END,
 CASE WHEN baseline_age > 30 THEN 'baseline glucose reading is ' || CAST(CAST(round(baseline_age) AS INT) AS VARCHAR) || ' minutes old' END,
 CASE WHEN baseline_glucose IS NULL THEN 'baseline glucose missing' END, CASE WHEN trend_slope IS NULL THEN 'pre-meal glucose trend unavailable' END)"""


@query("quality_flags", EVENTS + f"""SELECT event_id, reasons, reasons <> '' AS low_data_quality, n_window_readings < 3 AS insufficient_history,
 nullif(concat_ws(' ', CASE WHEN reasons <> '' THEN 'LOW DATA QUALITY: ' || reasons || '.' END,
  CASE WHEN n_window_readings < 3 THEN 'INSUFFICIENT HISTORY: only ' || CAST(n_window_readings AS VARCHAR) || ' own meals observed.' END), '') AS warning,
 window_completeness < 1 AS partial_window FROM (SELECT *, {_QR} AS reasons FROM ev)""")
def quality_flags(spark, sf):
    e = build(spark, sf).withColumn("r", ql.forecast_reasons())
    return e.select("event_id", F.concat_ws("; ", "r").alias("reasons"), (F.size("r") > 0).alias("low_data_quality"), ql.insufficient_history("n_window_readings").alias("insufficient_history"),
                    ql.forecast_warning("r", "n_window_readings").alias("warning"), ql.partial_window("window_completeness").alias("partial_window"))


_FLT = ["p_b", "p_c", "mean_rise_b", "mean_rise_c"]


@query("twin_forecast", with_(*M.SEQ_BC) + f"""SELECT {rsql(['participant_id', 'event_id', 'version', 'insufficient_history'], _FLT)} FROM (
 SELECT b.participant_id, b.event_id, b.n_personal_before AS version, b.n_personal_before < 3 AS insufficient_history, b.p AS p_b, c.p AS p_c, b.mean_rise AS mean_rise_b, c.mean_rise AS mean_rise_c
 FROM fb b JOIN fc c USING (event_id))""")
def twin_forecast(spark, sf):
    from anchorline.operators import compare as cp
    from anchorline.plans.eval_queries import both
    p = cp.pair(*both(spark, sf)).withColumn("version", F.col("n_personal_before_b")).withColumn("insufficient_history", ql.insufficient_history("n_personal_before_b"))
    return rounded(p, ["participant_id", "event_id", "version", "insufficient_history"], _FLT)


# attempts: the right outcome, a too early one, a wrong label, a repeat, an exclusion without a reason
_ATT = f"""att AS (
 SELECT participant_id, event_id, 1 AS arrival, CASE WHEN k % 11 = 0 THEN 'exclude' ELSE 'reconcile' END AS action, CASE WHEN k % 13 = 0 THEN NULL ELSE peak_glucose_rise END AS observed_rise,
  CASE WHEN k % 7 = 0 THEN label_exceeds_180 = 0 ELSE label_exceeds_180 = 1 END AS observed_label, CASE WHEN k % 5 = 0 THEN us ELSE us + {W} END AS observed_through,
  CASE WHEN k % 22 = 0 THEN 'sensor gap' END AS reason FROM (SELECT *, CAST(event_id AS BIGINT) AS k FROM cohort)
 UNION ALL SELECT participant_id, event_id, 2, 'reconcile', peak_glucose_rise, label_exceeds_180 = 1, us + {W}, NULL FROM cohort),
aj AS (SELECT a.*, CASE WHEN a.observed_through < c.us + {W} THEN 'window not complete' WHEN action = 'exclude' AND coalesce(trim(reason), '') = '' THEN 'an exclusion needs a reason'
 WHEN action <> 'exclude' AND observed_rise IS NULL THEN 'observed rise not finite' WHEN action <> 'exclude' AND (baseline_glucose + observed_rise >= 180 - 1e-6) <> observed_label
 THEN 'label disagrees with baseline plus rise' END AS why FROM att a JOIN cohort c USING (event_id))"""


def attempts(e):
    k = F.col("event_id").cast("bigint")
    y = F.col("label_exceeds_180")
    one = e.select("participant_id", "event_id", F.lit(1).alias("arrival"), F.when(k % 11 == 0, "exclude").otherwise("reconcile").alias("action"),
                   F.when(k % 13 != 0, F.col("peak_glucose_rise")).alias("observed_rise"), F.when(k % 7 == 0, y == 0).otherwise(y == 1).alias("observed_label"),
                   F.when(k % 5 == 0, F.col("us")).otherwise(F.col("us") + W).alias("observed_through"), F.when(k % 22 == 0, "sensor gap").alias("reason"))
    two = e.select("participant_id", "event_id", F.lit(2).alias("arrival"), F.lit("reconcile").alias("action"), F.col("peak_glucose_rise").alias("observed_rise"), (y == 1).alias("observed_label"),
                   (F.col("us") + W).alias("observed_through"), F.lit(None).cast("string").alias("reason"))
    return one.unionByName(two)


@query("reconcile_guard", with_(COHORT, _ATT) + """SELECT event_id, arrival, action, coalesce(why, CASE WHEN arrival > min(CASE WHEN why IS NULL THEN arrival END) OVER (PARTITION BY event_id)
 THEN 'already resolved' END) AS refused FROM aj""")
def reconcile_guard(spark, sf):
    e = stage(cohort(spark, sf), "events")
    return tw.reconcile_guard(e, attempts(e)).select("event_id", "arrival", "action", "refused")


@query("initialise_state", with_(COHORT) + """SELECT participant_id, arrival, CASE WHEN h THEN 'already initialised' WHEN arrival > min(arrival) OVER (PARTITION BY participant_id) THEN 'repeated request' END AS refused
 FROM (SELECT participant_id, CAST(event_id AS BIGINT) AS arrival, grp = 'BUILDING' AS h FROM cohort)""")
def initialise_state(spark, sf):
    e = stage(cohort(spark, sf), "events")
    req = e.select("participant_id", F.col("event_id").cast("bigint").alias("arrival"))
    return tw.initialise(e.where(F.col("grp") == "BUILDING"), req).select("participant_id", "arrival", "refused")


_IDM = """rq AS (SELECT participant_id, us, carbs_g, activity_level, CAST(event_id AS BIGINT) AS arrival, us // 31536000000000 AS year FROM cohort)"""


@query("idempotent_ingest", with_(COHORT, _IDM) + """SELECT participant_id, arrival, CASE WHEN arrival = min(arrival) OVER w THEN 'created' WHEN carbs_g = min_by(carbs_g, arrival) OVER w THEN 'repeat' ELSE 'conflict' END AS status
 FROM rq WINDOW w AS (PARTITION BY participant_id, year)""")
def idempotent_ingest(spark, sf):
    rq = stage(cohort(spark, sf), "events").withColumn("arrival", F.col("event_id").cast("bigint")).withColumn("year", F.floor(F.col("us") / 31536000000000))
    return tw.idempotent_intake(rq, ["participant_id", "year"], ["carbs_g"]).select("participant_id", "arrival", "status")


@query("backdate_guard", with_(COHORT) + f"""SELECT event_id, latest AS latest_learned, coalesce(us < latest + {W}, FALSE) AS refused FROM (
 SELECT *, max(CASE WHEN CAST(event_id AS BIGINT) % 3 = 0 THEN us END) OVER (PARTITION BY participant_id ORDER BY CAST(event_id AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM cohort)
 WHERE CAST(event_id AS BIGINT) % 3 <> 0""")
def backdate_guard(spark, sf):
    """Arrival order is the event number; every third event is an outcome that was learned on arrival."""
    e = stage(cohort(spark, sf), "events").withColumn("arrival", F.col("event_id").cast("bigint"))
    return tw.backdate_guard(e.where(F.col("arrival") % 3 != 0), e.where(F.col("arrival") % 3 == 0)).select("event_id", "latest_learned", "refused")


def _obs(e):
    k = F.col("event_id").cast("bigint")
    return e.select("participant_id", "event_id", F.when(k % 9 != 0, F.col("baseline_glucose") + F.col("peak_glucose_rise")).alias("peak_glucose"),
                    F.when(k % 27 == 0, "sensor gap").alias("excluded_reason"), F.when(k % 5 == 0, F.col("us")).otherwise(F.col("us") + W).alias("observed_through"),
                    F.when(k % 4 == 0, 0.9).otherwise(1.0).alias("window_completeness"))


@query("observation_intake", with_(COHORT) + f"""SELECT event_id, CASE WHEN k % 5 = 0 THEN 'outcome window not complete' WHEN k % 9 = 0 AND k % 27 <> 0 THEN 'need exactly one of peak and excluded reason' END AS refused,
 {r('CASE WHEN k % 9 <> 0 THEN baseline_glucose + peak_glucose_rise - baseline_glucose END')} AS peak_rise, CASE WHEN k % 9 <> 0 THEN baseline_glucose + peak_glucose_rise >= 180 END AS reached_threshold,
 CASE WHEN k % 27 = 0 THEN 'excluded' WHEN k % 4 = 0 THEN 'partial_window' END AS flag FROM (SELECT *, CAST(event_id AS BIGINT) AS k FROM cohort)""")
def observation_intake(spark, sf):
    e = stage(cohort(spark, sf), "events")
    return tw.observation_intake(e, _obs(e)).select("event_id", "refused", rounded_value("peak_rise").alias("peak_rise"), "reached_threshold", "flag")


_ACTS = [1.2, 2.0, 3.5]
_SD = lambda a: f"sqrt(s_bb + {a}*{a}*s_gg + 2*{a}*s_bg)"


@query("sensitivity_curve", with_(*traj_sql("C"), "lv AS (SELECT * FROM tj QUALIFY version = max(version) OVER (PARTITION BY participant_id))") + " UNION ALL ".join(
    f"SELECT participant_id, version, {a}e0 AS activity, {r(f'post_b + {a}*post_g')} AS sensitivity, {r(_SD(a))} AS sensitivity_sd, {r(f'post_b + {a}*post_g - {M.Z90}*{_SD(a)}')} AS low90 FROM lv" for a in _ACTS))
def sensitivity_curve(spark, sf):
    return rounded(tw.effective_sensitivity(tw.latest(traj(spark, sf, "C")), _ACTS), ["participant_id", "version", "activity"], ["sensitivity", "sensitivity_sd", "low90"])


_VH = ["beta_mean", "beta_var", "gamma_mean", "gamma_var", "beta_gamma_cov", "carb_sensitivity", "carb_sensitivity_var"]


@query("version_history", with_(*traj_sql("C")) + f"""SELECT {rsql(['participant_id', 'version', 'parent_version'], _VH)} FROM (SELECT participant_id, version, CASE WHEN version > 0 THEN version - 1 END AS parent_version,
 beta_mean, s_bb AS beta_var, gamma_mean, s_gg AS gamma_var, s_bg AS beta_gamma_cov, post_b + 2*post_g AS carb_sensitivity, s_bb + 4*s_gg + 4*s_bg AS carb_sensitivity_var FROM tj)""")
def version_history(spark, sf):
    return rounded(tw.history_rows(traj(spark, sf, "C"), 2.0), ["participant_id", "version", "parent_version"], _VH)


@query("latest_version", with_(*traj_sql("C")) + f"SELECT participant_id, version, event_id, {r('beta_mean')} AS beta_mean FROM tj QUALIFY version = max(version) OVER (PARTITION BY participant_id)")
def latest_version(spark, sf):
    return tw.latest(traj(spark, sf, "C")).select("participant_id", "version", "event_id", rounded_value("beta_mean").alias("beta_mean"))


@query("asof_version", with_(*traj_sql("C")) + f"SELECT participant_id, version, {r('beta_mean')} AS beta_mean, {r('gamma_sd')} AS gamma_sd FROM tj WHERE version = 3")
def asof_version(spark, sf):
    t = trajectory(spark, sf)
    wanted = t.where(F.col("version") == 3).select("participant_id", "version")
    return tw.as_of_version(t, wanted).select("participant_id", "version", rounded_value("beta_mean").alias("beta_mean"), rounded_value("gamma_sd").alias("gamma_sd"))


@query("convergence", with_(*traj_sql("C")) + f"""SELECT participant_id, max(version) AS n_observations, {r('max_by(beta_sd, version)/min_by(beta_sd, version)')} AS beta_ratio,
 {r('max_by(gamma_sd, version)/min_by(gamma_sd, version)')} AS gamma_ratio, bool_and(coalesce(beta_sd <= pb*(1+1e-9)+1e-9, TRUE)) AS beta_monotone, bool_and(coalesce(gamma_sd <= pg*(1+1e-9)+1e-9, TRUE)) AS gamma_monotone
 FROM (SELECT *, lag(beta_sd) OVER w AS pb, lag(gamma_sd) OVER w AS pg FROM tj WINDOW w AS (PARTITION BY participant_id ORDER BY version)) GROUP BY participant_id""")
def convergence(spark, sf):
    return rounded(tw.convergence(trajectory(spark, sf)), ["participant_id", "n_observations", "beta_monotone", "gamma_monotone"], ["beta_ratio", "gamma_ratio"])


_SC = [("reference", 50.0, 2.0, 110.0), ("smaller", 25.0, 2.0, 110.0), ("active", 50.0, 3.5, 110.0), ("extreme", 850.0, 9.0, 110.0)]


def _sc_sql():
    rows = ", ".join(f"({i}, '{n}', {c}e0, {a}e0, {b}e0)" for i, (n, c, a, b) in enumerate(_SC))
    return f"sc(idx, label, carbs_g, activity_level, baseline_glucose) AS (VALUES {rows})"


@query("what_if", with_(*traj_sql("C"), _sc_sql(), """lv AS (SELECT * FROM tj QUALIFY version = max(version) OVER (PARTITION BY participant_id)),
rg AS (SELECT participant_id, min(carbs_g) AS cl, max(carbs_g) AS ch, min(activity_level) AS al, max(activity_level) AS ah FROM cohort GROUP BY 1),
wi AS (SELECT lv.participant_id, idx, label, sc.carbs_g, sc.activity_level, sc.baseline_glucose, sc.carbs_g*post_b + sc.carbs_g*sc.activity_level*post_g AS mean_rise,
 sqrt(nz + sc.carbs_g*sc.carbs_g*(s_bb + 2*sc.activity_level*s_bg + sc.activity_level*sc.activity_level*s_gg)) AS pred_std FROM lv CROSS JOIN sc)""",
                         f"wp AS (SELECT *, {M.phi('((baseline_glucose + mean_rise - 180)/pred_std)')} AS p FROM wi)") + f"""SELECT participant_id, label, {r('mean_rise')} AS mean_rise, {r('p')} AS p,
 {r('mean_rise - first_value(mean_rise) OVER w')} AS delta_rise, {r('p - first_value(p) OVER w')} AS delta_p,
 nullif(concat_ws('; ', CASE WHEN carbs_g < cl OR carbs_g > ch THEN 'carbs_g outside the observed range' END, CASE WHEN activity_level < al OR activity_level > ah THEN 'activity_level outside the observed range' END), '') AS warning
 FROM wp JOIN rg USING (participant_id) WINDOW w AS (PARTITION BY participant_id ORDER BY idx)""")
def what_if(spark, sf):
    s = tw.what_if(stage(tw.latest(traj(spark, sf, "C")), "states"), _SC, tw.observed_ranges(cohort(spark, sf)))
    return rounded(s, ["participant_id", "label", "warning"], ["mean_rise", "p", "delta_rise", "delta_p"])


@query("activity_support", with_(COHORT) + """SELECT event_id, CASE WHEN grp = 'MACHINERY' THEN 'ok' WHEN activity_level BETWEEN 1.5 AND 2.5 THEN 'ok' WHEN grp = 'BUILDING' THEN 'reject' ELSE 'flag' END AS support FROM cohort""")
def activity_support(spark, sf):
    sup = spark.createDataFrame([("BUILDING", "synthetic", 1.5, 2.5)] + [(g, "file", 1.5, 2.5) for g in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD")], "prior_name string, prior_source string, lo double, hi double")
    return tw.activity_support(cohort(spark, sf).withColumnRenamed("grp", "prior_name"), sup).select("event_id", "support")


_RR = ["standardised_error", "probability_of_outcome", "brier"]


@query("reconciliation_report", with_(*M.SEQ_C) + f"""SELECT event_id, rise >= interval90_low AND rise <= interval90_high AS inside90, (p >= 0.5) = (y = 1) AS hit, {r('(rise - mean_rise)/pred_std')} AS standardised_error,
 {r('CASE WHEN y = 1 THEN p ELSE 1 - p END')} AS probability_of_outcome, {r('(p - y)*(p - y)')} AS brier FROM fc""")
def reconciliation_report(spark, sf):
    return rounded(tw.reconciliation_report(oof(spark, sf, "C")), ["event_id", "inside90", "hit"], _RR)


@query("reconciliation_summary", with_(*M.SEQ_C) + f"""SELECT participant_id, count(*) AS n_reconciled, {r('avg(CAST(rise >= interval90_low AND rise <= interval90_high AS INT))')} AS share_inside90,
 {r('avg((rise - mean_rise)/pred_std)')} AS mean_standardised_error, {r('avg((p - y)*(p - y))')} AS mean_brier FROM fc GROUP BY participant_id""")
def reconciliation_summary(spark, sf):
    return rounded(tw.reconciliation_summary(tw.reconciliation_report(scored(spark, sf))), ["participant_id", "n_reconciled"], ["share_inside90", "mean_standardised_error", "mean_brier"])


_HR = """hr AS (SELECT *, (p >= 0.5) = (y = 1) AS hit, row_number() OVER w AS rank, count(*) OVER (PARTITION BY participant_id) AS n FROM fc WINDOW w AS (PARTITION BY participant_id ORDER BY us, event_id))"""


@query("hit_rate", with_(*M.SEQ_C, _HR) + f"""SELECT event_id, rank, {r('avg(CAST(hit AS INT)) OVER (w ROWS UNBOUNDED PRECEDING)')} AS cumulative_hit_rate, {r('avg(CAST(hit AS INT)) OVER (w ROWS 4 PRECEDING)')} AS rolling_hit_rate
 FROM hr WINDOW w AS (PARTITION BY participant_id ORDER BY rank)""")
def hit_rate(spark, sf):
    return rounded(tw.hit_rates(tw.reconciliation_report(scored(spark, sf))), ["event_id", "rank"], ["cumulative_hit_rate", "rolling_hit_rate"])


@query("hit_halves", with_(*M.SEQ_C, _HR) + f"""SELECT participant_id, n, {r('avg(CASE WHEN rank <= n//2 THEN CAST(hit AS INT) END)')} AS first_half, {r('avg(CASE WHEN rank > n//2 AND n//2 > 0 THEN CAST(hit AS INT) END)')} AS second_half,
 {r('avg(CAST(hit AS INT))')} AS overall FROM hr GROUP BY participant_id, n""")
def hit_halves(spark, sf):
    return rounded(tw.hit_halves(stage(tw.hit_rates(tw.reconciliation_report(scored(spark, sf))), "hits")), ["participant_id", "n"], ["first_half", "second_half", "overall"])


@query("rolling_brier", with_(*M.SEQ_C, _HR) + f"""SELECT participant_id, count(*) AS n_in_window, {r('CASE WHEN count(*) >= 3 THEN avg((p - y)*(p - y)) END')} AS rolling_brier FROM hr WHERE rank > n - 10 GROUP BY participant_id""")
def rolling_brier(spark, sf):
    return rounded(tw.rolling_brier(stage(tw.hit_rates(tw.reconciliation_report(scored(spark, sf))), "hits")), ["participant_id", "n_in_window"], ["rolling_brier"])


@query("own_history", with_(COHORT) + f"""SELECT a.event_id, count(b.event_id) AS n_similar, {r('avg(b.peak_glucose_rise)')} AS mean_rise_similar, {r('avg(b.label_exceeds_180)')} AS share_reached
 FROM cohort a LEFT JOIN cohort b ON a.participant_id = b.participant_id AND b.us + {W} <= a.us AND abs(b.carbs_g - a.carbs_g) <= 0.25*a.carbs_g GROUP BY a.event_id""")
def own_history(spark, sf):
    e = stage(cohort(spark, sf).withColumn("rise", F.col("peak_glucose_rise")).withColumn("y", F.col("label_exceeds_180")), "events")
    return rounded(tw.own_history(e, e), ["event_id", "n_similar"], ["mean_rise_similar", "share_reached"])


_XP = ["carb_term", "carb_term_sd", "activity_term", "activity_term_sd", "parameter_variance", "share_parameter", "margin"]


@query("explanation", with_(*M.SEQ_C) + f"""SELECT event_id, 'expected rise ' || {'{}'} AS text, {', '.join(f'{r(c)} AS {c}' for c in _XP)} FROM (SELECT *, baseline_glucose + mean_rise - 180 AS margin,
 carbs_g*beta_mean_before AS carb_term, carbs_g*beta_sd_before AS carb_term_sd, carbs_g*activity*gamma_mean_before AS activity_term, carbs_g*activity*gamma_sd_before AS activity_term_sd, pv AS parameter_variance, pv/(pred_std*pred_std) AS share_parameter
 FROM (SELECT *, carbs_g*carbs_g*(beta_sd_before*beta_sd_before + 2*activity*s_bg + activity*activity*gamma_sd_before*gamma_sd_before) AS pv FROM fc))""".replace("{}", """CAST(CAST(round(mean_rise) AS BIGINT) AS VARCHAR) || ' (sd ' ||
 CAST(CAST(round(pred_std) AS BIGINT) AS VARCHAR) || '); carbohydrate ' || CAST(CAST(round(carb_term) AS BIGINT) AS VARCHAR) || ', activity ' || CAST(CAST(round(activity_term) AS BIGINT) AS VARCHAR) || '; ' ||
 CAST(CAST(round(100*share_parameter) AS BIGINT) AS VARCHAR) || '% of the variance is parameter uncertainty'"""))
def explanation(spark, sf):
    return rounded(tw.explain(scored(spark, sf)), ["event_id", "text"], _XP)


@query("trend_words", EVENTS + "SELECT event_id, CASE WHEN trend_slope > 0.1 THEN 'rising' WHEN trend_slope < -0.1 THEN 'falling' WHEN trend_slope IS NOT NULL THEN 'flat' END AS trend FROM ev")
def trend_words(spark, sf):
    return build(spark, sf).select("event_id", tw.trend_word("trend_slope").alias("trend"))


@query("state_view", with_(*M.SEQ_C) + f"""SELECT participant_id, max(as_of) AS as_of, count(*) AS n_forecasts, count(*) FILTER (us + {W} > as_of) AS open_windows,
 {r(f'sum(CASE WHEN us + {W} > as_of THEN carbs_g ELSE 0 END)')} AS carbs_in_open_windows, {r('max(CASE WHEN rk = 1 THEN baseline_glucose END)')} AS last_glucose, {r('max(CASE WHEN rk = 1 THEN p END)')} AS last_p
 FROM (SELECT *, max(us) OVER (PARTITION BY participant_id) AS as_of, row_number() OVER (PARTITION BY participant_id ORDER BY us DESC, event_id DESC) AS rk FROM fc) GROUP BY participant_id""")
def state_view(spark, sf):
    return rounded(tw.state_view(scored(spark, sf)), ["participant_id", "as_of", "n_forecasts", "open_windows"], ["carbs_in_open_windows", "last_glucose", "last_p"])


@query("store_overview", with_(*traj_sql("C"), f"""lv AS (SELECT * FROM tj QUALIFY version = max(version) OVER (PARTITION BY participant_id)),
st AS (SELECT participant_id, count(*) FILTER (us + {W} <= mx) AS n_reconciled, count(*) FILTER (us + {W} > mx) AS n_pending FROM (SELECT *, max(us) OVER (PARTITION BY participant_id) AS mx FROM cohort) GROUP BY 1)""")
       + f"SELECT participant_id, version, n_reconciled, n_pending, {r('beta_mean')} AS beta_mean, {r('gamma_mean')} AS gamma_mean FROM lv JOIN st USING (participant_id)")
def store_overview(spark, sf):
    e = stage(cohort(spark, sf).withColumn("excluded_reason", F.lit(None).cast("string")), "events")
    last = e.groupBy("participant_id").agg(F.max("us").alias("as_of"))
    return rounded(tw.overview(e, traj(spark, sf, "C"), last), ["participant_id", "version", "n_reconciled", "n_pending"], ["beta_mean", "gamma_mean"])


@query("paging", with_(COHORT) + "SELECT event_id, us, (SELECT count(*) FROM cohort) AS total FROM cohort ORDER BY us, event_id LIMIT 20 OFFSET 40")
def paging(spark, sf):
    return tw.page(stage(cohort(spark, sf), "events"), 20, 40).select("event_id", "us", "total")


@query("request_quarantine", with_(COHORT) + """SELECT event_id, concat_ws(';', CASE WHEN NOT (carbs_g * 5 BETWEEN 0 AND 500) THEN 'carbs_out_of_range' END, CASE WHEN NOT (baseline_glucose * 6 BETWEEN 20 AND 600) THEN 'baseline_out_of_range' END,
 CASE WHEN NOT (activity_level * 10 BETWEEN 0 AND 25) THEN 'activity_out_of_range' END,
 CASE WHEN NOT regexp_full_match(eid, '[A-Za-z0-9][A-Za-z0-9._:-]{0,63}') THEN 'bad_identifier' END, CASE WHEN NOT (cov BETWEEN 0 AND 1) THEN 'coverage_out_of_range' END, CASE WHEN NOT (age BETWEEN 0 AND 1440) THEN 'baseline_age_out_of_range' END,
 CASE WHEN NOT (slope BETWEEN -20 AND 20) THEN 'trend_out_of_range' END, CASE WHEN NOT (since BETWEEN 0 AND 100000) THEN 'time_since_last_out_of_range' END, CASE WHEN NOT (length(reason) BETWEEN 3 AND 200) THEN 'bad_reason_length' END) AS faults
 FROM (SELECT *, CASE WHEN n % 5 = 0 THEN '..' || event_id WHEN n % 7 = 0 THEN repeat('a', 65) ELSE event_id END AS eid, n % 12 / 10e0 AS cov, n % 1500 AS age, n % 50 - 25 AS slope, n * 977 % 120000 AS since, CASE WHEN n % 3 = 0 THEN repeat('x', CAST(n % 300 AS BIGINT)) END AS reason
  FROM (SELECT *, us // 3600000000 AS n FROM cohort))""")
def request_quarantine(spark, sf):
    e = cohort(spark, sf).select("event_id", (F.col("carbs_g") * 5).alias("carbs_g"), (F.col("baseline_glucose") * 6).alias("baseline_glucose"), (F.col("activity_level") * 10).alias("activity_level"), F.expr("us div 3600000000").alias("n"))
    n, eid = F.col("n"), F.when(F.col("n") % 5 == 0, F.concat(F.lit(".."), "event_id")).when(F.col("n") % 7 == 0, F.lit("a" * 65)).otherwise(F.col("event_id"))
    e = e.select(F.col("event_id").alias("key"), eid.alias("event_id"), "carbs_g", "baseline_glucose", "activity_level", (n % 12 / 10.0).alias("activity_coverage"), (n % 1500).alias("baseline_age"), (n % 50 - 25).alias("trend_slope"),
                 (n * 977 % 120000).alias("time_since_last"), F.when(n % 3 == 0, F.expr("repeat('x', CAST(n % 300 AS INT))")).alias("excluded_reason"))
    return e.select(F.col("key").alias("event_id"), F.concat_ws(";", ql.request_faults(e.columns)).alias("faults"))

