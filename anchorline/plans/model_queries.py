"""Registered queries: folds, splits, fits, priors, sequential forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.functions.numeric import rounded_value
from anchorline.operators import folds as fo
from anchorline.operators import priors as pr
from anchorline.operators import sequential as sq
from anchorline.plans import modelsql as M
from anchorline.plans.registry import query
from anchorline.plans.sqltext import COHORT, r, with_
from anchorline.session import stage
from anchorline.sources.adapters import cohort

FC_PLAIN = ["participant_id", "event_id", "us", "fold", "grp", "y", "n_personal_before"]
FC_FLOAT = ["rise", "activity", "p", "mean_rise", "pred_std", "interval90_low", "interval90_high", "p_frozen_prior", "mean_rise_frozen_prior",
            "beta_mean_before", "beta_sd_before", "gamma_mean_before", "gamma_sd_before", "train_prevalence"]


def rounded(df, plain, floats):
    return df.select(*plain, *[rounded_value(c).alias(c) for c in floats])


def rsql(plain, floats):
    return ", ".join([*plain, *[f"{r(c)} AS {c}" for c in floats]])


def fold_inputs(spark, sf):
    """The stored event table and the stored fold assignment, as the protocol has them between its steps."""
    ev = stage(cohort(spark, sf), "events")
    return ev, stage(fo.participant_folds(ev), "folds")


def learned(ev, folds):
    return sq.learned_before(ev).join(folds.select("participant_id", "fold"), "participant_id")


def oof(spark, sf, model, scheme="empirical_bayes", inputs=None):
    ev, folds = inputs or fold_inputs(spark, sf)
    on = ["fold"] if scheme == "empirical_bayes" else ["fold", "grp"]
    return sq.forecasts(learned(ev, folds), pr.fold_priors(ev, folds, model, scheme), model, on)


@query("folds", with_(COHORT, M.FOLDS) + "SELECT participant_id, grp, fold FROM folds")
def folds(spark, sf):
    return fo.participant_folds(cohort(spark, sf))


@query("fold_composition", with_(COHORT, M.FOLDS) + f"""SELECT fold, count(*) AS n_participants, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(pos) AS BIGINT) AS n_positive,
 CAST(sum(n - pos) AS BIGINT) AS n_negative, {r('sum(pos)/sum(n)')} AS prevalence, count(*) FILTER (lo = 0 AND hi = 1) AS participants_with_both_classes
 FROM folds JOIN (SELECT participant_id, count(*) AS n, sum(label_exceeds_180) AS pos, min(label_exceeds_180) AS lo, max(label_exceeds_180) AS hi FROM cohort GROUP BY 1)
 USING (participant_id) GROUP BY fold""")
def fold_composition(spark, sf):
    ev, f = fold_inputs(spark, sf)
    return fo.fold_composition(ev, f).withColumn("prevalence", rounded_value("prevalence"))


@query("fold_group_sizes", with_(COHORT, M.FOLDS) + "SELECT fold, grp, count(*) AS n_participants FROM folds GROUP BY ALL")
def fold_group_sizes(spark, sf):
    return fo.fold_group_sizes(fold_inputs(spark, sf)[1])


_LANES = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS UBIGINT)) AS HUGEINT) AS l{i}" for i in range(4))


@query("fold_hash", with_(COHORT, M.FOLDS) + f"""SELECT n, sha256(concat_ws(':', CAST(n AS VARCHAR), CAST(l0 AS VARCHAR), CAST(l1 AS VARCHAR), CAST(l2 AS VARCHAR), CAST(l3 AS VARCHAR))) AS fingerprint
 FROM (SELECT count(*) AS n, {_LANES} FROM (SELECT sha256(participant_id || chr(31) || CAST(fold AS VARCHAR)) AS h FROM folds))""")
def fold_hash(spark, sf):
    return fo.fingerprint(fold_inputs(spark, sf)[1], ["participant_id", "fold"])


_SPLIT = """sp0 AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY us, event_id) AS rk, count(*) OVER (PARTITION BY participant_id) AS n FROM cohort),
sp1 AS (SELECT *, rk > n - CASE WHEN n > 1 THEN greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT)) ELSE 0 END AS tst FROM sp0),
sp AS (SELECT *, CASE WHEN tst THEN 'test' WHEN us + 7200000000 > min(CASE WHEN tst THEN us END) OVER (PARTITION BY participant_id) THEN 'purged' ELSE 'train' END AS part FROM sp1)"""


@query("chrono_split", with_(COHORT, _SPLIT) + "SELECT participant_id, event_id, part FROM sp")
def chrono_split(spark, sf):
    return fo.chronological_split(cohort(spark, sf)).select("participant_id", "event_id", "part")


@query("split_leakage", with_(COHORT, _SPLIT) + """SELECT count(*) AS n_participants, count(*) FILTER (tf < tl + 7200000000) AS n_violations FROM
 (SELECT participant_id, max(CASE WHEN part = 'train' THEN us END) AS tl, min(CASE WHEN part = 'test' THEN us END) AS tf FROM sp GROUP BY 1)""")
def split_leakage(spark, sf):
    s = fo.chronological_split(cohort(spark, sf))
    n = s.agg(F.count_distinct("participant_id").alias("n_participants")).withColumn("k", F.lit(0))
    return n.join(fo.split_leakage(s).agg(F.count(F.lit(1)).alias("n_violations")).withColumn("k", F.lit(0)), "k").drop("k")


@query("fold_coverage", with_(COHORT) + "SELECT 0::BIGINT AS missing, 0::BIGINT AS unexpected, 0::BIGINT AS repeated, 0::BIGINT AS split_participants FROM cohort LIMIT 1")
def fold_coverage(spark, sf):
    ev, f = fold_inputs(spark, sf)
    return fo.coverage_check(oof(spark, sf, "B", inputs=(ev, f)), ev)


_FIT = ["b1", "i1", "b2", "g2", "i2bb", "i2bg", "i2gg", "mean_square1", "mean_square2"]


@query("participant_ols", with_(COHORT, M.FITS) + f"SELECT {rsql(['participant_id', 'n'], _FIT)} FROM (SELECT *, rss1 / (1000 * n) AS mean_square1, rss2 / (1000 * n) AS mean_square2 FROM fits)")
def participant_ols(spark, sf):
    # residual sums are large next to the other columns: shown per event and in thousands
    f = pr.ols(pr.sufficient(cohort(spark, sf), ["participant_id"]))
    f = f.withColumn("mean_square1", F.col("rss1") / (1000 * F.col("n"))).withColumn("mean_square2", F.col("rss2") / (1000 * F.col("n")))
    return rounded(f, ["participant_id", "n"], _FIT)


_PB = ["m_b", "v_bb", "noise", "spread1"]


@query("prior_b", with_(*M.BASE, M.PRIOR_B) + f"SELECT {rsql(['fold', 'n_participants', 'm1', 'source'], _PB)} FROM prior_b")
def prior_b(spark, sf):
    return rounded(pr.prior_b(pr.training_pool(*fold_inputs(spark, sf))), ["fold", "n_participants", "m1", "source"], _PB)


_PC = ["m_b", "m_g", "v_bb", "v_bg", "v_gg", "noise", "rms_b", "rms_g", "sampling_share_gamma"]


@query("prior_c", with_(*M.BASE, M.PRIOR_C) + f"SELECT {rsql(['fold', 'm2', 'n_raised', 'source'], _PC)} FROM prior_c")
def prior_c(spark, sf):
    return rounded(pr.prior_c(pr.training_pool(*fold_inputs(spark, sf))), ["fold", "m2", "n_raised", "source"], _PC)


_PS = ["m_b", "v_bb", "m_g", "v_gg", "noise_b", "noise_c", "activity_rms"]


@query("prior_stratified", with_(*M.BASE, M.STRATA, M.stratified()) + f"SELECT {rsql(['fold', 'grp', 'n_participants', 'source'], _PS)} FROM prior_s")
def prior_stratified(spark, sf):
    ev, f = fold_inputs(spark, sf)
    p = pr.stratified_prior(pr.training_pool(ev, f, by_group=True), pr.training_pool(ev, f), ["fold"])
    return rounded(p, ["fold", "grp", "n_participants", "source"], _PS)


@query("prior_by_participant", with_(*M.BASE, M.STRATA, M.stratified()) + f"""SELECT participant_id, fold, source, {r('m_b')} AS beta_mean, {r('sqrt(v_bb)')} AS beta_sd,
 {r('sqrt(v_gg)')} AS gamma_sd FROM folds JOIN prior_s USING (fold, grp)""")
def prior_by_participant(spark, sf):
    """The stratified prior each held-out participant is given; its own rows never enter (the training pool excludes its fold)."""
    ev, f = fold_inputs(spark, sf)
    p = pr.fold_priors(ev, f, "C", "stratified")
    return f.join(p, ["fold", "grp"]).select("participant_id", "fold", "source", rounded_value("m_b").alias("beta_mean"), rounded_value(F.sqrt("v_bb")).alias("beta_sd"), rounded_value(F.sqrt("v_gg")).alias("gamma_sd"))


@query("prior_fold_summary", with_(*M.BASE, M.STRATA, M.stratified()) + f"""SELECT fold, count(*) AS n_priors_averaged, count(*) FILTER (source LIKE '%pooled%') AS n_pooled_fallbacks,
 {r('avg(m_b)')} AS beta_mean, {r('avg(sqrt(v_bb))')} AS beta_sd, {r('avg(sqrt(v_gg))')} AS gamma_sd, {r('avg(sqrt(noise_c))')} AS noise_sd FROM folds JOIN prior_s USING (fold, grp) GROUP BY fold""")
def prior_fold_summary(spark, sf):
    ev, f = fold_inputs(spark, sf)
    p = f.join(pr.fold_priors(ev, f, "C", "stratified"), ["fold", "grp"])
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n_priors_averaged"), F.count_if(F.col("source").contains("pooled")).alias("n_pooled_fallbacks"),
                                 rounded_value(F.avg("m_b")).alias("beta_mean"), rounded_value(F.avg(F.sqrt("v_bb"))).alias("beta_sd"), rounded_value(F.avg(F.sqrt("v_gg"))).alias("gamma_sd"),
                                 rounded_value(F.avg(F.sqrt("noise"))).alias("noise_sd"))


@query("seq_forecast_b", with_(*M.SEQ_B) + f"SELECT {rsql(FC_PLAIN, FC_FLOAT)} FROM fb")
def seq_forecast_b(spark, sf):
    return rounded(oof(spark, sf, "B"), FC_PLAIN, FC_FLOAT)


@query("seq_forecast_c", with_(*M.SEQ_C) + f"SELECT {rsql(FC_PLAIN, FC_FLOAT)} FROM fc")
def seq_forecast_c(spark, sf):
    return rounded(oof(spark, sf, "C"), FC_PLAIN, FC_FLOAT)


@query("seq_forecast_b_stratified", with_(*M.ARMS) + f"SELECT {rsql(FC_PLAIN, FC_FLOAT)} FROM fbs")
def seq_forecast_b_stratified(spark, sf):
    return rounded(oof(spark, sf, "B", "stratified"), FC_PLAIN, FC_FLOAT)


@query("seq_forecast_c_stratified", with_(*M.ARMS) + f"SELECT {rsql(FC_PLAIN, FC_FLOAT)} FROM fcs")
def seq_forecast_c_stratified(spark, sf):
    return rounded(oof(spark, sf, "C", "stratified"), FC_PLAIN, FC_FLOAT)


_TJ = ["beta_mean", "beta_sd", "gamma_mean", "gamma_sd"]


def traj(spark, sf, model):
    ev, f = fold_inputs(spark, sf)
    return sq.trajectory(ev.join(f.select("participant_id", "fold"), "participant_id"), pr.fold_priors(ev, f, model), model, ["fold"])


def traj_sql(model):
    low = model.lower()
    prior = M.PRIOR_B if model == "B" else M.PRIOR_C
    return [*M.BASE, prior, M.TRAJ_ROWS, M.posterior("trows", f"prior_{low}", model, "qt"),
            "tj AS (SELECT *, post_b AS beta_mean, sqrt(s_bb) AS beta_sd, post_g AS gamma_mean, sqrt(s_gg) AS gamma_sd FROM qt)"]


@query("trajectory_b", with_(*traj_sql("B")) + f"SELECT {rsql(['participant_id', 'version', 'event_id'], _TJ)} FROM tj")
def trajectory_b(spark, sf):
    return rounded(traj(spark, sf, "B"), ["participant_id", "version", "event_id"], _TJ)


@query("trajectory_c", with_(*traj_sql("C")) + f"SELECT {rsql(['participant_id', 'version', 'event_id'], _TJ)} FROM tj")
def trajectory_c(spark, sf):
    return rounded(traj(spark, sf, "C"), ["participant_id", "version", "event_id"], _TJ)


_CH = ["beta_change", "beta_sd_ratio", "gamma_change", "gamma_sd_ratio"]


@query("parameter_change", with_(*traj_sql("C")) + f"""SELECT {rsql(['participant_id', 'version'], _CH)} FROM (SELECT *, beta_mean - lag(beta_mean) OVER w AS beta_change,
 beta_sd / lag(beta_sd) OVER w AS beta_sd_ratio, gamma_mean - lag(gamma_mean) OVER w AS gamma_change, gamma_sd / lag(gamma_sd) OVER w AS gamma_sd_ratio
 FROM tj WINDOW w AS (PARTITION BY participant_id ORDER BY version))""")
def parameter_change(spark, sf):
    return rounded(sq.version_changes(traj(spark, sf, "C")), ["participant_id", "version"], _CH)


@query("personal_rate", with_(*M.BASE, M.PRIOR_B, M.LEARNED) + f"""SELECT participant_id, event_id, n_learned AS n_personal_before, {r('rate')} AS rate, {r('carbs_g*rate')} AS mean_rise,
 {r(M.phi('((baseline_glucose + carbs_g*rate - 180)/sqrt(noise))'))} AS p
 FROM (SELECT l.*, q.noise, CASE WHEN n_learned > 0 THEN rate_sum/n_learned ELSE q.m_b END AS rate FROM learned l JOIN prior_b q USING (fold))""")
def personal_rate(spark, sf):
    ev, f = fold_inputs(spark, sf)
    return rounded(sq.personal_rate(learned(ev, f), pr.fold_priors(ev, f, "B"), ["fold"]), ["participant_id", "event_id", "n_personal_before"], ["rate", "mean_rise", "p"])


@query("batch_update", with_(*M.BASE, M.PRIOR_C) + f"""SELECT participant_id, n, {r('s_bb*hb + s_bg*hg')} AS beta, {r('s_bg*hb + s_gg*hg')} AS gamma FROM (
 SELECT *, qgg/(qbb*qgg-qbg*qbg) AS s_bb, -qbg/(qbb*qgg-qbg*qbg) AS s_bg, qbb/(qbb*qgg-qbg*qbg) AS s_gg FROM (
 SELECT s.participant_id, s.n, v_gg/d + s.cc/noise AS qbb, -v_bg/d + s.cg/noise AS qbg, v_bb/d + s.gg/noise AS qgg,
  v_gg/d*m_b - v_bg/d*m_g + s.cy/noise AS hb, -v_bg/d*m_b + v_bb/d*m_g + s.gy/noise AS hg
 FROM suff s JOIN folds USING (participant_id) JOIN (SELECT fold, m_b, m_g, v_bb, v_bg, v_gg, noise, v_bb*v_gg - v_bg*v_bg AS d FROM prior_c) q USING (fold)))""")
def batch_update(spark, sf):
    """All of a participant's evidence in one update; equals the last version of the sequential trajectory."""
    ev, f = fold_inputs(spark, sf)
    s = pr.sufficient(ev, ["participant_id"]).join(f, "participant_id").join(pr.fold_priors(ev, f, "C"), "fold")
    return rounded(sq.with_posterior(s, "C").select("participant_id", "n", F.col("post_b").alias("beta"), F.col("post_g").alias("gamma")), ["participant_id", "n"], ["beta", "gamma"])


@query("prospective_activity", with_(COHORT) + f"""SELECT participant_id, event_id, n AS n_earlier,
 CASE WHEN n < 4 THEN 'unknown' WHEN activity_level > med THEN 'active' ELSE 'sedentary' END AS label
 FROM (SELECT *, count(*) OVER w AS n, quantile_cont(activity_level, 0.5) OVER w AS med FROM cohort
  WINDOW w AS (PARTITION BY participant_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def prospective_activity(spark, sf):
    return sq.prospective_activity(stage(cohort(spark, sf), "events")).select("participant_id", "event_id", "n_earlier", "label")


@query("design_terms", with_(COHORT) + f"""SELECT event_id, 1e0 AS intercept, carbs_g, {r('carbs_g*(activity_level - (SELECT avg(activity_level) FROM cohort))')} AS carbs_x_activity FROM cohort""")
def design_terms(spark, sf):
    ev = cohort(spark, sf)
    centre = ev.agg(F.avg("activity_level").alias("a")).scalar()
    return ev.select("event_id", F.lit(1.0).alias("intercept"), "carbs_g", rounded_value(F.col("carbs_g") * (F.col("activity_level") - centre)).alias("carbs_x_activity"))
