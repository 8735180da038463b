"""Oracle CTEs for folds, fits, priors and sequential forecasts (DuckDB dialect)."""

from __future__ import annotations

from anchorline.plans.sqltext import COHORT, Z90, phi, r, with_

W = 7200000000

FOLDS = """folds AS (
 SELECT participant_id, grp, CAST((row_number() OVER (ORDER BY grp, md5('0|' || participant_id), participant_id) - 1) % 5 AS INT) AS fold
 FROM (SELECT DISTINCT participant_id, grp FROM cohort))"""

FITS = """suff AS (
 SELECT participant_id, count(*) AS n, sum(carbs_g*carbs_g) AS cc, sum(carbs_g*carbs_g*activity_level) AS cg,
  sum(carbs_g*activity_level*carbs_g*activity_level) AS gg, sum(carbs_g*peak_glucose_rise) AS cy, sum(carbs_g*activity_level*peak_glucose_rise) AS gy,
  sum(peak_glucose_rise*peak_glucose_rise) AS yy, sum(activity_level*activity_level) AS aa, sum(label_exceeds_180) AS pos FROM cohort GROUP BY participant_id),
fit0 AS (SELECT *, n > 1 AND cc > 0 AS ok1, n > 2 AND cc*gg - cg*cg > 1e-10*cc*gg AS ok2, cc*gg - cg*cg AS det FROM suff),
fit1 AS (SELECT *, CASE WHEN ok1 THEN cy/cc END AS b1, CASE WHEN ok1 THEN 1/cc END AS i1, CASE WHEN ok2 THEN (gg*cy - cg*gy)/det END AS b2,
  CASE WHEN ok2 THEN (cc*gy - cg*cy)/det END AS g2, CASE WHEN ok2 THEN gg/det END AS i2bb, CASE WHEN ok2 THEN -cg/det END AS i2bg, CASE WHEN ok2 THEN cc/det END AS i2gg FROM fit0),
fits AS (SELECT *, CASE WHEN ok1 THEN greatest(yy - b1*cy, 0) END AS rss1, CASE WHEN ok2 THEN greatest(yy - b2*cy - g2*gy, 0) END AS rss2 FROM fit1)"""


def _pool(name: str, keys: str, src: str) -> str:
    return f"""{name} AS (SELECT {keys}, count(*) AS n_participants, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in 'n cc cg gg cy gy yy aa pos'.split())},
 count(b1) AS m1, sum(rss1) AS s_rss1, CAST(sum(CASE WHEN b1 IS NOT NULL THEN n - 1 END) AS DOUBLE) AS s_df1, var_samp(b1) AS spread1, avg(i1) AS i1,
 count(b2) AS m2, sum(rss2) AS s_rss2, CAST(sum(CASE WHEN b2 IS NOT NULL THEN n - 2 END) AS DOUBLE) AS s_df2, var_samp(b2) AS sbb, covar_samp(b2, g2) AS sbg,
 var_samp(g2) AS sgg, avg(i2bb) AS ibb, avg(i2bg) AS ibg, avg(i2gg) AS igg FROM {src} GROUP BY {keys})"""


TRAIN = """train AS (SELECT f.*, k.k AS fold, g.grp FROM fits f JOIN folds g USING (participant_id) JOIN (SELECT unnest(range(5)) AS k) k ON k.k <> g.fold)"""
POOL = _pool("pool", "fold", "train")
STRATA = _pool("strata", "fold, grp", "train")

PRIOR_B = """pb0 AS (SELECT *, cy/cc AS m_b, CASE WHEN m1 >= 5 THEN greatest(s_rss1/s_df1, 1e-6) ELSE greatest(greatest(yy - cy*cy/cc, 0)/greatest(n-1, 1), 1e-6) END AS noise FROM pool),
prior_b AS (SELECT *, CASE WHEN m1 >= 5 THEN greatest(spread1 - noise*i1, greatest(1e-3*spread1, 1e-9)) ELSE 1e4 END AS v_bb, 0e0 AS m_g, 0e0 AS v_bg, 0e0 AS v_gg,
 CASE WHEN m1 >= 5 THEN 'empirical_bayes_hierarchical' ELSE 'diffuse_fallback' END AS source, pos/n AS train_prevalence FROM pb0)"""

PRIOR_C = """pc0 AS (SELECT *, (gg*cy - cg*gy)/(cc*gg - cg*cg) AS m_b, (cc*gy - cg*cy)/(cc*gg - cg*cg) AS m_g, sqrt(cc/n) AS rms_b, sqrt(gg/n) AS rms_g FROM pool),
pc1 AS (SELECT *, CASE WHEN m2 >= 5 THEN greatest(s_rss2/s_df2, 1e-6) ELSE greatest(greatest(yy - m_b*cy - m_g*gy, 0)/greatest(n-2, 1), 1e-6) END AS noise FROM pc0),
pc2 AS (SELECT *, (sbb - noise*ibb)*rms_b*rms_b AS ea, (sbg - noise*ibg)*rms_b*rms_g AS eb, (sgg - noise*igg)*rms_g*rms_g AS ed,
 greatest(1e-3*(sbb*rms_b*rms_b + sgg*rms_g*rms_g)/2, 1e-12) AS fl FROM pc1),
pc3 AS (SELECT *, sqrt(((ea-ed)/2)*((ea-ed)/2) + eb*eb) AS h FROM pc2),
pc4 AS (SELECT *, (ea+ed)/2 - h AS lo, (ea+ed)/2 + h AS hi FROM pc3),
pc5 AS (SELECT *, greatest(lo, fl) AS flo, greatest(hi, fl) AS fhi, CASE WHEN h > 0 THEN (ea-lo)/(2*h) ELSE 0 END AS paa, CASE WHEN h > 0 THEN eb/(2*h) ELSE 0 END AS pbb,
 CASE WHEN h > 0 THEN (ed-lo)/(2*h) ELSE 0 END AS pdd FROM pc4),
prior_c AS (SELECT *, CASE WHEN m2 >= 5 THEN (fhi*paa + flo*(1-paa))/(rms_b*rms_b) ELSE 1e4/(rms_b*rms_b) END AS v_bb,
 CASE WHEN m2 >= 5 THEN (fhi-flo)*pbb/(rms_b*rms_g) ELSE 0 END AS v_bg, CASE WHEN m2 >= 5 THEN (fhi*pdd + flo*(1-pdd))/(rms_g*rms_g) ELSE 1e4/(rms_g*rms_g) END AS v_gg,
 CASE WHEN m2 >= 5 THEN CAST(lo < fl AS INT) + CAST(hi < fl AS INT) END AS n_raised, CASE WHEN m2 >= 5 AND sgg > 0 THEN noise*igg/sgg END AS sampling_share_gamma,
 CASE WHEN m2 >= 5 THEN 'empirical_bayes_hierarchical_scale_aware' ELSE 'diffuse_fallback' END AS source, pos/n AS train_prevalence FROM pc5)"""


def stratified(width: float = 0.5) -> str:
    mv = lambda p: (f"CASE WHEN {p}m1 >= 5 THEN greatest({p}spread1 - greatest({p}s_rss1/{p}s_df1, 1e-6)*{p}i1, 1e-3*{p}spread1, 1e-9) END")
    return f"""ps0 AS (SELECT g.fold, g.grp, coalesce(s.n_participants, 0) AS n_participants, s.* EXCLUDE (fold, grp, n_participants),
 {', '.join(f'w.{c} AS w_{c}' for c in 'n cc cg gg cy gy yy aa pos m1 s_rss1 s_df1 spread1 i1 m2 s_rss2 s_df2'.split())}
 FROM (SELECT DISTINCT fold, grp FROM folds) g LEFT JOIN strata s ON s.fold = g.fold AND s.grp = g.grp JOIN pool w ON w.fold = g.fold),
ps1 AS (SELECT *, CASE WHEN n_participants >= 5 THEN cy/cc ELSE w_cy/w_cc END AS m_b, sqrt(w_aa/w_n) AS activity_rms FROM ps0),
prior_s AS (SELECT *, coalesce(CASE WHEN n_participants >= 5 THEN {mv('')} END, {mv('w_')}, greatest(abs(m_b), 1e-3)*greatest(abs(m_b), 1e-3)) AS v_bb, 0e0 AS m_g, 0e0 AS v_bg,
 ({width}e0*greatest(abs(m_b), 1e-3)/activity_rms)*({width}e0*greatest(abs(m_b), 1e-3)/activity_rms) AS v_gg,
 greatest(w_s_rss1/w_s_df1, 1e-6) AS noise_b, greatest(w_s_rss2/w_s_df2, 1e-6) AS noise_c,
 CASE WHEN n_participants >= 5 THEN 'stratified_regression_gamma0' ELSE 'stratified_regression_gamma0_pooled_fallback' END AS source, w_pos/w_n AS train_prevalence FROM ps1)"""


_CUM = {"cc": "carbs_g*carbs_g", "cg": "carbs_g*carbs_g*activity_level", "gg": "carbs_g*activity_level*carbs_g*activity_level",
        "cy": "carbs_g*peak_glucose_rise", "gy": "carbs_g*activity_level*peak_glucose_rise", "rate_sum": "peak_glucose_rise/greatest(carbs_g, 1e0)"}

LEARNED = f"""learned AS (SELECT e.*, f.fold, count(*) OVER w AS n_learned, {', '.join(f'coalesce(sum({v}) OVER w, 0) AS {k}' for k, v in _CUM.items())}
 FROM cohort e JOIN folds f USING (participant_id) WINDOW w AS (PARTITION BY e.participant_id ORDER BY e.us RANGE BETWEEN UNBOUNDED PRECEDING AND {W} PRECEDING))"""

TRAJ_ROWS = f"""trows AS (SELECT e.participant_id, f.fold, e.grp, us, event_id, row_number() OVER w AS version, {', '.join(f'sum({v}) OVER w AS {k}' for k, v in _CUM.items())}
 FROM cohort e JOIN folds f USING (participant_id) WINDOW w AS (PARTITION BY e.participant_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)
 UNION ALL SELECT participant_id, fold, grp, NULL, NULL, 0, 0, 0, 0, 0, 0, 0 FROM folds)"""


def posterior(src: str, prior: str, model: str, out: str, on: str = "fold", noise: str = "noise") -> str:
    """CTEs ending in `out`: rows of src with post_b, post_g, s_bb, s_bg, s_gg and the prior columns."""
    join = " AND ".join(f"x.{k} = q.{k}" for k in on.split(","))
    head = f"""{out}_j AS (SELECT x.*, q.m_b, q.v_bb, q.m_g, q.v_bg, q.v_gg, q.{noise} AS nz, q.train_prevalence FROM {src} x JOIN {prior} q ON {join})"""
    if model == "B":
        return head + f""",
{out} AS (SELECT *, (1/(1/v_bb + cc/nz))*(m_b/v_bb + cy/nz) AS post_b, 1/(1/v_bb + cc/nz) AS s_bb, 0e0 AS post_g, 0e0 AS s_bg, 0e0 AS s_gg FROM {out}_j)"""
    return head + f""",
{out}_1 AS (SELECT *, v_gg/(v_bb*v_gg - v_bg*v_bg) AS pbb, -v_bg/(v_bb*v_gg - v_bg*v_bg) AS pbg, v_bb/(v_bb*v_gg - v_bg*v_bg) AS pgg FROM {out}_j),
{out}_2 AS (SELECT *, pbb + cc/nz AS qbb, pbg + cg/nz AS qbg, pgg + gg/nz AS qgg, pbb*m_b + pbg*m_g + cy/nz AS hb, pbg*m_b + pgg*m_g + gy/nz AS hg FROM {out}_1),
{out}_3 AS (SELECT *, qgg/(qbb*qgg - qbg*qbg) AS s_bb, -qbg/(qbb*qgg - qbg*qbg) AS s_bg, qbb/(qbb*qgg - qbg*qbg) AS s_gg FROM {out}_2),
{out} AS (SELECT *, s_bb*hb + s_bg*hg AS post_b, s_bg*hb + s_gg*hg AS post_g FROM {out}_3)"""


def forecast(src: str, model: str, out: str) -> str:
    z = "(carbs_g*activity_level)" if model == "C" else "0e0"
    sd = lambda a, b, c: f"sqrt(nz + carbs_g*carbs_g*{a} + 2*carbs_g*{z}*{b} + {z}*{z}*{c})"
    return f"""{out}_m AS (SELECT *, carbs_g*post_b + {z}*post_g AS mean_rise, {sd('s_bb', 's_bg', 's_gg')} AS pred_std, carbs_g*m_b + {z}*m_g AS mean_rise_frozen_prior,
 {sd('v_bb', 'v_bg', 'v_gg')} AS fsd FROM {src}),
{out} AS (SELECT participant_id, event_id, us, fold, grp, label_exceeds_180 AS y, peak_glucose_rise AS rise, activity_level AS activity, carbs_g, baseline_glucose,
 {phi('((baseline_glucose + mean_rise - 180)/pred_std)')} AS p, mean_rise, pred_std, mean_rise - {Z90}*pred_std AS interval90_low, mean_rise + {Z90}*pred_std AS interval90_high,
 {phi('((baseline_glucose + mean_rise_frozen_prior - 180)/fsd)')} AS p_frozen_prior, mean_rise_frozen_prior, n_learned AS n_personal_before, post_b AS beta_mean_before,
 sqrt(s_bb) AS beta_sd_before, post_g AS gamma_mean_before, sqrt(s_gg) AS gamma_sd_before, s_bg, train_prevalence FROM {out}_m)"""


BASE = [COHORT, FOLDS, FITS, TRAIN, POOL]
SEQ_B = [*BASE, PRIOR_B, LEARNED, posterior("learned", "prior_b", "B", "qb"), forecast("qb", "B", "fb")]
SEQ_C = [*BASE, PRIOR_C, LEARNED, posterior("learned", "prior_c", "C", "qc"), forecast("qc", "C", "fc")]
SEQ_BC = [*BASE, PRIOR_B, PRIOR_C, LEARNED, posterior("learned", "prior_b", "B", "qb"), forecast("qb", "B", "fb"),
          posterior("learned", "prior_c", "C", "qc"), forecast("qc", "C", "fc")]
ARMS = [*SEQ_BC, STRATA, stratified(), posterior("learned", "prior_s", "B", "qbs", "fold,grp", "noise_b"), forecast("qbs", "B", "fbs"),
        posterior("learned", "prior_s", "C", "qcs", "fold,grp", "noise_c"), forecast("qcs", "C", "fcs")]

__all__ = ["BASE", "SEQ_B", "SEQ_C", "SEQ_BC", "ARMS", "with_", "r"]
