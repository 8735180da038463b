"""Registered queries: leave-one-participant-out prequential run."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.functions.numeric import rounded_value
from anchorline.operators import boosted as bt
from anchorline.operators import compare as cp
from anchorline.operators import leave_one_out as lo
from anchorline.plans.eval_queries import N_BOOT, boot_ctes
from anchorline.plans.model_queries import fold_inputs, rounded, rsql
from anchorline.plans.registry import query
from anchorline.plans.sqltext import COHORT, phi, r, with_
from anchorline.session import stage
from anchorline.sources.adapters import cohort

W = 7200000000
_S = {"n": "1", "c": "carbs_g", "cc": "carbs_g*carbs_g", "y": "peak_glucose_rise", "cy": "carbs_g*peak_glucose_rise", "yy": "peak_glucose_rise*peak_glucose_rise"}
_PARTS = {"k": "u", "rs": "coalesce(rss, 0)", "df": "u*(n - 2)", "s0": "coalesce(b0, 0)", "s1": "coalesce(b1, 0)", "q00": "coalesce(b0*b0, 0)", "q01": "coalesce(b0*b1, 0)", "q11": "coalesce(b1*b1, 0)",
          "j00": "coalesce(cc/det, 0)", "j01": "coalesce(-c/det, 0)", "j11": "coalesce(n/det, 0)", **{c: c for c in _S}}
_LOO = f"""s0 AS (SELECT participant_id, {', '.join(f'CAST(sum({e}) AS DOUBLE) AS {k}' for k, e in _S.items())} FROM cohort GROUP BY 1),
s1 AS (SELECT *, CASE WHEN n > 2 AND n*cc - c*c > 1e-10*n*cc THEN n*cc - c*c END AS det FROM s0),
s2 AS (SELECT *, (cc*y - c*cy)/det AS b0, (n*cy - c*y)/det AS b1, CASE WHEN det IS NULL THEN 0e0 ELSE 1e0 END AS u FROM s1),
s3 AS (SELECT *, CASE WHEN b0 IS NOT NULL THEN greatest(yy - b0*y - b1*cy, 0) END AS rss FROM s2),
ow AS (SELECT participant_id, {', '.join(f'{e} AS {k}' for k, e in _PARTS.items())} FROM s3),
lf AS (SELECT participant_id, {', '.join(f'(SELECT sum({k}) FROM ow) - {k} AS {k}' for k in _PARTS)} FROM ow),
l1 AS (SELECT *, (cc*y - c*cy)/(n*cc - c*c) AS m0, (n*cy - c*y)/(n*cc - c*c) AS m1, greatest(rs/df, 1e-6) AS noise, (q00 - s0*s0/k)/(k-1) AS c00, (q01 - s0*s1/k)/(k-1) AS c01, (q11 - s1*s1/k)/(k-1) AS c11 FROM lf),
l2 AS (SELECT *, c00 - noise*j00/k AS ea, c01 - noise*j01/k AS eb, c11 - noise*j11/k AS ed, greatest(1e-3*(c00 + c11)/2, 1e-9) AS fl FROM l1),
l3 AS (SELECT *, sqrt(((ea-ed)/2)*((ea-ed)/2) + eb*eb) AS h FROM l2),
l4 AS (SELECT *, greatest((ea+ed)/2 - h, fl) AS flo, greatest((ea+ed)/2 + h, fl) AS fhi, (ea - (ea+ed)/2 + h)/(2*h) AS paa, eb/(2*h) AS pbb, (ed - (ea+ed)/2 + h)/(2*h) AS pdd FROM l3),
lp AS (SELECT *, fhi*paa + flo*(1-paa) AS v00, (fhi-flo)*pbb AS v01, fhi*pdd + flo*(1-pdd) AS v11, y/n AS others_mean, sqrt((yy - y*y/n)/(n-1)) AS others_sd FROM l4),
ln AS (SELECT participant_id, event_id, carbs_g, baseline_glucose, label_exceeds_180, count(*) OVER w AS l_n, {', '.join(f'coalesce(sum({e}) OVER w, 0) AS l_{k}' for k, e in _S.items() if k not in ('n', 'yy'))},
 coalesce(sum(peak_glucose_rise/greatest(carbs_g, 1e0)) OVER w, 0) AS l_rate FROM cohort WINDOW w AS (PARTITION BY participant_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {W} PRECEDING)),
lj AS (SELECT ln.*, m0, m1, noise, others_mean, others_sd, v00, v01, v11, v00*v11 - v01*v01 AS d0 FROM ln JOIN lp USING (participant_id)),
lk AS (SELECT *, v11/d0 + l_n/noise AS a00, -v01/d0 + l_c/noise AS a01, v00/d0 + l_cc/noise AS a11, (v11*m0 - v01*m1)/d0 + l_y/noise AS h0, (v00*m1 - v01*m0)/d0 + l_cy/noise AS h1 FROM lj),
ll AS (SELECT *, a00*a11 - a01*a01 AS d1 FROM lk),
lm AS (SELECT *, a11/d1 AS t00, -a01/d1 AS t01, a00/d1 AS t11 FROM ll),
rw AS (SELECT participant_id, event_id, baseline_glucose, l_n, 'frozen_B' AS model, m0 + m1*carbs_g AS mean_rise, sqrt(noise + v00 + 2*carbs_g*v01 + carbs_g*carbs_g*v11) AS pred_std FROM lm
 UNION ALL SELECT participant_id, event_id, baseline_glucose, l_n, 'B', t00*h0 + t01*h1 + (t01*h0 + t11*h1)*carbs_g, sqrt(noise + t00 + 2*carbs_g*t01 + carbs_g*carbs_g*t11) FROM lm
 UNION ALL SELECT participant_id, event_id, baseline_glucose, l_n, 'personal_rate', carbs_g * CASE WHEN l_n > 0 THEN l_rate/l_n ELSE m1 END, sqrt(noise) FROM lm
 UNION ALL SELECT participant_id, event_id, baseline_glucose, l_n, 'population_constant', others_mean, others_sd FROM lm),
rz AS (SELECT *, {phi('((baseline_glucose + mean_rise - 180)/pred_std)')} AS p FROM rw WHERE participant_id IN (SELECT participant_id FROM cohort GROUP BY 1 HAVING count(*) >= 2))"""


@query("prequential_loo", with_(COHORT, _LOO) + f"SELECT event_id, model, l_n AS n_personal_before, {r('mean_rise')} AS mean_rise, {r('pred_std')} AS pred_std, {r('p')} AS p FROM rz")
def prequential_loo(spark, sf):
    e = stage(cohort(spark, sf), "events")
    return rounded(lo.prequential(e, lo.ONE_TERM), ["event_id", "model", "n_personal_before"], ["mean_rise", "pred_std", "p"])


@query("prequential_loo_activity")
def prequential_loo_activity(spark, sf):
    e = stage(cohort(spark, sf), "events")
    p = stage(lo.prequential(e, ("frozen_C", "C", "B_shuffled", "C_perm_activity")), "prequential")
    return p.groupBy("model", "is_active").agg(F.count(F.lit(1)).alias("n"), rounded_value(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("brier"), rounded_value(F.avg(F.abs(F.col("mean_rise") - F.col("rise")))).alias("mae_rise"))


@query("others_median", with_(COHORT) + f"""SELECT p.participant_id, {r('quantile_cont(c.activity_level, 0.5)')} AS others_median FROM (SELECT DISTINCT participant_id FROM cohort) p
 JOIN cohort c ON c.participant_id <> p.participant_id GROUP BY 1""")
def others_median(spark, sf):
    return rounded(lo.others_median(stage(cohort(spark, sf), "events")), ["participant_id"], ["others_median"])


#: (a, b, metric, subset), fixed in advance; a negative estimate favours a.
COMPARISONS = [
    ("B", "frozen_B", "brier", "all"), ("B", "B_shuffled", "brier", "all"), ("B", "personal_rate", "brier", "all"),
    ("C", "B", "brier", "all"), ("C", "B", "brier", "active"), ("C", "B", "brier", "sedentary"),
    ("C", "C_perm_activity", "brier", "all"),
    ("C", "frozen_C", "brier", "all"), ("C", "frozen_C", "brier", "active"), ("frozen_C", "frozen_B", "brier", "active"), ("B", "A", "brier", "all"), ("C", "A", "brier", "all"),
    ("C", "B", "log_loss", "active"), ("B", "frozen_B", "mae_rise", "all"), ("C", "B", "mae_rise", "active"),
]
_CMP = ["model_a", "model_b", "metric", "subset", "n_participants", "n_events", "excludes_zero", "reading"]
_NUM = ["estimate", "ci_low", "ci_high"]


@query("experiment_comparisons")
def experiment_comparisons(spark, sf):
    """All fixed comparisons of the leave-one-participant-out run. The boosted baseline forecasts each participant from the folds that it is not in."""
    e, f = fold_inputs(spark, sf)
    # the baseline's forecasts are a column of the events, so that no forecasts meet in an exchange by event
    with_a = stage(bt.out_of_fold(e, f, held=tuple(c for c in e.columns if c not in ("participant_id", "event_id", "us", "grp"))).select(*e.columns, F.col("p").alias("A_p")), "baseline-forecasts")
    run = ("frozen_B", "frozen_C", "B", "C", "B_shuffled", "C_perm_activity", "personal_rate")
    wide = lo.side_by_side(with_a, run, carry=("A_p",))
    return rounded(cp.wide_comparisons(wide, [*run, "A"], COMPARISONS, n_boot=N_BOOT), _CMP, _NUM)


_LOSS = {"brier": "(p - y) * (p - y)", "mae_rise": "abs(mean_rise - rise)"}
_ONE = [("B", "frozen_B", "brier"), ("B", "frozen_B", "mae_rise"), ("B", "personal_rate", "brier")]


@query("experiment_comparisons_one_term", with_(COHORT, _LOO, "rc AS (SELECT z.participant_id, z.event_id, model, p, mean_rise, label_exceeds_180 AS y, peak_glucose_rise AS rise FROM rz z JOIN cohort USING (event_id))",
       "cs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, '{m}' AS metric_name, participant_id, count(*) AS n, sum(x.l - z.l) AS d FROM (SELECT *, {_LOSS[m]} AS l FROM rc WHERE model = '{a}') x "
                                f"JOIN (SELECT event_id, {_LOSS[m]} AS l FROM rc WHERE model = '{b}') z USING (event_id) GROUP BY participant_id" for a, b, m in _ONE) + ")", boot_ctes("cs", ["model_a", "model_b", "metric_name"], ["d"]))
       + f"""SELECT model_a, model_b, metric_name AS metric, 'all' AS subset, n_participants, n_events, excludes_zero, CASE WHEN estimate < 0 THEN 'negative favours model_a' ELSE 'positive favours model_b' END AS reading,
 {', '.join(f'{r(c)} AS {c}' for c in _NUM)} FROM bt""")
def experiment_comparisons_one_term(spark, sf):
    """The fixed comparisons among forecasters of one term."""
    e = stage(cohort(spark, sf), "events")
    run = ("frozen_B", "B", "personal_rate")
    return rounded(cp.wide_comparisons(lo.side_by_side(e, run), list(run), COMPARISONS, n_boot=N_BOOT), _CMP, _NUM)
