"""Registered queries: metrics, bootstrap, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.functions.numeric import rounded_value
from anchorline.operators import bootstrap as bo
from anchorline.operators import compare as cp
from anchorline.operators import evaluation as ev
from anchorline.operators import sequential as sq
from anchorline.operators import priors as pr
from anchorline.operators.reports import distribution
from anchorline.plans import modelsql as M
from anchorline.plans.model_queries import fold_inputs, learned, oof, rounded, rsql
from anchorline.plans.registry import query
from anchorline.plans.sqltext import COHORT, r, with_
from anchorline.session import stage

N_BOOT = 2000


def both(spark, sf, inputs=None):
    seen, priors = seen_and_priors(spark, sf, inputs)
    return tuple(sq.forecasts(seen, priors[m], m, ["fold"]) for m in ("B", "C"))


def seen_and_priors(spark, sf, inputs=None):
    ev_, folds = inputs or fold_inputs(spark, sf)
    seen = stage(learned(ev_, folds), "learned")
    pools = (stage(pr.training_pool(ev_, folds), "pool"), None)
    return seen, {m: pr.fold_priors(ev_, folds, m, pools=pools) for m in ("B", "C")}


def side_by_side(spark, sf):
    """Both models' forecasts in one row per event: `pair` of `both`, without its join."""
    seen, priors = seen_and_priors(spark, sf)
    return sq.side_by_side(seen, {m.lower(): (priors[m], m, ["fold"]) for m in ("B", "C")}, _S)


def scored(spark, sf, model="C"):
    return stage(oof(spark, sf, model), "forecasts")


def paired(spark, sf):
    return stage(side_by_side(spark, sf), "paired")


def seen_and_arms(spark, sf):
    ev_, folds = fold_inputs(spark, sf)
    seen = stage(learned(ev_, folds), "learned")
    pools = (stage(pr.training_pool(ev_, folds), "pool"), stage(pr.training_pool(ev_, folds, by_group=True), "strata"))
    arms = {}
    for m in ("B", "C"):
        arms[f"{m.lower()}_eb"] = (pr.fold_priors(ev_, folds, m, pools=pools), m, ["fold"])
        arms[f"{m.lower()}_st"] = (pr.fold_priors(ev_, folds, m, "stratified", pools=pools), m, ["fold", "grp"])
    return seen, arms


def four(spark, sf):
    seen, arms = seen_and_arms(spark, sf)
    return {a: sq.forecasts(seen, *how) for a, how in arms.items()}


def four_arms(spark, sf):
    """The four arms in one row per event, stored: `compare.four_arms` of `four`, without its joins."""
    return stage(sq.side_by_side(*seen_and_arms(spark, sf), ["p", "mean_rise"]), "arms")


# ------------------------------------------------------------------ oracle text

_S = ["p", "mean_rise", "interval90_low", "interval90_high", "p_frozen_prior", "mean_rise_frozen_prior", "n_personal_before"]
PAIR = f"""pq AS (SELECT b.participant_id, b.event_id, b.fold, b.grp, b.y, b.rise, b.activity, {', '.join(f'b.{c} AS {c}_b, c.{c} AS {c}_c' for c in _S)}
 FROM fb b JOIN fc c ON b.event_id = c.event_id)"""
LONG = """lg AS (SELECT *, 'B' AS model, p_b AS p, mean_rise_b AS mean_rise FROM pq UNION ALL SELECT *, 'C', p_c, mean_rise_c FROM pq)"""


def ll(p, y="y"):
    q = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"-({y} * ln({q}) + (1 - {y}) * ln(1 - {q}))"


def auc_cte(src, keys, out="au", min_class=2):
    """roc_auc and average_precision per key list by average ranks and cumulative precision."""
    k = f"{keys}," if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""{out}_d AS (SELECT {k} p, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {k} p),
{out}_r AS (SELECT *, sum(neg) OVER ({part} ORDER BY p) AS cneg, sum(pos) OVER ({part} ORDER BY p DESC) AS tp, sum(neg) OVER ({part} ORDER BY p DESC) AS fp FROM {out}_d),
{out} AS (SELECT {k} CAST(sum(pos) AS BIGINT) AS n_positive, CAST(sum(neg) AS BIGINT) AS n_negative,
 CASE WHEN sum(pos) >= {min_class} AND sum(neg) >= {min_class} THEN sum(pos * (cneg - neg / 2e0)) / (sum(pos) * sum(neg)) END AS roc_auc,
 CASE WHEN sum(pos) >= {min_class} AND sum(neg) >= {min_class} THEN sum(pos * tp / (tp + fp)) / sum(pos) END AS average_precision FROM {out}_r {grp})"""


def bin_sql(p, n):
    return " + ".join(f"CAST({p} > {i * (1.0 / n)!r}e0 AS INT)" for i in range(1, n))


def ece_cte(src, keys, n, out):
    k = f"{keys}," if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""{out}_b AS (SELECT {k} {bin_sql('p', n)} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS mo FROM {src} GROUP BY {k} bin),
{out} AS (SELECT {k} sum(n * abs(mp - mo)) / sum(n) AS ece{n} FROM {out}_b {grp})"""


def loss_sql(p="p"):
    return (f"count(*) AS n_events, avg(y) AS prevalence, avg({p}) AS mean_probability, avg(({p} - y) * ({p} - y)) AS brier, avg({ll(p)}) AS log_loss, "
            "avg(y) * (1 - avg(y)) AS brier_of_constant_prevalence")


_BUND = ["prevalence", "mean_probability", "brier", "log_loss", "brier_of_constant_prevalence", "roc_auc", "average_precision", "ece10", "ece5"]


def bundle_ctes(src, keys, min_class=2, n="bd"):
    using = f"USING ({keys})" if keys else ""
    join = "JOIN" if keys else "CROSS JOIN"
    k = f"{keys}," if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""{auc_cte(src, keys, n + 'a', min_class)},
{ece_cte(src, keys, 10, n + 'e')},
{ece_cte(src, keys, 5, n + 'f')},
{n}l AS (SELECT {k} {loss_sql()} FROM {src} {grp}),
{n} AS (SELECT * FROM {n}l {join} {n}a {using} {join} {n}e {using} {join} {n}f {using})"""


# ------------------------------------------------------------------ point metrics

@query("auc", with_(*M.SEQ_C, auc_cte("fc", "")) + f"SELECT n_positive, n_negative, {r('roc_auc')} AS roc_auc FROM au")
def auc(spark, sf):
    return ev.discrimination(scored(spark, sf), []).select("n_positive", "n_negative", rounded_value("roc_auc").alias("roc_auc"))


@query("average_precision", with_(*M.SEQ_C, auc_cte("fc", "")) + f"SELECT {r('average_precision')} AS average_precision FROM au")
def average_precision(spark, sf):
    return ev.discrimination(scored(spark, sf), []).select(rounded_value("average_precision").alias("average_precision"))


_LOSS = ["prevalence", "mean_probability", "brier", "log_loss", "brier_of_constant_prevalence"]


@query("brier_logloss", with_(*M.SEQ_C) + f"SELECT n_events, {', '.join(f'{r(c)} AS {c}' for c in _LOSS)} FROM (SELECT {loss_sql()} FROM fc)")
def brier_logloss(spark, sf):
    return rounded(ev.losses(scored(spark, sf), []), ["n_events"], _LOSS)


@query("reliability_bins", with_(*M.SEQ_C) + f"""SELECT CAST(g.bin AS INT) AS bin, coalesce(n, 0) AS n, {r('mp')} AS mean_predicted, {r('mo')} AS mean_observed, {r('g.bin * 0.1e0')} AS lower
 FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN (SELECT {bin_sql('p', 10)} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS mo FROM fc GROUP BY 1) b ON b.bin = g.bin""")
def reliability_bins(spark, sf):
    return rounded(ev.reliability(scored(spark, sf)), ["bin", "n"], ["mean_predicted", "mean_observed", "lower"])


@query("ece_bins", with_(*M.SEQ_C, ece_cte("fc", "fold", 10, "e10"), ece_cte("fc", "fold", 5, "e5")) + f"SELECT fold, {r('ece10')} AS ece10, {r('ece5')} AS ece5 FROM e10 JOIN e5 USING (fold)")
def ece_bins(spark, sf):
    f = scored(spark, sf)
    return rounded(ev.ece(f, ["fold"], 10).join(ev.ece(f, ["fold"], 5), "fold"), ["fold"], ["ece10", "ece5"])


_CONF = """SELECT '{tag}' AS kind, fold, count(*) FILTER (y = 1 AND p >= {t}) AS tp, count(*) FILTER (y = 1 AND p < {t}) AS fn, count(*) FILTER (y = 0 AND p >= {t}) AS fp,
 count(*) FILTER (y = 0 AND p < {t}) AS tn, {thr} AS threshold, {sens} AS sensitivity, {prec} AS precision FROM fc GROUP BY fold"""


def _conf(tag, t):
    return _CONF.format(tag=tag, t=t, thr=r(f"avg({t})"), sens=r(f"sum(CAST(y = 1 AND p >= {t} AS INT)) / nullif(sum(y), 0)"),
                        prec=r(f"sum(CAST(y = 1 AND p >= {t} AS INT)) / nullif(sum(CAST(p >= {t} AS INT)), 0)"))


@query("confusion", with_(*M.SEQ_C) + _conf("fixed", "0.5e0") + " UNION ALL " + _conf("train_prevalence", "train_prevalence"))
def confusion(spark, sf):
    f = scored(spark, sf)
    cols = ["kind", "fold", "tp", "fn", "fp", "tn"]
    a = ev.confusion(f, ["fold"], 0.5).withColumn("kind", F.lit("fixed"))
    b = ev.confusion(f, ["fold"], "train_prevalence").withColumn("kind", F.lit("train_prevalence"))
    return rounded(a.unionByName(b), cols, ["threshold", "sensitivity", "precision"])


_RISE = ["mae_rise", "mean_error_rise", "coverage90", "mae_rise_frozen_prior"]


@query("rise_metrics", with_(*M.SEQ_C) + f"""SELECT fold, {r('avg(abs(mean_rise - rise))')} AS mae_rise, {r('avg(mean_rise - rise)')} AS mean_error_rise,
 {r('avg(CAST(rise >= interval90_low AND rise <= interval90_high AS INT))')} AS coverage90, {r('avg(abs(mean_rise_frozen_prior - rise))')} AS mae_rise_frozen_prior FROM fc GROUP BY fold""")
def rise_metrics(spark, sf):
    return rounded(ev.rise_metrics(oof(spark, sf, "C"), ["fold"]), ["fold"], _RISE)


@query("per_fold", with_(*M.SEQ_C, bundle_ctes("fc", "fold")) + f"SELECT {rsql(['fold', 'n_events', 'n_positive', 'n_negative'], _BUND)} FROM bd")
def per_fold(spark, sf):
    return rounded(ev.bundle(scored(spark, sf), ["fold"]), ["fold", "n_events", "n_positive", "n_negative"], _BUND)


_BOTH = """bc AS (SELECT grp, count(*) AS n_participants, count(*) FILTER (lo = 0 AND hi = 1) AS participants_with_both_classes
 FROM (SELECT grp, participant_id, min(y) AS lo, max(y) AS hi FROM fc GROUP BY 1, 2) GROUP BY grp)"""


@query("per_group", with_(*M.SEQ_C, bundle_ctes("fc", "grp"), _BOTH) + f"SELECT {rsql(['grp', 'n_events', 'n_positive', 'n_participants', 'participants_with_both_classes'], _BUND)} FROM bd JOIN bc USING (grp)")
def per_group(spark, sf):
    f = scored(spark, sf)
    return rounded(ev.bundle(f, ["grp"]).join(ev.both_classes(f, ["grp"]), "grp"), ["grp", "n_events", "n_positive", "n_participants", "participants_with_both_classes"], _BUND)


@query("activity_threshold_strata", with_(*M.SEQ_C, "st AS (SELECT *, activity >= 2 AS is_active FROM fc)", bundle_ctes("st", "is_active")) + f"SELECT {rsql(['is_active', 'n_events'], _BUND)} FROM bd")
def activity_threshold_strata(spark, sf):
    f = scored(spark, sf).withColumn("is_active", F.col("activity") >= 2.0)
    return rounded(ev.bundle(f, ["is_active"]), ["is_active", "n_events"], _BUND)


@query("calibration_line", with_(*M.SEQ_C, """cz AS MATERIALIZED (SELECT ln(q / (1 - q)) AS z, y FROM (SELECT least(greatest(p, 1e-6), 1 - 1e-6) AS q, y FROM fc)),
it(k, a, b) AS (SELECT 0, 0e0, 0e0 UNION ALL
 SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
 FROM (SELECT k, a, b, sum(y - f) AS g0, sum((y - f) * z) AS g1, sum(f * (1 - f)) AS h00, sum(f * (1 - f) * z) AS h01, sum(f * (1 - f) * z * z) AS h11
       FROM (SELECT k, a, b, z, y, 1 / (1 + exp(-(a + b * z))) AS f FROM it, cz WHERE k < 15) GROUP BY k, a, b))""").replace("WITH ", "WITH RECURSIVE ", 1)
       + f"SELECT CAST(NULL AS VARCHAR) AS reason, {r('b')} AS slope, {r('a')} AS intercept FROM it WHERE k = 15")
def calibration_line(spark, sf):
    return rounded(ev.calibration_line(scored(spark, sf)), ["reason"], ["slope", "intercept"])


# ------------------------------------------------------------------ personalisation summaries

_FIN = """fin AS (SELECT participant_id, fold, max(version) AS n_obs, max_by(beta_mean, version) AS beta, max_by(gamma_mean, version) AS gamma, max_by(beta_sd, version) AS bsd,
 max_by(gamma_sd, version) AS gsd, min_by(beta_mean, version) AS beta0, min_by(gamma_mean, version) AS gamma0, min_by(beta_sd, version) AS bsd0, min_by(gamma_sd, version) AS gsd0 FROM tj GROUP BY 1, 2)"""
_Q = ["mean", "sd", "min", "p5", "p25", "median", "p75", "p95", "max"]


def _summ(v, name):
    qs = ", ".join(f"{r(f'quantile_cont({v}, {q})')} AS {n}" for n, q in (("p5", .05), ("p25", .25), ("median", .5), ("p75", .75), ("p95", .95)))
    return f"SELECT '{name}' AS measure, count({v}) AS n, {r(f'avg({v})')} AS mean, {r(f'stddev_samp({v})')} AS sd, {r(f'min({v})')} AS min, {qs}, {r(f'max({v})')} AS max FROM fin"


_MEAS = {"n_observations": "n_obs", "final_minus_prior_beta": "beta - beta0", "final_minus_prior_gamma": "gamma - gamma0", "sd_ratio_beta": "bsd / bsd0", "sd_ratio_gamma": "gsd / gsd0"}


def finals(spark, sf, model):
    from anchorline.plans.model_queries import traj
    t = traj(spark, sf, model)
    last = lambda c: F.max_by(c, "version")
    first = lambda c: F.min_by(c, "version")
    return t.groupBy("participant_id", "fold").agg(
        F.max("version").alias("n_obs"), last("beta_mean").alias("beta"), last("gamma_mean").alias("gamma"), last("beta_sd").alias("bsd"), last("gamma_sd").alias("gsd"),
        first("beta_mean").alias("beta0"), first("gamma_mean").alias("gamma0"), first("beta_sd").alias("bsd0"), first("gamma_sd").alias("gsd0"))


def _traj_ctes(model):
    from anchorline.plans.model_queries import traj_sql
    return traj_sql(model)


@query("personalisation_summary", with_(*_traj_ctes("C"), _FIN) + " UNION ALL ".join(_summ(f"({v})", n) for n, v in _MEAS.items()))
def personalisation_summary(spark, sf):
    f = finals(spark, sf, "C")
    x = f.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.expr(f"CAST({v} AS DOUBLE)").alias("value")) for n, v in _MEAS.items()])).alias("x")).select("x.*")
    return rounded(distribution(stage(x, "measures"), "value", ["measure"]), ["measure", "n"], _Q)


@query("personalisation_levels", with_(*_traj_ctes("C"), _FIN, "rk AS (SELECT participant_id, n > 2 AND cc*gg - cg*cg > 1e-10*cc*gg AS ok FROM suff)") + f"""SELECT count(*) AS n_participants,
 {', '.join(f'count(*) FILTER (n_obs >= {m}) AS at_least_{m}' for m in (1, 3, 5, 10, 20))}, {r('stddev_samp(beta)')} AS between_sd_beta, {r('stddev_samp(gamma)')} AS between_sd_gamma,
 count(*) FILTER (ok) AS n_identifiable FROM fin JOIN rk USING (participant_id)""")
def personalisation_levels(spark, sf):
    from anchorline.sources.adapters import cohort
    ident = pr.ols(pr.sufficient(cohort(spark, sf), ["participant_id"])).select("participant_id", F.col("b2").isNotNull().alias("ok"))
    f = finals(spark, sf, "C").join(ident, "participant_id")
    return f.agg(F.count(F.lit(1)).alias("n_participants"), *[F.count_if(F.col("n_obs") >= m).alias(f"at_least_{m}") for m in (1, 3, 5, 10, 20)],
                 rounded_value(F.stddev_samp("beta")).alias("between_sd_beta"), rounded_value(F.stddev_samp("gamma")).alias("between_sd_gamma"), F.count_if("ok").alias("n_identifiable"))


@query("prior_only_forecasts", with_(*M.SEQ_B) + "SELECT count(*) AS n_forecasts, count(*) FILTER (n_personal_before = 0) AS from_prior_only FROM fb")
def prior_only_forecasts(spark, sf):
    return oof(spark, sf, "B").agg(F.count(F.lit(1)).alias("n_forecasts"), F.count_if(F.col("n_personal_before") == 0).alias("from_prior_only"))


# ------------------------------------------------------------------ bootstrap and paired comparisons

#: The draw rule as text of its own: how a 60-bit hash and a replicate give a number below 2**31 - 1, and from where on it counts 1, 2, 3 ... (Poisson with mean 1).
_POISSON_FROM = (790015083, 1580030167, 1975037709, 2106706890, 2139624185, 2146207644, 2147304887, 2147461637, 2147481230, 2147483407, 2147483625, 2147483645)


def draw_ctes(src, n_boot, seed, n):
    """CTE {n}_w: the rows of src (with participant_id) once per replicate r, with their count w."""
    return f"""{n}_k AS (SELECT *, CAST('0x' || substring(md5(participant_id), 1, 15) AS BIGINT) AS h FROM {src}),
{n}_a AS (SELECT *, h % 2147483647 AS h1, h // 2147483647 AS h2 FROM {n}_k, (SELECT unnest(range({n_boot})) AS r)),
{n}_b AS (SELECT *, ((h1 + r * 1000003 + {seed} * 40692 + 12345) % 2147483647 * 48271 + h2) % 2147483647 AS x1 FROM {n}_a),
{n}_c AS (SELECT *, ((x1 * x1 % 2147483647 + r * 271) % 2147483647 * 69621 + h1) % 2147483647 AS x3 FROM {n}_b),
{n}_d AS (SELECT *, (x3 * x3 % 2147483647 + h2 * 131) % 2147483647 * 16807 % 2147483647 AS u FROM {n}_c),
{n}_w AS (SELECT * EXCLUDE (h, h1, h2, x1, x3, u), {' + '.join(f'CAST(u >= {x} AS INT)' for x in _POISSON_FROM)} AS w FROM {n}_d)"""


def rank_ctes(src, arms, n_boot, n="rk"):
    """CTEs ending in {n}: intervals of the rank metrics of every arm and of later-minus-earlier pairs, from src (arm, participant_id, p, y)."""
    names = {"roc_auc": "u / (np * nn)", "average_precision": "s / np", "brier": "q / (np + nn)", "ece10": "e10 / (np + nn)", "ece5": "e5 / (np + nn)"}
    long = " UNION ALL ".join(f"SELECT arm, r, '{m}' AS metric, {x} AS v FROM {n}_m WHERE np > 0 AND nn > 0" for m, x in names.items())
    pairs = " UNION ALL ".join([f"SELECT '{a}' AS contrast, r, metric, v FROM {n}_l WHERE arm = '{a}'" for a in arms]
                               + [f"SELECT '{a}_minus_{b}', r, metric, x.v - y.v FROM {n}_l x JOIN {n}_l y USING (r, metric) WHERE x.arm = '{a}' AND y.arm = '{b}'" for i, a in enumerate(arms) for b in arms[:i]])
    bin_ = lambda k: " + ".join(f"CAST(p > {i * (1.0 / k)!r}e0 AS INT)" for i in range(1, k))
    return f"""{n}_0 AS (SELECT arm, participant_id, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM {src} GROUP BY ALL),
{draw_ctes(f'{n}_0', n_boot, 0, n)},
{n}_p AS (SELECT arm, r, p, CAST(sum(pos * w) AS DOUBLE) AS pos, CAST(sum(neg * w) AS DOUBLE) AS neg FROM {n}_w WHERE w > 0 GROUP BY arm, r, p),
{n}_o AS (SELECT *, sum(pos) OVER t AS up, sum(neg) OVER t AS un, sum(neg) OVER (PARTITION BY arm, r) AS tn FROM {n}_p WINDOW t AS (PARTITION BY arm, r ORDER BY p DESC)),
{n}_s AS (SELECT arm, r, sum(pos) AS np, sum(neg) AS nn, sum(pos * (tn - un + neg / 2)) AS u, sum(CASE WHEN pos > 0 THEN pos * up / (up + un) END) AS s, sum(pos * (1 - p) * (1 - p) + neg * p * p) AS q FROM {n}_o GROUP BY arm, r),
{n}_10 AS (SELECT arm, r, sum(d) AS e10 FROM (SELECT arm, r, abs(sum(p * (pos + neg)) - sum(pos)) AS d FROM {n}_p GROUP BY arm, r, {bin_(10)}) GROUP BY arm, r),
{n}_5 AS (SELECT arm, r, sum(d) AS e5 FROM (SELECT arm, r, abs(sum(p * (pos + neg)) - sum(pos)) AS d FROM {n}_p GROUP BY arm, r, {bin_(5)}) GROUP BY arm, r),
{n}_m AS (SELECT * FROM {n}_s JOIN {n}_10 USING (arm, r) JOIN {n}_5 USING (arm, r)),
{n}_l AS ({long}),
{n} AS (SELECT *, ci_low > 0 OR ci_high < 0 AS excludes_zero FROM (SELECT contrast, metric, count(*) AS n_draws_used, {n_boot} - count(*) AS n_draws_skipped, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high
 FROM ({pairs}) GROUP BY contrast, metric))"""


def boot_ctes(stats, keys, metrics, n_boot=N_BOOT, seed=0, n="bt"):
    """CTEs ending in {n}: long bootstrap table from a per-participant stats CTE."""
    k = "".join(f"{x}, " for x in keys)
    longs = " UNION ALL ".join(
        f"SELECT {''.join(f'p.{x}, ' for x in keys)} n_participants, n_events, '{m}' AS metric, p.{m} AS estimate, q.{m}_lo AS ci_low, q.{m}_hi AS ci_high FROM {n}_p p "
        + (f"JOIN {n}_q q ON {' AND '.join(f'p.{x} = q.{x}' for x in keys)}" if keys else f"CROSS JOIN {n}_q q") for m in metrics)
    gb = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""{draw_ctes(stats, n_boot, seed, n)},
{n}_r AS (SELECT {k} r, {', '.join(f'sum({m} * w) / sum(n * w) AS {m}' for m in metrics)} FROM {n}_w WHERE w > 0 GROUP BY {k} r),
{n}_q AS (SELECT {k} {', '.join(f'quantile_cont({m}, 0.025) AS {m}_lo, quantile_cont({m}, 0.975) AS {m}_hi' for m in metrics)} FROM {n}_r {gb}),
{n}_p AS (SELECT {k} count(*) AS n_participants, CAST(sum(n) AS BIGINT) AS n_events, {', '.join(f'sum({m}) / sum(n) AS {m}' for m in metrics)} FROM {stats} {gb}),
{n} AS (SELECT *, ci_low > 0 OR ci_high < 0 AS excludes_zero FROM ({longs}))"""


def diff_sql(src, keys, out="ds", a="_c", b="_b"):
    k = "".join(f"{x}, " for x in keys)

    def parts(s):
        return {"brier": f"(p{s} - y) * (p{s} - y)", "log_loss": f"({ll(f'p{s}')})", "mae_rise": f"abs(mean_rise{s} - rise)", "mean_error": f"(mean_rise{s} - rise)",
                "coverage90": f"CAST(rise >= interval90_low{s} AND rise <= interval90_high{s} AS INT)"}
    A, B = parts(a), parts(b)
    return f"""{out} AS (SELECT {k} participant_id, count(*) AS n, {', '.join(f'sum({A[m]} - {B[m]}) AS {m}' for m in A)} FROM {src} GROUP BY {k} participant_id)"""


_M5 = ["brier", "log_loss", "mae_rise", "mean_error", "coverage90"]
_M3 = _M5[:3]
_BT = ["estimate", "ci_low", "ci_high"]
_PQ = [*M.SEQ_BC, PAIR]


@query("paired_bootstrap", with_(*_PQ, diff_sql("pq", []), boot_ctes("ds", [], _M5)) + f"SELECT {rsql(['metric', 'n_participants', 'n_events', 'excludes_zero'], _BT)} FROM bt")
def paired_bootstrap(spark, sf):
    return rounded(cp.paired_differences(paired(spark, sf), n_boot=N_BOOT), ["metric", "n_participants", "n_events", "excludes_zero"], _BT)


_FZ = "fz AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, participant_id, count(*) AS n, sum((p_{s} - y) * (p_{s} - y) - (p_frozen_prior_{s} - y) * (p_frozen_prior_{s} - y)) AS brier, "
    f"sum(({ll(f'p_{s}')}) - ({ll(f'p_frozen_prior_{s}')})) AS log_loss, sum(abs(mean_rise_{s} - rise) - abs(mean_rise_frozen_prior_{s} - rise)) AS mae_rise FROM pq GROUP BY participant_id"
    for m, s in (("B", "b"), ("C", "c"))) + ")"


@query("frozen_bootstrap", with_(*_PQ, _FZ, boot_ctes("fz", ["model"], _M3)) + f"SELECT {rsql(['model', 'metric', 'n_events', 'excludes_zero'], _BT)} FROM bt")
def frozen_bootstrap(spark, sf):
    return rounded(cp.frozen_differences(paired(spark, sf), n_boot=N_BOOT), ["model", "metric", "n_events", "excludes_zero"], _BT)


def strata_sql(key_sql, name="stratum"):
    return f"sx AS (SELECT *, {key_sql} AS {name} FROM pq), sl AS (SELECT *, 'B' AS model, p_b AS p, mean_rise_b AS mean_rise FROM sx UNION ALL SELECT *, 'C', p_c, mean_rise_c FROM sx)"


_PTS = ["brier", "log_loss", "roc_auc", "average_precision", "ece10", "mae_rise"]


def points_sql(prefix, key="stratum", where=""):
    return with_(*_PQ, prefix, bundle_ctes("sl", f"{key}, model", 1), f"""mx AS (SELECT {key}, model, avg(abs(mean_rise - rise)) AS mae_rise FROM sl GROUP BY 1, 2),
np AS (SELECT {key}, count(DISTINCT participant_id) AS n_participants FROM sx GROUP BY 1)""") + f"""SELECT {rsql([key, 'model', 'n_events', 'n_participants'], _PTS)}
 FROM bd JOIN mx USING ({key}, model) JOIN np USING ({key}) {where}"""


def points(df, key="stratum"):
    return rounded(cp.stratum_points(stage(df, "strata"), key), [key, "model", "n_events", "n_participants"], _PTS)


_EXPER = "CASE WHEN n_personal_before_b < 3 THEN 'cold_start' WHEN n_personal_before_b >= 10 THEN 'experienced' ELSE 'neither' END"
_STAGE = ("CASE WHEN n_personal_before_b = 0 THEN '0' WHEN n_personal_before_b <= 4 THEN '1-4' WHEN n_personal_before_b <= 9 THEN '5-9' "
          "WHEN n_personal_before_b <= 19 THEN '10-19' ELSE '20+' END")
_WITHIN = """wm AS (SELECT *, quantile_cont(activity, 0.5) OVER (PARTITION BY participant_id) AS med FROM pq),
wl AS (SELECT *, CASE WHEN activity > med THEN 'active' ELSE 'sedentary' END AS lab FROM wm),
wc AS (SELECT *, count(CASE WHEN lab = 'active' THEN 1 END) OVER w AS na, count(CASE WHEN lab = 'sedentary' THEN 1 END) OVER w AS ns FROM wl WINDOW w AS (PARTITION BY participant_id)),
sx AS (SELECT *, CASE WHEN na >= 2 AND ns >= 2 THEN lab ELSE 'excluded' END AS stratum FROM wc),
sl AS (SELECT *, 'B' AS model, p_b AS p, mean_rise_b AS mean_rise FROM sx UNION ALL SELECT *, 'C', p_c, mean_rise_c FROM sx)"""


@query("cold_vs_experienced", points_sql(strata_sql(_EXPER)))
def cold_vs_experienced(spark, sf):
    return points(side_by_side(spark, sf).withColumn("stratum", cp.experience()))


@query("obs_stages", points_sql(strata_sql(_STAGE)))
def obs_stages(spark, sf):
    return points(side_by_side(spark, sf).withColumn("stratum", cp.stage_of()))


@query("group_breakdown", points_sql(strata_sql("grp")))
def group_breakdown(spark, sf):
    return points(side_by_side(spark, sf).withColumn("stratum", F.col("grp")))


@query("strata_active", with_(*_PQ, _WITHIN) + "SELECT event_id, stratum FROM sx")
def strata_active(spark, sf):
    return cp.within_participant_strata(paired(spark, sf)).select("event_id", "stratum")


@query("strata_active_points", points_sql(_WITHIN))
def strata_active_points(spark, sf):
    return points(cp.within_participant_strata(paired(spark, sf)))


@query("strata_active_bootstrap", with_(*_PQ, _WITHIN, diff_sql("sx", ["stratum"]), boot_ctes("ds", ["stratum"], _M3)) + f"SELECT {rsql(['stratum', 'metric', 'n_participants', 'n_events', 'excludes_zero'], _BT)} FROM bt")
def strata_active_bootstrap(spark, sf):
    s = stage(cp.within_participant_strata(paired(spark, sf)), "strata")
    d = cp.paired_differences(s, ["stratum"], n_boot=N_BOOT).where(F.col("metric").isin(*_M3))
    return rounded(d, ["stratum", "metric", "n_participants", "n_events", "excludes_zero"], _BT)


_TERT = """cut AS (SELECT quantile_cont(activity, 1.0/3) AS c1, quantile_cont(activity, 2.0/3) AS c2 FROM pq),
sx AS (SELECT pq.*, CASE WHEN activity < c1 THEN 'low' WHEN activity < c2 THEN 'middle' ELSE 'high' END AS tertile FROM pq CROSS JOIN cut),
sl AS (SELECT *, 'B' AS model, p_b AS p, mean_rise_b AS mean_rise FROM sx UNION ALL SELECT *, 'C', p_c, mean_rise_c FROM sx)"""


@query("tertiles", points_sql(_TERT, "tertile"))
def tertiles(spark, sf):
    return points(cp.tertiles(paired(spark, sf)), "tertile")


@query("participant_mae_split", with_(*_PQ) + """SELECT count(*) AS n_participants, count(*) FILTER (d < -1) AS improved, count(*) FILTER (d > 1) AS worsened, count(*) FILTER (abs(d) <= 1) AS within_tolerance
 FROM (SELECT avg(abs(mean_rise_c - rise)) - avg(abs(mean_rise_b - rise)) AS d FROM pq GROUP BY participant_id)""")
def participant_mae_split(spark, sf):
    return cp.participant_mae_split(side_by_side(spark, sf))


_PPD = """en AS (SELECT * FROM pq WHERE participant_id IN (SELECT participant_id FROM pq GROUP BY 1 HAVING count(*) >= 8)),
el AS (SELECT participant_id, 'B' AS model, y, p_b AS p FROM en UNION ALL SELECT participant_id, 'C', y, p_c FROM en)"""


@query("per_participant_delta", with_(*_PQ, _PPD, auc_cte("el", "participant_id, model", "au", 1), """dd AS (
 SELECT 'brier' AS metric, avg((p_c - y) * (p_c - y)) - avg((p_b - y) * (p_b - y)) AS d FROM en GROUP BY participant_id
 UNION ALL SELECT 'roc_auc', max(CASE WHEN model = 'C' THEN roc_auc END) - max(CASE WHEN model = 'B' THEN roc_auc END) FROM au GROUP BY participant_id),
de AS (SELECT metric, CASE WHEN abs(d) < 1e-12 THEN 0 ELSE d END AS d FROM dd WHERE d IS NOT NULL)""") + f"""SELECT metric, count(*) AS n_participants,
 count(*) FILTER (CASE WHEN metric = 'brier' THEN d < 0 ELSE d > 0 END) AS n_better, count(*) FILTER (CASE WHEN metric = 'brier' THEN d > 0 ELSE d < 0 END) AS n_worse,
 count(*) FILTER (d = 0) AS n_equal, {r('quantile_cont(d, 0.25)')} AS q25, {r('quantile_cont(d, 0.5)')} AS median, {r('quantile_cont(d, 0.75)')} AS q75 FROM de GROUP BY metric""")
def per_participant_delta(spark, sf):
    d = cp.per_participant_distribution(paired(spark, sf))
    return rounded(d, ["metric", "n_participants", "n_better", "n_worse", "n_equal"], ["q25", "median", "q75"])


_ARMN = {"b_eb": "fb", "b_st": "fbs", "c_eb": "fc", "c_st": "fcs"}
_WIDE = ("wd AS (SELECT fb.participant_id, fb.event_id, fb.y, fb.rise, " + ", ".join(f"{t}.p AS p_{a}, {t}.mean_rise AS mean_rise_{a}" for a, t in _ARMN.items())
         + " FROM fb JOIN fbs USING (event_id) JOIN fc USING (event_id) JOIN fcs USING (event_id))")


def _loss1(a):
    return {"brier": f"(p_{a} - y) * (p_{a} - y)", "log_loss": f"({ll(f'p_{a}')})", "mae_rise": f"abs(mean_rise_{a} - rise)"}


_CS = ("cs AS (SELECT participant_id, count(*) AS n, " + ", ".join(
    f"sum({' + '.join(f'({w}) * {_loss1(a)[m]}' for a, w in ws.items())}) AS {c}__{m}" for c, ws in cp.CONTRASTS.items() for m in _M3) + " FROM wd GROUP BY participant_id)")


@query("prior_contrasts", with_(*M.ARMS, _WIDE, _CS, boot_ctes("cs", [], [f"{c}__{m}" for c in cp.CONTRASTS for m in _M3])) + f"""SELECT split_part(metric, '__', 1) AS contrast, split_part(metric, '__', 2) AS metric,
 n_participants, n_events, excludes_zero, {', '.join(f'{r(c)} AS {c}' for c in _BT)} FROM bt""")
def prior_contrasts(spark, sf):
    w = four_arms(spark, sf)
    return rounded(cp.contrast_differences(w, n_boot=N_BOOT), ["contrast", "metric", "n_participants", "n_events", "excludes_zero"], _BT)


@query("prior_arms_points", with_(*M.ARMS, "al AS (" + " UNION ALL ".join(f"SELECT '{a}' AS arm, y, rise, p, mean_rise FROM {t}" for a, t in _ARMN.items()) + ")", bundle_ctes("al", "arm", 1)) + f"""SELECT {rsql(['arm', 'n_events'], ['brier', 'log_loss', 'ece10', 'ece5'])} FROM bd""")
def prior_arms_points(spark, sf):
    stacked = None
    for a, d in four(spark, sf).items():
        d = d.select(F.lit(a).alias("arm"), "y", "p")
        stacked = d if stacked is None else stacked.unionByName(d)
    return rounded(ev.bundle(stage(stacked, "arms"), ["arm"], 1), ["arm", "n_events"], ["brier", "log_loss", "ece10", "ece5"])


def adoption(spark, sf, n_boot):
    w = four_arms(spark, sf)
    c = cp.contrast_differences(w, n_boot=n_boot)
    long = w.select("participant_id", "y", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"p_{a}").alias("p")) for a in _ARMN])).alias("x")).select("participant_id", "y", "x.*")
    b = bo.rank_metric_bootstrap(long, list(_ARMN), n_boot=n_boot)
    name = F.when(F.col("contrast") == "b_st_minus_b_eb", "b_stratified_minus_eb").when(F.col("contrast") == "c_st_minus_c_eb", "c_stratified_minus_eb")
    return cp.adoption_screen(c, b.withColumn("contrast", name))


@query("prior_adoption_screen")
def prior_adoption_screen(spark, sf):
    return adoption(spark, sf, N_BOOT)


#: Replicates of the runs whose SQL a single machine can repeat.
N_CHECKED = 200
_ARML = "al AS (" + " UNION ALL ".join(f"SELECT '{a}' AS arm, participant_id, y, p FROM {t}" for a, t in _ARMN.items()) + ")"


@query("prior_adoption_screen_200", with_(*M.ARMS, _WIDE, _CS, boot_ctes("cs", [], [f"{c}__{m}" for c in cp.CONTRASTS for m in _M3], N_CHECKED), _ARML, rank_ctes("al", list(_ARMN), N_CHECKED)) + """
SELECT contrast, brier_below_zero, log_loss_below_zero, ece10_not_above_zero, brier_below_zero AND log_loss_below_zero AND ece10_not_above_zero AS passes
FROM (SELECT split_part(metric, '__', 1) AS contrast, bool_or(metric LIKE '%__brier' AND ci_high < 0) AS brier_below_zero, bool_or(metric LIKE '%__log_loss' AND ci_high < 0) AS log_loss_below_zero
      FROM bt WHERE metric LIKE '__stratified_minus_eb%' GROUP BY 1)
JOIN (SELECT substring(contrast, 1, 1) || '_stratified_minus_eb' AS contrast, NOT ci_low > 0 AS ece10_not_above_zero FROM rk WHERE metric = 'ece10' AND contrast IN ('b_st_minus_b_eb', 'c_st_minus_c_eb')) USING (contrast)""")
def prior_adoption_screen_200(spark, sf):
    return adoption(spark, sf, N_CHECKED)


_RKC = ["contrast", "metric", "n_draws_used", "n_draws_skipped", "excludes_zero"]


def rank_intervals(spark, sf, n_boot):
    long = cp.long_scores(paired(spark, sf), []).select(F.col("model").alias("arm"), "participant_id", "p", "y")
    return rounded(bo.rank_metric_bootstrap(long, ["B", "C"], n_boot=n_boot), _RKC, ["ci_low", "ci_high"])


@query("rank_bootstrap")
def rank_bootstrap(spark, sf):
    """AUC, average precision, Brier and ECE intervals for both models and their difference, one common resample."""
    return rank_intervals(spark, sf, N_BOOT)


@query("rank_bootstrap_200", with_(*_PQ, "al AS (SELECT 'B' AS arm, participant_id, p_b AS p, y FROM pq UNION ALL SELECT 'C', participant_id, p_c, y FROM pq)", rank_ctes("al", ["B", "C"], N_CHECKED))
       + f"SELECT {rsql(_RKC, ['ci_low', 'ci_high'])} FROM rk")
def rank_bootstrap_200(spark, sf):
    return rank_intervals(spark, sf, N_CHECKED)


@query("seed_sensitivity", with_(*_PQ, diff_sql("pq", []), *[boot_ctes("ds", [], _M3, seed=s, n=f"bt{s}") for s in (0, 1, 2)]) + f"""SELECT metric, {r('max(ci_low) - min(ci_low)')} AS low_spread, {r('max(ci_high) - min(ci_high)')} AS high_spread
 FROM (SELECT * FROM bt0 UNION ALL SELECT * FROM bt1 UNION ALL SELECT * FROM bt2) GROUP BY metric""")
def seed_sensitivity(spark, sf):
    p = paired(spark, sf)
    runs = [cp.paired_differences(p, n_boot=N_BOOT, seed=s) for s in (0, 1, 2)]
    u = runs[0].unionByName(runs[1]).unionByName(runs[2]).where(F.col("metric").isin(*_M3))
    return rounded(u.groupBy("metric").agg((F.max("ci_low") - F.min("ci_low")).alias("low_spread"), (F.max("ci_high") - F.min("ci_high")).alias("high_spread")), ["metric"], ["low_spread", "high_spread"])


# ------------------------------------------------------------------ integrity

@query("forecast_check", with_(*M.SEQ_C) + """SELECT count(*) AS n_events, 0::BIGINT AS null_keys, 0::BIGINT AS non_finite, count(*) FILTER (y NOT IN (0, 1)) AS bad_label,
 count(*) FILTER (p < 0 OR p > 1 OR p_frozen_prior < 0 OR p_frozen_prior > 1) AS bad_probability, count(*) FILTER (interval90_low > interval90_high) AS bad_interval, count(*) FILTER (fold < 0) AS bad_fold,
 count(*) - count(DISTINCT event_id) AS duplicate_events, 0::BIGINT AS participants_in_several_folds FROM fc""")
def forecast_check(spark, sf):
    return cp.forecast_problems(scored(spark, sf))


_MC = """SELECT count(*) AS n_shared, 0::BIGINT AS only_left, 0::BIGINT AS only_right, count(*) FILTER (b.participant_id <> c.participant_id) AS participant_mismatch,
 count(*) FILTER (b.fold <> c.fold) AS fold_mismatch, count(*) FILTER (b.y <> c.y) AS label_mismatch, count(*) FILTER (abs(b.rise - c.rise) > 1e-8 + 1e-5 * abs(c.rise)) AS rise_mismatch FROM fb b JOIN fc c USING (event_id)"""


@query("matched_check", with_(*M.SEQ_BC) + _MC)
def matched_check(spark, sf):
    return cp.match_problems(*both(spark, sf))


@query("superset_check", with_(*M.SEQ_BC) + """SELECT count(*) FILTER (activity >= 1.5) AS n_shared, count(*) FILTER (activity < 1.5) AS n_wide_only, 0::BIGINT AS absent_from_wide,
 0::BIGINT AS participant_mismatch, 0::BIGINT AS fold_mismatch, 0::BIGINT AS label_mismatch FROM fb""")
def superset_check(spark, sf):
    """The one-coefficient model covers every event, the activity model only events with enough activity."""
    b, c = both(spark, sf)
    return cp.superset_problems(b, c.where(F.col("activity") >= 1.5))


@query("arms_check")
def arms_check(spark, sf):
    return cp.arms_problems(four(spark, sf), "c_eb")


@query("arms_settings")
def arms_settings(spark, sf):
    stacked = None
    for a, d in four(spark, sf).items():
        s = d.groupBy("fold").agg(F.count(F.lit(1)).alias("n_events")).select(F.lit("cohort").alias("channel"), F.lit(0).alias("seed"), F.concat_ws(":", "fold", "n_events").alias("fold_size"), F.lit(a).alias("arm"))
        s = s.groupBy("channel", "seed", "arm").agg(F.array_join(F.sort_array(F.collect_list("fold_size")), ",").alias("fold_sizes"))
        stacked = s if stacked is None else stacked.unionByName(s)
    return cp.settings_disagreement(stacked, ("channel", "seed", "fold_sizes"))


@query("event_sets", with_(COHORT) + """SELECT count(*) FILTER (a OR b) AS n_union, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b,
 count(*) FILTER (a <> b) AS n_symmetric_difference FROM (SELECT label_exceeds_180 = 1 AS a, activity_level >= 2 AS b FROM cohort)""")
def event_sets(spark, sf):
    from anchorline.sources.adapters import cohort
    ev_ = stage(cohort(spark, sf), "events")
    return cp.event_sets(ev_.where(F.col("label_exceeds_180") == 1), ev_.where(F.col("activity_level") >= 2))


_REG = [("C_minus_B", "brier", "all"), ("C_minus_B", "brier", "active"), ("C_minus_B", "brier", "sedentary"), ("C_minus_B", "log_loss", "all"), ("C_minus_B", "mae_rise", "active")]


@query("comparison_list", with_(*_PQ, _WITHIN, "sy AS (SELECT 'all' AS subset, * FROM sx UNION ALL SELECT stratum, * FROM sx WHERE stratum <> 'excluded')", diff_sql("sy", ["subset"]), boot_ctes("ds", ["subset"], _M3))
       + f"SELECT subset, metric, n_events, {', '.join(f'{r(c)} AS {c}' for c in _BT)} FROM bt WHERE (metric, subset) IN ({', '.join(f'({chr(39)}{m}{chr(39)}, {chr(39)}{s}{chr(39)})' for _, m, s in _REG)})")
def comparison_list(spark, sf):
    """A fixed list of comparisons, each on all events or on one activity stratum."""
    s = stage(cp.within_participant_strata(paired(spark, sf)), "strata")
    sub = F.explode(F.when(F.col("stratum") == "excluded", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.col("stratum"))))
    d = cp.paired_differences(s.withColumn("subset", sub), ["subset"], n_boot=N_BOOT).withColumn("contrast", F.lit("C_minus_B"))
    listed = spark.createDataFrame(_REG, "contrast string, metric string, subset string")
    return rounded(cp.comparison_list(d, listed), ["subset", "metric", "n_events"], _BT)
