"""Population priors from per-participant sufficient statistics; every matrix is at most 2x2 and written out.

Model B: rise = beta * carbs. Model C: rise = beta * carbs + gamma * carbs * activity. Both without intercept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.operators.folds import N_FOLDS

MIN_PARTICIPANTS = 5
RATIO = 1e-3
DIFFUSE_B = 1e4
DIFFUSE_EFFECT = 1e4
GAMMA_WIDTHS = (0.25, 0.5, 1.0, 2.0)
RANK_TOLERANCE = 1e-10  # relative determinant below which a 2x2 design is called rank deficient

def sufficient(events: DataFrame, keys: list[str]) -> DataFrame:
    """Sums that every least-squares fit, prior and update needs. Partial aggregation keeps a hot participant cheap."""
    c, a, y = F.col("carbs_g"), F.col("activity_level"), F.col("peak_glucose_rise")
    g = c * a
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(c * c).alias("cc"), F.sum(c * g).alias("cg"), F.sum(g * g).alias("gg"),
        F.sum(c * y).alias("cy"), F.sum(g * y).alias("gy"), F.sum(y * y).alias("yy"), F.sum(a * a).alias("aa"),
        F.sum("label_exceeds_180").alias("pos"))


def ols(stats: DataFrame) -> DataFrame:
    """Least-squares fits of both designs on one row of sums; NULL where n <= k or the design is rank deficient."""
    n, cc, cg, gg, cy, gy, yy = (F.col(x) for x in ("n", "cc", "cg", "gg", "cy", "gy", "yy"))
    ok1 = (n > 1) & (cc > 0)
    det = cc * gg - cg * cg
    ok2 = (n > 2) & (det > RANK_TOLERANCE * cc * gg)
    b1 = F.when(ok1, cy / cc)
    b2, g2 = F.when(ok2, (gg * cy - cg * gy) / det), F.when(ok2, (cc * gy - cg * cy) / det)
    return (stats.withColumn("b1", b1).withColumn("rss1", F.when(ok1, F.greatest(yy - b1 * cy, F.lit(0.0)))).withColumn("i1", F.when(ok1, 1 / cc))
            .withColumn("b2", b2).withColumn("g2", g2).withColumn("rss2", F.when(ok2, F.greatest(yy - b2 * cy - g2 * gy, F.lit(0.0))))
            .withColumn("i2bb", F.when(ok2, gg / det)).withColumn("i2bg", F.when(ok2, -cg / det)).withColumn("i2gg", F.when(ok2, cc / det)))


def _pool(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled sums plus moments of the per-participant fits, one aggregate."""
    sums = [F.sum(c).alias(c) for c in ("n", "cc", "cg", "gg", "cy", "gy", "yy", "aa", "pos")]
    return parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_participants"), *sums,
        F.count("b1").alias("m1"), F.sum("rss1").alias("s_rss1"), F.sum(F.when(F.col("b1").isNotNull(), F.col("n") - 1)).alias("s_df1"),
        F.var_samp("b1").alias("spread1"), F.avg("i1").alias("i1"),
        F.count("b2").alias("m2"), F.sum("rss2").alias("s_rss2"), F.sum(F.when(F.col("b2").isNotNull(), F.col("n") - 2)).alias("s_df2"),
        F.var_samp("b2").alias("sbb"), F.covar_samp("b2", "g2").alias("sbg"), F.var_samp("g2").alias("sgg"),
        F.avg("i2bb").alias("ibb"), F.avg("i2bg").alias("ibg"), F.avg("i2gg").alias("igg"))


def training_pool(events: DataFrame, folds: DataFrame, k: int = N_FOLDS, by_group: bool = False) -> DataFrame:
    """Per fold: pooled statistics of all participants outside the fold (optionally also per group)."""
    per = ols(sufficient(events, ["participant_id"])).join(folds, "participant_id")
    train = per.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: x != F.col("fold"))))
    return _pool(train, ["fold", "grp"] if by_group else ["fold"])


def population_pool(events: DataFrame) -> DataFrame:
    return _pool(ols(sufficient(events, ["participant_id"])).withColumn("__all", F.lit(0)), ["__all"]).drop("__all")


def _noise(rss: str, df: str, m: str, need: int, pooled: Column) -> Column:
    return F.when(F.col(m) >= need, F.greatest(F.col(rss) / F.col(df), F.lit(1e-6))).otherwise(pooled)


def _pooled_b() -> Column:
    mu = F.col("cy") / F.col("cc")
    return F.greatest(F.greatest(F.col("yy") - mu * F.col("cy"), F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(1e-6))


def _mu_c() -> tuple[Column, Column]:
    det = F.col("cc") * F.col("gg") - F.col("cg") * F.col("cg")
    return (F.col("gg") * F.col("cy") - F.col("cg") * F.col("gy")) / det, (F.col("cc") * F.col("gy") - F.col("cg") * F.col("cy")) / det


def _pooled_c() -> Column:
    b, g = _mu_c()
    rss = F.greatest(F.col("yy") - b * F.col("cy") - g * F.col("gy"), F.lit(0.0))
    return F.greatest(rss / F.greatest(F.col("n") - 2, F.lit(1)), F.lit(1e-6))


def prior_b(pool: DataFrame) -> DataFrame:
    """Empirical-Bayes prior of the one-coefficient model."""
    enough = F.col("m1") >= MIN_PARTICIPANTS
    noise = _noise("s_rss1", "s_df1", "m1", MIN_PARTICIPANTS, _pooled_b())
    floor = F.greatest(RATIO * F.col("spread1"), F.lit(1e-9))
    return (pool.withColumn("noise", noise).withColumn("m_b", F.col("cy") / F.col("cc"))
            .withColumn("v_bb", F.when(enough, F.greatest(F.col("spread1") - F.col("noise") * F.col("i1"), floor)).otherwise(F.lit(DIFFUSE_B)))
            .withColumn("source", F.when(enough, "empirical_bayes_hierarchical").otherwise("diffuse_fallback")))


def eigen_floor(a: Column, b: Column, d: Column, floor: Column) -> tuple[Column, Column, Column, Column]:
    """Symmetric 2x2 [[a,b],[b,d]] with both eigenvalues raised to `floor`; fourth column counts the raised ones."""
    h = F.sqrt(((a - d) / 2) * ((a - d) / 2) + b * b)
    lo, hi = (a + d) / 2 - h, (a + d) / 2 + h
    flo, fhi = F.greatest(lo, floor), F.greatest(hi, floor)
    share = lambda x: F.when(h > 0, x / (2 * h)).otherwise(F.lit(0.0))
    paa, pbb, pdd = share(a - lo), share(b), share(d - lo)
    raised = (lo < floor).cast("int") + (hi < floor).cast("int")
    return fhi * paa + flo * (1 - paa), (fhi - flo) * pbb, fhi * pdd + flo * (1 - pdd), raised


def prior_c(pool: DataFrame) -> DataFrame:
    """Scale-aware empirical-Bayes prior: the eigenvalue floor is applied to effects in outcome units, so activity units cancel."""
    enough = F.col("m2") >= MIN_PARTICIPANTS
    rb, rg = F.sqrt(F.col("cc") / F.col("n")), F.sqrt(F.col("gg") / F.col("n"))
    b, g = _mu_c()
    p = (pool.withColumn("noise", _noise("s_rss2", "s_df2", "m2", MIN_PARTICIPANTS, _pooled_c())).withColumn("m_b", b).withColumn("m_g", g)
         .withColumn("rms_b", F.when(rb > 0, rb).otherwise(F.lit(1.0))).withColumn("rms_g", F.when(rg > 0, rg).otherwise(F.lit(1.0)))
         .withColumn("raw_bb", F.col("sbb") - F.col("noise") * F.col("ibb")).withColumn("raw_bg", F.col("sbg") - F.col("noise") * F.col("ibg"))
         .withColumn("raw_gg", F.col("sgg") - F.col("noise") * F.col("igg")))
    rb, rg = F.col("rms_b"), F.col("rms_g")
    floor = F.greatest(RATIO * (F.col("sbb") * rb * rb + F.col("sgg") * rg * rg) / 2, F.lit(1e-12))
    p = p.withColumn("effect_floor", floor)
    ea, eb, ed, raised = eigen_floor(F.col("raw_bb") * rb * rb, F.col("raw_bg") * rb * rg, F.col("raw_gg") * rg * rg, F.col("effect_floor"))
    return (p.withColumn("v_bb", F.when(enough, ea / (rb * rb)).otherwise(DIFFUSE_EFFECT / (rb * rb)))
            .withColumn("v_bg", F.when(enough, eb / (rb * rg)).otherwise(F.lit(0.0)))
            .withColumn("v_gg", F.when(enough, ed / (rg * rg)).otherwise(DIFFUSE_EFFECT / (rg * rg)))
            .withColumn("n_raised", F.when(enough, raised))
            .withColumn("sampling_share_gamma", F.when(enough & (F.col("sgg") > 0), F.col("noise") * F.col("igg") / F.col("sgg")))
            .withColumn("correlation", F.col("v_bg") / F.sqrt(F.col("v_bb") * F.col("v_gg")))
            .withColumn("source", F.when(enough, "empirical_bayes_hierarchical_scale_aware").otherwise("diffuse_fallback")))


def _moment_variance(prefix: str = "") -> Column:
    c = lambda x: F.col(prefix + x)
    noise = F.greatest(c("s_rss1") / c("s_df1"), F.lit(1e-6))
    return F.when(c("m1") >= MIN_PARTICIPANTS, F.greatest(c("spread1") - noise * c("i1"), RATIO * c("spread1"), F.lit(1e-9)))


def stratified_prior(strata: DataFrame, whole: DataFrame, keys: list[str], gamma_width: float = 0.5) -> DataFrame:
    """Group-stratified prior: beta from the group (pooled when it has too few participants), gamma centred at 0, noise and activity
    scale from all training rows. `strata` is keyed by keys + grp, `whole` by keys."""
    if gamma_width not in GAMMA_WIDTHS:
        raise ValueError(f"gamma width must be one of {GAMMA_WIDTHS}")
    w = whole.select(*keys, *[F.col(c).alias(f"w_{c}") for c in whole.columns if c not in keys])
    j = strata.join(w, keys)
    own = F.col("n_participants") >= MIN_PARTICIPANTS
    beta = F.when(own, F.col("cy") / F.col("cc")).otherwise(F.col("w_cy") / F.col("w_cc"))
    size = F.greatest(F.abs(F.col("m_b")), F.lit(1e-3))
    det = F.col("w_cc") * F.col("w_gg") - F.col("w_cg") * F.col("w_cg")
    wb, wg = (F.col("w_gg") * F.col("w_cy") - F.col("w_cg") * F.col("w_gy")) / det, (F.col("w_cc") * F.col("w_gy") - F.col("w_cg") * F.col("w_cy")) / det
    pooled_c = F.greatest((F.col("w_yy") - wb * F.col("w_cy") - wg * F.col("w_gy")) / F.greatest(F.col("w_n") - 2, F.lit(1)), F.lit(1e-6))
    wmu = F.col("w_cy") / F.col("w_cc")
    pooled_b = F.greatest((F.col("w_yy") - wmu * F.col("w_cy")) / F.greatest(F.col("w_n") - 1, F.lit(1)), F.lit(1e-6))
    out = (j.withColumn("m_b", beta)
           .withColumn("v_bb", F.coalesce(F.when(own, _moment_variance()), _moment_variance("w_"), size * size))
           .withColumn("m_g", F.lit(0.0)).withColumn("v_bg", F.lit(0.0))
           .withColumn("activity_rms", F.sqrt(F.col("w_aa") / F.col("w_n"))))
    sd = F.lit(gamma_width) * size / F.col("activity_rms")
    return (out.withColumn("v_gg", sd * sd)
            .withColumn("noise_b", F.when(F.col("w_m1") > 0, F.greatest(F.col("w_s_rss1") / F.col("w_s_df1"), F.lit(1e-6))).otherwise(pooled_b))
            .withColumn("noise_c", F.when(F.col("w_m2") > 0, F.greatest(F.col("w_s_rss2") / F.col("w_s_df2"), F.lit(1e-6))).otherwise(pooled_c))
            .withColumn("pooled_fallback", ~own)
            .withColumn("fallback_reason", F.when(~own, F.format_string("only %d training participants in the group (need %d)", F.col("n_participants"), F.lit(MIN_PARTICIPANTS))))
            .withColumn("source", F.when(own, "stratified_regression_gamma0").otherwise("stratified_regression_gamma0_pooled_fallback")))


def fold_priors(events: DataFrame, folds: DataFrame, model: str, scheme: str = "empirical_bayes", gamma_width: float | None = None,
                k: int = N_FOLDS, pools: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """Prior rows to join on `fold` (empirical Bayes) or `fold, grp` (stratified): m_b, v_bb, m_g, v_bg, v_gg, noise, prevalence.

    `pools` passes stored training pools (all, per group) so several priors share one pass over the events."""
    validate_options(model, scheme, gamma_width)
    whole = pools[0] if pools else training_pool(events, folds, k)
    prevalence = F.col("pos") / F.col("n")
    if scheme == "empirical_bayes":
        p = prior_b(whole) if model == "B" else prior_c(whole)
        if model == "B":
            p = p.withColumn("m_g", F.lit(0.0)).withColumn("v_bg", F.lit(0.0)).withColumn("v_gg", F.lit(0.0))
        return p.select("fold", "m_b", "v_bb", "m_g", "v_bg", "v_gg", "noise", "source", prevalence.alias("train_prevalence"))
    strata = pools[1] if pools and pools[1] is not None else training_pool(events, folds, k, by_group=True)
    # a group whose every participant sits in the held-out fold has no training row: it takes the pooled prior
    grid = folds.select("fold", "grp").distinct()
    strata = grid.join(strata, ["fold", "grp"], "left").withColumn("n_participants", F.coalesce("n_participants", F.lit(0)))
    p = stratified_prior(strata, whole, ["fold"], 0.5 if gamma_width is None else gamma_width)
    return p.select("fold", "grp", "m_b", "v_bb", "m_g", "v_bg", F.col("v_gg"), F.col("noise_b" if model == "B" else "noise_c").alias("noise"), "source",
                    (F.col("w_pos") / F.col("w_n")).alias("train_prevalence"))


def validate_options(model: str, scheme: str, gamma_width: float | None) -> None:
    if model not in ("B", "C"):
        raise ValueError("model must be 'B' or 'C'")
    if scheme not in ("empirical_bayes", "stratified"):
        raise ValueError("scheme must be 'empirical_bayes' or 'stratified'")
    if gamma_width is not None and (model == "B" or scheme == "empirical_bayes"):
        raise ValueError("a gamma width applies to Model C with the stratified prior only")
    if gamma_width is not None and gamma_width not in GAMMA_WIDTHS:
        raise ValueError(f"gamma width must be one of {GAMMA_WIDTHS}")


def prior_without_participants(events: DataFrame, held_out: DataFrame) -> DataFrame:
    """One empirical-Bayes prior for a set of held-out participants, from everyone else (left anti join)."""
    return population_pool(events.join(held_out.select("participant_id").distinct(), "participant_id", "left_anti"))
