"""Matched comparison of forecast tables: integrity checks, paired tables, strata, contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.labels import canonical_id
from anchorline.functions.numeric import finite, log_loss
from anchorline.functions.scale import exact_quantiles
from anchorline.operators.bootstrap import ratio_bootstrap
from anchorline.operators.evaluation import bundle, discrimination
from anchorline.session import stage
from anchorline.spec import COLD_START_MAX, EXPERIENCED_MIN

STAGES = ((0, 0, "0"), (1, 4, "1-4"), (5, 9, "5-9"), (10, 19, "10-19"), (20, 10**9, "20+"))
_SCORE = ["p", "mean_rise", "interval90_low", "interval90_high", "p_frozen_prior", "mean_rise_frozen_prior", "n_personal_before"]
SETTINGS = ("prior_scheme", "gamma_width", "seed", "fold_hash", "channel", "table_hash")


def forecast_problems(f: DataFrame) -> DataFrame:
    """Faults of one forecast table, one aggregate each; all counts must be zero."""
    bad = lambda c: ~F.coalesce(finite(c), F.lit(False))
    numeric = bad("p")
    for c in ("mean_rise", "rise", "p_frozen_prior", "mean_rise_frozen_prior"):
        numeric = numeric | bad(c)
    row = f.agg(F.count(F.lit(1)).alias("n_events"),
                F.count_if(F.col("event_id").isNull() | F.col("participant_id").isNull() | F.col("fold").isNull()).alias("null_keys"),
                F.count_if(numeric).alias("non_finite"), F.count_if(~F.col("y").isin(0, 1)).alias("bad_label"),
                F.count_if((F.col("p") < 0) | (F.col("p") > 1) | (F.col("p_frozen_prior") < 0) | (F.col("p_frozen_prior") > 1)).alias("bad_probability"),
                F.count_if(F.col("interval90_low") > F.col("interval90_high")).alias("bad_interval"),
                F.count_if((F.col("fold") < 0) | (F.col("fold") != F.floor("fold"))).alias("bad_fold"))
    dup = f.groupBy("event_id").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_events"))
    split = f.groupBy(canonical_id("participant_id").alias("c")).agg(F.min("fold").alias("a"), F.max("fold").alias("b")).agg(
        F.count_if(F.col("a") != F.col("b")).alias("participants_in_several_folds"))
    k = lambda d: d.withColumn("__k", F.lit(0))
    return k(row).join(k(dup), "__k").join(k(split), "__k").drop("__k")


def match_problems(left: DataFrame, right: DataFrame, counts: bool = False) -> DataFrame:
    """Full-outer comparison of two forecast tables on event id: ids, participants, folds, labels, rises (and personal counts)."""
    def side(d: DataFrame, s: str) -> DataFrame:
        return d.select("event_id", canonical_id("participant_id").alias(f"pid_{s}"), F.col("fold").alias(f"fold_{s}"), F.col("y").alias(f"y_{s}"),
                        F.col("rise").alias(f"rise_{s}"), F.col("n_personal_before").alias(f"n_{s}"))
    j = side(left, "a").join(side(right, "b"), "event_id", "full_outer")
    both = F.col("pid_a").isNotNull() & F.col("pid_b").isNotNull()
    close = F.abs(F.col("rise_a") - F.col("rise_b")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("rise_b"))
    out = [F.count_if(both).alias("n_shared"), F.count_if(F.col("pid_b").isNull()).alias("only_left"), F.count_if(F.col("pid_a").isNull()).alias("only_right"),
           F.count_if(both & (F.col("pid_a") != F.col("pid_b"))).alias("participant_mismatch"), F.count_if(both & (F.col("fold_a") != F.col("fold_b"))).alias("fold_mismatch"),
           F.count_if(both & (F.col("y_a") != F.col("y_b"))).alias("label_mismatch"), F.count_if(both & ~close).alias("rise_mismatch")]
    if counts:
        out.append(F.count_if(both & (F.col("n_a") != F.col("n_b"))).alias("count_mismatch"))
    return j.agg(*out)


def superset_problems(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """The wide table may hold more events; shared ones must agree and no narrow event may be absent."""
    p = match_problems(wide, narrow)
    return p.select("n_shared", F.col("only_left").alias("n_wide_only"), F.col("only_right").alias("absent_from_wide"), "participant_mismatch", "fold_mismatch", "label_mismatch")


def arms_problems(arms: dict[str, DataFrame], reference: str) -> DataFrame:
    """Every arm against the reference arm, one row per arm."""
    out = None
    for name, arm in sorted(arms.items()):
        if name == reference:
            continue
        row = match_problems(arms[reference], arm, counts=True).withColumn("arm", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def settings_disagreement(stacked: DataFrame, settings: tuple[str, ...]) -> DataFrame:
    """Distinct values of each run setting over stacked arms; every shared setting must have exactly one."""
    row = stacked.select(*settings).distinct().agg(*[F.count_distinct(F.coalesce(F.col(s).cast("string"), F.lit("missing"))).alias(s) for s in settings])
    return row.select(F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.col(s).alias("n_values")) for s in settings])).alias("x")).select("x.*")


def require_matched(problems: DataFrame, allow: tuple[str, ...] = ("n_shared", "n_events", "n_wide_only")) -> None:
    for row in problems.collect():
        bad = {k: v for k, v in row.asDict().items() if k not in allow and k != "arm" and v}
        if bad:
            raise ValueError(f"the forecast tables are not a matched evaluation: {bad}")


def event_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the event universes of two id sets: one full-outer join, no five separate set operations."""
    j = a.select("event_id").distinct().withColumn("a", F.lit(1)).join(b.select("event_id").distinct().withColumn("b", F.lit(1)), "event_id", "full_outer")
    ina, inb = F.col("a").isNotNull(), F.col("b").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("n_union"), F.count_if(ina & inb).alias("n_both"), F.count_if(ina & ~inb).alias("only_a"), F.count_if(~ina & inb).alias("only_b"),
                 F.count_if(ina != inb).alias("n_symmetric_difference"))


def pair(b: DataFrame, c: DataFrame) -> DataFrame:
    """Both models' forecasts side by side on identical events."""
    keep = ["participant_id", "event_id", "fold", "grp", "y", "rise", "activity", "us"]
    left = b.select(*keep, *[F.col(x).alias(f"{x}_b") for x in _SCORE])
    return left.join(c.select("participant_id", "event_id", *[F.col(x).alias(f"{x}_c") for x in _SCORE]), ["participant_id", "event_id"])


def loss_columns(suffix: str) -> dict[str, Column]:
    p, y, m = F.col(f"p{suffix}"), F.col("y"), F.col(f"mean_rise{suffix}")
    inside = ((F.col("rise") >= F.col(f"interval90_low{suffix}")) & (F.col("rise") <= F.col(f"interval90_high{suffix}"))).cast("double")
    return {"brier": (p - y) * (p - y), "log_loss": log_loss(y, p), "mae_rise": F.abs(m - F.col("rise")), "mean_error": m - F.col("rise"), "coverage90": inside}


def frozen_columns(suffix: str) -> dict[str, Column]:
    p, y, m = F.col(f"p_frozen_prior{suffix}"), F.col("y"), F.col(f"mean_rise_frozen_prior{suffix}")
    return {"brier": (p - y) * (p - y), "log_loss": log_loss(y, p), "mae_rise": F.abs(m - F.col("rise"))}


def difference_stats(paired: DataFrame, keys: list[str], first: dict[str, Column], second: dict[str, Column]) -> DataFrame:
    """Per participant: summed first-minus-second differences and the event count."""
    return paired.groupBy(*keys, "participant_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(first[m] - second[m]).alias(m) for m in first if m in second])


def paired_differences(paired: DataFrame, keys: list[str] | None = None, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """C minus B for the additive metrics with participant-clustered intervals, per key."""
    s = difference_stats(paired, keys or [], loss_columns("_c"), loss_columns("_b"))
    return ratio_bootstrap(s, keys or [], ["brier", "log_loss", "mae_rise", "mean_error", "coverage90"], n_boot=n_boot, seed=seed)


def frozen_differences(paired: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Updated minus frozen prior, for both models in one resample: the model name is a key."""
    parts = []
    for s in ("b", "c"):
        d = difference_stats(paired, [], {k: v for k, v in loss_columns(f"_{s}").items() if k in ("brier", "log_loss", "mae_rise")}, frozen_columns(f"_{s}"))
        parts.append(d.withColumn("model", F.lit(s.upper())))
    return ratio_bootstrap(parts[0].unionByName(parts[1]), ["model"], ["brier", "log_loss", "mae_rise"], n_boot=n_boot, seed=seed)


def long_scores(paired: DataFrame, keys: list[str]) -> DataFrame:
    arms = F.explode(F.array(*[F.struct(F.lit(m.upper()).alias("model"), F.col(f"p_{m}").alias("p"), F.col(f"mean_rise_{m}").alias("mean_rise")) for m in ("b", "c")]))
    return paired.select(*keys, "participant_id", "event_id", "y", "rise", arms.alias("x")).select(*keys, "participant_id", "event_id", "y", "rise", "x.*")


def stratum_points(paired: DataFrame, key: str) -> DataFrame:
    """Point metrics of both models per stratum: Brier, log loss, AUC (both classes present), ECE, rise error."""
    k = [key, "model"]
    s = long_scores(paired, [key])
    mae = s.groupBy(*k).agg(F.avg(F.abs(F.col("mean_rise") - F.col("rise"))).alias("mae_rise"))
    people = paired.select(key, "participant_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_participants"))
    return bundle(s, k, min_class=1).join(mae, k).join(people, key)


def within_participant_strata(df: DataFrame, activity: str = "activity", per_side: int = 2) -> DataFrame:
    """active = strictly above the participant's own median, sedentary otherwise, excluded without two events on each side."""
    med = exact_quantiles(df, ["participant_id"], activity, {"__med": 0.5})
    above = F.coalesce(F.col(activity) > F.col("__med"), F.lit(False))
    n = df.groupBy("participant_id", activity).agg(F.count(F.lit(1)).alias("__n")).join(med, "participant_id")
    each = n.groupBy("participant_id").agg(F.max("__med").alias("__med"), ((F.sum(F.when(above, F.col("__n")).otherwise(0)) >= per_side) & (F.sum(F.when(above, 0).otherwise(F.col("__n"))) >= per_side)).alias("__ok"))
    # a row per participant, stored: the events are read once more and meet it in one join
    lab = df.join(stage(each, "medians"), "participant_id")
    return lab.withColumn("stratum", F.when(~F.col("__ok"), "excluded").when(above, "active").otherwise("sedentary")).drop("__med", "__ok")


def experience(n: str = "n_personal_before_b") -> Column:
    return F.when(F.col(n) < COLD_START_MAX, "cold_start").when(F.col(n) >= EXPERIENCED_MIN, "experienced").otherwise("neither")


def stage_of(n: str = "n_personal_before_b") -> Column:
    out = None
    for lo, hi, name in STAGES:
        cond = F.col(n).between(lo, hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def tertiles(df: DataFrame, value: str = "activity") -> DataFrame:
    """Pooled tertiles; a value on a cut goes up."""
    q = exact_quantiles(df, [], value, {"c1": 1 / 3, "c2": 2 / 3}).withColumn("__k", F.lit(0))
    q = stage(q, "cuts")  # one row, which Spark then sends to the events
    return df.withColumn("__k", F.lit(0)).join(q, "__k").withColumn(
        "tertile", F.when(F.col(value) < F.col("c1"), "low").when(F.col(value) < F.col("c2"), "middle").otherwise("high")).drop("__k")


def participant_mae_split(paired: DataFrame, tolerance: float = 1.0) -> DataFrame:
    per = paired.groupBy("participant_id").agg((F.avg(F.abs(F.col("mean_rise_c") - F.col("rise"))) - F.avg(F.abs(F.col("mean_rise_b") - F.col("rise")))).alias("d"))
    return per.agg(F.count(F.lit(1)).alias("n_participants"), F.count_if(F.col("d") < -tolerance).alias("improved"), F.count_if(F.col("d") > tolerance).alias("worsened"),
                   F.count_if(F.abs(F.col("d")) <= tolerance).alias("within_tolerance"))


def per_participant_distribution(paired: DataFrame, min_events: int = 8) -> DataFrame:
    """Quartiles of per-participant C-minus-B differences in Brier and AUC over participants with enough events."""
    enough = paired.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_events).select("participant_id")
    src = paired.join(enough, "participant_id", "left_semi")
    lb, lc = loss_columns("_b")["brier"], loss_columns("_c")["brier"]
    brier = src.groupBy("participant_id").agg((F.avg(lc) - F.avg(lb)).alias("d")).withColumn("metric", F.lit("brier"))
    auc = discrimination(long_scores(src, []), ["participant_id", "model"], min_class=1)
    auc = auc.groupBy("participant_id").agg((F.max(F.when(F.col("model") == "C", F.col("roc_auc"))) - F.max(F.when(F.col("model") == "B", F.col("roc_auc")))).alias("d"))
    auc = auc.where(F.col("d").isNotNull()).withColumn("metric", F.lit("roc_auc"))
    both = brier.unionByName(auc)
    # rounding noise is not a difference
    both = both.withColumn("d", F.when(F.abs(F.col("d")) < 1e-12, F.lit(0.0)).otherwise(F.col("d")))
    better = F.when(F.col("metric") == "brier", F.col("d") < 0).otherwise(F.col("d") > 0)
    worse = F.when(F.col("metric") == "brier", F.col("d") > 0).otherwise(F.col("d") < 0)
    counts = both.groupBy("metric").agg(F.count(F.lit(1)).alias("n_participants"), F.count_if(better).alias("n_better"), F.count_if(worse).alias("n_worse"),
                                        F.count_if(F.col("d") == 0).alias("n_equal"))
    return counts.join(exact_quantiles(both, ["metric"], "d", {"q25": 0.25, "median": 0.5, "q75": 0.75}), "metric")


# contrast name -> weights of the four arms
CONTRASTS = {
    "b_stratified_minus_eb": {"b_st": 1, "b_eb": -1}, "c_stratified_minus_eb": {"c_st": 1, "c_eb": -1},
    "c_minus_b_under_eb": {"c_eb": 1, "b_eb": -1}, "c_minus_b_under_stratified": {"c_st": 1, "b_st": -1},
    "change_in_c_minus_b": {"c_st": 1, "b_st": -1, "c_eb": -1, "b_eb": 1},
}


def four_arms(arms: dict[str, DataFrame]) -> DataFrame:
    out = None
    for a, d in arms.items():
        cols = [F.col("p").alias(f"p_{a}"), F.col("mean_rise").alias(f"mean_rise_{a}")]
        part = d.select("participant_id", "event_id", *(["y", "rise"] if out is None else []), *cols)
        out = part if out is None else out.join(part, ["participant_id", "event_id"])
    return out


def contrast_differences(wide: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Additive-metric contrasts of the prior schemes, one common resample of participants for all of them."""
    def loss(a: str) -> dict[str, Column]:
        p, y = F.col(f"p_{a}"), F.col("y")
        return {"brier": (p - y) * (p - y), "log_loss": log_loss(y, p), "mae_rise": F.abs(F.col(f"mean_rise_{a}") - F.col("rise"))}
    sums = [F.sum(sum(w * loss(a)[m] for a, w in weights.items())).alias(f"{c}|{m}") for c, weights in CONTRASTS.items() for m in ("brier", "log_loss", "mae_rise")]
    stats = wide.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), *sums)
    r = ratio_bootstrap(stats, [], [f"{c}|{m}" for c in CONTRASTS for m in ("brier", "log_loss", "mae_rise")], n_boot=n_boot, seed=seed)
    parts = F.split("metric", r"\|")
    return r.withColumn("contrast", parts[0]).withColumn("metric", parts[1])


def adoption_screen(contrasts: DataFrame, ece_contrasts: DataFrame) -> DataFrame:
    """Per model: Brier and log-loss intervals entirely below zero and the ECE interval not entirely above zero."""
    which = F.col("contrast").isin("b_stratified_minus_eb", "c_stratified_minus_eb")
    a = contrasts.where(which).groupBy("contrast").agg(
        F.bool_or((F.col("metric") == "brier") & (F.col("ci_high") < 0)).alias("brier_below_zero"),
        F.bool_or((F.col("metric") == "log_loss") & (F.col("ci_high") < 0)).alias("log_loss_below_zero"))
    e = ece_contrasts.where(F.col("metric") == "ece10").select("contrast", (~(F.col("ci_low") > 0)).alias("ece10_not_above_zero"))
    return a.join(e, "contrast").withColumn("passes", F.col("brier_below_zero") & F.col("log_loss_below_zero") & F.col("ece10_not_above_zero"))


def experiment_comparisons(records: DataFrame, comparisons: list[tuple[str, str, str, str]], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """mean(metric of a - metric of b) over the events that both forecast, for a fixed list of (model_a, model_b, metric, subset).

    `records` is long: participant_id, event_id, model, p, mean_rise, y, rise, is_active. Subsets are all, active and sedentary. Lower is better for every
    metric, so a negative estimate favours model_a. A listed model that was not run gives no row, a comparison without shared events one with n_events 0.
    Events become wide once; each then gives its differences, which are summed per participant before any resampling."""
    run = [r[0] for r in records.select("model").distinct().collect()]  # the forecasters, a handful
    models = sorted({m for a, b, *_ in comparisons for m in (a, b) if a in run and b in run})
    wide = records.groupBy("participant_id", "event_id").pivot("model", models).agg(F.first("p").alias("p"), F.first("mean_rise").alias("mean_rise")).join(
        records.groupBy("participant_id", "event_id").agg(F.first("y").alias("y"), F.first("rise").alias("rise"), F.first("is_active").alias("is_active")), ["participant_id", "event_id"]) if models else records
    return wide_comparisons(wide, run, comparisons, n_boot, seed)


def wide_comparisons(wide: DataFrame, run: list[str], comparisons: list[tuple[str, str, str, str]], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """`experiment_comparisons` of the forecasters `run` from one row per event: <model>_p and <model>_mean_rise (where a metric reads it) of each, y, rise, is_active.
    A null <model>_p says that the model did not forecast the event."""
    listed = [(i, *c) for i, c in enumerate(comparisons) if c[0] in run and c[1] in run]
    spark = wide.sparkSession

    def loss(model: str, metric: str) -> Column:
        p, y = F.col(f"`{model}_p`"), F.col("y")
        return {"brier": lambda: (p - y) * (p - y), "log_loss": lambda: log_loss(y, p), "mae_rise": lambda: F.abs(F.col(f"`{model}_mean_rise`") - F.col("rise"))}[metric]()

    there = {"all": F.lit(True), "active": F.col("is_active"), "sedentary": ~F.col("is_active")}
    each = [F.struct(F.lit(i).alias("id"), F.when(there[subset] & F.col(f"`{a}_p`").isNotNull() & F.col(f"`{b}_p`").isNotNull(), loss(a, metric) - loss(b, metric)).alias("d")) for i, a, b, metric, subset in listed]
    names = spark.createDataFrame(listed or [], "id int, model_a string, model_b string, metric_name string, subset string")
    if not listed:
        return names.selectExpr("model_a", "model_b", "metric_name AS metric", "subset", "0L AS n_participants", "0L AS n_events", "0D AS estimate", "0D AS ci_low", "0D AS ci_high", "false AS excludes_zero", "'' AS reading")
    stats = wide.select("participant_id", F.explode(F.array(*each)).alias("x")).select("participant_id", "x.*").where("d IS NOT NULL").groupBy("id", "participant_id").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("n"))
    b = ratio_bootstrap(stage(stats, "comparisons"), ["id"], ["d"], n_boot=n_boot, seed=seed)
    reading = F.when(F.col("estimate") < 0, "negative favours model_a").when(F.col("estimate").isNotNull(), "positive favours model_b")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_participants", "n_events")]
    return names.join(b, "id", "left").select("model_a", "model_b", F.col("metric_name").alias("metric"), "subset", *counts, "estimate", "ci_low", "ci_high", "excludes_zero", reading.alias("reading"))


def comparison_list(paired_stats: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Keep the pre-registered comparisons, in their order; the list is a fixed small table."""
    return paired_stats.join(comparisons, ["contrast", "metric", "subset"])
