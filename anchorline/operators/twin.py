"""Versioned per-participant state as append-only tables: forecast, observe, reconcile, exclude, explain.

A participant's version number is the count of outcomes learned so far, so versions, pending queues and replay order are running counts
over (time, action), two-level like every other running sum here. Nothing pairs the rows of one participant with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.functions import scale
from anchorline.functions.numeric import exceed_probability, interval90
from anchorline.functions.scale import UNCUT, dyadic_cover, dyadic_nodes, equi_depth, one_slice, prefix_sums, time_slices
from anchorline.spec import LABEL_TOLERANCE, OUTCOME_WINDOW, THRESHOLD

HIT = 0.5
SIMILAR = 0.25
TREND_FLAT = 0.1


# ------------------------------------------------------------------ state creation and idempotent intake

def initialise(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests marked accepted (version 0 rows to append) or refused; one state per participant, first request wins."""
    first = requests.groupBy("participant_id").agg(F.min("arrival").alias("__first"))
    j = requests.join(first, "participant_id").join(existing.select("participant_id", F.lit(True).alias("__has")).distinct(), "participant_id", "left")
    why = F.when(F.col("__has"), "already initialised").when(F.col("arrival") > F.col("__first"), "repeated request")
    return j.withColumn("refused", why).withColumn("version", F.when(F.col("refused").isNull(), F.lit(0))).drop("__first", "__has")


def idempotent_intake(requests: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """created / repeat / conflict per request: the first arrival of a key is stored, an equal payload repeats it, another conflicts."""
    h = F.sha2(F.to_json(F.struct(*payload)), 256)
    hashed = requests.withColumn("input_hash", h)
    first = hashed.groupBy(*key).agg(F.min(F.struct("arrival", "input_hash")).alias("__f"))
    j = hashed.join(first, key)
    status = F.when(F.col("arrival") == F.col("__f.arrival"), "created").when(F.col("input_hash") == F.col("__f.input_hash"), "repeat").otherwise("conflict")
    return j.withColumn("status", status).drop("__f")


def backdate_guard(requests: DataFrame, learned: DataFrame, window: int = OUTCOME_WINDOW) -> DataFrame:
    """Refuse a forecast earlier than the close of any outcome already learned when it arrived.

    requests(participant_id, event_id, us, arrival), learned(participant_id, us, arrival): a running maximum in arrival order, carried over
    arrival slices so one participant's stream is not one task."""
    both = (learned.select("participant_id", "arrival", F.lit(0).alias("kind"), F.col("us").alias("__l"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("bigint").alias("us"))
            .unionByName(requests.select("participant_id", "arrival", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("__l"), "event_id", "us"))
            )
    both = equi_depth(both, ["participant_id"], "arrival", "__s")
    per = both.groupBy("participant_id", "__s").agg(F.max("__l").alias("__m"))
    before = per.select("participant_id", "__s", F.max("__m").over(Window.partitionBy("participant_id").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
    local = Window.partitionBy("participant_id", "__s").orderBy("arrival", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = both.join(before, ["participant_id", "__s"]).withColumn("latest_learned", F.greatest(F.max("__l").over(local), "__b"))
    return run.where(F.col("kind") == 1).select("participant_id", "event_id", "us", "latest_learned",
                                                F.coalesce(F.col("us") < F.col("latest_learned") + window, F.lit(False)).alias("refused"))


def observation_intake(forecasts: DataFrame, observations: DataFrame, window: int = OUTCOME_WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """Rise and label of an observed peak; refused while the window is open; flags for excluded or partial windows."""
    j = observations.join(forecasts.select("participant_id", "event_id", "us", "baseline_glucose"), ["participant_id", "event_id"], "left")
    excluded = F.coalesce(F.trim("excluded_reason") != "", F.lit(False))
    why = (F.when(F.col("us").isNull(), "no such forecast").when(F.col("observed_through") < F.col("us") + window, "outcome window not complete")
           .when(F.col("peak_glucose").isNull() == ~excluded, "need exactly one of peak and excluded reason"))
    return j.select("participant_id", "event_id", why.alias("refused"), (F.col("peak_glucose") - F.col("baseline_glucose")).alias("peak_rise"),
                    (F.col("peak_glucose") >= threshold).alias("reached_threshold"),
                    F.when(excluded, "excluded").when(F.col("window_completeness") < 1.0, "partial_window").alias("flag"))


def reconcile_guard(forecasts: DataFrame, attempts: DataFrame, window: int = OUTCOME_WINDOW) -> DataFrame:
    """Accept or refuse each reconcile / exclude attempt with the first rule it breaks. Each forecast is resolved once, by the earliest valid attempt."""
    j = attempts.join(forecasts.select("participant_id", "event_id", "us", "baseline_glucose"), ["participant_id", "event_id"], "left")
    agrees = (F.col("baseline_glucose") + F.col("observed_rise") >= F.lit(THRESHOLD - LABEL_TOLERANCE)) == F.col("observed_label")
    is_ex = F.col("action") == "exclude"
    why = (F.when(F.col("us").isNull(), "no such forecast").when(F.col("observed_through") < F.col("us") + window, "window not complete")
           .when(is_ex & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "an exclusion needs a reason")
           .when(~is_ex & ~F.coalesce(F.abs(F.col("observed_rise")) < float("inf"), F.lit(False)), "observed rise not finite")
           .when(~is_ex & ~F.coalesce(agrees, F.lit(False)), "label disagrees with baseline plus rise"))
    judged = j.withColumn("__why", why)
    first = judged.where(F.col("__why").isNull()).groupBy("participant_id", "event_id").agg(F.min("arrival").alias("__first"))
    k = judged.join(first, ["participant_id", "event_id"], "left")
    refused = F.coalesce(F.col("__why"), F.when(F.col("arrival") > F.col("__first"), "already resolved"))
    return k.select("participant_id", "event_id", "arrival", "action", refused.alias("refused"))


# ------------------------------------------------------------------ replay

def is_excluded(c: str = "excluded_reason") -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))




def versions(events: DataFrame) -> DataFrame:
    """version_after per reconciled event: how many outcomes are learned once its window has closed."""
    e = equi_depth(events.withColumn("__e", F.when(is_excluded(), 0).otherwise(1)), ["participant_id"], "us", "__s")
    run = prefix_sums(e, ["participant_id"], "__s", ["us", "event_id"], {"version_after": "__e"})
    return run.withColumn("version_after", F.when(~is_excluded(), F.col("version_after"))).drop("__s", "__e")


def replay_log(events: DataFrame, window: int = OUTCOME_WINDOW, slice_us: int | None = None) -> DataFrame:
    """Ordered actions per participant: due outcomes first, then the forecast; version before and after each action."""
    ex = is_excluded()
    forecast = events.select("participant_id", "event_id", "us", F.col("us").alias("at"), F.lit(1).alias("kind"), F.lit("forecast").alias("action"), F.lit(0).alias("__e"))
    close = events.select("participant_id", "event_id", "us", (F.col("us") + window).alias("at"), F.lit(0).alias("kind"),
                          F.when(ex, "exclude").otherwise("reconcile").alias("action"), F.when(ex, 0).otherwise(1).alias("__e"))
    a = time_slices(forecast.unionByName(close), ["participant_id"], "at", "__s", slice_us).withColumn("__one", F.lit(1))
    run = prefix_sums(a, ["participant_id"], "__s", ["at", "kind", "us", "event_id"], {"seq": "__one", "version_after": "__e"})
    return run.select("participant_id", (F.col("seq") - 1).alias("seq"), "action", "event_id", "at", (F.col("version_after") - F.col("__e")).alias("version_before"), "version_after")


def resolution_status(events: DataFrame, as_of: str, window: int = OUTCOME_WINDOW) -> DataFrame:
    """pending / reconciled / excluded per forecast as of a participant-level time column."""
    closed = F.col("us") + window <= F.col(as_of)
    return events.withColumn("status", F.when(~closed, "pending").when(is_excluded(), "excluded").otherwise("reconciled"))


# ------------------------------------------------------------------ what the state believes

def effective_sensitivity(state: DataFrame, activities: list[float]) -> DataFrame:
    """beta + gamma * activity with the covariance term, for a short list of activity levels (at most 25)."""
    if not 1 <= len(activities) <= 25:
        raise ValueError("give between 1 and 25 activity values")
    a = F.col("activity")
    s = state.select("*", F.explode(F.array(*[F.lit(float(x)) for x in activities])).alias("activity"))
    sd = F.sqrt(F.pow("beta_sd", 2) + a * a * F.pow("gamma_sd", 2) + 2 * a * F.col("beta_gamma_cov"))
    s = s.withColumn("sensitivity", F.col("beta_mean") + F.col("gamma_mean") * a).withColumn("sensitivity_sd", sd)
    lo, hi = interval90(F.col("sensitivity"), F.col("sensitivity_sd"))
    return s.withColumn("low90", lo).withColumn("high90", hi)


def latest(traj: DataFrame) -> DataFrame:
    """Current version per participant: one max_by, no sort."""
    cols = [c for c in traj.columns if c != "participant_id"]
    return traj.groupBy("participant_id").agg(F.max_by(F.struct(*cols), "version").alias("s")).select("participant_id", "s.*")


def as_of_version(traj: DataFrame, wanted: DataFrame) -> DataFrame:
    """State exactly as it was at a stored version."""
    return wanted.join(traj, ["participant_id", "version"])


def history_rows(traj: DataFrame, reference_activity: float) -> DataFrame:
    t = traj.withColumn("parent_version", F.when(F.col("version") > 0, F.col("version") - 1))
    s = effective_sensitivity(t, [reference_activity])
    return s.select("participant_id", "version", "parent_version", "beta_mean", F.pow("beta_sd", 2).alias("beta_var"), "gamma_mean", F.pow("gamma_sd", 2).alias("gamma_var"),
                    F.col("beta_gamma_cov"), F.col("sensitivity").alias("carb_sensitivity"), F.pow("sensitivity_sd", 2).alias("carb_sensitivity_var"))


def convergence(traj: DataFrame) -> DataFrame:
    """Final-over-prior sd of each parameter and whether it never grew from one version to the next."""
    tol = 1e-9
    prev = traj.select("participant_id", (F.col("version") + 1).alias("version"), F.col("beta_sd").alias("__b"), F.col("gamma_sd").alias("__g"))
    j = traj.join(prev, ["participant_id", "version"], "left")
    ok = lambda a, b: F.coalesce(F.col(a) <= F.col(b) * (1 + tol) + tol, F.lit(True))
    ends = [F.max("version").alias("n_observations"), F.min_by("beta_sd", "version").alias("__b0"), F.max_by("beta_sd", "version").alias("__b1"),
            F.min_by("gamma_sd", "version").alias("__g0"), F.max_by("gamma_sd", "version").alias("__g1"),
            F.bool_and(ok("beta_sd", "__b")).alias("beta_monotone"), F.bool_and(ok("gamma_sd", "__g")).alias("gamma_monotone")]
    return j.groupBy("participant_id").agg(*ends).select("participant_id", "n_observations", F.try_divide("__b1", "__b0").alias("beta_ratio"),
                                                         F.try_divide("__g1", "__g0").alias("gamma_ratio"), "beta_monotone", "gamma_monotone")


def what_if(state: DataFrame, scenarios: list[tuple[str, float, float, float]], ranges: DataFrame | None = None) -> DataFrame:
    """Predictive distribution of hypothetical (label, carbs, activity, baseline) inputs; the first is the reference of the deltas.

    The scenarios are a literal array on each state row. `ranges` holds the participant's own observed carbs and activity ranges."""
    if not scenarios:
        raise ValueError("at least one scenario is required")
    for label, c, a, b in scenarios:
        if not all(abs(float(v)) < float("inf") for v in (c, a, b)) or c < 0:
            raise ValueError(f"scenario {label!r} needs finite values and non-negative carbs")
    arr = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(x[0]).alias("label"), F.lit(float(x[1])).alias("carbs_g"), F.lit(float(x[2])).alias("activity_level"),
                             F.lit(float(x[3])).alias("baseline_glucose")) for i, x in enumerate(scenarios)])
    s = state.select("participant_id", "version", "beta_mean", "beta_sd", "gamma_mean", "gamma_sd", "beta_gamma_cov", "noise", F.explode(arr).alias("x")).select("*", "x.*").drop("x")
    c, z = F.col("carbs_g"), F.col("carbs_g") * F.col("activity_level")
    s = s.withColumn("mean_rise", c * F.col("beta_mean") + z * F.col("gamma_mean")).withColumn(
        "pred_std", F.sqrt(F.col("noise") + c * c * F.pow("beta_sd", 2) + 2 * c * z * F.col("beta_gamma_cov") + z * z * F.pow("gamma_sd", 2)))
    s = s.withColumn("p", exceed_probability("baseline_glucose", "mean_rise", "pred_std", THRESHOLD))
    first = s.where(F.col("idx") == 0).select("participant_id", F.col("mean_rise").alias("__m"), F.col("p").alias("__p"))
    s = s.join(first, "participant_id").withColumn("delta_rise", F.col("mean_rise") - F.col("__m")).withColumn("delta_p", F.col("p") - F.col("__p")).drop("__m", "__p")
    if ranges is None:
        return s.withColumn("warning", F.lit(None).cast("string"))
    j = s.join(ranges, "participant_id", "left")
    outside = lambda v, k: F.when((F.col(v) < F.col(f"{k}_lo")) | (F.col(v) > F.col(f"{k}_hi")), F.lit(f"{v} outside the observed range"))
    w = F.nullif(F.concat_ws("; ", outside("carbs_g", "carbs"), outside("activity_level", "activity")), F.lit(""))
    return j.withColumn("warning", w).drop("carbs_lo", "carbs_hi", "activity_lo", "activity_hi")


def observed_ranges(events: DataFrame) -> DataFrame:
    return events.groupBy("participant_id").agg(F.min("carbs_g").alias("carbs_lo"), F.max("carbs_g").alias("carbs_hi"),
                                                F.min("activity_level").alias("activity_lo"), F.max("activity_level").alias("activity_hi"))


def activity_support(requests: DataFrame, supports: DataFrame) -> DataFrame:
    """Reject (synthetic prior) or flag (file prior) an activity outside the range the prior was fitted on. `supports` is one row per prior."""
    j = requests.join(supports, "prior_name", "left")
    out = (F.col("activity_level") < F.col("lo")) | (F.col("activity_level") > F.col("hi"))
    return j.withColumn("support", F.when(F.col("lo").isNull() | ~out, "ok").when(F.col("prior_source") == "synthetic", "reject").otherwise("flag"))


# ------------------------------------------------------------------ forecast versus outcome

def reconciliation_report(forecasts: DataFrame, suffix: str = "") -> DataFrame:
    """Per reconciled forecast: inside the interval, standardised error, probability given to what happened, Brier component, hit."""
    p, y = F.col(f"p{suffix}"), F.col("y")
    return forecasts.withColumns({
        "inside90": (F.col("rise") >= F.col(f"interval90_low{suffix}")) & (F.col("rise") <= F.col(f"interval90_high{suffix}")),
        "standardised_error": (F.col("rise") - F.col(f"mean_rise{suffix}")) / F.col(f"pred_std{suffix}"),
        "probability_of_outcome": F.when(y == 1, p).otherwise(1 - p), "brier": (p - y) * (p - y), "hit": (p >= HIT) == (y == 1)})


def reconciliation_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n_reconciled"), F.avg(F.col("inside90").cast("double")).alias("share_inside90"),
                                                F.avg("standardised_error").alias("mean_standardised_error"), F.avg("brier").alias("mean_brier"))


def hit_rates(report: DataFrame, window: int = 5, slice_us: int | None = None) -> DataFrame:
    """Cumulative and last-`window` hit rate in reconciliation order. The rolling rate is a difference of two running counts, found by an
    equality join on (participant, rank), so a long history stays distributed."""
    if window < 1:
        raise ValueError("window must be at least 1")
    r = time_slices(report.withColumn("__h", F.col("hit").cast("int")).withColumn("__one", F.lit(1)), ["participant_id"], "us", "__s", slice_us)
    run = prefix_sums(r, ["participant_id"], "__s", ["us", "event_id"], {"rank": "__one", "hits": "__h"}).drop("__s", "__h", "__one")
    back = run.select("participant_id", (F.col("rank") + window).alias("rank"), F.col("hits").alias("__before"))
    return run.join(back, ["participant_id", "rank"], "left").withColumn("cumulative_hit_rate", F.col("hits") / F.col("rank")).withColumn(
        "rolling_hit_rate", (F.col("hits") - F.coalesce("__before", F.lit(0))) / F.least(F.col("rank"), F.lit(window))).drop("__before")


def hit_halves(rates: DataFrame) -> DataFrame:
    n = rates.groupBy("participant_id").agg(F.max("rank").alias("n"))
    j = rates.join(n, "participant_id").withColumn("__half", F.floor(F.col("n") / 2))
    h = F.col("hit").cast("double")
    return j.groupBy("participant_id").agg(F.max("n").alias("n"), F.avg(F.when(F.col("rank") <= F.col("__half"), h)).alias("first_half"),
                                           F.avg(F.when((F.col("rank") > F.col("__half")) & (F.col("__half") > 0), h)).alias("second_half"), F.avg(h).alias("overall"))


def rolling_brier(rates: DataFrame, window: int = 10, minimum: int = 3) -> DataFrame:
    """Mean Brier of the last reconciled forecasts; NULL with too few."""
    n = rates.groupBy("participant_id").agg(F.max("rank").alias("n"))
    recent = rates.join(n, "participant_id").where(F.col("rank") > F.col("n") - window)
    return recent.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n_in_window"), F.avg("brier").alias("__b")).select(
        "participant_id", "n_in_window", F.when(F.col("n_in_window") >= minimum, F.col("__b")).alias("rolling_brier"))


def own_history(forecasts: DataFrame, reconciled: DataFrame, window: int = OUTCOME_WINDOW, slice_us: int | None = None) -> DataFrame:
    """For each forecast, the participant's outcomes already learned from meals within 25 % of its dose: count, mean rise, share reached.

    Doses become ranks among the participant's distinct doses; a dose range is then a rank range, tiled by aligned power-of-two intervals,
    and a lesson is indexed under the few intervals that hold its rank. The condition is an equality on (participant, interval) plus a
    running sum over time, so the rows of one participant are never paired with each other."""
    dose = F.round("carbs_g", 9)
    # order at equal values: lower bound, value, upper bound - so a running count gives "values below" and "values up to"
    vals = reconciled.select("participant_id", dose.alias("d")).distinct().select("participant_id", F.lit("").alias("event_id"), F.lit(None).cast("bigint").alias("us"), "d", F.lit(0).alias("side"), F.lit(1).alias("__w"))
    ends = F.explode(F.array(F.struct(F.round(F.col("carbs_g") * (1 - SIMILAR), 9).alias("d"), F.lit(-1).alias("side")), F.struct(F.round(F.col("carbs_g") * (1 + SIMILAR), 9).alias("d"), F.lit(1).alias("side"))))
    asks = forecasts.where("carbs_g IS NOT NULL").select("participant_id", "event_id", "us", ends.alias("x")).select("participant_id", "event_id", "us", "x.d", "x.side", F.lit(0).alias("__w"))
    # three rows of the first count and two of the second for a lesson and a question, so no slice is needed where no participant has many events
    small = not any(one_slice(x, ["participant_id"], "__s", scale.DEPTH // 6) is None for x in ([forecasts] if forecasts is reconciled else [forecasts, reconciled]))
    one = lambda d: d.withColumn("__s", F.lit(0)).withMetadata("__s", {UNCUT: True})
    first = vals.where("d IS NOT NULL").unionByName(asks)
    run = prefix_sums(one(first) if small else equi_depth(first, ["participant_id"], "d", "__s"), ["participant_id"], "__s", ["d", "side", "event_id"], {"below": "__w"}, totals=True)
    bits = (F.ceil(F.log2(F.greatest(F.col("below_total"), F.lit(1)).cast("double"))) + 1).cast("int")
    rank = run.where(F.col("side") == 0).select("participant_id", "d", (F.col("below") - 1).alias("__rank"), bits.alias("__bits"))
    span = run.where(F.col("side") != 0).groupBy("participant_id", "event_id").agg(
        F.max(F.when(F.col("side") == -1, F.col("below"))).alias("__lo"), (F.max(F.when(F.col("side") == 1, F.col("below"))) - 1).alias("__hi"), F.max(bits).alias("__bits"), F.max("us").alias("us"))
    live = span.where(F.col("__hi") >= F.col("__lo"))
    ask = live.select(
        "participant_id", "event_id", F.col("us").alias("at"), F.lit(1).alias("kind"), F.explode(dyadic_cover(F.col("__lo"), F.col("__hi"), F.col("__bits"))).alias("t"))
    know = reconciled.withColumn("d", dose).join(rank, ["participant_id", "d"]).select(
        "participant_id", F.lit("").alias("event_id"), (F.col("us") + window).alias("at"), F.lit(0).alias("kind"), F.explode(dyadic_nodes(F.col("__rank"), F.col("__bits"))).alias("t"),
        F.lit(1).alias("__n"), F.col("rise").alias("__r"), F.col("y").alias("__y"))
    flat = lambda d: d.select("*", "t.level", "t.node").drop("t")
    both = flat(know).unionByName(flat(ask), allowMissingColumns=True).fillna(0, ["__n", "__y"]).fillna(0.0, ["__r"])
    found = prefix_sums(one(both.repartition("participant_id")) if small and not slice_us else time_slices(both, ["participant_id", "level", "node"], "at", "__s", slice_us), ["participant_id", "level", "node"], "__s", ["at", "kind", "event_id"], {"n": "__n", "r": "__r", "y": "__y"})
    found = found.where(F.col("kind") == 1).groupBy("participant_id", "event_id").agg(F.sum("n").alias("n_similar"), F.sum("r").alias("__r"), F.sum("y").alias("__y"))
    out = forecasts.select("participant_id", "event_id", "carbs_g").join(found, ["participant_id", "event_id"], "left")
    n = F.coalesce("n_similar", F.lit(0))
    return out.select("participant_id", "event_id", n.alias("n_similar"), F.when(n > 0, F.col("__r") / n).alias("mean_rise_similar"), F.when(n > 0, F.col("__y") / n).alias("share_reached"))


def explain(forecasts: DataFrame) -> DataFrame:
    """Additive terms, variance split, margin and plain text of an activity-model forecast, from the state it was made with."""
    c, a = F.col("carbs_g"), F.col("activity")
    d = forecasts.withColumns({
        "carb_term": c * F.col("beta_mean_before"), "carb_term_sd": F.abs(c) * F.col("beta_sd_before"),
        "activity_term": c * a * F.col("gamma_mean_before"), "activity_term_sd": F.abs(c * a) * F.col("gamma_sd_before"),
        "parameter_variance": c * c * F.pow("beta_sd_before", 2) + 2 * c * c * a * F.col("s_bg") + c * c * a * a * F.pow("gamma_sd_before", 2)})
    d = d.withColumn("noise_variance", F.col("pred_std") * F.col("pred_std") - F.col("parameter_variance"))
    d = d.withColumn("share_parameter", F.col("parameter_variance") / (F.col("pred_std") * F.col("pred_std")))
    d = d.withColumn("margin", F.col("baseline_glucose") + F.col("mean_rise") - THRESHOLD)
    whole = lambda x: F.round(x).cast("bigint").cast("string")
    text = F.concat(F.lit("expected rise "), whole(F.col("mean_rise")), F.lit(" (sd "), whole(F.col("pred_std")), F.lit("); carbohydrate "), whole(F.col("carb_term")),
                    F.lit(", activity "), whole(F.col("activity_term")), F.lit("; "), whole(100 * F.col("share_parameter")), F.lit("% of the variance is parameter uncertainty"))
    return d.withColumn("text", text)


def trend_word(slope: str) -> Column:
    return F.when(F.col(slope) > TREND_FLAT, "rising").when(F.col(slope) < -TREND_FLAT, "falling").when(F.col(slope).isNotNull(), "flat")


def state_view(forecasts: DataFrame, window: int = OUTCOME_WINDOW) -> DataFrame:
    """Per participant at its last forecast: last inputs, open windows and their carbohydrate, outcomes waiting to be reconciled."""
    last = forecasts.groupBy("participant_id").agg(F.max(F.struct("us", "event_id", "baseline_glucose", "activity", "p", "n_personal_before")).alias("l"))
    as_of = last.select("participant_id", F.col("l.us").alias("as_of"), F.col("l.event_id").alias("last_event"), F.col("l.baseline_glucose").alias("last_glucose"),
                        F.col("l.activity").alias("last_activity"), F.col("l.p").alias("last_p"), F.col("l.n_personal_before").alias("version_at_last"))
    j = forecasts.select("participant_id", "us", "carbs_g").join(as_of, "participant_id")
    open_ = F.col("us") + window > F.col("as_of")
    g = j.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n_forecasts"), F.count_if(open_).alias("open_windows"), F.sum(F.when(open_, F.col("carbs_g")).otherwise(0.0)).alias("carbs_in_open_windows"))
    return as_of.join(g, "participant_id")


def overview(forecasts: DataFrame, traj: DataFrame, as_of: DataFrame) -> DataFrame:
    """One row per state: version, reconciled and pending counts at the as-of time, current parameters."""
    st = resolution_status(forecasts.join(as_of, "participant_id"), "as_of")
    n = st.groupBy("participant_id").agg(F.count_if(F.col("status") == "reconciled").alias("n_reconciled"), F.count_if(F.col("status") == "pending").alias("n_pending"))
    return latest(traj).join(n, "participant_id", "left")


def page(forecasts: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page of a listing ordered by (time, event) with the total count; a top-k, not a full sort, once a limit is set."""
    total = forecasts.agg(F.count(F.lit(1)).alias("total")).scalar()
    return forecasts.orderBy("us", "event_id").offset(offset).limit(limit).withColumn("total", total)

