"""Forecast metrics as grouped aggregates. Every function takes grouping keys, so pooled, per-fold, per-group, per-stratum and
per-replicate metrics are the same plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.numeric import log_loss
from anchorline.functions.scale import UNCUT, one_slice, prefix_sums, prob_bucket


def _w(weight: str | None) -> Column:
    return F.lit(1) if weight is None else F.col(weight)


def discrimination(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", weight: str | None = None, min_class: int = 2) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum over distinct thresholds); NULL below `min_class` of either class.

    Scores are collapsed to distinct values first; the order statistics are two-level running sums, never one global sort."""
    w = _w(weight)
    d = df.groupBy(*keys, F.col(p).alias("__p")).agg(F.sum(w * F.col(y)).cast("double").alias("pos"), F.sum(w * (1 - F.col(y))).cast("double").alias("neg"))
    few = one_slice(df, keys, "__bk") if keys else None  # such keys as a participant's need no slices
    d = d.withColumn("__bk", prob_bucket("__p")) if few is None else d.withColumn("__bk", F.lit(0)).withMetadata("__bk", {UNCUT: True})
    run = prefix_sums(d, keys, "__bk", ["__p"], {"cpos": "pos", "cneg": "neg"}, totals=True)
    above_pos = F.col("cpos_total") - F.col("cpos") + F.col("pos")
    above_neg = F.col("cneg_total") - F.col("cneg") + F.col("neg")
    agg = run.groupBy(*keys).agg(F.max("cpos_total").alias("n_positive"), F.max("cneg_total").alias("n_negative"),
                                 F.sum(F.col("pos") * (F.col("cneg") - F.col("neg") / 2)).alias("u"),
                                 F.sum(F.col("pos") * above_pos / (above_pos + above_neg)).alias("s"))
    ok = (F.col("n_positive") >= min_class) & (F.col("n_negative") >= min_class)
    return agg.select(*keys, F.col("n_positive").cast("bigint").alias("n_positive"), F.col("n_negative").cast("bigint").alias("n_negative"),
                      F.when(ok, F.col("u") / (F.col("n_positive") * F.col("n_negative"))).alias("roc_auc"),
                      F.when(ok, F.col("s") / F.col("n_positive")).alias("average_precision"))


def losses(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    pc, yc = F.col(p), F.col(y)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.avg(yc).alias("prevalence"), F.avg(pc).alias("mean_probability"),
                                 F.avg((pc - yc) * (pc - yc)).alias("brier"), F.avg(log_loss(yc, pc)).alias("log_loss"),
                                 (F.avg(yc) * (1 - F.avg(yc))).alias("brier_of_constant_prevalence"))


def bin_of(p: str, n_bins: int) -> Column:
    """Right-closed equal-width bin: the number of interior edges strictly below the probability. Edges are i * (1 / n)."""
    return F.expr(" + ".join(f"CAST({p} > {i * (1.0 / n_bins)!r}D AS INT)" for i in range(1, n_bins)))


def bins(df: DataFrame, keys: list[str], n_bins: int = 10, p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """Occupied reliability bins."""
    w = _w(weight)
    g = df.groupBy(*keys, bin_of(p, n_bins).alias("bin")).agg(F.sum(w).alias("n"), F.sum(w * F.col(p)).alias("__sp"), F.sum(w * F.col(y)).alias("__sy"))
    return g.select(*keys, "bin", "n", (F.col("__sp") / F.col("n")).alias("mean_predicted"), (F.col("__sy") / F.col("n")).alias("mean_observed"))


def reliability(df: DataFrame, n_bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """All bins, empty ones kept with n = 0."""
    spark = df.sparkSession
    grid = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    step = 1.0 / n_bins
    return (grid.join(bins(df, [], n_bins, p, y), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("lower", F.col("bin") * F.lit(step)).withColumn("upper", (F.col("bin") + 1) * F.lit(step)))


def ece(df: DataFrame, keys: list[str], n_bins: int = 10, p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    b = bins(df, keys, n_bins, p, y, weight)
    return b.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("mean_observed"))) / F.sum("n")).alias(f"ece{n_bins}"))


def confusion(df: DataFrame, keys: list[str], threshold: float | str = 0.5, p: str = "p", y: str = "y") -> DataFrame:
    """Confusion counts at a fixed threshold or a per-event threshold column; a ratio with a zero denominator is NULL with a reason."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    hit, yes = F.col(p) >= t, F.col(y) == 1
    c = df.groupBy(*keys).agg(F.avg(t).alias("threshold"), F.count_if(yes & hit).alias("tp"), F.count_if(yes & ~hit).alias("fn"),
                              F.count_if(~yes & hit).alias("fp"), F.count_if(~yes & ~hit).alias("tn"))
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.withColumns({
        "sensitivity": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp), "precision": F.try_divide(tp, tp + fp),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "undefined": F.concat_ws(";", F.when(tp + fn == 0, "sensitivity: no positive events"), F.when(tn + fp == 0, "specificity: no negative events"),
                                 F.when(tp + fp == 0, "precision: no events predicted positive"),
                                 F.when(2 * tp + fp + fn == 0, "f1: no positives and none predicted positive"))})


def rise_metrics(df: DataFrame, keys: list[str], suffix: str = "") -> DataFrame:
    m, y = F.col(f"mean_rise{suffix}"), F.col("rise")
    inside = (y >= F.col(f"interval90_low{suffix}")) & (y <= F.col(f"interval90_high{suffix}"))
    return df.groupBy(*keys).agg(F.avg(F.abs(m - y)).alias("mae_rise"), F.avg(m - y).alias("mean_error_rise"), F.avg(inside.cast("double")).alias("coverage90"),
                                 F.avg(F.abs(F.col(f"mean_rise_frozen_prior{suffix}") - y)).alias("mae_rise_frozen_prior"))


def bundle(df: DataFrame, keys: list[str], min_class: int = 2) -> DataFrame:
    """The whole metric row per key. Keys are small report keys, so the five aggregates are joined on them."""
    k = keys or ["__k"]
    src = df if keys else df.withColumn("__k", F.lit(0))
    out = losses(src, k).join(discrimination(src, k, min_class=min_class), k).join(ece(src, k, 10), k).join(ece(src, k, 5), k)
    out = out.withColumn("warning", F.when(F.col("n_events") < 10, "small sample")).withColumn(
        "undefined_metrics", F.when(F.col("roc_auc").isNull(), F.lit("roc_auc;average_precision")).otherwise(F.lit("")))
    return out if keys else out.drop("__k")


def both_classes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Participants, and participants holding both outcomes, per key."""
    per = df.groupBy(*keys, "participant_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_participants"), F.count_if((F.col("lo") == 0) & (F.col("hi") == 1)).alias("participants_with_both_classes"))


#: Newton steps of the calibration line, and the step below which it has converged.
NEWTON_STEPS, CONVERGED = 25, 1e-10


def calibration_line(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Slope and intercept of an unpenalised logistic fit of the outcome on logit(p); NULL for one class, a constant forecast or outcomes that a line separates.

    Newton's method on sums: every step is one aggregate of two gradients and three curvatures over a stored table, so the data stay where they are."""
    from math import isfinite

    from anchorline.session import stage
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    z = stage(df.select(F.log(q / (1 - q)).alias("z"), F.col(y).cast("double").alias("y")), "logits")
    schema, spark = "slope double, intercept double, reason string", df.sparkSession
    seen = z.agg(F.min("y").alias("a"), F.max("y").alias("b"), (F.max("z") - F.min("z")).alias("r")).first()
    if seen.a is None or seen.a == seen.b or seen.r < 1e-9:
        return spark.createDataFrame([(None, None, "single class or constant predictions")], schema)
    intercept = slope = 0.0
    for _ in range(NEWTON_STEPS):
        fit = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("z"))))
        w = fit * (1 - fit)
        s = z.agg(*[F.sum(x).alias(n) for n, x in (("g0", F.col("y") - fit), ("g1", (F.col("y") - fit) * F.col("z")), ("h00", w), ("h01", w * F.col("z")), ("h11", w * F.col("z") * F.col("z")))]).first()
        det = s.h00 * s.h11 - s.h01 * s.h01
        if not det > 1e-12 * s.h00 * s.h11:
            break
        d0, d1 = (s.h11 * s.g0 - s.h01 * s.g1) / det, (s.h00 * s.g1 - s.h01 * s.g0) / det
        intercept, slope = intercept + d0, slope + d1
        if not (isfinite(intercept) and isfinite(slope)):
            break
        if abs(d0) < CONVERGED and abs(d1) < CONVERGED:
            return spark.createDataFrame([(slope, intercept, None)], schema)
    return spark.createDataFrame([(None, None, "no finite fit")], schema)
