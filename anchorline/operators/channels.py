"""Two sensor channels on the same anchors: matching, confusion, differences, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.functions.scale import equi_depth, prefix_sums

# fixed values
WITHIN = (1, 5, 10, 20)
BANDS = (5, 10, 20)


def match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on (participant, event); rows whose anchors differ keep anchor_match = false so they can be counted."""
    cols = ["us", "label_exceeds", "peak_glucose", "baseline_glucose", "window_completeness", "eligible_core"]
    x = a.select("participant_id", "event_id", *[F.col(c).alias(f"{c}_a") for c in cols])
    y = b.select("participant_id", "event_id", *[F.col(c).alias(f"{c}_b") for c in cols])
    return x.join(y, ["participant_id", "event_id"]).withColumn("anchor_match", F.col("us_a") == F.col("us_b"))


def confusion(m: DataFrame) -> DataFrame:
    la, lb = F.col("label_exceeds_a") == 1, F.col("label_exceeds_b") == 1
    c = m.agg(F.count(F.lit(1)).alias("n"), F.count_if(la & lb).alias("tp"), F.count_if(la & ~lb).alias("fn"), F.count_if(~la & lb).alias("fp"), F.count_if(~la & ~lb).alias("tn"))
    n, tp, fn, fp, tn = (F.col(x).cast("double") for x in ("n", "tp", "fn", "fp", "tn"))
    po, pe = F.try_divide(tp + tn, n), F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return c.withColumn("share_disagree", F.try_divide(fn + fp, n)).withColumn("kappa", F.when(pe != 1, (po - pe) / (1 - pe)))


def difference_report(m: DataFrame, threshold: float, delta: float = 10.0) -> DataFrame:
    """Signed and absolute window-maximum differences, closeness to the threshold, direction of disagreements: one aggregate."""
    d = F.col("peak_glucose_a") - F.col("peak_glucose_b")
    dis = F.col("label_exceeds_a") != F.col("label_exceeds_b")
    near = F.least(F.abs(F.col("peak_glucose_a") - threshold), F.abs(F.col("peak_glucose_b") - threshold))
    short = (F.col("window_completeness_a") < 1) | (F.col("window_completeness_b") < 1)
    return m.agg(F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd_difference"), F.avg(F.abs(d)).alias("mean_abs_difference"),
                 *[F.avg((F.abs(d) <= k).cast("double")).alias(f"within_{k}") for k in WITHIN],
                 F.count_if(near <= delta).alias("near_threshold"), F.count_if(dis & (F.abs(d) <= delta)).alias("disagree_close"), F.count_if(dis & (F.abs(d) > delta)).alias("disagree_far"),
                 *[F.count_if(dis & (near < k)).alias(f"disagree_nearer_{k}") for k in BANDS], F.count_if(dis & (d > 0)).alias("a_higher"), F.count_if(dis & (d < 0)).alias("b_higher"),
                 F.count_if(short).alias("incomplete"), F.count_if(dis & short).alias("disagree_incomplete"))


def concentration(m: DataFrame) -> DataFrame:
    """How the label disagreements spread over participants."""
    per = m.groupBy("participant_id").agg(F.count_if(F.col("label_exceeds_a") != F.col("label_exceeds_b")).alias("d"))
    return per.agg(F.count_if(F.col("d") > 0).alias("participants_with_any"), F.try_divide(F.max("d"), F.sum("d")).alias("max_share"), F.sum("d").alias("n_disagreements"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of each distinct value: counts per value, even slices of them, two-level running counts."""
    d = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    run = prefix_sums(equi_depth(d, [], "__v", "__s"), [], "__s", ["__v"], {"__upto": "__c"})
    return run.select(F.col("__v").alias(value), (F.col("__upto") - (F.col("__c") - 1) / 2).alias(out))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman; NULL below three pairs or for a constant side."""
    p = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    r = p.join(average_ranks(p, a, "__ra"), a).join(average_ranks(p, b, "__rb"), b)
    ok = (F.count(F.lit(1)) >= 3) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    rho = lambda x, y: F.when(ok, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    return r.agg(F.count(F.lit(1)).alias("n"), rho(a, b).alias("pearson"), rho("__ra", "__rb").alias("spearman"))


def summary(df: DataFrame, value: str) -> DataFrame:
    from anchorline.operators.reports import distribution
    return distribution(df, value)

