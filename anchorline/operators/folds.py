"""Participant folds, chronological splits, leakage assertions, order-free fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.functions.scale import dense_ids, prefix_sums
from anchorline.spec import DAY, OUTCOME_WINDOW

N_FOLDS = 5


def participant_folds(people: DataFrame, k: int = N_FOLDS, seed: int = 0) -> DataFrame:
    """(participant_id, grp) -> fold: seeded hash order inside each group, dealt round-robin with the deal carried over between groups."""
    keyed = people.select("participant_id", "grp").distinct().withColumn("__seeded", F.concat_ws("|", F.lit(str(seed)), "participant_id"))
    ranked = dense_ids(keyed, "__seeded", "__rank", "__n", keys=["grp"])
    sizes = keyed.groupBy("grp").agg(F.count(F.lit(1)).alias("__size"))
    w = Window.partitionBy(F.lit(0)).orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("grp", F.coalesce(F.sum("__size").over(w), F.lit(0)).alias("__start"))  # one row per group: bounded
    return ranked.join(start, "grp").select("participant_id", "grp", ((F.col("__rank") + F.col("__start")) % k).cast("int").alias("fold"))


def small_groups(people: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """Groups with fewer than k participants; stratified folds are refused while this is not empty."""
    return people.select("participant_id", "grp").distinct().groupBy("grp").count().where(F.col("count") < k)


def checked_folds(people: DataFrame, k: int = N_FOLDS, seed: int = 0) -> DataFrame:
    bad = small_groups(people, k).limit(5).collect()
    if bad:
        raise ValueError(f"every group needs at least {k} participants; too small: {[r['grp'] for r in bad]}")
    return participant_folds(people, k, seed)


def fold_composition(events: DataFrame, folds: DataFrame) -> DataFrame:
    per = events.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label_exceeds_180").alias("pos"),
                                               F.min("label_exceeds_180").alias("lo"), F.max("label_exceeds_180").alias("hi"))
    j = folds.join(per, "participant_id", "left")
    return j.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_participants"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_positive"),
        F.coalesce(F.sum(F.col("n") - F.col("pos")), F.lit(0)).alias("n_negative"), (F.sum("pos") / F.sum("n")).alias("prevalence"),
        F.count_if((F.col("lo") == 0) & (F.col("hi") == 1)).alias("participants_with_both_classes"))


def fold_group_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold", "grp").agg(F.count(F.lit(1)).alias("n_participants"))


def _lanes(h: Column) -> list[Column]:
    return [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]


def fingerprint(df: DataFrame, columns: list[str], name: str = "fingerprint") -> DataFrame:
    """Order-free table hash: sha256 per row, four 60-bit lanes summed exactly, hashed again with the row count."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    h = df.select(F.sha2(text, 256).alias("h"))
    sums = h.agg(F.count(F.lit(1)).alias("n"), *[F.sum(lane).cast("decimal(38,0)").alias(f"l{i}") for i, lane in enumerate(_lanes(F.col("h")))])
    return sums.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"l{i}").cast("string") for i in range(4)]), 256).alias(name))


def chronological_split(events: DataFrame, fraction: float = 0.25, window: int = OUTCOME_WINDOW, slice_us: int = 90 * DAY) -> DataFrame:
    """part = train / test / purged per event; the last round(n * fraction) events of a participant are held out (at least one if n > 1)."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1, exclusive")
    e = events.withColumn("__s", F.floor(F.col("us") / slice_us)).withColumn("__one", F.lit(1))
    ranked = prefix_sums(e, ["participant_id"], "__s", ["us", "event_id"], {"__rank": "__one"})
    n = events.groupBy("participant_id").agg(F.count(F.lit(1)).alias("__n"))
    ranked = ranked.join(n, "participant_id")
    n_test = F.when(F.col("__n") > 1, F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(fraction), 0).cast("bigint"))).otherwise(F.lit(0))
    ranked = ranked.withColumn("__test", F.col("__rank") > F.col("__n") - n_test)
    first = ranked.where("__test").groupBy("participant_id").agg(F.min("us").alias("__first"))
    return ranked.join(first, "participant_id", "left").withColumn(
        "part", F.when(F.col("__test"), "test").when(F.col("us") + window > F.col("__first"), "purged").otherwise("train")
    ).drop("__s", "__one", "__rank", "__n", "__test", "__first")


def split_leakage(split: DataFrame, window: int = OUTCOME_WINDOW) -> DataFrame:
    """Participants whose training outcomes are not all observed before their first test event; must be empty."""
    per = split.groupBy("participant_id").agg(F.max(F.when(F.col("part") == "train", F.col("us"))).alias("train_last"),
                                              F.min(F.when(F.col("part") == "test", F.col("us"))).alias("test_first"))
    return per.where(F.col("test_first") < F.col("train_last") + window)


def coverage_check(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """Exactly one prediction per event, and no participant in more than one fold."""
    pred = predictions.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    both = events.select("event_id", F.lit(1).alias("e")).join(pred, "event_id", "full_outer")
    left = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"),
                    F.count_if(F.col("n") > 1).alias("repeated"))
    folds = predictions.groupBy("participant_id").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).agg(
        F.count_if(F.col("lo") != F.col("hi")).alias("split_participants"))
    return left.withColumn("__k", F.lit(0)).join(folds.withColumn("__k", F.lit(0)), "__k").drop("__k")
