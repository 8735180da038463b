"""Replays that are published as a whole or not at all.

A participant is replayed only if each of their events keeps every rule. A run is written under its own id, and one manifest row, written last,
makes it visible: readers join the manifest, so a run that was lost before that row leaves nothing to see, and a retry takes a new id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.operators.twin import LABEL_TOLERANCE, THRESHOLD, is_excluded, replay_log
from anchorline.session import stage
from anchorline.spec import OUTCOME_WINDOW

MANIFEST = "run_id string, n_participants bigint, n_refused bigint, n_actions bigint"


def _finite(c: str) -> Column:
    return F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))


def rules() -> list[tuple[str, Column]]:
    """Name and condition of every rule an event can break, in the order in which they are reported. An excluded event needs neither rise nor label."""
    counts, label = ~is_excluded(), F.col("label_exceeds_180")
    agrees = (F.col("baseline_glucose") + F.col("peak_glucose_rise") >= F.lit(THRESHOLD - LABEL_TOLERANCE)) == (label == 1)
    return [("no participant", F.col("participant_id").isNull()), ("no time", F.col("us").isNull()), ("carbs not finite", ~_finite("carbs_g")), ("baseline not finite", ~_finite("baseline_glucose")),
            ("activity not finite", ~_finite("activity_level")), ("rise not finite", counts & ~_finite("peak_glucose_rise")), ("negative carbs", F.coalesce(F.col("carbs_g") < 0, F.lit(False))),
            ("label not 0 or 1", counts & ~F.coalesce(label.isin(0, 1), F.lit(False))), ("label disagrees with baseline plus rise", counts & ~F.coalesce(agrees, F.lit(False)))]


def refused(events: DataFrame) -> DataFrame:
    """(participant_id, refused, n_events): participants with a broken rule, the first one, and how many of their events break it."""
    own = rules()
    broken = events.groupBy("participant_id").agg(*[F.count_if(c).alias(f"__{i}") for i, (_, c) in enumerate(own)])
    first = F.coalesce(*[F.when(F.col(f"__{i}") > 0, F.struct(F.lit(name).alias("refused"), F.col(f"__{i}").alias("n_events"))) for i, (name, _) in enumerate(own)])
    return broken.select("participant_id", first.alias("x")).where("x IS NOT NULL").select("participant_id", "x.*")


def write_run(events: DataFrame, base: str, run_id: str, window: int = OUTCOME_WINDOW) -> None:
    """The replay log of all participants that keep the rules, and the refused ones with their reason. Nothing of it is visible before `commit`."""
    gone = stage(refused(events), "refused")
    kept = stage(events.where("participant_id IS NOT NULL").join(gone, "participant_id", "left_anti"), "accepted")
    gone.write.mode("errorifexists").parquet(f"{base}/runs/{run_id}/refused")
    replay_log(kept, window).write.mode("errorifexists").parquet(f"{base}/runs/{run_id}/log")


def commit(spark: SparkSession, base: str, run_id: str) -> None:
    """One manifest row, counted from what was written. A run without a full log cannot be committed, and a run is committed once."""
    log, gone = spark.read.parquet(f"{base}/runs/{run_id}/log"), spark.read.parquet(f"{base}/runs/{run_id}/refused")
    short = log.groupBy("participant_id").agg((F.count_if(F.col("action") == "forecast") * 2 != F.count(F.lit(1))).alias("bad")).where("bad").count()
    if short:
        raise ValueError(f"{short} participants have forecasts without an outcome; nothing was published")
    both = log.select("participant_id", F.lit(False).alias("gone")).unionByName(gone.select(F.lit(None).cast("string").alias("participant_id"), F.lit(True).alias("gone")))
    row = both.agg(F.count_distinct("participant_id").alias("n_participants"), F.count_if("gone").alias("n_refused"), F.count_if(~F.col("gone")).alias("n_actions"))
    row.select(F.lit(run_id).alias("run_id"), "n_participants", "n_refused", "n_actions").coalesce(1).write.mode("errorifexists").parquet(f"{base}/manifest/run={run_id}")


def publish(events: DataFrame, base: str, run_id: str, window: int = OUTCOME_WINDOW) -> None:
    write_run(events, base, run_id, window)
    commit(events.sparkSession, base, run_id)


def manifest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest/*")


def published(spark: SparkSession, base: str, part: str = "log") -> DataFrame:
    """Rows of all committed runs with their run_id. `part`: log or refused."""
    rows = spark.read.parquet(f"{base}/runs/*/{part}").withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), "/runs/([^/]+)/", 1))
    return rows.join(manifest(spark, base).select("run_id"), "run_id", "left_semi")
