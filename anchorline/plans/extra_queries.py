"""Registered queries: boosted baseline, leakage mutation, streaming, population start, replay by anonymous index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from anchorline.functions.numeric import rounded_value
from anchorline.operators import boosted as bt
from anchorline.operators import bootstrap as bo
from anchorline.operators import compare as cp
from anchorline.operators import evaluation as ev
from anchorline.operators import leakage as lk
from anchorline.operators import priors as pr
from anchorline.operators import twin as tw
from anchorline.operators.reports import anonymous_labels
from anchorline.plans import modelsql as M
from anchorline.plans.model_queries import fold_inputs, rounded
from anchorline.plans.registry import query
from anchorline.plans.sqltext import COHORT, SERIES, r, with_
from anchorline.plans.twin_queries import _LOG
from anchorline.session import checkpoint_dir, stage
from anchorline.sources.adapters import cohort, series, table
from anchorline.spec import FIXTURE
from anchorline.streaming import pipelines as st

TREES = 100


@query("model_a_forecasts")
def model_a_forecasts(spark, sf):
    e, f = fold_inputs(spark, sf)
    a = bt.staged_out_of_fold(e, f, TREES)
    return rounded(ev.bundle(a, ["fold"]), ["fold", "n_events"], ["brier", "roc_auc", "ece10"])


@query("model_a_contributions")
def model_a_contributions(spark, sf):
    """Rows whose contributions do not add up to the log-odds (none), with the mean size of each feature's share."""
    e, _ = fold_inputs(spark, sf)
    c = stage(bt.contributions(bt.fit(e, TREES), e, e), "contributions")
    total = F.col("bias")
    for f in bt.BASELINE_FEATURES:
        total = total + F.col(f"contribution_{f}")
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - F.col("log_odds")) > 1e-9).alias("n_not_additive"),
                 *[rounded_value(F.avg(F.abs(f"contribution_{f}"))).alias(f"mean_abs_{f}") for f in bt.BASELINE_FEATURES])


@query("three_model_comparison")
def three_model_comparison(spark, sf):
    """Boosted baseline, one-term and activity models on the shared events, with all pairwise differences."""
    from anchorline.plans.eval_queries import both
    e, f = fold_inputs(spark, sf)
    a = bt.staged_out_of_fold(e, f, TREES).select("participant_id", "event_id", F.col("p").alias("p_a"))
    p = cp.pair(*both(spark, sf, (e, f))).join(a, ["participant_id", "event_id"])
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), F.col(c).alias("p")) for n, c in (("A", "p_a"), ("B", "p_b"), ("C", "p_c"))]))
    long = stage(p.select("participant_id", "y", arms.alias("x")).select("participant_id", "y", "x.*"), "arms")
    return rounded(bo.rank_metric_bootstrap(long, ["A", "B", "C"], n_boot=1000), ["contrast", "metric", "n_draws_used", "excludes_zero"], ["ci_low", "ci_high"])


@query("leakage_check")
def leakage_check(spark, sf):
    return lk.check(series(spark, sf), FIXTURE)


@query("leakage_tally")
def leakage_tally(spark, sf):
    return lk.tally(lk.check(series(spark, sf), FIXTURE))


@query("population_start", with_(COHORT, "co AS (SELECT * FROM cohort WHERE participant_id <> '7')", *[c.replace("FROM cohort", "FROM co") for c in (M.FITS,)], M._pool("pool", "1", "fits").replace("SELECT 1,", "SELECT 1 AS fold,"), M.PRIOR_B)
       + f"SELECT n_participants, {r('m_b')} AS m_b, {r('v_bb')} AS v_bb, {r('noise')} AS noise, source FROM prior_b")
def population_start(spark, sf):
    """Version-0 prior of one participant from everyone else."""
    e = stage(cohort(spark, sf), "events")
    p = pr.prior_b(pr.prior_without_participants(e, e.where(F.col("participant_id") == "7")))
    return rounded(p, ["n_participants", "source"], ["m_b", "v_bb", "noise"])


_FIRST = """ce AS (SELECT *, CAST(NULL AS VARCHAR) AS excluded_reason FROM cohort WHERE participant_id = (
 SELECT participant_id FROM (SELECT DISTINCT participant_id FROM cohort) d ORDER BY md5('3|' || participant_id), participant_id LIMIT 1))"""


@query("replay_by_index", with_(COHORT, _FIRST, _LOG) + "SELECT seq, action, version_after - e AS version_before, version_after FROM lg")
def replay_by_index(spark, sf):
    """Replay of the participant behind one anonymous label."""
    e = stage(cohort(spark, sf).withColumn("excluded_reason", F.lit(None).cast("string")), "events")
    who = anonymous_labels(e, seed=3).where(F.col("label") == "P1").select("participant_id")
    return tw.replay_log(e.join(who, "participant_id", "left_semi")).select("seq", "action", "version_before", "version_after")


@query("b_vs_a_bootstrap")
def b_vs_a_bootstrap(spark, sf):
    from anchorline.plans.model_queries import oof
    e, f = fold_inputs(spark, sf)
    a = bt.staged_out_of_fold(e, f, TREES).select("participant_id", "event_id", F.col("p").alias("p_a"))
    b = stage(oof(spark, sf, "B", inputs=(e, f)).select("participant_id", "event_id", "y", "p"), "forecasts")
    cp.require_matched(cp.event_sets(a, b).select(F.col("n_both").alias("n_shared"), "only_a", "only_b"))
    from anchorline.functions.numeric import log_loss
    j = b.join(a, ["participant_id", "event_id"])
    y, pb, pa = F.col("y"), F.col("p"), F.col("p_a")
    s = j.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), F.sum((pb - y) * (pb - y) - (pa - y) * (pa - y)).alias("brier"), F.sum(log_loss(y, pb) - log_loss(y, pa)).alias("log_loss"))
    return rounded(bo.ratio_bootstrap(s, [], ["brier", "log_loss"], n_boot=1000), ["metric", "n_events", "excludes_zero"], ["estimate", "ci_low", "ci_high"])


# ------------------------------------------------------------------ streaming, run to the end of the supplied table

def _stream(spark, sf, build):
    """Run a stream over the events table to completion and return what it appended."""
    st.use_rocksdb(spark)
    table(spark, sf, "events")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    base = f"{checkpoint_dir(spark)}/anchorline/stream-{uuid.uuid4().hex}"
    out = build(src.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("participant_id", F.col("user_id").cast("string")))
    st.run_to_table(out, f"{base}/out", f"{base}/state")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


_WM = "(SELECT max(epoch_us(ts)) FROM events)"


@query("stream_daily_blocks", f"""SELECT CAST(user_id AS VARCHAR) AS participant_id, epoch_us(date_trunc('day', ts)) AS day_us, count(value) AS n, {r('avg(value)')} AS mean FROM events GROUP BY 1, 2
 HAVING epoch_us(date_trunc('day', any_value(ts))) + 86400000000 <= {_WM} - 3600000000""")
def stream_daily_blocks(spark, sf):
    d = _stream(spark, sf, st.daily_blocks)
    return d.select("participant_id", F.unix_micros("day").alias("day_us"), "n", rounded_value("mean").alias("mean"))


@query("stream_rolling_activity", f"""WITH w AS (SELECT CAST(user_id AS VARCHAR) AS participant_id, value, (epoch_us(ts) // 43200000000 + k) * 43200000000 + 43200000000 AS at_us FROM events, (SELECT unnest(range(4)) AS k))
SELECT participant_id, at_us, {r('avg(value)')} AS mean, count(value) AS n FROM w GROUP BY 1, 2 HAVING at_us <= {_WM} - 3600000000""")
def stream_rolling_activity(spark, sf):
    d = _stream(spark, sf, lambda s: st.rolling_activity(s, "2 days", "12 hours"))
    return d.select("participant_id", F.unix_micros("at").alias("at_us"), rounded_value("mean").alias("mean"), "n")


@query("stream_first_requests", "SELECT CAST(user_id AS VARCHAR) AS participant_id, event_id FROM events")
def stream_first_requests(spark, sf):
    return _stream(spark, sf, st.first_requests).select("participant_id", "event_id")


@query("stream_sessions", f"""WITH a AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events WHERE event_type = 'purchase'),
s AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 86399999999 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS k FROM a)
SELECT CAST(user_id AS VARCHAR) AS participant_id, min(us) AS first_us, count(*) AS n_anchors FROM s GROUP BY user_id, k HAVING max(us) + 86399999999 <= (SELECT max(us) FROM a) - 10800000000""")
def stream_sessions(spark, sf):
    d = _stream(spark, sf, lambda s: st.overlap_sessions(s.where(F.col("event_type") == "purchase"), "23 hours 59 minutes 59.999999 seconds"))
    return d.select("participant_id", F.unix_micros("first").alias("first_us"), "n_anchors")


@query("stream_outcomes", with_(SERIES) + f"""SELECT a.participant_id, a.row_order AS event_id, {r('max(s.sensor_a)')} AS peak, count(s.sensor_a) AS n_readings FROM series a JOIN series s ON s.participant_id = a.participant_id AND s.us > a.us AND s.us <= a.us + 43200000000
 WHERE a.anchor_label IS NOT NULL AND s.sensor_a IS NOT NULL GROUP BY 1, 2 HAVING max(a.us) <= (SELECT least(max(CASE WHEN anchor_label IS NOT NULL THEN us END), max(CASE WHEN sensor_a IS NOT NULL THEN us END)) FROM series) - 43200000000 - 600000000""")
def stream_outcomes(spark, sf):
    def build(s):
        a = s.where(F.col("event_type") == "purchase").select("participant_id", "event_id", F.col("ts").alias("t0"))
        rd = s.where(F.col("event_type").isin("view", "click", "error")).select("participant_id", "ts", "value")
        return st.outcome_windows(a, rd, "12 hours")
    d = _stream(spark, sf, build)
    return d.select("participant_id", "event_id", rounded_value("peak").alias("peak"), "n_readings")


@query("stream_personalise", with_(*M.SEQ_C) + f"SELECT participant_id, event_id, n_personal_before AS version, {r('mean_rise')} AS mean_rise, {r('pred_std')} AS pred_std FROM fc")
def stream_personalise(spark, sf):
    """The stateful stream over the event cohort must equal the batch forecasts."""
    st.use_rocksdb(spark)
    e, f = fold_inputs(spark, sf)
    base = f"{checkpoint_dir(spark)}/anchorline/stream-{uuid.uuid4().hex}"
    priors = stage(pr.fold_priors(e, f, "C"), "priors")
    e.join(f.select("participant_id", "fold"), "participant_id").withColumn("excluded_reason", F.lit(None).cast("string")).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    src = spark.readStream.schema(schema).parquet(f"{base}/in").join(priors.drop("source", "train_prevalence"), "fold")
    out = st.personalise(src)
    st.run_to_table(out, f"{base}/out", f"{base}/state")
    d = spark.read.schema(out.schema).parquet(f"{base}/out").where(F.col("kind") == "forecast")
    return rounded(d, ["participant_id", "event_id", "version"], ["mean_rise", "pred_std"])



# ------------------------------------------------------------------ stored tables as sources

@query("file_scan")
def file_scan(spark, sf):
    from anchorline.sources.files import scan_directory
    return scan_directory(spark, sf).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "ext", "class", "length")


@query("table_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count(nullif(CAST({c} AS VARCHAR), '')) AS n_missing, count(*) AS n_rows FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def table_profile(spark, sf):
    from anchorline.sources.files import profile_table
    return profile_table(spark, f"{sf}/customer.parquet").select("column_name", "n_missing", "n_rows")


@query("event_table_stored", with_(SERIES) + "SELECT 'sensor_a' AS channel, TRUE AS require_isolated, 100e0 AS threshold FROM series LIMIT 1")
def event_table_stored(spark, sf):
    """Write the event table with its settings and read the settings back."""
    from anchorline.operators.events import event_table
    from anchorline.sources.sinks import write_event_table
    path = f"{checkpoint_dir(spark)}/anchorline/events-{uuid.uuid4().hex}"
    write_event_table(event_table(series(spark, sf), FIXTURE), path, FIXTURE, "run-1")
    return spark.read.json(f"{path}/settings").select("channel", "require_isolated", "threshold")


@query("prior_artifact")
def prior_artifact(spark, sf):
    """Export an aggregate prior and read it back through the validator."""
    from anchorline.sources.files import read_priors
    from anchorline.sources.sinks import export_prior
    path = f"{checkpoint_dir(spark)}/anchorline/prior-{uuid.uuid4().hex}"
    export_prior(stage(cohort(spark, sf), "events"), path, ["7"])
    return read_priors(spark, path).select("format", rounded_value("model_b.mean").alias("mean"), rounded_value("model_c.v_gg").alias("v_gg"), "rejected")
