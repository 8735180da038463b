import pytest
from pyspark.sql import functions as F

from anchorline.operators import reports as rep
from anchorline.operators import twin as tw
from anchorline.spec import OUTCOME_WINDOW as W
from helpers import COHORT, cohort_rows

EVENTS = COHORT + ", excluded_reason string"


def test_replay_matches_a_queue(spark):
    times = [0, W // 2, W, W, 3 * W]
    rows = [("p", f"e{i}", t, 50.0, 2.0, 100.0, 40.0, 0, "A", "gap" if i == 1 else None) for i, t in enumerate(times)]
    log = tw.replay_log(spark.createDataFrame(rows, EVENTS), slice_us=W).orderBy("seq").collect()
    want, pending, version = [], [], 0

    def close(now):
        nonlocal version
        for p in sorted([p for p in pending if p[0] <= now]):
            pending.remove(p)
            act = "exclude" if p[1] == 1 else "reconcile"
            version += act == "reconcile"
            want.append((act, f"e{p[1]}", version))
    for i, t in enumerate(times):
        close(t)
        want.append(("forecast", f"e{i}", version))
        pending.append((t + W, i))
    close(10 ** 18)
    assert [(r.action, r.event_id, r.version_after) for r in log] == want
    assert all(r.version_after - r.version_before == (r.action == "reconcile") for r in log)


def test_reconcile_rules(spark):
    f = spark.createDataFrame([(e, "p", 0, 150.0) for e in "abcdefg"], "event_id string, participant_id string, us long, baseline_glucose double")
    ok, early = W, W - 1
    att = [("a", 1, "reconcile", 40.0, True, ok, None), ("a", 2, "reconcile", 40.0, True, ok, None), ("b", 1, "reconcile", 40.0, True, early, None), ("c", 1, "reconcile", 40.0, False, ok, None),
           ("d", 1, "exclude", None, None, ok, " "), ("e", 1, "exclude", None, None, ok, "gap"), ("e", 2, "reconcile", 10.0, False, ok, None), ("f", 1, "reconcile", float("nan"), True, ok, None),
           ("zz", 1, "reconcile", 1.0, False, ok, None), ("g", 1, "reconcile", 30.0 - 5e-7, True, ok, None)]
    df = spark.createDataFrame([("p", *a) for a in att], "participant_id string, event_id string, arrival int, action string, observed_rise double, observed_label boolean, observed_through long, reason string")
    got = {(r.event_id, r.arrival): r.refused for r in tw.reconcile_guard(f, df).collect()}
    assert got == {("a", 1): None, ("a", 2): "already resolved", ("b", 1): "window not complete", ("c", 1): "label disagrees with baseline plus rise", ("d", 1): "an exclusion needs a reason",
                   ("e", 1): None, ("e", 2): "already resolved", ("f", 1): "observed rise not finite", ("zz", 1): "no such forecast", ("g", 1): None}


def test_own_history_equals_pairs(spark):
    rows = cohort_rows(n_people=3, n_events=40, gap_hours=1)
    e = spark.createDataFrame(rows, COHORT).withColumn("rise", F.col("peak_glucose_rise")).withColumn("y", F.col("label_exceeds_180"))
    got = {r.event_id: r for r in tw.own_history(e, e, slice_us=7 * 3_600_000_000).collect()}
    for a in rows:
        sim = [b for b in rows if b[0] == a[0] and b[2] + W <= a[2] and abs(b[3] - a[3]) <= 0.25 * a[3]]
        assert got[a[1]].n_similar == len(sim)
        if sim:
            assert got[a[1]].mean_rise_similar == pytest.approx(sum(b[6] for b in sim) / len(sim)) and got[a[1]].share_reached == pytest.approx(sum(b[7] for b in sim) / len(sim))


def test_idempotent_and_backdated_intake(spark):
    rq = spark.createDataFrame([("p", "e", 1, 5.0), ("p", "e", 2, 5.0), ("p", "e", 3, 6.0)], "participant_id string, event_id string, arrival long, carbs_g double")
    assert {r.arrival: r.status for r in tw.idempotent_intake(rq, ["participant_id", "event_id"], ["carbs_g"]).collect()} == {1: "created", 2: "repeat", 3: "conflict"}
    req = spark.createDataFrame([("p", "x", 10 + W, 5), ("p", "y", 9 + W, 5), ("p", "z", 0, 1)], "participant_id string, event_id string, us long, arrival long")
    learned = spark.createDataFrame([("p", 10, 4), ("p", 10 ** 12, 9)], "participant_id string, us long, arrival long")
    assert {r.event_id: r.refused for r in tw.backdate_guard(req, learned).collect()} == {"x": False, "y": True, "z": False}


def test_hit_rates_cross_slices(spark):
    hits = [True, False, True, True, False, True, True, False]
    df = spark.createDataFrame([("p", f"e{i}", i * W, h) for i, h in enumerate(hits)], "participant_id string, event_id string, us long, hit boolean")
    r = tw.hit_rates(df, 3, slice_us=2 * W).orderBy("rank").collect()
    assert [x.cumulative_hit_rate for x in r] == pytest.approx([sum(hits[:i + 1]) / (i + 1) for i in range(8)])
    assert [x.rolling_hit_rate for x in r] == pytest.approx([sum(hits[max(0, i - 2):i + 1]) / min(3, i + 1) for i in range(8)])


def test_refusals(spark):
    state = spark.createDataFrame([("p", 0, 1.0, 0.1, 0.0, 0.1, 0.0, 100.0)], "participant_id string, version int, beta_mean double, beta_sd double, gamma_mean double, gamma_sd double, beta_gamma_cov double, noise double")
    with pytest.raises(ValueError):
        tw.what_if(state, [("bad", -1.0, 2.0, 100.0)])
    with pytest.raises(ValueError):
        tw.effective_sensitivity(state, [1.0] * 26)
    with pytest.raises(ValueError):
        rep.require_columns(state, ["carbs_g"], "events")
    ok = spark.createDataFrame(cohort_rows(), COHORT)
    rep.require_zero(rep.schema_problems(ok), "events")
    with pytest.raises(ValueError):
        rep.require_zero(rep.schema_problems(ok.withColumn("carbs_g", -F.col("carbs_g"))), "events")


def test_a_replay_is_published_whole_or_not_at_all(spark, tmp_path):
    from anchorline.operators import replay_store as rs
    good = lambda p, i, **c: {"participant_id": p, "event_id": f"{p}{i}", "us": i * W, "carbs_g": 50.0, "activity_level": 2.0, "baseline_glucose": 100.0,
                              "peak_glucose_rise": 40.0, "label_exceeds_180": 0, "grp": "A", "excluded_reason": None, **c}
    inf = float("inf")
    bad = {"b": {"us": None}, "c": {"carbs_g": -1.0}, "d": {"activity_level": inf}, "e": {"peak_glucose_rise": float("nan")}, "f": {"label_exceeds_180": 1}, "g": {"label_exceeds_180": None}, None: {}}
    rows = [good("a", i) for i in range(4)] + [good("h", 1, peak_glucose_rise=None, label_exceeds_180=None, excluded_reason="gap")]
    rows += [good(p, i, **(c if i == 2 else {})) for p, c in bad.items() for i in range(4)]
    names = [c.split()[0] for c in EVENTS.split(",")]
    events = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVENTS)
    got = {r["participant_id"]: (r["refused"], r["n_events"]) for r in rs.refused(events).collect()}
    assert got == {"b": ("no time", 1), "c": ("negative carbs", 1), "d": ("activity not finite", 1), "e": ("rise not finite", 1), "f": ("label disagrees with baseline plus rise", 1),
                   "g": ("label not 0 or 1", 1), None: ("no participant", 4)}
    base = str(tmp_path)
    rs.publish(events, base, "one")
    rs.write_run(events, base, "two")
    assert {(r["run_id"], r["participant_id"]) for r in rs.published(spark, base).collect()} == {("one", "a"), ("one", "h")}
    assert [tuple(r) for r in rs.manifest(spark, base).collect()] == [("one", 2, 7, 10)]
    with pytest.raises(Exception, match="(?i)exist"):
        rs.commit(spark, base, "one")
    rs.commit(spark, base, "two")
    assert rs.published(spark, base).count() == 20 and rs.published(spark, base, "refused").count() == 14
    rs.publish(events.where("participant_id = 'b'"), base, "none")
    assert rs.manifest(spark, base).where("run_id = 'none'").first()["n_actions"] == 0
