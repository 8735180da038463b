import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.functions import labels as lb
from anchorline.operators import audits as au
from anchorline.operators import signal as sg
from anchorline.session import stage
from anchorline.spec import MINUTE
from helpers import T0


def native(period=5, offset=2, n=3000, seed=0):
    """Linear interpolation between knots that sit on one residue."""
    rng = np.random.default_rng(seed)
    knots = np.arange(offset - period, n + period, period)
    return np.interp(np.arange(n), knots, 100 + np.cumsum(rng.normal(0, 4, len(knots))))


def grid(spark, v, pid="p"):
    return spark.createDataFrame([(pid, i, float(x)) for i, x in enumerate(v) if np.isfinite(x)], "participant_id string, m long, v double")


def test_known_phase_is_recovered(spark):
    d = sg.differences(grid(spark, native()))
    c = sg.concentration(sg.clipped(d), [5]).first()
    assert c.residue == 2 and c.concentration > 0.95
    ph = sg.block_phases(d, 5, block=600)
    s = sg.phase_stability(ph, sg.concentration(sg.clipped(d), [5]), 5).first()
    assert s.agreement_exact == 1.0 and s.phase_shifts == 0


def test_permutation_test_separates_signal_from_noise(spark):
    g = grid(spark, native(n=1200)).unionByName(grid(spark, 100 + np.random.default_rng(1).normal(0, 4, 1200), "noise"))
    pts = sg.clipped(sg.differences(g))
    t = {(r.participant_id, r.period): r for r in sg.permutation_test(pts, [3, 5, 10]).collect()}
    assert t["p", 5].p_value == pytest.approx(0.01) and t["p", 5].concentration > t["p", 5].null95 and t["noise", 5].p_value > 0.01
    assert sg.fundamental_period(sg.permutation_test(pts, [2, 3, 4, 5, 6, 7, 8, 9, 10]).where("participant_id = 'p'")).first().fundamental_period == 5


def test_permutations_make_no_row_per_replicate_and_pieces_agree(spark, monkeypatch):
    pts = stage(sg.clipped(sg.differences(grid(spark, native(n=400)).unionByName(grid(spark, 100 + np.random.default_rng(1).normal(0, 4, 30), "noise")))), "points")
    whole = sg.permutation_test(pts, [3, 5])
    assert "Generate" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(sg, "PIECE", 64)  # p is then dealt in pieces
    key = lambda t: sorted((r.participant_id, r.period, r.residue, r.n_points, round(r.concentration, 9), round(r.p_value, 9), round(r.null95, 9)) for r in t.collect())
    assert key(sg.permutation_test(pts, [3, 5])) == key(whole)


def test_shuffled_ranks_are_those_of_the_column_form(spark):
    for n in (1, 2, 7, 300):
        df = spark.range(n).selectExpr("id AS rank", f"{n}L AS n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2))))
        want = {(r.rank, r.rep): r.pos for r in df.withColumn("pos", sg._shuffled_rank("rank", "n", "rep", 0)).collect()}
        to = sg.shuffled_ranks(np.arange(n), n, 3, 0)
        assert all(to[k, r] == x for (k, r), x in want.items()) and len(want) == 3 * n


def test_probe_summary_pairs_anchors_by_row_alone_as_its_sql_does(spark, tmp_path):
    import duckdb

    from anchorline.plans import audit_queries
    from anchorline.plans.registry import ORACLES
    rows = [(1, f"2024-01-01 00:00:0{u}", u, "purchase", 1.0 + u, '{"k": 3}') for u in (1, 2)] + [(10 * u + i, f"2024-01-01 {h}:00:00", u, "view", 3.0 * u + i, '{"k": 3}') for u in (1, 2) for i, h in enumerate(("01", "15"))]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string").selectExpr("event_id", "CAST(t AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLES["probe_summary"]).fetchall()
    assert sorted(tuple(r) for r in audit_queries.probe_summary(spark, str(tmp_path)).collect()) == sorted(want) and max(w[1] for w in want) == 4


def test_differences_need_observed_neighbours(spark):
    v = np.array([1.0, 3, 6, np.nan, 10, 20, 50])
    rows = {r.m: (r.d1, r.d2) for r in sg.differences(grid(spark, v)).collect()}
    assert rows == {0: (None, None), 1: (2.0, 1.0), 2: (3.0, None), 4: (None, None), 5: (10.0, 20.0), 6: (30.0, None)}


def test_filled_outage_is_a_long_sloped_run(spark):
    v = native(n=600)
    v[200:261] = np.linspace(v[200], v[200] + 60, 61)
    v[400:440] = v[400]
    d = sg.differences(grid(spark, v))
    r = sg.straight_runs(d, sg.resolution(grid(spark, v)), 5).first()
    assert r.n_sloped == 1 and 61 <= r.longest_sloped <= 66 and r.n_flat == 1 and r.longest_flat >= 40


def test_null_gaps_and_resolution(spark):
    v = np.round(native(n=200))
    v[50:52] = np.nan
    v[100] = np.nan
    v[120:160] = np.nan
    r = sg.null_gaps(grid(spark, v), 5).first()
    assert (r.n_gaps, r.len_1, r.len_to_period, r.len_to_30, r.len_over_30, r.longest) == (3, 1, 1, 0, 1, 40)
    assert sg.resolution(grid(spark, v)).first().q == 1.0


def test_step_hold_is_not_called_linear(spark):
    v = np.repeat(100 + np.cumsum(np.random.default_rng(3).normal(0, 4, 300)), 5)
    d = sg.differences(grid(spark, v))
    test, first = sg.permutation_test(sg.clipped(d), [5]), sg.permutation_test(sg.clipped(d, "d1"), [5])
    valid = d.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n_valid"))
    stab = sg.phase_stability(sg.block_phases(d, 5, 300), test, 5)
    out = sg.verdicts(test, first, stab, sg.knots(d, test, sg.resolution(grid(spark, v)), 5), valid, 5)
    assert out.first().verdict == "periodic_but_step_hold_like_not_linear"


def test_nearest_prefers_the_later_of_two_equal(spark):
    rows = [("p", 0, T0, None, "Lunch"), ("p", 1, T0 - MINUTE, 1.0, None), ("p", 2, T0 + MINUTE, 2.0, None)]
    df = spark.createDataFrame(rows, "participant_id string, row_order long, us long, v double, anchor_label string")
    assert au.nearest_probe(df, "v", MINUTE, MINUTE, offsets=(0,)).first().v == 2.0


def test_photo_pairing(spark):
    rows = [("p", 0, 0, None, True), ("p", 1, 10, "Lunch", True), ("p", 2, 10, None, True), ("p", 3, 25, None, True), ("p", 4, 30, None, True), ("p", 5, 60, "lunch ", False), ("p", 6, 90, "Dinner", False), ("p", 7, 95, None, True)]
    df = spark.createDataFrame([(a, b, T0 + c * MINUTE, d, e) for a, b, c, d, e in rows], "participant_id string, row_order long, us long, anchor_label string, is_photo boolean").withColumn("is_anchor", F.col("anchor_label").isNotNull())
    got = {r.anchor_row: r for r in au.pairing_classes(df, MINUTE).collect()}
    assert [(got[k].n_candidates, got[k]["class"]) for k in (1, 5, 6)] == [(2, "multiple"), (0, "none"), (1, "single")]
    assert got[1].first_offset == 15 and got[1].next_same_label and got[1].own_photo and not got[5].next_same_label and not got[6].has_next
    assert {r.us: r.offset for r in au.photo_pairs(df, MINUTE).collect()}[T0] is None


def test_rare_tokens_are_suppressed(spark):
    rows = [(f"p{i}", f"dir\\Before_{i}.jpg", "anchor") for i in range(5)] + [("p1", "anna.jpg", "other")]
    got = {r.token: r for r in au.token_report(spark.createDataFrame(rows, "participant_id string, name string, role string")).collect()}
    assert set(got) == {"before", "(suppressed tokens)"} and got["(suppressed tokens)"].on_anchor_rows == 1 and got["before"].n_participants == 5


def test_groups_are_linked_by_identifier_or_refused(spark):
    bio = spark.createDataFrame([("S-002", 9, "6.4 (high)"), ("S-001", 8, "5.6")], "subject string, other long, a1c string")
    people = spark.createDataFrame([("x-1",), ("x-2",)], "participant_id string")
    assert {r.participant_id: r.grp for r in au.checked_groups(bio, people, "a1c").collect()} == {"x-1": "healthy", "x-2": "pre-diabetes"}
    with pytest.raises(ValueError):
        au.checked_groups(bio.withColumnRenamed("subject", "name"), people, "a1c")
    with pytest.raises(ValueError):
        au.checked_groups(bio.withColumn("a1c", F.lit("n/a")), people, "a1c")


def test_scalar_text_rules(spark):
    vals = [(" Snack  2 ",), ("SNACKS",), ("dinner",), ("snack bar",), (None,)]
    assert [r[0] for r in spark.createDataFrame(vals, "s string").select(lb.normalize_meal_type("s")).collect()] == ["snack", "snack", "dinner", "unrecognized", None]
    ids = [("3.0",), ("3",), ("03",), ("0.00",), (" P1 ",), ("p1",)]
    assert [r[0] for r in spark.createDataFrame(ids, "s string").select(lb.canonical_id("s")).collect()] == ["3", "3", "03", "0", "P1", "p1"]
    a = spark.createDataFrame([("5.4 (low)",), ("5.4",), ("<5",), ("6",)], "s string").select(lb.parse_numeric("s"), lb.is_annotated("s")).collect()
    assert [tuple(r) for r in a] == [(5.4, True), (5.4, False), (None, False), (6.0, False)]
    p = spark.createDataFrame([("subject-12\\S12.csv",), ("a/participant_3.parquet",), ("p01/p01/x.txt",)], "s string").select(lb.redact_path("s")).collect()
    assert [r[0] for r in p] == ["<participant_id>/<participant_file>.csv", "a/<participant_file>.parquet", "<participant_id>/<participant_id>/x.txt"]


def test_registered_scan_finds_long_periods(spark, monkeypatch):
    from anchorline.plans import audit_queries
    monkeypatch.setattr(audit_queries, "diff", lambda spark, sf: sg.differences(grid(spark, native(15, n=3000))))
    assert audit_queries.period_scan(spark, None).first().fundamental_period == 15


def test_registered_verdict_needs_twenty_points_a_period(spark, monkeypatch):
    from anchorline.plans import audit_queries
    short = grid(spark, native(n=80))
    monkeypatch.setattr(audit_queries, "grid", lambda spark, sf: short)
    monkeypatch.setattr(audit_queries, "diff", lambda spark, sf: sg.differences(short))
    assert [tuple(r) for r in audit_queries.channel_verdicts(spark, None).collect()] == [("insufficient_data", 1)]
