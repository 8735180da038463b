import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.functions.numeric import phi
from anchorline.operators import bootstrap as bo
from anchorline.operators import channels as ch
from anchorline.operators import compare as cp
from anchorline.operators import evaluation as ev


def scored(spark, p, y):
    return spark.createDataFrame([(f"e{i}", f"p{i % 5}", float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "event_id string, participant_id string, p double, y int")


def auc(p, y):
    pos, neg = [a for a, b in zip(p, y, strict=True) if b], [a for a, b in zip(p, y, strict=True) if not b]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def ap(p, y):
    p, y = np.array(p), np.array(y)
    out, prev = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        rec = (y[hit]).sum() / y.sum()
        out += (rec - prev) * y[hit].mean()
        prev = rec
    return out


def test_discrimination_against_pairs_with_ties(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.beta(0.5, 0.7, 300), 2)
    y = (rng.random(300) < p).astype(int)
    r = ev.discrimination(scored(spark, p, y), []).first()
    assert r.roc_auc == pytest.approx(auc(p, y)) and r.average_precision == pytest.approx(ap(p, y))


def test_discrimination_needs_two_of_each_class(spark):
    s = scored(spark, [0.1, 0.5, 0.9], [0, 0, 1])
    assert ev.discrimination(s, []).first().roc_auc is None
    assert ev.discrimination(s, [], min_class=1).first().roc_auc == 1.0


def test_bins_are_right_closed_and_empty_bins_kept(spark):
    s = scored(spark, [0.0, 0.1, 0.1000001, 1.0], [0, 1, 1, 1])
    rows = {r.bin: r.n for r in ev.reliability(s).collect()}
    assert rows[0] == 2 and rows[1] == 1 and rows[9] == 1 and sum(v == 0 for v in rows.values()) == 7


def test_ece_and_losses(spark):
    s = scored(spark, [0.05, 0.95, 0.0], [0, 1, 1])
    assert ev.ece(s, []).first().ece10 == pytest.approx((2 / 3) * abs(0.025 - 0.5) + (1 / 3) * 0.05)
    assert ev.losses(s, []).first().log_loss == pytest.approx(-(2 * np.log(0.95) + np.log(1e-6)) / 3)


def test_confusion_undefined_reason_and_inclusive_threshold(spark):
    r = ev.confusion(scored(spark, [0.5, 0.4], [1, 1]), []).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (1, 1, 0, 0) and r.specificity is None and "no negative events" in r.undefined


def test_phi(spark):
    from math import erfc, sqrt
    z = [-40, -8, -3, -1.5, -1e-9, 0.0, 0.3, 2.2, 7.5, 39]
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in z], "z double").select(phi("z")).collect()]
    assert got == pytest.approx([0.5 * erfc(-x / sqrt(2)) for x in z], abs=2e-16, rel=1e-9)


def poisson_count(r, pid, seed):
    """Inverse of the Poisson(1) distribution function at the mixed number of (replicate, participant)."""
    import hashlib
    from math import exp, factorial
    M = 2147483647
    h = int(hashlib.md5(pid.encode()).hexdigest()[:15], 16)
    a, b = h % M, h // M
    x = (a + r * 1000003 + seed * 40692 + 12345) % M
    x = (x * 48271 + b) % M
    x = (x * x % M + r * 271) % M
    x = (x * 69621 + a) % M
    x = (x * x % M + b * 131) % M
    u = x * 16807 % M
    return sum(u >= int(M * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(12))


def test_counts_are_poisson_and_independent_over_participants():
    w = np.array([[poisson_count(r, f"p{i}", 0) for i in range(60)] for r in range(400)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04
    c = np.corrcoef(w.T) - np.eye(60)
    assert np.abs(c).max() < 0.25 and abs(c.mean()) < 0.005


def test_ratio_bootstrap_is_the_ratio_of_drawn_sums(spark):
    ids = [f"p{i}" for i in range(9)]
    num = {p: float(i * i - 20) for i, p in enumerate(ids)}
    den = {p: float(1 + i % 3) for i, p in enumerate(ids)}
    boots = []
    for r in range(100):
        w = {p: poisson_count(r, p, 5) for p in ids}
        boots.append(sum(w[p] * num[p] for p in ids) / sum(w[p] * den[p] for p in ids))
    df = spark.createDataFrame([(p, num[p], den[p]) for p in ids], "participant_id string, x double, n double")
    r = bo.ratio_bootstrap(df, [], ["x"], n_boot=100, seed=5).first()
    assert r.estimate == pytest.approx(sum(num.values()) / sum(den.values()))
    assert [r.ci_low, r.ci_high] == pytest.approx(list(np.quantile(boots, [0.025, 0.975])))


def test_rank_bootstrap_counts_one_class_draws_and_pairs_arms(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        y = int(i % 5 == 0)
        rows += [("A", f"p{i % 5}", float(rng.random()), y), ("B", f"p{i % 5}", float(0.5 * y + 0.4 * rng.random()), y)]
    r = {(x.contrast, x.metric): x for x in bo.rank_metric_bootstrap(spark.createDataFrame(rows, "arm string, participant_id string, p double, y int"), ["A", "B"], n_boot=40).collect()}
    x = r["B_minus_A", "roc_auc"]
    assert x.n_draws_used + x.n_draws_skipped == 40 and x.n_draws_skipped > 0 and x.ci_low > 0


def forecasts(spark, n=40, shift=0.0):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        p, m, y = float(rng.random()), float(rng.normal(40, 10)), int(rng.random() < 0.5)
        rows.append((f"e{i}", f"p{i % 8}", i % 8 % 4, y, 40.0 + i, float(i % 7), i, "g", p * 0.9 + shift, m, m - 10, m + 10, p * 0.5, m, i // 8))
    return spark.createDataFrame(rows, "event_id string, participant_id string, fold int, y int, rise double, activity double, us long, grp string, p double, mean_rise double, interval90_low double, interval90_high double, p_frozen_prior double, mean_rise_frozen_prior double, n_personal_before long")


@pytest.mark.parametrize("change, field", [
    (("y", "1 - y"), "label_mismatch"), (("fold", "fold + 4"), "fold_mismatch"), (("rise", "rise + 1"), "rise_mismatch"),
    (("participant_id", "concat(participant_id, 'x')"), "participant_mismatch"), (("event_id", "concat(event_id, 'x')"), "only_left")])
def test_unmatched_tables_are_refused(spark, change, field):
    b = forecasts(spark)
    c = b.withColumn(change[0], F.when(F.col("event_id") == "e3", F.expr(change[1])).otherwise(F.col(change[0])))
    p = cp.match_problems(b, c)
    assert p.first()[field] == 1
    with pytest.raises(ValueError):
        cp.require_matched(p)
    cp.require_matched(cp.match_problems(b, b, counts=True))


@pytest.mark.parametrize("column, value, field", [
    ("p", "1.5", "bad_probability"), ("p", "double('nan')", "non_finite"), ("y", "2", "bad_label"), ("interval90_low", "1e9", "bad_interval"),
    ("fold", "-1", "bad_fold"), ("event_id", "'e4'", "duplicate_events"), ("fold", "3", "participants_in_several_folds")])
def test_single_table_faults(spark, column, value, field):
    f = forecasts(spark)
    bad = f.withColumn(column, F.when(F.col("event_id") == "e8", F.expr(value)).otherwise(F.col(column)))
    assert cp.forecast_problems(bad).first()[field] >= 1
    assert all(v == 0 for k, v in cp.forecast_problems(f).first().asDict().items() if k != "n_events")


def test_strata_tertiles_stages(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)]
    df = spark.createDataFrame(rows, "participant_id string, activity double")
    got = sorted((r.participant_id, r.activity, r.stratum) for r in cp.within_participant_strata(df).collect())
    assert [g[2] for g in got if g[0] == "a"] == ["sedentary", "sedentary", "sedentary", "active", "active"]
    assert {g[2] for g in got if g[0] == "b"} == {"excluded"}
    t = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3)], "activity double")
    assert {r.activity: r.tertile for r in cp.tertiles(t).collect()} == {0.0: "low", 1.0: "middle", 2.0: "high", 3.0: "high"}
    s = spark.createDataFrame([(n,) for n in (0, 2, 4, 9, 10, 25)], "n_personal_before_b int")
    assert [r[0] for r in s.select(cp.stage_of()).collect()] == ["0", "1-4", "1-4", "5-9", "10-19", "20+"]
    assert [r[0] for r in s.select(cp.experience()).collect()] == ["cold_start", "cold_start", "neither", "neither", "experienced", "experienced"]


def test_spearman_with_ties_and_constant_side(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 6, 80).astype(float), rng.normal(size=80)
    import pandas as pd
    s = ch.correlation(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a double, b double"), "a", "b").first()
    assert s.pearson == pytest.approx(np.corrcoef(a, b)[0, 1]) and s.spearman == pytest.approx(np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1])
    assert ch.correlation(spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double"), "a", "b").first().pearson is None


@pytest.mark.parametrize("name, least", [("rank_bootstrap", 2000), ("prior_adoption_screen", 2000), ("three_model_comparison", 1000)])
def test_registered_rank_intervals_take_all_replicates(spark, monkeypatch, name, least):
    from anchorline.operators import bootstrap
    from anchorline.plans import eval_queries, extra_queries

    class Asked(Exception):
        pass

    def asked(scored, arms, n_boot=200, **more):
        raise Asked(n_boot)

    monkeypatch.setattr(bootstrap, "rank_metric_bootstrap", asked)
    monkeypatch.setattr(extra_queries, "TREES", 1)
    with pytest.raises(Asked) as got:
        getattr(extra_queries if name == "three_model_comparison" else eval_queries, name)(spark, "/root/testdata/sf0.001")
    assert got.value.args[0] >= least


def _draws(ids, n_boot, seed):
    import hashlib
    m = bo._M
    out = {}
    for i in ids:
        h = int(hashlib.md5(i.encode()).hexdigest()[:15], 16)
        a, b, counts = h % m, h // m, []
        for r in range(n_boot):
            x = (a + r * 1000003 + seed * 40692 + 12345) % m
            x = (x * 48271 + b) % m
            x = (x * x % m + r * 271) % m
            x = (x * 69621 + a) % m
            x = (x * x % m + b * 131) % m
            counts.append(sum(x * 16807 % m >= limit for limit in bo._LIMITS))
        out[i] = counts
    return out


def test_rank_metrics_of_every_replicate_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bo, "SLICE_CELLS", 8)
    rng = np.random.default_rng(7)
    rows = [("A", f"p{i % 4}", float(p), int(rng.random() < 0.1 + 0.6 * p)) for i, p in enumerate(rng.random(90).round(2))]
    rows += [("A", f"q{i}", 0.3, int(i % 3 == 0)) for i in range(60)]  # one score for many: a slice of its own
    rows += [("B", who, float(rng.integers(0, 11) / 10), y) for _, who, _, y in rows]
    n_boot, seed = 30, 3
    got = {(r["arm"], r["__r"]): r for r in bo.rank_metrics_by_replicate(spark.createDataFrame(rows, "arm string, participant_id string, p double, y int"), n_boot, seed).collect()}
    assert len(got) == 2 * n_boot
    w = _draws({r[1] for r in rows}, n_boot, seed)
    for arm in "AB":
        for b in range(n_boot):
            e = [(p, y) for a, who, p, y in rows if a == arm for _ in range(w[who][b])]
            p, y = (np.array(x, float) for x in zip(*e))
            pos, neg = p[y == 1], p[y == 0]
            auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
            ap = np.mean([(y[p >= t] == 1).mean() for t in pos])
            ece = [sum(abs((p[k] - y[k]).sum()) for k in [np.searchsorted([i * (1 / n) for i in range(1, n)], p, "left") == j for j in range(n)]) / len(p) for n in (10, 5)]
            r = got[arm, b]
            assert [r["roc_auc"], r["average_precision"], r["brier"], r["ece10"], r["ece5"]] == pytest.approx([auc, ap, ((p - y) ** 2).mean(), *ece])


def test_replicates_without_anyone_are_counted(spark):
    rows = [("A", "p1", 0.2, 0), ("A", "p1", 0.7, 1), ("A", "p2", 0.4, 1)]
    r = bo.rank_metric_bootstrap(spark.createDataFrame(rows, "arm string, participant_id string, p double, y int"), ["A"], n_boot=50).first()
    drawn = [sum(c) for c in zip(*_draws(["p1"], 50, 0).values())]
    assert r.n_draws_used == sum(c > 0 for c in drawn) and r.n_draws_used + r.n_draws_skipped == 50


def test_fixed_comparisons_against_paired_means(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        y, active = int(rng.random() < 0.4), bool(i % 3)
        for m in ("B", "C", "A"):
            if m == "A" and i % 2:
                continue
            rows.append((f"p{i % 7}", f"e{i}", m, float(rng.random()), float(rng.normal()), y, 1.0, active))
    df = spark.createDataFrame(rows, "participant_id string, event_id string, model string, p double, mean_rise double, y int, rise double, is_active boolean")
    listed = [("C", "B", "brier", "active"), ("C", "B", "mae_rise", "all"), ("B", "A", "log_loss", "sedentary"), ("C", "gone", "brier", "all")]
    got = {(r.model_a, r.model_b, r.metric, r.subset): r for r in cp.experiment_comparisons(df, listed, n_boot=50).collect()}
    assert len(got) == 3
    at = {(r[1], r[2]): r for r in rows}
    loss = {"brier": lambda r: (r[3] - r[5]) ** 2, "mae_rise": lambda r: abs(r[4] - r[6]), "log_loss": lambda r: -np.log(r[3] if r[5] else 1 - r[3])}
    for (a, b, metric, subset), r in got.items():
        both = [(at[e, a], at[e, b]) for e in {x[1] for x in rows} if (e, a) in at and (e, b) in at and (subset == "all" or at[e, a][7] == (subset == "active"))]
        assert r.n_events == len(both) and r.estimate == pytest.approx(np.mean([loss[metric](x) - loss[metric](z) for x, z in both]))
        assert r.ci_low <= r.estimate <= r.ci_high and r.reading.startswith("negative" if r.estimate < 0 else "positive")
    none = cp.experiment_comparisons(df.where("model <> 'A' OR is_active"), [("B", "A", "brier", "sedentary")], n_boot=5).first()
    assert none.n_events == 0 and none.estimate is None


def test_calibration_line_is_the_likelihood_fit(spark):
    rng = np.random.default_rng(10)
    z = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 0.7 * z)))).astype(int)
    p = 1 / (1 + np.exp(-z))
    r = ev.calibration_line(spark.createDataFrame(list(zip(p.tolist(), y.tolist())), "p double, y int")).first()
    f = 1 / (1 + np.exp(-(r.intercept + r.slope * z)))
    assert abs((y - f).sum()) < 1e-6 and abs(((y - f) * z).sum()) < 1e-6
    for bad in ([(0.2, 0), (0.8, 1), (0.3, 0)], [(0.5, 0), (0.5, 1)], [(0.1, 1), (0.9, 1)]):
        r = ev.calibration_line(spark.createDataFrame(bad, "p double, y int")).first()
        assert r.slope is None and r.reason


def test_draws_follow_the_rule_and_hold_little_beside_their_result():
    import tracemalloc

    import numpy as np

    from anchorline.operators import bootstrap
    m = 2**31 - 1
    h = np.random.default_rng(0).integers(0, 2**60, 256)
    h[:4] = [0, 2**60 - 1, m, m * (m // 5)]
    for n_boot, seed in ((2000, 0), (7, 5)):
        a, b, r = (h % m)[:, None], (h // m)[:, None], np.arange(n_boot)
        x = ((a + r * 1000003 + seed * 40692 + 12345) % m * 48271 + b) % m
        x = ((x * x % m + r * 271) % m * 69621 + a) % m
        u = (x * x % m + b * 131) % m * 16807 % m
        assert (bootstrap.draw_counts(h, n_boot, seed) == (u[..., None] >= np.array(bootstrap._LIMITS)).sum(-1)).all()
    tracemalloc.start()
    size = bootstrap.draw_counts(h, 2000, 0).nbytes
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * size  # whole tables of intermediate numbers do not fit a core's cache


def test_draws_are_the_plain_rule_with_fewer_remainders():
    import numpy as np

    from anchorline.operators import bootstrap as bo
    m, n, seed = 2**31 - 1, 40, 123
    h = [0, 1, m - 1, m, m + 1, 2**60 - 1, 2**60 - m, *np.random.default_rng(5).integers(0, 2**60, 60).tolist()]

    def plain(h, r):
        p, q = h % m, h // m
        x = ((p + (r * 1000003 + seed * 40692 + 12345) % m) * 48271 + q) % m
        x = (x * x % m + r * 271) * 69621 + p
        x = (x % m) ** 2 % m + q * 131
        return sum(x * 16807 % m >= limit for limit in bo._LIMITS)
    assert bo.draw_counts(np.array(h), n, seed).tolist() == [[plain(x, r) for r in range(n)] for x in h]


def test_experiment_stores_and_shuffles_no_row_per_event_and_forecaster(spark, monkeypatch):
    """The long records of seven forecasters, stored and then shuffled by event, filled the disk on large tables."""
    from anchorline.operators import boosted, leave_one_out
    from anchorline.plans import loo_queries
    fit, stored = boosted.fit, {}
    monkeypatch.setattr(boosted, "fit", lambda train, trees=1: fit(train, 1))

    def counted(real):
        def put(df, label):
            out = real(df, label)
            stored[label] = max(stored.get(label, 0), out.count())
            return out
        return put

    for m in (loo_queries, leave_one_out, boosted, cp):
        monkeypatch.setattr(m, "stage", counted(m.stage))
    got = loo_queries.experiment_comparisons(spark, "/root/testdata/sf0.001")
    assert got.count() == 15 and got.where("n_events > 0").count() == 15
    assert max(n for label, n in stored.items() if label != "comparisons") == stored["folded-events"]


def test_forecasts_side_by_side_are_the_long_records(spark):
    from anchorline.operators import leave_one_out as lo
    from helpers import COHORT, cohort_rows
    e = spark.createDataFrame(cohort_rows(8, 6), COHORT).withColumn("mark", F.col("us") % 7)
    long = {(r.event_id, r.model): r for r in lo.prequential(e).collect()}
    wide = lo.side_by_side(e, carry=("mark",)).collect()
    assert len(wide) * 8 == len(long) and all(r.mark is not None for r in wide)
    for r in wide:
        for m in ("frozen_B", "frozen_C", "B", "C", "B_shuffled", "C_perm_activity", "personal_rate", "population_constant"):
            o = long[r.event_id, m]
            assert (r.y, r.rise, r.is_active, r[f"{m}_p"], r[f"{m}_mean_rise"]) == (o.y, o.rise, o.is_active, pytest.approx(o.p), pytest.approx(o.mean_rise))


@pytest.mark.parametrize("decimals", [9, 2])
def test_weighing_a_slice_passes_over_the_counts_few_times(monkeypatch, decimals):
    """Sums of a slice against the plain formula, and the counts of a cell are only multiplied as a matrix, not once for every sum."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    n, draws = 200, 40
    p, y = np.round(rng.random(n), decimals), (rng.random(n) < 0.4).astype(float)
    h = rng.integers(0, 1 << 60, n)
    above = {c: rng.integers(0, 50, draws).astype(float) for c in ("above_pos", "above_neg")} | {"all_neg": np.full(draws, 400.0)}
    stacked = []
    stack = np.stack
    monkeypatch.setattr(np, "stack", lambda parts, *a, **k: stacked.append(np.ndim(parts[0])) or stack(parts, *a, **k))
    got = bo._weigh((pa.scalar("B"), pa.scalar(2)), pa.table({"p": p, "h": h, "pos": y, "neg": 1 - y}), pa.table({"r": np.arange(draws), **above}), draws, 0).to_pandas()
    assert max(stacked) == 1  # no table of cells by replicates for each of the six sums
    w = bo.draw_counts(h, draws, 0)
    hit, miss = y[:, None] * w, (1 - y)[:, None] * w
    upto = lambda x: np.array([x[p >= v].sum(0) for v in p])
    same = np.array([miss[p == v].sum(0) for v in p])
    up, un = above["above_pos"] + upto(hit), above["above_neg"] + upto(miss)
    want = {"pos": hit, "neg": miss, "sp": p[:, None] * w, "u": hit * (400 - un + same / 2), "s": hit * up / np.maximum(up + un, 1), "q": hit * (1 - p[:, None]) ** 2 + miss * p[:, None] ** 2}
    for name, x in want.items():
        assert got.groupby("r")[name].sum().to_numpy() == pytest.approx(x.sum(0))


def test_a_draw_of_the_modulus_counts_as_zero(monkeypatch):
    h = np.random.default_rng(6).integers(0, 1 << 60, 64)
    h[:4] = [0, (1 << 60) - 1, bo._M, bo._M - 1]
    for seed in (0, 3):
        x = [(int(v) % bo._M + r * 1000003 + seed * 40692 + 12345) % bo._M for v in h for r in range(5)]
        q = [int(v) // bo._M for v in h for _ in range(5)]
        pp = [int(v) % bo._M for v in h for _ in range(5)]
        out = []
        for i, (a, b, c) in enumerate(zip(x, q, pp)):
            a = (a * 48271 + b) % bo._M
            a = (a * a % bo._M + (i % 5) * 271) % bo._M
            a = (a * 69621 + c) % bo._M
            a = (a * a % bo._M + b * 131) % bo._M
            a = a * 16807 % bo._M
            out.append(sum(a >= limit for limit in bo._LIMITS))
        assert bo.draw_counts(h, 5, seed).ravel().tolist() == out
