import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.operators import folds as fo
from anchorline.operators import leave_one_out as lo
from anchorline.operators import priors as pr
from anchorline.operators import sequential as sq
from anchorline.session import stage
from anchorline.spec import OUTCOME_WINDOW
from helpers import COHORT, cohort_rows

ROWS = cohort_rows()


@pytest.fixture(scope="module")
def events(spark):
    return stage(spark.createDataFrame(ROWS, COHORT), "test-events")


def design(rows, k):
    c, a = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    return c[:, None] if k == 1 else np.c_[c, c * a]


def scale_aware(train):
    """Plain numpy form of the effect-space prior."""
    X, y = design(train, 2), np.array([r[6] for r in train])
    mu = np.linalg.lstsq(X, y, rcond=None)[0]
    D = np.diag(np.sqrt((X ** 2).mean(0)))
    betas, rss, df, inv = [], 0.0, 0, []
    for p in sorted({r[0] for r in train}):
        g = [r for r in train if r[0] == p]
        x, z = design(g, 2), np.array([r[6] for r in g])
        b = np.linalg.lstsq(x, z, rcond=None)[0]
        betas.append(b)
        rss += float(((z - x @ b) ** 2).sum())
        df += len(g) - 2
        inv.append(np.linalg.inv(x.T @ x))
    s2 = rss / df
    spread = np.cov(np.array(betas), rowvar=False)
    raw = spread - s2 * np.mean(inv, axis=0)
    vals, vecs = np.linalg.eigh(D @ ((raw + raw.T) / 2) @ D)
    floor = max(1e-3 * np.trace(D @ spread @ D) / 2, 1e-12)
    Di = np.linalg.inv(D)
    return mu, Di @ (vecs * np.clip(vals, floor, None)) @ vecs.T @ Di, s2


def loop(rows, mu, V, s2, k):
    """Forecast, then learn what has closed, one meal at a time."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    P, m, pending, out = np.linalg.inv(V), mu, [], {}
    for r in rows:
        for q in [q for q in pending if q[2] + OUTCOME_WINDOW <= r[2]]:
            x = design([q], k)[0]
            Pn = P + np.outer(x, x) / s2
            m = np.linalg.solve(Pn, P @ m + x * q[6] / s2)
            P = Pn
            pending.remove(q)
        x = design([r], k)[0]
        out[r[1]] = (float(x @ m), float(np.sqrt(s2 + x @ np.linalg.inv(P) @ x)))
        pending.append(r)
    return out


def test_folds_are_stratified_and_complete(spark):
    people = spark.createDataFrame([(f"p{i}", "AB"[i % 2]) for i in range(43)], "participant_id string, grp string")
    f = fo.checked_folds(people).collect()
    assert len(f) == 43
    sizes = np.bincount([r.fold for r in f], minlength=5)
    assert sizes.max() - sizes.min() <= 1
    for g in "AB":
        s = np.bincount([r.fold for r in f if r.grp == g], minlength=5)
        assert s.max() - s.min() <= 1
    assert fo.participant_folds(people, seed=1).exceptAll(fo.participant_folds(people)).count() > 0
    with pytest.raises(ValueError):
        fo.checked_folds(people.where("participant_id in ('p1','p2')"))


def test_prior_c_matches_numpy_and_sequential_equals_loop(spark, events):
    folds = stage(fo.participant_folds(events, k=3), "test-folds")
    prior = pr.fold_priors(events, folds, "C", k=3)
    fold_of = {r.participant_id: r.fold for r in folds.collect()}
    want = {k: scale_aware([r for r in ROWS if fold_of[r[0]] != k]) for k in range(3)}
    for r in prior.collect():
        mu, V, s2 = want[r.fold]
        assert [r.m_b, r.m_g] == pytest.approx(list(mu)) and [r.v_bb, r.v_bg, r.v_gg, r.noise] == pytest.approx([V[0, 0], V[0, 1], V[1, 1], s2])
    learned = sq.learned_before(events, slice_us=86_400_000_000).join(folds.select("participant_id", "fold"), "participant_id")
    got = {r.event_id: r for r in sq.forecasts(learned, prior, "C", ["fold"]).collect()}
    assert len(got) == len(ROWS)
    for p in sorted({r[0] for r in ROWS}):
        ref = loop([r for r in ROWS if r[0] == p], *want[fold_of[p]], 2)
        for e, (m, s) in ref.items():
            assert got[e].mean_rise == pytest.approx(m, rel=1e-9) and got[e].pred_std == pytest.approx(s, rel=1e-9)


def test_learning_rule_is_inclusive_and_equal_times_do_not_teach(spark):
    w = OUTCOME_WINDOW
    base = [("p", f"e{i}", t, 50.0, 2.0, 100.0, 40.0, 0, "A") for i, t in enumerate((0, w - 1, w, w, 2 * w))]
    got = {r.event_id: int(r.n_learned) for r in sq.learned_before(spark.createDataFrame(base, COHORT)).collect()}
    assert got == {"e0": 0, "e1": 0, "e2": 1, "e3": 1, "e4": 4}


def test_prior_is_invariant_to_activity_units(spark, events):
    folds = fo.participant_folds(events, k=3)
    a = {r.fold: r for r in pr.fold_priors(events, folds, "C", k=3).collect()}
    b = {r.fold: r for r in pr.fold_priors(events.withColumn("activity_level", F.col("activity_level") * 1000), folds, "C", k=3).collect()}
    for k, r in a.items():
        assert b[k].m_g * 1000 == pytest.approx(r.m_g, rel=1e-6) and b[k].v_gg * 1e6 == pytest.approx(r.v_gg, rel=1e-6) and b[k].v_bb == pytest.approx(r.v_bb, rel=1e-6)


def test_diffuse_prior_below_five_participants(spark, events):
    few = events.where(F.col("participant_id").isin("p00", "p01", "p02"))
    r = pr.prior_b(pr.population_pool(few)).first()
    assert r.source == "diffuse_fallback" and r.v_bb == 1e4
    with pytest.raises(ValueError):
        pr.validate_options("B", "stratified", 0.5)
    with pytest.raises(ValueError):
        pr.validate_options("C", "stratified", 0.3)


def test_stratified_prior_falls_back_to_the_pool(spark, events):
    folds = stage(fo.participant_folds(events, k=3), "test-folds")
    rows = pr.fold_priors(events, folds, "C", "stratified", k=3).collect()
    assert len(rows) == 9 and all("pooled_fallback" in r.source and r.m_g == 0 and r.v_bg == 0 for r in rows)  # fewer than five per group


def test_trajectory_versions_shrink_and_end_at_the_batch_posterior(spark, events):
    folds = stage(fo.participant_folds(events, k=3), "test-folds")
    prior = stage(pr.fold_priors(events, folds, "C", k=3), "test-priors")
    t = sq.trajectory(events.join(folds.select("participant_id", "fold"), "participant_id"), prior, "C", ["fold"])
    rows = [r for r in t.orderBy("participant_id", "version").collect() if r.participant_id == "p03"]
    assert [r.version for r in rows] == list(range(11))
    assert all(b.beta_sd <= a.beta_sd + 1e-12 and b.gamma_sd <= a.gamma_sd + 1e-12 for a, b in zip(rows, rows[1:], strict=False))
    last = sq.with_posterior(pr.sufficient(events, ["participant_id"]).join(folds, "participant_id").join(prior, "fold"), "C").where("participant_id = 'p03'").first()
    assert rows[-1].beta_mean == pytest.approx(last.post_b) and rows[-1].gamma_mean == pytest.approx(last.post_g)


def loo_prior(train, k):
    """Plain numpy form of the intercept prior: design [1, c] or [1, c, c(a - mean a)]."""
    a0 = np.mean([r[4] for r in train])

    def X(g):
        c, a = np.array([r[3] for r in g]), np.array([r[4] for r in g])
        return np.c_[np.ones_like(c), c] if k == 2 else np.c_[np.ones_like(c), c, c * (a - a0)]
    y = np.array([r[6] for r in train])
    mu = np.linalg.lstsq(X(train), y, rcond=None)[0]
    betas, rss, df, inv = [], 0.0, 0, []
    for p in sorted({r[0] for r in train}):
        g = [r for r in train if r[0] == p]
        x, z = X(g), np.array([r[6] for r in g])
        b = np.linalg.lstsq(x, z, rcond=None)[0]
        betas.append(b)
        rss += float(((z - x @ b) ** 2).sum())
        df += len(g) - k
        inv.append(np.linalg.inv(x.T @ x))
    s2 = rss / df
    spread = np.cov(np.array(betas), rowvar=False)
    d = spread - s2 * np.mean(inv, axis=0)
    vals, vecs = np.linalg.eigh((d + d.T) / 2)
    V = (vecs * np.clip(vals, max(1e-3 * np.trace(spread) / k, 1e-9), None)) @ vecs.T
    return X, mu, V, s2


def test_leave_one_out_matches_refits(spark, events):
    got = {(r.event_id, r.model): r for r in lo.prequential(events).collect()}
    assert len(got) == 8 * len(ROWS)
    for p in ("p00", "p05", "p11"):
        own, others = sorted([r for r in ROWS if r[0] == p], key=lambda r: r[2]), [r for r in ROWS if r[0] != p]
        cut = np.median([r[4] for r in others])
        for k, frozen, live in ((2, "frozen_B", "B"), (3, "frozen_C", "C")):
            X, mu, V, s2 = loo_prior(others, k)
            for i, r in enumerate(own):
                x = X([r])[0]
                assert got[r[1], frozen].mean_rise == pytest.approx(float(x @ mu), rel=1e-6)
                assert got[r[1], frozen].pred_std == pytest.approx(float(np.sqrt(s2 + x @ V @ x)), rel=1e-6)
                P, h = np.linalg.inv(V), np.linalg.inv(V) @ mu
                for q in own[:i]:
                    z = X([q])[0]
                    P, h = P + np.outer(z, z) / s2, h + z * q[6] / s2
                assert got[r[1], live].mean_rise == pytest.approx(float(x @ np.linalg.solve(P, h)), rel=1e-6)
                assert got[r[1], live].is_active == (r[4] >= cut) and got[r[1], live].n_personal_before == i
    assert any(abs(got[e, "C"].mean_rise - got[e, "C_perm_activity"].mean_rise) > 1e-6 for e, m in got if m == "C")


def test_controls_permute_and_swap(spark, events):
    perm = lo.permuted_activity(events).collect()
    own = {r[1]: r for r in ROWS}
    for p in {r[0] for r in ROWS}:
        assert sorted(r.activity_level for r in perm if r.participant_id == p) == pytest.approx(sorted(r[4] for r in ROWS if r[0] == p))
    donors = lo.shuffled_lessons(events).collect()
    assert len(donors) == len(ROWS) and all(d.carbs_g != own[d.event_id][3] for d in donors)


def test_chronological_split_purges_and_keeps_touching(spark):
    w = OUTCOME_WINDOW
    rows = [("p", f"e{i}", t, 1.0, 1.0, 1.0, 1.0, 0, "A") for i, t in enumerate((0, w, 2 * w - 1, 2 * w, 3 * w))] + [("q", "only", 0, 1.0, 1.0, 1.0, 1.0, 0, "A")]
    part = {r.event_id: r.part for r in fo.chronological_split(spark.createDataFrame(rows, COHORT), 0.4).collect()}
    assert part == {"e0": "train", "e1": "train", "e2": "purged", "e3": "test", "e4": "test", "only": "train"}


def test_fingerprint_ignores_order_and_sees_changes(spark, events):
    cols = ["participant_id", "event_id", "carbs_g"]
    a = fo.fingerprint(events, cols).first().fingerprint
    assert fo.fingerprint(events.orderBy(F.rand(1)), cols).first().fingerprint == a
    assert fo.fingerprint(events.withColumn("carbs_g", F.col("carbs_g") + F.when(F.col("event_id") == "p00-m000", 1e-6).otherwise(0.0)), cols).first().fingerprint != a


def test_contributions_are_shapley_values_over_the_whole_background(spark):
    import random

    from pyspark.ml.functions import vector_to_array

    from anchorline.operators import boosted
    rng = random.Random(8)
    rows = []
    for i in range(60):
        x = [None if rng.random() < 0.15 else round(rng.uniform(0, 9), 1) for _ in range(3)]
        rows.append((f"e{i}", *x, int(sum(v or 0 for v in x) + rng.gauss(0, 2) > 12)))
    df = spark.createDataFrame(rows, "event_id string, carbs_g double, baseline_glucose double, activity_level double, label_exceeds_180 int")
    model = boosted.fit(df, trees=6)
    few = df.limit(4)
    mixed = [(a[0], m, *[a[1 + i] if m >> i & 1 else b[1 + i] for i in range(3)]) for a in few.collect() for m in range(8) for b in rows]
    scored = model.transform(boosted._vector(spark.createDataFrame(mixed, "event_id string, mask int, carbs_g double, baseline_glucose double, activity_level double")))
    means = scored.withColumn("v", 2 * vector_to_array("rawPrediction")[1]).groupBy("event_id", "mask").avg("v")
    v = {(r[0], r[1]): r[2] for r in means.collect()}
    for r in boosted.contributions(model, few, df).collect():
        e = r["event_id"]
        assert r["bias"] == pytest.approx(v[e, 0]) and r["log_odds"] == pytest.approx(v[e, 7])
        for i, f in enumerate(boosted.BASELINE_FEATURES):
            b, j, k = 1 << i, *[1 << q for q in range(3) if q != i]
            want = (v[e, b] - v[e, 0]) / 3 + (v[e, b | j] - v[e, j]) / 6 + (v[e, b | k] - v[e, k]) / 6 + (v[e, 7] - v[e, j | k]) / 3
            assert r[f"contribution_{f}"] == pytest.approx(want)


def test_baseline_is_fitted_on_different_rows_with_their_number(spark, monkeypatch):
    import random

    from pyspark.ml.classification import GBTClassifier

    from anchorline.operators import boosted
    rng = random.Random(8)
    rows = [(rng.randint(0, 9) / 2, None if i % 7 == 0 else float(rng.randint(0, 9)), float(rng.randint(0, 3)), int(rng.random() < 0.4)) for i in range(80)]
    df = spark.createDataFrame(rows * 5, "carbs_g double, baseline_glucose double, activity_level double, label_exceeds_180 int")
    whole = GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.1, seed=0, maxBins=64).fit(boosted._vector(df.withColumn("label", F.col("label_exceeds_180").cast("double"))))
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data, *more: (seen.append(data.count()), fit(self, data, *more))[1])
    got = boosted.probability(boosted.fit(df, trees=4), df.distinct())
    want = {tuple(r[:4]): r.p for r in boosted.probability(whole, df.distinct()).select(*df.columns, "p").collect()}
    assert seen == [len(set(rows))] and all(r.p == pytest.approx(want[tuple(r[:4])]) for r in got.select(*df.columns, "p").collect())


def test_a_fit_goes_over_a_bounded_number_of_rows_on_the_side_of_its_splits(spark):
    from pyspark.sql import functions as F

    from anchorline.operators import boosted
    df = spark.range(5000).selectExpr("CAST(id % 3 = 0 AS INT) AS label_exceeds_180", "CAST(id * 1.37 AS DOUBLE) AS carbs_g", "CASE WHEN id % 9 > 0 THEN 100D END AS baseline_glucose", "CAST(id % 5 AS DOUBLE) AS activity_level")
    held = boosted.cells(df).toPandas()
    assert len(held) <= 2 * boosted.BINS * 2 * 5 and held.weight.sum() == 5000  # before, one row for each of the 5,000
    assert set(held.activity_level) == {0.0, 1.0, 2.0, 3.0, 4.0} and set(held.baseline_glucose.dropna()) == {100.0}
    assert held.weight[held.baseline_glucose.isna()].sum() == df.where("baseline_glucose IS NULL").count()
    levels = boosted._levels(df)[0]
    assert len(levels) < boosted.BINS and (levels[0], levels[-1]) == (0.0, 4999 * 1.37)
    split = (levels[20] + levels[21]) / 2
    assert held.weight[held.carbs_g <= split].sum() == df.where(F.col("carbs_g") <= split).count()


def test_posterior_of_two_coefficients_writes_nothing_out_twice(spark):
    names = ["v_bb", "v_bg", "v_gg", "m_b", "m_g", "noise", "cc", "cg", "gg", "cy", "gy"]
    row = (2.0, 0.3, 1.5, 1.1, -0.2, 4.0, 50.0, 70.0, 120.0, 65.0, 80.0)
    out = sq.with_posterior(spark.createDataFrame([row], ", ".join(f"{c} double" for c in names)), "C")
    assert out._jdf.queryExecution().optimizedPlan().toString().count(" / ") <= 20  # 11; 89 where every value writes out what it needs
    v = dict(zip(names, row))
    p = np.linalg.inv([[v["v_bb"], v["v_bg"]], [v["v_bg"], v["v_gg"]]])
    s = np.linalg.inv(p + np.array([[v["cc"], v["cg"]], [v["cg"], v["gg"]]]) / v["noise"])
    m = s @ (p @ [v["m_b"], v["m_g"]] + np.array([v["cy"], v["gy"]]) / v["noise"])
    r = out.first()
    assert [r.post_b, r.post_g, r.s_bb, r.s_bg, r.s_gg] == pytest.approx([*m, s[0, 0], s[0, 1], s[1, 1]])
