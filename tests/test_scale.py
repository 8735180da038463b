import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.functions import scale as sc
from anchorline.operators.signal import _shuffled_rank


def test_exact_quantiles_match_numpy_per_key_and_pooled(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in rng.normal(size=700)] + [("ties", float(v)) for v in rng.integers(0, 4, 90)] + [("one", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.05, "b": 1 / 3, "c": 0.5, "d": 0.99}
    got = {r.k: r for r in sc.exact_quantiles(df, ["k"], "v", probs, slices=16).collect()}
    for k in ("hot", "ties", "one"):
        x = [v for kk, v in rows if kk == k]
        for n, q in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(x, q), abs=1e-12)
    r = sc.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert r.m == pytest.approx(np.median([v for _, v in rows]))


def test_prefix_sums_and_totals(spark):
    rng = np.random.default_rng(1)
    rows = [("k", int(t), float(t % 7)) for t in rng.permutation(200)]
    df = spark.createDataFrame(rows, "k string, t long, v double").withColumn("s", F.floor(F.col("t") / 13))
    got = sc.prefix_sums(df, ["k"], "s", ["t"], {"c": "v"}, totals=True).orderBy("t").collect()
    want = np.cumsum([t % 7 for t in range(200)])
    assert [r.c for r in got] == pytest.approx(list(want)) and {r.c_total for r in got} == {want[-1]}
    excl = sc.prefix_sums(df, [], "s", ["t"], {"c": "v"}, inclusive=False).orderBy("t").collect()
    assert [r.c for r in excl] == pytest.approx([0, *want[:-1]])


def test_dense_ids_are_a_bijection(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    r = sc.dense_ids(df, "id", "i", "n").agg(F.min("i"), F.max("i"), F.count_distinct("i"), F.max("n")).first()
    assert tuple(r) == (0, 2999, 3000, 3000)


def test_adjacent_row_crosses_empty_slices(spark):
    df = spark.createDataFrame([("k", t, t // 10) for t in (1, 5, 12, 47, 48, 90)], "k string, t long, s long")
    p = [r.p.t if r.p else None for r in sc.adjacent_row(df, ["k"], "s", ["t"], [], "p").orderBy("t").collect()]
    n = [r.p.t if r.p else None for r in sc.adjacent_row(df, ["k"], "s", ["t"], [], "p", following=True).orderBy("t").collect()]
    assert p == [None, 1, 5, 12, 47, 48] and n == [5, 12, 47, 48, 90, None]


def test_dyadic_cover_tiles_exactly(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(a + w)) for a, w in zip(rng.integers(0, 400, 60), rng.integers(0, 90, 60), strict=True)] + [(0, 511), (3, 3)]
    rows = spark.createDataFrame(pairs, "lo long, hi long").select("lo", "hi", sc.dyadic_cover(F.col("lo"), F.col("hi"), 10).alias("c")).collect()
    for r in rows:
        got = sorted(x for s in r.c for x in range(s.node << s.level, (s.node + 1) << s.level))
        assert got == list(range(r.lo, r.hi + 1)) and len(r.c) <= 20


def test_shuffled_rank_is_a_permutation(spark):
    for n in (1, 2, 97, 1000):
        df = spark.range(n).select(F.col("id").alias("rank"), F.lit(n).cast("long").alias("n"), F.lit(4).alias("rep"))
        got = sorted(r[0] for r in df.select(_shuffled_rank("rank", "n", "rep", 7)).collect())
        assert got == list(range(n))


def test_prob_bucket_preserves_order(spark):
    p = np.sort(np.r_[0.0, 1.0, 0.5, np.random.default_rng(3).beta(0.2, 0.2, 500), 1 - 1e-15, 1e-200])
    b = [r[0] for r in spark.createDataFrame([(float(x),) for x in p], "p double").select(sc.prob_bucket("p")).collect()]
    assert b == sorted(b)


def test_equi_depth_cuts_a_hot_key_evenly_whatever_its_values(spark):
    rng = np.random.default_rng(8)
    hot = [("hot", float(v)) for v in rng.exponential(size=3000)] + [("hot", 1e12), ("hot", None)] + [("hot", 0.5)] * 900
    rows = hot + [(f"k{i % 300}", float(i)) for i in range(6000)] + [("few", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = sc.equi_depth(df, ["k"], "v", "s", depth=100, most=64).collect()
    assert len(got) == len(rows) and {r.s for r in got if r.k != "hot"} == {0}
    mine = sorted((r.v, r.s) for r in got if r.k == "hot" and r.v is not None)
    assert [s for _, s in mine] == sorted(s for _, s in mine)
    sizes = {}
    for v, s in mine:
        sizes.setdefault(s, []).append(v)
    assert all(len(x) < 200 for s, x in sizes.items() if s % 2 == 0) and len(sizes) > 25
    assert [set(x) for s, x in sizes.items() if s % 2] == [{0.5}]
    pooled = sc.equi_depth(df, [], "v", "s", depth=1000, most=64).groupBy("s").count().collect()
    assert len(pooled) >= 8 and "__all" not in pooled[0].asDict()


def test_slices_of_a_hot_participant_do_not_change_results(spark, monkeypatch):
    from helpers import COHORT, cohort_rows
    from anchorline.operators import leave_one_out as lo
    from anchorline.operators import sequential as sq
    from anchorline.operators import twin as tw
    rows = [r for r in cohort_rows(6, 8)] + [("hot", f"h{i:03d}", 1_704_067_200_000_000 + i * i * 3_600_000_000, 20.0 + i % 7, 1.0 + i % 3, 100.0, 30.0 + i % 5, i % 2, "A") for i in range(60)]
    e = spark.createDataFrame(rows, COHORT).cache()
    def run():
        learned = sorted(map(tuple, sq.learned_before(e).select("event_id", "cc", "gy", "n_learned").collect()))
        log = sorted(map(tuple, tw.replay_log(e.withColumn("excluded_reason", F.lit(None).cast("string"))).collect()))
        return learned, log, sorted(map(tuple, sq.prospective_activity(e).collect())), sorted(map(tuple, lo.others_median(e).collect()))
    whole = run()
    monkeypatch.setattr(sc, "DEPTH", 9)
    cut = run()
    assert cut[1:] == whole[1:]
    assert [x[0] for x in cut[0]] == [x[0] for x in whole[0]] and [x[1:] for x in cut[0]] == [pytest.approx(x[1:]) for x in whole[0]]
    assert sc.equi_depth(e, ["participant_id"], "us", "s").where("participant_id = 'hot'").select("s").distinct().count() >= 6


def test_slice_boundaries_are_read_from_a_stored_table(spark):
    from anchorline.functions.scale import equi_depth
    cut = equi_depth(spark.range(1000).selectExpr("id % 2 AS k", "CAST(id AS double) AS v"), ["k"], "v", "s", depth=50)
    # a sketch made anew by each use of the slices may cut them elsewhere
    assert "percentile_approx" not in cut._jdf.queryExecution().optimizedPlan().toString() and cut.select("k", "s").distinct().count() > 10


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_running_sum_without_hot_keys_takes_one_exchange(spark):
    from helpers import COHORT, cohort_rows
    from anchorline.operators import sequential as sq
    e = spark.createDataFrame(cohort_rows(6, 8), COHORT)
    for df in (sq.learned_before(e), sc.prefix_sums(sc.equi_depth(e, ["participant_id"], "us", "s"), ["participant_id"], "s", ["us"], {"c": "carbs_g"}, totals=True)):
        assert _plan(df).count("Exchange hashpartitioning") == 1 and "Join" not in _plan(df)
    p = _plan(sq.prospective_activity(e))
    assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p


def test_quantiles_of_many_small_keys_take_no_join(spark):
    df = spark.range(300).selectExpr("id % 50 AS k", "CAST(id * 7 % 11 AS double) AS v")
    q = sc.exact_quantiles(df, ["k"], "v", {"m": 0.5, "u": 0.9})
    assert "Join" not in _plan(q)
    for r in q.collect():
        assert (r.m, r.u) == pytest.approx(tuple(np.quantile([i * 7 % 11 for i in range(300) if i % 50 == r.k], [0.5, 0.9])))


def test_models_side_by_side_equal_their_joined_tables(spark):
    from anchorline.operators import compare as cp
    from anchorline.plans import eval_queries as eq
    sf = "/root/testdata/sf0.001"
    columns = eq._S
    got, want = eq.side_by_side(spark, sf), cp.pair(*eq.both(spark, sf))
    assert got.columns == want.columns and len(columns) == 7
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_leave_one_out_joins_events_with_participants_only(spark):
    from helpers import COHORT, cohort_rows
    from anchorline.operators import leave_one_out as lo
    p = _plan(lo.prequential(spark.createDataFrame(cohort_rows(6, 8), COHORT), lo.ONE_TERM))
    assert p.count("Join") == 1 and p.count("Exchange hashpartitioning") <= 2


def test_the_tail_stands_once_in_the_normal_distribution(spark):
    from math import erf, sqrt
    from anchorline.functions.numeric import phi
    z = [-40.0, -8.0, -7.0, -1.5, -0.0, 0.0, 0.3, 2.0, 7.5, 38.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(z)], "i int, z double").withColumn("p", phi("z"))
    assert str(df._jdf.queryExecution().analyzed().toString()).count("0.0352624965998911") == 1
    got = {r.z: r.p for r in df.collect()}
    assert got.pop(None) is None and all(p == pytest.approx(0.5 * (1 + erf(v / sqrt(2))), abs=1e-12) for v, p in got.items())
