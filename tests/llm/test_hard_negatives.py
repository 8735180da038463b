"""Mined negatives against comparison of everything with everything."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, goal int, low string"


def brute(rows, every):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [float(np.float32(x)) for x in v])
        kept[i] = min(kept.get(i, key), key)
    at = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, x) in at.items():
        if a % every:
            continue
        ranked = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in at.items() if i != a and len(x) == len(y))
        for ps, p in [(-s, i) for s, i, other in ranked if other == label][:5]:
            hard = [(i, -s) for s, i, other in ranked if other != label and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(hard)]
    return sorted(out)


def result(spark, rows, every=5):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, label)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def test_equals_brute_force_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIRST", 20)
    monkeypatch.setattr(hard_negatives, "ROWS", 30)
    monkeypatch.setattr(hard_negatives, "VISITS", 7)
    monkeypatch.setattr(hard_negatives, "CELL", 8)
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((6, 8))
    rows = [(i, (centers[i % 6] + 0.3 * rng.standard_normal(8)).tolist(), int(rng.integers(0, 4)), 0.5, 1, "x") for i in range(240)]
    rows += [(i, rows[0][1], i % 3, 0.5, 1, "x") for i in range(240, 340)]  # many copies of one vector: ties
    assert result(spark, rows) == brute(rows, 5) != []


def test_defined_cases(spark):
    rng = random.Random(2)
    v = lambda n=3: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, v(), i % 3) for i in range(40)] + [(i, v(5), i % 2) for i in range(40, 60)]
    rows += [(60, None, 1), (61, [], 1), (65, [], 2), (62, [0.0, float("nan"), 1.0], 1), (63, [float("inf"), 0.0, 1.0], 1), (64, [None, 0.0, 1.0], 1), (None, v(), 1), (70, v(), None),
             (80, [0.0] * 3, 1), (5, v(), 2), (5, v(), 2), (10, rows[10][1], 1), (90, v(1), 3), (95, v(1), 3)]
    rows = [(*r, 1.0, 2, "t") for r in rows]
    assert result(spark, rows) == brute(rows, 5) != []
    assert result(spark, []) == []
    with pytest.raises(ValueError):
        result(spark, [(0, [1e30], 1, 0.0, 1, "x"), (1, [1e30], 1, 0.0, 1, "x")])


def test_bounds_hold_and_fall(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * 100).astype(int).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<bigint>, label long").select("vec_id", "label", "vector")
    placed, index = hard_negatives.build(df, 6, False)
    anchor = np.array([rows[0][1]])
    first, second = index.bounds(anchor)
    walk = list(index.walk(first[0], second[0]))
    assert [w[0] for w in walk] == sorted((w[0] for w in walk), reverse=True) and {w[1:] for w in walk} == set(index.count)
    bound = {w[1:]: w[0] for w in walk}
    for r in placed.collect():
        assert int(anchor[0] @ np.array(r["vector"])) <= bound[r["ci"], r["cj"]]
