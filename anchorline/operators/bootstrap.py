"""Participant-clustered percentile bootstrap.

Participants are collapsed to their sums before any resampling. How often a participant is in a replicate is a Poisson(1) count, as in resampling a large
cohort with replacement, drawn by integer mixing of the replicate with 60 bits of the participant's md5: every engine, task and retry draws alike, no
participant needs a number, and a replicate's sums are folded inside each task before the only exchange, a row per replicate.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.functions.scale import equi_depth
from anchorline.session import stage

_M = 2147483647
#: u at or above the k-th limit counts at least k + 1. Beyond twelve the chance is below one in the range of u.
_LIMITS = [int(_M * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(12)]


def _folded(stats: DataFrame, keys: list[str], columns: list[str], n_boot: int, seed: int) -> DataFrame:
    """(keys, __r, columns): weighted sums of every replicate, folded in each task: a task hands on one row per key and replicate it has met."""
    h = F.conv(F.substring(F.md5(F.col("participant_id").cast("string")), 1, 15), 16, 10).cast("bigint").alias("__h")
    kinds = "".join(f"`{k}` {stats.schema[k].dataType.simpleString()}, " for k in keys)
    k = len(keys)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def flush():
            for key, sums in held.items():
                yield pa.RecordBatch.from_arrays([*[pa.array([v] * n_boot, t) for v, t in zip(key, types)], pa.array(np.arange(n_boot, dtype=np.int64)), *[pa.array(x) for x in sums]], names=[*keys, "__r", *columns])
            held.clear()

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(k)]
            for at in range(0, batch.num_rows, HELD):
                some = batch.slice(at, HELD)
                w = draw_counts(some.column(k).to_numpy(), n_boot, seed)
                x = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in some.columns[k + 1:]])
                rows: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*[c.to_pylist() for c in some.columns[:k]]) if k else [()] * some.num_rows):
                    rows.setdefault(key, []).append(i)
                for key, mine in rows.items():
                    held[key] = held.get(key, 0) + x[:, mine] @ w[mine]
                if len(held) > KEYS_HELD:
                    yield from flush()
        yield from flush()

    values = [F.col(c).cast("double").alias(c) for c in columns]
    each = stats.select(*keys, h, *values).mapInArrow(run, f"{kinds}__r bigint, " + ", ".join(f"`{c}` double" for c in columns))
    return each.groupBy(*keys, "__r").agg(*[F.sum(c).alias(c) for c in columns])


def ratio_bootstrap(stats: DataFrame, keys: list[str], numerators: list[str], denominator: str = "n", n_boot: int = 1000, seed: int = 0,
                    alpha: float = 0.05) -> DataFrame:
    """Ratio-of-sums estimates with percentile intervals, long form: keys, metric, estimate, ci_low, ci_high, excludes_zero.

    `stats` has one row per (keys, participant_id). Replicates in which nobody of a key is drawn are skipped and counted. The interval quantile is taken over
    n_boot values per key, a fixed small number."""
    named = {c: f"__v{i}" for i, c in enumerate([denominator, *numerators])}
    by_replicate = _folded(stats.select(*keys, "participant_id", *[F.col(c).alias(n) for c, n in named.items()]), keys, list(named.values()), n_boot, seed)
    den = F.col(named[denominator])
    q = by_replicate.groupBy(*keys).agg(F.count_if(den > 0).alias("n_draws_used"), F.count_if(~(den > 0)).alias("n_draws_skipped"),
                                        *[F.percentile(F.when(den > 0, F.col(named[c]) / den), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias(c) for c in numerators])
    point = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_participants"), F.sum(denominator).cast("bigint").alias("n_events"),
                                     *[(F.sum(c) / F.sum(denominator)).alias(f"__e_{c}") for c in numerators])
    joined = point.join(q, keys) if keys else point.withColumn("__k", F.lit(0)).join(q.withColumn("__k", F.lit(0)), "__k").drop("__k")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"__e_{c}").alias("estimate"), F.col(c)[0].alias("ci_low"), F.col(c)[1].alias("ci_high"))
                               for c in numerators]))
    counts = ["n_participants", "n_events", "n_draws_used", "n_draws_skipped"]
    return joined.select(*keys, *counts, rows.alias("x")).select(*keys, *counts, "x.*").withColumn(
        "excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def draw_counts(h: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """(rows, n_boot): how often each 60-bit hash is in each replicate, in integers that any engine can repeat.

    The rule takes remainders by _M = 2**31 - 1. As 2**31 leaves 1, adding the bits above the 31st to those below gives a number of the same remainder, which
    costs a fraction of a division. It is done only where the next product would leave 64 bits, and at the end; a few rows at a time, so that all steps stay in
    a core's cache. Sizes: p below 2**31, q below 2**29, the first sum below 2**32, a square folded once below 2**34 and a number from below 2**51 below 2**31 + 2**20."""
    r = np.arange(n_boot, dtype=np.int64)
    # the first step, (p + first) * 48271 + q, is a sum of a number of the row and one of the replicate
    first, third = ((r * 1000003 + seed * 40692 + 12345) % _M * 48271 % _M).astype(np.uint64), (r * 271).astype(np.uint64)
    a, b = ((h % _M).astype(np.uint64)[:, None], (h // _M).astype(np.uint64)[:, None])
    own = (a * np.uint64(48271) + b) % np.uint64(_M)
    drawn = np.empty((len(h), n_boot))
    mask, bits, limits = np.uint64(_M), np.uint64(31), np.array(_LIMITS, np.uint32)
    high = np.empty((CACHED, n_boot), np.uint64)

    def fold(x: np.ndarray, times: int = 1) -> None:
        t = high[:len(x)]
        for _ in range(times):
            np.right_shift(x, bits, out=t)
            np.bitwise_and(x, mask, out=x)
            x += t

    for i in range(0, len(h), CACHED):
        p, q = a[i:i + CACHED], b[i:i + CACHED]
        x = own[i:i + CACHED] + first
        x *= x
        fold(x)
        x += third
        x *= np.uint64(69621)
        x += p
        fold(x)
        x *= x
        fold(x)
        x += q * np.uint64(131)
        x *= np.uint64(16807)
        fold(x, 2)
        u = x.astype(np.uint32)
        n = (u >= np.uint32(_LIMITS[0])).view(np.uint8)
        for limit in _LIMITS[1:3]:
            n += u >= np.uint32(limit)
        rare = np.flatnonzero(u >= limits[3])  # one in fifty
        high_ones = u.ravel()[rare]
        n.ravel()[rare] = np.where(high_ones == np.uint32(_M), 0, 3 + np.searchsorted(limits[3:], high_ones, "right"))  # a remainder of _M is one of 0
        drawn[i:i + CACHED] = n
    return drawn


#: Cells of a slice that are weighed together, and rows whose draws are held at once.
SLICE_CELLS, HELD = 1024, 32
#: Rows whose draws are mixed at once.
CACHED = 16
#: Keys whose sums a task holds before it hands them on.
KEYS_HELD = 64
#: Upper ends of the inner reliability bins; the five bins are pairs of the ten.
_EDGES = np.array([i * (1.0 / 10) for i in range(1, 10)])
_SUMS = ["pos", "neg", "sp", "u", "s", "q"]


def _cells(scored: DataFrame) -> DataFrame:
    """(arm, p, h, pos, neg) with the slice of the score within its arm. Slices hold whole scores; a score that fills one has an odd number."""
    h = F.conv(F.substring(F.md5(F.col("participant_id").cast("string")), 1, 15), 16, 10).cast("bigint").alias("h")
    cells = scored.groupBy("arm", "participant_id", "p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    cells = stage(cells.select("arm", F.col("p").cast("double").alias("p"), h, "pos", "neg"), "cells")
    return stage(equi_depth(cells, ["arm"], "p", "slice", SLICE_CELLS), "cells")


def _totals(cells: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(arm, slice, r, pos, neg): weighted positives and negatives of every slice and replicate. Slices of one score are weighed in pieces."""
    pieces = cells.groupBy("arm", "slice").agg(F.ceil(F.count(F.lit(1)) / (2 * SLICE_CELLS)).alias("n"))
    dealt = cells.join(pieces, ["arm", "slice"]).withColumn("piece", F.pmod(F.xxhash64("h", "p"), F.col("n")))
    out = pa.schema([("arm", pa.string()), ("slice", pa.int32()), ("pos", pa.list_(pa.float64())), ("neg", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        h, y = table.column("h").to_numpy(), np.stack([table.column(c).to_numpy() for c in ("pos", "neg")])
        total = sum(y[:, i:i + HELD] @ draw_counts(h[i:i + HELD], n_boot, seed) for i in range(0, len(h), HELD))
        return pa.Table.from_arrays([pa.array([table.column(0)[0].as_py()]), pa.array([table.column(1)[0].as_py()], pa.int32()), *[pa.array([t.tolist()], out.types[2]) for t in total]], schema=out)

    each = dealt.select("arm", "slice", "h", "pos", "neg", "piece").groupBy("arm", "slice", "piece").applyInArrow(run, "arm string, slice int, pos array<double>, neg array<double>")
    return each.select("arm", "slice", F.posexplode(F.arrays_zip("pos", "neg")).alias("r", "t")).groupBy("arm", "slice", "r").agg(F.sum("t.pos").alias("pos"), F.sum("t.neg").alias("neg"))


def _weigh(key, cells: pa.Table, carry: pa.Table, n_boot: int, seed: int) -> pa.Table:
    """Sums of one slice per bin and replicate, its scores from the highest down, on top of what stands above it."""
    p = cells.column("p").to_numpy()
    order = np.argsort(-p, kind="stable")
    p, h, pos, neg = p[order], *[cells.column(c).to_numpy()[order] for c in ("h", "pos", "neg")]
    r = np.argsort(carry.column("r").to_numpy())
    above_pos, above_neg, all_neg = (carry.column(c).to_numpy()[r] for c in ("above_pos", "above_neg", "all_neg"))
    starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    sums: dict[int, np.ndarray] = {}
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + HELD, "right")) - 1)
        end = starts[to] if to < len(starts) else len(p)
        a = starts[at]
        w, first = draw_counts(h[a:end], n_boot, seed), starts[at:to] - a
        own = p[a:end], pos[a:end], neg[a:end]
        hit, miss = (c[:, None] * w if to - at == end - a else np.add.reduceat(c[:, None] * w, first) for c in own[1:])
        upto_pos, upto_neg = np.cumsum(hit, 0), np.cumsum(miss, 0)
        upto_pos += above_pos
        upto_neg += above_neg
        # what is linear in the counts is a product of matrices; the two rank sums have no part where there is no positive
        linear = np.stack([own[1], own[2], own[0] * (own[1] + own[2]), own[1] * (1 - own[0]) ** 2 + own[2] * own[0] ** 2])
        where, has, of = np.searchsorted(_EDGES, p[starts[at:to]], "left"), np.add.reduceat(own[1], first) > 0, np.searchsorted(_EDGES, own[0], "left")
        for b in np.unique(where).tolist():
            total, k = linear[:, of == b] @ w[of == b] if (of != b).any() else linear @ w, np.flatnonzero(has & (where == b))
            h_k, up, rank = hit[k], upto_pos[k], upto_neg[k]
            precision = up / np.maximum(up + rank, 1)
            rank -= miss[k] / 2
            sums[b] = sums.get(b, 0) + np.stack([total[0], total[1], total[2], all_neg * total[0] - np.einsum("ij,ij->j", h_k, rank), np.einsum("ij,ij->j", h_k, precision), total[3]])
        above_pos, above_neg, at = upto_pos[-1], upto_neg[-1], to
    n = len(sums)
    return pa.table({"arm": pa.array([key[0].as_py()] * (n * n_boot), pa.string()), "bin": pa.array(np.repeat(np.array(list(sums), np.int32), n_boot)), "r": pa.array(np.tile(np.arange(n_boot, dtype=np.int32), n)),
                     **{c: pa.array(np.concatenate([x[i] for x in sums.values()])) for i, c in enumerate(_SUMS)}})


def rank_metrics_by_replicate(scored: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """(__r, arm, roc_auc, average_precision, brier, ece10, ece5) for every replicate, NULL ranks where a class or everyone is missing.

    Scores of an arm are cut into slices of even size. A task weighs a slice's cells with a vector of all replicates at once, so what is shuffled is slices x
    replicates, not events x replicates: first the totals, which are carried from slice to slice, then the sums of each slice on top of them."""
    cells = _cells(scored)
    totals = stage(_totals(cells, n_boot, seed), "totals")
    over = Window.partitionBy("arm", "r")
    higher = over.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    carry = stage(totals.select("arm", "slice", "r", "pos", "neg", *[F.coalesce(F.sum(c).over(higher), F.lit(0.0)).alias(f"above_{c}") for c in ("pos", "neg")], F.sum("neg").over(over).alias("all_neg")), "carry")
    one = cells.where("slice % 2 = 1").groupBy("arm", "slice").agg(F.min("p").alias("p"))
    alone = carry.join(one, ["arm", "slice"]).selectExpr("arm", f"CAST({' + '.join(f'CAST(p > {e!r}D AS INT)' for e in _EDGES.tolist())} AS INT) AS bin", "CAST(r AS INT) AS r", "pos", "neg", "p * (pos + neg) AS sp",
                                                         "pos * (all_neg - above_neg - neg / 2) AS u", "pos * (above_pos + pos) / greatest(above_pos + pos + above_neg + neg, 1) AS s", "pos * (1 - p) * (1 - p) + neg * p * p AS q")
    many = (cells.where("slice % 2 = 0").groupBy("arm", "slice").cogroup(carry.where("slice % 2 = 0").groupBy("arm", "slice"))
            .applyInArrow(lambda key, left, right: _weigh(key, left, right, n_boot, seed), "arm string, bin int, r int, " + ", ".join(f"{c} double" for c in _SUMS)))
    total = lambda c: F.sum(c).alias(c)
    per_bin = many.unionByName(alone).groupBy("arm", "r", "bin").agg(*[total(c) for c in _SUMS])
    pairs = per_bin.groupBy("arm", "r", F.floor(F.col("bin") / 2).alias("five")).agg(*[total(c) for c in _SUMS], F.sum(F.abs(F.col("sp") - F.col("pos"))).alias("e10")).withColumn("e5", F.abs(F.col("sp") - F.col("pos")))
    m = pairs.groupBy("arm", "r").agg(*[total(c) for c in [*_SUMS, "e10", "e5"]]).withColumn("n", F.col("pos") + F.col("neg"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    part = lambda c: F.try_divide(F.col(c), F.col("n"))
    return m.select(F.col("r").cast("bigint").alias("__r"), "arm", F.when(both, F.col("u") / (F.col("pos") * F.col("neg"))).alias("roc_auc"), F.when(both, F.col("s") / F.col("pos")).alias("average_precision"),
                    part("q").alias("brier"), part("e10").alias("ece10"), part("e5").alias("ece5"))


def rank_metric_bootstrap(scored: DataFrame, arms: list[str], n_boot: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Intervals of AUC, average precision, Brier and ECE for each arm and for every later-minus-earlier arm pair, one common resample.

    `scored` is long: arm, participant_id, p, y, the same events in every arm. Replicates with one class, or with nobody drawn, are skipped and counted."""
    m = rank_metrics_by_replicate(scored, n_boot, seed)
    names = ["roc_auc", "average_precision", "brier", "ece10", "ece5"]
    wide = m.groupBy("__r").pivot("arm", arms).agg(*[F.first(n).alias(n) for n in names])
    used = F.col(f"{arms[0]}_roc_auc").isNotNull()
    items: list[Column] = []
    for n in names:
        for i, a in enumerate(arms):
            items.append(F.struct(F.lit(a).alias("contrast"), F.lit(n).alias("metric"), F.col(f"{a}_{n}").alias("v")))
            items += [F.struct(F.lit(f"{a}_minus_{b}").alias("contrast"), F.lit(n).alias("metric"), (F.col(f"{a}_{n}") - F.col(f"{b}_{n}")).alias("v"))
                      for b in arms[:i]]
    flat = wide.select("__r", F.when(used, 1).otherwise(0).alias("used"), F.explode(F.array(*items)).alias("x")).select("used", "x.*")
    return flat.groupBy("contrast", "metric").agg(
        F.sum("used").alias("n_draws_used"), F.sum(1 - F.col("used")).alias("n_draws_skipped"),
        F.percentile(F.when(F.col("used") == 1, F.col("v")), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q")).select(
        "contrast", "metric", "n_draws_used", "n_draws_skipped", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high")).withColumn(
        "excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
