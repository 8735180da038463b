"""Sampling-phase audits of a regular-grid sensor: differences, periodic concentration, phases, knots, runs, gaps.

A series is (participant_id, m, v): grid index and value, one row per observed grid point. The dense grid is never built; a difference exists
exactly when the neighbouring rows are one step away. Order-dependent steps are two-level over slices of the grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.scale import adjacent_row, exact_quantiles, prefix_sums

# fixed values
ALPHA = 0.01
MIN_CONCENTRATION = 0.5
MIN_PHASE_AGREEMENT = 0.8
MIN_DETECTABLE_KNOTS = 0.3
MIN_POINTS_PER_PERIOD = 20
MIN_PERMUTATIONS = 99
BLOCK = 1440
SLICE = 4 * BLOCK
RESOLUTIONS = (1.0, 0.5, 0.1, 0.01, 0.001)
K = ["participant_id"]


def grid_quality(df: DataFrame, value: str, unit: int) -> DataFrame:
    """Per participant: rows, share on whole grid points, rows out of order, repeated points, span, missing points."""
    lo = df.groupBy(*K).agg(F.min("us").alias("__lo"))
    r = df.join(lo, K).withColumn("x", (F.col("us") - F.col("__lo")) / unit).withColumn("m", F.round("x").cast("bigint")).withColumn("__s", F.floor(F.col("row_order") / 100_000))
    r = adjacent_row(r, K, "__s", ["row_order"], ["m"], "prev")
    agg = r.groupBy(*K).agg(F.count(F.lit(1)).alias("n_rows"), F.avg((F.abs(F.col("x") - F.col("m")) < 1e-6).cast("double")).alias("share_on_grid"),
                            F.count_if(F.col("m") < F.col("prev.m")).alias("out_of_order"), F.count_if(F.col(value).isNotNull()).alias("n_values"), (F.max("m") + 1).alias("span"))
    points = r.select(*K, "m").distinct().groupBy(*K).agg(F.count(F.lit(1)).alias("n_points"))
    j = agg.join(points, K)
    return j.withColumn("duplicates", F.col("n_rows") - F.col("n_points")).withColumn("missing_points", F.col("span") - F.col("n_points")).drop("n_points")


def to_grid(df: DataFrame, value: str, unit: int, snap: bool = False) -> DataFrame:
    """First row per grid point in file order: (participant_id, m, v), v NULL where the row has no reading. `snap` floors off-grid times."""
    lo = df.groupBy(*K).agg(F.min("us").alias("__lo"))
    x = (F.col("us") - F.col("__lo")) / unit
    m = (F.floor(x) if snap else F.round(x)).cast("bigint")
    return (df.join(lo, K).withColumn("m", m).groupBy(*K, "m").agg(F.min(F.struct("us", "row_order", F.col(value).alias("v"))).alias("f")).select(*K, "m", F.col("f.v").alias("v")))


def resolution(grid: DataFrame) -> DataFrame:
    """Finest step that fits at least 99.9 % of the values (0 when none does), and the zero tolerance it implies."""
    def fits(q: float) -> Column:
        r = F.col("v") / q
        return F.avg((F.abs(r - F.rint(r)) < 1e-6).cast("double")) >= 0.999
    pick = None
    for q in RESOLUTIONS:
        pick = F.when(fits(q), q) if pick is None else pick.when(fits(q), q)
    g = grid.where(F.col("v").isNotNull()).groupBy(*K).agg(pick.otherwise(0.0).alias("q"))
    return g.withColumn("tolerance", F.when(F.col("q") > 0, 2 * F.col("q")).otherwise(1e-6))


def differences(grid: DataFrame) -> DataFrame:
    """d1 = |v[m] - v[m-1]| and d2 = v[m-1] - 2 v[m] + v[m+1], NULL unless the neighbours are observed one step away."""
    g = grid.where(F.col("v").isNotNull()).withColumn("__s", F.floor(F.col("m") / SLICE))
    g = adjacent_row(g, K, "__s", ["m"], ["v"], "p")
    g = adjacent_row(g, K, "__s", ["m"], ["v"], "n", following=True)
    back, ahead = F.col("p.m") == F.col("m") - 1, F.col("n.m") == F.col("m") + 1
    return g.select(*K, "m", "v", F.when(back, F.abs(F.col("v") - F.col("p.v"))).alias("d1"),
                    F.when(back & ahead, F.col("p.v") - 2 * F.col("v") + F.col("n.v")).alias("d2"))


def clipped(diff: DataFrame, col: str = "d2") -> DataFrame:
    """|difference| cut at the participant's 99th percentile, so a few spikes cannot fake concentration."""
    a = diff.where(F.col(col).isNotNull()).select(*K, "m", F.abs(col).alias("a"))
    cap = exact_quantiles(a, K, "a", {"cap": 0.99})
    return a.join(cap, K).select(*K, "m", F.when(F.col("cap") > 0, F.least("a", "cap")).otherwise(F.col("a")).alias("a"))


def _with_periods(df: DataFrame, periods: list[int]) -> DataFrame:
    return df.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))


def _means(by_residue: DataFrame, keys: list[str], total: str = "__s", count: str = "__c") -> DataFrame:
    """Array of residue means (zero where empty) per key; at most `period` entries are gathered."""
    g = by_residue.groupBy(*keys, "period").agg(F.map_from_entries(F.collect_list(F.struct("residue", (F.col(total) / F.col(count)).alias("x")))).alias("__m"), F.sum(count).alias("n_points"))
    return g.withColumn("means", F.expr("transform(sequence(0, period - 1), i -> coalesce(element_at(__m, i), 0D))")).drop("__m")


def _concentration(df: DataFrame) -> DataFrame:
    tot = F.expr("aggregate(means, 0D, (s, x) -> s + x)")
    df = df.withColumn("__tot", tot)
    pair = F.expr("array_max(transform(means, (x, i) -> x + means[(i + 1) % size(means)]))")
    ok = F.col("__tot") > 0
    return df.withColumn("concentration", F.when(ok, F.array_max("means") / F.col("__tot"))).withColumn(
        "residue", F.when(ok, F.array_position("means", F.array_max("means")).cast("int") - 1)).withColumn("pair_concentration", F.when(ok, pair / F.col("__tot"))).drop("__tot")


def concentration(points: DataFrame, periods: list[int]) -> DataFrame:
    """Top-residue share of the mean magnitude per participant and period, its residue, and the best adjacent pair."""
    p = _with_periods(points, periods).withColumn("residue", (F.col("m") % F.col("period")).cast("int"))
    return _concentration(_means(p.groupBy(*K, "period", "residue").agg(F.sum("a").alias("__s"), F.count(F.lit(1)).alias("__c")), K))


def _shuffled_rank(rank: str, n: str, rep: str, seed: int) -> Column:
    """A keyed bijection of [0, n): a three-round Feistel network on a square of side ceil(sqrt(n)), walked until it lands inside.

    `shuffled_ranks` is the same on arrays. It stands in for a sort by random key, so a permutation costs no shuffle. A walk can pass each of the side**2 - n points outside once at
    most, so side**2 - n + 1 steps always end inside; above side 32 less than a sixteenth lies outside, and 64 steps leave odds below 1e-77."""
    side = f"CAST(ceil(sqrt({n})) AS BIGINT)"

    def h(x: str, k: int) -> str:
        return f"pmod(xxhash64({x}, {rep}, {k}, {seed}), {side})"
    lft, rgt = f"(x div {side})", f"(x % {side})"
    r1 = f"(({lft} + {h(rgt, 1)}) % {side})"
    r2 = f"(({rgt} + {h(r1, 2)}) % {side})"
    r3 = f"(({r1} + {h(r2, 3)}) % {side})"
    step = f"({r2} * {side} + {r3})"
    return F.expr(f"pmod(aggregate(sequence(1, CAST(least(64, {side} * {side} - {n} + 1) AS INT)), CAST(-1 AS BIGINT), (acc, j) -> CASE WHEN acc >= 0 AND acc < {n} THEN acc "
                  f"ELSE {step.replace('x div', f'(CASE WHEN acc < 0 THEN {rank} ELSE acc END) div').replace('(x %', f'((CASE WHEN acc < 0 THEN {rank} ELSE acc END) %')} END), {n})")


#: Points of a participant that are shuffled in one piece. Longer series are dealt in such pieces, whose sums Spark adds.
PIECE = 4096
_P1, _P2, _P3, _P4, _P5 = (np.array(p, np.uint64) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hashed(x: np.ndarray, *more) -> np.ndarray:
    """Spark's xxhash64 of a bigint column followed by int columns, which broadcast."""
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
    h = mixed(turn((np.uint64(42) + _P5 + np.uint64(8)) ^ (turn(x.astype(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4)
    for v in more:
        h = mixed(turn((h + _P5 + np.uint64(4)) ^ (np.asarray(v).astype(np.uint64) * _P1), 23) * _P2 + _P3)
    return h.astype(np.int64)


def shuffled_ranks(rank: np.ndarray, n: int, n_perm: int, seed: int) -> np.ndarray:
    """(ranks, n_perm): where each rank goes under keyed bijections of [0, n), one for each replicate: a three-round Feistel network on a square of side
    ceil(sqrt(n)), walked until it lands inside.

    It stands in for a sort by random key, so a permutation costs no shuffle. A walk can pass each of the side**2 - n points outside once at
    most, so side**2 - n + 1 steps always end inside; above side 32 less than a sixteenth lies outside, and 64 steps leave odds below 1e-77."""
    side = ceil(sqrt(n))
    rep = np.broadcast_to(np.arange(n_perm), (len(rank), n_perm))
    one, two, three = (_hashed(np.arange(side)[:, None], np.arange(n_perm), k, seed) % side for k in (1, 2, 3))

    def step(x, r):
        left, right = x // side, x % side
        left = (left + one[right, r]) % side
        right = (right + two[left, r]) % side
        return right * side + (left + three[right, r]) % side
    at = step(np.broadcast_to(rank[:, None], rep.shape), rep)
    for _ in range(min(64, side * side - n + 1) - 1):
        out = at >= n
        if not out.any():
            break
        at[out] = step(at[out], rep[out])
    return at % n


_short_ranks = lru_cache(maxsize=512)(lambda n, n_perm, seed: shuffled_ranks(np.arange(n), n, n_perm, seed))
_TEST = "period int, concentration double, residue int, pair_concentration double, n_points bigint, p_value double, null95 double"


def _tested(m: np.ndarray, a: np.ndarray, owner: np.ndarray, sizes: np.ndarray, periods: list[int], n_perm: int, seed: int) -> Iterator[tuple]:
    """The columns of _TEST for each period, of whole participants: rows by owner and m."""
    people, first = len(sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    to = np.concatenate([_short_ranks(n, n_perm, seed) if n <= 256 else shuffled_ranks(np.arange(n), n, n_perm, seed) for n in sizes.tolist()]) + np.repeat(first, sizes)[:, None]
    slot, weight = owner[:, None] * n_perm + np.arange(n_perm), np.repeat(a, n_perm)
    at = (n_perm - 1) * 0.95
    lo, part = int(at), at - int(at)
    for p in periods:
        residue = m % p
        # only the sizes of the residue groups matter for the null: the shuffled positions are those of the points in order of residue
        in_order = residue[np.lexsort((residue, owner))]
        c = np.bincount(owner * p + residue, minlength=people * p).reshape(people, 1, p)
        sums = (np.bincount(owner * p + residue, a, people * p).reshape(people, 1, p), np.bincount((slot * p + in_order[to]).ravel(), weight, people * n_perm * p).reshape(people, n_perm, p))
        means = [s / np.maximum(c, 1) for s in sums]
        total = [np.cumsum(x, -1)[..., -1] for x in means]
        real, null = (np.divide(x.max(-1), t, out=np.full(t.shape, np.nan), where=t > 0) for x, t in zip(means, total))
        own = means[0][:, 0]
        pair = np.divide((own + np.roll(own, -1, 1)).max(1), total[0][:, 0], out=np.full(people, np.nan), where=total[0][:, 0] > 0)
        null = np.sort(np.nan_to_num(null), 1)
        yield (p, real[:, 0], np.where(np.isnan(real[:, 0]), -1, own.argmax(1)), pair, (1 + (null >= real).sum(1)) / (n_perm + 1),
               null[:, lo] * (1 - part) + null[:, min(lo + 1, n_perm - 1)] * part)


def _short_series(points: DataFrame, periods: list[int], n_perm: int, seed: int) -> DataFrame:
    """The test of participants of at most PIECE points, in memory of some PIECE points at a time."""
    each = points.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("m", "a"))).alias("x")).select(*K, F.col("x.m").alias("m"), F.col("x.a").alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            m, a, ends = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(), np.cumsum(sizes)
            i = 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + PIECE, "right")))
                rows, n = slice(ends[i] - sizes[i], ends[j - 1]), sizes[i:j].astype(np.int64)
                nullable = lambda x, t: pa.array(x, t, mask=np.isnan(conc))  # noqa: B023, E731
                for p, conc, residue, pair, p_value, null95 in _tested(m[rows], a[rows], np.repeat(np.arange(j - i), n), n, periods, n_perm, seed):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, p, np.int32)), nullable(conc, pa.float64()), nullable(residue.astype(np.int32), pa.int32()),
                                                      nullable(pair, pa.float64()), pa.array(n), pa.array(p_value), pa.array(null95)], names=[*K, *_TEST.replace(",", "").split()[::2]])
                i = j
    return each.mapInArrow(run, f"{K[0]} {points.schema[K[0]].dataType.simpleString()}, {_TEST}")


def _long_series(points: DataFrame, periods: list[int], n_perm: int, seed: int) -> DataFrame:
    """The test of longer series: pieces of PIECE points meet the sizes of their participant's residue groups, and a task hands on its sums."""
    obs = concentration(points, periods)
    sizes = _with_periods(points, periods).withColumn("residue", (F.col("m") % F.col("period")).cast("int")).groupBy(*K, "period", "residue").agg(F.count(F.lit(1)).alias("c"))
    g = sizes.groupBy(*K, "period").agg(F.map_from_entries(F.collect_list(F.struct("residue", "c"))).alias("__m"))
    g = g.withColumn("counts", F.expr("transform(sequence(0, period - 1), i -> coalesce(element_at(__m, i), 0L))")).drop("__m")
    sized = g.groupBy(*K).agg(F.collect_list(F.struct("period", "counts")).alias("ps"))
    ranked = prefix_sums(points.withColumn("__one", F.lit(1)).withColumn("__s", F.floor(F.col("m") / SLICE)), K, "__s", ["m"], {"rank": "__one"}).withColumn("rank", F.col("rank") - 1)
    pieces = ranked.groupBy(*K, F.floor(F.col("rank") / PIECE).alias("piece")).agg(F.collect_list(F.struct("rank", "a")).alias("x"))
    dealt = pieces.join(sized, K).select(*K, F.col("x.rank").alias("rank"), F.col("x.a").alias("a"), F.col("ps.period").alias("periods"), F.col("ps.counts").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        kind = None

        def flush():
            for (who, p), (s, c) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([who] * len(s), kind), pa.array(np.full(len(s), p, np.int32)), pa.array(np.arange(len(s), dtype=np.int32) // p), pa.array(np.arange(len(s), dtype=np.int32) % p), pa.array(s), pa.array(c)],
                                                 names=[*K, "period", "rep", "residue", "__s", "__c"])
            held.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                who, rank, a, ps, counts = (batch.column(k)[i] for k in range(5))
                a, ends = np.asarray(a.as_py()), [np.cumsum(c) for c in counts.as_py()]
                to, weight = shuffled_ranks(np.asarray(rank.as_py()), int(ends[0][-1]), n_perm, seed), np.repeat(a, n_perm)
                for p, end in zip(ps.as_py(), ends):
                    slot = (np.arange(n_perm) * p + np.searchsorted(end, to, "right")).ravel()
                    s, c = held.setdefault((who.as_py(), p), [np.zeros(n_perm * p), np.zeros(n_perm * p, np.int64)])
                    s += np.bincount(slot, weight, n_perm * p)
                    c += np.bincount(slot, minlength=n_perm * p)
                if len(held) > 64 * len(periods):
                    yield from flush()
        yield from flush()

    sums = dealt.mapInArrow(run, f"{K[0]} {points.schema[K[0]].dataType.simpleString()}, period int, rep int, residue int, __s double, __c bigint")
    sums = sums.where("__c > 0").groupBy(*K, "period", "rep", "residue").agg(F.sum("__s").alias("__s"), F.sum("__c").alias("__c"))
    nulls = _concentration(_means(sums, [*K, "rep"])).select(*K, "period", F.coalesce("concentration", F.lit(0.0)).alias("nc"))
    j = nulls.join(obs, [*K, "period"])
    return j.groupBy(*K, "period").agg(F.first("concentration").alias("concentration"), F.first("residue").alias("residue"), F.first("pair_concentration").alias("pair_concentration"),
                                       F.first("n_points").alias("n_points"), ((1 + F.count_if(F.col("nc") >= F.col("concentration"))) / (F.count(F.lit(1)) + 1)).alias("p_value"),
                                       F.percentile("nc", F.lit(0.95)).alias("null95"))


def permutation_test(points: DataFrame, periods: list[int], n_perm: int = MIN_PERMUTATIONS, seed: int = 0) -> DataFrame:
    """p = (1 + #null >= observed) / (n + 1) for the top-residue concentration; null = values shuffled over the same positions.

    A shuffled value needs its new rank, not a join to its new position. Participants of at most PIECE points are tested where their points meet, many at a
    time as arrays over all replicates; longer ones are dealt in pieces, so none is a unit of work. No row is made per replicate."""
    n_perm = max(int(n_perm), MIN_PERMUTATIONS)
    counts = points.groupBy(*K).agg(F.count(F.lit(1)).alias("__n"))
    long = counts.where(F.col("__n") > PIECE).select(*K)
    if not long.limit(1).count():  # the usual table
        return _short_series(points, periods, n_perm, seed)
    return _short_series(points.join(long, K, "left_anti"), periods, n_perm, seed).unionByName(_long_series(points.join(long, K, "left_semi"), periods, n_perm, seed))


def fundamental_period(scan: DataFrame, rel: float = 0.8) -> DataFrame:
    """Largest significant period that holds at least `rel` of the best significant concentration."""
    sig = scan.where(F.col("concentration").isNotNull() & (F.col("p_value") <= ALPHA))
    best = sig.groupBy(*K).agg(F.max("concentration").alias("__b"))
    return sig.join(best, K).where(F.col("concentration") >= rel * F.col("__b")).groupBy(*K).agg(F.max("period").alias("fundamental_period"))


def circular(a: Column, b: Column, period: Column) -> Column:
    d = F.abs(a - b) % period
    return F.least(d, period - d)


def block_phases(diff: DataFrame, period: int, block: int = BLOCK, min_per_residue: int = 5) -> DataFrame:
    """Top residue of |d2| per block; blocks with too few points are left out."""
    d = diff.where(F.col("d2").isNotNull()).select(*K, F.floor(F.col("m") / block).alias("block"), (F.col("m") % period).cast("int").alias("residue"), F.abs("d2").alias("a"))
    r = d.groupBy(*K, "block", "residue").agg(F.avg("a").alias("mean"), F.count(F.lit(1)).alias("c"))
    # the smallest residue wins a tie, as an argmax does
    return r.groupBy(*K, "block").agg(F.sum("c").alias("n"), F.max_by("residue", F.struct("mean", -F.col("residue"))).alias("phase")).where(F.col("n") >= period * min_per_residue).select(*K, "block", "phase")


def phase_stability(phases: DataFrame, dominant: DataFrame, period: int) -> DataFrame:
    """Agreement of block phases with the dominant residue and the shifts between consecutive blocks."""
    p = adjacent_row(phases.withColumn("__s", F.floor(F.col("block") / 64)), K, "__s", ["block"], ["phase"], "prev")
    per = F.lit(period)
    j = p.join(dominant.select(*K, "residue"), K)
    dist = circular(F.col("phase"), F.col("residue"), per)
    shift = F.when(F.col("prev").isNotNull(), circular(F.col("phase"), F.col("prev.phase"), per))
    return j.groupBy(*K).agg(F.count(F.lit(1)).alias("n_blocks"), F.avg((F.col("phase") == F.col("residue")).cast("double")).alias("agreement_exact"),
                             F.avg((dist <= 1).cast("double")).alias("agreement_within_1"), F.count_if(shift > 0).alias("phase_shifts"))


def knots(diff: DataFrame, dominant: DataFrame, tol: DataFrame, period: int) -> DataFrame:
    """Detected slope changes per expected interval, on and near the dominant residue, and their spacing over fully observed stretches."""
    d = diff.join(tol.select(*K, "tolerance"), K).join(dominant.select(*K, "residue"), K)
    # observed run number: a stretch ends where the previous observed point is not one step away
    s = d.withColumn("__s", F.floor(F.col("m") / SLICE)).withColumn("__brk", F.when(F.col("d1").isNull(), 1).otherwise(0))
    s = prefix_sums(s, K, "__s", ["m"], {"stretch": "__brk"})
    n = s.groupBy(*K).agg(F.count(F.lit(1)).alias("n_valid"))
    kn = s.where(F.abs("d2") > F.col("tolerance")).select(*K, "m", "stretch", "residue", "__s")
    kn = adjacent_row(kn, K, "__s", ["m"], ["stretch"], "prev")
    gap = F.when(F.col("prev.stretch") == F.col("stretch"), F.col("m") - F.col("prev.m"))
    r = (F.col("m") % period)
    g = kn.withColumn("gap", gap).groupBy(*K).agg(
        F.count(F.lit(1)).alias("n_knots"), F.avg((r == F.col("residue")).cast("double")).alias("share_on_residue"),
        F.avg((circular(r, F.col("residue"), F.lit(period)) <= 1).cast("double")).alias("share_near_residue"), F.count("gap").alias("n_spacings"),
        F.avg((F.col("gap") == period).cast("double")).alias("share_equal_period"), F.avg((F.col("gap") % period != 0).cast("double")).alias("share_not_multiple"))
    return g.join(n, K).withColumn("knots_per_interval", F.col("n_knots") / (F.col("n_valid") / period))


def _islands(flagged: DataFrame) -> DataFrame:
    """Consecutive grid points with flag: island id = m minus running count."""
    f = flagged.withColumn("__one", F.lit(1)).withColumn("__s", F.floor(F.col("m") / SLICE))
    return prefix_sums(f, K, "__s", ["m"], {"__r": "__one"}).withColumn("island", F.col("m") - F.col("__r")).drop("__s", "__one", "__r")


def straight_runs(diff: DataFrame, tol: DataFrame, period: int) -> DataFrame:
    """Runs with second difference near zero over more than two native intervals, flat and sloped counted apart."""
    d = diff.join(tol.select(*K, "tolerance"), K)
    z = _islands(d.where(F.abs("d2") <= F.col("tolerance")))
    runs = z.groupBy(*K, "island").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.first("tolerance").alias("tolerance"))
    ends = (runs.join(diff.select(*K, (F.col("m") + 1).alias("a"), F.col("v").alias("va")), [*K, "a"])
            .join(diff.select(*K, (F.col("m") - 1).alias("b"), F.col("v").alias("vb")), [*K, "b"]))
    pts = F.col("b") - F.col("a") + 3
    long = ends.withColumn("points", pts).where(pts > 2 * period + 1).withColumn("flat", F.abs(F.col("vb") - F.col("va")) <= F.col("tolerance"))
    n = diff.groupBy(*K).agg(F.count(F.lit(1)).alias("n_valid"))
    g = long.groupBy(*K).agg(F.count_if("flat").alias("n_flat"), F.count_if(~F.col("flat")).alias("n_sloped"), F.sum(F.when(~F.col("flat"), F.col("points"))).alias("__p"),
                             F.max(F.when(~F.col("flat"), F.col("points"))).alias("longest_sloped"), F.max(F.when(F.col("flat"), F.col("points"))).alias("longest_flat"))
    z0 = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return n.join(g, K, "left").select(*K, "n_valid", z0("n_flat"), z0("n_sloped"), z0("longest_sloped"), z0("longest_flat"), (F.coalesce("__p", F.lit(0)) / F.col("n_valid")).alias("share_in_sloped"))


def null_gaps(grid: DataFrame, period: int) -> DataFrame:
    """Lengths of unobserved stretches between the first and the last reading, in buckets."""
    g = grid.where(F.col("v").isNotNull()).withColumn("__s", F.floor(F.col("m") / SLICE))
    g = adjacent_row(g.select(*K, "m", "__s"), K, "__s", ["m"], [], "p").withColumn("gap", F.col("m") - F.col("p.m") - 1)
    return g.groupBy(*K).agg(F.count(F.lit(1)).alias("n_valid"), F.count_if(F.col("gap") > 0).alias("n_gaps"), F.count_if(F.col("gap") == 1).alias("len_1"),
                             F.count_if(F.col("gap").between(2, period)).alias("len_to_period"), F.count_if((F.col("gap") > period) & (F.col("gap") <= 30)).alias("len_to_30"),
                             F.count_if(F.col("gap") > 30).alias("len_over_30"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest"),
                             (F.coalesce(F.sum("gap"), F.lit(0)) / (F.max("m") - F.min("m") + 1)).alias("share_missing"))


def constant_runs(series: DataFrame) -> DataFrame:
    """Distribution of runs of equal consecutive readings per participant: pairs, equal pairs, longest run."""
    g = series.where(F.col("v").isNotNull()).withColumn("__s", F.floor(F.col("m") / SLICE))
    g = adjacent_row(g, K, "__s", ["m"], ["v"], "p").withColumn("__new", F.when(F.col("p").isNotNull() & (F.col("p.v") == F.col("v")), 0).otherwise(1))
    r = prefix_sums(g, K, "__s", ["m"], {"run": "__new"})
    runs = r.groupBy(*K, "run").agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(*K).agg((F.sum("len") - 1).alias("pairs"), (F.sum("len") - F.count(F.lit(1))).alias("equal_pairs"), F.max("len").alias("longest_run"), F.count(F.lit(1)).alias("n_runs"))


def verdicts(test: DataFrame, first_difference: DataFrame, stability: DataFrame, knot: DataFrame, valid: DataFrame, period: int) -> DataFrame:
    """Conservative per-participant verdict from the measured statistics."""
    t = test.select(*K, "concentration", "p_value", "n_points")
    f = first_difference.select(*K, F.col("concentration").alias("c1"), F.col("p_value").alias("p1"))
    j = valid.join(t, K, "left").join(f, K, "left").join(stability.select(*K, "n_blocks", "agreement_exact"), K, "left").join(knot.select(*K, "knots_per_interval"), K, "left")
    few = (F.col("n_valid") < MIN_POINTS_PER_PERIOD * period) | (F.coalesce("n_points", F.lit(0)) < MIN_POINTS_PER_PERIOD * period)
    weak = F.coalesce("knots_per_interval", F.lit(0.0)) < MIN_DETECTABLE_KNOTS
    v = (F.when(few, "insufficient_data")
         .when((F.col("p1") <= ALPHA) & (F.col("c1") >= MIN_CONCENTRATION), "periodic_but_step_hold_like_not_linear")
         .when(F.col("concentration").isNull() | (F.col("p_value") > ALPHA) | (F.col("concentration") < MIN_CONCENTRATION), F.when(weak, "inconclusive_low_power").otherwise("not_supported"))
         .when((F.coalesce("n_blocks", F.lit(0)) < 2) | (F.coalesce("agreement_exact", F.lit(0.0)) < MIN_PHASE_AGREEMENT), "periodic_but_phase_unstable")
         .otherwise("consistent_with_linear_interpolation_on_fixed_grid"))
    return j.select(*K, v.alias("verdict"))


def integer_share(series: DataFrame, value: str, unit: int) -> DataFrame:
    """Integer and fractional readings, time steps between integer readings, and their phase in the five-step cycle."""
    s = series.where(F.col(value).isNotNull()).withColumn("is_int", F.pmod(F.col(value), F.lit(1.0)) < 1e-6)
    ints = s.where("is_int").withColumn("__s", F.floor(F.col("us") / (unit * SLICE)))
    ints = adjacent_row(ints.select(*K, "us", "row_order", "__s"), K, "__s", ["us", "row_order"], [], "p")
    steps = ints.groupBy(*K).agg(F.count_if((F.col("us") - F.col("p.us")) == unit).alias("one_step"), F.count_if((F.col("us") - F.col("p.us")) == 5 * unit).alias("five_steps"),
                                 *[F.count_if(F.floor(F.col("us") / unit) % 5 == i).alias(f"phase_{i}") for i in range(5)])
    return s.groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_int").alias("n_integer")).join(steps, K, "left")
