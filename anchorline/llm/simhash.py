"""SimHash fingerprints and their links by a generalised pigeonhole.

A 64-bit fingerprint has a bit set where more than half of its shingles' hashes have it. Equal fingerprints are one class with its smallest
document. To find all classes within `radius` bits of each other, the bits are cut into partitions and partition i gets a threshold t_i with
sum(t_i + 1) = radius + 1: two fingerprints within the radius differ in at most t_i bits of some partition i, so every fingerprint is indexed
by its partition values and probes the values within t_i of its own. Thresholds are unequal, and -1 leaves a partition out.

What is learned from the data changes cost only, never the result: (1) bits are grouped by their correlation over all fingerprints, so that the
redundancy between bits is inside partitions; (2) for each number of partitions, histograms of all fingerprints give the chance that two
of them are within t bits in a partition, hence estimated candidate counts; (3) dynamic programming over partitions spends radius + 1 where
probes and candidates cost least. More data therefore moves to fewer, wider partitions.

Candidates are verified on all bits inside the bucket they share, and a bucket gives at most one edge per member (its spanning forest), never its
pairs. A bucket above BLOCK rows is cut into block pairs. As equal fingerprints are collapsed first, the members of a dense bucket are distinct
points of a small Hamming ball, which bounds it whatever the number of copies.

Sixty-four bits tell apart similarities near 1. For lower ones, `copies` fingerprints are taken from one pass over the shingles; each copy is probed, so that
a pair meets in one of many partitions, and `total` bounds the distance over all copies' bits: two texts of Jaccard similarity j differ in about
arccos(2 j / (1 + j)) / pi of them. `similar_bits` gives that bound. Both are estimates: they find candidates and decide nothing exactly.

`keep_one` decides by the exact Jaccard similarity of the sets of shingles and leaves no pair out. Equal sets are collapsed. First, large groups are settled
cheaply: sets that share all ROWS minima of one of BANDS groups of hash functions, and enough minima altogether, are tied to loose groups, inside which every
two sets are compared exactly, in cells of bounded rows and shingles; only what passes is an edge. This finds most pairs, not all. Then `other_edges` finds every
pair that is left between two of the groups so far: with all shingles in one fixed order, two sets of similarity j share one of the first n - ceil(j n) + 1
shingles of each, so sets meet under these. The order puts rare shingles first, by counters of bounded number, which changes cost only. Pairs that meet are
dropped by bounds that no similar pair fails (lengths, places in the order, counters of shingles), and what is left is compared exactly.

Inputs. A null or empty text, or one of white space, has fingerprint zero and is linked like any other. Rows with a null id get a fingerprint but no
component, and link nothing. Rows with equal ids or equal texts each get a row. An empty table gives an empty result. Further columns are ignored."""

from __future__ import annotations

import zlib
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import column, pick, spread, steps, text_key
from anchorline.llm.components import Forest, cells, connected_components, each_offset, whole_runs
from anchorline.session import stage

BITS = 64
#: Rows of a block of a large bucket.
BLOCK = 1024
#: Relative cost of a probe row (shuffled) and of a candidate (one xor and count).
PROBE_COST, CANDIDATE_COST = 1.0, 0.01


#: Multiplier and shift that give the further copies their own hashes: those of SplitMix64. Fixed values.
_STEP, _MULTIPLY = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def similar_bits(jaccard: float, copies: int, slack: float = 0.8) -> int:
    """Distance over all copies' bits of two texts of this similarity, and `slack` standard deviations."""
    p, n = acos(2 * jaccard / (1 + jaccard)) / pi, BITS * copies
    return int(n * p + slack * (n * p * (1 - p)) ** 0.5)


def _copy(hashes: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return hashes
    x = hashes + np.uint64(k * _STEP & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MULTIPLY[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MULTIPLY[1])
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, copies: int = 1) -> bytes:
    """Whole text, A-Z lower-cased, words between ASCII white space, shingles with repeats. Eight bytes per copy, highest bit first."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8 * copies)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    start, end = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest, last = xxhash.xxh64_intdigest, min(shingle, len(words)) - 1
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(start, end[last:])], np.uint64)
    counts = np.zeros((copies, BITS), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at:at + (1 << 14)]
        for k in range(copies):
            counts[k] += np.unpackbits(_copy(some, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, copies: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp)."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])

    def run(batches):
        for batch in steps(batches):
            fps = [fingerprint(t, shingle, seed, copies) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.binary())], schema=out)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, fp binary")


def _words(column_: pa.Array, copies: int) -> np.ndarray:
    """(rows, copies) words of a binary column of fingerprints."""
    column_ = column_.combine_chunks() if isinstance(column_, pa.ChunkedArray) else column_
    if not len(column_):
        return np.zeros((0, copies), np.uint64)
    at = int(np.frombuffer(column_.buffers()[1], np.int32)[column_.offset])
    return np.frombuffer(column_.buffers()[2], ">u8", len(column_) * copies, at).astype(np.uint64).reshape(-1, copies)


# ---- what the data say about the bits ----------------------------------------------------------------------------------------------------
def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _sums(fps: DataFrame, count, copies: int, size: int) -> np.ndarray:
    """Sum over all fingerprints of a count vector per copy, added up per task and then in Spark."""
    def run(batches):
        total = np.zeros((copies, size), np.int64)
        for batch in batches:
            x = _words(batch.column(0), copies)
            for at in range(0, len(x), 1 << 13):
                for k in range(copies):
                    total[k] += count(x[at:at + (1 << 13), k], k)
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(total.ravel()[keep])], names=["cell", "n"])

    out = np.zeros(copies * size, np.int64)
    for r in fps.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most copies * size rows
        out[r["cell"]] = r["n"]
    return out.reshape(copies, size)


def correlation(fps: DataFrame, n: int, copies: int) -> np.ndarray:
    """Absolute correlation of every two bits of a copy over all fingerprints."""
    def count(x, k):
        b = _bits(x).astype(np.float32)
        return (b.T @ b).astype(np.int64).ravel()

    both = _sums(fps, count, copies, BITS * BITS).reshape(copies, BITS, BITS) / max(n, 1)
    p = np.diagonal(both, axis1=1, axis2=2)
    spread_ = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - p[:, :, None] * p[:, None, :]) / (spread_[:, :, None] * spread_[:, None, :]))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width, each grown from its most correlated pair by the bit most correlated with it."""
    left, out = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        sub = np.array([[corr[a, b] if a != b else -1 for b in left] for a in left])
        a, b = np.unravel_index(sub.argmax(), sub.shape)
        group = [left[a], left[b]]
        while len(group) < size:
            group.append(max((x for x in left if x not in group), key=lambda x: corr[x, group].sum()))
        out.append(sorted(group[:size]))
        left = [x for x in left if x not in group[:size]]
    return out


def _distance_chances(hist: np.ndarray) -> np.ndarray:
    """Chance that two draws differ in d bits, from a histogram over 2**w values (xor self-convolution by Walsh-Hadamard transform)."""
    p = hist / max(hist.sum(), 1)
    h = 1
    p = p.astype(float).copy()
    while h < len(p):
        p = p.reshape(-1, 2, h)
        p = np.concatenate([p[:, :1] + p[:, 1:], p[:, :1] - p[:, 1:]], 1).reshape(-1)
        h *= 2
    p = p * p
    h = 1
    while h < len(p):
        p = p.reshape(-1, 2, h)
        p = np.concatenate([p[:, :1] + p[:, 1:], p[:, :1] - p[:, 1:]], 1).reshape(-1)
        h *= 2
    return np.bincount(np.bitwise_count(np.arange(len(p), dtype=np.uint64)), np.maximum(p, 0) / len(p))


def _ball(width: int, t: int) -> int:
    return sum(comb(width, d) for d in range(t + 1))


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = budget. costs[i][t] for t from -1."""
    best = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in options.items():
                to = used + t + 1
                if to <= budget and (to not in step or cost + c < step[to][0]):
                    step[to] = (cost + c, [*chosen, t])
        best = step
    return best[budget]


def _histograms(fps: DataFrame, subs: list[list[list[int]]], copies: int) -> np.ndarray:
    """Counts of every value of every sub-partition (at most eight bits), per copy."""
    def count(x, k):
        b = _bits(x).astype(np.int64)
        return np.concatenate([np.bincount(b[:, s] @ (1 << np.arange(len(s))), minlength=256) for s in subs[k]])

    return _sums(fps, count, copies, 256 * len(subs[0])).reshape(copies, -1, 256)


def plan(fps: DataFrame, radius: int, copies: int = 1, partitions: tuple[int, ...] | None = None) -> list[list[tuple[list[int], int]]]:
    """For each copy, (bits, threshold) of each partition that is probed. `partitions`: the numbers of partitions to choose from."""
    n = fps.count()
    layouts = [[group_bits(corr, m) for m in partitions or range(2, radius + 2)] for corr in correlation(fps, n, copies)]
    subs = [[[part[at:at + 8] for at in range(0, len(part), 8)] for layout in own for part in layout] for own in layouts]
    flat = [[s for part in own for s in part] for own in subs]
    hist = _histograms(fps, flat, copies)
    out = []
    for k in range(copies):
        chances, at = [], 0
        for part in subs[k]:
            total = np.ones(1)
            for s in part:
                total = np.convolve(total, _distance_chances(hist[k, at][:1 << len(s)]))
                at += 1
            chances.append(total.cumsum())
        options, c = [], 0
        for layout in layouts[k]:
            costs = []
            for part in layout:
                near = chances[c]
                c += 1
                costs.append({-1: 0.0} | {t: n * (1 + _ball(len(part), t)) * PROBE_COST + n * n / 2 * float(near[min(t, len(near) - 1)]) * CANDIDATE_COST for t in range(radius + 1)})
            cost, thresholds = allocate(costs, radius + 1)
            options.append((cost, [(p, t) for p, t in zip(layout, thresholds) if t >= 0]))
        out.append(min(options, key=lambda o: o[0])[1])
    return out


# ---- probe and verify --------------------------------------------------------------------------------------------------------------------
def _index(reps: DataFrame, plans: list[list[tuple[list[int], int]]]) -> DataFrame:
    """(part, value, fp, node): every class under its own value of each partition and under the values it probes."""
    copies = len(plans)
    masks = [[[sum(1 << b for b in flip) for d in range(t + 1) for flip in combinations(range(len(bits)), d)] for bits, t in parts] for parts in plans]

    def run(batches):
        for batch in batches:
            words, node, fp = _words(batch.column(0), copies), batch.column(1), batch.column(0)
            for k, parts in enumerate(plans):
                b = _bits(words[:, k]).astype(np.int64)
                for i, (bits, t) in enumerate(parts):
                    value = b[:, bits] @ (np.int64(1) << np.arange(len(bits), dtype=np.int64))
                    for mask in masks[k][i]:
                        # of two values one bit apart, the one that has the bit set looks for the other
                        keep = np.arange(len(value)) if t != 1 or not mask else np.flatnonzero(value & mask)
                        v = value[keep] ^ mask
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k * BITS + i, np.int32)), pa.array(v), fp.take(pa.array(keep)), node.take(pa.array(keep))], names=["part", "value", "fp", "node"])

    return reps.select("fp", "node").mapInArrow(run, "part int, value bigint, fp binary, node bigint")


def link_edges(reps: DataFrame, radius: int = 3, copies: int = 1, total: int | None = None, partitions: tuple[int, ...] | None = None) -> DataFrame:
    """(a, b): a spanning forest of every bucket's links, by node."""
    keys, most = ["part", "value", "b1", "b2"], radius if total is None else total

    def run(batches):
        for table, starts in whole_runs(batches, keys):
            fp, node = _words(table.column("fp"), copies), table.column("node").to_numpy()
            forest = Forest(len(fp))

            def compare(i, j):
                near = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int32) <= most
                forest.join(i[near], j[near])

            each_offset(starts, len(fp), compare)
            tied = forest.root != np.arange(len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[forest.root[tied]])], names=["a", "b"])

    dealt = cells(_index(reps, plan(reps, radius, copies, partitions)), ["part", "value"], "fp", BLOCK)
    return dealt.select(*keys, "fp", "node").mapInArrow(run, "a bigint, b bigint").where("a <> b")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, copies: int = 1, total: int | None = None,
                    partitions: tuple[int, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest id reachable over linked fingerprints. Links: within `radius` bits, or with `total` within that over all copies."""
    fps = stage(fingerprints(docs, shingle, seed, copies, id_col, text_col), "fingerprints")
    reps = stage(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = connected_components(link_edges(reps, radius, copies, total, partitions))
    classes = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# ---- exact similarity of shingle sets ----------------------------------------------------------------------------------------------------
#: Minima of a band and bands of a sketch; chance that the count of equal minima rejects a pair at the bound. What they miss is found by `other_edges`.
ROWS, BANDS, MISS = 4, 12, 0.01
#: Counters that the order of shingles is taken from, a block of them in a row of the exchange, and counters of a set.
PLACES, PLACES_ROW, OWN = 1 << 20, 1 << 14, 128
#: Documents and shingles of a block of a large group.
SETS, SHINGLES = 512, 1 << 20
#: Counters of the bound on an intersection.
COUNTERS = 1024
_ODD = np.random.Generator(np.random.PCG64(8)).integers(1, 2**63, (2, ROWS * BANDS), np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_key", pa.binary()), ("n", pa.int64()), ("minima", pa.binary()), ("bands", pa.binary()), ("own", pa.binary()), ("first", pa.binary())])


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, cut as in `fingerprint`."""
    words = (text or "").encode().lower().split()
    last, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i:i + last]), seed) for i in range(len(words) - last + 1)] if words else [], np.uint64))


def equal_minima(jaccard: float, miss: float = MISS) -> int:
    """The most equal minima that a pair of this similarity falls short of with a chance of at most `miss`."""
    n, below = ROWS * BANDS, 0.0
    for k in range(n + 1):
        below += comb(n, k) * jaccard**k * (1 - jaccard) ** (n - k)
        if below > miss:
            return k
    return n


def sketch(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """A byte of each minimum, and a 64-bit key of each band. An empty set has zeros."""
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64) if len(hashes) else np.zeros(ROWS * BANDS, np.uint64)
    for at in range(0, len(hashes), 1 << 11):
        x = hashes[at:at + (1 << 11), None] * _ODD[0] + _ODD[1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(_MULTIPLY[0])
        least = np.minimum(least, x.min(0))
    mixed = _copy(least, 1)
    keys = np.zeros(BANDS, np.uint64)
    for row in mixed.reshape(BANDS, ROWS).T:
        keys = _copy(keys ^ row, 1)
    return mixed.astype(np.uint8).tobytes(), _copy(keys + np.arange(BANDS, dtype=np.uint64), 1).tobytes()


def shingle_ranks(rows: DataFrame, shingle: int) -> np.ndarray:
    """A byte for each of PLACES values of a shingle's hash: how common the shingles of that value are, in powers of two; 128 and more where over 2 * BLOCK sets may hold one."""
    def count(batches):
        total = np.zeros(PLACES, np.int64)
        for batch in steps(batches):
            found = np.concatenate([shingle_set(t, shingle) for t in batch.column(2).to_pylist()])
            total += np.bincount((found % np.uint64(PLACES)).astype(np.int64), minlength=PLACES)
        for at in range(0, PLACES, PLACES_ROW):
            if total[at:at + PLACES_ROW].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zlib.compress(total[at:at + PLACES_ROW].tobytes(), 1)], pa.binary())], names=["at", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(x), np.int64)
        for at, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["at", "counts"])

    counts, schema = np.zeros(PLACES, np.int64), "at bigint, counts binary"
    for r in rows.mapInArrow(count, schema).repartition(min(spread(rows), PLACES // PLACES_ROW), "at").mapInArrow(add, schema).collect():  # at most PLACES counters
        counts[r["at"]:r["at"] + PLACES_ROW] = np.frombuffer(r["counts"], np.int64)
    usual = max(2 * counts.mean(), 1)
    rank = np.where(counts > usual, 1 + np.log2(np.maximum(counts / usual, 1)).astype(np.int64), 0)
    return (rank + 128 * (counts > 2 * BLOCK)).astype(np.uint8)


def needed(n, jaccard: float):
    """Shingles that a set of n shares at least with any set of this similarity."""
    return np.ceil(jaccard * n - 1e-6).astype(np.int64)


def first_shingles(hashes: np.ndarray, ranks: np.ndarray, jaccard: float) -> np.ndarray:
    """The first of a set's shingles in the order that all sets share, one of which is among those of every set of this similarity. Of a hash the upper 31 bits, then
    a bit for a shingle that may be in more than 2 * BLOCK sets."""
    rank = ranks[(hashes % np.uint64(PLACES)).astype(np.int64)]
    first = np.lexsort((hashes, rank))[:len(hashes) - int(needed(np.array(len(hashes)), jaccard)) + 1]
    return (hashes[first] >> np.uint64(33) << np.uint64(1) | (rank[first] >> 7).astype(np.uint64)).astype(np.uint32)


def own_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each remainder by OWN; 255 is 255 or more."""
    return np.minimum(np.bincount((hashes % np.uint64(OWN)).astype(np.int64), minlength=OWN), 255).astype(np.uint8)


def _sketches(rows: DataFrame, shingle: int, jaccard: float, ranks: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in steps(batches):
            sets = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            minima, bands = zip(*map(sketch, sets))
            own, first = [own_counts(x).tobytes() for x in sets], [first_shingles(x, ranks, jaccard).tobytes() if len(x) else b"" for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()),
                                              *[pa.array(x, pa.binary()) for x in (minima, bands, own, first)]], schema=_SKETCH)

    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, set_key binary, n bigint, minima binary, bands binary, own binary, first binary")


def _flat(column_: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column_.to_pylist()), kind)


def candidate_edges(classes: DataFrame, jaccard: float) -> DataFrame:
    """(a, b): a spanning forest of every band bucket's pairs that share enough minima. `other_edges` finds the similar pairs that these leave out."""
    keys, least = ["band", "b1", "b2"], equal_minima(jaccard)

    def index(batches):
        for batch in batches:
            at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(_flat(batch.column(2), np.int64)), batch.column(1).take(at), batch.column(0).take(at)], names=["band", "minima", "node"])

    def run(batches):
        for table, starts in whole_runs(batches, keys):
            minima, node = _flat(table.column("minima"), np.uint8).reshape(-1, ROWS * BANDS), table.column("node").to_numpy()
            forest = Forest(len(node))

            def compare(i, j):
                apart = forest.root[i] != forest.root[j]
                i, j = i[apart], j[apart]
                near = np.count_nonzero(minima[i] == minima[j], axis=1) >= least
                forest.join(i[near], j[near])

            each_offset(starts, len(node), compare)
            tied = forest.root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[forest.root[tied]])], names=["a", "b"])

    rows = classes.select("node", "minima", "bands").mapInArrow(index, "band bigint, minima binary, node bigint")
    return cells(rows, ["band"], "minima", BLOCK).select(*keys, "minima", "node").mapInArrow(run, "a bigint, b bigint").where("a <> b")


def tie_similar(sets: list[np.ndarray], jaccard: float) -> np.ndarray:
    """Root of each set in the graph of pairs with at least this Jaccard similarity, by exact intersections.

    An intersection is at most the sum of the smaller counts of hashes modulo COUNTERS, which spares most pairs of a large group the intersection."""
    n, forest = np.array([len(x) for x in sets]), Forest(len(sets))
    counts = np.array([np.bincount((x % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) for x in sets], np.int32) if len(sets) > 16 else None

    def enough(inter, i, j):
        return inter / np.maximum(n[i] + n[j] - inter, 1) >= jaccard

    def compare(i, j):
        keep = (forest.root[i] != forest.root[j]) & enough(np.minimum(n[i], n[j]), i, j)
        i, j = i[keep], j[keep]
        if counts is not None and len(i):
            keep = enough(np.minimum(counts[i], counts[j]).sum(1), i, j)
            i, j = i[keep], j[keep]
        if len(i):
            near = enough(np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())]), i, j)
            forest.join(i[near], j[near])

    each_offset(np.array([0]), len(sets), compare)
    return forest.root


def similar_edges(rows: DataFrame, classes: DataFrame, loose: DataFrame, jaccard: float, shingle: int) -> DataFrame:
    """(a, b): a spanning forest of each cell's pairs of loosely tied documents that are similar by exact count. `rows`: doc_id, text_key, text."""
    keys = ["component", "b1", "b2"]
    members = classes.select("node", "text_key", "n").join(loose, "node")
    # only groups of more than one block are in this table, so that Spark can broadcast it and no group has to pass through one task before it is dealt
    blocks = stage(members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SETS), F.ceil(F.sum("n") / SHINGLES)).cast("bigint").alias("__n")).where("__n > 1"), "blocks")
    members = members.join(blocks, "component", "left").withColumn("__n", F.coalesce("__n", F.lit(1).cast("bigint"))).select("component", F.col("node").alias("doc_id"), "text_key", "n", "__n")
    found = rows.join(members, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])

    def cut(batches):
        for batch in steps(batches, size=1 << 20):
            held = [shingle_set(t, shingle).tobytes() for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(held, pa.binary())], names=["component", "doc_id", "text_key", "__n", "hashes"])

    def run(batches):
        for table, starts in whole_runs(batches, keys):
            node = table.column("doc_id").to_numpy()
            for at, to in zip(starts, [*starts[1:], len(node)]):
                sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").slice(at, to - at).to_pylist()]
                root, own = tie_similar(sets, jaccard), node[at:to]
                tied = root != np.arange(len(root))
                yield pa.RecordBatch.from_arrays([pa.array(own[tied]), pa.array(own[root[tied]])], names=["a", "b"])

    dealt = (found.select("component", "doc_id", "text_key", "__n", "text").mapInArrow(cut, "component bigint, doc_id bigint, text_key bigint, __n bigint, hashes binary")
             .withColumn("block", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("__n")))
             .withColumn("__o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
             .withColumn("b1", F.least("block", "__o")).withColumn("b2", F.greatest("block", "__o")))
    return dealt.select(*keys, "doc_id", "hashes").repartition(spread(rows), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").where("a <> b")


def other_edges(rows: DataFrame, sketches: DataFrame, classes: DataFrame, found: DataFrame, jaccard: float, shingle: int) -> DataFrame:
    """(a, b): every pair of similar sets of two different components of `found`. `rows`: doc_id, text_key, text."""
    share = jaccard / (1 + jaccard)
    members = classes.select(F.col("node").alias("doc_id"), "text_key").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    sets = stage(sketches.select("doc_id", "text_key", "n", "own", "first").join(members, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
                 .select(F.col("doc_id").alias("node"), "text_key", F.coalesce("component", "doc_id").bitwiseXOR(F.col("doc_id")).alias("tied"), "n", "own", "first"), "sets")  # tied: component ^ node, mostly 0

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                n = [len(x) // 4 for x in some.column(3).to_pylist()]
                token, of = _flat(some.column(3), np.uint32), pa.array(np.repeat(np.arange(some.num_rows), n))
                place = np.concatenate([np.arange(x, dtype=np.int64) for x in n])
                yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), *[some.column(i).take(of) for i in range(3)], pa.array(place)], names=["token", "node", "tied", "n", "place"])

    def meet(batches, keys):
        for table, starts in whole_runs(batches, keys):
            node, tied, n, place = (table.column(c).to_numpy() for c in ("node", "tied", "n", "place"))
            component, pairs, held = node ^ tied, [], 0

            def compare(i, j):
                nonlocal held
                keep = component[i] != component[j]
                i, j = i[keep], j[keep]
                # of two similar sets the first shingle in common leaves enough behind it in both
                most = np.minimum(n[i] - place[i], n[j] - place[j])
                keep = (np.minimum(n[i], n[j]) >= jaccard * np.maximum(n[i], n[j]) - 1e-6) & (most >= share * (n[i] + n[j]) - 1e-6)
                if keep.any():
                    i, j = node[i[keep]], node[j[keep]]
                    pairs.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1))
                    held += len(i)
                    if held > 1 << 20:
                        pairs[:] = [np.unique(np.concatenate(pairs), axis=0)]
                        held = len(pairs[0])

            each_offset(starts, len(node), compare)
            if pairs:
                a, b = np.unique(np.concatenate(pairs), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["a", "b"])

    tokens = sets.select("node", "tied", "n", "first").mapInArrow(index, "token bigint, node bigint, tied bigint, n bigint, place bigint")
    tokens = tokens.select("token", "node", "tied", F.col("n").cast("int").alias("n"), F.col("place").cast("int").alias("place"))
    usual = tokens.where("token % 2 = 0").repartition(spread(rows), "token").sortWithinPartitions("token").mapInArrow(lambda x: meet(x, ["token"]), "a bigint, b bigint")
    common = cells(tokens.where("token % 2 = 1").hint("merge"), ["token"], "node", BLOCK).select("token", "b1", "b2", "node", "tied", "n", "place").mapInArrow(lambda x: meet(x, ["token", "b1", "b2"]), "a bigint, b bigint")

    def bounded(batches):
        for batch in batches:
            (n, own), (m, other) = ((batch.column(i).to_numpy(), _flat(batch.column(i + 1), np.uint8).reshape(-1, OWN)) for i in (2, 4))
            both = np.minimum(own, other)
            keep = (both.sum(1, dtype=np.int64) >= share * (n + m) - 1e-6) | (both == 255).any(1)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda c, names: sets.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in names])
    likely = stage(usual.unionByName(common).distinct().hint("merge").join(side("a", ["n", "own"]), "a").join(side("b", ["n", "own"]), "b").select("a", "b", "n_a", "own_a", "n_b", "own_b")
                   .mapInArrow(bounded, "a bigint, b bigint"), "pairs")
    asked = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct().join(sets.select("node", "text_key"), "node").select(F.col("node").alias("doc_id"), "text_key")

    def cut(batches):
        for batch in steps(batches, size=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "hashes"])

    texts = stage(rows.join(asked, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text").mapInArrow(cut, "node bigint, hashes binary"), "compared")

    def decide(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(inter / max(len(x) + len(y) - inter, 1) >= jaccard)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    hashes = lambda c: texts.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}"))
    return likely.join(hashes("a"), "a").join(hashes("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(decide, "a bigint, b bigint")


def keep_one(docs: DataFrame, jaccard: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows of one document of each group of similar documents, the one with the smallest id; of rows with that id, one, that with the smallest
    hash of its text. Rows with a null id stay.

    Groups: reachable over pairs whose sets of shingles have at least this Jaccard similarity. Empty sets are equal."""
    rows = pick(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text")
    sketches = stage(_sketches(rows, shingle, jaccard, shingle_ranks(rows, shingle)), "sketches")
    # a class has one set, so one n and one sketch
    classes = stage(sketches.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("bands").alias("bands"))
                    .select("set_key", F.col("r.doc_id").alias("node"), F.col("r.text_key").alias("text_key"), "n", "minima", "bands"), "classes")
    loose = connected_components(candidate_edges(classes, jaccard))
    found = connected_components(similar_edges(rows, classes, loose, jaccard, shingle))
    others = stage(other_edges(rows, sketches, classes, found, jaccard, shingle), "edges")
    if not others.isEmpty():
        found = connected_components(others.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    groups = classes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    keep = (sketches.select("doc_id", "text_key", "set_key").join(groups, "set_key").where(F.col("doc_id") == F.col("component_id"))
            .groupBy(F.col("doc_id").alias("__keep")).agg(F.min("text_key").alias("__key")))
    kept = docs.join(keep, (column(id_col) == F.col("__keep")) & (text_key(text_col) == F.col("__key")), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(column(id_col).isNull()))
