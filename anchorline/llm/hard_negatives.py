"""Hard negatives by an inverted multi-index.

Every vector is cut into two halves. For each half a codebook of at most CENTROIDS integer centroids is fitted on a bounded sample (at most about SAMPLE
vectors, chosen by hash); a vector lies in the cell of its two nearest centroids, and all vectors are indexed. The score of an anchor with any vector of
a cell is at most the sum, over both halves, of its inner product with the centroid and its own length times the centroid's radius, which is measured
over all vectors. These bounds are integers computed exactly, so every task and every retry visits cells alike.

An anchor visits cells in the order of their bounds: its half-scores are sorted, and a heap walks pairs of ranks from the best (the multi-sequence
walk). A goal is a window of scores, a wish for rows of the anchor's label or of others, and a count k. It is certified when its k-th score is not below
the bound of the next cell, or that bound is below the window; then no cell left can change it. Rounds visit FIRST rows of cells, then GROW times as
many, until every goal of every anchor is certified, so results equal brute force on all rows. First the positives of an anchor are sought, then, for
each, its negatives in the window that the positive's score gives.

A round joins the visits to the cells. A cell is dealt in blocks of rows and blocks of visits, so neither a crowded cell nor one that all anchors
visit grows a task. Only rows that beat what an anchor already has leave a task, at most k for each goal.

Where vectors are far from each other the radii are wide and most cells are visited: then the work is that of comparing each anchor with everything.

Inputs. Rows with a null id, a null label, a null vector, or a null or non-finite component take no part. Vectors are compared only with their own length.
Rows with equal ids count as one, the one whose label and components sort first. Ties go to the smaller id. Anchors with no positive, and positives
with no negative, give no rows. An empty table gives an empty result. Further columns of the input are ignored. Inner products that could leave 64 bits
are refused with a ValueError."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.llm.common import pick, spread
from anchorline.llm.components import whole_runs
from anchorline.session import stage

SAMPLE, CENTROIDS = 4096, 64
#: Vectors to a cell that the number of centroids aims at; rows and visits of one block.
CELL, ROWS, VISITS = 128, 2048, 512
#: Rows that an anchor's first round visits, at least, and the factor from round to round.
FIRST, GROW = 2048, 8
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _matrix(x) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), len(flat) // max(len(x), 1))


def _product(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Integer inner products of all rows of a with all of b; through doubles unless they are wide, which is exact below 2**53."""
    if wide:
        return np.einsum("ik,jk->ij", a, b)
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


def _fit(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k or fewer integer centroids."""
    if not sample.shape[1]:
        return sample[:1]
    kinds = np.unique(sample, axis=0)
    if len(kinds) <= k:
        return kinds
    x = sample.astype(np.float64)
    center = kinds[np.random.default_rng(7).choice(len(kinds), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = ((center * center).sum(1) - 2 * x @ center.T).argmin(1)
        sums = np.zeros_like(center)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(center))
        center = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], center)
    return np.unique(np.rint(center).astype(np.int64), axis=0)


class Index:
    """Codebooks of both halves with squared radii, and the rows of every cell in use: at most CENTROIDS squared of them."""

    def __init__(self, dim: int, books: list[np.ndarray], wide: bool):
        self.half, self.books, self.wide = dim // 2, books, wide
        self.radius: list[np.ndarray] = []
        self.count: dict[tuple[int, int], int] = {}

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :self.half], x[:, self.half:]]

    def place(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Cell and squared distance to its centroid, for both halves."""
        cells, apart = [], []
        for part, book in zip(self.halves(x), self.books):
            p, b = part.astype(np.float64), book.astype(np.float64)
            near = ((b * b).sum(1) - 2 * p @ b.T).argmin(1)
            cells.append(near)
            d = part - book[near]
            apart.append((d * d).sum(1))
        return cells, apart

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """For both halves, the most that a row of x can score with a vector of each centroid."""
        out = []
        for part, book, radius in zip(self.halves(x), self.books, self.radius):
            length = (part * part).sum(1)
            reach = np.array([[isqrt(n * r) + 1 for r in radius.tolist()] for n in length.tolist()], np.int64).reshape(len(x), -1)
            out.append(_product(part, book, self.wide) + reach)
        return out

    def walk(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bound, i, j) of the cells in use by falling bound: the multi-sequence walk over the sorted halves."""
        a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        fa, fb, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
        heap = [(-fa[0] - fb[0], 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if (a[i], b[j]) in self.count:
                yield -bound, a[i], b[j]
            if j + 1 < len(b):
                heapq.heappush(heap, (-fa[i] - fb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-fa[i + 1] - fb[0], i + 1, 0))


def build(rows: DataFrame, dim: int, wide: bool) -> tuple[DataFrame, Index]:
    """Indexed rows (ci, cj, vec_id, label, vector) and the index, from rows (vec_id, label, vector) of one length."""
    n = rows.count()
    share = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    got = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) < share).select("vector").collect()
    sample = np.array([r[0] for r in got] or [[0] * dim], np.int64).reshape(max(len(got), 1), dim)
    k = int(min(CENTROIDS, max(1, (n / CELL) ** 0.5)))
    index = Index(dim, [_fit(part, k) for part in (sample[:, :dim // 2], sample[:, dim // 2:])], wide)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells, apart = index.place(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in cells], *[pa.array(d) for d in apart], *batch.columns], names=["ci", "cj", "di", "dj", "vec_id", "label", "vector"])

    placed = stage(rows.select("vec_id", "label", "vector").mapInArrow(run, "ci int, cj int, di bigint, dj bigint, vec_id bigint, label bigint, vector array<bigint>"), "cells")
    index.radius = [np.zeros(len(b), np.int64) for b in index.books]
    for r in placed.groupBy("ci", "cj").agg(F.max("di").alias("di"), F.max("dj").alias("dj"), F.count(F.lit(1)).alias("n")).collect():  # a row per cell
        index.count[r["ci"], r["cj"]] = r["n"]
        for half, i, d in ((0, r["ci"], r["di"]), (1, r["cj"], r["dj"])):
            index.radius[half][i] = max(index.radius[half][i], d)
    return placed.drop("di", "dj"), index


_ASK = "anchor bigint, label bigint, vector array<bigint>, low array<bigint>, high array<bigint>, need array<bigint>"


def seek(anchors: DataFrame, placed: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """(anchor, goal, rank, vec_id, score): the k best rows of every goal. anchors: anchor, label, vector, and per goal the window low, high.

    With `same` rows of the anchor's label are wanted, itself left out; else rows of other labels."""
    best = None
    active = anchors.select("anchor", "label", "vector", "low", "high", F.transform("low", lambda _: F.lit(_LOW).cast("bigint")).alias("need"), F.lit(_HIGH).cast("bigint").alias("floor"))
    budget = FIRST
    while True:
        visits = stage(active.mapInArrow(_chooser(index, budget), f"{_ASK}, floor bigint, ci int, cj int"), "visits")
        if not visits.limit(1).count():
            break
        found = _compare(visits, placed, index, same, k)
        order = Window.partitionBy("anchor", "goal").orderBy(F.col("score").desc(), "vec_id")
        both = found if best is None else found.unionByName(best.drop("rank"))
        best = stage(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        # the k-th score of a goal that has k rows is what a row must beat
        needs = best.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("kth"))  # one entry per goal
        left = visits.groupBy("anchor").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("floor").alias("floor"))
        active = stage(left.join(needs, "anchor", "left").select(
            "anchor", "label", "vector", "low", "high",
            F.transform("low", lambda _, i: F.coalesce(F.try_element_at("kth", (i + 1).cast("int")), F.lit(_LOW).cast("bigint"))).alias("need"), "floor"), "asks")
        budget *= GROW
    return best if best is not None else anchors.sparkSession.createDataFrame([], "anchor bigint, goal int, score bigint, vec_id bigint, rank int")


def _chooser(index: Index, budget: int):
    """The next cells of every anchor, with the bound down to which it has then visited all; none once its goals are certified."""
    names = ["anchor", "label", "vector", "low", "high", "need", "floor", "ci", "cj"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                first, second = index.bounds(_matrix(some.column(2)))
                row, cells, floors = [], [], []
                for i, (low, high, need, floor) in enumerate(zip(*[some.column(c).to_pylist() for c in (3, 4, 5, 6)])):
                    stop = min((max(a, c) for a, b, c in zip(low, high, need) if a <= b), default=_HIGH)
                    rows, last, chosen = 0, None, []
                    for bound, a, b in index.walk(first[i], second[i]):
                        if bound >= floor:
                            continue
                        if bound < stop or (rows >= budget and bound < last):
                            break
                        chosen.append((a, b))
                        rows, last = rows + index.count[a, b], bound
                    row += [i] * len(chosen)
                    cells += chosen
                    floors += [last] * len(chosen)
                if row:
                    take = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*take.columns[:6], pa.array(floors, pa.int64()), *[pa.array([c[h] for c in cells], pa.int32()) for h in (0, 1)]], names=names)

    return run


def _compare(visits: DataFrame, placed: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """(anchor, goal, score, vec_id): of every cell block, at most k rows of each goal that are not below what the anchor needs."""
    spark, key = visits.sparkSession, ["ci", "cj"]
    rows_of = spark.createDataFrame([(i, j, -(-n // ROWS)) for (i, j), n in index.count.items()], "ci int, cj int, nr bigint")  # a row per cell
    sizes = F.broadcast(visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("bigint").alias("nv")).join(rows_of, key))
    block = lambda name, of: F.pmod(F.xxhash64(name), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1))
    order = [*key, "br", "bv"]
    data = placed.join(sizes, key).withColumn("br", block("vec_id", "nr")).withColumn("bv", every("nv"))
    asked = visits.join(sizes, key).withColumn("bv", block("anchor", "nv")).withColumn("br", every("nr"))
    nothing = [F.lit(None).cast("array<bigint>").alias(c) for c in ("low", "high", "need")]
    both = (data.select(*order, F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "label", "vector", *nothing)
            .unionByName(asked.select(*order, F.lit(True).alias("asks"), F.col("anchor").alias("id"), "label", "vector", "low", "high", "need")))
    wide = index.wide

    def run(batches):
        for table, starts in whole_runs(batches, order):
            c = {n: table.column(n).combine_chunks() for n in ("asks", "id", "label", "vector", "low", "high", "need")}
            asks = c["asks"].to_numpy(zero_copy_only=False)
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                q, v = pa.array(a + np.flatnonzero(asks[a:b])), pa.array(a + np.flatnonzero(~asks[a:b]))
                if not len(q) or not len(v):
                    continue
                vec, label = c["id"].take(v).to_numpy(), c["label"].take(v).to_numpy()
                by_id = np.argsort(vec)
                vec, label = vec[by_id], label[by_id]
                x = _matrix(c["vector"].take(v))[by_id]
                who, own = c["id"].take(q).to_numpy(), c["label"].take(q).to_numpy()
                scores = _product(_matrix(c["vector"].take(q)), x, wide)
                wanted = (own[:, None] == label) == same
                if same:
                    wanted &= who[:, None] != vec
                windows = [c[n].take(q).to_pylist() for n in ("low", "high", "need")]
                for i in range(len(who)):
                    mine = np.flatnonzero(wanted[i])
                    s = scores[i, mine]
                    for goal, (low, high, need) in enumerate(zip(*[w[i] for w in windows])):
                        at = np.flatnonzero((s >= max(low, need)) & (s <= high))
                        if len(at) > k:
                            kth = np.partition(s[at], len(at) - k)[len(at) - k]
                            at = at[s[at] >= kth]
                        at = at[np.lexsort((at, -s[at]))[:k]]
                        out += [(int(who[i]), goal + 1, x_, y) for x_, y in zip(s[at].tolist(), vec[mine[at]].tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "goal", "score", "vec_id"])

    return both.repartition(spread(placed), *order).sortWithinPartitions(*order).mapInArrow(run, "anchor bigint, goal int, score bigint, vec_id bigint")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale x component). `is_anchor` and `label` are expressions over vec_id and label. A negative has another label than the anchor
    and a score from low to high per cent of the positive's."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (pick(vectors, vec_id=id_col, embedding=vector_col, label=label_col).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~bad)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.transform(v, lambda x: x.cast("double")).alias("embedding")))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("s")).select("vec_id", "s.label", "s.embedding")
    limit = rows.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(F.floor(x * scale).cast("double"))))).alias("m"), F.max(F.size("embedding")).alias("d")).first()
    reach = (limit["m"] or 0.0) ** 2 * 4 * max(limit["d"] or 1, 1)  # distances to centroids stay below this too
    if reach * max(low, high) >= 2.0 ** 63:
        raise ValueError("inner products may leave 64 bits")
    rows = stage(rows.select("vec_id", (label if label is not None else F.col("label")).cast("bigint").alias("label"), F.transform("embedding", lambda x: F.floor(x * scale).cast("bigint")).alias("vector")), "vectors")
    found = None
    for d in [r[0] for r in rows.select(F.size("vector")).distinct().collect()]:  # lengths of vectors, one in any usual table
        part = _mine(rows.where(F.size("vector") == d), is_anchor, d, reach >= 2.0 ** 53, positives, negatives, low, high)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def _mine(rows: DataFrame, is_anchor: Column, dim: int, wide: bool, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    placed, index = build(rows, dim, wide)
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor"), "label", "vector")
    everything = [F.array(F.lit(x).cast("bigint")).alias(n) for n, x in (("low", _LOW), ("high", _HIGH))]
    near = seek(anchors.select("*", *everything), placed, index, True, positives)
    # one goal per positive, in the order of their ranks: low * p <= 100 n <= high * p
    near = stage(near.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("p"),
                             F.expr(f"p * {low} div 100 + int(p * {low} % 100 > 0)").cast("bigint").alias("low"),
                             F.expr(f"p * {high} div 100 - int(p * {high} % 100 < 0)").cast("bigint").alias("high")), "positives")
    goals = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("g"))  # at most `positives` each
    asks = anchors.join(goals, "anchor").select("anchor", "label", "vector", F.col("g.low").alias("low"), F.col("g.high").alias("high"))
    hard = seek(asks, placed, index, False, negatives)
    return (hard.join(near.withColumnRenamed("rank", "goal"), ["anchor", "goal"])
            .select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score")))
