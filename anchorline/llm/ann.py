"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes. On a bounded sample (at most about SAMPLE vectors, chosen by hash) the mean, the principal axes and several rotations are learned by iterative
quantisation: from different starts the axes are turned until signs lose least. A code is the signs of the rotated components, BITS in all. Every
vector is coded and indexed.

Radius. At most about PILOTS queries, chosen by hash, are compared with every vector; the Hamming distances of their true neighbours give the radius that
holds the share `cover` of them. This is the measure of recall against brute force that the index is set by.

Index. The code is cut into m substrings of 8 or 16 bits, whichever costs less at this radius, and every vector is indexed under each. With
r + 1 = m * q + rest, two codes within r bits are within q bits on one of the first `rest` substrings or within q - 1 on one of the others, so probing
those values retrieves every code within the radius. A pair counts under the first substring that admits it. Pairs within the radius are reranked by
cosine in double precision on the original vectors. Queries with fewer than k pairs are compared with all vectors, in cells of a block of queries and a
block of vectors, all in one job.

Equal vectors are indexed by their k + 1 smallest ids, as no other can be among the k nearest of anything. A large bucket is cut into blocks.

Inputs. Vectors that are null, zero, or hold null or non-finite components, and rows with a null id take no part, as queries or candidates. Vectors of
another length are no candidates of a query, as they have no cosine with it: each length is searched by itself, by the same index. Ties go to the smaller id. With fewer than k candidates all are returned. Rows with equal ids count as one
vector, the one whose components sort first. An empty table gives an empty result. Further columns of the input are ignored."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.llm.common import pick, spread
from anchorline.llm.components import whole_runs
from anchorline.llm.embedding_dedup import _matrix, _scaled, usable
from anchorline.session import stage

SAMPLE, PILOTS, BITS = 4096, 256, 256
#: Vectors and probes of one cell, and queries of one cell of the full comparison.
VECTORS, PROBES, BLOCK = 4096, 4096, 4096
#: More than the rounding of a product of unit vectors.
ROUNDING = 1e-9
#: Cost of a shuffled probe against one comparison of two codes.
PROBE_COST = 100


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same bits for the same two vectors wherever it runs."""
    a, b = _scaled(a), _scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class Codes:
    """Mean and rotations, as learned on the sample."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = 25):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        dim = x.shape[1]
        self.mean = x.mean(0)
        x = x - self.mean
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        rng, turns = np.random.default_rng(7), []
        for _ in range(-(-bits // dim)):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(x @ axes @ turn >= 0, 1.0, -1.0).T @ (x @ axes))
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.turns = np.concatenate(turns, 1)[:, :bits]

    def of(self, x: np.ndarray) -> np.ndarray:
        """(n, bits / 64) unsigned words."""
        x = _scaled(x)
        x = x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean
        return np.packbits(x @ self.turns >= 0, axis=1, bitorder="little").view(np.uint64)


def thresholds(radius: int, m: int) -> list[int]:
    """Per substring, so that sum(t + 1) = radius + 1."""
    q, rest = divmod(radius + 1, m)
    return [q if i < rest else q - 1 for i in range(m)]


def substring_width(radius: int, bits: int, n: int, queries: int) -> int:
    def cost(w):
        probes = sum(sum(comb(w, d) for d in range(min(t, w) + 1)) for t in thresholds(radius, bits // w))
        return queries * probes * (PROBE_COST + n / 2 ** w)
    return min((8, 16), key=cost)


def full_scan(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of a bounded block of queries over all vectors, k per task before the exchange."""
    def run(batches):
        best: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vec, raw = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for q, v, score in _top(ids, queries, vec, raw, k):
                best[q] = sorted([*best.get(q, []), *zip((-score).tolist(), vec[v].tolist())])[:k]
        rows = [(int(ids[i]), v, -s) for i, found in best.items() for s, v in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["query_id", "vec_id", "score"])

    return nearest(vectors.select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k)


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(ids: np.ndarray, queries: np.ndarray, vec: np.ndarray, raw: np.ndarray, k: int):
    """(query's position, positions of its k nearest, their cosines), nearest first and ties by id. The product of unit vectors only narrows the choice:
    whatever lies within its rounding of the k-th value is scored exactly, ties included."""
    unit = _units(raw).T
    for at in range(0, len(ids), 256):
        near = _units(queries[at:at + 256]) @ unit
        near[ids[at:at + 256, None] == vec] = -np.inf
        floor = np.partition(near, max(len(vec) - k, 0), 1)[:, max(len(vec) - k, 0)] - ROUNDING
        for i in range(len(near)):
            picks = np.flatnonzero((near[i] >= floor[i]) & np.isfinite(near[i]))
            if len(picks):
                score = cosines(np.broadcast_to(queries[at + i], (len(picks), queries.shape[1])), raw[picks])
                first = np.lexsort((vec[picks], -score))[:k]
                yield at + i, picks[first], score[first]


def full_cells(vectors: DataFrame, queries: DataFrame, k: int, n: int, n_queries: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query over all n vectors. A cell holds a block of queries and a block of vectors and emits k rows
    a query, so neither side is held whole anywhere, and the plan is the same for any number of queries."""
    nv, nq = -(-n // VECTORS), -(-n_queries // BLOCK)

    def dealt(side, own, other, mine, theirs, asks):
        return (side.select("vec_id", "embedding", F.lit(asks).alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(mine)).alias(own))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(theirs - 1).cast("bigint")))))

    order = ["bv", "bq"]
    columns = [*order, "asks", "vec_id", "embedding"]
    both = dealt(vectors, "bv", "bq", nv, nq, False).select(*columns).unionByName(dealt(queries, "bq", "bv", nq, nv, True).select(*columns))

    def run(batches):
        for table, starts in whole_runs(batches, order):
            c = {x: table.column(x).combine_chunks() for x in columns[2:]}
            asks, vec = c["asks"].to_numpy(zero_copy_only=False), c["vec_id"].to_numpy()
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                q, v = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                if not len(q) or not len(v):
                    continue
                x = _matrix(c["embedding"].slice(a, b - a))
                rows = [(vec[q[i]], vec[v[near]], score) for i, near, score in _top(vec[q], x[q - a], vec[v], x[v - a], k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])), *(pa.array(np.concatenate([r[j] for r in rows])) for j in (1, 2))],
                                                     names=["query_id", "vec_id", "score"])

    dense = both.repartition(max(spread(vectors), min(nv * nq, 10_000)), *order).sortWithinPartitions(*order)
    return nearest(dense.mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k)


def nearest(scored: DataFrame, k: int) -> DataFrame:
    """Rank within each query; only k rows of a query leave a task."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _share(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` of n rows, by hash."""
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))


def _collect(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select("vec_id", "embedding").orderBy("vec_id").collect()
    return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 5, bits: int = BITS, cover: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which `is_query` (over `vec_id`) holds."""
    good = pick(vectors, vec_id=id_col, embedding=vector_col).where(usable() & F.col("vec_id").isNotNull())
    good = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    good = stage(good, "vectors")
    out = good.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for d, n in sorted(tuple(r) for r in good.groupBy(F.size("embedding")).count().collect()):  # lengths of vectors, one in any usual table
        out = out.unionByName(_search(good.where(F.size("embedding") == d), n, is_query, k, bits, cover))
    return out


def _search(good: DataFrame, n: int, is_query: Column, k: int, bits: int, cover: float) -> DataFrame:
    """`search` over n vectors of one length."""
    empty = good.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    same = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = stage(good.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"), "indexed")
    queries = stage(good.where(is_query), "queries")
    n_queries = queries.count()
    if not n_queries or n < 2:
        return empty
    codes = Codes(_collect(_share(good, n, SAMPLE))[1], bits)

    # radius
    ids, pilots = _collect(_share(queries, n_queries, PILOTS))
    if not len(ids):
        ids, pilots = _collect(queries.orderBy("vec_id").limit(1))
    truth = full_scan(indexed, ids, pilots, k).join(indexed.select("vec_id", "embedding"), "vec_id").select("query_id", "embedding").collect()  # k rows per pilot
    at = {q: i for i, q in enumerate(ids.tolist())}
    distances = np.bitwise_count(codes.of(pilots)[[at[r[0]] for r in truth]] ^ codes.of(np.array([r[1] for r in truth], np.float64))).sum(1) if truth else np.zeros(1)
    radius = int(np.quantile(distances, cover, method="higher"))

    pairs = _within(indexed, queries, codes, radius, bits, n, n_queries)
    scored = stage(nearest(_rerank(pairs, indexed, queries), k), "ranked")
    # queries with fewer than k: against all vectors
    missing = stage(queries.join(scored.groupBy("query_id").count().where(F.col("count") >= k), F.col("vec_id") == F.col("query_id"), "left_anti"), "missing")
    n_missing = missing.count()
    if not n_missing:
        return scored
    done = scored.join(missing.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*scored.columns)
    return done.unionByName(full_cells(indexed, missing, k, n, n_missing))


def _within(indexed: DataFrame, queries: DataFrame, codes: Codes, radius: int, bits: int, n: int, n_queries: int) -> DataFrame:
    """(query_id, vec_id): every pair of codes within the radius, once."""
    width = substring_width(radius, bits, n, n_queries)
    limits = thresholds(radius, bits // width)
    parts = [(j, t) for j, t in enumerate(limits) if t >= 0]
    flips = {t: np.array([sum(1 << b for b in c) for d in range(min(t, width) + 1) for c in combinations(range(width), d)], np.int64) for _, t in parts}
    step = np.uint16 if width == 16 else np.uint8

    def rows(part, value, ids, code):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), part, np.int32)), pa.array(value), pa.array(ids), pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits // 8), len(ids), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())],
                                          names=["part", "value", "id", "code"])

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                code = codes.of(_matrix(batch.column(1)))
                for j, _ in parts:
                    yield rows(j, code.view(step)[:, j].astype(np.int64), batch.column(0).to_numpy(), code)

    def probe(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, batch.num_rows, 64):
                code = codes.of(_matrix(batch.column(1).slice(at, 64)))
                for j, t in parts:
                    value = (code.view(step)[:, j].astype(np.int64)[:, None] ^ flips[t]).ravel()
                    who = np.repeat(np.arange(len(code)), len(flips[t]))
                    yield rows(j, value, ids[at:at + 64][who], code[who])

    schema = "part int, value bigint, id bigint, code binary"
    data, asked = indexed.select("vec_id", "embedding").mapInArrow(index, schema), queries.select("vec_id", "embedding").mapInArrow(probe, schema)
    key = ["part", "value"]
    # Spark takes a table that Python makes for as large as the one it was made of, and would send the probes, hundreds to thousands of a query, through the driver
    sizes = (data.groupBy(*key).agg(F.count(F.lit(1)).alias("v")).hint("merge").join(asked.groupBy(*key).agg(F.count(F.lit(1)).alias("p")), key)
             .select(*key, F.ceil(F.col("v") / VECTORS).alias("nv"), F.ceil(F.col("p") / PROBES).alias("np")))

    def dealt(side, own, mine, other):
        return (side.hint("merge").join(sizes, key).withColumn(own, F.pmod(F.xxhash64("id"), F.col(mine)))
                .withColumn("bp" if own == "bv" else "bv", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))))

    order = [*key, "bv", "bp"]
    both = (dealt(data, "bv", "nv", "np").select(*order, F.lit(False).alias("asks"), "id", "code")
            .unionByName(dealt(asked, "bp", "np", "nv").select(*order, F.lit(True).alias("asks"), "id", "code")))

    def compare(batches):
        for table, starts in whole_runs(batches, order):
            columns = {k: table.column(k).combine_chunks() for k in ("part", "asks", "id", "code")}
            raw = columns["code"]
            code = np.frombuffer(raw.buffers()[2], np.uint64, count=len(raw) * bits // 64, offset=int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset])).reshape(-1, bits // 64)
            asks, ids, part = columns["asks"].to_numpy(zero_copy_only=False), columns["id"].to_numpy(), columns["part"].to_numpy()
            found = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                q, v = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                for s in range(0, len(q), 256):
                    some = q[s:s + 256]
                    apart = np.zeros((len(some), len(v)), np.uint16)
                    for word in range(bits // 64):
                        apart += np.bitwise_count(code[some, word][:, None] ^ code[v, word])
                    i, j = np.nonzero(apart <= radius)
                    i, j = some[i], v[j]
                    fresh = ids[i] != ids[j]
                    if fresh.any():
                        differ = np.bitwise_count(np.ascontiguousarray(code[i] ^ code[j]).view(step))
                        for p, t in parts:
                            if p < part[a]:
                                fresh &= differ[:, p] > t
                    found.append((ids[i[fresh]], ids[j[fresh]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) if found else pa.array([], pa.int64()) for x in (zip(*found) if found else ((), ()))], names=["query_id", "vec_id"])

    return both.repartition(spread(indexed), *order).sortWithinPartitions(*order).mapInArrow(compare, "query_id bigint, vec_id bigint")


def _rerank(pairs: DataFrame, indexed: DataFrame, queries: DataFrame) -> DataFrame:
    full = (pairs.hint("merge").join(indexed.select("vec_id", F.col("embedding").alias("v")), "vec_id")
            .hint("merge").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").select("query_id", "vec_id", "q", "v"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosines(_matrix(batch.column(2)), _matrix(batch.column(3))))], names=["query_id", "vec_id", "score"])

    return full.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
