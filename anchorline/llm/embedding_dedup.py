"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared only under one label. Equal vectors are collapsed to one row with their count. In each of `trees` trees a node above `leaf`
vectors is split at the median of a random projection, several levels at a time, and a vector within `spill` of the median goes to both sides.
A pair with cosine c is at most sqrt(2 - 2c) apart and its projections differ by that over sqrt(dimension) in the mean square, so `spill` is given
in these units: a split loses a pair only if its projections differ by more than 2 x spill of them and straddle the median, and the trees are
independent. A node that splitting does not shrink (a dense cluster within the spill) becomes a leaf of any size. Leaves are compared in cells of
bounded size, all cosines in double precision on the original components.

A pair counts in the first tree and leaf in which it meets, so counts need no pair list: each vector carries its leaves. A cell gives, per vector,
the number of links found and one edge to its group (a spanning forest); counts are summed and groups joined in Spark.

Medians are fitted per node on a sample of at most SAMPLE of its vectors, chosen by hash; every vector is routed.

Inputs. Vectors that are null, zero, or hold null or non-finite components, rows with a null label and rows with a null id link with nothing and keep
themselves. Vectors of different lengths under one label are compared only with their own length. Rows with equal ids count as one vector, the one
whose components sort first. An empty table gives an empty result. Further columns of the input are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import pick
from anchorline.llm.components import cells, connected_components, whole_runs
from anchorline.session import stage

SAMPLE = 256
#: Levels that one round of splitting goes down; 2**LEVELS leaves come out of a node.
LEVELS = 4
BLOCK = 512
#: A node whose children hold more than this share of its vectors each is dense: it is not split further.
SHRINK = 0.9


def usable(vector: str = "embedding") -> Column:
    """Neither null nor zero, all components finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0), F.lit(False))


def direction(tree: int, node: int, dim: int) -> np.ndarray:
    """The random unit vector of a node: the same in every task and every retry."""
    v = np.random.default_rng([tree, node, dim]).standard_normal(dim)
    return v / np.linalg.norm(v)


def _matrix(column_) -> np.ndarray:
    column_ = column_.combine_chunks() if isinstance(column_, pa.ChunkedArray) else column_
    return column_.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column_), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which loses nothing and keeps squares from overflowing or vanishing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(sample: np.ndarray, tree: int, node: int, spill: float) -> list[float]:
    """Medians of a subtree of LEVELS levels in heap order; NaN where splitting would not shrink."""
    out = [float("nan")] * (1 << LEVELS)
    todo = {1: sample}
    for h in range(1, 1 << LEVELS):
        x = todo.pop(h, None)
        if x is None or len(x) < 4:
            continue
        at = x @ direction(tree, (node << LEVELS + 1) + h, x.shape[1])
        mid = float(np.median(at))
        left, right = x[at <= mid + spill], x[at > mid - spill]
        if max(len(left), len(right)) > SHRINK * len(x):
            continue
        out[h] = mid
        todo[2 * h], todo[2 * h + 1] = left, right
    return out


def grow(vectors: DataFrame, trees: int, leaf: int, spill: float) -> DataFrame:
    """(grp, vec, embedding, tree, leaf): each vector in every leaf it reaches. Rounds of LEVELS levels; each is written to the shared folder."""
    split_type = "tree int, grp bigint, leaf bigint, medians array<double>"
    out = pa.schema([("tree", pa.int32()), ("grp", pa.int64()), ("leaf", pa.int64()), ("medians", pa.list_(pa.float64()))])

    def fit(batches):
        for table, starts in whole_runs(batches, ["tree", "grp", "leaf"]):
            rows = []
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                tree, grp, node = (table.column(k)[int(a)].as_py() for k in ("tree", "grp", "leaf"))
                rows.append((tree, grp, node, _fit(_unit(_matrix(table.column("embedding").slice(a, b - a))), tree, node, spill)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), out.types)], schema=out)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(batch.schema.get_field_index("embedding"))))
            tree, node = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("tree", "leaf"))
            medians = _matrix(batch.column(batch.schema.get_field_index("medians")))
            row, heap, final = np.arange(len(x)), np.ones(len(x), np.int64), []
            for _ in range(LEVELS):
                mid = medians[row, heap]
                stop = np.isnan(mid)
                final.append((row[stop], heap[stop]))
                row, heap, mid = row[~stop], heap[~stop], mid[~stop]
                at = np.empty(len(row))
                key = np.stack([tree[row], node[row], heap], 1)
                kinds, which = np.unique(key, axis=0, return_inverse=True)
                which = which.ravel()
                for k, (t, nd, h) in enumerate(kinds.tolist()):
                    here = which == k
                    at[here] = x[row[here]] @ direction(t, (nd << LEVELS + 1) + h, x.shape[1])
                left, right = at <= mid + spill, at > mid - spill
                row, heap = np.concatenate([row[left], row[right]]), np.concatenate([2 * heap[left], 2 * heap[right] + 1])
            final.append((row, heap))
            row, heap = np.concatenate([r for r, _ in final]), np.concatenate([h for _, h in final])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)).take(pa.array(row)) for k in ("tree", "grp", "vec", "embedding")],
                                              pa.array((node[row] << LEVELS + 1) + heap), pa.array(heap < (1 << LEVELS))], names=["tree", "grp", "vec", "embedding", "leaf", "done"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    key = ["tree", "grp", "leaf"]
    now = vectors.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)]))).withColumn("leaf", F.lit(1).cast("bigint")).withColumn("done", F.lit(False))
    finished = None
    columns = ["tree", "grp", "vec", "embedding", "leaf"]
    while True:
        sizes = now.where("NOT done").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        large = stage(sizes.where(F.col("n") > leaf), "nodes")
        small = now.join(large.select(*key), key, "left_anti").select(*columns)
        finished = small if finished is None else finished.unionByName(small)
        if not large.limit(1).count():
            return finished
        over = now.where("NOT done").join(large, key)
        # about SAMPLE vectors of each node, by hash: a share of the node that its size gives
        sample = over.where(F.pmod(F.xxhash64("vec", "tree", "leaf"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n"))
        dealt = sample.repartition(*key).sortWithinPartitions(*key).select(*key, "embedding")
        splits = stage(dealt.mapInArrow(fit, split_type), "splits")
        moved = over.join(splits, key).select(*key, "vec", "embedding", "medians")
        # a node that does not split, or a part that stops as dense, comes out as done
        now = stage(moved.mapInArrow(route, f"tree int, grp bigint, vec bigint, embedding {kind}, leaf bigint, done boolean"), "routed")


def group_of(label, vector):
    """Hash of what vectors must share to be compared; labels themselves are compared before a link is made."""
    return F.xxhash64(label, F.size(vector))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = 6, leaf: int = 1024, spill: float = 0.75,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of the input."""
    rows = pick(vectors, vec_id=id_col, embedding=vector_col, label=label_col)
    good = rows.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    if good.groupBy("vec_id").count().where("count > 1").limit(1).count():
        good = good.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("s")).select("vec_id", "s.label", "s.embedding")
    good = stage(good.select("vec_id", "embedding", "label", group_of("label", "embedding").alias("grp")), "vectors")
    classes = stage(good.groupBy("grp", "label", "embedding").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    found = None
    for d in [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]:  # lengths of vectors, one in any usual table
        part = _links(classes.where(F.size("embedding") == d), threshold, trees, leaf, spill * float(np.sqrt((2 - 2 * threshold) / d)))
        found = part if found is None else found.unionByName(part)
    alone = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    found = stage(found, "links")
    groups = connected_components(found.where("other <> vec").select(F.col("vec").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "vec")
    per_class = (classes.join(found.groupBy("vec").agg(F.sum("n").alias("n")), "vec", "left").join(groups, "vec", "left")
                 .select("grp", "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component_id")))
    linked = good.join(per_class, ["grp", "label", "embedding"]).select("vec_id", "n_links", "component_id")
    return (rows.select("vec_id").join(linked, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _links(classes: DataFrame, threshold: float, trees: int, leaf: int, spill: float) -> DataFrame:
    """(vec, n, other): the links of vec first met in a cell, counted with the copies of the other side, and the smallest vector of its group there."""
    code = F.col("tree").cast("bigint") * F.lit(1 << 56) + F.xxhash64("grp", "leaf").bitwiseAND(F.lit((1 << 56) - 1))
    member = stage(grow(classes.select("grp", "vec", "embedding"), trees, leaf, spill).withColumn("code", code), "forest")
    paths = member.groupBy("vec").agg(F.collect_list("code").alias("codes"))  # a few leaves per tree
    full = member.join(paths, "vec").join(classes.select("vec", "copies", "label"), "vec").select("code", "vec", "copies", "label", "embedding", "codes")
    keys = ["code", "b1", "b2"]
    out = pa.schema([("vec", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(batches):
        for table, starts in whole_runs(batches, keys):
            columns = {k: table.column(k).combine_chunks() for k in ("vec", "copies", "label", "embedding", "codes", "block", "code", "b1", "b2")}
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                x = _scaled(_matrix(columns["embedding"].slice(a, b - a)))
                vec, copies, block = (columns[k].slice(a, b - a).to_numpy() for k in ("vec", "copies", "block"))
                norm = np.sqrt((x * x).sum(1))
                hit = x @ x.T / (norm[:, None] * norm) >= threshold
                hit &= ~np.eye(b - a, dtype=bool) if columns["b1"][a] == columns["b2"][a] else block[:, None] != block
                label = columns["label"].slice(a, b - a).dictionary_encode().indices.to_numpy()
                hit &= label[:, None] == label  # two groups or leaves may share a hash
                if not hit.any():
                    continue
                # pairs that met in an earlier leaf were counted there
                codes = columns["codes"].slice(a, b - a)
                row = np.repeat(np.arange(b - a), codes.value_lengths().to_numpy())
                flat = codes.flatten().to_numpy()
                early = flat < columns["code"][a].as_py()
                _, leaf_at = np.unique(flat[early], return_inverse=True)
                met = np.zeros((b - a, leaf_at.max(initial=-1) + 1), np.float32)
                met[row[early], leaf_at] = 1
                hit &= met @ met.T == 0
                group, last = vec, None
                while last is None or (group != last).any():
                    group, last = np.minimum(group, np.where(hit, group, np.iinfo(np.int64).max).min(1)), group
                some = np.flatnonzero(hit.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(vec[some]), pa.array((hit @ copies)[some]), pa.array(group[some])], schema=out)

    # a cell of two blocks of one bucket holds both; in a bucket of one block, b1 = b2
    return cells(full, ["code"], "vec", BLOCK).select(*keys, "block", "vec", "copies", "label", "embedding", "codes").mapInArrow(run, "vec bigint, n bigint, other bigint")
