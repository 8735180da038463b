"""Connected components, and comparison of the rows of a bucket without pairing them in a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import spread
from anchorline.session import stage

#: A node with more than one in HUBS of all edge ends is a hub; there are fewer than HUBS of them whatever the data, so their table is broadcast.
HUBS = 1000


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v) with m, the smallest neighbour of u, for `total` edges. The few hubs meet their m by a broadcast of fewer than HUBS rows, all other nodes by a join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") * HUBS > F.lit(total)).select("u", F.col("m").alias("hub_m")))
    known = edges.join(hubs, "u", "left")
    return (known.where(F.col("hub_m").isNotNull()).select("u", "v", F.col("hub_m").alias("m"))
            .unionByName(known.where(F.col("hub_m").isNull()).select("u", "v").join(least.select("u", "m"), "u")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list: component is the smallest node reachable.

    Alternating large-star and small-star contraction; every round is written to the shared folder, which cuts the lineage, and the rounds end
    when the edge set (its size and the xor of its hashes) no longer changes. The number of rounds grows with the logarithm of the graph."""
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        here = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if here == mark or not here[0]:
            break
        mark = here
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_with_least(both, 2 * here[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "edges")
        low = _with_least(large, large.count())
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stage(small.distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def cells(rows: DataFrame, keys: list[str], spread_by: str, limit: int) -> DataFrame:
    """Rows of buckets with at least two rows, dealt into cells of about `limit` to 2 x `limit` rows and sorted by cell.

    A bucket above `limit` rows is cut into blocks by hash, and a cell is a pair of blocks; every two rows of a bucket meet in a cell, and no cell
    grows with its bucket. `b1`, `b2` are the cell's blocks and `block` the row's own."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).where("__c >= 2")
    dealt = (rows.join(sizes, keys)
             .withColumn("__n", F.ceil(F.col("__c") / limit))
             .withColumn("block", F.pmod(F.xxhash64(spread_by), F.col("__n")))
             .withColumn("__o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
             .withColumn("b1", F.least("block", "__o")).withColumn("b2", F.greatest("block", "__o")))
    order = [*keys, "b1", "b2"]
    return dealt.drop("__c", "__n", "__o").repartition(spread(rows), *order).sortWithinPartitions(*order)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, from batches sorted by them, with the row each run starts at. What is held is a batch and a run."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        n = table.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]).combine_chunks(), at[:-1]
        held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.array([0])


class Forest:
    """Union-find over the rows of one step."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i]-b[i]; those already joined cost one array comparison."""
        root = self.root
        new = root[a] != root[b]
        if not new.any():
            return
        up = dict[int, int]()

        def find(x: int) -> int:
            path = []
            while (y := up.get(x, x)) != x:
                path.append(x)
                x = y
            for p in path:
                up[p] = x
            return x

        pairs = np.unique(np.stack([root[a[new]], root[b[new]]], 1), axis=0)
        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        heads = np.array(list(up), np.int64)
        to = np.arange(len(root))
        to[heads] = [find(x) for x in heads.tolist()]
        self.root = to[root]


def each_offset(starts: np.ndarray, n: int, compare: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Call compare(i, j) so that every two rows of a run occur once, all runs together: rows 1 apart, then 2 apart, and so on."""
    lengths = np.diff([*starts, n])
    end = np.repeat(starts + lengths, lengths)
    i = np.arange(n)
    for d in range(1, int(lengths.max(initial=1))):
        i = i[i + d < end[i]]
        compare(i, i + d)
