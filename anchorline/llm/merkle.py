"""Merkle manifest of a dataset with retained SHA-256 midstates.

Leaves of one tree (a language) ascend by id; every two consecutive nodes, or a last one alone, become the hash of their digests as hex text, until one
is left. The trees' roots, in order, are the leaves of a top tree. A digest as hex text is 64 bytes, just one block of SHA-256, so the state of a parent
before a child slot is the compression of the children on its left: eight words. The manifest keeps these states. A changed leaf is folded upwards by
copying the state before its slot and feeding the replacement and the siblings on its right only; siblings on the left are never read again.

Layout. Positions come from one range exchange on (tree, id, leaf) and running counts per partition, so no tree is sorted in one task. 2**LEVELS
consecutive leaves are a block: one row that holds the digests and states of its levels. Roots of blocks are the leaves of the next round, so a tree of n
leaves takes log(n) / LEVELS rounds, each a written table. A block hands its path (states, siblings, slots from its root up to the top) down to its
leaves: rows are folded by one exchange on (tree, block), and tasks work on arrays, all rows of a block at once.

Inputs. Null columns hash as "-". Rows with equal ids are ordered by leaf, equal rows are leaves of their own. A null id comes first in its tree, a null
language is a tree of its own and first of all. Empty and very long texts are hashed whole. An empty table gives no nodes and no rows. Further
columns of the input are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.llm.common import column, spread
from anchorline.session import stage

#: Levels of one block: at most 2**LEVELS leaves.
LEVELS = 12
TOP = "top"
_WORD = np.uint32


def _primes(n: int) -> list[int]:
    return [p for p in range(2, 400) if all(p % q for q in range(2, p))][:n]


def _fraction(p: int, root: int) -> int:
    """The first 32 bits of the fraction of a square or cube root, exactly."""
    value = p << 32 * root
    x = 1 << (value.bit_length() // root + 1)
    while (y := ((root - 1) * x + value // x ** (root - 1)) // root) < x:
        x = y
    return x & 0xFFFFFFFF


#: The constants of SHA-256: square roots of the first 8 primes, cube roots of the first 64.
START = np.array([_fraction(p, 2) for p in _primes(8)], _WORD)
ROUND = np.array([_fraction(p, 3) for p in _primes(64)], _WORD)
_HEX = np.array([int.from_bytes(f"{i:02x}".encode(), "big") for i in range(256)], ">u2")


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> _WORD(by)) | (x << _WORD(32 - by))


def _schedule(block: np.ndarray) -> list[np.ndarray]:
    """The 64 words of 16-word blocks, block[i] being word i of all rows."""
    w = list(block)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + w[i - 7] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> _WORD(3))) + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> _WORD(10))))
    return w


def compress(state: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """SHA-256 compression of one block into each row of (n, 8) states."""
    a, b, c, d, e, f, g, h = state.T
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + words[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], 1)


def _hex_words(digest: np.ndarray) -> list[np.ndarray]:
    """The schedule of the hex text of (n, 8) digests."""
    raw = np.ascontiguousarray(digest).astype(">u4").view(np.uint8)
    return _schedule(_HEX[raw].view(">u4").astype(_WORD).T)


def _padding(blocks: int) -> list[np.ndarray]:
    """The schedule of the block that ends a message of `blocks` whole blocks."""
    return _schedule(np.array([0x80000000, *[0] * 13, 0, blocks * 512], _WORD)[:, None])


_END = {n: _padding(n) for n in (1, 2)}


def feed(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """The midstate after one more child."""
    return compress(state, _hex_words(digest))


def _start(n: int) -> np.ndarray:
    return np.broadcast_to(START, (n, 8))


def tree_levels(leaves: np.ndarray, high: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of every level, (n, 8) each, and of every parent the state before its second slot; up to one node, or `high` levels up."""
    levels, states = [leaves], []
    while len(levels[-1]) > 1 if high is None else len(states) < high:
        now = levels[-1]
        first = feed(_start((len(now) + 1) // 2), now[::2])
        both = len(now) // 2
        parents = np.concatenate([compress(feed(first[:both], now[1::2]), _END[2]), compress(first[both:], _END[1])])
        levels.append(parents)
        states.append(first)
    return levels, states


def paths(levels: list[np.ndarray], states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every leaf, per level: the state before its slot (n, L, 8), its sibling (n, L, 8), and 2 x slot + whether there is a sibling (n, L)."""
    n, high = len(levels[0]), len(states)
    state, sibling, flag = np.empty((n, high, 8), _WORD), np.zeros((n, high, 8), _WORD), np.zeros((n, high), np.uint8)
    at = np.arange(n)
    for h, (now, before) in enumerate(zip(levels, states)):
        slot, other = at & 1, at ^ 1
        there = other < len(now)
        state[:, h] = np.where(slot[:, None] == 1, before[at >> 1], START)
        sibling[there, h] = now[other[there]]
        flag[:, h] = 2 * slot + there
        at = at >> 1
    return state, sibling, flag


def fold(leaf: np.ndarray, state: np.ndarray, sibling: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Digests at the upper end of the paths: at every level the state before the slot takes up the replacement and the siblings on its right only."""
    now = leaf
    for h in range(flag.shape[1]):
        now = feed(state[:, h], now)
        right = flag[:, h] == 1
        if right.any():
            now[right] = feed(now[right], sibling[right, h])
        two = (flag[:, h] & 1) == 1
        out = np.empty_like(now)
        for mask, n in ((two, 2), (~two, 1)):
            if mask.any():
                out[mask] = compress(now[mask], _END[n])
        now = out
    return now


# ---------------------------------------------------------------------------------------------------------------------------------------------
def _words(x: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all values, as rows of eight words."""
    return np.frombuffer(b"".join(x.to_pylist()), ">u4").astype(_WORD).reshape(-1, 8)


def _raw(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words).astype(">u4").tobytes()


def _cells(raw: bytes, ends: np.ndarray) -> pa.Array:
    """Binary values that end at `ends` of raw."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(raw)])


def _even(raw: bytes, n: int) -> pa.Array:
    """n binary values of equal length."""
    return _cells(raw, np.arange(1, n + 1) * (len(raw) // max(n, 1)))


def leaf_hash(*fields: Column) -> Column:
    """SHA-256, as 32 bytes, of columns as "-" if null, else UTF-8 byte count, ":" and the value."""
    text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]).cast("binary"), 256))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `position`, counted from 0 within `tree` by `order`, and `size`, the leaves of the tree.

    One range exchange; the counts of the partitions are carried forward by a window over a row per partition and tree. Rows equal in everything are told
    apart by where they were read, so that copies cannot fill a partition."""
    read = stage(rows.withColumn("__read", F.monotonically_increasing_id()), "leaves")
    cut = read.repartitionByRange(spread(rows), "tree", *order, "__read").sortWithinPartitions("tree", *order, "__read")
    there = stage(cut.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).drop("__read"), "ordered")
    counts = there.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"))
    before, whole = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("tree")
    carried = counts.select("tree", "__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("__first")).alias("__base"), F.sum("n").over(whole).alias("size"))
    return there.join(carried, ["tree", "__part"]).withColumn("position", F.col("__at") + F.col("__base")).drop("__part", "__at", "__base")


class Manifest:
    """Rounds of block rows (tree, block, size, digests, states) of the trees, and of the top tree over their roots."""

    def __init__(self, trees: list[DataFrame], top: list[DataFrame], roots: DataFrame):
        self.trees, self.top, self.roots = trees, top, roots


_BLOCK = "tree string, block bigint, size bigint, root binary, digests binary, states binary"


def _blocks(leaves: DataFrame, digest: str) -> DataFrame:
    """Block rows of leaves (tree, position, size, digest); `size` counts the leaves of the tree in this round."""
    out = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("root", pa.binary()), ("digests", pa.binary()), ("states", pa.binary())])

    high = LEVELS

    def build(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        order = np.argsort(table.column("position").to_numpy())
        levels, states = tree_levels(_words(table.column("digest"))[order], None if size <= 1 << high else high)
        row = [table.column("tree")[0].as_py(), table.column("block")[0].as_py(), size, _raw(levels[-1]), _raw(np.concatenate(levels)), _raw(np.concatenate(states)) if states else b""]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, out.types)], schema=out)

    rows = leaves.select("tree", F.shiftright("position", LEVELS).alias("block"), "position", "size", F.col(digest).alias("digest"))
    return rows.groupBy("tree", "block").applyInArrow(build, _BLOCK)


def _rounds(leaves: DataFrame, digest: str) -> list[DataFrame]:
    rounds = [stage(_blocks(leaves, digest), "manifest")]
    while rounds[-1].where(F.col("size") > 1 << LEVELS).limit(1).count():
        up = rounds[-1].where(F.col("size") > 1 << LEVELS).select("tree", F.col("block").alias("position"), F.ceil(F.col("size") / (1 << LEVELS)).cast("bigint").alias("size"), F.col("root").alias("digest"))
        rounds.append(stage(_blocks(up, "digest"), "manifest"))
    return rounds


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root) where a tree ends."""
    out = None
    for r in rounds:
        here = r.where(F.col("size") <= 1 << LEVELS).select("tree", "root")
        out = here if out is None else out.unionByName(here)
    return out


def manifest(leaves: DataFrame, digest: str = "leaf") -> Manifest:
    """The manifest of leaves (tree, position, size, digest)."""
    trees = _rounds(leaves, digest)
    roots = stage(_roots(trees), "roots")
    top = positions(roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "root"), ["of"])
    top = stage(top, "top")
    return Manifest(trees, _rounds(top, "root"), stage(roots.join(top.select(F.col("of").alias("tree"), F.col("position").alias("at")), "tree"), "roots"))


_PATH = "states binary, siblings binary, flags binary"


def _levels(digests: np.ndarray, states: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The levels of a block row: with n leaves in it, each level has half of the one before, rounded up."""
    if not len(states):
        return [digests], []
    # n leaves give ceil(n / 2) states at the first level, and so on; digests hold one level more
    n, kept_d, kept_s, at_d, at_s = len(digests) - len(states), [], [], 0, 0
    while at_s < len(states):
        kept_d.append(digests[at_d:at_d + n])
        at_d, n = at_d + n, (n + 1) // 2
        kept_s.append(states[at_s:at_s + n])
        at_s += n
    kept_d.append(digests[at_d:])
    return kept_d, kept_s


def down(rows: DataFrame, blocks: DataFrame, upper: DataFrame, carry: list[str], changed: str | None = None) -> DataFrame:
    """rows (tree, block, position, carry) with their path from leaf to top: the part in their block, then what `upper` (tree, block, path) has for it.

    With `changed` (a digest column) the paths are followed at once: `folded` is what the top becomes with that leaf, `proof` the siblings on the way."""
    names = {f.name: f.dataType for f in rows.schema.fields}
    right = blocks.select("tree", "block", "digests", F.col("states").alias("own")).join(upper, ["tree", "block"])
    given = [*carry, *([changed] if changed and changed not in carry else [])]
    kinds = ", ".join(f"`{c}` {names[c].simpleString()}" for c in carry)
    schema = f"tree string, position bigint, {kinds}{', ' if kinds else ''}" + ("folded binary, proof binary, subroot binary" if changed else _PATH)

    leaves = (1 << LEVELS) - 1

    def run(key, left: pa.Table, block: pa.Table) -> pa.Table:
        n = len(left)
        at = left.column("position").to_numpy() & leaves
        digests, own = (_words(block.column(k)) for k in ("digests", "own"))
        state, sibling, flag = (x[at] for x in paths(*_levels(digests, own)))
        above = np.frombuffer(block.column("flags")[0].as_py(), np.uint8)
        state, sibling = (np.concatenate([x, np.broadcast_to(_words(block.column(k)), (n, len(above), 8))], 1) for x, k in ((state, "states"), (sibling, "siblings")))
        flag = np.concatenate([flag, np.broadcast_to(above, (n, len(above)))], 1)
        if changed:
            there = (flag & 1) == 1
            more = {"folded": _even(_raw(fold(_words(left.column(changed)), state, sibling, flag)), n), "proof": _cells(_raw(sibling[there]), np.cumsum(there.sum(1) * 32)),
                    "subroot": block.column("subroot").take(pa.array(np.zeros(n, np.int64)))}
        else:
            more = {"states": _even(_raw(state), n), "siblings": _even(_raw(sibling), n), "flags": _even(flag.tobytes(), n)}
        return pa.table({c: left.column(c) for c in ("tree", "position", *carry)} | more)

    return (rows.select("tree", "block", "position", *given).groupBy("tree", "block")
            .cogroup(right.groupBy("tree", "block")).applyInArrow(run, schema))


def upper_paths(m: Manifest) -> DataFrame:
    """(tree, block, path) of every block of the trees' first round: the way from its root to the top."""
    nothing = F.lit(b"")
    path = ["states", "siblings", "flags"]
    last = m.top[-1].select("tree", "block", nothing.alias("states"), nothing.alias("siblings"), nothing.alias("flags"))
    for lower, higher in zip(reversed(m.top[:-1]), reversed(m.top)):
        rows = lower.select("tree", F.shiftright("block", LEVELS).alias("block"), F.col("block").alias("position"))
        last = stage(down(rows, higher, last, []).select("tree", F.col("position").alias("block"), *path), "paths")
    # the roots of the trees are the leaves of the top tree
    ends = m.roots.select(F.lit(TOP).alias("tree"), F.shiftright("at", LEVELS).alias("block"), F.col("at").alias("position"), F.col("tree").alias("of"))
    at_root = stage(down(ends, m.top[0], last, ["of"]).select(F.col("of").alias("tree"), *path), "paths")
    above = None
    for i in range(len(m.trees) - 1, -1, -1):
        whole = m.trees[i].where(F.col("size") <= 1 << LEVELS).select("tree", "block").join(at_root, "tree")
        if i + 1 < len(m.trees):
            rows = m.trees[i].where(F.col("size") > 1 << LEVELS).select("tree", F.shiftright("block", LEVELS).alias("block"), F.col("block").alias("position"))
            part = down(rows, m.trees[i + 1], above, []).select("tree", F.col("position").alias("block"), *path)
            whole = whole.unionByName(part)
        above = stage(whole, "paths")
    return above


def verify(docs: DataFrame, fields: list[str], changed: dict[str, Column], when: Column, tree_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root (hex, as they are), proof (the siblings' digests from leaf to top, 32 bytes each) and folded_root
    (hex): the root that results where the row, if `when` holds, has the `changed` columns instead. All else comes from the stored manifest."""
    field = {f: column(f) for f in fields}
    leaf, other = leaf_hash(*field.values()), leaf_hash(*[changed.get(f, c) for f, c in field.items()])
    tree = F.coalesce(F.concat(F.lit("1"), column(tree_col).cast("string")), F.lit("0"))  # null first, then by bytes
    rows = docs.select(tree.alias("tree"), column(id_col).cast("bigint").alias("doc_id"), leaf.alias("leaf"), F.when(when, other).alias("other"))
    leaves = stage(positions(rows, ["doc_id", "leaf"]), "placed")
    if not leaves.limit(1).count():
        return docs.sparkSession.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof binary, folded_root string")
    m = manifest(leaves)
    lower = lambda c: F.lower(F.hex(c))
    placed = leaves.select("tree", F.shiftright("position", LEVELS).alias("block"), "position", "doc_id", "leaf", F.coalesce("other", "leaf").alias("now"))
    ways = upper_paths(m).join(m.roots.select("tree", F.col("root").alias("subroot")), "tree")  # a row per block
    done = down(placed, m.trees[0], ways, ["doc_id", "leaf"], "now")
    return done.select("doc_id", lower("leaf").alias("leaf"), lower("subroot").alias("subroot"), F.lit(_roots(m.top).first()["root"].hex()).alias("root"), "proof", lower("folded").alias("folded_root"))
