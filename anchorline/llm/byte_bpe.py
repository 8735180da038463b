"""Byte-level BPE by ranks, with a segment tree over the byte positions of each match.

A leaf stands for the pair that starts at a position and holds (rank, position), so the root is the leftmost pair of minimum rank. A merge
changes three leaves (the pair before, the merged pair, the pair that vanished), each a walk of logarithmic length, and never rescans the
match. Matches of a batch that have not been seen before are merged together: trees of one size are rows of one array and every step advances
all of them. A match above `WIDE` bytes has a tree of its own, so a text without any space costs n log n.

A memo of matches is kept per Python worker and starts anew when it is full. As in the tiktoken library, a match that is itself a token is
not merged at all.

Inputs. A null text counts as empty and gives no ids. Rows are encoded one by one, so ties and repeated rows give repeated results; null ids
are kept. An empty table gives an empty result. Further columns of the input are ignored. Decoding gives bytes: ids need not end on a
character."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from anchorline.llm.common import pick, steps

MEMO_ENTRIES, MEMO_BYTES = 600_000, 48 << 20
#: Bytes up to which trees are advanced together, and how many at once.
WIDE, TOGETHER = 64, 8192
_NONE = np.int64(1) << 62
_LOADED: dict[tuple[str, str], "RankBpe"] = {}


class RankBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.memo: dict[str, bytes] = {}
        self.held = 0

    # pair ranks -------------------------------------------------------------------------------------------------------------------------
    def leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rank, position) of the pairs a, b as one number; no pair where an id is below zero or the two do not merge."""
        key = (a << 32) | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[i] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, (self.values[i] << 24) | at, _NONE)

    # many short matches -----------------------------------------------------------------------------------------------------------------
    def merge_many(self, words: list[bytes], size: int) -> list[bytes]:
        """words of at most `size` bytes, a power of two; one tree per row."""
        n, rows = len(words), np.arange(len(words))
        lengths = np.array([len(w) for w in words])
        raw = np.zeros((n, size), np.uint8)
        inside = np.arange(size) < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((n, size + 1), -1, np.int64)  # the last column stands for "no neighbour"
        ids[:, :size][inside] = self.byte_ids[raw[inside]]
        after = np.tile(np.arange(1, size + 2), (n, 1))
        after[:, size] = size
        after[:, :size][after[:, :size] >= lengths[:, None]] = size
        before = np.tile(np.arange(-1, size), (n, 1))
        before[:, 0] = size
        alive = inside.copy()
        tree = np.full((n, 2 * size), _NONE)
        tree[:, size:] = self.leaf(ids[:, :size], np.take_along_axis(ids, after[:, :size], 1), np.broadcast_to(np.arange(size), (n, size)))
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(r, position, value):
            node = position + size
            tree[r, node] = value
            node >>= 1
            while node[0]:  # all leaves are at one depth
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                node >>= 1

        while True:
            rows = rows[tree[rows, 1] < _NONE]
            if not len(rows):
                break
            best = tree[rows, 1]
            at, rank = best & 0xFFFFFF, best >> 24
            gone = after[rows, at]
            far = after[rows, gone]
            ids[rows, at] = rank
            alive[rows, gone] = False
            after[rows, at] = far
            before[rows, far] = at
            put(rows, gone, _NONE)
            put(rows, at, self.leaf(rank, ids[rows, far], at))
            left = before[rows, at]
            has = left < size
            if has.any():
                r, left = rows[has], left[has]
                put(r, left, self.leaf(ids[r, left], rank[has], left))
        flat = ids[:, :size][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    # one long match ---------------------------------------------------------------------------------------------------------------------
    def merge_one(self, word: bytes) -> bytes:
        n = len(word)
        size = 1 << (n - 1).bit_length()
        none, pairs = 1 << 62, self.pairs
        shift = size.bit_length()
        low = (1 << shift) - 1
        ids, after, before = [int(self.byte_ids[b]) for b in word], list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i, j):
            rank = pairs.get(ids[i] << 32 | ids[j]) if j < n else None
            return none if rank is None else rank << shift | i

        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = leaf(i, i + 1)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i, value):
            node = size + i
            tree[node] = value
            node >>= 1
            while node:
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value
                node >>= 1

        while tree[1] < none:
            rank, at = tree[1] >> shift, tree[1] & low
            gone = after[at]
            far = after[gone]
            ids[at], ids[gone] = rank, -1
            after[at] = far
            if far < n:
                before[far] = at
            put(gone, none)
            put(at, leaf(at, far))
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    # texts ------------------------------------------------------------------------------------------------------------------------------
    def merge(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = np.array([whole], "<u4").tobytes()
            elif len(w) > WIDE:
                out[i] = self.merge_one(w)
            elif w:
                groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for size, all_ in groups.items():
            for at in range(0, len(all_), TOGETHER):
                some = all_[at:at + TOGETHER]
                for i, ids in zip(some, self.merge_many([words[i] for i in some], size)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > MEMO_ENTRIES or self.held > MEMO_BYTES:
            self.memo, self.held = {}, 0
        memo = self.memo
        cut = [self.find(t) if t else [] for t in texts]
        new = list({m for parts in cut for m in parts if m not in memo})
        for match, ids in zip(new, self.merge([m.encode() for m in new])):
            memo[match] = ids
            self.held += len(ids) + len(match)
        return [b"".join([memo[m] for m in parts]) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def codec(path: str, pattern: str) -> RankBpe:
    """One per Python worker, so that the memo serves all its tasks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankBpe(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit integers."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        code = codec(path, pattern)
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(code.encode(batch.column(1).to_pylist()), pa.binary())], schema=out)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, decoded: the bytes that the ids stand for. Null ids decode to nothing."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches):
        code = codec(path, pattern)
        for batch in steps(batches, "ids"):
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.binary()), pa.array([code.decode(x or b"") for x in ids], pa.binary())], schema=out)

    return pick(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id bigint, ids binary, decoded binary")
