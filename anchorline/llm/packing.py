"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of floor(capacity / k) tokens, and a sequence of class k is full with k of
them. Instead of padding every piece up to its class, a document is cut greedily at class sizes (a long document first into whole sequences),
which takes two to four pieces for a document because the rest shrinks quadratically. Each Spark task fills the sequences of its own rows; no
shuffle, no shared state. What is left in a task's unfilled classes at its end is laid end to end, and the last part, shorter than a sequence,
is cut at powers of two, so that it needs no padding either.

Inputs. A null text counts as empty; an empty text still has its end id. Rows with equal ids, or equal rows, are packed one by one. A null
id is kept as null. An empty table gives an empty result. Further columns of the input are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import STEP_BYTES, pick, steps
from anchorline.llm.tokens import tokenizer

PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, offset bigint"
_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
_OUT = pa.schema([("sequence_id", pa.int64()), ("length", pa.int64()), ("padded_length", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])
#: Sequences that go into one Arrow batch of the result.
BATCH = 256


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Class sizes that add up to n, largest first. A part below the square root of the capacity is a class of its own."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        size = capacity // -(-capacity // n)  # the largest class not above n
        out.append(size)
        n -= size
    return out


class _Worker:
    """The open sequences of one task: under one sequence for each class."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}
        self.done: list = []

    def close(self, pieces: list) -> None:
        offset, laid = 0, []
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            laid.append({"doc_id": doc, "start": start, "length": n, "doc_tokens": total, "offset": offset})
            offset += n
        padded = offset if offset & (offset - 1) == 0 else self.capacity
        self.done.append((self.next_id, offset, padded, b"".join(p[2] for p in pieces), laid))
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total = start = len(ids) // 4
        start = 0
        for n in piece_lengths(total, self.capacity):
            piece = (doc, start, ids[4 * start:4 * (start + n)], total)
            start += n
            pieces = self.open.setdefault(n, [])
            pieces.append(piece)
            if len(pieces) == self.capacity // n:
                self.close(self.open.pop(n))

    def finish(self) -> None:
        """Unfilled classes end to end, longest pieces first; the last part at powers of two."""
        rest = [p for n in sorted(self.open, reverse=True) for p in self.open[n]]
        self.open = {}
        left = sum(len(p[2]) // 4 for p in rest)
        current, room = [], min(self.capacity, left)
        if left < self.capacity and left:
            room = 1 << (left.bit_length() - 1)
        while rest:
            doc, start, ids, total = rest.pop(0)
            n = min(len(ids) // 4, room)
            current.append((doc, start, ids[:4 * n], total))
            if n < len(ids) // 4:
                rest.insert(0, (doc, start + n, ids[4 * n:], total))
            room, left = room - n, left - n
            if not room:
                self.close(current)
                current, room = [], self.capacity if left >= self.capacity else 1 << max(0, left.bit_length() - 1)

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        while self.done and len(self.done) >= least:
            some, self.done = self.done[:BATCH], self.done[BATCH:]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), _OUT.types)], schema=_OUT)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
         memo: int | None = None, step: int = STEP_BYTES) -> DataFrame:
    """Packed sequences: sequence_id, length, padded_length (the capacity, or the length itself where that is a power of two), ids (little-endian
    unsigned 32-bit integers, without padding) and the pieces they are made of. Sequence ids are unique over all tasks.

    `memo` and `step` bound what a worker remembers and cuts at once, not the result: parts in a generation of the memo, bytes of text."""
    def run(batches):
        worker = _Worker(capacity, TaskContext.get().partitionId() << 36)
        code, end = tokenizer(tokenizer_path, memo), np.array([end_id], "<u4").tobytes()
        for batch in steps(batches, size=step):
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode(batch.column(1).to_pylist())):
                worker.add(doc, ids + end)
            yield from worker.flush(BATCH)
        worker.finish()
        yield from worker.flush(1)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"sequence_id bigint, length bigint, padded_length bigint, ids binary, pieces array<struct<{PIECE.replace(' bigint', ':bigint')}>>")


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece, with the checksum of its ids taken from the packed sequence."""
    p = F.col("p")
    return (sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
            .select(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"),
                    F.crc32(F.substring(F.col("ids"), (p["offset"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))).alias("ids_crc32"),
                    p["doc_tokens"].alias("doc_tokens"), "sequence_id", p["offset"].alias("offset")))
