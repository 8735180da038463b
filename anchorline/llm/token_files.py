"""Token ids as fixed-width bit-packed files.

Every id takes the fewest bits that hold the vocabulary's largest id. Documents are range-partitioned by id and sorted; each partition is one
shard, a run of blocks. A block row holds whole documents and about `block_tokens` ids: the bit stream, which starts on a byte, the number of
ids before it in its shard, and the documents' ids and their offsets in the block. Any id is at bit `bits * position` of its block, so one
document, or any range, is read without the rest of the block, and a block unpacks in a few numpy operations. The shards are Parquet files of
such rows, written and read by Spark, so they lie on whatever store the cluster uses, and `first_token` and `first_doc` are columns whose
statistics let a reader skip to the block it wants.

Inputs. A null text counts as empty; an empty text has its end id alone. Null ids come first. Rows with equal ids each have their own entry,
in the order of their text keys. An empty table gives no blocks. Further columns of the input are ignored."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm.common import pick, spread, steps, text_key
from anchorline.llm.tokens import tokenizer
from anchorline.session import checkpoint_dir

BLOCK = "shard int, block int, bits int, first_token bigint, n_tokens bigint, first_doc bigint, doc_ids array<bigint>, doc_offsets array<bigint>, payload binary"
_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
                    ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())), ("payload", pa.binary())])


def width(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


#: Widths at which the stream is an array of little-endian integers.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first: id i fills bits [i * bits, (i + 1) * bits) of the stream."""
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    planes = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from position `start`, touching only the bytes that hold them."""
    if not n:
        return np.zeros(0, "<u4")
    if bits in _WHOLE:
        return np.frombuffer(payload, _WHOLE[bits], n, start * bits // 8).astype("<u4")
    lo, hi = start * bits, (start + n) * bits
    stream = np.unpackbits(np.frombuffer(payload, np.uint8, -(-hi // 8) - lo // 8, lo // 8), bitorder="little")[lo % 8:lo % 8 + n * bits]
    planes = np.zeros((n, 32), np.uint8)
    planes[:, :bits] = stream.reshape(n, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").ravel()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, block_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append the end id, and write the shards in ascending order of id."""
    def run(batches):
        shard, code, end = TaskContext.get().partitionId(), tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        bits = width(max(code.vocabulary, end_id + 1))
        first = block = held = 0
        docs_, parts = [], []

        def close():
            nonlocal first, block, held
            offsets = np.cumsum([0, *[len(x) // 4 for x in parts]])
            row = [shard, block, bits, first, held, docs_[0], list(docs_), offsets.tolist(), pack_bits(np.frombuffer(b"".join(parts), "<u4"), bits)]
            first, block, held = first + held, block + 1, 0
            docs_.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK.types)], schema=_BLOCK)

        for batch in steps(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode(batch.column(1).to_pylist())):
                docs_.append(doc)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= block_tokens:
                    yield close()
        if parts:
            yield close()

    rows = pick(docs, doc_id=id_col, text=text_col)
    order = [F.col("doc_id").asc_nulls_first(), text_key()]
    dealt = rows.repartitionByRange(spread(docs), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, BLOCK).write.parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `start`, the number of ids in all blocks before: shard sizes are summed (a row per shard), not the documents."""
    read = spark.read.schema(BLOCK).parquet(path)
    shards = read.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    before, total = [], 0
    for s, n in sorted((r["shard"], r["n"]) for r in shards):
        before.append((s, total))
        total += n
    offsets = spark.createDataFrame(before, "shard int, shard_start bigint")
    return read.join(F.broadcast(offsets), "shard").withColumn("start", F.col("shard_start") + F.col("first_token")).drop("shard_start")  # a row per written file


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens and its unpacked ids (little-endian unsigned 32-bit integers)."""
    def run(batches):
        out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                ids, offsets = unpack_bits(r["payload"], r["bits"], 0, r["n_tokens"]), r["doc_offsets"]
                rows = [(d, r["start"] + a, b - a, ids[a:b].tobytes()) for d, a, b in zip(r["doc_ids"], offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), out.types)], schema=out)

    return blocks(spark, path).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_slice(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document's rows, from the blocks whose statistics admit it."""
    near = spark.read.schema(BLOCK).parquet(path).where((F.col("first_doc") <= doc_id) & F.array_contains("doc_ids", doc_id))
    out = []
    for r in near.orderBy("shard", "block").toLocalIterator():
        for d, a, b in zip(r["doc_ids"], r["doc_offsets"], r["doc_offsets"][1:]):
            if d == doc_id:
                out.append(unpack_bits(bytes(r["payload"]), r["bits"], a, b - a))
    return out


def scratch(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark)}/anchorline/{label}-{uuid.uuid4().hex}"


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)
