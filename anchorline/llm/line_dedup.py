"""Line de-duplication by range-partitioned line hashes.

Every line's 128-bit hash goes to a range partition, sorted by (hash, document, position), and a stream over the sorted rows sees the first
document of each line before any other. The ranges are cut over (hash, document, position), so one line that a third of all documents hold is
spread over many partitions like any other rows. Such a line may begin in an earlier partition: each partition therefore also reports the
smallest document of its first and last line, and the rows of its first line are decided against those reports, which are broadcast (two rows
per partition).
The decisions come back as one compressed keep bitmap per document, never as text.

A line's key is the line without white space at its ends, with A-Z lower-cased. Keys of fewer than `min_chars` code points never count.

Inputs. A null or empty text is one empty line, which is kept. Rows with a null id take no part and keep all lines. Rows with equal ids count as
one document; equal rows share one bitmap. An empty table gives an empty result. Further columns of the input are ignored, or passed through by
`apply`."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import column, pick, spread, steps, text_key
from anchorline.session import stage

SPACE = b" \t\n\x0b\x0c\r"
_LINES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int64())])
_SEEN = pa.schema([*_LINES, ("kind", pa.int32())])
#: What a stream says of a row: dropped, undecided because its line may begin before this partition, or a report of a line's first document.
DROPPED, OPEN, REPORT = 0, 1, 2


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(k1, k2, doc_id, text_key, pos): one row per line whose key is long enough."""
    def run(batches):
        for batch in steps(batches):
            hashes, ids, keys, at = bytearray(), [], [], []
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if doc is None or not text:
                    continue
                for i, line in enumerate(text.encode().split(b"\n")):
                    line = line.strip(SPACE)
                    if len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars):
                        hashes += xxhash.xxh3_128_digest(line.lower())
                        ids.append(doc)
                        keys.append(key)
                        at.append(i)
            pair = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(at, pa.int64())], schema=_LINES)

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, text_key bigint, pos bigint")


def _stream(batches):
    """First occurrences over rows sorted by (k1, k2, doc_id, pos). Holds one Arrow batch and the first document of the line it is in."""
    line, first, opening = None, None, None
    part = TaskContext.get().partitionId()

    def rows(arrays, kind):
        n = len(arrays[0])
        return pa.RecordBatch.from_arrays([*[pa.array(a, pa.int64()) for a in arrays], pa.array(np.full(n, kind, np.int32))], schema=_SEEN)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k1, k2, doc, key, pos = (c.to_numpy() for c in batch.columns)
        new = np.empty(n, bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new[0] = line != (k1[0], k2[0])
        if line is None:
            opening = (k1[0], k2[0])
            yield rows([[k1[0]], [k2[0]], [doc[0]], [0], [part]], REPORT)
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        head = np.where(start >= 0, doc[np.maximum(start, 0)], first if first is not None else 0)
        undecided = (k1 == opening[0]) & (k2 == opening[1])
        drop = (doc != head) & ~undecided
        yield rows([x[drop] for x in (k1, k2, doc, key, pos)], DROPPED)
        yield rows([x[undecided] for x in (k1, k2, doc, key, pos)], OPEN)
        line, first = (k1[-1], k2[-1]), head[-1]
    if line is not None and line != opening:
        yield rows([[line[0]], [line[1]], [first], [0], [part]], REPORT)


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_key, pos) of every line that an earlier document holds."""
    lines = stage(line_hashes(docs, min_chars), "lines")  # range partitioning reads its input twice
    order = ["k1", "k2", "doc_id", "pos"]
    seen = stage(lines.repartitionByRange(spread(docs), *order).sortWithinPartitions(*order)
                 .mapInArrow(_stream, "k1 bigint, k2 bigint, doc_id bigint, text_key bigint, pos bigint, kind int"), "seen")
    # at most two rows per range partition, so its size is bounded by the number of partitions
    firsts = seen.where(F.col("kind") == REPORT).groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    decided = seen.where(F.col("kind") == OPEN).join(F.broadcast(firsts), ["k1", "k2"]).where(F.col("doc_id") > F.col("first"))
    names = ["doc_id", "text_key", "pos"]
    return seen.where(F.col("kind") == DROPPED).select(*names).unionByName(decided.select(*names))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_lines, n_dropped, keep: one row per distinct (id, text); keep is a zlib-compressed bitmap with a bit per line."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    lost = dropped_lines(rows, min_chars).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("lost"))
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = rows.select("doc_id", text_key().alias("text_key"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines")).distinct()
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])

    def run(batches):
        for batch in batches:
            doc, key, n_lines, gone = (c.to_pylist() for c in batch.columns)
            maps = []
            for n, lost_ in zip(n_lines, gone):
                keep = np.ones(n, bool)
                keep[np.array(lost_ or [], np.int64)] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc, key, n_lines, [len(x or []) for x in gone], maps), out.types)], schema=out)

    return sizes.join(lost, ["doc_id", "text_key"], "left").select("doc_id", "text_key", "n_lines", "lost").mapInArrow(run, "doc_id bigint, text_key bigint, n_lines bigint, n_dropped bigint, keep binary")


def kept_text(text: str | None, n_lines: int, keep: bytes) -> str | None:
    """The lines that a keep bitmap keeps, joined again."""
    if text is None:
        return None
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    return "\n".join([line for line, bit in zip(text.split("\n"), bits.tolist()) if bit])


def apply(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """The input with the text column cut down to its kept lines; a null text stays null. `counts` names two columns to add: lines, and lines dropped."""
    maps = keep_bitmaps(docs, min_chars, id_col, text_col).withColumnsRenamed({"doc_id": "__doc", "text_key": "__key", "n_lines": "__n", "n_dropped": "__gone", "keep": "__keep"})
    joined = docs.join(maps, (column(id_col).eqNullSafe(F.col("__doc"))) & (text_key(text_col) == F.col("__key")), "left").drop("__doc", "__key")
    names, at = joined.columns, joined.columns.index(text_col)

    def run(batches):
        n_at, gone_at, keep_at = names.index("__n"), names.index("__gone"), names.index("__keep")
        for batch in steps(batches, text_col):
            texts = batch.column(at).to_pylist()
            if any(g for g in batch.column(gone_at).to_pylist()):
                parts = zip(texts, *(batch.column(i).to_pylist() for i in (n_at, gone_at, keep_at)))
                texts = [kept_text(t, n, k) if g else t for t, n, g, k in parts]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = joined.mapInArrow(run, joined.schema)
    if counts:
        out = out.withColumnsRenamed({"__n": counts[0], "__gone": counts[1]})
    return out.drop("__n", "__gone", "__keep")
