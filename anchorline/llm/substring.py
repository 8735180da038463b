"""Removal of word windows that occur more than once.

Every window of `window` consecutive words is hashed (Rabin-Karp: polynomial hashes of words, then a polynomial over the words, from running sums), and a
window is repeated if its hash starts anywhere else, in the same document or another. Windows are counted where they meet: each belongs to its anchor,
the smallest hash among its runs of `anchor` words, so equal windows have equal anchors, and neighbouring windows mostly share one. A row of the shuffle
is a run of neighbouring windows with one anchor, with the 64 bits of each window's hash; that is a few bytes per window instead of a record. Before the
shuffle a step counts its own windows: those repeated inside it are settled, and of each only one goes on, so a passage that every document holds costs
one row per step.

A phrase of an anchor's length, or a passage, may stand in any share of the documents. A first pass therefore counts the windows that each anchor sends. The
rows of an anchor with more than GROUP of them are dealt over as many parts as keep about GROUP windows in each. A part settles what it holds twice and sends
one witness of each of its windows on, and the witnesses of a window meet by its hash: there are no more of them than parts. So neither a phrase in windows that all
differ nor one window that every step sends makes a group that grows with the table before an anchor has GROUP x GROUP windows. The anchors above GROUP are a written table;
Spark broadcasts it where its size allows and joins by shuffle where not. Nothing of it passes through the driver.

Repeated windows of a document merge into maximal intervals of words, which are joined back to the texts.

Words are separated by ASCII white space and compared unchanged. `spans` gives the intervals, `apply` the cut texts: from the first removed word up to the
next kept one, what stands between kept words stays as it was.

Inputs. A null or empty text, or one with fewer words than a window, loses nothing; a null text stays null. Rows with a null id, equal ids or equal rows take
part like any other, so a repeated row loses every window. An empty table gives an empty result. Further columns of the input are ignored, or passed
through by `apply`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.llm.common import column, pick, spread, steps, text_key
from anchorline.llm.components import whole_runs
from anchorline.session import stage

#: Text bytes counted together before the shuffle.
STEP = 2 << 20
#: Windows that one task compares together.
GROUP = 1 << 18
#: Odd multipliers of the two polynomials, and of the final mixing (the 64-bit finaliser of MurmurHash3). Fixed values.
WORD, SEQUENCE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_U = np.uint64
_ROW = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())])
#: An interval, or with a hash the witness of a window of a dealt anchor; `once`: its part holds it once.
_FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64()), ("once", pa.bool_())])
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        p = np.full(max(n, 1 << 16), base & (2**64 - 1), _U)
        p[0] = 1
        got = _POWERS[base] = np.cumprod(p, dtype=_U)
    return got[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(MIX[0])
    x = (x ^ (x >> _U(33))) * _U(MIX[1])
    return x ^ (x >> _U(33))


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a byte array."""
    inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hash_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word's bytes, mixed with its length."""
    length = end - start
    flat = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)  # position in the word
    value = (raw[np.repeat(start, length) + flat].astype(_U) + _U(1)) * _powers(WORD, int(length.max(initial=1)))[flat]
    sums = np.add.reduceat(value, np.cumsum(length) - length) if len(start) else np.zeros(0, _U)
    return _mix(sums + length.astype(_U) * _U(WORD))


class Windows:
    """Rolling hashes over a word sequence: the hash of words [i, i + size) from two running sums."""

    def __init__(self, words: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(words * _powers(SEQUENCE, len(words)), dtype=_U)])
        self.n = len(words)

    def of(self, size: int) -> np.ndarray:
        m = self.n - size + 1
        return _mix((self.sums[size:size + m] - self.sums[:m]) * _powers(pow(SEQUENCE, -1, 2**64), m)) if m > 0 else np.zeros(0, _U)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every `size` neighbours, by doubling."""
    done, m = 1, x
    while 2 * done <= size:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = size - done
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def _windows(batch: pa.RecordBatch, window: int, anchor: int):
    """Of the windows that go on or are settled: first word, hash, anchor, document, first word of each document, and which are the first of their hash or repeated here."""
    texts = [t.encode() if t else b"" for t in batch.column(2).to_pylist()]
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    start, end = words_of(raw)
    if len(start) < window:
        return None
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    doc = np.searchsorted(bounds, start, "right") - 1
    first_word = np.searchsorted(doc, np.arange(len(texts)))
    rolling = Windows(hash_words(raw, start, end))
    m = len(start) - window + 1
    hashes, anchors = rolling.of(window), sliding_min(rolling.of(anchor), window - anchor + 1)
    at = np.flatnonzero(doc[:m] == doc[window - 1:])
    if not len(at):
        return None
    hashes, anchors = hashes[at], anchors[at]
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    counts = np.diff([*np.flatnonzero(new), len(order)])
    first, repeated = np.zeros(len(at), bool), np.zeros(len(at), bool)
    first[order[new]] = True
    repeated[order] = np.repeat(counts > 1, counts)
    return at, hashes, anchors, doc, first_word, first, repeated


def _count_rows(batch: pa.RecordBatch, window: int, anchor: int) -> list[pa.RecordBatch]:
    """How many windows of each anchor go on."""
    got = _windows(batch, window, anchor)
    if got is None:
        return []
    own, n = np.unique(got[2][got[5]], return_counts=True)
    return [pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["anchor", "n"])]


def _window_rows(batch: pa.RecordBatch, window: int, anchor: int) -> list[pa.RecordBatch]:
    got = _windows(batch, window, anchor)
    if got is None:
        return []
    at, hashes, anchors, doc, first_word, first, repeated = got
    doc_id, key = batch.column(0).cast(pa.int64()), batch.column(1)
    out = []

    def rows(keep, same, hashed):
        i = np.flatnonzero(keep)
        if not len(i):
            return
        fresh = np.concatenate([[True], (at[i][1:] != at[i][:-1] + 1) | (same[i][1:] != same[i][:-1])])
        head = np.flatnonzero(fresh)
        size = np.diff([*head, len(i)])
        word, where = at[i[head]], doc[at[i[head]]]
        if hashed:
            data = hashes[i].astype("<u8").tobytes()
            blobs = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size) * 8]).astype(np.int32)), pa.py_buffer(data)])
            keyed = anchors[i[head]].view(np.int64)
        else:
            blobs, keyed = pa.nulls(len(head), pa.binary()), _mix(word.astype(_U)).view(np.int64)
        out.append(pa.RecordBatch.from_arrays([pa.array(keyed), doc_id.take(pa.array(where)), key.take(pa.array(where)), pa.array(word - first_word[where]), pa.array(size), blobs], schema=_ROW))

    rows(first, anchors, True)
    rows(repeated, doc[at], False)
    return out


def _spans_of(batches, window: int):
    """Rows of one anchor, or of a part of it, together: intervals of the windows that stand in two rows, those a step has settled, and the witnesses of a part."""
    for table, starts in whole_runs(batches, ["anchor"]):
        n = table.num_rows
        doc_id, key = table.column("doc_id").combine_chunks(), table.column("text_key").combine_chunks()
        at, size = table.column("start").to_numpy(), table.column("n").to_numpy()
        blobs, dealt = table.column("hashes").combine_chunks(), table.column("parts").to_numpy() > 1
        settled = np.asarray(blobs.is_null())
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
        many = np.bincount(group, ~settled, minlength=len(starts)) > 1
        wanted = np.flatnonzero((many[group] | dealt) & ~settled)

        def found(who, begin, end, hashes=None, once=None):
            m, i = len(who), pa.array(who)
            return pa.RecordBatch.from_arrays([doc_id.take(i), key.take(i), pa.array(begin), pa.array(end), pa.nulls(m, pa.int64()) if hashes is None else pa.array(hashes.view(np.int64)),
                                               pa.nulls(m, pa.bool_()) if once is None else pa.array(once)], schema=_FOUND)

        if settled.any():
            i = np.flatnonzero(settled)
            yield found(i, at[i], at[i] + size[i] + window - 1)
        if not len(wanted):
            continue
        value = np.frombuffer(b"".join(blobs.take(pa.array(wanted)).to_pylist()), "<u8")
        row = np.repeat(wanted, size[wanted])
        offset = np.arange(len(row)) - np.repeat(np.cumsum(size[wanted]) - size[wanted], size[wanted])
        order = np.lexsort((value, group[row]))
        v, g = value[order], group[row][order]
        same = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
        twice = np.zeros(len(row), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        i = np.flatnonzero(twice)
        if len(i):
            fresh = np.concatenate([[True], (i[1:] != i[:-1] + 1) | (row[i][1:] != row[i][:-1])])
            head = np.flatnonzero(fresh)
            length = np.diff([*head, len(i)])
            who, begin = row[i[head]], at[row[i[head]]] + offset[i[head]]
            yield found(who, begin, begin + length + window - 1)
        lead = order[np.concatenate([[True], ~same])]
        lead = lead[dealt[row[lead]]]
        if len(lead):
            begin = at[row[lead]] + offset[lead]
            yield found(row[lead], begin, begin + window, value[lead], ~twice[lead])


def spans(docs: DataFrame, window: int = 35, anchor: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, start, end): words [start, end) of a document that repeated windows cover; intervals of one document may touch or overlap."""
    anchor = min(anchor, window)
    texts = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_key().alias("text_key"), "text")

    def tally(batches):
        for batch in steps(batches, size=STEP):
            yield from _count_rows(batch, window, anchor)

    large = stage(texts.mapInArrow(tally, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP)
                  .select("anchor", F.ceil(F.col("n") / GROUP).cast("bigint").alias("parts")), "anchors")

    def find(batches):
        for batch in steps(batches, size=STEP):
            yield from _window_rows(batch, window, anchor)

    rows = texts.mapInArrow(find, "anchor bigint, doc_id bigint, text_key bigint, start bigint, n bigint, hashes binary").join(large, "anchor", "left")
    part = F.xxhash64("anchor", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.col("parts")))
    dealt = rows.withColumn("anchor", F.when(F.col("parts").isNull() | F.col("hashes").isNull(), F.col("anchor")).otherwise(part)).withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    met = dealt.repartition(spread(docs), "anchor").sortWithinPartitions("anchor")
    found = stage(met.mapInArrow(lambda b: _spans_of(b, window), "doc_id bigint, text_key bigint, start bigint, end bigint, hash bigint, once boolean"), "windows")
    seen = found.where("hash IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("hash"))).where("once AND n > 1")
    return found.where("hash IS NULL").unionByName(seen.drop("n")).select("doc_id", "text_key", "start", "end")


def cut(text: str | None, spans_: list) -> tuple[str | None, int, int]:
    """The text without the words of the intervals; its number of words, and of removed ones."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    start, end = words_of(raw)
    n = len(start)
    if not spans_:
        return text, n, 0
    gone = np.zeros(n + 1, np.int64)
    for s in spans_:
        gone[s["start"]] += 1
        gone[s["end"]] -= 1
    gone = np.cumsum(gone)[:n] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    pieces, at = [], 0
    limits = [*start.tolist(), len(raw)]
    for a, b in zip(edge[::2], edge[1::2]):  # maximal intervals
        pieces.append(raw[at:limits[a]].tobytes())
        at = limits[b]
    pieces.append(raw[at:].tobytes())
    return b"".join(pieces).decode(), n, int(gone.sum())


def apply(docs: DataFrame, window: int = 35, anchor: int = 8, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """The input with repeated windows cut out of its text column. `counts` names two columns to add: words, and words removed."""
    found = (spans(docs, window, anchor, id_col, text_col).groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"))
             .agg(F.collect_set(F.struct("start", "end")).alias("__spans")))  # a document's own intervals
    joined = docs.join(found, column(id_col).eqNullSafe(F.col("__doc")) & (text_key(text_col) == F.col("__key")), "left").drop("__doc", "__key")
    names = [c for c in joined.columns if c != "__spans"]
    schema = docs.select(*[column(c) for c in names]).schema.add("__words", "long").add("__removed", "long")

    def run(batches):
        for batch in steps(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            done = [cut(t, s or []) for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            texts, n, gone = zip(*done)
            columns = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "__words", "__removed"])

    out = joined.select(*[column(c) for c in names], "__spans").mapInArrow(run, schema)
    return out.withColumnsRenamed({"__words": counts[0], "__removed": counts[1]}) if counts else out.drop("__words", "__removed")
