"""SentencePiece BPE by a prefix table: for every prefix of a word its unique last token is stored, and the ids are read backwards from the end.

The last token of a prefix is the one match of the vocabulary's automaton ending there that is compatible with the last token of the prefix before
it: two tokens are compatible if merging their joined text gives just these two. No merge loop runs over a text, and a word of n characters costs
O(n) automaton matches, so a text without any space is no worse than another.

Compatibility is decided along the seam. The right edge of the left token and the left edge of the right token are undone in the reverse order of
their merges; the tokens are incompatible if at some time the two symbols at the seam form a piece whose merge would have come first (higher score,
then leftmost). That is exact where every piece is built by merges of higher score than its own, which is checked when a model is loaded; pieces
that merging does not build from their own text can never occur and are left out of the automaton. Pieces that share a score (runs of one
character) are compared by merging the joined text. Answers are remembered per Python worker, as are the ids of words.

No piece holds a space mark after another character, so a text falls into words at its spaces; nor does any go from a letter to the punctuation of
`breaks` (found when the model is loaded), so a word and what ends it are looked up apart. Single characters need no test: where no longer match fits, the
last token is the character. Characters outside the vocabulary become byte pieces
and separate what stands beside them. Models are BPE with byte fallback and identity normalisation; any other is refused with a ValueError.

Inputs. A null or empty text gives the end id alone. Rows are encoded one by one, so ties and repeated rows give repeated results; null ids are kept.
An empty table gives an empty result. Further columns of the input are ignored. Null ids decode to the empty text."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from anchorline.llm.common import pick, steps

#: Entries and bytes of one generation of the memo of words (two are kept, so that what is frequent outlives what is not), and pairs remembered.
MEMO_ENTRIES, MEMO_BYTES, PAIR_ENTRIES = 200_000, 16 << 20, 500_000
#: Rows decoded at once.
ROWS = 1024
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces, fixed by the model format
_LOADED: dict[str, "PrefixBpe"] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at:at + size]
            at += size


class PrefixBpe:
    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer, normalizer = (dict(_fields(next((v for k, v in model if k == n), b""))) for n in (2, 3))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("needs a BPE model with byte fallback, identity normalisation and escaped spaces")
        self.dummy = bool(normalizer.get(3, 1))
        self.pieces, self.bytes, self.ids, score = [], [0] * 256, {}, {}
        self.end = trainer.get(42, 2)
        for i, raw in enumerate(v for k, v in model if k == 1):
            piece = dict(_fields(raw))
            text, kind = piece.get(1, b"").decode(), piece.get(3, _NORMAL)
            self.pieces.append(text)
            if kind == _BYTE:
                self.bytes[int(text[3:5], 16)] = i
            elif kind in (_USER, _UNUSED):
                raise ValueError(f"piece {i} is user-defined or unused")
            elif kind == _NORMAL:
                self.ids[text] = i
                score[i] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
        self.length = [len(p) for p in self.pieces]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character")
        #: Order of merging: pieces of more than one character by falling score; single characters are there from the start.
        order = {s: i for i, s in enumerate(sorted({score[i] for p, i in self.ids.items() if len(p) > 1}, reverse=True))}
        self.rank = [-1] * len(self.pieces)
        times: dict[int, int] = {}
        for p, i in self.ids.items():
            if len(p) > 1:
                self.rank[i] = order[score[i]]
                times[self.rank[i]] = times.get(self.rank[i], 0) + 1
        self.tied = {i for p, i in self.ids.items() if len(p) > 1 and times[self.rank[i]] > 1}
        if any(len(set(self.pieces[i])) > 1 for i in self.tied):
            raise ValueError("pieces of different characters share a score")
        self.characters = {p for p in self.ids if len(p) == 1}
        self.left, self.right = [-1] * len(self.pieces), [-1] * len(self.pieces)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1:
                parts, last, highest = self.merge(p, last_pair=True)
                if parts != [i]:
                    continue
                if highest > self.rank[i]:
                    raise ValueError(f"piece {i} is built by a merge of lower score than its own")
                self.left[i], self.right[i] = last
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        letter = "[A-Za-z\u00c0-\u024f\u0400-\u04ff]"
        inside = {c for p in self.ids for c in re.findall(f"(?<={letter})[!-/:-@\\[-`{{-~\n]", p)}
        self.breaks = "".join(chr(c) for c in [10, *range(33, 127)] if not chr(c).isalnum() and chr(c) not in inside)
        self.stem = re.compile(f"(.*?{letter})([{re.escape(self.breaks)}].*)", re.S).fullmatch if self.breaks else lambda text: None

    def merge(self, text: str, last_pair: bool = False):
        """Ids by the merges themselves, for short texts of known characters; with last_pair also the last two ids merged and the largest rank of a merge."""
        ids: list[int] = [self.ids.get(c, -1) for c in text]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        names, heap, last, highest = list(text), [], (-1, -1), -1

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(ids) and (whole := self.ids.get(names[i] + names[j])) is not None:
                heapq.heappush(heap, (self.rank[whole], i, j, len(names[i]), len(names[j]), whole))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while heap:
            rank, i, j, a, b, whole = heapq.heappop(heap)
            if not names[i] or len(names[i]) != a or after[i] != j or len(names[j]) != b:
                continue
            last, highest = (ids[i], ids[j]), max(highest, rank)
            ids[i], names[i], ids[j], names[j] = whole, names[i] + names[j], -1, ""
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out = [x for x, n in zip(ids, names) if n]
        return (out, last, highest) if last_pair else out

    def compatible(self, a: int, b: int) -> bool:
        if a in self.tied or b in self.tied:
            return self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        ids, pieces, rank = self.ids, self.pieces, self.rank
        until_a = until_b = 1 << 60  # when the symbols at the seam are merged into the next larger one of their own side
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None and rank[joined] < until_a and rank[joined] <= until_b:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                until_a, a = rank[a], self.right[a]
            else:
                until_b, b = rank[b], self.left[b]

    def _known(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        last, length, pairs, ids = [-1] * (len(text) + 1), self.length, self.pairs, self.ids
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if end > n:
                before = last[end - n]
                if before < 0:  # no longer match ended there
                    before = last[end - n] = ids[text[end - n - 1]]
                key = before << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > PAIR_ENTRIES:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(before, token)
                if not fits:
                    continue
            last[end] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            if token < 0:
                token = ids[text[at - 1]]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def _remembered(self, text: str) -> bytes:
        ids = self.memo.get(text)
        if ids is None:
            ids = self.older.get(text)
            if ids is None:
                known = self._known(text)
                ids = struct.pack(f"<{len(known)}i", *known)
            self.memo[text] = ids
            self.held += len(ids) + 2 * len(text)
        return ids

    def word(self, text: str) -> bytes:
        out, characters = [], self.characters
        while text:
            cut = self.stem(text)
            head, text = (cut[1], cut[2]) if cut else (text, "")
            if characters.issuperset(head):
                out.append(self._remembered(head))
                continue
            start = 0
            for i, c in enumerate(head):
                if c not in characters:
                    if i > start:
                        out.append(self._remembered(head[start:i]))
                    out += [struct.pack("<i", self.bytes[x]) for x in c.encode()]
                    start = i + 1
            if start < len(head):
                out.append(self._remembered(head[start:]))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids without the end id, as little-endian 32-bit integers."""
        if len(self.memo) > MEMO_ENTRIES or self.held > MEMO_BYTES:
            self.memo, self.older, self.held = {}, self.memo, 0
        memo, older, front = self.memo, self.older, SPACE if self.dummy else ""
        cut = [self.words(front + t.replace(" ", SPACE)) if t else [] for t in texts]
        for new in set().union(*cut) - memo.keys():
            ids = older.get(new)
            memo[new] = ids = self.word(new) if ids is None else ids
            self.held += len(ids) + 2 * len(new)
        return [b"".join([memo[w] for w in words]) for words in cut]


def codec(path: str) -> PrefixBpe:
    """One per Python worker, so that the memos serve all its tasks."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of the whole text and the end id."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        code = codec(path)
        end = struct.pack("<i", code.end)
        for batch in steps(batches):
            done = [x + end for x in code.encode(batch.column(1).to_pylist())]
            ends = np.cumsum([0, *[len(x) // 4 for x in done]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(done), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], schema=out)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, decoded: the text that the sentencepiece library's decode gives for the ids."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = batch.column(1).cast(pa.list_(pa.int32()))
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist()
                text = [library.decode(flat[a:b]) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids, pa.array(text, pa.string())], schema=out)

    return pick(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
