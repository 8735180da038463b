"""Exact encoding by the tokenizers library with a bounded memo of what stands between spaces.

Both supported kinds of vocabulary never let a token cross from a non-space character to a space: byte-level vocabularies take a space only
as the first character of a piece, word vocabularies drop white space. A text cut at those places therefore encodes to the same ids, and most
of the cut parts have been seen before. Nor does a token cross from a letter to the punctuation that ends a part, so a word and its
punctuation are remembered apart. New words of letters alone are one piece for the library's model; all else goes through its whole chain.
Any other kind of tokenizer encodes whole texts, and so does a text that holds the first two characters of an added token ("<|"), as the library gives
such a token inside a text its own id."""

from __future__ import annotations

import json
import os
import re
from struct import Struct

#: Entries of one generation of the memo, about 150 bytes each. Two are kept, so that what is frequent outlives what is not.
MEMO_ENTRIES = 900_000
_GAP = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S) ")
_STEM = re.compile(r"(.*[^\W\d_])([!-/:-@\[-^`{-~]+)", re.S)
_LOADED: dict[tuple[str, int | None], "MemoTokenizer"] = {}


#: Packers of up to 63 ids.
_PACK = [Struct(f"<{n}I").pack for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 64 else Struct(f"<{len(ids)}I").pack(*ids)


class MemoTokenizer:
    def __init__(self, path: str, entries: int | None = None):
        """`entries`: those of one generation of the memo, where a worker has less room than MEMO_ENTRIES take."""
        self.entries = entries
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model, self.normalizer = self.library.model, self.library.normalizer
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        before, normal = plan.get("pre_tokenizer") or {}, plan.get("normalizer") or {}
        steps = before.get("pretokenizers", [])
        self.kind = "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
            self.kind = "byte"
        elif steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and {"type": "Lowercase"} in normal.get("normalizers", []):
            self.kind = "word"
        #: Texts that hold one of these go through the library whole.
        self.marks = {t["content"][:2] for t in plan.get("added_tokens", [])}
        if any(m.lower() != m.upper() for m in self.marks):
            self.kind = "whole"
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        # the characters that stand for bytes, as the library's byte level gives them
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.characters: dict[int, str] = {}
        for c in [*range(0x800), *range(0x800, 0xD800, 0x100), *range(0xE000, 0x10000, 0x100), *range(0x10000, 0x110000, 0x1000)]:
            for byte, shown in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0]):
                self.characters[byte] = shown
        self.space = self.characters[32] if self.kind == "byte" else ""
        self.memo: dict[str, bytes] = {}  # parts that follow a space
        self.older: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # parts that do not: the first of a text, and ending punctuation

    def parts(self, text: str) -> list[str]:
        """The first part, then what follows each cut. A part that starts with a line end or a space has no space before it, any other has."""
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        if text[:1] not in (" ", "\n") and not _GAP.search(text):
            return text.replace("\n", " \n").split(" ")
        first, *rest = _CUT.split(text)
        return [first, *[" " + p if not p or p[0].isspace() else p for p in rest]]

    def _chain(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_bare(self, parts: set[str]) -> None:
        """Ids of parts that do not follow a space, all at once."""
        new = [p for p in parts if p not in self.bare]
        self.bare.update(zip(new, self._chain(new)))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of parts after the first."""
        out: list[bytes] = [b""] * len(words)
        rest, byte, line = [], self.kind == "byte", self.bare.get("\n", b"")
        for i, word in enumerate(words):
            on_line = byte and word[:1] == "\n"
            plain = word[1:] if on_line else word if byte or (word.isascii() and word.islower()) else self.normalizer.normalize_str(word)
            if not plain.isalpha() or len(plain) > 1000:
                rest.append(i)
                continue
            if not plain.isascii():
                plain = plain.encode().decode("latin-1").translate(self.characters)
            ids = _packed([t.id for t in self.model.tokenize(plain if on_line else self.space + plain)])
            out[i] = line + ids if on_line else ids
        for at in range(0, len(rest), 2000):
            some = rest[at:at + 2000]
            for i, ids in zip(some, self._chain([" " + words[i] if byte and words[i][:1] not in (" ", "\n") else words[i] for i in some])):
                out[i] = ids
        return out

    def _learn(self, new: set[str]) -> None:
        memo, older = self.memo, self.older
        words, stems, split = [], set(), []
        old = new & older.keys()
        memo.update(zip(old, map(older.__getitem__, old)))
        for part in new - old:
            if part[-1].isalnum() or not (cut := _STEM.fullmatch(part)):
                words.append(part)
            else:
                split.append((part, cut[1], cut[2]))
                stems.add(cut[1])
        for stem in stems - memo.keys() - new:
            if stem in older:
                memo[stem] = older[stem]
            else:
                words.append(stem)
        memo.update(zip(words, self._words(words)))
        self._learn_bare({tail for _, _, tail in split})
        for part, stem, tail in split:
            memo[part] = memo[stem] + self.bare[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for a null or empty text."""
        if self.kind == "whole":
            done = iter(self._chain([t for t in texts if t]))
            return [next(done) if t else b"" for t in texts]
        most = self.entries or MEMO_ENTRIES
        if len(self.memo) > most:
            self.memo, self.older = {}, self.memo
        if len(self.bare) > most // 30:
            self.bare = {}
        whole = [i for i, t in enumerate(texts) if t and any(m in t for m in self.marks)]
        cut = [self.parts(t) if t else [""] for t in texts]
        for i in whole:
            cut[i] = [""]
        heads = [p.pop(0) for p in cut]
        self._learn_bare({*heads, " ", "\n"})
        new = set().union(*cut) - self.memo.keys()
        new.discard("")
        self._learn(new)
        self.memo[""] = self.bare[" "] if self.kind == "byte" else b""
        find, bare = self.memo.__getitem__, self.bare
        out = [bare[head] + b"".join(map(find, p)) for head, p in zip(heads, cut)]
        for i, ids in zip(whole, self._chain([texts[i] for i in whole])):
            out[i] = ids
        return out


def tokenizer(path: str, entries: int | None = None) -> MemoTokenizer:
    """One per Python worker, so that the memo serves all its tasks."""
    if (path, entries) not in _LOADED:
        _LOADED[path, entries] = MemoTokenizer(path, entries)
    return _LOADED[path, entries]


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies keep a file."""
    import public_tokenizers
    return public_tokenizers.path(name)
