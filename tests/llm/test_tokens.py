"""Encoders against the libraries, bit packing and its files, packed sequences."""
import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llmhelp import documents, odd_rows, prose
from tokenizers import Tokenizer

from anchorline.llm import byte_bpe, packing, token_files, tokens

ODD = ["", " ", "a", "  a   b \n\n  c\t\td", " " * 50, " x", "x ", "x\n", "\nx", "a\nb", "a\n\nb", "a \nb", "a\n b", "a.\nB", "it's we'll I'M x\x1c y \x85 z  w", "<|endoftext|> hi <|startoftext|>", "a <|endoftext|> b", "x<|ENDOFTEXT|>y <| endoftext|>", "<|startoftext|>", "日本語のテキスト \U0001f389 عربى " * 9,
       "é café. ΑΣ Σ. İstanbul ǅ ﬁ straße a_b 1st 2² x²! y½, a'b' don't' 's ​zero ﻿x Ⅷ. ªº x̀! K Å é. ́", "a" * 3000, "ab" * 999]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_encodes_as_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 50)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab ,.'!\n1é́Σ_- ") for _ in range(200)) for _ in range(200)] + [prose(rng, 200)]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    mine = tokens.MemoTokenizer(public_tokenizers.path(name))
    for at in range(0, len(texts), 7):
        for text, ids in zip(texts[at:at + 7], mine.encode(texts[at:at + 7])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert mine.encode([None, ""]) == [b"", b""]


def test_rank_bpe_encodes_as_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ODD + ["".join(chr(rng.choice([32, 10, 0xe9, 0x4e00 + rng.randrange(2000), rng.randrange(33, 127)])) for _ in range(400)) for _ in range(20)] + ["é" * 70, "abc" * 40]
    docs = documents(spark, [*texts, None])
    done = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    for r in done.collect():
        text = (texts + [None])[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()


def test_both_trees_merge_alike():
    code = byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 33))).encode() for _ in range(300)]
    assert code.merge_many(words, 32) == [code.merge_one(w) for w in words]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype("<u4")
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (token_files.unpack_bits(packed, bits, 0, 1001) == ids).all()
    for start, n in ((0, 0), (3, 1), (7, 500), (1000, 1)):
        assert (token_files.unpack_bits(packed, bits, start, n) == ids[start:start + n]).all()
    assert token_files.width(50257) == 16 and token_files.width(2) == 1 and token_files.width(65537) == 17


def test_token_files_in_order_of_id(spark):
    docs, rows = odd_rows(spark)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = token_files.scratch(spark, "files")
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), block_tokens=500)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    want = sorted((r[0] or -1, [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows)
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    assert token_files.read_slice(spark, path, 4)[0].tolist() == next(w for d, w in want if d == 4)
    empty = token_files.scratch(spark, "files")
    token_files.write(docs.limit(0), empty, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_documents(spark, empty).count() == 0


def test_piece_lengths_are_classes_and_add_up():
    for n in [*range(0, 300), 2048, 4095, 4096, 4097, 10000]:
        got = packing.piece_lengths(n, 4096)
        assert sum(got) == n and all(4096 // (4096 // k) == k for k in got)


def test_packed_sequences_hold_every_id_once(spark):
    docs, rows = odd_rows(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    sequences = packing.pack(docs, path, capacity=256)
    for s in sequences.collect():
        assert s["length"] <= 256 and len(s["ids"]) == 4 * s["length"] and sum(p["length"] for p in s["pieces"]) == s["length"]
        assert s["padded_length"] == (s["length"] if s["length"] & (s["length"] - 1) == 0 else 256)
    pieces = packing.pieces(sequences).collect()
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
    want = {}
    for doc, text, *_ in rows:
        want.setdefault(doc, []).append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    total = sum(p["length"] for p in pieces)
    assert total == sum(len(x) for v in want.values() for x in v)
    for doc, lists in want.items():
        if len(lists) == 1:
            own = sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"])
            at = 0
            for p in own:
                ids = np.array(lists[0][at:at + p["length"]], "<u4")
                assert p["start"] == at and p["doc_tokens"] == len(lists[0]) and p["ids_crc32"] == zlib.crc32(ids.tobytes())
                at += p["length"]
            assert at == len(lists[0])
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_pads_little(spark):
    rng = random.Random(4)
    docs = documents(spark, [prose(rng, int(rng.paretovariate(1.1) * 40) % 5000 + 1) for _ in range(300)]).coalesce(1)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).agg({"length": "sum", "padded_length": "sum"}).first()
    assert got["sum(padded_length)"] < 1.01 * got["sum(length)"]


def test_a_small_memo_and_step_bound_a_worker_but_not_its_ids():
    from anchorline.llm import tokens
    path = tokens.vocabulary_path("word_bpe_49k.json")
    texts = [" ".join(f"word{i}x{j}" for j in range(40)) for i in range(60)]
    small, large = tokens.tokenizer(path, 100), tokens.tokenizer(path)
    got = [small.encode([t])[0] for t in texts]
    assert got == large.encode(texts) and len(small.memo) + len(small.older) <= 400 and small is tokens.tokenizer(path, 100) is not large
