"""Prefix table against the sentencepiece library."""
import random

import public_tokenizers
import pytest
import sentencepiece
from llmhelp import documents, odd_rows, prose

from anchorline.llm import sentence_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [" " * n + w for n in (0, 1, 2, 15, 16, 17, 18, 31, 32, 33, 49) for w in ("", "the", "x ", "\n  a")] + [
    "日本語のテキスト \U0001f389 عربى " * 9, "a\x00b", "<s>hi</s> <unk> <0x41>", "▁a ▁ b▁", "=" * 77, "0" * 33, "a" * 3000, "ab" * 999, "é 　x", "\t\r\n\x0b"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(code, library, texts):
    import numpy as np
    for text, ids in zip(texts, code.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text), repr(text)


def test_encodes_as_the_library(library, monkeypatch):
    monkeypatch.setattr(sentence_bpe, "MEMO_ENTRIES", 500)
    monkeypatch.setattr(sentence_bpe, "PAIR_ENTRIES", 500)
    code, rng = sentence_bpe.PrefixBpe(PATH), random.Random(1)
    pieces = list(code.ids)
    same(code, library, ODD)
    for _ in range(10):
        same(code, library, ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 60))) for _ in range(300)])
        same(code, library, ["".join(rng.choice(pieces) for _ in range(rng.randrange(2, 12))) for _ in range(300)])
        same(code, library, ["".join(rng.choice("ab ,.'!\n1é́Σ_-日本\x00 ") for _ in range(100)) for _ in range(50)])


def test_compatible_pairs_are_those_that_merging_leaves(library):
    code, rng = sentence_bpe.PrefixBpe(PATH), random.Random(2)
    ids = [i for i in code.ids.values() if code.rank[i] < 4000]
    for _ in range(20000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert code.compatible(a, b) == (code.merge(code.pieces[a] + code.pieces[b]) == [a, b])


def test_rows_of_a_table(spark, library):
    docs, rows = odd_rows(spark)
    done = sentence_bpe.decode(sentence_bpe.encode(docs, PATH), PATH).collect()
    want = sorted((str(r[0]), library.encode(r[1] or "", add_eos=True)) for r in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in done) == want
    assert sorted(r["decoded"] for r in done) == sorted(library.decode(i) for _, i in want)
    assert sentence_bpe.encode(docs.limit(0), PATH).count() == 0
    rng = random.Random(3)
    texts = [prose(rng, 500), None, ""]
    again = sentence_bpe.decode(sentence_bpe.encode(documents(spark, texts), PATH), PATH)
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {0: texts[0], 1: "", 2: ""}
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert sentence_bpe.decode(nulls, PATH).first()["decoded"] == ""


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"\x12\x02\x18\x01")  # a unigram model
    with pytest.raises(ValueError):
        sentence_bpe.PrefixBpe(str(path))
