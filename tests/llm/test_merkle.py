"""Midstates against hashlib, and the manifest against a tree built by recursion."""
import hashlib
import zlib

import numpy as np
import pytest
from llmhelp import DOCS, documents, odd_rows
from pyspark.sql import functions as F

from anchorline.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """Levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, at):
    for level in levels[:-1]:
        yield at & 1, [level[at ^ 1]] if (at ^ 1) < len(level) else []
        at //= 2


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root)."""
    trees = {}
    for r in rows:
        trees.setdefault(b"" if r[2] is None else b"1" + r[2].encode(), []).append(r)
    order = sorted(trees)
    levels = {k: climb([x[1] for x in sorted(((r[0] is not None, r[0] or 0), leaf_of(*r)) for r in trees[k])]) for k in order}
    top = climb([levels[k][-1][0] for k in order])
    out = []
    for i, k in enumerate(order):
        places = sorted(trees[k], key=lambda r: ((r[0] is not None, r[0] or 0), leaf_of(*r)))
        for at, r in enumerate(places):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            now, proof = leaf_of(*r[:4], r[4] + 1) if changed else leaf_of(*r), []
            for slot, sibling in [*way(levels[k], at), *way(top, i)]:
                now = h(*(sibling + [now] if slot else [now] + sibling))
                proof += sibling
            out.append((r[0], leaf_of(*r), levels[k][-1][0], top[-1][0], h(*proof), now))
    return sorted(out, key=str)


def result(docs):
    changed = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    done = merkle.verify(docs, FIELDS, changed, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], h(bytes(r["proof"]).hex()), r["folded_root"]) for r in done.collect()), key=str)


def test_states_are_those_of_the_hash():
    digests = np.random.default_rng(1).integers(0, 2**32, (9, 8), np.uint32)
    text = [d.astype(">u4").tobytes().hex() for d in digests]
    levels, states = merkle.tree_levels(digests)
    assert [[x.astype(">u4").tobytes().hex() for x in level] for level in levels] == climb(text)
    resumed = merkle.compress(merkle.feed(states[0][:4], digests[1::2]), merkle._END[2])
    assert [x.astype(">u4").tobytes().hex() for x in resumed] == climb(text)[1][:4]


@pytest.mark.parametrize("levels", [2, 12])
def test_every_row_folds_to_the_root(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i, f"text {i % 5}", ["en", "de", None, "fr", "zz", "ä"][i * i % 6], None if i % 4 else "s", None if i % 9 == 0 else i) for i in range(61)]
    assert result(spark.createDataFrame(rows, DOCS).repartition(5)) == brute(rows)


def test_defined_cases(spark):
    docs, rows = odd_rows(spark)
    assert result(docs) == brute(rows)
    assert result(docs.limit(0)) == []
    one = documents(spark, ["alone"], 3)
    assert result(one) == brute([(3, "alone", "en", "s", 5)])


def test_copies_of_a_row_are_spread(spark):
    rows = [(1, "same", "en", "s", 4)] * 3000 + [(i, "other", "de", "s", 5) for i in range(200)]
    leaves = merkle.positions(spark.createDataFrame(rows, DOCS).select(F.col("lang").alias("tree"), "doc_id"), ["doc_id"])
    assert sorted(r["position"] for r in leaves.where("tree = 'en'").collect()) == list(range(3000))
    assert {r["size"] for r in leaves.where("tree = 'de'").collect()} == {200}
