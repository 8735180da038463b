"""Line, passage and near-duplicate operators against brute force."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from llmhelp import components, documents, odd_rows, prose
from pyspark.sql import functions as F

from anchorline.llm import components as graph
from anchorline.llm import line_dedup, simhash, substring

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def lines_by_hand(rows, least):
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = lower(line.strip(SPACE))
            if doc is not None and len(k) >= least:
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if doc is None or first.get(lower(x.strip(SPACE)), doc) == doc]
        out.append((doc, None if text is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r)))


@pytest.mark.parametrize("parts", [1, 9])
def test_lines(spark, parts, monkeypatch):
    rng = random.Random(1)
    common = [prose(rng, 5) for _ in range(12)] + ["  Ünïcode line \t", "short", "\x0b exactly10\x0c"]
    texts = ["\n".join(rng.choice(common + [prose(rng, 4)]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += [x.upper() if x.isascii() else x for x in texts[:5]] + ["the common line of all"] * 30 + ["", None]
    monkeypatch.setattr(line_dedup, "spread", lambda df: parts)
    rows = list(enumerate(texts))
    got = line_dedup.apply(documents(spark, texts), counts=("n", "gone")).select("doc_id", "text", "n", "gone").collect()
    assert by_id(map(tuple, got)) == by_id(lines_by_hand(rows, 10))


def test_lines_of_odd_rows(spark):
    docs, rows = odd_rows(spark)
    got = line_dedup.apply(docs)
    assert got.columns == docs.columns
    assert by_id((r["doc_id"], r["text"]) for r in got.collect()) == by_id(x[:2] for x in lines_by_hand([r[:2] for r in rows], 10))
    maps = line_dedup.keep_bitmaps(docs).collect()
    assert len(maps) == len({(r[0], r[1] or "") for r in rows}) and all(zlib.decompress(m["keep"]) for m in maps)
    assert line_dedup.apply(docs.limit(0)).count() == 0


def passages_by_hand(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("step", [300, 1 << 21])
def test_passages(spark, monkeypatch, step):
    rng = random.Random(2)
    shared = [prose(rng, n) for n in (34, 35, 36, 80)]
    texts = []
    for _ in range(40):
        texts.append("  ".join([prose(rng, rng.randrange(0, 60)), rng.choice(shared), prose(rng, rng.randrange(0, 60)), rng.choice(shared)]))
    texts += [texts[0], texts[1], "same word " * 60, None, "", "few words", prose(rng, 35), " \n ".join([shared[1], shared[1]])]
    monkeypatch.setattr(substring, "STEP", step)
    got = substring.apply(documents(spark, texts), counts=("n", "gone")).orderBy("doc_id").collect()
    for r, text, want in zip(got, texts, passages_by_hand(texts, 35)):
        assert (r["n"], r["gone"], " ".join(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))) == want
        if not r["gone"]:
            assert r["text"] == text


def test_no_group_of_an_anchor_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", 64, raising=False)
    monkeypatch.setattr(substring, "STEP", 3000)
    rng = random.Random(8)
    phrase, shared = prose(rng, 20), [prose(rng, 40) for _ in range(3)]
    texts = [" ".join([prose(rng, 40), phrase, prose(rng, 40), *([f"{s} {phrase} {s}" for s in [rng.choice(shared)]] if i % 5 == 0 else [])]) for i in range(150)]
    largest = []
    whole_runs = substring.whole_runs

    def watched(batches, keys):
        for table, starts in whole_runs(batches, keys):
            n = np.where(np.asarray(table.column("hashes").combine_chunks().is_null()), 0, table.column("n").to_numpy())
            largest.append(int(np.add.reduceat(n, starts).max()))
            yield table, starts

    docs = documents(spark, texts)
    got = substring.apply(docs, counts=("n", "gone")).orderBy("doc_id").collect()
    assert [(r["n"], r["gone"]) for r in got] == [w[:2] for w in passages_by_hand(texts, 35)]
    # the second pass, in this process
    rows = []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, **b: (rows.append(self.toArrow().to_batches()) if "anchor" in self.columns else None, real(self, f, schema, *a, **b))[1])
    substring.spans(docs)
    monkeypatch.setattr(substring, "whole_runs", watched)
    for _ in substring._spans_of(iter(sorted_by_anchor(rows[-1])), 35):
        pass
    assert largest and max(largest) < 4 * 64


def sorted_by_anchor(batches):
    import pyarrow as pa
    return pa.Table.from_batches(batches).sort_by("anchor").combine_chunks().to_batches()


def test_passages_of_odd_rows(spark):
    docs, rows = odd_rows(spark)
    got = substring.apply(docs)
    want = passages_by_hand([r[1] for r in rows], 35)
    assert got.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], " ".join(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))) for r in got.collect()), key=key) == sorted(((r[0], w[2]) for r, w in zip(rows, want)), key=key)
    assert substring.apply(docs.limit(0)).count() == 0


def fingerprint_by_hand(text, shingle=3):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    grams = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def variants(rng, n, size):
    base = [prose(rng, size).split() for _ in range(n)]
    out = [" ".join(w) for w in base]
    for w in base:
        for edits in (1, 2, 4):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = "edit%d" % rng.randrange(1000)
            out.append(" ".join(v))
    return out


@pytest.mark.parametrize("partitions", [None, (2,), (3,), (4,)])
def test_simhash_components(spark, partitions, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = random.Random(3)
    texts = variants(rng, 30, 120) + ["", None, " \n", "one two", "ONE two", "a b c"] + [prose(rng, 60)] * 20
    fps = [fingerprint_by_hand(t) for t in texts]
    got = simhash.near_duplicates(documents(spark, texts), partitions=partitions).orderBy("doc_id").collect()
    assert [int.from_bytes(r["fp"], "big") for r in got] == fps
    assert [r["component_id"] for r in got] == components(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert len({r["component_id"] for r in got}) < len(set(fps))


def test_thresholds_are_a_pigeonhole_and_follow_cost():
    cost, chosen = simhash.allocate([{-1: 0, 0: 5, 1: 50, 2: 500, 3: 5000}, {-1: 0, 0: 1, 1: 2, 2: 3, 3: 90}, {-1: 0, 0: 4, 1: 40, 2: 400, 3: 4000}], 4)
    assert sum(t + 1 for t in chosen) == 4 and chosen == [-1, 2, 0] and cost == 7


def test_bits_group_by_correlation(spark):
    rng = np.random.default_rng(0)
    half = rng.integers(0, 2, (500, 32), dtype=np.uint8)
    fps = np.packbits(np.concatenate([half, half], 1), axis=1)  # bit i repeats bit i + 32
    df = spark.createDataFrame([(bytearray(x.tobytes()), i) for i, x in enumerate(fps)], "fp binary, node long")
    groups = simhash.group_bits(simhash.correlation(df, 500, 1)[0], 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all((b + 32) % 64 in g for g in groups for b in g)


def test_similar_documents_leave_one(spark):
    rng = random.Random(6)
    texts = variants(rng, 25, 300)
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, texts)).collect()}
    assert set(range(25)) <= kept and len(kept) <= 27
    docs, rows = odd_rows(spark)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({1: 1, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1, 10: 1, None: 2})
    assert simhash.keep_one(docs.limit(0)).count() == 0
    near = simhash.near_duplicates(docs)
    assert near.count() == len(rows) and near.where("doc_id IS NULL AND component_id IS NOT NULL").count() == 0


def shingles_by_hand(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}


def jaccard_by_hand(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("block", [7, 512])
def test_similarity_is_decided_exactly_near_the_bound(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SETS", block)
    rng = random.Random(12)
    base = [prose(rng, rng.choice((8, 30, 90, 200, 600))).split() for _ in range(120)]
    texts = [" ".join(w) for w in base]
    for w in base:  # a changed tail of one in eight to one in twelve of the words: similarities of about 0.7 to 0.85
        cut = max(1, round(len(w) / rng.uniform(6, 12)))
        texts.append(" ".join([*w[:-cut], *prose(rng, cut).split()]))
    texts += [" ".join(["the same six words again and"] * 20 + base[0]), *[" ".join(base[1][:-k]) for k in range(1, 40)], "", None, "one two", "ONE two"]
    sets = [shingles_by_hand(t) for t in texts]
    alike = [[jaccard_by_hand(a, b) for b in sets] for a in sets]
    assert sum(0.7 < alike[i][i + 120] < 0.8 for i in range(120)) > 15 < sum(0.8 <= alike[i][i + 120] < 0.9 for i in range(120))
    root = components(list(range(len(texts))), lambda i, j: alike[i][j] >= 0.8)
    assert {r["doc_id"] for r in simhash.keep_one(documents(spark, texts)).collect()} == set(root)


def test_components_of_paths_stars_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUBS", 5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 499), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {499: 499, 500: 499}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("steps", [10, 100, 1000])
def test_one_passage_in_every_step_leaves_groups_flat(spark, monkeypatch, steps):
    monkeypatch.setattr(substring, "GROUP", 64)
    monkeypatch.setattr(substring, "STEP", 300)
    rng = random.Random(9)
    passage = prose(rng, 45)
    texts = [f"{prose(rng, 12)} {passage} {prose(rng, 6)}" for _ in range(steps)]
    groups, real = [], spark.createDataFrame([], "x int").__class__.mapInArrow
    monkeypatch.setattr(spark.createDataFrame([], "x int").__class__, "mapInArrow", lambda self, f, schema, *a, **b: (groups.append(self) if "parts" in self.columns else None, real(self, f, schema, *a, **b))[1])
    got = substring.apply(documents(spark, texts), counts=("n", "gone"))
    largest = groups[-1].where("hashes IS NOT NULL").groupBy("anchor").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert largest <= 4 * 64
    assert [(r["n"], r["gone"]) for r in got.select("doc_id", "n", "gone").orderBy("doc_id").collect()] == [w[:2] for w in passages_by_hand(texts, 35)]


def test_of_rows_with_one_id_the_same_text_stays(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    kept = {tuple(r["text"] for r in simhash.keep_one(documents(spark, texts * n).withColumn("doc_id", F.lit(7).cast("bigint")).repartition(p)).collect()) for n, p in ((1, 1), (3, 5))}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def near_the_bound(rng, n):
    base = [prose(rng, rng.choice((8, 30, 90, 200, 600))).split() for _ in range(n)]
    texts = [" ".join(w) for w in base]
    for w in base:
        cut = max(1, round(len(w) / rng.uniform(6, 12)))
        texts.append(" ".join([*w[:-cut], *prose(rng, cut).split()]))
    return texts


@pytest.mark.parametrize("common", [False, True])
def test_no_similar_pair_depends_on_the_minima(spark, monkeypatch, common):
    """With minima that propose nothing at all the groups are those of brute force."""
    monkeypatch.setattr(simhash, "equal_minima", lambda jaccard, miss=0.0: simhash.ROWS * simhash.BANDS + 1)
    if common:  # all shingles in the cells of large buckets
        monkeypatch.setattr(simhash, "BLOCK", 0.4)
        real = simhash.cells
        monkeypatch.setattr(simhash, "cells", lambda rows, keys, by, limit: real(rows, keys, by, 3))
    texts = near_the_bound(random.Random(13), 60)
    sets = [shingles_by_hand(t) for t in texts]
    root = components(list(range(len(texts))), lambda i, j: jaccard_by_hand(sets[i], sets[j]) >= 0.8)
    assert len(set(root)) < len(texts) - 10
    assert {r["doc_id"] for r in simhash.keep_one(documents(spark, texts)).collect()} == set(root)


def test_similar_sets_share_one_of_their_first_shingles():
    rng = np.random.default_rng(4)
    ranks = rng.integers(0, 4, simhash.PLACES).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, int(rng.integers(len(a) // 2, len(a) + 1)), False), rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), np.uint64)]))
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
            assert set(simhash.first_shingles(a, ranks, 0.8)) & set(simhash.first_shingles(b, ranks, 0.8))
