"""Classifiers on held-out rows and odd input; vector operators against brute force; the pipeline."""
import random
import zlib

import numpy as np
import pytest
from llmhelp import DOCS, components, documents, odd_rows, prose

from pyspark.sql import functions as F

from anchorline.llm import ann, embedding_dedup, quality, toxicity
from anchorline.llm.labelled import fold, training_rows

VEC = "vec_id long, embedding array<float>, label int"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)


def test_training_rows_leave_out_the_held_out_fold(spark):
    docs = documents(spark, [f"t{i}" for i in range(200)])
    known = labels(spark, [(i, i % 2, 0) for i in range(150)] + [(3, 0, 0), (4, None, 0), (None, 1, 1)])
    got = {r["doc_id"]: r["label"] for r in training_rows(docs, known, "quality", 4, 2, 10_000).collect()}
    assert got == {i: i % 2 for i in range(150) if zlib.crc32(str(i).encode()) % 4 != 2 and i != 3}
    few = training_rows(docs, known, "quality", 4, 2, 20).count()
    assert 0 < few < 60


def test_quality_ranks_held_out_documents(spark):
    rng = random.Random(1)
    junk = [lambda: " ".join(w + "###" for w in prose(rng, 60).split()), lambda: " | ".join(prose(rng, 40).split()), lambda: prose(rng, 30).upper().replace(" ", "!! "), lambda: " ".join(w for w in prose(rng, 8).split() for _ in range(9))]
    texts = [prose(rng, rng.randrange(5, 300)).capitalize() + "." if i % 5 else rng.choice(junk)() for i in range(500)]
    docs = documents(spark, texts)
    known = labels(spark, [(i, int(i % 5 > 0), 0) for i in range(500)])
    model = quality.fit(training_rows(docs, known, "quality", 4, 2, 10_000))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    out = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == (i % 5 > 0) for i in out) >= 0.97 * len(out)
    odd, rows = odd_rows(spark)
    scored = quality.score(odd, model).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    none = quality.fit(training_rows(docs, known.limit(0), "quality", 4, 2, 100))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def brute_distance(a, b):
    """Edits, with transposition of neighbours."""
    d = {}
    for i in range(-1, len(a) + 1):
        d[i, -1] = i + 1
    for j in range(-1, len(b) + 1):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8))) for _ in range(30)]
    lexicon = toxicity.Lexicon([(t, False, 5.0) for t in terms], [])
    for _ in range(3000):
        word = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
        exact = word in terms
        close = any(brute_distance(word, t) == 1 for t in terms if len(t) >= toxicity.FUZZY_FROM)
        found = lexicon.match(word)
        assert (found[0] if found else 0) == (1 if exact else 2 if close else 0), word
    begins = toxicity.Lexicon([("abra", True, 3.0)], ["known"])
    assert begins.match("abracad!")[0] == 1 and begins.match("abr") is None


def test_toxicity_finds_misspelling_and_spares_quotation(spark):
    rng = random.Random(3)
    bad = ["grobnik", "vulgrath", "sneerbag"]

    def mean(words):
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    texts = [mean(prose(rng, 60).split()) if i % 6 == 0 else prose(rng, 60) + ' they said "%s" then' % rng.choice(bad) if i % 6 == 1 else prose(rng, 60) for i in range(600)]
    docs = documents(spark, texts)
    known = labels(spark, [(i, 1, int(i % 6 == 0)) for i in range(600)])
    model = toxicity.fit(training_rows(docs, known, "toxic", 3, 1, 10_000), precision=0.4)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 6 == 0) for i in out) >= 0.97 * len(out)
    typo, quote, plain = model.score(["you vulgarth and you snerbag and grobnlk", 'he wrote "grobnik" there', "ba ke lo"])
    assert typo > quote and typo > plain
    odd, rows = odd_rows(spark)
    assert toxicity.score(odd, model).count() == len(rows)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i] < 0.7}
    none = toxicity.fit(training_rows(docs, known.limit(0), "toxic", 3, 1, 100))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5} and toxicity.reject(docs, none).count() == 600
    assert toxicity.score(docs.limit(0), model).count() == 0


def cloud(rng, n, dim=16):
    """Random vectors, a dense cluster, copies, and near copies."""
    x = rng.standard_normal((n, dim))
    dense = rng.standard_normal(dim) + 0.02 * rng.standard_normal((n // 3, dim))
    near = x[:20] + 0.03 * rng.standard_normal((20, dim))
    return np.concatenate([x, dense, near, np.repeat(x[:1], 30, 0), 3 * x[1:2]]).astype(np.float32)


BAD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1), (9006, [], 1), (9007, [1.0] * 16, None), (None, [1.0] * 16, 1), (9008, [1.0, 2.0], 1)]


@pytest.mark.parametrize("leaf,block", [(40, 512), (60, 16)])
def test_vector_links(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    x = cloud(np.random.default_rng(4), 240)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + BAD, VEC)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, leaf=leaf, trees=8, spill=1.5).collect() if r["vec_id"] is not None}
    y = x.astype(float)
    cos = y @ y.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    link = (cos >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2) & ~np.eye(len(x), dtype=bool)
    want = components(list(range(len(x))), lambda i, j: link[i, j])
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), want[i], want[i] == i)
    for b in BAD:
        if b[0] is not None:
            assert (got[b[0]]["n_links"], got[b[0]]["component_id"], got[b[0]]["kept"]) == (0, b[0], True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    again = embedding_dedup.near_duplicates(spark.createDataFrame([*rows[:3], rows[0]], VEC)).collect()
    assert sorted(r["vec_id"] for r in again) == [0, 0, 1, 2]


def test_labels_are_kept_apart_where_their_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "group_of", lambda label, vector: F.lit(0).cast("bigint"))
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 1, 7, 7, 7), (2, v, 2, 7, 7, 7), (3, [2 * x for x in v], 1, 7, 7, 7), (4, [3 * x for x in v], 2, 7, 7, 7), (5, v, None, 7, 7, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, grp long, code long, copies long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, True), 3: (1, 1, False), 4: (1, 2, False), 5: (0, 5, True)}


def test_nearest_neighbours(spark):
    x = cloud(np.random.default_rng(5), 600)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + BAD, VEC)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y = np.concatenate([x.astype(float), np.ones((1, 16))])
    ids = np.array([*range(len(x)), 9007])
    cos = y @ y.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    hits = 0
    queries = [i for i in range(len(x)) if i % 10 == 0]
    assert set(got) == set(queries)
    for q in queries:
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - cos[q, np.flatnonzero(ids == m[1])[0]]) < 1e-12 for m in mine)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(mine, mine[1:]))
        s = cos[q].copy()
        s[q] = -9
        floor = np.sort(s)[-5]
        hits += sum(m[2] >= floor - 1e-12 for m in mine)
    assert hits >= 0.9 * 5 * len(queries)
    few = ann.search(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0 and ann.search(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def exact_nearest(rows, q, k=5):
    """The k nearest of row q among rows (id, vector) of its length, by the definition."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    score = ann.cosines(np.broadcast_to(x[q], x.shape), x)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
    return [(rank + 1, int(ids[i]), float(score[i])) for rank, i in enumerate(order)]


@pytest.mark.parametrize("block", [4096, 7])
def test_full_comparison_keeps_ties_whatever_the_cells(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "VECTORS", block)
    monkeypatch.setattr(ann, "BLOCK", block)
    x = np.random.default_rng(8).standard_normal((60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 - i, (x[0] * 2.0 ** i).tolist()) for i in range(1, 31)]  # thirty equal cosines, smaller ids last
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.full_cells(df, df.where("vec_id % 4 = 0"), 5, len(rows), 22).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {r[0]: exact_nearest(rows, at) for at, r in enumerate(rows) if r[0] % 4 == 0}
    assert {q: sorted(v) for q, v in got.items()} == want
    ids = np.array([0, 4])
    one = ann.full_scan(df, ids, x[ids], 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in one) == sorted((q, *t) for q in (0, 4) for t in want[q])


def test_every_length_is_searched_and_odd_rows_have_a_defined_result(spark):
    rng = np.random.default_rng(9)
    long, short = rng.standard_normal((40, 12)), rng.standard_normal((9, 3))
    rows = [(i, v.tolist(), 1, 0.5, 7, 8) for i, v in enumerate(long)] + [(200 + i, v.tolist(), 1, 0.5, 7, 8) for i, v in enumerate(short)]
    rows += [rows[0], (10, [9.0] * 12, 1, 0.5, 7, 8)]  # a repeated row, and an id with two vectors: the one that sorts first counts
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double, query_id long, asks long")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 2 == 0, cover=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    one = {}
    for i, v, *_ in rows:
        one[i] = min(v, one.get(i, v))
    for lot in ([r for r in one.items() if r[0] < 200], [r for r in one.items() if r[0] >= 200]):
        for at, (i, _) in enumerate(lot):
            if i % 2 == 0:
                mine, want = sorted(got.pop(i)), exact_nearest(lot, at)
                assert len(mine) == 5 and sum(m[1] in {w[1] for w in want} for m in mine) >= 4
    assert not got


def test_probing_retrieves_every_code_within_the_radius(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    codes = ann.Codes(x, 64)
    for radius in (3, 11, 20):
        assert sum(t + 1 for t in ann.thresholds(radius, 8)) == radius + 1
        got = [tuple(r) for r in ann._within(df, df.where("vec_id % 7 = 0"), codes, radius, 64, 300, 43).collect()]
        apart = np.bitwise_count(codes.of(x)[:, None] ^ codes.of(x)[None]).sum(2)
        want = {(i, j) for i in range(0, 300, 7) for j in range(300) if i != j and apart[i, j] <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_lexicon_is_the_same_however_rows_are_dealt(spark):
    rng = random.Random(11)
    rows = []
    for i in range(240):
        toxic = i % 3 == 0
        words = prose(rng, 30).split() + (["vilescum", "rotbrain"] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    rows += [(1000 + i, rows[i][1] + " tail%d" % i, rows[i][2]) for i in range(60)]  # near copies, of which one is learned from
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    a, b = toxicity.fit(df.repartition(1)), toxicity.fit(df.orderBy(F.desc("doc_id")).repartition(7, "text"))
    texts = [r[1] for r in rows] + ["", None, "You vilescumm", "'vilescum'"]
    assert (a.score(texts) == b.score(texts)).all() and a.score(["vilescum rotbrain"])[0] > 0.7 > a.score([""])[0]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(80)]
    texts += [texts[0], texts[1] + " x", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, 1, int(i % 9 == 0)) for i in range(60)]).write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "substring_dedup", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for some in (now, now.limit(0), odd_rows(spark)[0]):
            out = stage(spark, some, str(tmp_path))
            assert at == 4 or out.columns == some.columns
            out.count()
        if at < 4:
            now = stage(spark, now, str(tmp_path))
            now.write.parquet(f"{tmp_path}/{at}")
            now = spark.read.parquet(f"{tmp_path}/{at}")
    left = {r["doc_id"]: r["text"] for r in now.collect()}
    assert 80 not in left or not left[80]
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.count() and {r["doc_id"] for r in done.select("doc_id").collect()} == set(left)


def test_no_probe_or_pair_goes_through_the_driver(spark, tmp_path):
    """Spark sees tables as large as what Python made them from, so it would broadcast all probes of few queries."""
    x = np.random.default_rng(3).normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/vectors")
    df = spark.read.parquet(f"{tmp_path}/vectors")  # of known size
    queries = df.where("vec_id % 100 = 0")
    pairs = ann._within(df, queries, ann.Codes(x, 64), 20, 64, 300, 3)
    for found in (pairs, ann._rerank(pairs, df, queries)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
