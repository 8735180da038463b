"""Small tables and brute force for the training-data operators."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "sto", "ti", "vo", "ze") for b in ("den", "fal", "gor", "him", "kas", "lun", "mer", "pol", "ras", "ton")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 4), (4, "one", None, "s", 3), (5, long, "en", None, len(long)), (6, long, "en", "s", len(long)),
            (6, long, "en", "s", len(long)), (7, prose(rng, 60), "en", "s", 1), (7, prose(rng, 50), "en", "s", 1), (None, "no id at all here", "en", "s", 1), (None, None, None, None, None),
            (8, "x" * 40000, "en", "s", 40000), (9, "naïve  café\n\nzwei  Zeilen \U0001f389", "de", "s", 9), (10, "a\x00b \x1f c\x85d", "en", "s", 7)]
    extra = "component_id long, fp string, start long, ids string, score double, keep string, label int, vec_id long, tree int, text_key long, n_lines long"
    return spark.createDataFrame([(*r, 1, "f", 2, "i", 0.5, "k", 3, 4, 5, 6, 7) for r in rows], f"{DOCS}, {extra}"), rows


def components(ids, linked):
    """Smallest id reachable, by brute force over linked(i, j)."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [ids[find(i)] for i in range(len(ids))]
