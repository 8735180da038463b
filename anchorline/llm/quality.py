"""Document quality by Bradley-Terry ranking.

Preferences are pairs of labelled documents of which one is labelled better. Each document has a strength w . x over features of its whole text, the chance
that i beats j is the logistic function of w . (x_i - x_j), and w minimises the logistic loss over feature differences (Newton steps, ridge). The decision
threshold is a quantile of the strengths of the training documents: the share labelled 0. The score is the logistic function of the strength, shifted so
that the threshold has score `cut` and scaled by the spread between the classes.

Features are ratios of what the text is made of (bytes, words, repeats, punctuation), none of language, source or id. The model is fitted on at most about
`max_rows` labelled rows and is a few dozen numbers; every document is scored in one pass without a shuffle.

Inputs. A null or empty text is scored like any other, by its features, all zero but one. Rows with equal ids or texts are scored one by one; null ids have
held_out false. Without labelled rows of both kinds all strengths are 0, which gives the score 0.5. An empty table gives an empty result. Further columns of
the input are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from anchorline.llm.common import pick, steps
from anchorline.llm.substring import hash_words, words_of

#: Pairs that each training document takes part in on its own side.
PAIRS = 4
_MARKS = b".,;:!?|#$%&*\"'()-_/\\<>[]{}=+@~^`"


def features(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    start, end = words_of(raw)
    n = len(start)
    if not n:
        return np.array([1.0] + [0.0] * 29)
    count = np.bincount(raw, minlength=256)
    length = end - start
    words = hash_words(raw, start, end)
    distinct, times = np.unique(words, return_counts=True)
    pairs = words[1:] * np.uint64(3) + words[:-1]
    mark = np.zeros(256, bool)
    mark[list(_MARKS)] = True
    last, second = mark[raw[end - 1]], (length > 1) & mark[raw[np.maximum(end - 2, 0)]]
    upper, lower = count[65:91].sum(), count[97:123].sum()
    total = len(raw)
    same = words[1:] == words[:-1]
    letters = (raw >= 128) | ((raw | 32) >= 97) & ((raw | 32) <= 122)
    has_letter = np.add.reduceat(letters.astype(np.int32), start) > 0
    ratio = [same.mean() if n > 1 else 0.0, times.max() / n if n > 20 else 0.0, 1 - len(np.unique(pairs)) / max(1, n - 1), 1 - len(distinct) / n,
             upper / max(1, upper + lower), count[48:58].sum() / total, count[128:].sum() / total, (last & second).mean(), last.mean(), (~has_letter).mean(), (length == 1).mean(),
             count[ord("!")] / n, count[ord("?")] / n, count[ord("|")] / n, count[list(b"#$%&*")].sum() / n, count[ord(".")] / n, count[ord(",")] / n, count[list(b"<>{}[]=\\_@~^")].sum() / n,
             count[10] / n, count[list(b"\"'()")].sum() / n, (length > 25).mean(), count[list(b":;/-+")].sum() / n, (count[:9].sum() + count[14:32].sum() + count[127]) / total]
    return np.array([0.0, np.log1p(n), np.log1p(n) ** 2 / 10, length.mean() / 10, length.std() / 10, np.log(len(distinct)) / np.log(n) if n > 1 else 1.0, float(n < 20), *np.log1p(50 * np.array(ratio))])


class BradleyTerry:
    def __init__(self, x: np.ndarray, label: np.ndarray, cut: float, ridge: float = 1e-3):
        self.cut = cut
        self.mean, self.scale, self.w = np.zeros(30), np.ones(30), np.zeros(30)
        self.threshold, self.slope, self.offset = 0.0, 1.0, 0.0
        good, bad = x[label == 1], x[label == 0]
        if not len(good) or not len(bad):
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._standard(x)
        good, bad = z[label == 1], z[label == 0]
        rng = np.random.default_rng(11)
        win = np.concatenate([np.repeat(np.arange(len(good)), PAIRS), rng.integers(0, len(good), PAIRS * len(bad))])
        lose = np.concatenate([rng.integers(0, len(bad), PAIRS * len(good)), np.repeat(np.arange(len(bad)), PAIRS)])
        difference = good[win] - bad[lose]
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))  # chance of the wrong order
            slope = -difference.T @ p / len(p) + ridge * w
            curve = (difference * (p * (1 - p))[:, None]).T @ difference / len(p) + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        strength = np.sort(z @ w)
        n_bad = int((label == 0).sum())
        self.threshold = float((strength[n_bad - 1] + strength[min(n_bad, len(strength) - 1)]) / 2)  # the quantile of the share labelled 0
        self.slope = 6.0 / max(float(np.median(good @ w) - np.median(bad @ w)), 1e-6)
        self.offset = float(np.log(cut / (1 - cut)))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self._standard(x) @ self.w - self.threshold) + self.offset, -40, 40)))


def fit(training: DataFrame, cut: float = 0.7) -> BradleyTerry:
    """From (doc_id, text, label); features are computed in Spark, a row of thirty numbers per training document comes to the driver."""
    def run(batches):
        for batch in steps(batches):
            x = [features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "label"])

    rows = sorted(training.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, x array<double>, label int").collect())
    return BradleyTerry(np.array([r["x"] for r in rows]).reshape(-1, 30), np.array([r["label"] for r in rows]), cut)


def score(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    def run(batches):
        for batch in steps(batches):
            s = model.score(np.array([features(t) for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s)], names=["doc_id", "score"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, score double")
